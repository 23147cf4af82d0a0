"""References against the examples of RFC 3986, section 5.4, and against the resolver of single addresses."""

import random

from pyspark.sql import functions as F

from marquee.functions.address import resolved, without_dots
from marquee.sources.extract import resolve

BASE = "http://a/b/c/d;p?q"
# The normal and abnormal examples of the RFC.
EXAMPLES = """g:h g:h|g http://a/b/c/g|./g http://a/b/c/g|g/ http://a/b/c/g/|/g http://a/g|//g http://g|?y http://a/b/c/d;p?y|g?y http://a/b/c/g?y|#s http://a/b/c/d;p?q#s|g#s http://a/b/c/g#s|g?y#s http://a/b/c/g?y#s
;x http://a/b/c/;x|g;x http://a/b/c/g;x|g;x?y#s http://a/b/c/g;x?y#s| http://a/b/c/d;p?q|. http://a/b/c/|./ http://a/b/c/|.. http://a/b/|../ http://a/b/|../g http://a/b/g|../.. http://a/|../../ http://a/|../../g http://a/g
../../../g http://a/g|../../../../g http://a/g|/./g http://a/g|/../g http://a/g|g. http://a/b/c/g.|.g http://a/b/c/.g|g.. http://a/b/c/g..|..g http://a/b/c/..g|./../g http://a/b/g|./g/. http://a/b/c/g/|g/./h http://a/b/c/g/h|g/../h http://a/b/c/h
g;x=1/./y http://a/b/c/g;x=1/y|g;x=1/../y http://a/b/c/y|g?y/./x http://a/b/c/g?y/./x|g?y/../x http://a/b/c/g?y/../x|g#s/./x http://a/b/c/g#s/./x|g#s/../x http://a/b/c/g#s/../x|http:g http:g"""


def of(spark, pairs):
    rows = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(pairs)], "i int, b string, r string")
    return [x.u for x in rows.select("i", resolved(F.col("b"), F.col("r")).alias("u")).orderBy("i").collect()]


def test_examples_of_the_rfc(spark):
    pairs = [x.split(" ") for x in EXAMPLES.replace("\n", "|").split("|")]
    assert len(pairs) == 42 and of(spark, [(BASE, r) for r, _ in pairs]) == [u for _, u in pairs]


def test_references_equal_the_resolver(spark):
    rng = random.Random(3)
    fixed = ["x", " /a b ", "", ":", "a:b", "1:b", "./a:b", "mailto:x", "%zz", "a?%zz", "a%2", "a\tb", "//h:99999/", "//h:x/", "//[::1]:80/p", "//[bad/", "http://u@h:1/", "?a=b", "a/b?c#d", "é/ü", "https://[", "../../../x", "/a/./b/../c", "..", "."]
    bases = ["https://s.test/a/b/c?x=1", "https://s.test", "https://s.test/a/", "https://[s.test/", "http://h:80/x/y#f"]
    parts = ["a", "b.c", "..", ".", "e%20f"]
    pairs = [(b, r) for b in bases for r in fixed] + [(rng.choice(bases[:3]), rng.choice(["", "/", "//h/"]) + "/".join(rng.choices(parts, k=rng.randrange(1, 6))) + rng.choice(["", "/", "?q=1", "#f"])) for _ in range(300)]
    pairs = [(b, r) for b, r in pairs if r.strip() or "#" not in b]  # of an empty reference the RFC drops the base's fragment
    got = of(spark, pairs)
    # The resolver leaves dots behind a host of the reference's own; the RFC takes them out.
    want = [resolve(resolve(b, "//h/"), r[3:]) if r.startswith("//h/") else resolve(b, r) for b, r in pairs]
    assert [(p, g, w) for p, g, w in zip(pairs, got, want) if g != w] == [] and of(spark, [(BASE, "HTTP://X/y")]) == ["http://X/y"]


def test_nulls_and_long_paths(spark):
    assert of(spark, [(None, "x"), ("https://s.test/", None), (None, None)]) == [None] * 3
    path = "/a/.." * 3000 + "/end"
    assert spark.range(1).select(without_dots(F.lit(path)).alias("p")).first().p == "/end"


def test_plain_addresses_equal_urllib():
    from marquee.sources.extract import _resolved

    rng = random.Random(9)
    bases = ["https://s.test/a/b/c?x=1", "https://s.test/a/", "https://s.test", "https://s.test/a//b/", "https://s.test/./a/b", "http://h:80/x/y#f", "HTTPS://s.test/a"]
    parts = ["a", "b.c", "..", ".", "", "e-1", "/", "//", "?", "#", "x=1", "https://h.test", ":", "%41", ";", "é"]
    for _ in range(20000):
        base, href = rng.choice(bases), "".join(rng.choices(parts, k=rng.randrange(6)))
        assert resolve(base, href) == _resolved(base, href.strip()), (base, href)
