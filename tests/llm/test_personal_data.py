"""Personal data: patterns against plain regular expressions, the model against enumeration, and held-out forms."""

import hashlib
import math
import random
import re
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_base(text):
    """The patterns as the contract writes them."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 14, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or plain_luhn(digits)):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1290.@+-() \n25é", max_size=80))
def test_base_spans_match_the_patterns(text):
    from marquee.llm.pii_crf import base_spans

    assert base_spans(text) == plain_base(text)


def test_base_spans_of_numbers_near_the_limits():
    from marquee.llm.pii_crf import base_spans

    rng = random.Random(5)
    for _ in range(3000):
        parts = [rng.choice(["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "10.0.0.255", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "a.b@c.de", "@", "@@x.y", "000255.0.0.1", "12345678901234", "+49 30", "7" * rng.randint(1, 30)]) for _ in range(rng.randint(1, 5))]
        text = rng.choice(["", " ", ".", "-", " x "]).join(parts)
        assert base_spans(text) == plain_base(text), text


@pytest.mark.parametrize("text", ["x" * 1_000_000, "1" * 1_000_000, "a.b" * 300_000, "1.1." * 100_000, "a@" * 150_000, "+1 " * 150_000, "1-" * 150_000, "+1" + "(" * 1_000_000, "4111 " * 60_000, "x at y " * 60_000, "a@b.co 1234567 " * 60_000])
def test_hostile_texts_take_linear_time(text):
    import time

    from marquee.llm.pii_crf import KINDS, Model, added_spans, base_spans

    began = time.process_time()
    base = base_spans(text)
    added_spans(text, base, Model({("card", "bias"): -1.0}, dict.fromkeys(KINDS, 0.0)))
    assert time.process_time() - began < 30


def segmentations(n, spans):
    """All ways to read n atoms, as lists of (span index, kind) and outside atoms left out."""
    by_first = {}
    for k, (first, stop, scores) in enumerate(spans):
        by_first.setdefault(first, []).extend((stop, k, y) for y in range(len(scores)))

    def rest(at):
        if at == n:
            yield []
            return
        yield from rest(at + 1)
        for stop, k, y in by_first.get(at, []):
            for more in rest(stop):
                yield [(k, y), *more]

    return list(rest(0))


def total(spans, follows, chosen):
    score = 0.0
    for before, (k, y) in zip([None, *chosen], chosen):
        score += spans[k][2][y] + (follows[y] if before is not None and spans[before[0]][1] == spans[k][0] else 0.0)
    return score


def test_decoding_and_marginals_match_enumeration():
    from marquee.llm.pii_crf import best_segmentation, marginals

    rng = random.Random(3)
    for _ in range(150):
        n, kinds = rng.randint(1, 6), rng.choice([1, 3])
        places = [(i, j) for i, j in product(range(n), range(1, n + 1)) if 0 < j - i <= 4 and rng.random() < 0.6]
        spans, follows = [(i, j, [rng.gauss(0, 2) for _ in range(kinds)]) for i, j in places], [rng.gauss(0, 1) for _ in range(kinds)]
        every = segmentations(n, spans)
        scores = [total(spans, follows, s) for s in every]
        best = best_segmentation(n, spans, follows)
        chosen = [(places.index((i, j)), y) for i, j, y in best]
        assert math.isclose(total(spans, follows, chosen), max(scores), abs_tol=1e-9)
        z = math.log(sum(map(math.exp, scores)))
        partition, found = marginals(n, spans, follows)
        assert math.isclose(partition, z, abs_tol=1e-9)
        for k, (first, _, _) in enumerate(spans):
            for y in range(kinds):
                want = [0.0, 0.0]
                for s, score in zip(every, scores):
                    if (k, y) in s:
                        before = s[s.index((k, y)) - 1] if s.index((k, y)) else None
                        want[before is not None and spans[before[0]][1] == first] += math.exp(score - z)
                assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(found[k][y], want))


@pytest.fixture(scope="module")
def model(spark):
    from marquee.llm.pii_crf import fit

    return fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_forms_that_the_patterns_miss(model):
    from marquee.llm.pii_crf import added_spans, base_spans, examples_of

    rng, texts = random.Random(9), []
    for _ in range(300):
        digits = "4" + "".join(rng.choices("0123456789", k=14))
        card = next(digits + c for c in "0123456789" if plain_luhn(digits + c))
        ip = ".".join(str(rng.randint(1, 254)) for _ in range(4))
        phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04}"
        texts.append(f"kemo tala {rng.choice([card, ip, phone, f'some.one{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com'])} rivo dano")
    good = lost = wrong = 0
    for text, gold in examples_of(texts, seed=4):
        base = base_spans(text)
        if any(s not in gold for s in base):
            continue  # a pattern takes more than the entity, and its span stays
        found, want = set(added_spans(text, base, model)), {s for s in gold if s not in base}
        good, lost, wrong = good + len(found & want), lost + len(want - found), wrong + len(found - want)
    assert good > 200 and good / (good + lost) > 0.95 and good / (good + wrong) > 0.97


def test_numbers_that_run_into_others(model):
    from marquee.llm.pii_crf import added_spans, base_spans

    def told(text):
        base = base_spans(text)
        return [(k, text[a:b]) for k, a, b in added_spans(text, base, model)]

    assert told("pay 7536784127813050 4845168114407329 now") == [("card", "7536784127813050"), ("card", "4845168114407329")]
    assert told("call +1 (826) 555-4081 190.137.223.204 or") == [("phone", "+1 (826) 555-4081")]
    for clean in ("on 2024-05-06 we met", "pages 1998-2003", "isbn 978-3-16-148410-0", "costs 1,234,567.89 in all", "at 12:30 on 01/02/2003", "version 2.14.3", "meet at noon. dot by dot"):
        assert told(clean) == []


def test_spans_of_documents(spark):
    from marquee.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_personal_data"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base, spans = plain_base(texts[r.doc_id]), [s.split(":") for s in r.spans.split(",")] if r.spans else []
        spans = [(k, int(a), int(b)) for k, a, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]


def test_masked_text():
    from marquee.llm.pii_crf import base_spans, masked

    text = "write a@b.co or +1 234 567 8901, é 10.0.0.1"
    assert masked(text, base_spans(text)) == "write [email] or [phone], é [ip]"


def test_personal_data_edges(spark, edge, none):
    from marquee.llm.pii_crf import find, fit

    model = fit(edge)
    assert not model.weights and fit(none) == model
    rows = find(edge.unionByName(edge.limit(1).selectExpr(*(f"'mail a@b.co é\U0001f600 c@d.ef' AS text" if c == "text" else c for c in edge.columns))), model).collect()
    assert len(rows) == edge.count() + 1 and find(none, model).count() == 0
    assert [[tuple(s) for s in r.spans] for r in rows if r.spans] == [[("email", 5, 11), ("email", 15, 21)]]


def test_counts_are_those_of_the_base_spans(spark, tmp_path):
    """The model finds a bare number that the patterns miss; the counts of the contract leave it out."""
    from marquee.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = "call (743) 555-3824 or +1 743 555 3824 now"
    docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(-1).cast("long")).withColumn("text", F.lit(text))).write.parquet(f"{tmp_path}/documents.parquet")
    r = QUERIES["op12_personal_data"](spark, str(tmp_path)).filter("doc_id = -1").first()
    assert r.spans == "phone:5:19,phone:23:38" and r.base_sha256 == hashlib.sha256(b"phone:23:38").hexdigest()
    assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [0, 0, 0, 1]
