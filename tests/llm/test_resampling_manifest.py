"""Importance resampling and the Merkle manifest against brute force, with edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_features(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def plain_draw(docs, target):
    """Counter of (doc_id, n_features, weight, score, rank) with doc_ids that differ."""
    s, t = (Counter(bucket(f) for text in texts for f in plain_features(text)) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    rows = []
    for i, text in docs:
        f = plain_features(text)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = Counter()
    ranks = defaultdict(list)
    for k, r in enumerate(able[: 5 * len(able) // 100], 1):
        ranks[r].append(k)
    out = []
    for r in rows:
        rank[r] += 1
        out.append((*r[:4], ranks[r][rank[r] - 1] if rank[r] <= len(ranks[r]) else None))
    return sorted(out, key=repr)


def test_crcs_of_words_and_runs():
    from marquee.llm.importance import features, range_crcs

    rng = random.Random(1)
    texts = ["", "One", "a b", "É x" * 9, "w" * 64 + " " + "v" * 65 + " z " + "long" * 400 + " end", " ".join("".join(rng.choices("aé1Z-", k=rng.randint(1, 90))) for _ in range(300))]
    raw = [x.encode() for x in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    rows, buckets, n_words = features(data, offsets)
    for k, text in enumerate(texts):
        assert Counter(buckets[rows == k].tolist()) == Counter(map(bucket, plain_features(text))) and n_words[k] == len(words(text))
    starts, ends = np.array([0, 0, 5, 9]), np.array([0, 3, 9, len(data)])
    assert range_crcs(data, starts, ends).tolist() == [zlib.crc32(data[a:b]) for a, b in zip(starts, ends)]


@pytest.mark.parametrize("chunk_bytes", [1, 40, 1 << 20])
def test_draw_matches_brute_force_however_texts_are_split(spark, chunk_bytes):
    from marquee.llm.importance import resample

    rng = random.Random(2)
    vocabulary = ["the", "Tower", "of", "straße", "x" * 70, "日本語", "7", "and", "plain"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 19, 20, 60, 400])))) for i in range(90)] + [(90, None), (91, "--- !!"), (92, "")]
    docs += [(93, docs[7][1])] * 3
    target = [" ".join(rng.choices(vocabulary[:4], k=30)) for _ in range(9)] + [None, ""]
    got = resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(x,) for x in target], "text string"), chunk_bytes=chunk_bytes)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=repr) == plain_draw(docs, target)


def test_chunks_own_every_word_once():
    from marquee.llm.importance import cuts

    text = ("  Alpha beta, " + "g" * 50 + " d e f-g h. ") * 9
    for size in (1, 7, 30, 1000):
        parts = list(cuts(text.encode(), size))
        assert [w for own, part in parts for w in words(part.decode())[:own]] == words(text)
        assert sum((Counter(" ".join(words(p.decode())[i : i + n]) for own, p in parts for n in (1, 2, 3) for i in range(own) if i + n <= len(words(p.decode())))).values()) == len(plain_features(text))


def test_resampling_edges(spark, edge, none):
    from marquee.llm.importance import resample

    rows = resample(edge, edge, percent=50).collect()
    assert len(rows) == edge.count() and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 1 + sum(r.n_words >= 20 for r in rows) // 2))
    assert all(r.weight == 0 for r in rows if not r.n_features)
    assert resample(none, edge).count() == 0 and resample(edge, none).count() == len(rows)


# the manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    """The root, and of each node the siblings and its place, level by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for proof, p in zip(proofs, at):
            run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
            proof.append((p % 16, run[: p % 16] + run[p % 16 + 1 :]))
        nodes, at = [digest(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], [p // 16 for p in at]
    return nodes[0], proofs


def plain_manifest(rows):
    lower = lambda x: x and re.sub("[A-Z]", lambda m: m[0].lower(), x)
    by_source = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by_source[r[1]].append((r[0], plain_leaf(*r), plain_leaf(*r[:4], lower(r[4]) if hit else r[4])))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        found = sorted(by_source[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((found, *plain_tree([x[1] for x in found])))
    root, tops = plain_tree([t[1] for t in trees])
    out = []
    for (found, subroot, proofs), top in zip(trees, tops):
        for (doc_id, leaf, now), proof in zip(found, proofs):
            fold = now
            for slot, others in (*proof, *top):
                fold = digest(*others[:slot], fold, *others[slot:])
            out.append((doc_id, leaf, subroot, root, digest(*(d for _, others in (*proof, *top) for d in others)), fold, fold == root))
    return sorted(out, key=repr)


def manifest(docs):
    from marquee.llm.merkle import proofs, tampered_text

    found = proofs(docs, tampered_text())
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [[600, 1, 16, 17, 2], [1] * 40, [300], [5], [1], [257, 256, 255]])
def test_manifest_matches_brute_force(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = [(rng.randrange(5000), f"sé{k}" if k else None, rng.choice(["en", None]), rng.choice([None, 7]), rng.choice([None, "", "Aé B", "lower", "日 TEXT " * 9])) for k, n in enumerate(sizes) for _ in range(n)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    got = manifest(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert got == plain_manifest(rows)
    assert {r[6] for r in got if r[1] == r[5]} <= {True}


def test_manifest_edges(spark, edge, none):
    from marquee.llm.merkle import proofs

    rows = [tuple(r) for r in edge.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = proofs(edge).collect()
    assert len(got) == len(rows) and all(r.verified for r in got) and len({r.root for r in got}) == 1
    assert sorted(r.leaf for r in got) == sorted(plain_leaf(*r) for r in rows) and proofs(none).count() == 0
    # Rows with one doc_id are ordered by their digests, so any order of the input gives one root.
    assert {r.root for r in proofs(edge.orderBy(F.desc("text"))).collect()} == {got[0].root}


def test_parents_wait_for_late_children(spark):
    from marquee.llm.merkle import build, leaves
    from marquee.llm.common import materialize

    rows = [(i, "large" if i < 300 else f"s{i}", None, None, "x") for i in range(340)]
    table = materialize(leaves(spark.createDataFrame(rows, SCHEMA), F.col("text")), "leaves")
    steps = build(table)
    assert steps[0].filter("get(held, 0).tree = -1").count() == 1 and steps[2].filter("tree = 0 and level = 3").count() == 1
    assert sum(s.filter("tree = -1 and level = 2").count() for s in steps) == 1 and max(len(v.children) for s in steps for v in s.filter("tree is not null").collect()) == 16
