"""Corpus operators against brute force, round trips, held-out accuracy and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ordered(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


# 1: quality


def test_quality_orders_held_out_documents(spark):
    from marquee.llm.queries import QUERIES

    rows = QUERIES["op1_quality_crf"](spark, SF).join(table(spark, "labels"), "doc_id").filter("held_out and quality is not null").toPandas()
    good, bad = rows.score[rows.quality == 1].to_numpy(), rows.score[rows.quality == 0].to_numpy()
    auc = ((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :])).mean()
    assert auc > 0.9 and ((rows.score >= 0.5) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()


def test_forward_backward_matches_enumeration():
    from itertools import product

    from marquee.llm.quality_crf import Chains

    rng = np.random.default_rng(3)
    bounds = np.array([0, 4, 5, 11, 13])
    emission, transition = rng.normal(size=(13, 2)) * 3, rng.normal(size=(2, 2)) * 2
    p, pairs, partition = Chains(bounds).marginals(emission, transition)
    want_p, want_pairs, want_partition = np.zeros((13, 2)), np.zeros((2, 2)), 0.0
    for a, b in zip(bounds, bounds[1:]):
        weights = {}
        for labels in product((0, 1), repeat=int(b - a)):
            score = sum(emission[a + t, y] for t, y in enumerate(labels)) + sum(transition[x, y] for x, y in zip(labels, labels[1:]))
            weights[labels] = np.exp(score)
        z = sum(weights.values())
        want_partition += np.log(z)
        for labels, w in weights.items():
            for t, y in enumerate(labels):
                want_p[a + t, y] += w / z
            for x, y in zip(labels, labels[1:]):
                want_pairs[x, y] += w / z
    assert np.allclose(p, want_p) and np.allclose(pairs, want_pairs) and np.isclose(partition, want_partition)


def test_quality_gradient_and_weights():
    from marquee.llm.quality_crf import N_FEATURES, fit_chains, weighted

    rng = np.random.default_rng(4)
    bounds = np.array([0, 4, 5, 9, 12])
    f = rng.normal(size=(12, N_FEATURES))
    model = fit_chains(f, np.ones(12), bounds, np.array([1, 0, 1, 0]), rounds=10)
    assert np.allclose(model.lines(f, bounds)[4:5], model.lines(f[4:5], np.array([0, 1])))
    size, p = rng.integers(0, 90, 12).astype(float), rng.random(12)
    plain = [sum(p[k] * (size[k] + 1) for k in range(a, b)) / sum(size[k] + 1 for k in range(a, b)) for a, b in zip(bounds, bounds[1:])]
    assert np.allclose(weighted(p, size, bounds), plain)


def test_line_features_match_plain_counts():
    from marquee.llm.quality_crf import line_features

    texts = ["One line. ONE!\nx x x 123\n\nOne line. ONE!", "", "a | b | c\n" * 3, "é 日本"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    found, size, bounds = line_features(data, offsets)
    for k, text in enumerate(raw):
        lines = text.split(b"\n")
        lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        assert bounds[k + 1] - bounds[k] == len(lines)
        for row, n, line in zip(found[bounds[k] :], size[bounds[k] :], lines):
            words = line.split()
            assert n == len(line) and np.isclose(row[2], np.log1p(len(words)))
            assert np.isclose(row[4] * max(n, 1), sum(48 <= c < 58 for c in line))
            assert np.isclose(row[12], len(set(words)) / max(len(words), 1)) and np.isclose(row[13], float(lines.count(line) > 1))


def test_samples_are_bounded(spark):
    from marquee.llm.common import first_by_hash

    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"))
    whole, each = first_by_hash(rows, 500, 7), first_by_hash(rows, 500, 7, by="lang")
    assert 400 < whole.count() <= 500 and first_by_hash(rows, 30_000, 7).count() == 20_000
    sizes = {r["lang"]: r["count"] for r in each.groupBy("lang").count().collect()}
    assert sorted(sizes) == ["a", "b"] and all(400 < n <= 500 for n in sizes.values())
    same = rows.withColumn("doc_id", F.lit(5)).unionByName(rows)
    assert first_by_hash(same, 500, 7, by="lang").groupBy("lang").count().filter("count > 500").isEmpty()


def test_training_is_bounded_by_lines(spark):
    from marquee.llm.quality_crf import fit

    docs = spark.createDataFrame([(k, "good prose line here.\n" * 9 if k % 2 else "#$%\n" * 9) for k in range(60)] + [(99, "x\n" * 20_000)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    assert fit(docs, labels, train_lines=200) is not None and fit(docs, labels, train_lines=5) is None


def test_quality_edges(edge, none):
    from marquee.llm.quality_crf import fit, score

    labels = edge.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 0).otherwise(1).alias("quality"))
    for model in (fit(edge, labels), fit(none, labels.limit(0))):
        rows = score(edge, model).collect()
        assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert score(none, model).count() == 0


# 2: token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50000), st.integers(0, 2**64 - 1)), max_size=700))
def test_simple8b_round_trip(ids):
    from marquee.llm.simple8b import decode_blocks, encode_blocks

    ids = np.array(ids, np.uint64)
    words, sizes = encode_blocks(ids)
    assert np.array_equal(decode_blocks(words, sizes, len(ids)), ids)


def reference_ids(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(name)))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_hold_the_tokenizers_ids(spark):
    from marquee.llm.queries import QUERIES

    encode, start, expected = reference_ids("word_bpe_49k.json"), 0, []
    for i, text in sorted(ordered(table(spark, "documents", "/root/testdata/sf0.001"), "doc_id", "text")):
        ids = encode(text)
        expected.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    got = QUERIES["op2_simple8b"](spark, "/root/testdata/sf0.001")
    assert sorted(ordered(got, "doc_id", "start", "n_tokens", "ids_crc32")) == expected


def test_token_files_edges(spark, edge, none):
    import public_tokenizers

    from marquee.llm.simple8b import token_file_digests

    path, encode = public_tokenizers.path("word_bpe_49k.json"), reference_ids("word_bpe_49k.json")
    got = token_file_digests(spark, edge, path, False, 2)
    want = sorted((len(ids), crc(ids)) for ids in (encode(r["text"]) for r in edge.collect()))
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got.collect()) == want
    assert token_file_digests(spark, none, path, False, 2).count() == 0


# 3: language


def test_language_of_held_out_documents(spark):
    from marquee.llm.queries import QUERIES

    rows = QUERIES["op3_language_id"](spark, SF).join(table(spark, "documents"), "doc_id").filter("held_out and lang is not null").toPandas()
    told = rows[rows.lang_pred != "und"]
    assert len(told) > 0.95 * len(rows) and (told.lang == told.lang_pred).mean() > 0.95 and rows.score.between(0, 1).all()


def brute_language(train, texts):
    """Language and score of each text, counted and looked up plainly."""
    import math
    import unicodedata
    from collections import Counter

    letter = lambda c: unicodedata.category(c)[0] in "LM"
    words_of = lambda t: "".join(c if letter(c) else " " for c in t.lower()).split()
    languages = sorted({lang for lang, _ in train})
    words, grams = Counter(), Counter()
    for lang, text in train:
        for w in words_of(text):
            words[lang, w] += 1
            marked = f"^{w}$"
            for n in range(1, 6):
                for k in range(len(marked) - n + 1):
                    grams[lang, marked[k : k + n]] += 1
    size = {lang: sum(n for (x, _), n in words.items() if x == lang) + 0.5 * len({w for _, w in words}) for lang in languages}
    logs = lambda counts, key: [math.log((counts[lang, key] + 0.5) / size[lang]) for lang in languages]
    known_words, known_grams = {w for _, w in words}, {g for _, g in grams}
    out = []
    for text in texts:
        real = [w for w in words_of(text or "") if any(map(str.isalpha, w))]
        scores = []
        for w in real:
            if w in known_words:
                scores.append(logs(words, w))
                continue
            marked = f"^{w}$"
            for n in range(5, 0, -1):
                found = [marked[k : k + n] for k in range(len(marked) - n + 1) if marked[k : k + n] in known_grams]
                if found and (n > 1 or any(c in known_grams for c in w)):
                    scores.append([sum(x) / len(found) for x in zip(*(logs(grams, g) for g in found))])
                    break
        if not scores:
            out.append((languages[0] if real else "und", 0.0))
            continue
        evidence = [sum(x) / len(scores) * min(len(scores), 50) for x in zip(*scores)]
        p = [math.exp(e - max(evidence)) for e in evidence]
        out.append((languages[p.index(max(p))], max(p) / sum(p)))
    return out


def test_language_scores_match_brute_force(spark):
    from marquee.llm.langid import fit, predict

    rng = random.Random(17)
    alphabets = {"aa": "abcdeé", "bb": "acegi", "cc": "bdfhß"}
    word = lambda chars: "".join(rng.choice(chars) for _ in range(rng.randrange(1, 8)))
    train = [(lang, " ".join(word(chars) for _ in range(30)) + rng.choice([".", "! 12", ""])) for lang, chars in alphabets.items() for _ in range(8)]
    texts = [t for _, t in train[::5]] + [" ".join(word(rng.choice(list(alphabets.values()))) for _ in range(rng.randrange(1, 80))) for _ in range(40)] + ["Ωμέγα", "xyz", "", None, "123 !", "ABC def", "e\u0301 \u0301"]
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(train)] + [(500, "nothing", None), (501, None, "dd")], "doc_id long, text string, lang string")
    rows = predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), fit(docs)).orderBy("doc_id").collect()
    for r, (lang, score), text in zip(rows, brute_language(train, texts), texts, strict=True):
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4, text


def test_language_edges(edge, none):
    from marquee.llm.langid import fit, keep_recognised, predict

    model = fit(edge)
    found = {r["lang_pred"] for r in predict(edge.filter("text is null or trim(text) = '' or doc_id = 7"), model).collect()}
    assert found == {"und"} and predict(edge, model).count() == edge.count()
    kept = keep_recognised(edge, model, 0.5)
    assert kept.columns == edge.columns and kept.filter("text is null").isEmpty()
    assert fit(none) is None and predict(none, model).count() == 0 and {r["lang_pred"] for r in predict(edge, None).collect()} == {"und"}
    assert keep_recognised(edge, None, 0.5).count() == edge.filter(r"text rlike '\\p{L}'").count()


# 4: HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>One<p>Two &amp; three", "One\n\nTwo & three"),
        ("a<script>no()</script><style>x</style><!-- c -->b", "ab"),
        ("<div hidden>x</div><div style='display: none'>y</div>z", "z"),
        ("a<br>b", "a\nb"),
    ],
)
def test_visible_text(page, text):
    from marquee.llm.html_layout import page_text

    assert page_text(page).strip() == text


def test_lists_and_tables():
    from marquee.llm.html_layout import page_text

    out = page_text("<ul><li>a<li>b</ul><ol><li>c<li>d</ol><table><tr><td>x<td>long cell<tr><td>yyyy<td>z</table>").splitlines()
    assert any(l.strip().endswith("b") for l in out) and any(re.match(r"\s*2\W+d", l) for l in out)
    cells = [l for l in out if "long cell" in l or l.rstrip().endswith("z")]
    assert len(cells) == 2 and cells[0].index("long cell") == cells[1].index("z")
    assert page_text("<div>" * 5000 + "deep").strip() == "deep"


@pytest.mark.parametrize(
    ("page", "words"),
    [
        ("<table><tr><form><td>a<td>b</form></table>", "a b"),
        ("<table><tbody><td>a<td>b</table>", "a b"),
        ("<table><td>a<tr><td>b</table>", "a b"),
        ("<table><tbody><form><tr><td>a</form></table>", "a"),
        ("<table><tr>loose <a>link</a> <div>block</div><td>a</table>", "loose link block a"),
        ("<table><tbody>loose<tr><td>a <table><tr>inner<td>b</table></table>", "loose a inner b"),
        ("<table><colgroup>x<col><tr><td>a</table>", "x a"),
        ("<table><tr><table><tr><td>a</table>b", "a b"),
        ("<table><tr><select><option>no</select><script>no()</script><td>a</table>", "a"),
        ("<span aria-hidden=true>shown</span>", "shown"),
        ("x<textarea rows=2>\nfirst &amp;\n  second</textarea>y", "x first & second y"),
    ],
)
def test_text_between_cells_stays(page, words):
    from marquee.llm.html_layout import page_text

    assert page_text(page).split() == words.split()


def test_all_words_of_tag_soup_stay():
    from marquee.llm.html_layout import page_text

    tags = "table table tr tr td td th tbody thead tfoot caption colgroup col form div a p ul li b span dl dt button pre center h1 textarea fieldset".split()
    for seed in range(1000):
        rng, words, page = random.Random(seed), [], ""
        for k in range(rng.randrange(1, 40)):
            tag = rng.choice(tags)
            if rng.random() < 0.3:
                words.append(f"w{k}")
                page += f" w{k} "
            else:
                page += f"</{tag}>" if rng.random() < 0.4 else f"<{tag}>" + "</textarea>" * (tag == "textarea")
        assert sorted(page_text(page).split()) == sorted(words + [w for w in page_text(page).split() if w == "-"]), page


def test_html_edges(spark):
    from marquee.llm.html_layout import extract

    pages = spark.createDataFrame([(1, None, "<p>x"), (None, "u", None), (1, None, "<p>x"), (2, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted(r["n_chars"] for r in extract(pages).collect()) == [0, 0, 1, 1]
    assert extract(pages.limit(0)).count() == 0


# 5: spans

PASSAGE = "It began on a cold morning when nobody in the town expected visitors at all. The bells rang twice, and the mayor came down the stairs in a hurry. Nobody could say afterwards who had opened the gates. They only remembered the long line of carts rolling over the bridge."


def own(seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) + ("." if k % 9 == 8 else "") for k in range(90)) + "."


def test_repeated_passages_go_but_for_the_first(spark):
    from marquee.llm.sentence_spans import deduplicate_spans

    docs = spark.createDataFrame([(1, own(1) + " " + PASSAGE + " " + own(2)), (2, own(3) + " " + PASSAGE.upper() + "  " + own(4)), (3, own(5)), (4, PASSAGE), (5, None), (6, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in deduplicate_spans(docs).collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(got[i]["text"] == before[i] for i in (1, 3, 5, 6))
    assert "MAYOR" not in got[2]["text"] and got[2]["text"].split() == (own(3) + " " + own(4)).split() and got[4]["text"].strip() == ""


def test_spans_match_brute_force():
    from marquee.llm.sentence_spans import MIN_SENTENCES, MIN_WORDS, spans

    rng = random.Random(5)
    for _ in range(30):
        counts = [rng.randrange(0, 8) for _ in range(4)]
        words = [rng.randrange(0, 15) for _ in range(sum(counts))]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        ok = lambda a, b: b - a >= MIN_SENTENCES and sum(words[a:b]) >= MIN_WORDS
        want = {(a, b) for lo, hi in zip(bounds, bounds[1:]) for a in range(lo, hi) for b in range(a + 1, hi + 1) if ok(a, b) and (not ok(a + 1, b) or not ok(a, b - 1))}
        first, end = spans(np.array(words, int), bounds)
        got = set(zip(first.tolist(), end.tolist()))
        assert got <= {(a, b) for a, b in want} and {a for a, _ in got} == {a for a, _ in want} and {b for _, b in got} == {b for _, b in want}


def test_passages_at_every_offset_of_unpunctuated_text(spark):
    from marquee.llm.sentence_spans import MIN_WORDS, WINDOW, deduplicate_spans

    rng = random.Random(6)
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    passage, other, edited = fresh(51), fresh(120), fresh(120)
    texts = [fresh(k) + passage + fresh(60 - k) for k in range(50)] + [other, other[:60] + fresh(1) + other[60:], edited, edited[:60] + edited[61:]]
    docs = spark.createDataFrame([(i, rng.choice([" ", "  ", "\t"]).join(t) + rng.choice(["", " ", "\n"])) for i, t in enumerate(texts)], "doc_id long, text string")
    left = {r["doc_id"]: r["text"].split() for r in deduplicate_spans(docs).collect()}
    seen = set()
    for i, words in enumerate(texts):
        runs = [tuple(words[k : k + MIN_WORDS]) for k in range(len(words) - MIN_WORDS + 1)]
        repeated = {w for run in runs if run in seen for w in run}
        seen |= set(runs)
        gone = set(words) - set(left[i])
        assert gone <= repeated and bool(gone) == bool(repeated)
        assert len(repeated) - len(gone) <= 2 * WINDOW * (1 if i < 50 else 2)
        assert left[i] == [w for w in words if w not in gone]


def test_white_space_does_not_change_the_cut():
    from marquee.llm.sentence_spans import WINDOW, sentence_ends

    rng = random.Random(7)
    for n in (WINDOW, WINDOW + 1, 24, 25, 200):
        words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
        cuts = set()
        for text in (gap.join(words) + end for gap in (" ", "  ", "\t") for end in ("", " ", "\n", "  \n ")):
            ends = sentence_ends(text.encode())
            cuts.add(tuple(len(text[a:b].split()) for a, b in zip([0, *ends], ends)))
        assert len(cuts) == 1 and sum(*cuts) == n and max(*cuts) <= WINDOW and (len(*cuts) > 1) == (n > WINDOW)
    constant = ("word " * 500).encode()
    assert max(len(constant[a:b].split()) for a, b in zip([0, *sentence_ends(constant)], sentence_ends(constant))) <= WINDOW


def test_span_edges(edge, none):
    from marquee.llm.sentence_spans import deduplicate_spans, without_repeats

    assert deduplicate_spans(edge).count() == edge.count() and deduplicate_spans(none).count() == 0
    kept = without_repeats(edge)
    assert kept.columns == edge.columns and kept.count() == edge.count() and without_repeats(none).count() == 0


# 6: Matroska


def test_matroska_round_trip(spark, edge, none):
    from marquee.llm.matroska import media_column, padded, read_media

    got = read_media(media_column(edge)).collect()
    want = [padded(r["text"]) for r in edge.collect()]
    assert sorted((r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for p in want)
    assert all(len(p) % 64 == 0 and p for p in want) and read_media(media_column(none)).count() == 0


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_lacing(lacing):
    from marquee.llm.matroska import lace, laced_sizes

    frames = [b"a" * 300] if lacing == 0 else [b"a" * 300] * 3 if lacing == 2 else [b"a" * 300, b"b" * 7, b"c" * 1000]
    data = lace(frames, lacing)
    sizes, at = laced_sizes(data, 0, len(data), lacing)
    assert sizes == [len(f) for f in frames] and data[at:] == b"".join(frames)


# 7: packing


def test_packing_is_whole_and_tight(spark):
    from marquee.llm.queries import QUERIES

    encode = reference_ids("byte_bpe_50k.json")
    ids = {i: encode(t) for i, t in ordered(table(spark, "documents", "/root/testdata/sf0.001"), "doc_id", "text")}
    rows = QUERIES["op7_best_fit_packing"](spark, "/root/testdata/sf0.001").toPandas().sort_values(["doc_id", "piece"])
    for i, own_rows in rows.groupby("doc_id"):
        at = 0
        for k, r in enumerate(own_rows.itertuples()):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == crc(ids[i][at : at + r.length]) and (k == 0 or r.length == 1024)
            at += r.length
        assert at == len(ids[i]) and (len(ids[i]) > 1024 or len(own_rows) == 1)
    for _, seq in rows.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert list(seq.offset) == [0, *np.cumsum(seq.length)[:-1]] and seq.length.sum() <= 1024
    assert rows.doc_id.nunique() == len(ids) and rows.sequence_id.nunique() <= np.ceil(rows.length.sum() / 1024) * 1.02 + 1


def test_packing_plan_matches_plain_best_fit():
    from collections import Counter

    from marquee.llm.packing import plan_places

    rng = random.Random(2)
    for _ in range(20):
        lengths = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 200))]
        bins = []
        for n in sorted(lengths, reverse=True):
            fits = [b for b in range(len(bins)) if bins[b] >= n]
            if fits:
                bins[min(fits, key=lambda b: bins[b])] -= n
            else:
                bins.append(20 - n)
        used, count, ends = Counter(), Counter(), {}
        for length, rank_from, rank_to, sequence, offset in plan_places(dict(Counter(lengths)), 20):
            assert rank_from == count[length] < rank_to  # ranks go on without gaps, the last is left out
            count[length] = rank_to
            for k in range(rank_to - rank_from):
                assert ends.get(sequence + k, 0) == offset
                ends[sequence + k] = offset + length
                used[sequence + k] += length
        assert count == Counter(lengths) and len(used) == len(bins) and max(used.values()) <= 20
        assert sorted(20 - u for u in used.values()) == sorted(bins)


def test_packing_edges(edge, none):
    import public_tokenizers

    from marquee.llm.packing import pack_documents

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = pack_documents(edge, path, True, 2, 1024).toPandas()
    encode = reference_ids("byte_bpe_50k.json")
    assert rows.length.sum() == sum(len(encode(r["text"])) for r in edge.collect())
    assert pack_documents(none, path, True, 2, 1024).count() == 0


# 8: decontamination


def brute_contamination(docs, items):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            n = min(13, len(b))
            windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_contamination_matches_brute_force(spark):
    from marquee.llm.decontaminate import contamination, is_contaminated

    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["a", "B", "c9", "é"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 4, 6, 13, 14, 20]))) for k in range(12)] + [(90, ""), (91, None)]
    docs = [(k, text(rng.randrange(0, 60)) + "-" + items[k % 12][1] + "." + text(rng.randrange(0, 400))) for k in range(60)] + [(100, None), (101, ""), (102, "...")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = contamination(d, b).withColumn("contaminated", is_contaminated())
    assert ordered(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_contamination(docs, items)


def test_contamination_edges(spark, edge, none):
    from marquee.llm.decontaminate import contamination, drop_contaminated

    items = spark.createDataFrame([(1, "lazy dog. It was"), (1, "lazy dog. It was"), (None, "amused by"), (2, None)], "item_id long, text string").withColumn("n_words", F.lit("clash"))
    assert contamination(edge, items).count() == edge.count() and contamination(none, items).count() == 0
    assert contamination(edge, items.limit(0)).filter("n_hit > 0").isEmpty()
    kept = drop_contaminated(edge, items)
    assert kept.columns == edge.columns and kept.filter("text like '%quick brown%'").isEmpty() and kept.filter("doc_id = 9").count() == 1


# 9: near duplicates


def plain_simhash(text):
    import xxhash

    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(prints):
    label = {p: p for p in prints}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    items = sorted(label)
    for i, a in enumerate(items):
        for b in items[:i]:
            if bin(a ^ b).count("1") <= 4:
                label[root(a)] = root(b)
    return {p: root(p) for p in items}


def test_near_duplicates_match_brute_force(spark):
    from marquee.llm.queries import QUERIES

    docs = ordered(table(spark, "documents", "/root/testdata/sf0.001"), "doc_id", "text")
    prints = {i: plain_simhash(t) for i, t in docs}
    label = components(set(prints.values()))
    first = {}
    for i, p in prints.items():
        first[label[p]] = min(i, first.get(label[p], i))
    want = sorted(((i, f"{p:016x}", first[label[p]]) for i, p in prints.items()), key=repr)
    assert ordered(QUERIES["op9_simhash_golay"](spark, "/root/testdata/sf0.001"), "doc_id", "fingerprint", "component_id") == want


def test_links_match_brute_force_on_chains(spark):
    rng, prints = random.Random(4), set()
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            prints.add(p)
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                p ^= 1 << b
    assert_links_match_brute_force(spark, prints)


def test_links_match_brute_force_in_dense_groups(spark):
    """Many fingerprints around one, and some outside that only a few of them reach, if any."""
    rng, prints = random.Random(5), set()
    for _ in range(3):
        middle = rng.getrandbits(64)
        for far, n in ((1, 20), (2, 80), (3, 40), (5, 30), (6, 30), (7, 30)):
            for _ in range(n):
                p = middle
                for b in rng.sample(range(64), far):
                    p ^= 1 << b
                prints.add(p)
    assert_links_match_brute_force(spark, prints)


def assert_links_match_brute_force(spark, prints):
    from marquee.llm.simhash_golay import link_fingerprints

    signed = lambda p: p - (1 << 64) if p >> 63 else p
    got = {r["node"]: r["label"] for r in link_fingerprints(spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")).collect()}
    label = components(prints)
    groups = lambda f: sorted(sorted(g) for g in f.values() if len(g) > 1)
    want, have = {}, {}
    for p in prints:
        want.setdefault(label[p], []).append(p)
        have.setdefault(got.get(signed(p), signed(p)), []).append(p)
    assert groups(want) == groups(have)


def test_golay_code_is_perfect():
    from marquee.llm.simhash_golay import Golay

    golay, words = Golay(), np.random.default_rng(0).integers(0, 1 << 23, 2000)
    again = golay.index(words)
    assert again.min() >= 0 and again.max() < 4096
    codeword = words ^ golay.error[golay.high[words >> 11] ^ (words & 2047)]
    assert all(bin(int(a ^ b)).count("1") <= 3 for a, b in zip(words, codeword)) and np.array_equal(golay.index(codeword ^ 0b10000000000000000000101), golay.index(codeword))


def test_near_duplicate_edges(edge, none):
    from marquee.llm.simhash_golay import keep_one_of_each, near_duplicate_groups

    rows = near_duplicate_groups(edge).collect()
    assert len(rows) == edge.count() and {r["component_id"] for r in rows if r["fingerprint"] == 0} == {2}
    kept = keep_one_of_each(edge)
    assert kept.columns == edge.columns and kept.count() == len({r["component_id"] for r in rows})
    assert near_duplicate_groups(none).count() == 0 and keep_one_of_each(none).count() == 0


# 10: quotations


def test_quotations_become_threads(spark):
    from marquee.llm.quotes import chat_lines, reply_order

    m = [(1, 0, "user", "How do I fold a map?"), (1, 1, "user", "Where is the\n  old harbour now?"), (1, 2, "assistant", "> How do I fold a map?\nAlong its creases."), (1, 3, "user", "> > How do I fold a map?\n> Along its creases.\nThanks!"), (1, 4, "assistant", "> where is the old   harbour now?\nIt is gone."), (2, 0, "user", None), (2, 1, None, ""), (None, 0, "user", "> lost"), (3, None, "user", "x")]
    rows = spark.createDataFrame(m, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("clash"))
    got = {(r["conv_id"], r["turn"]): r for r in reply_order(rows).collect()}
    assert len(got) == len(m) and got[1, 2]["parent_turn"] == 0 and got[1, 3]["parent_turn"] == 2 and got[1, 4]["parent_turn"] == 1
    assert got[1, 3]["content"].strip() == "Thanks!" and got[1, 3]["root_turn"] == 0 and got[1, 3]["depth"] == 2
    assert [t for (c, t), r in sorted(got.items(), key=lambda x: x[1]["position"]) if c == 1] == [0, 2, 3, 1, 4]
    assert chat_lines(reply_order(rows)).count() == len(m) and reply_order(rows.limit(0)).count() == 0


def test_quotations_of_deeper_levels_and_of_parts_link(spark):
    from marquee.llm.quotes import reply_order

    long = "The bridge is closed today. Take the ferry instead!\nIt leaves at nine."
    m = [
        (1, 0, "Where can one cross the river?"),
        (1, 1, long),
        (1, 2, "> > Where can one cross the river?\n> An edited answer.\nStill open?"),  # a deeper level
        (1, 3, "> Take the ferry instead!\nThanks."),  # a sentence
        (1, 4, "> It leaves at nine.\nToo early."),  # a line
        (1, 5, "> Take the ferry instead!\n> It leaves at nine.\n> Words of nobody.\nNoted."),  # some of the parts
        (2, 0, "> A common remark.\nWhich one?"),  # its own conversation has it later, the third earlier
        (2, 1, "A common remark."),
        (3, 4, "A common remark."),
    ]
    rows = spark.createDataFrame([(c, t, "user", x) for c, t, x in m], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["parent_conv"], r["parent_turn"]) for r in reply_order(rows).collect()}
    want = {(1, 2): (1, 0), (1, 3): (1, 1), (1, 4): (1, 1), (1, 5): (1, 1), (2, 0): (3, 4)}
    assert got == {(c, t): want.get((c, t), (None, None)) for c, t, _ in m}


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    ids = {r["doc_id"] for r in table(spark, "documents", "/root/testdata/sf0.001").select("doc_id").collect()}
    assert set(out.doc_id) <= ids and len(out) > 0.3 * len(ids) and not out.duplicated(["doc_id", "piece"]).any()
    assert (out.groupby("sequence_id").length.sum() <= 1024).all()


def test_grams_of_long_words(spark):
    from marquee.llm.langid import GRAMS

    words = ["ab", "a" * 499 + "b", "".join(chr(97 + k % 26) for k in range(1001)), "é" * 1500]
    df = spark.createDataFrame([(w, k) for w in words for k in (1, 2, 6) if k <= len(w)], "w string, k int")
    for r in df.select("w", "k", F.expr(GRAMS).alias("g")).collect():
        assert r["g"] == [r["w"][i : i + r["k"]] for i in range(len(r["w"]) - r["k"] + 1)]


def brute_spans(docs):
    """Ranges of sentences that deduplication takes from each document, from texts alone."""
    from marquee.llm.sentence_spans import MIN_SENTENCES, MIN_WORDS, sentence_ends

    places = {}
    for i, text in docs:
        raw = (text or "").encode().lower()
        ends = sentence_ends(raw)
        parts = [raw[a:b].split() for a, b in zip([0, *ends], ends)]
        words = [len(x) for x in parts]
        ok = lambda a, b: b - a >= MIN_SENTENCES and sum(words[a:b]) >= MIN_WORDS
        for a in range(len(parts)):
            for b in range(a + 1, len(parts) + 1):
                if ok(a, b) and (not ok(a + 1, b) or not ok(a, b - 1)):
                    places.setdefault(tuple(tuple(x) for x in parts[a:b]), set()).add((i is None, i or 0, text, a, b))
    gone = {}
    for found in places.values():
        first = min(found, key=lambda f: (f[0], f[1], f[3]))
        for null, i, text, a, b in found - {first}:
            gone.setdefault((None if null else i, text), set()).update(range(a, b))
    return gone


def test_spans_match_brute_force_on_texts(spark):
    from marquee.llm.sentence_spans import deduplicate_spans, sentence_ends

    rng = random.Random(11)
    stock = [" ".join(rng.choice(["oak", "elm", "ash", "fir"]) for _ in range(rng.randrange(2, 9))) + rng.choice([". ", "! ", "\n", "... "]) for _ in range(12)]
    docs = [(k if k else None, "".join(rng.choice(stock) for _ in range(rng.randrange(0, 14)))) for k in range(60)]
    docs += [(61, docs[5][1]), (62, docs[7][1].upper()), (62, docs[7][1].upper())]
    want = brute_spans(docs)
    for parts in (1, 7):  # one batch, and batches that meet in the shuffle
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        for r, text in zip(sorted(deduplicate_spans(df).collect(), key=lambda r: (r["doc_id"] or 0)), [t for _, t in sorted(docs, key=lambda d: d[0] or 0)]):
            raw = text.encode()
            ends = sentence_ends(raw)
            left = b"".join(raw[a:b] for k, (a, b) in enumerate(zip([0, *ends], ends)) if k not in want.get((r["doc_id"], text), ()))
            assert r["text"] == left.decode()


def test_runs_of_marks_take_linear_time():
    from time import process_time

    from marquee.llm.sentence_spans import sentence_ends

    start = process_time()
    for text in (b"." * 1_000_000, b".'" * 500_000, b"?! " * 300_000, b"x." * 500_000, b"." * 500_000 + b" " * 500_000, b"\n" * 1_000_000):
        assert sentence_ends(text)[-1] == len(text)
    assert process_time() - start < 15


HOSTILE_PAGES = {
    "open tags": "<a " * 350_000,
    "divs": "<div>" * 200_000 + "x",
    "paragraphs": "<p>" * 330_000,
    "lists": "<ul><li>" * 120_000 + "x",
    "quotes": "<blockquote>x" * 80_000,
    "tables": "<table><tr><td>a<td>" * 50_000 + "x",
    "one line": "a<b>c</b>" * 110_000,
    "scripts": "<script></script " * 60_000,
    "wide cell": "<table><tr><td>" + "w" * 500_000 + "<td>b" + "<tr><td>a<td>b" * 20_000,
    "column spans": "<table><tr>" + "<td>aaaaaaaaaaaaaaaaaaaaaaaaaaa" * 1000 + "<tr><td colspan=999>a<td>b" * 30_000,
    "row spans": "<table><tr>" + "<td rowspan=65534>a" * 1000 + "<tr>" * 200_000,
    "digits": "&#" + "1" * 1_000_000 + ";",
    "style sheet": "<style>" + "{" * 1_000_000,
    "foster": "<table><tr>" + "x<td>" * 150_000,
    "open values": '<a x="' * 170_000,
    "comments": "<!--" * 250_000,
}


@pytest.mark.parametrize("name", list(HOSTILE_PAGES))
def test_hostile_pages_of_a_megabyte(name):
    from time import process_time

    from marquee.llm.html_layout import page_text

    start = process_time()
    assert len(page_text(HOSTILE_PAGES[name])) < 10 * len(HOSTILE_PAGES[name])
    assert process_time() - start < 15


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<ol start="²"><li>x</ol>', "1. x"),
        ("<ol start=99999999999><li>x<li value=7>y<li>z</ol>", "1. x\n7. y\n8. z"),
        ("<ol start=' -2abc'><li>x</ol>", "-2. x"),
        ("<li marker=zzz>x", "- x"),
        ('<table><tr><td colspan="²">y<td>z</table>', "y  z"),
        ("<table><tr><th rowspan=2>A<th colspan=2>BB<tr><td>c<td>d<tr><td>e<td>ffff<td>g</table>", "A  BB\n   c     d\ne  ffff  g"),
        ("<table><tr><td>one<td><table><tr><td>x<td>yy<tr><td>xxx<td>y</table><td>last</table>", "one\n\nx    yy\nxxx  y\n\nlast"),
        ("<style>.x{display:none} p.q , i {visibility:hidden}</style><b class='a x'>no</b><p class=q>no<b>no</b></p>yes <i>no</i>", "yes"),
        ("<style>@media print{b{display:none}} .x.y{display:none} .z{display:none} .z{display:block}</style><b class='x y z'>shown</b>", "shown"),
        ("<style>@media screen{.x{display:none}}</style><b class=x style='display:inline'>shown</b><b class=x>no</b><b hidden>no</b>", "shown"),
        ("a<b>b</b> <i>c</i>d&#99999999999;&#x110000;", "ab cd��"),
    ],
)
def test_layout_rules(page, text):
    from marquee.llm.html_layout import page_text

    assert page_text(page).strip("\n") == text


def test_matroska_features_follow_the_samples(spark):
    from marquee.llm.matroska import FRAME_NS, feature, packet_table, read_media, stored_media

    docs = spark.createDataFrame([(1, "a" * 9000), (2, "b" * 9000), (3, "a" * 9000), (4, "a" * 8999 + " "), (None, None)], "doc_id long, text string")
    read = read_media(stored_media(docs))
    got = {r["doc_id"]: r["f"] for r in read.select("doc_id", feature().alias("f")).collect()}
    assert got[1] == got[3] and len({got[k] for k in (1, 2, 4, None)}) == 4
    times = [r["timestamp_ns"] for r in packet_table(read.filter("doc_id = 1"), "doc_id").orderBy("first").collect()]
    assert times == [k * FRAME_NS for k in range(9)]
    raw = {r["doc_id"]: [bytes(r["media"])[p["first"] : p["first"] + p["bytes"]] for p in r["packets"]] for r in stored_media(docs).join(read.select("doc_id", "packets"), "doc_id").collect()}
    assert b"".join(raw[1]).rstrip(b"\0") == b"a" * 9000


def test_broken_media_have_errors(spark):
    from marquee.llm import matroska as m

    good = m.mux(m.padded("some text " * 300))
    e, u = m._element, m._uint
    track = e(m.TRACK, u(m.NUMBER, 1), u(m.KIND, 2), e(m.CODEC, b"x"))
    segment = lambda *parts: m._HEADER + e(m.SEGMENT, *parts)
    block = b"\x81\x00\x00\x80abc"
    cases = {
        "none": None,
        "empty": b"",
        "zeros": bytes(64),
        "cut": good[:-5],
        "no track number": segment(e(m.TRACKS, e(m.TRACK, u(m.KIND, 2), e(m.CODEC, b"x")))),
        "no codec": segment(e(m.TRACKS, e(m.TRACK, u(m.NUMBER, 1), u(m.KIND, 2)))),
        "cue without place": segment(e(m.CUES, e(m.CUE, u(m.CUE_TIME, 1)))),
        "cue without cluster": segment(e(m.CUES, e(m.CUE, u(m.CUE_TIME, 1), e(m.CUE_PLACES, u(m.CUE_TRACK, 1))))),
        "huge time": segment(e(m.TRACKS, track), e(m.CLUSTER, e(m.TIME, b"\xff" * 8), e(m.SIMPLE_BLOCK, block))),
        "long number": segment(e(m.TRACKS, track), e(m.CLUSTER, e(m.TIME, b"\xff" * 900))),
        "huge track": segment(e(m.CLUSTER, e(m.SIMPLE_BLOCK, b"\x01" + b"\xee" * 7 + block[1:]))),
        "bad codec": segment(e(m.TRACKS, e(m.TRACK, u(m.NUMBER, 1), u(m.KIND, 2), e(m.CODEC, b"\xff\xfe")))),
        "bad lacing": segment(e(m.CLUSTER, e(m.SIMPLE_BLOCK, b"\x81\x00\x00\x82\xff"))),
        "odd lacing": segment(e(m.CLUSTER, e(m.SIMPLE_BLOCK, b"\x81\x00\x00\x84\x01abc"))),
        "huge cue": segment(e(m.CUES, e(m.CUE, e(m.CUE_TIME, b"\xff" * 8), e(m.CUE_PLACES, u(m.CUE_CLUSTER, 1))))),
    }
    rows = spark.createDataFrame([(k, v if v is None else bytearray(v)) for k, v in cases.items()], "name string, media binary").withColumn("error", F.lit("clash"))
    got = m.read_media(rows).select("name", "error", F.size("packets").alias("n"), "samples", m.feature().alias("f")).collect()
    assert len(got) == len(cases) and all(r["error"] and r["error"] != "clash" and r["n"] == 0 and r["samples"] is None and r["f"] is None for r in got)
    rng = random.Random(3)
    for _ in range(3000):
        data = bytearray(good)
        for _ in range(rng.randrange(1, 6)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        assert len(m.read_file(bytes(data))) == len(m._READ)
    assert m.read_media(rows.limit(0)).count() == 0


def test_files_of_other_writers():
    from marquee.llm import matroska as m

    e, u = m._element, m._uint
    track = e(m.TRACK, u(m.NUMBER, 1), u(m.KIND, 2), e(m.CODEC, b"x"))
    xiph = b"\x81\x00\x05\x02" + m.lace([b"a" * 300, b"b" * 7, b"c"], m.XIPH)
    group = e(m.BLOCK_GROUP, e(m.BLOCK, b"\x81\x00\x02\x04" + m.lace([b"d", b"e"], m.FIXED)), u(m.BLOCK_DURATION, 8), u(m.REFERENCE, 1))
    cluster = u(m.TIME, 10) + e(m.SIMPLE_BLOCK, xiph) + group
    unknown = bytes.fromhex("1F43B675") + b"\x01" + b"\xff" * 7 + cluster
    cues = e(m.CUES, e(m.CUE, u(m.CUE_TIME, 10), e(m.CUE_PLACES, u(m.CUE_TRACK, 1), u(m.CUE_CLUSTER, 40))))
    found = m.demux(m._HEADER + e(m.SEGMENT, e(m.INFO, u(m.SCALE, 1000)), e(m.TRACKS, track), unknown, unknown, cues))
    ticks = [(p[1] // 1000, p[3], p[4], p[5], p[6]) for p in found["packets"]]
    assert ticks == [(15, 300, False, 1, 0), (15, 7, False, 1, 1), (15, 1, False, 1, 2), (12, 1, False, 2, 0), (16, 1, False, 2, 1)] * 2
    assert found["tracks"] == [{"number": 1, "kind": 2, "codec": "x"}] and found["cues"][0][:2] == (10_000, 1)


def brute_links(messages):
    """The parent of each message, message by message."""
    import regex

    from marquee.llm.quotes import _SENTENCE, parse

    def units(text):
        parts = [text, *text.split("\n"), *regex.split(_SENTENCE, text, flags=regex.V1)]
        clean = [regex.sub(r"[\s\p{Z}]+", " ", p).strip(" ").lower() for p in parts]
        return [(k, u) for k, u in enumerate(dict.fromkeys(clean)) if u]

    said, asked = {}, {}
    for conv, turn, text in set(messages):
        for at, (level, passage) in enumerate(parse(text)[1]):
            for place, unit in units(passage):
                if level:
                    asked.setdefault((conv, turn), []).append((level, at, place, unit))
                else:
                    said.setdefault(unit, set()).add((conv, turn))
    out = {}
    for (conv, turn), quotes in asked.items():
        ranks = []
        for level, at, place, unit in quotes:
            found = said.get(unit, set())
            near = [t for c, t in found if c == conv and t < turn]
            others = [m for m in found if m[0] != conv]
            if near or others:
                ranks.append((place > 0 and not near, level, place > 0, at, place, (conv, max(near)) if near else min(others)))
        if ranks:
            out[conv, turn] = min(ranks)[-1]
    return out


def test_links_match_brute_force_on_random_conversations(spark):
    from marquee.llm.quotes import reply_order

    rng = random.Random(13)
    stock = [" ".join(rng.choice(["ship", "port", "tide", "rope", "sail"]) for _ in range(rng.randrange(1, 5))) + rng.choice([".", "!", "?", ""]) for _ in range(14)]
    passage = lambda: rng.choice([" ", "\n"]).join(rng.choice(stock) for _ in range(rng.randrange(1, 4)))
    rows = []
    for conv in range(12):
        for turn in range(0, 40 if conv else 9000, 1 if conv else 300):
            text = "\n".join("\n".join("> " * level + line for line in passage().split("\n")) + "\n" for level in (rng.choice([0, 0, 1, 2]) for _ in range(rng.randrange(0, 4))))
            rows.append((conv, turn, text))
    rows += [rows[3], (5, 7, "> " + stock[0] + "\nsaid twice"), (5, 3000, "> " + stock[1])]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = reply_order(df).collect()
    want = brute_links(rows)
    assert len(want) > 100 and len(got) == len(set(rows))
    assert {(r["conv_id"], r["turn"]): (r["parent_conv"], r["parent_turn"]) for r in got} == {(c, t): want.get((c, t), (None, None)) for c, t, _ in rows}
    parent = {k: v for k, v in want.items() if v[0] == k[0]}

    def root(k):
        return root(parent[k]) if k in parent else k

    for conv in range(12):
        own = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(len(own)))
        assert [(r["root_turn"], r["turn"]) for r in own] == sorted((root((conv, r["turn"]))[1], r["turn"]) for r in own)


def test_long_messages_take_linear_time():
    from time import process_time

    from marquee.llm.quotes import parse

    start = process_time()
    for text in (">" * 1_000_000, "> " * 500_000, ">\n" * 500_000, "x wrote: " * 110_000, "\n" * 1_000_000, " >" * 400_000 + "\nwrote:"):
        parse(text)
    assert process_time() - start < 15 and parse(None) == ("", [])


def test_contamination_by_one_word_items_and_many_items(spark):
    from marquee.llm import decontaminate as d

    rng = random.Random(21)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(0, "the"), (1, "ax bx"), (2, "the the")] + [(k, text(rng.choice([3, 5, 13, 30]))) for k in range(3, 400)]
    docs = [(k, " ".join(rng.choice(["the", text(6), items[rng.randrange(400)][1]]) for _ in range(30))) for k in range(40)] + [(90, "the " * 5000)]
    rows, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(docs, items)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert ordered(d.contamination(rows, bench).withColumn("contaminated", d.is_contaminated()), *columns) == want
    limits = d.LEAST_BITS, d.MOST_BITS
    try:
        d.LEAST_BITS = d.MOST_BITS = 6  # a filter that passes nearly everything
        assert ordered(d.contamination(rows, bench).withColumn("contaminated", d.is_contaminated()), *columns) == want
    finally:
        d.LEAST_BITS, d.MOST_BITS = limits


def test_places_fall_with_rarity(spark):
    from marquee.llm.decontaminate import item_windows, shingle_counts, shingle_places

    docs = spark.createDataFrame([(k, "a b c d e f g h i j k l m n" + (" o" if k == 0 else "")) for k in range(50)], "doc_id long, text string")
    windows = item_windows(spark.createDataFrame([(1, "c d e f g h i j k l m n o")], "item_id long, text string"), 13, 5).cache()
    counts = {r["shingle"]: r["n"] for r in shingle_counts(docs, windows.select("shingle"), [5]).collect()}
    assert sorted(counts.values()) == [1] + [50] * 8
    rarest = windows.filter(F.col("shingle") == min(counts, key=counts.get)).select("shingle")
    assert shingle_places(docs, rarest, [5], 13, 5).filter(F.size("places") > 0).count() == 1


def test_scratch_tables_go(spark):
    import os

    from marquee.llm.common import discard, materialize, materialized, scratch_tables, shared_dir

    here = lambda: {f for f in os.listdir(shared_dir(spark)) if f.startswith("gone-")}
    with scratch_tables():
        a = materialize(spark.range(5), "gone-a")
        b = materialized(lambda: materialize(a, "gone-inner").filter("id > 1"), "gone-b")
        assert b.count() == 3 and len(here()) == 2 and not any("inner" in f for f in here())
        discard(a)
        assert len(here()) == 1
        with pytest.raises(ZeroDivisionError), scratch_tables():
            materialize(b, "gone-c")
            1 / 0
        assert len(here()) == 1
    assert not here()


def test_components_leave_labels_alone(spark):
    import os

    from marquee.llm.common import shared_dir
    from marquee.llm.components import smallest_reachable

    before = set(os.listdir(shared_dir(spark)))
    pairs = spark.createDataFrame([(k, k + 1) for k in range(1, 200)] + [(900, 901), (5, 5)], "a long, b long")
    labels = smallest_reachable(pairs)
    assert {r["label"] for r in labels.collect()} == {1, 900} and labels.count() == 202
    assert [f.split("-")[0] for f in set(os.listdir(shared_dir(spark))) - before] == ["labels"]


def test_pipeline_edges(spark, edge, tmp_path):
    """Nulls in every column, empty and very long texts, rows that repeat and clashing columns through
    all stages, then an empty table."""
    import corpus_pipeline

    own_text = edge.filter("doc_id in (4, 9)").unionByName(edge.filter("doc_id is null"))
    docs = edge.unionByName(own_text)
    bench = spark.createDataFrame([(1, "Another text under one id."), (None, "x"), (2, None)], "item_id long, text string").withColumn("score", F.lit("clash"))
    for name, rows in (("all", docs), ("none", docs.limit(0))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "all")).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 1024 and len(out) > 0
    kept = set(out.doc_id.dropna().astype(int))
    assert kept <= {1, 4, 5, 8, 9} and 1 in kept and not kept & {2, 3, 6, 7}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    columns, at = docs.columns, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path / "all"))
        assert at.columns == columns


def test_items_without_an_id_hit(spark):
    from marquee.llm.decontaminate import contamination, drop_contaminated

    letters = "a b c d e f g h i j k l m n o"
    docs = spark.createDataFrame([(1, letters), (2, "p q r s"), (3, letters + " p q r s")], "doc_id long, text string")
    items = spark.createDataFrame([(None, letters[:25]), (7, "q r"), (None, "q r")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in contamination(docs, items).collect()}
    assert got == {1: (13, 0), 2: (2, 1), 3: (15, 1)} and drop_contaminated(docs, items).isEmpty()


def test_short_blocks_have_errors():
    from marquee.llm import matroska as m

    for lacing in range(4):
        for n in range(6):
            block = (b"\x81\x00\x00" + bytes([0x80 | lacing << 1]) + b"\x00\x00")[:n]
            media = m._HEADER + m._element(m.SEGMENT, m._element(m.CLUSTER, m._element(m.SIMPLE_BLOCK, block)))
            try:
                packets = m.demux(media + b"\x00" * 9)["packets"] if n > 9 else m.demux(media)["packets"]
            except ValueError:
                continue
            assert n >= (4 if not lacing else 5) and all(p[3] >= 0 for p in packets)


def test_folders_go_with_their_scope(spark):
    import os

    import public_tokenizers

    from marquee.llm.common import scratch_tables, shared_dir
    from marquee.llm.simple8b import token_file_digests

    before = set(os.listdir(shared_dir(spark)))
    with scratch_tables():
        docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
        assert token_file_digests(spark, docs, public_tokenizers.path("word_bpe_49k.json"), False, 2).count() == 1
    assert set(os.listdir(shared_dir(spark))) == before


def test_rows_of_one_id_are_bounded_in_training(spark):
    from marquee.llm.quality_crf import fit

    docs = spark.createDataFrame([(k % 2, f"good line {k}\n" * 9 if k % 2 else f"#{k}$%\n" * 9) for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int")
    assert fit(docs, labels, train_docs=10, train_lines=90) is not None


def test_leads_of_quotations():
    from marquee.llm.quotes import parse

    long = "On " + "a long day, " * 40 + "someone wrote:"
    for lead in (long, "Ann wrote:", "Er schrieb :  "):
        for gap in ("", "\n", "\n \n\n"):
            assert parse(f"Yes.\n{lead}\n{gap}> what was said\n> here\nNo.") == ("Yes.\nNo." if not gap else parse(f"Yes.\n{gap}> what was said\n> here\nNo.")[0], [(0, "Yes."), (1, "what was said\nhere"), (0, "No.")])
    assert parse("He said:\nnothing")[0] == "He said:\nnothing" and parse("He said:\n\nnothing\n> q")[0] == "He said:\n\nnothing"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a <math><mi>x</mi><annotation>tex</annotation></math> b", "a x b"),
        ("a <svg><title>no</title><desc>no</desc><text>label</text></svg> b", "a label b"),
        ("<dialog>shut</dialog><dialog open>hello</dialog>", "hello"),
        ("<dialog open hidden>hello</dialog>x", "x"),
        ("<details>a<summary>head</summary>b</details>", "head"),
        ("<details open>a<summary>head</summary>b</details>", "a\nhead\nb"),
        ("<details>no summary</details>x", "x"),
        ("<style>@media print{@media screen{p{display:none}}}@media screen{b{display:none}}i{display:none}</style><p>a<b>b</b><i>c</i>", "a"),
    ],
)
def test_more_visible_text(page, text):
    from marquee.llm.html_layout import build, page_layout

    assert page_layout(build(page)) == text


@pytest.mark.parametrize("sheet", ["@media screen{" * 60_000, "@media screen{p{x:y}" * 40_000, "@media print{" * 60_000 + "}" * 60_000])
def test_nested_style_sheets_take_linear_time(sheet):
    import time

    from marquee.llm.html_layout import build, page_layout

    began = time.process_time()
    assert page_layout(build(f"<style>{sheet}</style>x")) == "x"
    assert time.process_time() - began < 4


def test_row_spans_hold_to_their_last_row():
    """Spans over many rows with few cells kept their columns for a bounded number of looks only."""
    import random

    from marquee.llm.html_layout import Spans, Styles, _grid, build

    page = "<table><tr>" + "<td rowspan=65534>a" * 1000 + "<tr>" * 200 + "<tr><td>b</table>"
    grid = _grid(next(c for c in build(page).children if c.tag == "table"), Styles([]))
    assert len(grid) == 2 and [c[0] for c in grid[1]] == [1000]
    rng = random.Random(4)
    for _ in range(300):
        spans, until = Spans(), {}
        for _ in range(rng.randrange(1, 25)):
            first, n, end = rng.randrange(40), rng.choice([1, 2, 3, 9]), rng.randrange(1, 12)
            spans.take(first, n, end)
            for c in range(first, first + n):
                until[c] = max(until.get(c, 0), end)
            column, row = rng.randrange(55), rng.randrange(12)
            free = next(c for c in range(column, 100) if until.get(c, 0) <= row)
            assert spans.next_free(column, row) == free
