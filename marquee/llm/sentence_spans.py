"""Substring deduplication over sliding spans of sentences.

A text is cut after sentence ends and line feeds, and inside sentences of over WINDOW words after
the word pair of least hash, the last of equals, of each WINDOW in a row (winnowing). So cuts
depend on the words around them alone, not on where a sentence starts, no piece is over WINDOW
words, and a word put in or left out changes no cut WINDOW words or more away. Pieces count as
sentences from here on.

A span is a run of at least MIN_SENTENCES consecutive sentences with at least MIN_WORDS words that
loses either property without its first or without its last sentence's end: one starts at each
sentence and one ends at each. As WINDOW is below MIN_WORDS, every run of MIN_WORDS words has the
sentences. Two copies of a passage, wherever they stand, are cut alike but for at most WINDOW
words at each end, and have the same spans in between: a passage of 2 * WINDOW + MIN_WORDS words
has one at least. Spans are hashed with ASCII lower case and white space collapsed, to 128 bits, so
that of 10**13 spans no two differing ones are expected to be taken for equal (chance below 10**-12).
They are grouped over all documents, and every sentence under a span that is not the first of its
hash, by doc_id and place, is removed.

A batch of documents first compares its own spans: only the first of each hash goes on to the others,
so the places that meet for a passage are as many as batches hold it, not as many as texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm.common import batch, mix, powers, steps, string_parts, text_key, tidy, with_identity

MIN_SENTENCES = 2
MIN_WORDS = 20
#: Words of a sentence in a row of which the pair of least hash ends a piece.
WINDOW = 15
#: Rows of an Arrow batch that a task gives on.
SPANS_AT_ONCE = 1 << 15
#: Sets the two halves of a span's hash apart.
SECOND = 0x5851F42D4C957F2D
#: A run of marks is looked at once, from its first.
_END = re.compile(rb"(?:(?<![.!?])[.!?]++[\"')\]]*+(?=\s)|\n)\s*+")
_WORD = re.compile(rb"\S+\s*")
_MIX = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_HIGH, _LOW = np.array([0xFFFFFFFF00000000, 0xFFFFFFFF], np.uint64)


def piece_ends(text: bytes, start: int, stop: int) -> list[int]:
    """Where pieces of the sentence from start to stop end, but for its own end."""
    sentence = text[start:stop]
    words = sentence.lower().split()
    n = len(words)
    if n <= WINDOW:
        return []
    sums = np.fromiter(map(crc32, words), np.uint64, n)
    # of equal pairs, the last is the least
    least = ((sums[:-1] + sums[1:] * _MIX[0]) * _MIX[1] & _HIGH) | np.arange(n - 1, 0, -1, dtype=np.uint64)
    seen = 1
    while seen < WINDOW:
        more = min(seen, WINDOW - seen)
        least = np.minimum(least[:-more], least[more:])
        seen += more
    places = (n - 1 - (least & _LOW).astype(np.int64)).tolist()
    if len(sentence.rstrip()) == sum(map(len, words)) + n - 1:  # single white space between words
        ends = list(accumulate((len(w) + 1 for w in words), initial=start))[1:]
    else:
        ends = [m.end() for m in _WORD.finditer(text, start, stop)]
    return [ends[k] for k in dict.fromkeys(places)]


def sentence_ends(text: bytes) -> list[int]:
    """Where sentences end; the last is the end of the text. An empty text has no sentence."""
    if not text:
        return []
    ends, start = [], 0
    for stop in [*(m.end() for m in _END.finditer(text)), len(text)]:
        if stop == start:
            continue
        if stop - start > 2 * WINDOW:
            ends += piece_ends(text, start, stop)
        ends.append(stop)
        start = stop
    return ends


def spans(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of all spans, in sentences; words counts the words of each sentence and bounds
    holds the first sentence of each text, and the number of all."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    i = np.arange(n)
    end = np.maximum(np.searchsorted(total, total[:-1] + MIN_WORDS, side="left"), i + MIN_SENTENCES)
    ok = end <= bounds[text + 1]
    stop = i + 1
    first = np.minimum(np.searchsorted(total, total[1:] - MIN_WORDS, side="right") - 1, stop - MIN_SENTENCES)
    fine = first >= bounds[text]
    both = np.unique(np.concatenate([i[ok] * (n + 1) + end[ok], first[fine] * (n + 1) + stop[fine]]))
    return both // (n + 1), both % (n + 1)


SPANS = "hash long, check long, doc_id long, text_key long, place long, later boolean"


def _hashes(digests: np.ndarray, first: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of the digests of each run of sentences."""
    values = mix(digests + np.uint64(salt))
    p, q = powers(len(values) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * p[: len(values)], dtype=np.uint64)])
    return mix((sums[end] - sums[first]) * q[first] + (end - first).astype(np.uint64))


def _repeats(h: np.ndarray, check: np.ndarray, null: np.ndarray, ids: np.ndarray, keys: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which spans come after another of their hash, by doc_id (null last), text and place. Equal
    places of rows that repeat count as one."""
    out = np.zeros(len(h), bool)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    shared = np.zeros(len(h), bool)
    shared[1:] |= same
    shared[:-1] |= same
    some = order[shared]  # few: those whose hash another has
    if not len(some):
        return out
    some = some[np.lexsort((place[some], keys[some], ids[some], null[some], check[some], h[some]))]
    a, b = some[:-1], some[1:]
    same = (h[a] == h[b]) & (check[a] == check[b])
    twin = same & (null[a] == null[b]) & (ids[a] == ids[b]) & (keys[a] == keys[b]) & (place[a] == place[b])
    # the first of a hash, and its twins, are not later
    group, step = np.concatenate([[0], np.cumsum(~same)]), np.concatenate([[0], np.cumsum(~twin)])
    begins = np.searchsorted(group, np.arange(group[-1] + 1))
    out[some] = step != step[begins][group]
    return out


def span_hashes(docs: DataFrame) -> DataFrame:
    """hash and check (128 bits), doc_id, text_key and place (first and end sentence, 32 bits each) of
    spans of every text, and whether a span is known to come after another of its hash.

    Null and empty texts have none. Of spans that come later in their batch the hash is random. Rows
    that repeat entirely give the same places.
    """
    import xxhash

    schema = pa.schema([("hash", pa.int64()), ("check", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("place", pa.int64()), ("later", pa.bool_())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_digest
        for b in batches:
            data, offsets = string_parts(b.column(2))
            doc_ids, keys = b.column(0), b.column(1)
            found = []
            for lo, hi in steps(offsets):
                digests, words, counts = [], [], []
                for r in range(lo, hi):
                    text = data[offsets[r] : offsets[r + 1]].tobytes().lower()
                    start, n = 0, 0
                    for stop in sentence_ends(text):
                        part = text[start:stop].split()
                        digests.append(digest(b" ".join(part)))
                        words.append(len(part))
                        start, n = stop, n + 1
                    counts.append(n)
                if not digests:
                    continue
                bounds = np.concatenate([[0], np.cumsum(counts)])
                first, end = spans(np.array(words), bounds)
                row = np.searchsorted(bounds, first, side="right") - 1
                own = np.frombuffer(b"".join(digests), "<u8")
                found.append((_hashes(own, first, end, 0), _hashes(own, first, end, SECOND), row + lo, (first - bounds[row]) << 32 | (end - bounds[row])))
            if not found:
                continue
            h, check, row, place = (np.concatenate([f[k] for f in found]) for k in range(4))
            null = np.asarray(doc_ids.is_null())[row]
            ids = doc_ids.fill_null(0).to_numpy()[row]
            later = _repeats(h, check, null, ids, keys.to_numpy()[row], place)
            # those that are known to repeat need not meet the others: they are dealt out evenly
            h = np.where(later, mix(h + mix(ids.astype(np.uint64) + np.uint64(1)) + place.astype(np.uint64)), h)
            for a in range(0, len(h), SPANS_AT_ONCE):
                s = slice(a, a + SPANS_AT_ONCE)
                at = pa.array(row[s])
                yield batch(schema, [h[s].view(np.int64), check[s].view(np.int64), doc_ids.take(at), keys.take(at), place[s], later[s]])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return columns.mapInArrow(tidy(cut), SPANS)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and ranges (array of first, end in sentences) for documents with a span that
    is not the first of its hash. One shuffle by hash and a running rank, equal places as one, tell the
    spans that no batch has told."""
    order = Window.partitionBy("later", "hash", "check").orderBy(F.col("doc_id").isNull(), "doc_id", "text_key", "place")
    later = span_hashes(docs).withColumn("rank", F.rank().over(order)).filter("later or rank > 1")
    place = F.struct(F.shiftright("place", 32).cast("int").alias("first"), F.col("place").bitwiseAND(0xFFFFFFFF).cast("int").alias("end"))
    return later.groupBy("doc_id", "text_key").agg(F.collect_set(place).alias("ranges"))


def remaining(text: str | None, gone: list[dict] | None) -> tuple[str | None, int, int]:
    """What is left of a text without the sentences in ``gone``, its sentences, and those removed."""
    raw = (text or "").encode()
    ends = sentence_ends(raw)
    if not gone:
        return text, len(ends), 0
    drop = np.zeros(len(ends) + 1, np.int64)
    np.add.at(drop, [g["first"] for g in gone], 1)
    np.add.at(drop, [g["end"] for g in gone], -1)
    stays = np.cumsum(drop)[:-1] == 0
    left = b"".join(raw[s:e] for s, e, stay in zip([0, *ends], ends, stays) if stay)
    return left.decode(), len(ends), int((~stays).sum())


def remove_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with text cut to the sentences outside ``ranges``, and n_sentences,
    n_removed. Texts without ranges stay as they are, null texts null."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out, n, removed = b.column(1).to_pylist(), [], [], []
            for text, gone in zip(texts, b.column(2).to_pylist()):
                left, sentences, cuts = remaining(text, gone)
                out.append(left)
                n.append(sentences)
                removed.append(cuts)
            yield batch(schema, [b.column(0), out, n, removed])

    tagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key"))
    r = ranges.select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_key"), "ranges")
    joined = tagged.join(r, (tagged["text_key"] == r["_key"]) & tagged["doc_id"].eqNullSafe(r["_doc_id"]), "left")
    return joined.select("doc_id", "text", "ranges").mapInArrow(tidy(cut), "doc_id long, text string, n_sentences long, n_removed long")


def deduplicate_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_sentences, n_removed of every row of ``docs``; see the module.

    Rows that repeat entirely count as one document and stay, each with the same result; the same
    text under two doc_ids is a repeat. An empty table stays empty. Other columns are not read.
    """
    return remove_ranges(docs, repeated_ranges(docs))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, and repeated passages cut from text; n_chars,
    if there, is the length of what is left. No row goes."""
    ranges, tagged = repeated_ranges(docs), with_identity(docs)
    joined = tagged.join(ranges, (tagged["own_key"] == ranges["text_key"]) & tagged["own_id"].eqNullSafe(ranges["doc_id"]), "left").select("row.*", "ranges")
    joined = joined.toDF(*(f"c{i}" for i in range(len(docs.columns))), "ranges")
    text_at, ranges_at = docs.columns.index("text"), len(docs.columns)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [remaining(t, gone)[0] if gone else t for t, gone in zip(b.column(text_at).to_pylist(), b.column(ranges_at).to_pylist())]
            arrays = [pa.array(texts, b.schema.field(i).type) if i == text_at else b.column(i) for i in range(ranges_at)]
            yield pa.RecordBatch.from_arrays(arrays, names=docs_columns)

    docs_columns = docs.columns
    out = joined.mapInArrow(tidy(cut), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out
