"""Importance resampling: draws the documents whose words look like those of a target.

Features are the runs of 1 to N_MAX words of a text, hashed into BUCKETS buckets. How much commoner a
bucket is in the target than in the corpus is its gain; a document weighs the sum of the gains of its
features, and Gumbel noise on top of the weights makes the highest scores a draw without replacement.

Texts are split by overlap chunking: a text of more than CHUNK_BYTES is cut at word boundaries into
chunks, each of which owns the features that start in it and carries the first N_MAX - 1 words of the
next ones, so that runs across a cut count once. The chunks of long texts are dealt over all tasks, and
counts and weights are summed again: counts by bucket, weights by document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import batch, byte_words, ranked, steps, string_parts, text_key, tidy

#: Longest run of words that is a feature, and the number of buckets.
N_MAX, BUCKETS = 3, 10_000
#: Documents of fewer words are never drawn; the share drawn is DRAW_PERCENT of the others.
MIN_WORDS, DRAW_PERCENT, SEED = 20, 5, 42
#: Texts of more bytes are split. Only where the work is done depends on it.
CHUNK_BYTES = 256 << 10

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


# crc32 of many ranges of bytes, and of their concatenations


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _byte_table()
_LONG = 64


def _zeros_tables() -> np.ndarray:
    """[n, k, b]: what byte k of a register, with value b, becomes after n bytes of zero."""
    out = np.zeros((_LONG + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(_LONG):
        out[n + 1] = (out[n] >> 8) ^ _TABLE[out[n] & 255]
    return out


_ZEROS = _zeros_tables()


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The registers after n bytes of zero each."""
    far = np.flatnonzero(n > _LONG)
    if len(far):
        crc, n = crc.copy(), n.copy()
        while len(far):
            c = crc[far]
            crc[far] = _ZEROS[_LONG, 0, c & 255] ^ _ZEROS[_LONG, 1, (c >> 8) & 255] ^ _ZEROS[_LONG, 2, (c >> 16) & 255] ^ _ZEROS[_LONG, 3, c >> 24]
            n[far] -= _LONG
            far = far[n[far] > _LONG]
    return _ZEROS[n, 0, crc & 255] ^ _ZEROS[n, 1, (crc >> 8) & 255] ^ _ZEROS[n, 2, (crc >> 16) & 255] ^ _ZEROS[n, 3, crc >> 24]


def range_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of the bytes of each range: byte by byte for all ranges at once, the longest first."""
    size = ends - starts
    out = np.empty(len(starts), np.uint32)
    for i in np.flatnonzero(size > _LONG):
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -_LONG) :]
    at, longer = starts[order], np.searchsorted(-size[order], -np.arange(_LONG + 1))
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(_LONG):
        k = int(longer[j])  # as many ranges have more than j bytes
        if not k:
            break
        c = crc[:k]
        crc[:k] = _TABLE[(c ^ data[at[:k] + j]) & 255] ^ (c >> 8)
    out[order] = ~crc
    return out


def _with_space(crc: np.ndarray) -> np.ndarray:
    c = ~crc
    return ~(_TABLE[(c ^ 32) & 255] ^ (c >> 8))


def features(data: np.ndarray, offsets: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of the texts at ``offsets`` of ``data``, and the number of words
    of each. own: with how many of its words a text's features may start, if not with all."""
    data = _LOWER[data]
    starts, ends = byte_words(data, offsets, _WORD)
    row, size = np.searchsorted(offsets, starts, side="right") - 1, ends - starts
    first = np.searchsorted(row, np.arange(len(offsets)))
    n_words = np.diff(first)
    starting = np.ones(len(row), bool)
    if own is not None:
        n_words = np.minimum(n_words, own)
        starting = np.arange(len(row)) - first[row] < own[row]
    crc = run = range_crcs(data, starts, ends)
    rows, buckets = [row[starting]], [run[starting] % BUCKETS]
    for n in range(1, N_MAX):
        if len(row) <= n:
            break
        # crc(a + " " + b) is the crc of a and the space, carried on over the bytes of b, and that of b.
        run = _shifted(_with_space(run[:-1]), size[n:]) ^ crc[n:]
        within = (row[:-n] == row[n:]) & starting[:-n]
        rows.append(row[:-n][within])
        buckets.append(run[within] % BUCKETS)
    return np.concatenate(rows), np.concatenate(buckets).astype(np.int64), n_words


# chunks


def cuts(text: bytes, chunk_bytes: int) -> Iterator[tuple[int, bytes]]:
    """(words that it owns, bytes with the carried words) of the chunks of a text. Cuts lie where a
    word starts; a word of more than a chunk stays whole."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = byte_words(data, np.array([0, len(data)]), _WORD)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + chunk_bytes)))
        carried = min(len(starts), stop + N_MAX - 1)
        yield stop - at, text[starts[at] : ends[carried - 1]]
        at = stop


_CHUNK = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("chunk", pa.int32()), ("own", pa.int64()), ("text", pa.binary())])


def chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id, key, chunk, own, text (bytes) of all texts of ``docs``. A text up to ``chunk_bytes``, empty or
    null is one chunk that owns all its words (own is null) and stays in its task; chunks of longer ones
    are dealt over all tasks. A text without a word still has its chunk 0."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                doc_id, key, n = b.column(0)[i].as_py(), b.column(1)[i].as_py(), 0
                for n, (own, text) in enumerate(cuts(b.column(2)[i].as_py(), chunk_bytes), 1):
                    yield batch(_CHUNK, [[doc_id], [key], [n - 1], [own], [text]])
                if not n:
                    yield batch(_CHUNK, [[doc_id], [key], [0], [0], [b""]])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_key().alias("key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    long = F.octet_length("text") > chunk_bytes
    short = rows.filter(~long).select("id", "key", F.lit(0).alias("chunk"), F.lit(None).cast("long").alias("own"), "text")
    dealt = rows.filter(long).mapInArrow(tidy(split), "id long, key long, chunk int, own long, text binary").repartition("id", "key", "chunk")
    return short.unionByName(dealt)


def _parts(b: pa.RecordBatch) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Ranges of the rows of a batch with their features, about a million bytes at a time."""
    data, offsets = string_parts(b.column(b.schema.get_field_index("text")).cast(pa.large_binary()).view(pa.large_utf8()))
    own = b.column(b.schema.get_field_index("own")).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    for lo, hi in steps(offsets, 1 << 20):
        yield lo, hi, features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], own[lo:hi])


def bucket_counts(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task gives its sums once, so the driver
    and the shuffle see at most BUCKETS rows a task, whatever the texts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, (_, buckets, _) in _parts(b):
                total += np.bincount(buckets, minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    found = chunks(docs, chunk_bytes).select("own", "text").mapInArrow(tidy(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BUCKETS, np.int64)
    total[found.bucket.to_numpy(np.int64)] = found.n.to_numpy(np.int64)
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how much commoner each bucket is in the target), with one added to each count."""
    s, t = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + BUCKETS) / ((a + 1.0) * (t + BUCKETS)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, key, n_words, n_features, weight of every row of ``docs``.

    Chunks' sums are added by document. Rows that repeat entirely give a row each: their sums are
    added up together and divided by their number, which is that of their first chunks.
    """
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("first", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, (row, buckets, n_words) in _parts(b):
                n = np.bincount(row, minlength=hi - lo)
                # Sums of whole numbers below 2**53 are exact in doubles.
                weight = np.bincount(row, gain[buckets], minlength=hi - lo).astype(np.int64)
                part = b.slice(lo, hi - lo)
                first = (part.column(2).to_numpy() == 0).astype(np.int64)
                yield batch(schema, [part.column(0), part.column(1), first, n_words, n, weight])

    found = chunks(docs, chunk_bytes).mapInArrow(tidy(weigh), "id long, key long, first long, n_words long, n_features long, weight long")
    summed = found.groupBy("id", "key").agg(*(F.sum(c).alias(c) for c in ("first", "n_words", "n_features", "weight")))
    each = summed.select("id", "key", *(F.expr(f"{c} div first").alias(c) for c in ("n_words", "n_features", "weight")), F.explode(F.sequence(F.lit(1).cast("long"), "first")))
    return each.select(F.col("id").alias("doc_id"), "key", "n_words", "n_features", "weight")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise), told by the seed and the id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAW_PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``: rank is 1, 2, ...
    for those drawn, else null. ``docs`` has doc_id and text, ``target`` has text.

    Of the rows with at least ``min_words`` words, floor(percent / 100 of them) with the highest scores
    are drawn, ties by smaller doc_id (null first), then by a hash of the text. Null texts have no
    words and weight 0. Rows that repeat are ranked one by one. An empty table gives an empty one, an
    empty target gains that only follow the corpus. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, chunk_bytes), bucket_counts(target.select(F.lit(0).alias("doc_id"), "text"), chunk_bytes))
    scored = weights(docs, gain, chunk_bytes).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    out = (F.col("n_words") < min_words).cast("int").alias("out")
    placed = ranked(scored.select("*", out), ["out", F.desc("score"), "doc_id", "key"], name="scores")
    drawn = percent * placed.filter("out = 0").count() // 100
    rank = F.when((F.col("out") == 0) & (F.col("position") < drawn), F.col("position") + 1)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
