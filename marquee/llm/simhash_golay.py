"""SimHash fingerprints linked by Golay-code fuzzy hashing.

The 64 bits are split into segments of 22, 21 and 21 bits, each the low bits of a 23-bit word. The
binary Golay code (23, 12) is perfect: each word decodes to exactly one of 4096 codewords, at most 3
bits away. If two fingerprints differ in at most 4 bits, some fingerprint half-way is within two
bits of both; those two bits lie in one segment, or one each in two. Each fingerprint therefore has
as keys the codeword indices of its three segments, 36 bits together, for itself and for everything
within two bits. Most flips stay within a codeword's reach, so that is about 120 distinct keys and
not 2081. Linked fingerprints share a key for certain; a shared key is verified on all 64 bits.

Keys, and so shuffled rows, grow in proportion to the distinct fingerprints n. Unlinked ones meet by
chance in about n * 120**2 / 2**36 keys each, 2 at 10**7 and 210 at 10**9: up to some 10**9 such
pairs cost less than the keys themselves, beyond it they grow with the square of n, as comparisons
within a key and not as shuffled rows. Only pairs of different components are formed at all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm.common import batch, materialize, materialized, string_parts, text_key, tidy, with_identity
from marquee.llm.components import smallest_reachable

#: Fixed value: generator polynomial of the binary Golay code.
GENERATOR = 0b101011100011
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (lowest bit, bits)
MAX_BITS = 4


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit polynomials by the generator."""
    words = words.astype(np.int64).copy()
    for k in range(22, 10, -1):
        words ^= np.where(words >> k & 1, GENERATOR << (k - 11), 0)
    return words


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 4096 high parts of a word, and the error of each of the 2048 remainders."""
    single = 1 << np.arange(23)
    errors = [np.zeros(1, np.int64), single]
    for _ in range(2):
        errors.append(np.unique((errors[-1][:, None] | single[None, :]).reshape(-1)))
    error = np.zeros(2048, np.int64)
    for e in reversed(errors):
        error[_remainder(e)] = e
    return _remainder(np.arange(4096) << 11), error


class Golay:
    def __init__(self) -> None:
        self.high, self.error = golay_tables()

    def index(self, words: np.ndarray) -> np.ndarray:
        """The index, 0 to 4095, of the codeword nearest to each 23-bit word."""
        return (words ^ self.error[self.high[words >> 11] ^ (words & 2047)]) >> 11


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Each row's distinct values, repeated at its end up to the longest row."""
    rows = np.sort(rows, axis=1)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    place = np.cumsum(new, axis=1) - 1
    out = np.repeat(rows[:, -1:], place[:, -1].max(initial=0) + 1, axis=1)
    row, column = np.nonzero(new)
    out[row, place[row, column]] = rows[row, column]
    return out


def fuzzy_keys(fingerprints: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row of the fingerprint, key): the distinct keys of each fingerprint."""
    own, one, two = [], [], []
    for low, bits in SEGMENTS:
        words = (fingerprints >> np.uint64(low)).astype(np.int64)[:, None] & ((1 << bits) - 1)
        flip = 1 << np.arange(bits)
        i, j = np.triu_indices(bits, 1)
        own.append(golay.index(words))
        one.append(_distinct(np.concatenate([own[-1], golay.index(words ^ flip)], axis=1)))
        two.append(_distinct(golay.index(words ^ (flip[i] | flip[j]))))
    keys = [a[:, :, None, None] << 24 | b[:, None, :, None] << 12 | c[:, None, None, :] for a, b, c in ((one[0], one[1], own[2]), (one[0], own[1], one[2]), (own[0], one[1], one[2]), (two[0], own[1], own[2]), (own[0], two[1], own[2]), (own[0], own[1], two[2]))]
    keys = np.sort(np.concatenate([k.reshape(len(fingerprints), -1) for k in keys], axis=1), axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(new)[0], keys[new]


#: For each byte value, its bits from the highest to the lowest as eight bytes of a 64-bit word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).reshape(256)


def simhash(texts: list[bytes], words_in_shingle: int = 4, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit fingerprints: bit by bit, whether over half of the shingle hashes have it set.

    ASCII letters are lower-cased, words are split at ASCII white space, shingles repeat as often as
    they occur. Fewer words than a shingle has make one shingle; no word makes the fingerprint zero.
    """
    import xxhash

    digest = xxhash.xxh64_digest
    out = np.zeros(len(texts), ">u8")
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        n = max(1, len(words) - words_in_shingle + 1)
        counts = np.zeros(64, np.int64)
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths) - 1
        starts = (ends - lengths + 1)[:n].tolist()
        ends = ends[-n:].tolist()
        for a in range(0, n, 1 << 17):
            hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[a : a + (1 << 17)], ends[a : a + (1 << 17)])])
            lanes = _LANES[np.frombuffer(hashes, np.uint8)].reshape(-1, 8)
            sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)  # a byte holds 255
            counts += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out[i : i + 1] = np.packbits(counts * 2 > n).view(">u8")
    return out.astype(np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and fingerprint (a signed long) of every row; a null text has no words."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fingerprint", pa.int64())])

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = string_parts(b.column(2))
            data = data.tobytes()
            bits = simhash([data[s:e] for s, e in zip(offsets.tolist(), offsets[1:].tolist())])
            yield batch(schema, [b.column(0), b.column(1), bits.view(np.int64)])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return columns.mapInArrow(tidy(hashed), "doc_id long, text_key long, fingerprint long")


def near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """(node, label) for each linked fingerprint of ``distinct`` (fingerprint, each once): label is
    the smallest fingerprint reachable over links of at most MAX_BITS bits.

    First each key's fingerprints are compared with the smallest of the key, so that a dense group
    joins up without its pairs; then pairs under a key are formed only where the key still holds
    different components, and only between those.
    """
    schema = pa.schema([("key", pa.int64()), ("fingerprint", pa.int64())])

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for b in batches:
            all_prints = b.column(0).to_numpy().view(np.uint64)
            for a in range(0, len(all_prints), 1000):
                prints = all_prints[a : a + 1000]
                rows, keys = fuzzy_keys(prints, golay)
                yield batch(schema, [keys, prints[rows].view(np.int64)])

    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = distinct.select("fingerprint").repartition(tasks).mapInArrow(tidy(keyed), "key long, fingerprint long")
    # Running frames: a key's fingerprints stream past, whatever their number.
    order = Window.partitionBy("key").orderBy("fingerprint")
    placed = keys.select("key", "fingerprint", F.first("fingerprint").over(order).alias("pivot"), F.lead("fingerprint").over(order).alias("next"))
    keys = materialize(placed.filter((F.col("fingerprint") != F.col("pivot")) | F.col("next").isNotNull()).drop("next"), "keys")
    to_pivot = keys.filter((F.col("fingerprint") != F.col("pivot")) & near(F.col("fingerprint"), F.col("pivot")))
    links = materialize(to_pivot.select(F.col("pivot").alias("a"), F.col("fingerprint").alias("b")).distinct(), "links")
    labels = smallest_reachable(links)
    labelled = keys.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("key", "fingerprint", F.coalesce("label", "fingerprint").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    rest = materialize(labelled.join(mixed, "key"), "mixed-keys")
    a = rest.select("key", F.col("fingerprint").alias("a"), F.col("label").alias("label_a"))
    b = rest.select("key", F.col("fingerprint").alias("b"), F.col("label").alias("label_b"))
    across = a.join(b, (a.key == b.key) & (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & near(F.col("a"), F.col("b")))
    more = materialize(across.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct(), "links")
    top = smallest_reachable(more).select(F.col("node").alias("label"), F.col("label").alias("top"))
    met = more.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    every = labels.unionByName(met.join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
    return every.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label"))


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fingerprint and component_id of every row of ``docs``.

    component_id is the smallest doc_id whose fingerprint is reachable over links of at most 4 bits,
    itself included. Texts that are null, empty or of white space alone have fingerprint 0, which
    links like any other. A null doc_id takes part, but is never the smallest unless its component
    has no other. Very long texts are read whole, by one task. Rows that repeat stay; other columns of
    docs are not read.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    labels = materialized(lambda: link_fingerprints(distinct), "fingerprint-labels").withColumnRenamed("node", "fingerprint")
    placed = distinct.join(labels, "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    first = placed.groupBy("label").agg(F.min("first").alias("component_id"))
    component = placed.join(first, "label").select("fingerprint", "component_id")
    return prints.join(component, "fingerprint").select("doc_id", "text_key", "fingerprint", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without near duplicates: of each component the row with the smallest doc_id stays,
    once if that row repeats (of several texts under that doc_id, the first by text hash)."""
    rows = near_duplicate_groups(docs).groupBy("component_id", "doc_id", "text_key").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "n")).alias("best")
    kept = rows.groupBy("component_id").agg(best).select("best.doc_id", "best.text_key", "best.n")
    tagged = with_identity(docs)
    stay = tagged.join(kept, tagged["own_id"].eqNullSafe(kept["doc_id"]) & (tagged["own_key"] == kept["text_key"]))
    once = stay.filter("n = 1").select("row.*")
    return once.unionByName(stay.filter("n > 1").dropDuplicates(["own_id", "own_key"]).select("row.*"))


def hexadecimal(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")
