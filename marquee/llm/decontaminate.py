"""Benchmark decontamination as a prefix-filtered set join.

A window of an item is the set of its word shingles, and a document holds the window only if it has
them all, so one shingle is a sufficient prefix: the window's rarest. A first pass over the documents
counts the benchmark's shingles, no places; the counts order the shingles of a window by rarity. A
second pass finds the places of the rarest alone, with as many words around them as a window can
have there; these are joined with the windows, kept where the window fits between the document's
ends (length and position), and verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm.common import batch, byte_words, materialize, materialized, mix, range_hashes, steps, string_parts, text_key, tidy, with_identity

#: ASCII bytes below 0x80 that belong to words: digits and lower-case letters. All others belong too.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Bits of the filter of benchmark shingles: this many for each, as a power of two between two limits
#: (32 MB at most, whatever the benchmark's size). A fuller filter lets more through to the joins,
#: which are exact.
BITS_EACH, LEAST_BITS, MOST_BITS = 256, 22, 28


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; positions too near the end are left out."""
    n = max(0, len(words) - k + 1)
    h = np.full(n, np.uint64(k))
    for i in range(k):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[i : i + n])
    return h


def words_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By steps: first row, lower-cased bytes, starts, ends and hashes of words, words before each row."""
    data, offsets = string_parts(column)
    for lo, hi in steps(offsets):
        part = _LOWER[data[offsets[lo] : offsets[hi]]]
        rows = offsets[lo : hi + 1] - offsets[lo]
        starts, ends = byte_words(part, rows, _WORD)
        yield lo, part, starts, ends, range_hashes(part, starts, ends), np.searchsorted(starts, rows)


ITEM = "item_id string, window int, length int, place int, shingle long, k int, words array<string>"


def item_windows(benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """A row for each shingle of each window of each item: item_id, window (its first word), length,
    place (of the shingle in it), shingle, k (its words) and words.

    An item of fewer words than ``window`` is one window, one of fewer than ``k`` one shingle; an
    item with no word, or null, has none.
    """
    names = [f.split()[0] for f in ITEM.split(", ")]
    schema = pa.schema(list(zip(names, [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string())])))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, part, starts, ends, hashes, bounds in words_of(b.column(1)):
                raw = part.tobytes()
                for i in range(len(bounds) - 1):
                    s, e = int(bounds[i]), int(bounds[i + 1])
                    if s == e:
                        continue
                    words = [raw[x:y].decode() for x, y in zip(starts[s:e].tolist(), ends[s:e].tolist())]
                    size = min(window, e - s)
                    width = min(k, size)
                    shingles = shingle_hashes(hashes[s:e], width).view(np.int64).tolist()
                    for a in range(0, e - s - size + 1, 500):
                        rows = [(ids[lo + i], w, size, p, shingles[w + p], width, words[w : w + size]) for w in range(a, min(a + 500, e - s - size + 1)) for p in range(size - width + 1)]
                        yield batch(schema, list(zip(*rows)))

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(tidy(cut), ITEM)


def shingle_filter(shingles: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each hash prefix that some shingle has, packed, and how many bits a prefix has. The
    aggregate that makes it has at most 2**MOST_BITS / 64 rows."""
    n = shingles.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * max(n, 1)).bit_length()))
    slots = shingles.select(F.shiftrightunsigned("shingle", 64 - bits).alias("slot"))
    words = slots.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out, bits


def _passed(h: np.ndarray, packed: np.ndarray, bits: int) -> np.ndarray:
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    return np.flatnonzero(packed[slot >> 6] >> (slot & 63) & 1)


def shingle_counts(docs: DataFrame, shingles: DataFrame, widths: list[int]) -> DataFrame:
    """shingle and n: how often the documents have it, of those shingles that pass the filter; each
    batch counts its own first."""
    schema = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])
    packed, bits = shingle_filter(shingles)
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = []
            for _, _, _, _, hashes, bounds in words_of(b.column(0)):
                for k in widths:
                    h = shingle_hashes(hashes, k)
                    hit = _passed(h, shared.value, bits)
                    inside = hit + k <= bounds[np.searchsorted(bounds, hit, side="right")]
                    seen.append(h[hit[inside]])
            if seen:
                found, n = np.unique(np.concatenate(seen), return_counts=True)
                yield batch(schema, [found.view(np.int64), n.astype(np.int64)])

    parts = docs.select("text").mapInArrow(tidy(count), "shingle long, n long")
    return parts.groupBy("shingle").agg(F.sum("n").alias("n"))


PLACES = "doc_id long, text_key long, n_words long, places array<struct<shingle: long, at: array<int>, before: array<string>, after: array<string>>>"


def shingle_places(docs: DataFrame, shingles: DataFrame, widths: list[int], window: int, k_most: int) -> DataFrame:
    """Each document's number of words, and the places of the shingles that pass the filter of
    ``shingles``, with the words around them that a window may have. Null texts have no words.

    A shingle of fewer than ``k_most`` words is a whole window, and its places in a document are one
    entry; one of ``k_most`` words has up to window - k_most words before it.
    """
    place = pa.struct([("shingle", pa.int64()), ("at", pa.list_(pa.int32())), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(place))])
    packed, bits = shingle_filter(shingles)
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, part, starts, ends, hashes, bounds in words_of(b.column(2)):
                n = len(bounds) - 1
                places: list[dict] = [{} for _ in range(n)]
                for k in widths:
                    h = shingle_hashes(hashes, k)
                    hit = _passed(h, shared.value, bits)
                    row = np.searchsorted(bounds, hit, side="right") - 1
                    inside = hit + k <= bounds[row + 1]
                    back, ahead = (window - k, window) if k == k_most else (0, k)
                    for at, r in zip(hit[inside].tolist(), row[inside].tolist()):
                        s, e = int(bounds[r]), int(bounds[r + 1])
                        first, last = max(s, at - back), min(e, at + ahead)
                        word = [part[x:y].tobytes().decode() for x, y in zip(starts[first:last], ends[first:last])]
                        m = at - first
                        own = (h[at].view(np.int64).item(), tuple(word[:m]), tuple(word[m:]))
                        places[r].setdefault(own, []).append(at - s)
                rows = [[{"shingle": x, "at": at, "before": list(before), "after": list(after)} for (x, before, after), at in p.items()] for p in places]
                yield batch(schema, [b.column(0).slice(lo, n), b.column(1).slice(lo, n), np.diff(bounds), rows])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return columns.mapInArrow(tidy(find), PLACES)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 5) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items_sha256 of every row of ``docs``.

    n_hit counts the words inside any occurrence of a window of an item, n_items the items with
    such windows; the words of an item without an id are hit as well, but it is not counted. Nulls and texts without words have zeros, as have all documents under an empty
    benchmark. Rows that repeat get the same result each; item_ids that repeat count once. A very
    long text is read whole, by one task. Columns other than doc_id, text and item_id are not read.
    """
    widths: list[int] = []  # 1 to k

    def prefixes() -> DataFrame:
        windows = materialize(item_windows(benchmark, window, k), "windows")
        widths.extend(sorted(r.k for r in windows.select("k").distinct().collect()))
        counts = materialize(shingle_counts(docs, windows.select("shingle").distinct(), widths), "shingle-counts")
        rare = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "place")
        prefix = windows.join(counts, "shingle", "left").groupBy("item_id", "words").agg(F.min(rare).alias("rare"))
        # Windows that several items share are verified once; one whose rarest shingle is nowhere is done.
        needed = prefix.groupBy("words").agg(F.min("rare").alias("rare"), F.collect_set("item_id").alias("items")).filter("rare.n > 0")
        return needed.select("words", "items", F.col("rare.shingle").alias("shingle"), F.col("rare.place").alias("place"), F.size("words").alias("length"))

    needed = materialized(prefixes, "prefixes")
    found = materialize(shingle_places(docs, needed.select("shingle").distinct(), widths, window, k), "places")
    places = found.filter(F.size("places") > 0).dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", F.explode("places").alias("p")).select("doc_id", "text_key", "p.*")
    candidate = places.join(needed, "shingle")
    fits = (F.size("before") >= F.col("place")) & (F.size("after") >= F.col("length") - F.col("place"))
    head = F.slice("before", F.size("before") - F.col("place") + 1, F.col("place"))
    same = F.concat(head, F.slice("after", F.lit(1), F.col("length") - F.col("place"))) == F.col("words")
    hits = candidate.filter(fits).filter(same).select("doc_id", "text_key", F.transform("at", lambda a: a - F.col("place")).alias("firsts"), "length", "items")
    hits = materialize(hits, "hits")
    each = hits.select("doc_id", "text_key", F.explode("firsts").alias("first"), "length")
    spans = each.groupBy("doc_id", "text_key", "first").agg(F.max("length").alias("length"))
    before = Window.partitionBy("doc_id", "text_key").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("end", F.col("first") + F.col("length")).withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
    n_hit = spans.groupBy("doc_id", "text_key").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("first", "covered"))).cast("long").alias("n_hit"))
    items = hits.select("doc_id", "text_key", F.explode("items").alias("item")).distinct().groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    keys = ["doc_id", "text_key"]
    seen = n_hit.join(items, n_hit["doc_id"].eqNullSafe(items["doc_id"]) & (n_hit["text_key"] == items["text_key"]), "left").select(n_hit["doc_id"].alias("_doc_id"), n_hit["text_key"].alias("_text_key"), "n_hit", "items")
    joined = found.select(*keys, "n_words").join(seen, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")), "left")
    return joined.select(
        *keys,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
    )


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """A twentieth of the words or more are hit, and at least one."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated; all other rows stay, with all columns, repeats included. Null
    and empty texts stay; an empty table or benchmark leaves all as it is."""
    # Written first: where few documents are contaminated, their ids are broadcast and no text is shuffled.
    bad = materialized(lambda: contamination(docs, benchmark).filter(is_contaminated()).select("doc_id", "text_key").distinct(), "contaminated")
    tagged = with_identity(docs)
    return tagged.join(bad, tagged["own_id"].eqNullSafe(bad["doc_id"]) & (tagged["own_key"] == bad["text_key"]), "left_anti").select("row.*")
