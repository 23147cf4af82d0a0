"""Best-fit packing planned over a histogram of lengths.

Best-fit decreasing needs only how many pieces there are of each length, so the plan is made on at
most ``capacity`` counts, whatever the number of documents. Each line of the plan says: the pieces
of one length with ranks a to b take one place each in consecutive sequences, at one offset. Pieces
get their rank within their length by counts of hash buckets, so that a length that a third of all
pieces have is ranked by many tasks, and take their places by a join on length and rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm.common import batch, materialize, steps, tidy
from marquee.llm.wordcache import WordCacheTokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, rank_from long, rank_to long, sequence_from long, offset long"


def cut_pieces(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first may be shorter than the others."""
    first = n_tokens % capacity or min(n_tokens, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n_tokens, capacity))]


def token_pieces(docs: DataFrame, tokenizer: str, keeps_space: bool, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of every text.

    A null text is empty: one piece with the end id. Rows that repeat give pieces each time, also under
    a null doc_id. Very long texts are encoded whole, by one task; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCacheTokenizer.of(tokenizer, keeps_space)
        for b in batches:
            lengths = np.frombuffer(b.column(1).cast(pa.large_string()).buffers()[1], np.int64)[: b.num_rows + 1]
            for lo, hi in steps(lengths, 6 << 20):
                ids, offsets = coder.encode_ended(b.column(1).slice(lo, hi - lo), end_id)
                data = memoryview(ids.astype("<u4").tobytes())
                rows = [
                    (doc_id, k, s, n, zlib.crc32(data[4 * (o + s) : 4 * (o + s + n)]))
                    for doc_id, o, e in zip(b.column(0).slice(lo, hi - lo).to_pylist(), offsets.tolist(), offsets[1:].tolist())
                    for k, (s, n) in enumerate(cut_pieces(e - o, capacity))
                ]
                if rows:
                    yield batch(schema, list(zip(*rows)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(cut), PIECES)


def plan_places(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, rank_from, rank_to, sequence_from, offset).

    Open sequences with the same room left form groups (first sequence, how many). Pieces of the
    longest length go first, each into the sequence with the least room that is enough. Of equal
    pieces the next goes where the last went, as long as it fits there, so a group's sequences fill
    up one by one; a length that finds no room opens sequences in the same way. Plain best-fit over
    the pieces gives the same rooms.
    """
    rooms: list[int] = []  # ascending, those with open sequences
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)
    plan, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if not groups[room]:
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                room, each = capacity, capacity // length
                first, n = opened, -(-left // each)
                opened += n
            else:
                room = rooms[i]
                each = room // length
                first, n = groups[room].pop()
                if not groups[room]:
                    rooms.pop(i)
            full = min(n, left // each)
            over = min(left - full * each, each) if full < n else 0
            for k in range(each if full else 0):
                plan.append((length, rank, rank + full, first, capacity - room + k * length))
                rank += full
            for k in range(over):
                plan.append((length, rank, rank + 1, first + full, capacity - room + k * length))
                rank += 1
            left -= full * each + over
            put(room - each * length, first, full)
            if over:
                put(room - over * length, first + full, 1)
            put(room, first + full + bool(over), n - full - bool(over))
    return plan


def ranked_within_length(pieces: DataFrame, buckets: int) -> DataFrame:
    """``pieces`` with the column rank: 0, 1, ... within each length.

    Each length is dealt over hash buckets; a piece's rank is its rank in its bucket plus the
    counts of the buckets before. ``pieces`` must be materialised, as it is read twice.
    """
    order = ("doc_id", "piece", "ids_crc32")
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1
    ranked = dealt.withColumn("local", local)
    return ranked.join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("local")).drop("bucket", "local", "before")


def pack(pieces: DataFrame, capacity: int, rows_per_bucket: int = 50_000) -> DataFrame:
    """``pieces`` (materialised, with length from 1 to capacity) with sequence_id and offset.

    An empty table stays empty. Ties in length are ranked by doc_id, piece and ids; nulls come first, and
    rows that repeat entirely take places in any order. All columns of ``pieces`` stay.
    """
    spark = pieces.sparkSession
    histogram = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError(f"a piece has no length from 1 to {capacity}")
    plan = spark.createDataFrame(plan_places(histogram, capacity), PLAN)
    ranked = ranked_within_length(pieces, max(16, -(-max(histogram.values(), default=0) // rows_per_bucket)))
    # A length has at most capacity / length lines for each group of open sequences that it fills or
    # splits, so the size of the plan follows capacity alone.
    inside = (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    joined = ranked.alias("r").join(F.broadcast(plan).alias("p"), (F.col("r.length") == F.col("p.length")) & inside)
    return joined.select(*(F.col(f"r.{c}") for c in pieces.columns), (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), F.col("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, keeps_space: bool, end_id: int, capacity: int) -> DataFrame:
    """Tokenise, cut and pack every document; see token_pieces and pack."""
    return pack(materialize(token_pieces(docs, tokenizer, keeps_space, end_id, capacity), "pieces"), capacity)
