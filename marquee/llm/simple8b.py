"""Token ids in Simple-8b word-aligned files.

A 64-bit word has a selector in its top 4 bits, which says how many ids of which width fill the
other 60. Ids are coded in blocks of BLOCK; a block starts at a word of its own, so blocks decode
independently and all words of one selector decode in one array operation. An id of 2**60 - 1 or
more is escaped: a word of selector 15 with all payload bits set, then the id in a raw word.

A shard file is: MAGIC; the words of all blocks; the word offset of each block; doc_id, whether it
is null, and the number of ids of each document; then a footer of six 64-bit numbers. Documents
are in ascending doc_id order within a shard and from shard to shard.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm.common import batch, materialize, scratch_folder, steps, tidy
from marquee.llm.wordcache import WordCacheTokenizer

#: Fixed values of the format: ids in a word and bits of an id, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 4096
MAGIC = b"S8BSHARD"
_ESCAPE = np.uint64((1 << 60) - 1)
_GROUP = 256  # blocks that are coded or decoded together


def _bits(ids: np.ndarray) -> np.ndarray:
    high = (ids >> np.uint64(32)).astype(np.float64)
    low = (ids & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.uint8)


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks of ``ids`` (unsigned 64-bit), and the number of words of each block.

    Every word takes the longest run of ids that any selector fits; the blocks advance together,
    one word of each at a time.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    wide = BLOCK + int(COUNTS[0])
    padded = np.zeros((blocks, wide), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = ids
    padded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    padded = padded.reshape(-1)
    bits = _bits(padded)
    choice = np.full(len(padded), 15, np.uint8)
    for s in range(14, -1, -1):
        count, bad = int(COUNTS[s]), bits > WIDTHS[s]
        sums = np.zeros(len(bits) + 1, np.int32)
        np.cumsum(bad, out=sums[1:])
        fits = sums[count:] == sums[:-count]
        choice[: len(fits)][fits] = s
    lengths = np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
    at, end = np.arange(blocks) * wide, np.arange(blocks) * wide + lengths
    begins = np.zeros(len(padded), bool)
    while len(at):
        begins[at] = True
        at = at + COUNTS[choice[at]]
        going = at < end
        at, end = at[going], end[going]
    at = np.flatnonzero(begins)
    chosen = choice[at]
    words = np.zeros(len(at), np.uint64)
    for s in np.unique(chosen):
        rows, width, count = np.flatnonzero(chosen == s), int(WIDTHS[s]), int(COUNTS[s])
        word = np.full(len(rows), np.uint64(int(s) << 60))
        if width:
            values = padded[at[rows][:, None] + np.arange(count)]
            if s == 15:
                values = np.minimum(values, _ESCAPE)
            word |= np.bitwise_or.reduce(values << (np.arange(count) * width).astype(np.uint64), axis=1)
        words[rows] = word
    sizes = np.bincount(at // wide, minlength=blocks)
    escaped = np.flatnonzero((chosen == 15) & (padded[at] >= _ESCAPE))
    if len(escaped):
        sizes = sizes + np.bincount(at[escaped] // wide, minlength=blocks)
        words = np.insert(words, escaped + 1, padded[at[escaped]])
    return words, sizes


def decode_blocks(words: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of consecutive blocks with ``sizes`` words each."""
    raw = np.zeros(len(words), bool)
    full = np.uint64(15 << 60) | _ESCAPE
    if (words == full).any():  # a raw word may look like an escape itself
        for i in np.flatnonzero(words == full):
            if not raw[i]:
                raw[i + 1] = True
    code = np.flatnonzero(~raw)
    selector = (words[code] >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    block = np.repeat(np.arange(len(sizes)), sizes)[code]
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    first = np.searchsorted(block, np.arange(len(sizes)))
    place = block * (BLOCK + 240) + starts - starts[first][block]
    out = np.zeros(len(sizes) * (BLOCK + 240) + 240, np.uint64)
    for s in np.unique(selector):
        width, count = int(WIDTHS[s]), int(COUNTS[s])
        if not width:
            continue
        rows = np.flatnonzero(selector == s)
        mask = np.uint64((1 << width) - 1)
        values = (words[code[rows]][:, None] >> (np.arange(count) * width).astype(np.uint64)) & mask
        if s == 15:
            escaped = np.flatnonzero(words[code[rows]] == full)
            values[escaped, 0] = words[code[rows][escaped] + 1]
        out[place[rows][:, None] + np.arange(count)] = values
    return out[: len(sizes) * (BLOCK + 240)].reshape(len(sizes), BLOCK + 240)[:, :BLOCK].reshape(-1)[:n]


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


class ShardWriter:
    """Streams documents into one shard file. The file appears under its name when it is whole, so
    a task that dies or runs twice leaves no partial shard."""

    def __init__(self, path: str):
        self.fs, self.path = filesystem(path)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = self.n_words = 0
        self.sizes: list[np.ndarray] = []
        self.docs: list[tuple] = []

    def add(self, ids: np.ndarray, doc_ids: list, counts: np.ndarray) -> None:
        self.docs.append((np.array([0 if d is None else d for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8), counts.astype("<i8")))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= _GROUP * BLOCK:
            self._flush(self.n_waiting // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint64)
        for a in range(0, n, _GROUP * BLOCK):
            words, sizes = encode_blocks(ids[a : min(n, a + _GROUP * BLOCK)].astype(np.uint64))
            self.out.write(words.astype("<u8").tobytes())
            self.n_words += len(words)
            self.sizes.append(sizes)
        self.waiting, self.n_waiting = [ids[n:]], len(ids) - n

    def close(self) -> dict:
        self._flush(self.n_waiting)
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
        ids, null, counts = (np.concatenate([d[k] for d in self.docs]) if self.docs else np.zeros(0, np.int64) for k in range(3))
        self.out.write(np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes())
        self.out.write(ids.astype("<i8").tobytes() + null.astype(np.uint8).tobytes() + counts.astype("<i8").tobytes())
        self.out.write(np.array([self.n_words, len(sizes), len(ids), self.n_ids, BLOCK, 1], "<u8").tobytes())
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return {"n_docs": len(ids), "n_ids": self.n_ids}


def read_shard(path: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_ids, ids, counts so far) in pieces: the ids of a group of blocks with the pieces of
    documents that they hold, as (index of the document, ids)."""
    fs, path = filesystem(path)
    with fs.open_input_file(path) as f:
        size = f.size()
        n_words, n_blocks, n_docs, n_ids, block, _ = (int(x) for x in np.frombuffer(f.read_at(48, size - 48), "<u8"))
        if f.read_at(8, 0) != MAGIC or block != BLOCK:
            raise ValueError(f"{path} is not a shard of this format")
        at = 8 + 8 * n_words
        table = np.frombuffer(f.read_at(8 * (n_blocks + 1), at), "<u8").astype(np.int64)
        at += 8 * (n_blocks + 1)
        docs = np.frombuffer(f.read_at(8 * n_docs, at), "<i8")
        null = np.frombuffer(f.read_at(n_docs, at + 8 * n_docs), np.uint8)
        counts = np.frombuffer(f.read_at(8 * n_docs, at + 9 * n_docs), "<i8").astype(np.int64)
        yield docs, null, counts
        for b in range(0, n_blocks, _GROUP):
            e = min(n_blocks, b + _GROUP)
            words = np.frombuffer(f.read_at(int(8 * (table[e] - table[b])), int(8 + 8 * table[b])), "<u8")
            yield decode_blocks(words, np.diff(table[b : e + 1]), min(n_ids, e * BLOCK) - b * BLOCK)


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, keeps_space: bool, end_id: int) -> DataFrame:
    """Write the ids of every text, each followed by ``end_id``, as shards under ``path`` in
    ascending doc_id order. Returns the written manifest: shard, path, n_docs, n_ids, start.

    Nulls: a null text is empty (its end id alone), a null doc_id sorts first. Rows with the same
    doc_id stay, ordered by text. An empty table writes no shard. Other columns are not read.
    """
    spark = docs.sparkSession
    filesystem(path)[0].create_dir(filesystem(path)[1])
    schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer = None, None
        shard = TaskContext.get().partitionId()
        name = f"{path}/shard-{shard:07d}.s8b"
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                coder, writer = WordCacheTokenizer.of(tokenizer, keeps_space), ShardWriter(name)
            lengths = np.frombuffer(b.column(1).cast(pa.large_string()).buffers()[1], np.int64)[: b.num_rows + 1]
            for lo, hi in steps(lengths, 6 << 20):
                ids, offsets = coder.encode_ended(b.column(1).slice(lo, hi - lo), end_id)
                writer.add(ids, b.column(0).slice(lo, hi - lo).to_pylist(), np.diff(offsets))
        if writer is not None:
            done = writer.close()
            yield batch(schema, [[shard], [name], [done["n_docs"]], [done["n_ids"]]])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = materialize(ordered.mapInArrow(tidy(write), "shard long, path string, n_docs long, n_ids long"), "s8b-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the shard files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pieces = read_shard(path)
                docs, null, counts = next(pieces)
                ends = np.cumsum(counts)
                crc, doc, seen = np.zeros(len(docs), np.int64), 0, 0
                for ids in pieces:
                    data = memoryview(ids.astype("<u4").tobytes())
                    last = seen + len(ids)
                    while doc < len(docs):
                        a, e = max(seen, int(ends[doc] - counts[doc])), min(last, int(ends[doc]))
                        crc[doc] = zlib.crc32(data[4 * (a - seen) : 4 * (e - seen)], int(crc[doc]))
                        if ends[doc] > last:
                            break
                        doc += 1
                    seen = last
                if doc != len(docs) or seen != (ends[-1] if len(ends) else 0):
                    raise ValueError(f"{path} ends within a document")
                for a in range(0, len(docs), 10_000):
                    s = slice(a, a + 10_000)
                    yield batch(schema, [pa.array(docs[s], mask=null[s].astype(bool)), start + ends[s] - counts[s], counts[s], crc[s]])

    n = max(1, manifest.count())
    spread = manifest.select("path", "start").coalesce(1).repartition(n)  # a file for each task
    return spread.mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(spark: SparkSession, docs: DataFrame, tokenizer: str, keeps_space: bool, end_id: int) -> DataFrame:
    """Write shards to the shared folder and read them back."""
    out = scratch_folder(spark, "s8b")
    return read_token_shards(write_token_shards(docs, os.path.join(out, "shards"), tokenizer, keeps_space, end_id))
