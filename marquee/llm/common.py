"""Helpers shared by the corpus operators: scratch tables, Arrow columns, byte-level words."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text that one vectorised step holds; a single longer text is a step of its own.
STEP_BYTES = 2 << 20
#: Bytes whose 64-bit prefix sums are held at once while words are hashed.
HASH_BYTES = 1 << 20

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset, a temporary folder serves
    local mode (tests), and the warehouse, which is shared as well, serves a cluster.
    """
    global _local_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="marquee-")
    return _local_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_paths: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()
_scopes: list[list[DataFrame | tuple[SparkSession, str]]] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted as the tables of materialize() are."""
    path = scratch_path(spark, name)
    if _scopes:
        _scopes[-1].append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost
    executor costs a reread instead of a recomputation. The table stays until discard(), or until
    the scratch_tables() around it end."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def discard(*tables: DataFrame | tuple[SparkSession, str]) -> None:
    """Delete tables of materialize(), or folders (with their session), that nothing reads any more."""
    for df in tables:
        if isinstance(df, tuple):
            delete_folder(*df)
            continue
        path = _paths.pop(df, None)
        if path is not None:
            delete_folder(df.sparkSession, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


@contextmanager
def scratch_tables() -> Iterator[None]:
    """Deletes the tables and folders that materialize() and scratch_folder() give within, at the end: what is to stay is written
    before by other means."""
    _scopes.append([])
    try:
        yield
    finally:
        discard(*_scopes.pop())


def materialized(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """materialize(make()), without the tables that ``make`` itself writes."""
    inner: list[DataFrame | tuple[SparkSession, str]] = []
    _scopes.append(inner)
    try:
        df = make()
        _scopes.pop()
        out = materialize(df, name)
    finally:
        if _scopes and _scopes[-1] is inner:
            _scopes.pop()
        discard(*inner)
    return out


def crc32_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def first_by_hash(rows: DataFrame, n: int, seed: int, by: str | None = None) -> DataFrame:
    """About ``n`` rows of ``rows``, or of each value of ``by``, and never more: those whose hash of
    doc_id is under n / count, with _h (the hash) and _r (their rank by it). All rows if there are fewer.

    The threshold is applied where rows are read, so only about n rows are shuffled and ranked. Counts
    are written first: Spark broadcasts them where their size, a row for each value, allows it.
    """
    h = F.xxhash64("doc_id", F.lit(seed))
    unit = (F.shiftrightunsigned("_h", 11) / F.lit(float(1 << 53))).alias("_unit")
    if by is None:
        total, counted = F.lit(max(1, rows.count())), rows
    else:
        sizes = materialize(rows.groupBy(by).agg(F.count("*").alias("_n")).withColumnRenamed(by, "_by"), "sizes")
        total, counted = F.col("_n"), rows.join(sizes, F.col(by) == F.col("_by"))
    picked = counted.withColumn("_h", h).filter(unit * total < n).select(*rows.columns, "_h")
    rank = F.row_number().over((Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy("_h", "doc_id"))
    return picked.withColumn("_r", rank).filter(F.col("_r") <= n)


def ranked(rows: DataFrame, order: list[Column | str], by: str | None = None, name: str = "ranked") -> DataFrame:
    """``rows`` with position (0, 1, ... by ``order``) in the whole table or in each value of ``by``,
    and size, the number of rows counted through.

    Rows are dealt over ranges of the order and written with the number of their range; a row's
    position is its place within the range plus the counts of the ranges before. So a value of ``by``
    that a third of all rows have is ranked by as many tasks as it fills, and no task orders a whole
    table. The order must tell all rows apart but for those that are equal. Nulls of ``by`` are one value.
    """
    group = [by] if by else []
    dealt = materialize(rows.orderBy(*group, *order).withColumn("_range", F.spark_partition_id()), name)
    counts = dealt.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*group) if by else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(c).alias(f"_g{c}") for c in group), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("size"))
    same = F.col("_range") == F.col("_r")
    if by:
        same = same & F.col(by).eqNullSafe(F.col(f"_g{by}"))
    local = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)) - 1
    placed = dealt.withColumn("_local", local).join(starts, same)
    return placed.select(*rows.columns, (F.col("_before") + F.col("_local")).alias("position"), "size")


def text_key(column: str = "text") -> Column:
    """With doc_id, the identity of a row: rows that repeat entirely count as one document."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def with_identity(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns of ``docs``), own_id and own_key, so that helper columns clash
    with none that ``docs`` has."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("own_id"), text_key().alias("own_key"))


def same_row(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> Column:
    """Null-safe equality of the key columns."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def string_parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty string."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    if array.null_count:
        array = pc.fill_null(array, "")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES):
    """Ranges (lo, hi) of rows of about ``limit`` bytes; at least one row each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2**64, of the hash base and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def byte_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; no run crosses a row."""
    inside = is_word[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = before.copy()
    before, after = before[:-1], after[1:]
    first, last = inside & ~before, np.zeros(len(data), bool)
    last[:-1] = inside[:-1] & ~after[1:]
    if len(data):
        last[-1] = inside[-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range; the ranges ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + HASH_BYTES, side="right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        p, q = powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * p[: hi - lo], out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((sums[e] - sums[s]) * q[s] + (e - s).astype(np.uint64))
        a = b
    return out


def tidy(f: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f``, and at its end memory that it freed goes back to the system: Python workers are used
    again by other tasks, and share the executor's memory with them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
