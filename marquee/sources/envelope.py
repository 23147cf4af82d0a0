"""Captured bodies in hashed JSON envelopes; marquee.operators.replay reads runs back from them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.text import same_word, trim
from marquee.store.place import opened

VERSION = 1
MAX_BODY = 2 << 20
METADATA = "struct<url: string, final_url: string, status: string, status_code: int, content_type: string, content_length: long, body_bytes: int, captured_at: string>"
ENVELOPE = f"struct<version: int, metadata: {METADATA}, sha256: string, truncated: boolean, body_base64: string>"


def land(rows: DataFrame, folder: str) -> list[str]:
    """Writes content (binary) of ``rows`` as a file each, and returns the folders that hold them, one for each task.
    A file's name ends in ``name``, a string without slashes, after a number, so names may repeat. The folder of
    a task that failed or ran twice is not among those returned. Without rows it is one empty folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        own, n = uuid.uuid4().hex, 0
        for b in batches:
            if not n:
                system.create_dir(f"{path}/{own}", recursive=True)
            for name, content in zip(b.column("name").to_pylist(), b.column("content")):
                with system.open_output_stream(f"{path}/{own}/{n}-{name}", buffer_size=0) as out:
                    out.write(content.as_buffer())
                n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"folder": [own]})

    told = rows.select("name", "content").mapInArrow(write, "folder string").collect()
    if not told:
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
    return sorted(f"{folder}/{r.folder}" for r in told) or [folder]


def landed_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """url (the file's path) and content of the files in a folder or glob, or in several, calendars and pages alike."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), "content")


def capture(files: DataFrame, limit: int = MAX_BODY) -> DataFrame:
    """body and truncated of rows with content (as spark.read.format("binaryFile") gives them)."""
    return files.withColumn("truncated", F.length("content") > limit).withColumn("body", F.substring("content", 1, limit)).drop("content")


def seal(rows: DataFrame) -> DataFrame:
    """``rows`` with payload: the envelope, as JSON, of body, truncated and the metadata columns."""
    names = ("url", "final_url", "status", "status_code", "content_type", "content_length", "captured_at")
    metadata = F.struct(*(F.col(n) for n in names[:-1]), F.length("body").alias("body_bytes"), F.col("captured_at"))
    plain = F.regexp_replace(F.base64("body"), r"[\r\n]", "")
    return rows.withColumn("payload", F.to_json(F.struct(F.lit(VERSION).alias("version"), metadata.alias("metadata"), F.sha2("body", 256).alias("sha256"), F.col("truncated"), plain.alias("body_base64"))))


def unseal(snapshots: DataFrame) -> DataFrame:
    """``snapshots`` with metadata, truncated, body and error (null if the envelope is whole)."""
    e = snapshots.withColumn("e", F.from_json("payload", ENVELOPE)).withColumn("body", F.try_to_binary(F.col("e.body_base64"), F.lit("base64")))
    error = (
        F.when(F.col("e").isNull() | F.col("e.version").isNull(), "malformed envelope")
        .when(F.col("e.version") != VERSION, "unsupported version")
        .when(F.col("body").isNull(), "malformed body")
        .when(F.sha2("body", 256) != F.trim(F.coalesce("e.sha256", F.lit(""))), "hash mismatch")
    )
    return e.select(*snapshots.columns, F.col("e.metadata").alias("metadata"), F.col("e.truncated").alias("truncated"), "body", error.alias("error"))


def run_detail(snapshots: DataFrame) -> DataFrame:
    """Metadata of envelopes alone: bodies are never read out of the payload."""
    e = snapshots.withColumn("e", F.from_json("payload", f"struct<version: int, metadata: {METADATA}, truncated: boolean>"))
    known = F.coalesce(F.col("e.version") == VERSION, F.lit(False))
    status = F.coalesce(F.nullif(F.col("e.metadata.status"), F.lit("")), F.col("e.metadata.status_code").cast("string"), F.lit(""))
    return e.select(*(c for c in snapshots.columns if c != "payload"), F.when(known, F.col("e.metadata")).alias("metadata"), F.when(known, status).otherwise("Metadata unavailable").alias("status_label"))


def replayable(runs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Run id and why it can't be replayed (null if it can)."""
    n = snapshots.groupBy(F.col("import_run_id").alias("id")).agg(F.count("*").alias("n"))
    error = F.when(F.col("finished_at").isNull(), "unfinished").when(~same_word(trim(F.col("status")), "succeeded"), "not succeeded").when(F.col("n").isNull(), "no snapshots")
    return runs.join(n, "id", "left").select("id", error.alias("error"))
