"""Captured bodies on a shelf: decoded once, bucketed by snapshot, and fetched late.

What runs are judged by, and what links are looked up in, are the heads of the snapshots: all columns but
the body, which Parquet reads without it. Bodies are joined by snapshot id when all else is settled. The
table is bucketed by that id, so the join moves the few ids to the bodies' buckets and no body at all.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.sources.envelope import unseal
from marquee.store.place import new_path

#: Buckets of a shelf. A bucket is read by one task, so a store of 100 TB takes some tens of thousands.
BUCKETS = 32


class Shelf(NamedTuple):
    """heads: all columns of the snapshots but payload, with metadata, truncated and error; bodies: id, body."""

    heads: DataFrame
    bodies: DataFrame


def split(decoded: DataFrame) -> Shelf:
    return Shelf(decoded.drop("body"), decoded.select("id", "body"))


def unsealed(snapshots: DataFrame) -> Shelf:
    """The shelf of ``snapshots`` (id, payload and others) as they are, decoded whenever it is read."""
    decoded = unseal(snapshots)
    return split(decoded.drop("payload"))


def shelve(snapshots: DataFrame, table: str, buckets: int = BUCKETS) -> Shelf:
    """``snapshots`` (id, payload and others) decoded, hashed and written once, as the table ``table``
    of the session's catalog. Bodies of broken envelopes are written as they are; their heads say so."""
    spark = snapshots.sparkSession
    decoded = unseal(snapshots).drop("payload").repartition(buckets, "id")
    decoded.write.bucketBy(buckets, "id").sortBy("id").option("path", new_path(spark, table)).saveAsTable(table)
    return open_shelf(spark, table)


def open_shelf(spark: SparkSession, table: str) -> Shelf:
    return split(spark.table(table))


def with_bodies(rows: DataFrame, snapshot: str, bodies: DataFrame, name: str = "body", outer: bool = False) -> DataFrame:
    """``rows`` with the body of the snapshot that their column ``snapshot`` names; with ``outer`` also those
    that name none, or one without a body. Rows without a snapshot are dealt over all buckets."""
    b = bodies.select(F.col("id").alias("_body_id"), F.col("body").alias(name))
    own = F.col(snapshot)
    if not outer:
        return rows.join(b, own == F.col("_body_id")).drop("_body_id")
    nobody = -1 - F.pmod(F.xxhash64(*(c for c, kind in rows.dtypes if not kind.startswith("map"))), F.lit(1 << 40))
    keyed = rows.withColumn("_snapshot_key", F.coalesce(own, nobody))
    return keyed.join(b, (F.col("_snapshot_key") == F.col("_body_id")) & own.isNotNull(), "left").drop("_body_id", "_snapshot_key")
