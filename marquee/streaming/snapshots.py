"""Extension: captured calendars as a stream, staged as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marquee.sources.envelope import ENVELOPE, unseal
from marquee.sources.extract import ics_candidates

SNAPSHOTS = "id long, import_run_id long, source_id long, captured_at string, payload string"


def snapshot_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SNAPSHOTS).parquet(path)


def captured_per_window(snapshots: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """How many envelopes each window of capture time has; later ones than ``late`` are left out."""
    at = F.try_to_timestamp("captured_at").alias("at")
    e = snapshots.select(at, F.from_json("payload", ENVELOPE)["truncated"].alias("truncated"))
    return e.withWatermark("at", late).groupBy(F.window("at", window).alias("window")).agg(F.count("*").alias("n"), F.count_if("truncated").alias("truncated"))


def stage_candidates(snapshots: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the candidates, skips and errors of each new envelope to ``out``, once each."""

    def stage(batch: DataFrame, epoch: int) -> None:
        good = unseal(batch).filter("error is null").select(F.col("metadata.url").alias("url"), "body")
        ics_candidates(good).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return snapshots.writeStream.foreachBatch(stage).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
