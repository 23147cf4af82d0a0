"""Counts kept as rows come and go: snapshots by run, candidates and drafted fields by group, statuses by run.

Each count is a table of the versioned store. A batch of rows with ``d`` (1 for a row that came, -1 for one that
went) is summed by key, and only the buckets of its keys are read and written. A distinct count keeps the count
of every key beside it: what changes it are the keys that the batch takes from none to some, or back. After any
batches the tables equal the full queries over the rows that are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.text import origin_run_id, trim
from marquee.operators.reviews import names_run, status_text
from marquee.store.place import written
from marquee.store.versioned import Kind, Store, Transaction, transact

TABLES = {
    "snapshot_counts": Kind(("run_id",), "run_id"),
    "candidate_counts": Kind(("group_id",), "group_id"),
    "field_counts": Kind(("group_id", "field"), "group_id"),
    "draft_counts": Kind(("group_id",), "group_id"),
    "status_counts": Kind(("run_id", "status"), "run_id"),
}
_SCHEMAS = {"snapshot_counts": "run_id long, n long", "candidate_counts": "group_id long, n long", "field_counts": "group_id long, field string, n long", "draft_counts": "group_id long, n long", "status_counts": "run_id long, status string, n long"}


def open_counts(spark: SparkSession, root: str, buckets: int = 64) -> Store:
    """A new store of counts, all of them zero."""
    store = Store(spark, root, TABLES, buckets)
    store.create({name: spark.createDataFrame([], schema) for name, schema in _SCHEMAS.items()})
    return store


def _moved(transaction: Transaction, name: str, deltas: DataFrame) -> DataFrame:
    """The counts that ``deltas`` (the key and d) change: the key, n, was and _deleted. Null keys count nothing."""
    keys = list(TABLES[name].key)
    sums = deltas.dropna(subset=keys).groupBy(*keys).agg(F.sum("d").cast("long").alias("_d")).filter("_d != 0")
    sums = written(sums, name)
    old = transaction.rows(name, sums.select(TABLES[name].by)).withColumnRenamed("n", "was")
    joined = sums.join(old, keys, "left").withColumn("was", F.coalesce("was", F.lit(0)))
    return joined.select(*keys, (F.col("was") + F.col("_d")).alias("n"), "was").withColumn("_deleted", F.col("n") == 0)


def count_snapshots(store: Store, changes: DataFrame) -> int:
    """``changes``: import_run_id and d of snapshots that came or went."""
    own = changes.select(F.col("import_run_id").alias("run_id"), "d")
    return transact(store, lambda t: {"snapshot_counts": _moved(t, "snapshot_counts", own).drop("was")})


def count_candidates(store: Store, changes: DataFrame) -> int:
    """``changes``: group_id and d of candidates."""
    return transact(store, lambda t: {"candidate_counts": _moved(t, "candidate_counts", changes.select("group_id", "d")).drop("was")})


def count_choices(store: Store, changes: DataFrame) -> int:
    """``changes``: group_id, field and d of choices; a group's drafted fields are counted once each."""

    def batch(t: Transaction) -> dict[str, DataFrame]:
        fields = written(_moved(t, "field_counts", changes.select("group_id", "field", "d")), "fields")
        crossed = (F.col("n") > 0).cast("long") - (F.col("was") > 0).cast("long")
        drafts = _moved(t, "draft_counts", fields.select("group_id", crossed.alias("d")))
        return {"field_counts": fields.drop("was"), "draft_counts": drafts.drop("was")}

    return transact(store, batch)


def count_groups(store: Store, changes: DataFrame) -> int:
    """``changes``: notes, status and d of review groups; one whose status changes goes and comes."""
    run = origin_run_id(F.col("notes"))
    own = changes.withColumn("run_id", run).filter(names_run(F.col("notes"), F.col("run_id")))
    status = F.when(trim(F.col("status")) == "", "unknown").otherwise(trim(F.col("status")))
    own = own.select("run_id", status.alias("status"), "d")
    return transact(store, lambda t: {"status_counts": _moved(t, "status_counts", own).drop("was")})


def _joined(rows: DataFrame, counts: DataFrame, key: str, name: str) -> DataFrame:
    c = counts.select(F.col(key).alias("_key"), F.col("n").alias(name))
    return rows.join(c, rows["id"] == F.col("_key"), "left").drop("_key").fillna(0, [name])


def runs_with_counts(store: Store, runs: DataFrame) -> DataFrame:
    """As runs.with_snapshot_count(), from the counts."""
    return _joined(runs, store.rows("snapshot_counts", store.manifest()), "run_id", "snapshot_count")


def groups_with_counts(store: Store, groups: DataFrame) -> DataFrame:
    """As reviews.with_counts(), from the counts."""
    now = store.manifest()
    counted = _joined(groups, store.rows("candidate_counts", now), "group_id", "candidate_count")
    return _joined(counted, store.rows("draft_counts", now), "group_id", "draft_count")


def status_summary(store: Store, runs: DataFrame) -> DataFrame:
    """As reviews.status_summary(), from the counts."""
    per = status_text(store.rows("status_counts", store.manifest()))
    return runs.join(per, runs["id"] == per["run_id"], "left").drop("run_id").fillna("none", ["summary"])
