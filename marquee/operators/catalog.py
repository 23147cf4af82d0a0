"""Listings: the star of events, venues and sources; lookups, integrity checks and append logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.functions.time import parse_rfc3339


def events_star(events: DataFrame, venues: DataFrame, sources: DataFrame) -> DataFrame:
    """Events with their venue's slug and their source, ordered by start and slug. Spark broadcasts
    a dimension where its size allows."""
    v = venues.select(F.col("id").alias("venue_id"), F.col("slug").alias("venue_slug"))
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("url").alias("source_url"))
    return events.join(v, "venue_id").join(s, "source_id").orderBy("start_at", "slug")


def events_for_venue(star: DataFrame, slug: str) -> DataFrame:
    return star.filter(F.col("venue_slug") == slug)


def by_slug(table: DataFrame, slug: str) -> DataFrame:
    return table.filter(F.col("slug") == slug).limit(1)


def ensure_source(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sources`` with the (name, url) of ``wanted`` that it lacks, ids going on from the largest."""
    return sources.unionByName(new_sources(sources, wanted, sources).select(sources.columns))


def new_sources(sources: DataFrame, wanted: DataFrame, numbered: DataFrame) -> DataFrame:
    """id, name and url of those of ``wanted`` that ``sources`` lacks; ids go on from those of ``numbered``."""
    return with_ids(wanted.select("name", "url").distinct().join(sources, ["name", "url"], "left_anti"), numbered)


def with_ids(rows: DataFrame, table: DataFrame, buckets: int = 1024) -> DataFrame:
    """``rows``, each distinct, with ids that go on without gaps from the largest of ``table``. Rows are
    numbered within hash buckets, and buckets by their counts, so no task orders all rows."""
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    tagged = rows.withColumn("_bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(buckets)))
    counts = tagged.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*rows.columns))
    placed = tagged.withColumn("_rank", rank).join(F.broadcast(before), "_bucket")
    return placed.select(*rows.columns, (F.col("_rank") + F.col("_before") + top.scalar()).cast("long").alias("id"))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def source_id(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(sources.select("id", "name", "url"), ["name", "url"], "left")


def dangling(table: DataFrame, column: str, parents: DataFrame, parent: str = "id", key: str = "id") -> DataFrame:
    """The first row, by ``key``, whose ``column`` no parent has."""
    p = parents.select(F.col(parent).alias(column))
    return table.join(p, column, "left_anti").orderBy(key).limit(1)


def row_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("n"))


def max_version(table: DataFrame, column: str = "version") -> DataFrame:
    return table.agg(F.coalesce(F.max(column), F.lit(0)).alias("version"))


def latest(log: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last version of each key of an append log: what an upsert would have left. Aggregates
    combine before the shuffle, so a key with a long history is no hot group."""
    others = [c for c in log.columns if c not in keys]
    row = F.max_by(F.struct(*others), F.col(version)).alias("row")
    return log.groupBy(*keys).agg(row).select(*keys, *(F.col(f"row.{c}").alias(c) for c in others))


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with created: whether their key was new to ``table``. Repeats of a key in the batch
    count once."""
    once = rows.dropDuplicates([key])
    known = table.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(True))
    return once.join(known, key, "left").withColumn("created", F.col("_known").isNull()).drop("_known")


def duplicates(table: DataFrame, *keys: str) -> DataFrame:
    """Keys that a unique index would refuse."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


#: What a store can have wrong, in the order in which it is told.
PROBLEMS = ("event without venue", "event without source", "malformed event time", "repeated venue slug", "repeated event slug")


def _flagged(events: DataFrame, venues: DataFrame, sources: DataFrame) -> DataFrame:
    """``events`` with _no_venue, _no_source and _no_time."""
    v = venues.select(F.col("id").alias("_venue")).distinct()
    s = sources.select(F.col("id").alias("_source")).distinct()
    joined = events.join(v, F.col("venue_id") == F.col("_venue"), "left").join(s, F.col("source_id") == F.col("_source"), "left")
    bad = lambda c: parse_rfc3339(F.col(c)).isNull()
    no_time = bad("start_at") | ((F.coalesce("end_at", F.lit("")) != "") & bad("end_at"))
    return joined.withColumns({"_no_venue": F.col("_venue").isNull(), "_no_source": F.col("_source").isNull(), "_no_time": no_time}).drop("_venue", "_source")


def store_report(events: DataFrame, venues: DataFrame, sources: DataFrame) -> DataFrame:
    """problem, n and first (an id or slug) of everything that is wrong with a store, in one job: one pass over
    the events with their parents, and counts by slug. Problems that there are none of have n 0."""
    flags = dict(zip(PROBLEMS, ("_no_venue", "_no_source", "_no_time")))
    sums = [F.struct(F.lit(p).alias("problem"), F.count_if(c).alias("n"), F.min(F.when(F.col(c), F.col("id"))).cast("string").alias("first")) for p, c in flags.items()]
    report = _flagged(events, venues, sources).agg(F.array(*sums).alias("found")).select(F.inline("found"))
    for problem, table in ((PROBLEMS[3], venues), (PROBLEMS[4], events)):
        report = report.unionByName(duplicates(table, "slug").agg(F.lit(problem).alias("problem"), F.count("*").alias("n"), F.min("slug").alias("first")))
    return report


def validate_store(events: DataFrame, venues: DataFrame, sources: DataFrame) -> list[str]:
    """What is wrong with a store: nothing, or dangling references, times that can't be read and repeated slugs."""
    wrong = {r.problem for r in store_report(events, venues, sources).filter("n > 0").collect()}
    return [p for p in PROBLEMS if p in wrong]


def write_events(events: DataFrame, venues: DataFrame, sources: DataFrame, path: str) -> dict[str, int]:
    """Writes ``events`` and returns how many there are and how many have each of the first three PROBLEMS,
    observed while they are written."""
    seen = Observation("events")
    flags = dict(zip(PROBLEMS, ("_no_venue", "_no_source", "_no_time")))
    counted = _flagged(events, venues, sources).observe(seen, F.count("*").alias("events"), *(F.count_if(c).alias(p) for p, c in flags.items()))
    counted.select(*events.columns).write.parquet(path)
    return seen.get


def valid_origin(x: Column) -> Column:
    return x.isin("seed", "test", "dev", "live")
