"""From the candidates of a run to review groups with stable keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.functions.text import candidate_fingerprint, collapse, first_non_empty, folded, staging_key, trim, venue_slug
from marquee.operators.catalog import with_ids

CONTENT = ("external_id", "name", "venue_slug", "start_at", "end_at", "genre", "status", "description")


def cluster_key(uid: Column, summary: Column, start_at: Column, location: Column) -> Column:
    """The UID if there is one, else title, start and venue; null without a title or start."""
    title, start = folded(summary), trim(start_at)
    fallback = F.when((title != "") & (start != ""), F.concat_ws("\0", F.lit("fallback"), title, start, venue_slug(location)))
    return F.when(trim(uid) != "", F.concat(F.lit("uid\0"), trim(uid))).otherwise(fallback)


def projected(rows: DataFrame) -> DataFrame:
    """Run candidates (run_id, calendar and candidate ordinals, calendar_url, report_url,
    source_name and the extracted fields) as review candidates."""
    status = F.when(F.upper(trim(F.col("status"))) == "CONFIRMED", "Listed").otherwise(trim(F.col("status")))
    origin = F.when(F.col("uid") != "", F.concat(F.lit("UID "), "uid")).when(F.col("url") != "", F.concat(F.lit("URL "), "url"))
    run = F.when(F.col("run_id") != 0, F.concat(F.lit("import run "), F.col("run_id").cast("string")))
    calendar = F.when(F.col("calendar_url") != "", F.concat(F.lit("calendar "), "calendar_url"))
    told = F.concat_ws("; ", run, calendar, origin)
    return rows.select(
        "run_id",
        "calendar",
        "candidate",
        cluster_key(F.col("uid"), F.col("summary"), F.col("start_at"), F.col("location")).alias("key"),
        trim(F.col("uid")).alias("external_id"),
        trim(F.col("summary")).alias("name"),
        venue_slug(F.col("location")).alias("venue_slug"),
        trim(F.col("start_at")).alias("start_at"),
        trim(F.col("end_at")).alias("end_at"),
        F.lit("").alias("genre"),
        status.alias("status"),
        trim(F.col("description")).alias("description"),
        "source_name",
        first_non_empty(F.col("url"), F.col("calendar_url"), F.col("report_url")).alias("source_url"),
        F.when(told == "", "manual ingest").otherwise(told).alias("provenance"),
        first_non_empty(F.col("calendar_url"), F.col("report_url")).alias("group_url"),
    )


def members(rows: DataFrame) -> DataFrame:
    """projected() rows that have a key, with fingerprint and their 1-based position in the cluster."""
    p = projected(rows).filter("key is not null").withColumn("fingerprint", candidate_fingerprint(*map(F.col, CONTENT)))
    order = Window.partitionBy("run_id", "key").orderBy("calendar", "candidate")
    return p.withColumn("position", F.row_number().over(order))


def clustered(rows: DataFrame) -> DataFrame:
    """run_id, ordinal, key, title, source_name, source_url, notes, n_candidates and staging_key of each
    cluster, the clusters of a run in order of their first candidate. members() has the candidates.

    Of the candidates only fingerprints are gathered, which the key is made of; the rest are minima.
    """
    p = projected(rows).filter("key is not null").withColumn("fingerprint", candidate_fingerprint(*map(F.col, CONTENT)))
    shown = collapse(F.col("name"))
    at = (F.col("calendar"), F.col("candidate"))
    groups = p.groupBy("run_id", "key").agg(
        F.min(F.struct(*at, "source_name", "group_url")).alias("first"),
        F.min(F.when(shown != "", F.struct(*at, shown.alias("name"))))["name"].alias("shown"),
        F.count("*").alias("n_candidates"),
        staging_key(F.collect_list("fingerprint")).alias("staging_key"),
    )
    prefix = F.when(F.col("n_candidates") == 1, "New listing review").otherwise("Duplicate review")
    notes = F.when(F.col("run_id") == 0, "Created from manual ingest review staging.").otherwise(F.concat(F.lit("Created from manual ingest run "), F.col("run_id").cast("string"), F.lit(" review staging.")))
    return groups.select(
        "run_id",
        F.struct(F.col("first.calendar").alias("calendar"), F.col("first.candidate").alias("candidate")).alias("ordinal"),
        "key",
        F.concat_ws(": ", prefix, "shown").alias("title"),
        F.col("first.source_name").alias("source_name"),
        F.col("first.group_url").alias("source_url"),
        notes.alias("notes"),
        "n_candidates",
        "staging_key",
    ).orderBy("run_id", "ordinal")


def source_error() -> Column:
    return F.when(trim(F.col("source_name")) == "", "review source name is required").when(trim(F.col("source_url")) == "", "review source URL is required")


def key_id(key: Column) -> Column:
    """An id that a staging key gives by itself, whoever stages it: 60 bits of its hash. Of a billion groups
    two have the same with a probability of 0.4; catalog.duplicates() tells."""
    return F.conv(F.substring(F.sha2(F.coalesce(key, F.lit("")), 256), 1, 15), 16, 10).cast("long")


def staged(groups: DataFrame, clusters: DataFrame, ids_by_key: bool = False) -> DataFrame:
    """``clusters`` (as clustered() gives them) with id, result (created or reused) and error.

    A staging key that ``groups`` (id, staging_key) has, whatever the group's status, is reused, and so
    is one that an earlier cluster of the batch creates. A blank source is an error and gets no id. New ids
    go on from the largest or, with ``ids_by_key``, come from the staging key.
    """
    told = clusters.withColumn("error", source_error())
    first = Window.partitionBy("staging_key").orderBy("run_id", "ordinal")
    good = told.filter("error is null").withColumn("nth", F.row_number().over(first))
    own = groups.filter("staging_key is not null").groupBy("staging_key").agg(F.min("id").alias("own_id"))
    fresh = good.filter("nth = 1").select("staging_key").join(own, "staging_key", "left_anti")
    made = fresh.withColumn("new_id", key_id(F.col("staging_key"))) if ids_by_key else with_ids(fresh, groups).withColumnRenamed("id", "new_id")
    known = good.join(own, "staging_key", "left").join(made, "staging_key", "left")
    result = F.when(F.col("own_id").isNull() & (F.col("nth") == 1), "created").otherwise("reused")
    out = known.select(*clusters.columns, F.coalesce("own_id", "new_id").alias("id"), result.alias("result"), "error")
    none = told.filter("error is not null").select(*clusters.columns, F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("result"), "error")
    return out.unionByName(none)


def stage_totals(staged_groups: DataFrame) -> DataFrame:
    """run_id, groups_created, groups_reused, candidate_count, errors of staged()'s rows."""
    return staged_groups.groupBy("run_id").agg(F.count_if(F.col("result") == "created").alias("groups_created"), F.count_if(F.col("result") == "reused").alias("groups_reused"), F.sum("n_candidates").alias("candidate_count"), F.count("error").alias("errors"))


def new_groups(staged_groups: DataFrame, now: Column) -> DataFrame:
    """The rows that created groups add to the table of groups."""
    made = staged_groups.filter("result = 'created'")
    title = F.when(trim(F.col("title")) == "", "Review group").otherwise(trim(F.col("title")))
    return made.select("id", title.alias("title"), trim(F.col("source_name")).alias("source_name"), trim(F.col("source_url")).alias("source_url"), F.lit("open").alias("status"), "notes", now.alias("created_at"), now.alias("updated_at"), "staging_key")


def fixture_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """fixture_group() for each of many calendar files at once: ``rows`` are candidates with ``path`` and
    ``candidate``. Groups by path, and candidates with their path and position. Files without one have none."""
    url = F.concat(F.lit("file:"), "path")
    group = rows.groupBy("path").agg(F.count("*").alias("n_candidates")).select("path", F.concat(F.lit("Fixture review: "), F.regexp_extract("path", "[^/]*$", 0)).alias("title"), F.lit("Fixture ICS").alias("source_name"), url.alias("source_url"), F.lit("Created from offline fixture.").alias("notes"), "n_candidates")
    base = rows.withColumns({"run_id": F.lit(0).cast("long"), "calendar": F.col("path"), "calendar_url": url, "report_url": url, "source_name": F.lit("Fixture ICS")})
    own = projected(base).withColumnRenamed("calendar", "path")
    told = F.when(F.col("external_id") != "", F.concat(F.lit("fixture UID "), "external_id")).when(F.col("source_url") != F.concat(F.lit("file:"), "path"), F.concat(F.lit("fixture URL "), "source_url")).otherwise("fixture ICS")
    placed = own.withColumn("provenance", told).withColumn("position", F.row_number().over(Window.partitionBy("path").orderBy("candidate")))
    return group, placed.drop("run_id", "key", "candidate", "group_url")


def fixture_group(rows: DataFrame, path: str, title: str = "") -> tuple[DataFrame, DataFrame]:
    """All candidates of a calendar file (the extracted fields and ``candidate``, their order) as one
    group: the group and its candidates. Raises ValueError if there is none."""
    if rows.isEmpty():
        raise ValueError("at least one review candidate is required")
    spark, url = rows.sparkSession, f"file:{path}"
    name = title if title.strip() else f"Fixture review: {path.rsplit('/', 1)[-1]}"
    group = spark.createDataFrame([(name, "Fixture ICS", url, "Created from offline fixture.")], "title string, source_name string, source_url string, notes string")
    base = rows.withColumns({"run_id": F.lit(0).cast("long"), "calendar": F.lit(0), "calendar_url": F.lit(url), "report_url": F.lit(url), "source_name": F.lit("Fixture ICS")})
    told = F.when(F.col("external_id") != "", F.concat(F.lit("fixture UID "), "external_id")).when(F.col("source_url") != url, F.concat(F.lit("fixture URL "), "source_url")).otherwise("fixture ICS")
    own = projected(base).withColumn("provenance", told).withColumn("position", F.row_number().over(Window.orderBy("candidate")))  # one file's rows
    return group, own.drop("run_id", "key", "calendar", "candidate", "group_url")
