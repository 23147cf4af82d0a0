"""Runs over captured bodies: from landed files, and replayed from stored envelopes.

Both give a Report: ``lines`` has a row for each calendar of a run and each candidate, skip and
error in it, ``runs`` the totals, status and notes of each run. Bodies are parsed once, in one pass
after the join of links with bodies; what follows are aggregates by calendar and by run. Runs over files whose lines
nobody keeps count them where they are parsed. A replay judges
runs and finds the snapshots of links by their heads, and fetches bodies from the shelf last of all.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import first_non_empty, trim
from marquee.operators import runs as run_ops
from marquee.operators.staging import clustered
from marquee.sources.envelope import replayable, seal
from marquee.sources.extract import calendar_counts, calendar_rows, source_page_counts, source_page_rows
from marquee.store.shelf import Shelf, unsealed, with_bodies

#: What a run without a usable calendar says, by page mode.
UNUSABLE = {"linked_ics": "no ICS calendars parsed successfully", "source_page": "no listings parsed successfully"}
NO_LINKS = "no ICS links found"


class Report(NamedTuple):
    """runs: run_id, source, source_url, links, snapshots, candidates, skips, errors, status, notes,
    refused (why a replay gives nothing, else null). lines: run_id, calendar (ordinal), snapshot_id,
    kind (calendar, candidate, skip, error, failure), ordinal and the extracted fields."""

    runs: DataFrame
    lines: DataFrame


def _trouble(what: str, truncated: Column, code: Column) -> Column:
    http = F.concat(F.lit(f"{what} returned HTTP "), F.coalesce(code.cast("string"), F.lit("0")))
    name = F.lit(f"{what} response was truncated")
    return F.when(truncated, name).when(~F.coalesce(run_ops.http_ok(code), F.lit(False)), http)


def _answered(rows: DataFrame, answers: DataFrame, bodies: DataFrame | None, on: list[str], missing: str) -> DataFrame:
    """``rows`` of pages, links with what answers them (see parsed_lines()): _body, trouble, snapshot_id and calendar."""
    own = [F.col("body").alias("_body")] if bodies is None else []
    b = answers.select(*(F.col(c).alias(f"_{c}") for c in on), F.col("snapshot_id").alias("_snapshot"), "truncated", "status_code", *own)
    # Rows that are no link have a key of their own: nulls, and addresses that many share, would meet in one task.
    alone = F.concat(F.lit("\0"), F.xxhash64(*(c for c, _ in rows.dtypes)).cast("string"))
    rows = rows.withColumn("_key", F.when(F.col("kind") == "link", trim(F.col("url"))).otherwise(alone))
    link = F.col("_link") == F.col("_key")
    same = (F.col("kind") == "link") & (link & (F.col("_run_id") == F.col("run_id")) if "run_id" in on else link)
    # bodies are much larger in memory than their files say, so they are not broadcast
    joined = rows.join(b.hint("merge") if own else b, same, "left").drop("_key")
    if bodies is not None:
        joined = with_bodies(joined, "_snapshot", bodies, "_body", outer=True)
    is_link = F.col("kind") == "link"
    trouble = F.when(is_link, F.when(F.col("_body").isNull(), missing).otherwise(_trouble("ICS", F.col("truncated"), F.col("status_code"))))
    snapshot = F.when(is_link, F.col("_snapshot")).otherwise(F.col("page_snapshot"))
    return joined.withColumn("trouble", trouble).withColumn("snapshot_id", snapshot).withColumn("calendar", F.when(is_link, F.col("ordinal")).otherwise(0))


def parsed_lines(pages: DataFrame, answers: DataFrame, bodies: DataFrame | None, on: list[str], limit: int, missing: str) -> DataFrame:
    """The lines of ``pages`` (run_id, page_mode, page_url, page_snapshot, body; those that can be
    read). ``answers``: the columns ``on`` (link, and run_id if each run has its own), snapshot_id,
    truncated and status_code, and their body unless ``bodies`` (id, body) has it under snapshot_id. A
    link without a body is a calendar with the error ``missing``."""
    return calendar_rows(_answered(source_page_rows(pages, ("run_id", "page_snapshot"), limit), answers, bodies, on, missing))


def counted_calendars(pages: DataFrame, answers: DataFrame, bodies: DataFrame | None, on: list[str], limit: int, missing: str) -> DataFrame:
    """calendars() of parsed_lines(), counted where bodies are parsed: a calendar is one row from there on, and one
    shuffle by run serves the sums by calendar and by run."""
    rows = calendar_counts(_answered(source_page_counts(pages, ("run_id", "page_snapshot"), limit), answers, bodies, on, missing))
    ordinal = F.when(F.col("kind") == "failure", -1).otherwise(F.col("calendar")).cast("long")
    return rows.repartition("run_id").groupBy("run_id", ordinal.alias("ordinal")).agg(
        F.max(F.when(F.col("kind") == "calendar", F.col("url"))).alias("url"),
        F.bool_or(F.col("snapshot_id").isNotNull()).alias("has_snapshot"),
        *(F.sum(c).alias(c) for c in ("candidates", "skips", "errors")),
        F.min(F.when(F.col("errors") > 0, F.struct("first", "reason")))["reason"].alias("first_error"),
    )


def calendars(lines: DataFrame) -> DataFrame:
    """run_id, ordinal, url, has_snapshot, candidates, skips, errors (counts) and first_error of each
    calendar. A failure of the run is a row with ordinal -1."""
    bad = F.col("kind").isin("error", "failure") | ((F.col("kind") == "calendar") & F.col("reason").isNotNull())
    ordinal = F.when(F.col("kind") == "failure", -1).otherwise(F.col("calendar")).cast("long")
    first = F.min(F.when(bad, F.struct("ordinal", "reason")))["reason"]
    return lines.groupBy("run_id", ordinal.alias("_calendar")).agg(
        F.max(F.when(F.col("kind") == "calendar", F.col("url"))).alias("url"),
        F.bool_or(F.col("snapshot_id").isNotNull()).alias("has_snapshot"),
        F.count_if(F.col("kind") == "candidate").alias("candidates"),
        F.count_if(F.col("kind") == "skip").alias("skips"),
        F.count_if(bad).alias("errors"),
        first.alias("first_error"),
    ).withColumnRenamed("_calendar", "ordinal")


def summarised(pages: DataFrame, found: DataFrame, replaying: bool) -> DataFrame:
    """run_id, source, source_url, links, snapshots, candidates, skips, errors, status, notes and
    missing (calendars without a snapshot) of each of ``pages`` (run_id, source, source_url, page_mode,
    trouble, stored), whose calendars() are ``found``. A run over files that has no page to read or no link in it ends there; a
    replay also says that no calendar is usable. One chain of aggregates, so bodies are parsed once."""
    own = F.col("ordinal") >= 0
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    per = found.groupBy("run_id").agg(
        F.count_if(own).alias("n"),
        F.count_if(own & F.col("has_snapshot")).alias("with_snapshot"),
        F.bool_or(run_ops.usable()).alias("usable"),
        *(F.sum(F.when(own, F.col(c))).alias(f"c_{c}") for c in ("candidates", "skips", "errors")),
        F.collect_list(F.when(~own, F.col("first_error"))).alias("failures"),
        F.collect_list(F.when(own, run_ops.error_line())).alias("lines"),
    )
    joined = pages.join(per, "run_id", "left")
    joined = joined.withColumns({"failures": F.coalesce("failures", F.array().cast("array<string>")), "lines": F.coalesce("lines", F.array().cast("array<struct<ordinal: long, line: string>>"))})
    linked = F.col("page_mode") == "linked_ics"
    readable = F.col("trouble").isNull() & (F.size("failures") == 0)
    links = F.when(linked, zero("n")).otherwise(0)
    none = readable & linked & (links == 0)
    unusable = F.when(linked, UNUSABLE["linked_ics"]).otherwise(UNUSABLE["source_page"])
    says = ~F.coalesce("usable", F.lit(False)) & (F.lit(True) if replaying else readable & ~none)
    told = F.array(F.col("trouble"), F.when(none, NO_LINKS), F.when(says, unusable))
    base = joined.withColumn("told", F.filter(F.concat("failures", told), lambda x: x.isNotNull()))
    counts = {"links": links, "candidates": zero("c_candidates"), "skips": zero("c_skips"), "errors": F.size("told") + zero("c_errors")}
    stored = F.col("stored").cast("long") + F.when(linked, zero("with_snapshot")).otherwise(0)
    missing = F.when(linked, zero("n") - zero("with_snapshot")).otherwise(0)
    return base.select(
        "run_id",
        "source",
        "source_url",
        stored.alias("snapshots"),
        *(n.cast("long").alias(c) for c, n in counts.items()),
        run_ops.status_of(counts["errors"], F.col("usable")).alias("status"),
        run_ops.notes_of(counts, F.col("told"), F.col("lines")).alias("notes"),
        missing.alias("missing"),
    )


def replay(runs: DataFrame, snapshots: DataFrame | Shelf, registry: DataFrame, limit: int, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Report:
    """Replays every run of ``runs`` (id, finished_at, status) from its ``snapshots`` (id,
    import_run_id, source_name, source_url, captured_at, payload) or, with less to do, from a shelf of
    them. Writes nothing.

    A run is refused if it is unfinished, not succeeded or without snapshots, if any of its envelopes
    is broken, if it has not exactly one page snapshot of a source in ``registry``, if two snapshots
    answer to one address, or if a link has no snapshot. ``keep`` is given the lines, and may write
    them and read them back or persist them, for callers who use both parts of the report.
    """
    limit = run_ops.run_limit(limit, replay=True)
    shelf = snapshots if isinstance(snapshots, Shelf) else unsealed(snapshots)
    guard = replayable(runs, shelf.heads).withColumnRenamed("id", "run_id")
    heads = shelf.heads.withColumnRenamed("import_run_id", "run_id")
    r = registry.select("key", F.col("name").alias("_name"), F.col("url").alias("_url"), "page_mode")
    match = (trim(F.col("source_name")) == F.col("_name")) & (trim(F.col("source_url")) == F.col("_url")) & (trim(F.col("metadata.url")) == F.col("_url"))
    known = heads.join(r, match, "left")
    keys = F.array_distinct(F.filter(F.array(trim(F.col("metadata.url")), trim(F.col("metadata.final_url"))), lambda u: u.isNotNull() & (u != "")))
    # One pass over the heads judges the runs; it gathers ids and addresses.
    judged = known.groupBy("run_id").agg(
        F.min(F.when(F.col("error").isNotNull(), F.struct("captured_at", "id", "error")))["error"].alias("broken"),
        F.count("key").alias("pages"),
        F.min(F.when(F.col("key").isNotNull(), F.struct("id", "key", "_url", "page_mode"))).alias("page"),
        F.collect_list(F.struct("id", keys.alias("keys"))).alias("addresses"),
    )
    others = F.flatten(F.transform(F.filter("addresses", lambda a: a["id"] != F.col("page.id")), lambda a: a["keys"]))
    judged = judged.withColumn("twice", F.size(others) != F.size(F.array_distinct(others))).drop("addresses")
    v = guard.join(judged, "run_id", "left")
    refused = F.coalesce(F.col("error"), F.col("broken"), F.when(F.col("pages") == 0, "no source page snapshot").when(F.col("pages") > 1, "several source page snapshots"))
    v = v.select("run_id", refused.alias("refused"), "page", "twice")
    good = v.filter("refused is null").select("run_id", "page")
    own = heads.join(good, "run_id")
    url = first_non_empty(F.col("metadata.final_url"), F.col("metadata.url"))
    page = own.filter("id = page.id").select("run_id", F.col("page.key").alias("source"), F.col("page._url").alias("source_url"), F.col("page.page_mode").alias("page_mode"), url.alias("page_url"), F.col("id").alias("page_snapshot"), _trouble("source page", F.col("truncated"), F.col("metadata.status_code")).alias("trouble"))
    link = F.explode(keys).alias("link")
    answers = own.filter("id != page.id").select("run_id", link, F.col("id").alias("snapshot_id"), "truncated", F.col("metadata.status_code").alias("status_code")).dropDuplicates(["run_id", "link"])
    pages = with_bodies(page.filter("trouble is null"), "page_snapshot", shelf.bodies)
    lines = keep(parsed_lines(pages, answers, shelf.bodies, ["run_id", "link"], limit, "missing"))
    summary = summarised(page.select("run_id", "source", "source_url", "page_mode", "trouble", F.lit(True).alias("stored")), calendars(lines), replaying=True)
    whole = v.select("run_id", "refused", "twice").join(summary, "run_id", "left")
    late = F.when(F.coalesce("twice", F.lit(False)) & (F.col("links") > 0), "duplicate ICS snapshot address").when(F.col("missing") > 0, "missing ICS snapshot")
    whole = whole.withColumn("refused", F.coalesce("refused", late)).drop("missing")
    told = [F.when(F.col("refused").isNull(), F.col(c)).alias(c) for c in summary.columns if c not in ("run_id", "missing")]
    out = whole.select("run_id", "refused", *told)
    return Report(out, lines.join(out.filter("refused is null").select("run_id"), "run_id", "left_semi"))


def ingest(wanted: DataFrame, landed: DataFrame, registry: DataFrame, limit: int, keep: Callable[[DataFrame], DataFrame] | None = None, keep_pages: Callable[[DataFrame], DataFrame] = lambda df: df) -> Report:
    """Runs over landed files: ``wanted`` (run_id, source: a key of ``registry``) and ``landed`` (url,
    final_url, status_code, truncated, body), one file for each address. Limit 0 is the default limit.
    A file that did not land is an error of the page or calendar.

    ``keep`` is given the lines as in replay(), for callers who use both parts of the report. Without it the runs come
    from counts by calendar, and lines are parsed when they are read. ``keep_pages`` is given the pages that the runs
    read, with their bodies, which are used twice."""
    limit = run_ops.run_limit(limit)
    r = registry.select(F.col("key").alias("source"), F.col("url").alias("source_url"), "page_mode")
    files = landed.select(trim(F.col("url")).alias("link"), "final_url", "status_code", "truncated", "body")
    page = wanted.join(r, "source").join(files.withColumnRenamed("link", "source_url").hint("merge"), "source_url", "left")
    missing = F.when(F.col("body").isNull(), "source page did not land")
    page = page.withColumn("trouble", F.coalesce(missing, _trouble("source page", F.col("truncated"), F.col("status_code")))).withColumn("page_url", first_non_empty(F.col("final_url"), F.col("source_url")))
    page = page.withColumn("stored", F.col("body").isNotNull()).withColumn("page_snapshot", F.lit(0).cast("long"))
    page = page.select("run_id", "source", "source_url", "page_mode", "page_url", "page_snapshot", "trouble", "stored", F.when(F.col("trouble").isNull(), F.col("body")).alias("body"))
    # parsing takes long for their size, by which Spark would deal them
    spark = wanted.sparkSession
    page = keep_pages(page.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "run_id"))
    bodies = files.select("link", F.lit(0).cast("long").alias("snapshot_id"), "truncated", "status_code", "body")
    asked = (page.filter("trouble is null"), bodies, None, ["link"], limit, "ICS did not land")
    lines = parsed_lines(*asked) if keep is None else keep(parsed_lines(*asked))
    found = counted_calendars(*asked) if keep is None else calendars(lines)
    summary = summarised(page.select("run_id", "source", "source_url", "page_mode", "trouble", "stored"), found, replaying=False)
    return Report(summary.drop("missing").withColumn("refused", F.lit(None).cast("string")), lines)


def captured(report: Report, landed: DataFrame, registry: DataFrame) -> DataFrame:
    """The snapshots that the runs of ingest() store: import_run_id, source_name, source_url, captured_at, payload."""
    r = registry.select(F.col("key").alias("source"), F.col("name").alias("_page_name"), "calendar_name", F.col("url").alias("_page"), "page_mode")
    run = report.runs.select("run_id", "source").join(r, "source")
    page = run.select("run_id", F.col("_page_name").alias("source_name"), F.col("_page").alias("url"))
    links = report.lines.filter("kind = 'calendar'").select("run_id", trim(F.col("url")).alias("url")).join(run.filter("page_mode = 'linked_ics'"), "run_id").select("run_id", F.col("calendar_name").alias("source_name"), "url")
    rows = page.unionByName(links).join(landed.withColumn("url", trim(F.col("url"))), "url")
    sealed = seal(rows)
    return sealed.select(F.col("run_id").alias("import_run_id"), "source_name", F.col("url").alias("source_url"), "captured_at", "payload")


def run_candidates(report: Report, staged_names: DataFrame) -> DataFrame:
    """The candidates of the runs that succeeded, as clustered() takes them. ``staged_names``: source,
    staged_as; a source that it lacks is named after its key."""
    run = report.runs.filter("status = 'succeeded'").join(staged_names.select("source", "staged_as"), "source", "left")
    run = run.select("run_id", F.coalesce("staged_as", F.concat("source", F.lit(" manual ingest"))).alias("source_name"), F.col("source_url").alias("report_url"))
    own = report.lines.filter("kind in ('candidate', 'calendar')")
    address = own.groupBy("run_id", "calendar").agg(F.max(F.when(F.col("kind") == "calendar", F.col("url"))).alias("calendar_url"))
    rows = own.filter("kind = 'candidate'").join(address, ["run_id", "calendar"]).join(run, "run_id")
    return rows.withColumnRenamed("ordinal", "candidate").drop("kind", "reason", "snapshot_id")


def review_groups(report: Report, staged_names: DataFrame) -> DataFrame:
    return clustered(run_candidates(report, staged_names))
