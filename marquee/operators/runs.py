"""Import runs: listings, totals, status and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LIMIT, DEFAULT_LIMIT = 50, 20


def positive(limit: int) -> int:
    if limit <= 0:
        raise ValueError("a limit is positive")
    return limit


def run_limit(limit: int, replay: bool = False) -> int:
    """0 is the default for a run and an error for a replay; over MAX_LIMIT is an error."""
    if limit == 0 and not replay:
        return DEFAULT_LIMIT
    if not 0 < limit <= MAX_LIMIT:
        raise ValueError(f"a limit is from 1 to {MAX_LIMIT}")
    return limit


def with_snapshot_count(runs: DataFrame, snapshots: DataFrame) -> DataFrame:
    n = snapshots.groupBy(F.col("import_run_id").alias("id")).agg(F.count("*").alias("snapshot_count"))
    return runs.join(n, "id", "left").withColumn("snapshot_count", F.coalesce("snapshot_count", F.lit(0)))


def recent_runs(runs: DataFrame, snapshots: DataFrame, limit: int) -> DataFrame:
    return with_snapshot_count(runs, snapshots).orderBy(F.desc("started_at"), F.desc("id")).limit(positive(limit))


def latest_successful(runs: DataFrame, snapshots: DataFrame) -> DataFrame:
    good = (F.lower(F.trim("status")) == "succeeded") & (F.trim("finished_at") != "")
    return with_snapshot_count(runs.filter(good), snapshots).orderBy(F.desc("finished_at"), F.desc("id")).limit(1)


def run_header(runs: DataFrame, run_id: int) -> DataFrame:
    found = runs.filter(F.col("id") == run_id)
    if found.isEmpty():
        raise LookupError(f"run {run_id} not found")
    return found


def run_snapshots(snapshots: DataFrame, sources: DataFrame, run_id: int) -> DataFrame:
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("url").alias("source_url"))
    rows = snapshots.filter(F.col("import_run_id") == run_id).join(s, "source_id", "left")
    return rows.fillna("", ["source_name", "source_url"]).orderBy("captured_at", "id")


def http_ok(code: Column) -> Column:
    return code.between(200, 299)


def totals(runs: DataFrame, calendars: DataFrame) -> DataFrame:
    """``runs`` (run_id, links, errors: an array) with links, candidates, skips and errors counted over
    the run and its ``calendars`` (run_id, and counts of candidates, skips and errors)."""
    per = calendars.groupBy("run_id").agg(*(F.sum(c).alias(f"c_{c}") for c in ("candidates", "skips", "errors")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = runs.join(per, "run_id", "left")
    return joined.select("run_id", F.col("links").cast("long").alias("links"), zero("c_candidates").alias("candidates"), zero("c_skips").alias("skips"), (F.size("errors") + zero("c_errors")).alias("errors"))


def usable() -> Column:
    """Whether a calendar has a snapshot, candidates and no error."""
    return F.col("has_snapshot") & (F.col("errors") == 0) & (F.col("candidates") > 0)


def status_of(errors: Column, any_usable: Column) -> Column:
    """failed for any error, or if no calendar is usable."""
    return F.when((errors == 0) & F.coalesce(any_usable, F.lit(False)), "succeeded").otherwise("failed")


def error_line() -> Column:
    """ordinal and text of a calendar's first error, for notes_of(); null if it has none."""
    label = F.when(F.col("url") == "", "calendar").otherwise(F.col("url"))
    return F.when(F.col("errors") > 0, F.struct("ordinal", F.concat(label, F.lit(": "), "first_error").alias("line")))


def notes_of(counts: dict[str, Column], errors: Column, lines: Column, details: int = 3) -> Column:
    """The totals, the run's errors (array), then the first of its calendars' error lines (array)."""
    summary = F.concat_ws(" ", *(F.concat(F.lit(f"{c}="), n.cast("string")) for c, n in counts.items()))
    first = F.transform(F.slice(F.sort_array(lines), 1, details), lambda x: x["line"])
    more = F.when(F.size(lines) > details, F.concat(F.lit("... and "), (F.size(lines) - details).cast("string"), F.lit(" more calendar errors")))
    return F.concat_ws("; ", summary, errors, first, more)


def run_status(run_totals: DataFrame, calendars: DataFrame) -> DataFrame:
    """run_id and status of status_of()."""
    per = calendars.groupBy("run_id").agg(F.bool_or(usable()).alias("usable"))
    return run_totals.join(per, "run_id", "left").select("run_id", status_of(F.col("errors"), F.col("usable")).alias("status"))


def run_notes(runs: DataFrame, calendars: DataFrame) -> DataFrame:
    """run_id and notes_of() its totals, errors and ``calendars`` (run_id, ordinal, url, candidates,
    skips, errors, first_error). Only lines of calendars with errors are gathered, which a run has few of."""
    sums = [F.sum(c).alias(f"c_{c}") for c in ("candidates", "skips", "errors")]
    per = calendars.groupBy("run_id").agg(*sums, F.collect_list(error_line()).alias("lines"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = runs.join(per, "run_id", "left")
    counts = {"links": F.col("links"), "candidates": zero("c_candidates"), "skips": zero("c_skips"), "errors": F.size("errors") + zero("c_errors")}
    return joined.select("run_id", notes_of(counts, F.col("errors"), F.coalesce("lines", F.array().cast("array<struct<ordinal: long, line: string>>"))).alias("notes"))


def run_finishes(runs: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Log rows id, finished_at, status, notes of ``done`` (id, status, notes); error where there is no
    such run or no status."""
    known = runs.select("id", F.lit(True).alias("_known"))
    status = F.trim("status")
    error = F.when(F.col("_known").isNull(), "run not found").when(status == "", "run status is required")
    return done.join(known, "id", "left").select("id", now.alias("finished_at"), status.alias("status"), "notes", error.alias("error"))


def finished(runs: DataFrame, log: DataFrame) -> DataFrame:
    """``runs`` (id, finished_at, status, notes and others) after the good rows of run_finishes(); of
    several for a run the last counts."""
    row = F.max(F.struct("finished_at", "status", "notes")).alias("_row")
    last = log.filter("error is null").groupBy("id").agg(row)
    joined = runs.join(last, "id", "left")
    new = {c: F.coalesce(F.col(f"_row.{c}"), F.col(c)).alias(c) for c in ("finished_at", "status", "notes")}
    return joined.select(*(new.get(c, F.col(c)) for c in runs.columns))


def as_json(rows: DataFrame, indented: bool = True) -> DataFrame:
    """Each row as a JSON report; nulls are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"pretty": str(indented).lower()}).alias("report"))
