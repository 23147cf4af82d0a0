"""The listing model over the driver's tables: as DataFrames, and as SQL for the oracles.

Customers are venues and review groups, nations are sources, orders are events, import runs and
candidates, line items are snapshots and calendars. Times are RFC 3339 text, as the model has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.text import slug
from marquee.functions.time import rfc3339
from marquee.operators.reviews import FIELDS
from marquee.sources.envelope import seal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(ts: Column) -> Column:
    return rfc3339(ts.cast("timestamp"))


def _after(hours: str) -> Column:
    return F.expr(f"o_orderdate + make_dt_interval(0, cast({hours} as int), 0, 0)")


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), slug(F.col("c_name")).alias("slug"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("neighbourhood"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("https://"), slug(F.col("n_name")), F.lit(".test/")).alias("url"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("id"),
        F.concat(F.lit("order-"), key.cast("string")).alias("slug"),
        F.col("o_custkey").alias("venue_id"),
        (key % 25).alias("source_id"),
        F.concat(F.lit("Listing "), (key % 500).cast("string")).alias("name"),
        _text(_after("o_orderkey % 24")).alias("start_at"),
        _text(_after("o_orderkey % 24 + 3")).alias("end_at"),
        F.col("o_orderpriority").alias("genre"),
        F.col("o_orderstatus").alias("status"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("id"),
        _text(F.col("o_orderdate")).alias("started_at"),
        F.when(status != "P", _text(_after("o_orderkey % 5"))).alias("finished_at"),
        F.when(status == "F", " SUCCEEDED ").when(status == "O", "failed").otherwise("running").alias("status"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    return i.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("import_run_id"),
        F.when(F.col("l_linenumber") != 3, F.col("l_suppkey") % 30).alias("source_id"),
        _text(F.col("l_shipdate")).alias("captured_at"),
    )


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key, run = F.col("c_custkey"), (F.col("c_custkey") % 50).cast("string")
    notes = F.when(key % 4 == 0, F.concat(F.lit("Created from manual ingest run "), run, F.lit(" review staging."))).when(key % 4 == 1, F.concat(F.lit("import run "), run)).when(key % 4 == 2, F.concat(F.lit("import run "), run, F.lit("abc"))).otherwise(F.lit("Created from offline fixture."))
    segment = F.col("c_mktsegment")
    status = F.when(segment.isin("BUILDING", "MACHINERY"), "open").when(segment == "HOUSEHOLD", "resolved").when(segment == "FURNITURE", "rejected").otherwise("  ")
    return c.select(key.alias("id"), F.concat(F.lit("Review of "), F.col("c_name")).alias("title"), status.alias("status"), notes.alias("notes"), F.concat(F.lit("2026-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z")).alias("updated_at"), F.lit("Desk").alias("source_name"), F.lit("https://desk.test/").alias("source_url"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    venue = F.concat(F.lit("customer-"), F.lpad(F.col("venue_id").cast("string"), 9, "0"))
    return e.select(F.col("venue_id").alias("group_id"), "id", (F.col("id") % 7).alias("position"), F.col("slug").alias("external_id"), "name", venue.alias("venue_slug"), "start_at", "end_at", "genre", "status", F.lit("").alias("description"), F.when(F.col("id") % 2 == 0, "Feed").otherwise(" ").alias("source_name"), F.lit("").alias("source_url"))


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some fields of most groups; every field of each tenth, from their first and last candidates in turn."""
    e = events(spark, sf_dir)
    field = F.element_at(F.array(*map(F.lit, FIELDS)), (F.floor(F.col("id") / 3) % 9 + 1).cast("int"))
    some = e.filter("id % 3 = 0 and venue_id % 10 != 1").groupBy(F.col("venue_id").alias("group_id"), field.alias("field")).agg(F.max("id").alias("candidate_id"))
    ends = e.filter("venue_id % 10 = 1").groupBy(F.col("venue_id").alias("group_id")).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    every = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col("low" if i % 2 else "high").alias("candidate_id")) for i, f in enumerate(FIELDS)))).alias("c")
    return some.unionByName(ends.select("group_id", every).select("group_id", "c.*"))


def calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    at = F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    bad = F.col("l_returnflag") == "R"
    error = F.when(bad, F.concat(F.lit("bad body "), at.cast("string")))
    url = F.when(F.col("l_linenumber") == 2, "").otherwise(F.concat(F.lit("https://c.test/"), at.cast("string")))
    return i.select(F.col("l_orderkey").alias("run_id"), at.alias("ordinal"), url.alias("url"), (F.col("l_linestatus") == "O").alias("has_snapshot"), (F.col("l_quantity").cast("long") % 4).alias("candidates"), (F.col("l_linenumber") % 3).cast("long").alias("skips"), bad.cast("long").alias("errors"), error.alias("first_error"))


def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    error = F.when(F.col("o_orderkey") % 11 == 0, F.array(F.lit("page is gone"))).otherwise(F.array().cast("array<string>"))
    return o.select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 6).alias("links"), error.alias("errors"))


def run_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted candidates as a run reports them, with repeated UIDs and titles."""
    e = events(spark, sf_dir)
    key = F.col("id")
    return e.select(
        (F.col("venue_id") % 100).alias("run_id"),
        (F.col("venue_id") % 5).alias("calendar"),
        key.alias("candidate"),
        F.when(key % 3 == 0, F.concat(F.lit(" uid-"), (key % 40).cast("string"))).otherwise("").alias("uid"),
        F.when(key % 17 == 0, "").otherwise(F.concat(F.lit("  Big   Show "), (key % 20).cast("string"))).alias("summary"),
        F.lit("").alias("description"),
        F.when(key % 2 == 0, "Yellow Arch Studios").otherwise("The Leadmill").alias("location"),
        F.lit("").alias("url"),
        F.when(key % 5 == 0, "CONFIRMED").otherwise("Tentative").alias("status"),
        F.concat(F.lit("2026-05-0"), (key % 9 + 1).cast("string"), F.lit("T19:00:00Z")).alias("start_at"),
        F.lit("").alias("end_at"),
        F.lit("Feed").alias("source_name"),
        F.concat(F.lit("https://c.test/"), (F.col("venue_id") % 5).cast("string")).alias("calendar_url"),
        F.lit("https://feed.test/").alias("report_url"),
    )


def run_sources(spark: SparkSession) -> DataFrame:
    """Two sources as a registry has them: one whose page links calendars, one whose page has the events."""
    rows = [("linked", "Linked", "https://linked.test/", "linked_ics", "Linked calendars", "Linked desk"), ("paged", "Paged", "https://paged.test/what/", "source_page", "", "Paged desk")]
    return spark.createDataFrame(rows, "key string, name string, url string, page_mode string, calendar_name string, staged_as string")


def linked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (of a run), n, url and body of a calendar for each run and line number: c events, s cancelled
    ones and, if bad, a stray end; gone, cut and http_500 say how it is stored."""
    i = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    # that the last flag is R, in truth values: Spark sorts the rows for a maximum of texts
    own = i.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n")).agg(
        (F.min("l_quantity").cast("long") % 4).alias("c"), (F.bool_or(flag == "R") & ~F.bool_or(flag > "R")).alias("bad"), (F.min("l_partkey") % 50 == 0).alias("gone"), (F.min("l_suppkey") % 20 == 0).alias("cut"))
    url = F.concat(F.lit("https://c.test/"), F.col("id").cast("string"), F.lit("-"), F.col("n").cast("string"), F.lit(".ics"))
    event = lambda k, more: F.concat(F.lit("BEGIN:VEVENT\r\nUID:u"), (F.col("id") % 5).cast("string"), F.lit("-"), k.cast("string"), F.lit("\r\nSUMMARY:Show\r\nDTSTART:20260501T19000"), F.col("n").cast("string"), F.lit(f"Z\r\n{more}END:VEVENT"))
    upto = lambda n: F.sequence(F.lit(1), n.cast("int"))
    shows = F.when(F.col("c") > 0, F.transform(upto(F.col("c")), lambda k: event(k, ""))).otherwise(F.array().cast("array<string>"))
    off = F.when(F.col("n") % 3 > 0, F.transform(upto(F.col("n") % 3), lambda k: event(k, "STATUS:CANCELLED\r\n"))).otherwise(F.array().cast("array<string>"))
    stray = F.when(F.col("bad"), F.array(F.lit("END:VEVENT"))).otherwise(F.array().cast("array<string>"))
    body = F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), shows, off, stray, F.lit("END:VCALENDAR"))
    return own.select("id", "n", "gone", "cut", (F.col("n") == 5).alias("http_500"), url.alias("url"), F.encode(body, "UTF-8").alias("body"))


def run_pages(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    """id, key of the source, url and body of the page of each run. ``files`` are its linked_files(), if they are kept."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    anchor = F.concat(F.lit("<a href='"), F.col("url"), F.lit("'>Google Calendar ICS</a>"))
    linked = (linked_files(spark, sf_dir) if files is None else files).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", anchor.alias("a")))).alias("links"))
    name = lambda k: F.concat(F.lit("Show "), k.cast("string"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    node = lambda k, end: F.struct(F.lit("Event").alias("@type"), name(k).alias("name"), F.concat(F.lit("e/"), k.cast("string")).alias("url"), F.lit("2026-05-10T19:30").alias("startDate"), end.alias("endDate"), F.lit("Hall").alias("location"))
    events = F.concat(F.transform(upto(F.col("id") % 5), lambda k: node(k, F.lit("2026-05-10T23:00"))), F.transform(upto(F.col("id") % 3), lambda k: node(k, F.lit(""))))
    data = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(events), F.lit("</script>"))
    is_linked = F.col("id") % 2 == 0
    body = F.when(is_linked, F.concat(F.lit("<html>"), F.coalesce(F.array_join(F.transform("links", lambda x: x["a"]), " "), F.lit("")))).otherwise(data)
    return o.join(linked, "id", "left").select("id", F.when(is_linked, "linked").otherwise("paged").alias("source"), F.when(is_linked, "https://linked.test/").otherwise("https://paged.test/what/").alias("url"), F.encode(body, "UTF-8").alias("body"))


def stored_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of the pages and calendars of all runs, with the source that each belongs to."""
    pages = run_pages(spark, sf_dir).withColumn("source_name", F.initcap("source")).withColumn("truncated", F.col("id") % 13 == 0).withColumn("code", F.lit(200)).withColumn("n", F.lit(0))
    files = linked_files(spark, sf_dir).filter("not gone and id % 2 = 0").withColumn("source_name", F.lit("Linked calendars")).withColumn("truncated", F.col("cut")).withColumn("code", F.when(F.col("http_500"), 500).otherwise(200))
    columns = ("id", "n", "url", "source_name", "truncated", "code", "body")
    rows = pages.select(*columns).unionByName(files.select(*columns))
    rows = rows.select(F.col("id").alias("import_run_id"), (F.col("id") * 10 + F.col("n")).alias("id"), "source_name", F.col("url").alias("source_url"), "url", F.col("url").alias("final_url"), F.lit("").alias("status"), F.col("code").alias("status_code"), F.lit("").alias("content_type"), F.lit(-1).cast("long").alias("content_length"), F.lit("2026-04-19T09:00:00Z").alias("captured_at"), "truncated", "body")
    sealed = seal(rows)
    broken = F.when((F.col("import_run_id") % 11 == 0) & (F.col("id") % 10 == 0), F.regexp_replace("payload", '"sha256":"[0-9a-f]{4}', '"sha256":"zzzz')).otherwise(F.col("payload"))
    return sealed.select("id", "import_run_id", "source_name", "source_url", "captured_at", broken.alias("payload"))


def at(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%SZ')"


_FIELD = ", ".join(f"'{f}'" for f in FIELDS)
#: The same views for the oracles.
SQL = rf"""WITH venue AS (
  SELECT c_custkey AS id, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, c_name AS name, c_mktsegment AS neighbourhood FROM customer
), source AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, 'https://' || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') || '.test/' AS url FROM nation
), listing AS (
  SELECT o_orderkey AS id, 'order-' || o_orderkey AS slug, o_custkey AS venue_id, o_orderkey % 25 AS source_id, 'Listing ' || (o_orderkey % 500) AS name,
         {at("o_orderdate + to_hours(o_orderkey % 24)")} AS start_at, {at("o_orderdate + to_hours(o_orderkey % 24 + 3)")} AS end_at,
         o_orderpriority AS genre, o_orderstatus AS status,
         CAST(timezone('Europe/London', timezone('UTC', o_orderdate + to_hours(o_orderkey % 24))) AS DATE) AS local_day
  FROM orders
), star AS (
  SELECT listing.*, venue.slug AS venue_slug, source.name AS source_name, source.url AS source_url
  FROM listing JOIN venue ON venue_id = venue.id JOIN source ON source_id = source.id
), run AS (
  SELECT o_orderkey AS id, {at("o_orderdate")} AS started_at, CASE WHEN o_orderstatus <> 'P' THEN {at("o_orderdate + to_hours(o_orderkey % 5)")} END AS finished_at,
         CASE o_orderstatus WHEN 'F' THEN ' SUCCEEDED ' WHEN 'O' THEN 'failed' ELSE 'running' END AS status
  FROM orders
), snapshot AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS import_run_id, CASE WHEN l_linenumber <> 3 THEN l_suppkey % 30 END AS source_id, {at("l_shipdate")} AS captured_at FROM lineitem
), grp AS (
  SELECT c_custkey AS id, 'Review of ' || c_name AS title,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'open' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'resolved' WHEN c_mktsegment = 'FURNITURE' THEN 'rejected' ELSE '  ' END AS status,
         CASE c_custkey % 4 WHEN 0 THEN 'Created from manual ingest run ' || (c_custkey % 50) || ' review staging.' WHEN 1 THEN 'import run ' || (c_custkey % 50) WHEN 2 THEN 'import run ' || (c_custkey % 50) || 'abc' ELSE 'Created from offline fixture.' END AS notes,
         '2026-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' AS updated_at
  FROM customer
), grp_run AS (
  SELECT *, CASE WHEN id % 4 < 2 AND id % 50 > 0 THEN id % 50 END AS origin_run_id FROM grp
), candidate AS (
  SELECT venue_id AS group_id, id, id % 7 AS position, slug AS external_id, name, 'customer-' || lpad(CAST(venue_id AS VARCHAR), 9, '0') AS venue_slug, start_at, end_at, genre, status,
         '' AS description, CASE WHEN id % 2 = 0 THEN 'Feed' ELSE ' ' END AS source_name, '' AS source_url
  FROM listing
), choice AS (
  SELECT venue_id AS group_id, [{_FIELD}][CAST((id // 3) % 9 + 1 AS INT)] AS field, max(id) AS candidate_id FROM listing WHERE id % 3 = 0 AND venue_id % 10 <> 1 GROUP BY ALL
  UNION ALL
  SELECT group_id, [{_FIELD}][i] AS field, CASE WHEN i % 2 = 0 THEN low ELSE high END AS candidate_id
  FROM (SELECT venue_id AS group_id, min(id) AS low, max(id) AS high FROM listing WHERE venue_id % 10 = 1 GROUP BY ALL), (SELECT unnest(range(1, 10)) AS i)
), counted AS (
  SELECT g.id, g.title, g.status, g.notes, g.updated_at, g.origin_run_id, count(DISTINCT c.id) AS candidate_count, count(DISTINCT d.field) AS draft_count
  FROM grp_run g LEFT JOIN candidate c ON c.group_id = g.id LEFT JOIN choice d ON d.group_id = g.id GROUP BY ALL
), run_count AS (
  SELECT r.id, r.started_at, r.finished_at, r.status, count(s.id) AS snapshot_count FROM run r LEFT JOIN snapshot s ON s.import_run_id = r.id GROUP BY ALL
)
"""
#: What replay() finds in stored_snapshots(), worked out without reading a body.
REPLAYED = f"""{SQL}, file AS (
  SELECT l_orderkey AS id, l_linenumber AS n, CAST(min(l_quantity) AS BIGINT) % 4 AS c, l_linenumber % 3 AS s, max(l_returnflag) = 'R' AS bad, min(l_partkey) % 50 = 0 AS gone, min(l_suppkey) % 20 = 0 AS cut, l_linenumber = 5 AS http
  FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL
), page AS (
  SELECT id, id % 2 = 0 AS linked, id % 13 = 0 AS cut, CASE WHEN status = 'running' THEN 'unfinished' WHEN trim(status) <> 'SUCCEEDED' THEN 'not succeeded' WHEN id % 11 = 0 THEN 'hash mismatch' WHEN id % 2 = 0 AND id % 13 > 0 AND id IN (SELECT id FROM file WHERE gone) THEN 'missing ICS snapshot' END AS refused FROM run
), cal AS (
  SELECT page.id, n, 'https://c.test/' || page.id || '-' || n || '.ics' AS url, CASE WHEN file.cut OR http THEN 0 ELSE c END AS c, CASE WHEN file.cut OR http THEN 0 ELSE s END AS s,
         CASE WHEN file.cut THEN 'ICS response was truncated' WHEN http THEN 'ICS returned HTTP 500' WHEN bad THEN 'END:VEVENT without BEGIN:VEVENT' END AS error
  FROM page JOIN file ON file.id = page.id WHERE refused IS NULL AND NOT page.cut
  UNION ALL
  SELECT id, 0, 'https://paged.test/what/', id % 5, id % 3, CASE WHEN id % 5 = 0 AND id % 3 = 0 THEN 'no schema.org Event objects found in application/ld+json' END FROM page WHERE refused IS NULL AND NOT linked AND NOT cut
), per AS (
  SELECT page.id, linked, page.cut, refused, count(n) AS n, CAST(coalesce(sum(c), 0) AS BIGINT) AS candidates, CAST(coalesce(sum(s), 0) AS BIGINT) AS skips, count(error) AS bad, coalesce(bool_or(error IS NULL AND c > 0), false) AS usable
  FROM page LEFT JOIN cal ON cal.id = page.id GROUP BY ALL
), said AS (
  SELECT *, concat_ws('; ', CASE WHEN cut THEN 'source page response was truncated' END, CASE WHEN linked AND NOT cut AND n = 0 THEN 'no ICS links found' END,
         CASE WHEN NOT usable AND linked THEN 'no ICS calendars parsed successfully' WHEN NOT usable THEN 'no listings parsed successfully' END) AS own,
         CAST(cut AS INT) + CAST(linked AND NOT cut AND n = 0 AS INT) + CAST(NOT usable AS INT) + bad AS errors
  FROM per
), worst AS (
  SELECT id, string_agg(url || ': ' || error, '; ' ORDER BY n) FILTER (r <= 3) AS line, count(*) AS bad FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS r FROM cal WHERE error IS NOT NULL) GROUP BY id
), replayed AS (
  SELECT said.id AS run_id, refused, CASE WHEN linked AND NOT cut THEN n ELSE 0 END AS links, 1 + CASE WHEN linked THEN n ELSE 0 END AS snapshots, candidates, skips, errors, CASE WHEN errors = 0 THEN 'succeeded' ELSE 'failed' END AS status,
         concat_ws('; ', 'links=' || CASE WHEN linked AND NOT cut THEN n ELSE 0 END || ' candidates=' || candidates || ' skips=' || skips || ' errors=' || errors, nullif(own, ''), line, CASE WHEN worst.bad > 3 THEN '... and ' || (worst.bad - 3) || ' more calendar errors' END) AS notes
  FROM said LEFT JOIN worst ON worst.id = said.id
)
"""
