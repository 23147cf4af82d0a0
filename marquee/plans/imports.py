"""Import runs, snapshots, replay and extraction."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import functions as F

from marquee.functions import tables
from marquee.functions.address import resolved
from marquee.operators import replay, runs
from marquee.plans import model
from marquee.plans.registry import query
from marquee.sources import envelope, exchanges, extract, ics
from marquee.store.place import new_path, written
from marquee.store.shelf import shelve

_RUN = ("id", "started_at", "finished_at", "status", "snapshot_count")


@query(f"{model.SQL} SELECT * FROM run_count ORDER BY started_at DESC, id DESC LIMIT 20")
def runs_with_snapshot_count(spark, sf_dir):
    return runs.recent_runs(model.runs(spark, sf_dir), model.snapshots(spark, sf_dir), 20).select(*_RUN)


@query(f"{model.SQL} SELECT * FROM run_count WHERE lower(trim(status)) = 'succeeded' AND trim(finished_at) <> '' ORDER BY finished_at DESC, id DESC LIMIT 1")
def latest_successful_run(spark, sf_dir):
    return runs.latest_successful(model.runs(spark, sf_dir), model.snapshots(spark, sf_dir)).select(*_RUN)


@query(f"{model.SQL} SELECT id, started_at, finished_at, status FROM run WHERE id = 42")
def run_header(spark, sf_dir):
    return runs.run_header(model.runs(spark, sf_dir), 42)


@query(f"{model.SQL} SELECT s.id, s.captured_at, s.source_id, coalesce(source.name, '') AS source_name, coalesce(source.url, '') AS source_url FROM snapshot s LEFT JOIN source ON source.id = s.source_id WHERE s.import_run_id = 42 ORDER BY s.captured_at, s.id")
def run_snapshots(spark, sf_dir):
    return runs.run_snapshots(model.snapshots(spark, sf_dir), model.sources(spark, sf_dir), 42).select("id", "captured_at", "source_id", "source_name", "source_url")


@query(f"{model.SQL} SELECT run.id, CASE WHEN finished_at IS NULL THEN 'unfinished' WHEN lower(trim(status)) <> 'succeeded' THEN 'not succeeded' WHEN snapshot_count = 0 THEN 'no snapshots' END AS error FROM run_count run")
def replayable(spark, sf_dir):
    return envelope.replayable(model.runs(spark, sf_dir), model.snapshots(spark, sf_dir))


_TOTALS = f"""WITH cal AS (SELECT l_orderkey AS run_id, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS ordinal, l_linenumber = 2 AS plain, l_linestatus = 'O' AS has_snapshot, CAST(l_quantity AS BIGINT) % 4 AS c, l_linenumber % 3 AS s, CAST(l_returnflag = 'R' AS INT) AS e FROM lineitem),
rep AS (SELECT o_orderkey AS run_id, o_orderkey % 6 AS links, CAST(o_orderkey % 11 = 0 AS INT) AS own FROM orders),
tot AS (SELECT run_id, links, own, CAST(coalesce(sum(c), 0) AS BIGINT) AS candidates, CAST(coalesce(sum(s), 0) AS BIGINT) AS skips, CAST(own + coalesce(sum(e), 0) AS BIGINT) AS errors, coalesce(bool_or(has_snapshot AND e = 0 AND c > 0), false) AS usable FROM rep LEFT JOIN cal USING (run_id) GROUP BY run_id, links, own)
"""


@query(f"{_TOTALS} SELECT run_id, links, candidates, skips, errors FROM tot")
def run_totals(spark, sf_dir):
    return runs.totals(model.run_reports(spark, sf_dir), model.calendars(spark, sf_dir))


@query(f"{_TOTALS} SELECT run_id, CASE WHEN errors = 0 AND usable THEN 'succeeded' ELSE 'failed' END AS status FROM tot")
def run_status(spark, sf_dir):
    calendars = model.calendars(spark, sf_dir)
    return runs.run_status(runs.totals(model.run_reports(spark, sf_dir), calendars), calendars)


@query(f"""{_TOTALS}, bad AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ordinal) AS r FROM cal WHERE e > 0),
lines AS (SELECT run_id, string_agg(CASE WHEN plain THEN 'calendar' ELSE 'https://c.test/' || ordinal END || ': bad body ' || ordinal, '; ' ORDER BY r) FILTER (r <= 3) AS line, count(*) AS n FROM bad GROUP BY run_id)
SELECT tot.run_id, concat_ws('; ', 'links=' || links || ' candidates=' || candidates || ' skips=' || skips || ' errors=' || errors, CASE WHEN own = 1 THEN 'page is gone' END, line, CASE WHEN n > 3 THEN '... and ' || (n - 3) || ' more calendar errors' END) AS notes
FROM tot LEFT JOIN lines USING (run_id)""")
def run_notes(spark, sf_dir):
    return runs.run_notes(model.run_reports(spark, sf_dir), model.calendars(spark, sf_dir))


def _sealed(spark, sf_dir):
    p = model.table(spark, sf_dir, "pages")
    files = p.select("page_id", "url", F.col("url").alias("final_url"), F.lit("200 OK").alias("status"), F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), F.lit(-1).cast("long").alias("content_length"), F.lit("2026-04-19T09:00:00Z").alias("captured_at"), F.encode("html", "UTF-8").alias("content"))
    return envelope.seal(envelope.capture(files)).select("page_id", "url", "payload")


@query("""SELECT page_id, url, CASE WHEN page_id % 7 > 1 THEN sha256(html) END AS sha256, CASE WHEN page_id % 7 > 0 THEN octet_length(encode(html)) END AS body_bytes,
CASE WHEN page_id % 7 > 0 THEN false END AS truncated, CASE WHEN page_id % 7 = 0 THEN 'malformed envelope' WHEN page_id % 7 = 1 THEN 'malformed body' WHEN page_id % 7 = 2 THEN 'unsupported version' WHEN page_id % 7 = 3 THEN 'hash mismatch' END AS error FROM pages""")
def envelope_roundtrip(spark, sf_dir):
    """Written and read, with four kinds of damage."""
    kind, text = F.col("page_id") % 7, F.col("payload")
    broken = F.when(kind == 0, F.substring(text, 1, 40)).when(kind == 1, F.regexp_replace(text, '"body_base64":"', '"body_base64":"%')).when(kind == 2, F.regexp_replace(text, '"version":1', '"version":3')).when(kind == 3, F.regexp_replace(text, '"sha256":"[0-9a-f]{4}', '"sha256":"zzzz')).otherwise(text)
    read = envelope.unseal(_sealed(spark, sf_dir).withColumn("payload", broken))
    return read.select("page_id", "url", F.sha2("body", 256).alias("sha256"), F.col("metadata.body_bytes").cast("long").alias("body_bytes"), "truncated", "error")


@query("SELECT page_id, sha256(encode(html)[1:1000]) AS sha256, least(octet_length(encode(html)), 1000) AS n, octet_length(encode(html)) > 1000 AS truncated FROM pages")
def captured_bodies(spark, sf_dir):
    """Bodies of over a thousand bytes are cut and say so."""
    p = model.table(spark, sf_dir, "pages")
    rows = envelope.capture(p.select("page_id", F.encode("html", "UTF-8").alias("content")), 1000)
    return rows.select("page_id", F.sha2("body", 256).alias("sha256"), F.length("body").cast("long").alias("n"), "truncated")


@query("SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'Metadata unavailable' ELSE '200 OK' END AS status_label, CASE WHEN page_id % 7 > 0 THEN url END AS final_url FROM pages")
def run_detail(spark, sf_dir):
    newer = F.when(F.col("page_id") % 7 == 0, F.regexp_replace("payload", '"version":1', '"version":2')).otherwise(F.col("payload"))
    return envelope.run_detail(_sealed(spark, sf_dir).withColumn("payload", newer)).select("page_id", "status_label", F.col("metadata.final_url").alias("final_url"))


@query("""WITH part AS (SELECT page_id, unnest(string_split(html, '<a ')) AS p, generate_subscripts(string_split(html, '<a '), 1) AS i FROM pages),
link AS (SELECT page_id, i, substr(p, strpos(p, 'href="') + 6) AS h FROM part WHERE i > 1 AND strpos(p, 'href="') > 0 AND strpos(p, '</a>') > 0)
SELECT page_id, count(*) AS n, string_agg(substr(h, 1, strpos(h, '"') - 1), ' ' ORDER BY i) AS hrefs FROM link GROUP BY page_id""")
def anchor_links(spark, sf_dir):
    """The anchors of each page; the SQL cuts the text at tags that these pages write in one way."""
    found = extract.anchors(model.table(spark, sf_dir, "pages"), "page_id")
    hrefs = F.array_sort(F.collect_list(F.struct("position", "href")))
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.array_join(F.transform(hrefs, lambda x: x["href"]), " ").alias("hrefs"))


@query("""WITH link AS (
  SELECT o_orderkey AS id, 0 AS spot, 'https://s.test/cal/' || o_orderkey || '.ics?name=a&kind=b' AS link FROM orders
  UNION ALL SELECT o_orderkey, 1, 'https://s.test/e/' || o_orderkey || '/two.ics' FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, 2, 'https://s.test/e/three?format=ICAL' FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 3, 'https://s.test/e/' || o_orderkey || '/it''s.ics' FROM orders WHERE o_orderkey % 5 = 0
), placed AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY spot) - 1 AS INT) AS position, link FROM link WHERE id % 7 > 0)
SELECT id, position, link, CAST(NULL AS VARCHAR) AS reason FROM placed WHERE position < 3 UNION ALL SELECT o_orderkey, 0, NULL, 'bad page URL ''https://[s.test/''' FROM orders WHERE o_orderkey % 7 = 0""")
def ics_links(spark, sf_dir):
    """Calendar links of a page for each order, with other labels, repeats, relative links and a limit."""
    key = F.col("o_orderkey")
    text = key.cast("string")
    whole = F.concat(F.lit('<p><a class="x" href="/cal/'), text, F.lit('.ics?name=a&amp;kind=b">Google <b>Calendar</b>\n ICS</a>'))
    page = F.concat_ws(
        "",
        F.lit("<html><a name=top>ICS</a><a href=/no.ics>ICS</a>"),
        whole,
        F.lit('<a href="/no">Apple Calendar ICS</a>'),
        F.when(key % 2 == 0, "<A HREF='two.ics'> google calendar&#32;ICS </A>"),
        whole,
        F.when(key % 3 == 0, "<a href=../three?format=ICAL>ICS</a>"),
        F.when(key % 5 == 0, '<a title="a > b" href="it\'s.ics">Google Calendar ICS</a>'),
    )
    url = F.when(key % 7 == 0, "https://[s.test/").otherwise(F.concat(F.lit("https://s.test/e/"), text, F.lit("/")))
    pages = model.table(spark, sf_dir, "orders").select(key.alias("id"), url.alias("url"), page.alias("html"))
    return extract.ics_links(pages, "id", 3)


@query("""SELECT o_orderkey AS id, 'candidate' AS kind, CASE WHEN o_orderkey % 7 = 0 THEN 'Outer' ELSE 'Inner' END AS summary, CASE WHEN o_orderkey % 7 = 0 THEN 'https://p.test/o' WHEN o_orderkey % 4 = 0 THEN 'http://[bad' ELSE 'https://p.test/w/i' END AS url, CAST(NULL AS VARCHAR) AS reason FROM orders
UNION ALL SELECT o_orderkey, 'skip', 'No start', NULL, 'missing event start time' FROM orders
UNION ALL SELECT o_orderkey, 'error', NULL, NULL, CASE WHEN o_orderkey % 7 = 0 THEN 'bad start time of ''Inner''' ELSE 'bad event URL ''http://[bad''' END FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, 'calendar', NULL, 'https://p.test/w/', NULL FROM orders""")
def source_page(spark, sf_dir):
    """One candidate of a page for each order whose events nest, with bad times and addresses."""
    key = F.col("o_orderkey")
    inner = F.concat(F.lit('{"@type":[["Event"]],"name":"Inner","location":"Hall","endDate":"2026-05-10T23:00","startDate":"'), F.when(key % 7 == 0, "0001-01-01T00:00:00+01:00").otherwise("2026-05-10T19:30"), F.lit('","url":"'), F.when(key % 4 == 0, "http://[bad").otherwise("i"), F.lit('"}'))
    outer = F.concat(F.lit('{"@type":"Event","name":"Outer","location":{"name":"Hall"},"startDate":"2026-05-10T19:30","endDate":"2026-05-10T23:00","url":"/o","@graph":['), inner, F.lit(',{"@type":"event","name":"No start"}]}'))
    page = F.concat(F.lit("<script type='application/ld+json'>"), outer, F.lit("</script><script type=application/ld+json>no data</script>"))
    pages = model.table(spark, sf_dir, "orders").select(key.alias("id"), F.lit("source_page").alias("page_mode"), F.lit("https://p.test/w/").alias("page_url"), F.encode(page, "UTF-8").alias("body"))
    return extract.source_page_rows(pages, ("id",), 1).select("id", "kind", "summary", "url", "reason")


def _replayed(spark, sf_dir) -> replay.Report:
    shelf = shelve(model.stored_snapshots(spark, sf_dir), f"shelf_{uuid.uuid4().hex}")
    return replay.replay(model.runs(spark, sf_dir), shelf, model.run_sources(spark), 50, keep=partial(written, name="lines"))


_REPORT = ("run_id", "refused", "links", "snapshots", "candidates", "skips", "errors", "status", "notes")


@query(f"{model.REPLAYED} SELECT {', '.join(c if c in ('run_id', 'refused') else f'CASE WHEN refused IS NULL THEN {c} END AS {c}' for c in _REPORT)} FROM replayed")
def replay_totals(spark, sf_dir):
    """Every run replayed from its stored envelopes: totals, status and notes, or why it is refused."""
    return _replayed(spark, sf_dir).runs.select(*_REPORT)


@query(f"""{model.REPLAYED} SELECT cal.id AS run_id, n AS calendar, url, c AS candidates, s AS skips, error FROM (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS INT) AS n, url, c, s, error FROM cal) cal JOIN replayed ON replayed.run_id = cal.id WHERE refused IS NULL""")
def replay_run(spark, sf_dir):
    """The calendars of the replayed runs."""
    return replay.calendars(_replayed(spark, sf_dir).lines).select("run_id", F.col("ordinal").cast("int").alias("calendar"), "url", "candidates", "skips", F.col("first_error").alias("error"))


@query(f"""{model.REPLAYED}, gig AS (SELECT cal.id, n, 'u' || cal.id % 5 || '-' || unnest(range(1, c + 1)) AS uid FROM cal JOIN replayed ON run_id = cal.id WHERE refused IS NULL AND status = 'succeeded' AND n > 0)
SELECT id AS run_id, uid, CASE WHEN count(*) = 1 THEN 'New listing review: Show' ELSE 'Duplicate review: Show' END AS title, 'Linked desk' AS source_name, count(*) AS n_candidates FROM gig GROUP BY id, uid
UNION ALL SELECT cal.id, 'Show ' || unnest(range(1, c + 1)), 'New listing review: Show ' || unnest(range(1, c + 1)), 'Paged desk', 1 FROM cal JOIN replayed ON run_id = cal.id WHERE refused IS NULL AND status = 'succeeded' AND n = 0""")
def replay_groups(spark, sf_dir):
    """Review groups of the runs that the replay finds good."""
    found = replay.review_groups(_replayed(spark, sf_dir), model.run_sources(spark).select(F.col("key").alias("source"), "staged_as"))
    name = F.when(F.col("key").startswith("uid"), F.substring_index("key", "\0", -1)).otherwise(F.initcap(F.split_part("key", F.lit("\0"), F.lit(2))))
    return found.select("run_id", name.alias("uid"), "title", "source_name", "n_candidates")


@query(f"""{model.SQL} SELECT id, started_at, CASE WHEN id % 3 = 0 AND id % 5 > 0 THEN '2026-04-19T09:00:00Z' ELSE finished_at END AS finished_at, CASE WHEN id % 3 = 0 AND id % 5 > 0 THEN 'failed' ELSE status END AS status, CASE WHEN id % 3 = 0 AND id % 5 > 0 THEN 'n' || id END AS notes, CASE WHEN id % 3 = 0 AND id % 5 = 0 THEN 'run status is required' END AS error FROM run
UNION ALL SELECT -1 - id, NULL, NULL, NULL, NULL, 'run not found' FROM run WHERE id % 10 = 0""")
def finish_runs(spark, sf_dir):
    """Runs after a third of them finish; blank statuses and unknown runs are errors."""
    own = model.runs(spark, sf_dir).withColumn("notes", F.lit(None).cast("string"))
    key = F.col("id")
    done = own.filter("id % 3 = 0").select("id", F.when(key % 5 == 0, "  ").otherwise(" failed ").alias("status"), F.concat(F.lit("n"), key.cast("string")).alias("notes"))
    lost = own.filter("id % 10 = 0").select((-key - 1).alias("id"), F.lit("failed").alias("status"), F.lit("x").alias("notes"))
    log = runs.run_finishes(own, done.unionByName(lost), F.lit("2026-04-19T09:00:00Z"))
    after = runs.finished(own, log).join(log.filter("error is not null").select("id", "error"), "id", "left")
    unknown = log.filter("error = 'run not found'").select("id", *(F.lit(None).cast("string").alias(c) for c in ("started_at", "finished_at", "status", "notes")), "error")
    return after.select("id", "started_at", "finished_at", "status", "notes", "error").unionByName(unknown)


_LOCAL = "o_orderdate + to_hours(o_orderkey % 12 + 11)"


_CALENDARS = f"""SELECT 'https://c.test/' || o_orderkey AS url_of_body, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'skip' ELSE 'candidate' END AS kind, 'uid-' || o_orderkey AS uid, 'Show, number ' || o_orderkey AS summary,
CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 THEN strftime(timezone('UTC', timezone('Europe/London', {_LOCAL})), '%Y-%m-%dT%H:%M:%SZ') END AS start_at,
CASE WHEN o_orderkey % 5 = 0 THEN 'cancelled' WHEN o_orderkey % 7 = 0 THEN 'all-day event' END AS reason FROM orders"""


def _calendars(spark, sf_dir):
    """One calendar file for each order."""
    o = model.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    text = key.cast("string")
    when = F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 12 + 11 as int), 0, 0)")
    start = F.when(key % 7 == 0, F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(when, "yyyyMMdd"))).otherwise(F.concat(F.lit("DTSTART;TZID=Europe/London:"), F.date_format(when, "yyyyMMdd'T'HHmmss")))
    lines = (F.lit("BEGIN:VCALENDAR"), F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:uid-"), text), F.concat(F.lit("SUMMARY:Show\\, num\r\n ber "), text), start, F.when(key % 5 == 0, "STATUS:CANCELLED").otherwise("STATUS:CONFIRMED"), F.lit("END:VEVENT"), F.lit("END:VCALENDAR"))
    files = o.select(F.concat(F.lit("https://c.test/"), text).alias("url"), F.encode(F.concat_ws("\r\n", *lines), "UTF-8").alias("body"))
    return files


@query(_CALENDARS)
def calendar_files(spark, sf_dir):
    """One calendar file for each order, written and read."""
    return extract.ics_candidates(_calendars(spark, sf_dir)).select("url_of_body", "kind", "uid", "summary", "start_at", "reason")


@query(_CALENDARS)
def calendars_in_sql(spark, sf_dir):
    """The same without Python."""
    files = _calendars(spark, sf_dir).withColumnRenamed("url", "url_of_body")
    return ics.ics_rows(files, ("url_of_body",)).select("url_of_body", "kind", "uid", "summary", "start_at", "reason")


@query(f"""SELECT 'https://p.test/' || o_orderkey || '/' AS url_of_body, CASE WHEN o_orderkey % 5 = 0 THEN 'skip' ELSE 'candidate' END AS kind, 'Fish & Chips ' || o_orderkey AS summary,
CASE WHEN o_orderkey % 5 > 0 THEN 'https://p.test/event/' || o_orderkey END AS url, CASE WHEN o_orderkey % 5 > 0 THEN strftime(timezone('UTC', timezone('Europe/London', {_LOCAL})), '%Y-%m-%dT%H:%M:%SZ') END AS start_at,
CASE WHEN o_orderkey % 5 = 0 THEN 'missing event end time' END AS reason FROM orders""")
def schema_org_pages(spark, sf_dir):
    """One page with schema.org data for each order, written and read."""
    o = model.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    text = key.cast("string")
    when = F.date_format(F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 12 + 11 as int), 0, 0)"), "yyyy-MM-dd'T'HH:mm")
    node = F.struct(F.array(F.lit("Thing"), F.lit("event")).alias("@type"), F.concat(F.lit("Fish &amp; Chips "), text).alias("name"), F.concat(F.lit("/event/"), text).alias("url"), when.alias("startDate"), F.when(key % 5 > 0, when).alias("endDate"), F.struct(F.lit("Hall").alias("name")).alias("location"))
    page = F.concat(F.lit("<html><script type=\"application/ld+json\">"), F.to_json(F.struct(F.array(node).alias("@graph"))), F.lit("</script></html>"))
    files = o.select(F.concat(F.lit("https://p.test/"), text, F.lit("/")).alias("url"), F.encode(page, "UTF-8").alias("body"))
    return extract.jsonld_candidates(files, 20).select("url_of_body", "kind", "summary", "url", "start_at", "reason")


@query("""WITH RECURSIVE chain AS (SELECT o_orderkey AS id, CAST(o_orderkey % 12 AS INT) AS n, o_orderkey % 13 = 0 AS round, o_orderkey % 17 = 0 AS gone FROM orders),
hop AS (SELECT id, CAST(unnest(range(0, n)) AS INT) AS i, n, round FROM chain UNION ALL SELECT id, n, n, round FROM chain WHERE round),
walk AS (SELECT id, 0 AS at, 0 AS hops FROM chain
  UNION ALL SELECT w.id, CASE WHEN h.i = h.n THEN 0 ELSE h.i + 1 END, w.hops + 1 FROM walk w JOIN hop h ON h.id = w.id AND h.i = w.at WHERE w.hops < 30),
last AS (SELECT id, max(hops) AS hops FROM walk GROUP BY id)
SELECT c.id, CASE WHEN hops < 10 THEN 'https://x.test/' || c.id || '/' || n END AS final_url, CASE WHEN hops < 10 THEN CAST(hops AS BIGINT) END AS hops, CASE WHEN hops < 10 AND NOT gone THEN '200 OK' END AS status,
  CASE WHEN hops < 10 AND NOT gone THEN 'page ' || c.id END AS body, CASE WHEN hops >= 10 THEN 'stopped after 10 redirects' WHEN gone THEN 'no recorded exchange' END AS error, round AS loop FROM chain c JOIN last ON last.id = c.id""")
def fetch_results(spark, sf_dir):
    """Fetches from recorded exchanges: for each order a chain of up to eleven redirects, some of them in a
    circle and some that end at an address that was not recorded."""
    o = model.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    n, text = (F.col("id") % 12).cast("int"), F.col("id").cast("string")
    url = lambda i: F.concat(F.lit("https://x.test/"), text, F.lit("/"), i.cast("string"))
    steps = o.select("id", n.alias("n"), F.explode(F.sequence(F.lit(0), n)).alias("i"))
    i, end, circle = F.col("i"), F.col("i") == F.col("n"), F.col("id") % 13 == 0
    onward = F.when(end, url(F.lit(0))).when(F.col("id") % 2 == 0, (i + 1).cast("string")).otherwise(url(i + 1))
    moves = ~end | circle
    rows = steps.filter(~(end & ~circle & (F.col("id") % 17 == 0))).select(
        url(i).alias("url"), F.when(moves, "302 Found").otherwise("200 OK").alias("status"), F.when(moves, 302).otherwise(200).alias("status_code"), F.lit("text/plain").alias("content_type"), F.lit(-1).cast("long").alias("content_length"),
        F.when(moves, onward).alias("location"), F.lit(None).cast("string").alias("target"), F.lit("2026-04-19T09:00:00Z").alias("captured_at"), F.encode(F.when(~moves, F.concat(F.lit("page "), text)).otherwise(""), "UTF-8").alias("body"))
    exchanges.register(spark)
    folder = new_path(spark, "exchanges")
    exchanges.recorded(rows, folder)
    records = spark.read.format("exchanges").load(folder).filter(F.col("url").startswith("https://x.test/"))
    got = exchanges.fetched(o.select("id", url(F.lit(0)).alias("url")), records)
    return got.select("id", "final_url", "hops", "status", F.decode("body", "UTF-8").alias("body"), "error", "loop")


@query("""WITH part AS (SELECT page_id, url, unnest(string_split(html, '<a ')) AS p, generate_subscripts(string_split(html, '<a '), 1) AS i FROM pages),
link AS (SELECT page_id, i, substr(p, strpos(p, 'href="') + 6) AS h FROM part WHERE i > 1 AND strpos(p, 'href="') > 0 AND strpos(p, '</a>') > 0),
found AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS position, substr(h, 1, strpos(h, '"') - 1) AS href FROM link)
SELECT 'anchor' AS part, page_id, position, href AS value FROM found
UNION ALL SELECT 'link', page_id, 0, 'https://cal.test/' || page_id || '.ics' FROM pages
UNION ALL SELECT 'event', page_id, 0, 'Page ' || page_id || ' ' || CASE WHEN page_id % 3 = 0 THEN 'cancelled' ELSE '2026-05-01T19:00:00Z' END FROM pages
UNION ALL SELECT 'node', page_id, 0, CASE WHEN page_id % 2 = 0 THEN 'Node ' || page_id || ' https://p.test/e' ELSE 'no schema.org Event objects found in application/ld+json' END FROM pages""")
def lateral_extract(spark, sf_dir):
    """The extractors in SQL, over pages to which a calendar link, a calendar and a script were added."""
    tables.register(spark)
    p = model.table(spark, sf_dir, "pages")
    text = F.col("page_id").cast("string")
    link = F.concat(F.lit("<a href='https://cal.test/"), text, F.lit(".ics'>Google Calendar ICS</a>"))
    kind = F.when(F.col("page_id") % 2 == 0, "Event").otherwise("Person")
    node = F.to_json(F.struct(kind.alias("@type"), F.concat(F.lit("Node "), text).alias("name"), F.lit("/e").alias("url"), F.lit("2026-05-10T19:30").alias("startDate"), F.lit("2026-05-10T23:00").alias("endDate"), F.lit("Hall").alias("location")))
    calendar = F.concat(F.lit("BEGIN:VEVENT\nSUMMARY:Page "), text, F.lit("\nDTSTART:20260501T190000Z\n"), F.when(F.col("page_id") % 3 == 0, "STATUS:CANCELLED\n").otherwise(""), F.lit("END:VEVENT"))
    rows = p.select("page_id", "html", F.concat("html", link).alias("linked"), F.concat("html", F.lit('<script type="application/ld+json">'), node, F.lit("</script>")).alias("scripted"), calendar.alias("calendar"))
    return spark.sql("""
        SELECT 'anchor' AS part, page_id, position, href AS value FROM {p}, LATERAL anchors(html)
        UNION ALL SELECT 'link', page_id, position, link FROM {p}, LATERAL ics_links(linked, 'https://p.test/', 5)
        UNION ALL SELECT 'event', page_id, ordinal, concat_ws(' ', summary, coalesce(start_at, reason)) FROM {p}, LATERAL ics_events(calendar)
        UNION ALL SELECT 'node', page_id, ordinal, coalesce(reason, concat_ws(' ', summary, url)) FROM {p}, LATERAL schema_org_events(scripted, 'https://p.test/', 5)""", p=rows)


@query("""WITH part AS (SELECT page_id, url, unnest(string_split(html, '<a ')) AS p, generate_subscripts(string_split(html, '<a '), 1) AS i FROM pages),
link AS (SELECT page_id, url, i, substr(p, strpos(p, 'href="') + 6) AS h FROM part WHERE i > 1 AND strpos(p, 'href="') > 0 AND strpos(p, '</a>') > 0),
found AS (SELECT page_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS position, substr(h, 1, strpos(h, '"') - 1) AS href FROM link)
SELECT page_id, position, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/]*') || href ELSE regexp_extract(url, '^[a-z]+://[^/]*') || '/x/' || href END AS link,
regexp_extract(url, '^[a-z]+://[^/]*') || '/b/' || CASE WHEN href LIKE '/%' THEN substr(href, 2) ELSE href END || '?q#f' AS dotted FROM found""")
def resolved_links(spark, sf_dir):
    """The links of pages as whole addresses, and others with dot segments, resolved without Python."""
    p = model.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract.anchors(p, "page_id").join(p.select("page_id", "url"), "page_id")
    base = F.concat(F.regexp_extract("url", "^[a-z]+://[^/]*", 0), F.lit("/x/y?z"))
    dotted = F.concat(F.lit("../a/.././b/./c/../"), F.regexp_replace("href", "^/", ""), F.lit("?q#f"))
    return found.select("page_id", "position", resolved(base, F.col("href")).alias("link"), resolved(base, dotted).alias("dotted"))
