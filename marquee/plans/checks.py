"""Store checks, seed and registry, landed files, runs over them, fixtures, labels and paths."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from marquee.functions.text import blank_label, candidate_count_label, count_label, origin_label, strict_id
from marquee.operators import catalog, maintained, replay, runs, staging
from marquee.plans import model
from marquee.plans.registry import query
from marquee.sources import envelope, extract, seed
from marquee.store.place import new_path, written


@query("SELECT page_id, sha256(html || chr(10)) AS sha256, octet_length(encode(html)) + 1 AS n FROM pages")
def landed_pages(spark, sf_dir):
    """Pages written as a file each, and landed. A page without html has no file."""
    pages = model.table(spark, sf_dir, "pages").select("page_id", "html")
    named = pages.filter("html is not null").select(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(".html")).alias("name"), F.concat("html", F.lit("\n")).cast("binary").alias("content"))
    folders = envelope.land(named, new_path(spark, "landed"))
    files = envelope.landed_files(spark, folders).coalesce(max(len(folders), spark.sparkContext.defaultParallelism))
    page = F.expr(r"try_cast(regexp_extract(url, '/[0-9]+-(-?[0-9]*)[.]html$', 1) as long)")
    rows = files.select(page.alias("page_id"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("n"))
    return rows.unionByName(pages.filter("html is null").select("page_id", F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("long").alias("n")))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 2 THEN 'Sidney & Matilda listings' WHEN o_orderkey % 5 = 2 THEN 'Yellow Arch listings' END AS source_name, CASE WHEN o_orderkey % 5 < 2 THEN 'linked_ics' WHEN o_orderkey % 5 = 2 THEN 'source_page' END AS page_mode,
CASE WHEN o_orderkey % 5 > 2 THEN 'unsupported source ' || CASE o_orderkey % 5 WHEN 3 THEN 'Yellow-Arch' ELSE 'elsewhere' END END AS error FROM orders""")
def source_registry(spark, sf_dir):
    """The source that a run of each order asks for by its key."""
    key = F.element_at(F.array(*map(F.lit, ("  ", "sidney-and-matilda", " yellow-arch ", "Yellow-Arch", "elsewhere"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    wanted = model.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), key.alias("key"))
    return seed.configured(wanted, seed.registry(spark)).select("id", "source_name", "source_page_mode", "error").withColumnRenamed("source_page_mode", "page_mode")


@query(f"""{model.SQL}, file AS (
  SELECT l_orderkey AS id, l_linenumber AS n, CAST(min(l_quantity) AS BIGINT) % 4 AS c, l_linenumber % 3 AS s, max(l_returnflag) = 'R' AS bad, min(l_partkey) % 50 = 0 AS gone, min(l_suppkey) % 20 = 0 AS cut, l_linenumber = 5 AS http FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL
), page AS (SELECT id, id % 2 = 0 AS linked, id % 11 = 0 AS gone, id % 13 = 0 AS cut, id % 11 > 0 AND id % 13 > 0 AS readable FROM run
), cal AS (
  SELECT page.id, n, NOT file.gone AS landed, 'https://c.test/' || page.id || '-' || n || '.ics' AS url, CASE WHEN file.gone OR file.cut OR http THEN 0 ELSE c END AS c, CASE WHEN file.gone OR file.cut OR http THEN 0 ELSE s END AS s,
         CASE WHEN file.gone THEN 'ICS did not land' WHEN file.cut THEN 'ICS response was truncated' WHEN http THEN 'ICS returned HTTP 500' WHEN bad THEN 'END:VEVENT without BEGIN:VEVENT' END AS error
  FROM page JOIN file ON file.id = page.id WHERE readable
  UNION ALL SELECT id, 0, true, 'https://s.test/' || id || '/', id % 5, id % 3, CASE WHEN id % 5 = 0 AND id % 3 = 0 THEN 'no schema.org Event objects found in application/ld+json' END FROM page WHERE readable AND NOT linked
), per AS (
  SELECT page.id, linked, gone, cut, readable, count(n) AS n, count(*) FILTER (landed) AS landed, CAST(coalesce(sum(c), 0) AS BIGINT) AS candidates, CAST(coalesce(sum(s), 0) AS BIGINT) AS skips, count(error) AS bad, coalesce(bool_or(error IS NULL AND c > 0), false) AS usable
  FROM page LEFT JOIN cal ON cal.id = page.id GROUP BY ALL
), said AS (
  SELECT *, CASE WHEN gone THEN 'source page did not land' WHEN cut THEN 'source page response was truncated' WHEN linked AND n = 0 THEN 'no ICS links found' WHEN NOT usable AND linked THEN 'no ICS calendars parsed successfully' WHEN NOT usable THEN 'no listings parsed successfully' END AS own FROM per
), worst AS (
  SELECT id, string_agg(url || ': ' || error, '; ' ORDER BY n) FILTER (r <= 3) AS line, count(*) AS bad FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS r FROM cal WHERE error IS NOT NULL) GROUP BY id
), told AS (SELECT said.*, CASE WHEN linked AND readable THEN n ELSE 0 END AS links, said.bad + CAST(own IS NOT NULL AS INT) AS errors, line, worst.bad AS many FROM said LEFT JOIN worst ON worst.id = said.id)
SELECT id AS run_id, links, CAST(NOT gone AS INT) + CASE WHEN linked THEN landed ELSE 0 END AS snapshots, candidates, skips, errors, CASE WHEN errors = 0 THEN 'succeeded' ELSE 'failed' END AS status,
  concat_ws('; ', 'links=' || links || ' candidates=' || candidates || ' skips=' || skips || ' errors=' || errors, own, line, CASE WHEN many > 3 THEN '... and ' || (many - 3) || ' more calendar errors' END) AS notes FROM told""")
def ingest_runs(spark, sf_dir):
    """A run over landed files for each order, with a source of its own: pages and calendars that did not land, are
    cut or hold errors."""
    key = F.concat(F.lit("s"), F.col("id").cast("string"))
    url = F.concat(F.lit("https://s.test/"), F.col("id").cast("string"), F.lit("/"))
    files = written(model.linked_files(spark, sf_dir).filter("id % 2 = 0"), "files")
    pages = model.run_pages(spark, sf_dir, files)
    mode = F.when(F.col("id") % 2 == 0, "linked_ics").otherwise("source_page")
    registry = pages.select(key.alias("key"), url.alias("url"), mode.alias("page_mode"))
    landed_page = pages.filter("id % 11 > 0").select(url.alias("url"), url.alias("final_url"), F.lit(200).alias("status_code"), (F.col("id") % 13 == 0).alias("truncated"), "body")
    calendars = files.filter("not gone")
    landed = written(landed_page.unionByName(calendars.select("url", F.col("url").alias("final_url"), F.when(F.col("http_500"), 500).otherwise(200).alias("status_code"), F.col("cut").alias("truncated"), "body")), "landed")
    wanted = pages.select(F.col("id").alias("run_id"), key.alias("source"))
    report = replay.ingest(wanted, landed, registry, 0, keep_pages=partial(written, name="pages"))
    return report.runs.select("run_id", "links", "snapshots", "candidates", "skips", "errors", "status", "notes")


@query("""SELECT 'fixtures/' || o_orderkey || '.ics' AS path, 'Fixture review: ' || o_orderkey || '.ics' AS title, 'file:fixtures/' || o_orderkey || '.ics' AS source_url, 1 + o_orderkey % 3 AS n_candidates,
'Show 0' || CASE WHEN o_orderkey % 3 > 0 THEN ',Show 1' ELSE '' END || CASE WHEN o_orderkey % 3 > 1 THEN ',Show 2' ELSE '' END AS names, CASE WHEN o_orderkey % 2 = 0 THEN 'fixture UID u0' ELSE 'fixture URL https://e.test/0' END AS provenance FROM orders WHERE o_orderkey % 4 > 0""")
def fixture_groups(spark, sf_dir):
    """A calendar file for each order as one group; every fourth holds a cancelled event alone, and no group."""
    text = F.col("o_orderkey").cast("string")
    told = lambda k: F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("UID:u"), k)).otherwise(F.concat(F.lit("URL:https://e.test/"), k))
    event = lambda k: F.concat(F.lit("BEGIN:VEVENT\nSUMMARY:Show "), k, F.lit("\n"), told(k), F.lit("\nDTSTART:20260501T190000Z\n"), F.when(F.col("o_orderkey") % 4 == 0, "STATUS:CANCELLED\n").otherwise(""), F.lit("END:VEVENT"))
    events = F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 3).cast("int")), lambda k: event(k.cast("string")))
    files = model.table(spark, sf_dir, "orders").select(F.concat(F.lit("fixtures/"), text, F.lit(".ics")).alias("path"), F.encode(F.array_join(events, "\n"), "UTF-8").alias("body"))
    rows = extract.ics_candidates(files, "path").filter("kind = 'candidate'").withColumnRenamed("ordinal", "candidate")
    groups, own = staging.fixture_groups(rows)
    names = own.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]), ",").alias("names"), F.min_by("provenance", "position").alias("provenance"))
    return groups.join(names, "path").select("path", "title", "source_url", "n_candidates", "names", "provenance")


@query("""WITH e AS (SELECT o_orderkey AS id, o_custkey % 1000 AS v, o_orderkey % 28 AS s, 'order-' || (o_orderkey - CASE WHEN o_orderkey % 100 = 3 THEN 1 ELSE 0 END) AS slug, o_orderkey % 50 = 7 AS bad FROM orders)
SELECT 'event without venue' AS problem, count(*) AS n, CAST(min(id) AS VARCHAR) AS first FROM e WHERE v NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 > 0)
UNION ALL SELECT 'event without source', count(*), CAST(min(id) AS VARCHAR) FROM e WHERE s > 24
UNION ALL SELECT 'malformed event time', count(*), CAST(min(id) AS VARCHAR) FROM e WHERE bad
UNION ALL SELECT 'repeated venue slug', count(*), min(c_name) FROM (SELECT lower(replace(c_name, '#', '-')) AS c_name FROM customer WHERE c_custkey % 500 = 1)
UNION ALL SELECT 'repeated event slug', count(*), min(slug) FROM (SELECT slug FROM e GROUP BY slug HAVING count(*) > 1)""")
def store_report(spark, sf_dir):
    """What is wrong with a store whose venues, sources, times and slugs were damaged."""
    key = F.col("id")
    events = model.events(spark, sf_dir).withColumns({
        "venue_id": F.col("venue_id") % 1000, "source_id": key % 28, "slug": F.concat(F.lit("order-"), (key - F.when(key % 100 == 3, 1).otherwise(0)).cast("string")), "start_at": F.when(key % 50 == 7, "19:30").otherwise(F.col("start_at"))})
    own = model.venues(spark, sf_dir)
    venues = own.filter("id % 7 > 0").unionByName(own.filter("id % 500 = 1").withColumn("id", -F.col("id") - 1)).unionByName(own.filter("id % 500 = 1 and id % 7 = 0").withColumn("id", -F.col("id") - 2))
    return catalog.store_report(events, venues, model.sources(spark, sf_dir))


@query("""SELECT 'kept' AS store, 'events' AS part, count(*) AS n, CAST(max(o_orderkey) AS VARCHAR) AS last FROM orders UNION ALL SELECT 'kept', 'venues', count(*), CAST(max(c_custkey) AS VARCHAR) FROM customer UNION ALL SELECT 'kept', 'sources', count(*), CAST(max(n_nationkey) AS VARCHAR) FROM nation
UNION ALL SELECT 'seeded', 'events', 4, '4' UNION ALL SELECT 'seeded', 'venues', 3, '3' UNION ALL SELECT 'seeded', 'sources', 3, '3'""")
def bootstrapped_store(spark, sf_dir):
    """A store with rows stays as it is; one without venues and events gets the seed."""
    own = (model.venues(spark, sf_dir), model.events(spark, sf_dir), model.sources(spark, sf_dir))
    parts = []
    for store, tables in (("kept", own), ("seeded", (own[0].filter("id < 0"), own[1].filter("id < 0"), own[2]))):
        for part, table in zip(("venues", "events", "sources"), seed.bootstrapped(*tables)):
            parts.append(table.agg(F.lit(store).alias("store"), F.lit(part).alias("part"), F.count("*").alias("n"), F.max("id").cast("string").alias("last")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""SELECT o_orderkey AS id, n || CASE WHEN n = 1 THEN ' snapshot' ELSE ' snapshots' END AS snapshots, CASE WHEN n = 1 THEN 'New listing review - 1 candidate' ELSE 'Duplicate review - ' || n || ' candidates' END AS candidates,
CASE o_orderkey % 5 WHEN 0 THEN 'Seed data' WHEN 1 THEN 'Test data' WHEN 2 THEN 'Development data' ELSE '' END AS origin, CASE WHEN o_orderkey % 3 = 0 THEN '(blank)' ELSE ' ' || o_orderpriority END AS shown
FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def labels(spark, sf_dir):
    n = model.snapshots(spark, sf_dir).groupBy(F.col("import_run_id").alias("id")).agg(F.count("*").alias("n"))
    o = model.table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id").join(n, "id")
    origin = F.element_at(F.array(*map(F.lit, ("seed", "test", "dev", "live", "Seed"))), (F.col("id") % 5 + 1).cast("int"))
    shown = F.when(F.col("id") % 3 == 0, " \t　").otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    return o.select("id", count_label(F.col("n"), "snapshot", "snapshots").alias("snapshots"), candidate_count_label(F.col("n")).alias("candidates"), origin_label(origin).alias("origin"), blank_label(shown).alias("shown"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 AND o_orderkey > 0 THEN o_orderkey END AS run_id FROM orders""")
def id_paths(spark, sf_dir):
    """Only plain digits after the prefix are an id."""
    text = F.col("o_orderkey").cast("string")
    forms = [F.concat(F.lit("/runs/"), text), F.concat(F.lit("/runs/"), text, F.lit("/")), F.concat(F.lit("/runs/+"), text), F.concat(F.lit("/run/"), text), F.concat(F.lit("/runs/"), text, F.lit("99999999999999999999")), F.concat(F.lit("/runs/-"), text)]
    path = F.element_at(F.array(*forms), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return model.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), strict_id(path, "/runs/").alias("run_id"))


@query("""SELECT o_orderkey AS run_id, '{"run_id":' || o_orderkey || ',"links":' || (o_orderkey % 6) || ',"errors":[' || CASE WHEN o_orderkey % 11 = 0 THEN '"page is gone"' ELSE '' END || ']}' AS report FROM orders""")
def run_json(spark, sf_dir):
    """A JSON report of each run."""
    rows = model.run_reports(spark, sf_dir)
    return runs.as_json(rows, indented=False).select(F.get_json_object("report", "$.run_id").cast("long").alias("run_id"), "report")


@query(f"""{model.SQL}, kept AS (SELECT import_run_id, count(*) AS n FROM snapshot WHERE id % 10 <> 3 OR import_run_id % 4 > 0 GROUP BY ALL),
c AS (SELECT venue_id AS g, count(*) AS n FROM listing WHERE id % 5 > 0 GROUP BY ALL), d AS (SELECT venue_id AS g, count(DISTINCT (id // 3) % 9) AS n FROM listing WHERE id % 3 = 0 AND id % 2 > 0 GROUP BY ALL),
s AS (SELECT origin_run_id AS run, CASE WHEN status = 'open' AND id % 5 = 0 THEN 'resolved' WHEN trim(status) = '' THEN 'unknown' ELSE status END AS s, count(*) AS n FROM grp_run WHERE origin_run_id IS NOT NULL GROUP BY ALL),
t AS (SELECT run, string_agg(n || ' ' || s, ', ' ORDER BY CASE s WHEN 'open' THEN 0 WHEN 'resolved' THEN 1 WHEN 'rejected' THEN 2 ELSE 3 END, s) AS summary FROM s GROUP BY run)
SELECT 'run' AS kind, run.id, CAST(coalesce(n, 0) AS VARCHAR) AS value FROM run LEFT JOIN kept ON import_run_id = run.id
UNION ALL SELECT 'group', grp.id, coalesce(c.n, 0) || ' ' || coalesce(d.n, 0) FROM grp LEFT JOIN c ON c.g = grp.id LEFT JOIN d ON d.g = grp.id
UNION ALL SELECT 'summary', run.id, coalesce(summary, 'none') FROM run LEFT JOIN t ON t.run = run.id""")
def maintained_counts(spark, sf_dir):
    """Counts by batches: rows come in two parts, and some of them go again."""
    store = maintained.open_counts(spark, new_path(spark, "counts"), 4)
    came, went = F.lit(1).alias("d"), F.lit(-1).alias("d")
    shots, e, g = model.snapshots(spark, sf_dir), model.events(spark, sf_dir), model.groups(spark, sf_dir)
    for part in ("id % 3 = 0", "id % 3 > 0"):
        maintained.count_snapshots(store, shots.filter(part).select("import_run_id", came))
    maintained.count_snapshots(store, shots.filter("id % 10 = 3 and import_run_id % 4 = 0").select("import_run_id", went))
    gone = e.filter("id % 5 = 0").select(F.col("venue_id").alias("group_id"), went)
    maintained.count_candidates(store, e.select(F.col("venue_id").alias("group_id"), came))
    maintained.count_candidates(store, gone)
    field = F.floor(F.col("id") / 3) % 9
    chosen = e.filter("id % 3 = 0").select("id", F.col("venue_id").alias("group_id"), field.cast("string").alias("field"))
    maintained.count_choices(store, chosen.filter("id % 7 < 4").select("group_id", "field", came))
    maintained.count_choices(store, chosen.filter("id % 7 >= 4").select("group_id", "field", came).unionByName(chosen.filter("id % 2 = 0").select("group_id", "field", went)))
    maintained.count_groups(store, g.select("notes", "status", came))
    closed = g.filter("status = 'open' and id % 5 = 0")
    maintained.count_groups(store, closed.select("notes", "status", went).unionByName(closed.select("notes", F.lit("resolved").alias("status"), came)))
    runs_now = model.runs(spark, sf_dir)
    counted = maintained.runs_with_counts(store, runs_now).select(F.lit("run").alias("kind"), "id", F.col("snapshot_count").cast("string").alias("value"))
    grouped = maintained.groups_with_counts(store, g).select(F.lit("group").alias("kind"), "id", F.concat_ws(" ", F.col("candidate_count").cast("string"), F.col("draft_count").cast("string")).alias("value"))
    return counted.unionByName(grouped).unionByName(maintained.status_summary(store, runs_now).select(F.lit("summary").alias("kind"), "id", F.col("summary").alias("value")))
