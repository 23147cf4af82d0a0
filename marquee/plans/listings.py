"""Catalogue and calendar queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import first_non_empty, folded, origin_label, origin_run_id, slug, strip_tags, venue_slug
from marquee.functions.time import labels, local_day
from marquee.operators import calendar, catalog
from marquee.plans import model
from marquee.plans.registry import query
from marquee.sources import seed

TODAY = date(1998, 5, 10)
_DAY = "DATE '1998-05-10'"
_STAR = ("id", "slug", "venue_id", "source_id", "name", "start_at", "end_at", "genre", "status", "venue_slug", "source_name", "source_url")
_ALL = ", ".join(_STAR)


def _star(spark, sf_dir) -> DataFrame:
    return catalog.events_star(model.events(spark, sf_dir), model.venues(spark, sf_dir), model.sources(spark, sf_dir)).select(*_STAR)


@query(f"{model.SQL} SELECT {_ALL} FROM star ORDER BY start_at, slug")
def events_star(spark, sf_dir):
    return _star(spark, sf_dir)


@query(f"{model.SQL} SELECT {_ALL} FROM star WHERE venue_slug = 'customer-000000007' ORDER BY start_at, slug")
def events_for_venue(spark, sf_dir):
    return catalog.events_for_venue(_star(spark, sf_dir), "customer-000000007")


@query(f"{model.SQL} SELECT {_ALL} FROM star WHERE slug = 'order-42' LIMIT 1")
def event_by_slug(spark, sf_dir):
    return catalog.by_slug(_star(spark, sf_dir), "order-42")


@query(f"{model.SQL} SELECT * FROM venue WHERE slug = 'customer-000000007' LIMIT 1")
def venue_by_slug(spark, sf_dir):
    return catalog.by_slug(model.venues(spark, sf_dir), "customer-000000007")


@query(f"{model.SQL}, wanted AS (SELECT c_custkey AS customer, CASE WHEN c_custkey % 3 = 0 THEN 'https://elsewhere.test/' ELSE (SELECT url FROM source WHERE id = c_nationkey) END AS url, (SELECT name FROM source WHERE id = c_nationkey) AS name FROM customer) SELECT customer, wanted.name, wanted.url, source.id FROM wanted LEFT JOIN source ON source.name = wanted.name AND source.url = wanted.url")
def source_id_lookup(spark, sf_dir):
    own, c = model.sources(spark, sf_dir), model.table(spark, sf_dir, "customer")
    url = F.when(F.col("c_custkey") % 3 == 0, "https://elsewhere.test/").otherwise(F.col("url"))
    wanted = c.join(own, c["c_nationkey"] == own["id"]).select(F.col("c_custkey").alias("customer"), "name", url.alias("url"))
    return catalog.source_id(own, wanted).select("customer", "name", "url", "id")


@query(f"{model.SQL} SELECT id, slug, venue_id FROM listing WHERE venue_id NOT IN (SELECT id FROM venue WHERE neighbourhood <> 'BUILDING') ORDER BY id LIMIT 1")
def dangling_venue(spark, sf_dir):
    known = model.venues(spark, sf_dir).filter("neighbourhood != 'BUILDING'")
    return catalog.dangling(model.events(spark, sf_dir), "venue_id", known).select("id", "slug", "venue_id")


@query(f"{model.SQL} SELECT id, slug, source_id FROM listing WHERE source_id NOT IN (SELECT id FROM source WHERE id <> 13) ORDER BY id LIMIT 1")
def dangling_source(spark, sf_dir):
    return catalog.dangling(model.events(spark, sf_dir), "source_id", model.sources(spark, sf_dir).filter("id != 13")).select("id", "slug", "source_id")


@query("SELECT count(*) AS n FROM orders")
def count_rows(spark, sf_dir):
    return catalog.row_count(model.table(spark, sf_dir, "orders"))


@query("SELECT coalesce(max(o_orderkey), 0) AS version, 'all' AS rows FROM orders UNION ALL SELECT 0, 'none'")
def max_version(spark, sf_dir):
    o = model.table(spark, sf_dir, "orders")
    none = catalog.max_version(o.filter("o_orderkey < 0"), "o_orderkey")
    return catalog.max_version(o, "o_orderkey").withColumn("rows", F.lit("all")).unionByName(none.withColumn("rows", F.lit("none")))


@query(f"{model.SQL} SELECT c_nationkey % 5 AS nation, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def unique_key_violations(spark, sf_dir):
    c = model.table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("nation"), F.col("c_mktsegment").alias("segment"))
    return catalog.duplicates(c, "nation", "segment")


@query("""WITH log AS (SELECT o_custkey AS customer, o_orderpriority AS priority, o_orderkey AS version, o_orderstatus AS status, o_totalprice AS price FROM orders)
SELECT customer, priority, version, status, price FROM log QUALIFY row_number() OVER (PARTITION BY customer, priority ORDER BY version DESC) = 1""")
def upsert_latest(spark, sf_dir):
    o = model.table(spark, sf_dir, "orders")
    log = o.select(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    return catalog.latest(log, ["customer", "priority"], "version").select("customer", "priority", "version", "status", "price")


@query("""SELECT k AS staging_key, k NOT IN (SELECT 'v1:' || o_orderkey % 700 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0) AS created
FROM (SELECT DISTINCT 'v1:' || (o_orderkey % 700) AS k FROM orders WHERE o_orderstatus = 'O')""")
def insert_new_groups(spark, sf_dir):
    key = F.concat(F.lit("v1:"), (F.col("o_orderkey") % 700).cast("string")).alias("staging_key")
    o = model.table(spark, sf_dir, "orders")
    return catalog.insert_new(o.filter("o_orderstatus = 'F' and o_orderkey % 2 = 0").select(key), o.filter("o_orderstatus = 'O'").select(key), "staging_key")


@query(f"{model.SQL} SELECT name, url, CASE WHEN id < 25 THEN id END AS known_id, count(*) OVER () AS n, true AS in_range, 1 AS with_id FROM (SELECT id, name, url FROM source UNION ALL SELECT DISTINCT 99, p_brand, p_type FROM part)")
def ensure_source(spark, sf_dir):
    """Old sources keep their ids; the new ones have ids of their own that go on without gaps."""
    own, p = model.sources(spark, sf_dir), model.table(spark, sf_dir, "part")
    wanted = p.select(F.col("p_brand").alias("name"), F.col("p_type").alias("url")).unionByName(own.select("name", "url"))
    found = catalog.ensure_source(own, wanted)
    n = found.agg(F.count("*").alias("n"))
    per_id = found.groupBy("id").agg(F.count("*").cast("int").alias("with_id"))
    return found.join(per_id, "id").crossJoin(n).select("name", "url", F.when(F.col("id") < 25, F.col("id")).alias("known_id"), "n", F.col("id").between(0, F.col("n") - 1).alias("in_range"), "with_id")


@query(f"""{model.SQL} SELECT slug, venue_slug, name, genre, start_at, end_at, source_name, source_url, '' AS origin FROM star UNION ALL
SELECT slug, venue_slug, name, genre, start_at, end_at, source_name, CASE venue_slug WHEN 'leadmill' THEN 'https://leadmill.co.uk/events/live-music/' WHEN 'yellow-arch' THEN 'https://www.yellowarch.com/events/' ELSE 'https://www.sidneyandmatilda.com/' END, 'Seed data' FROM (VALUES
('matinee-noise-at-the-leadmill', 'leadmill', 'Matinee Noise', 'Indie / alt', '2026-05-08T18:30:00Z', '2026-05-08T22:00:00Z', 'The Leadmill live music listings'),
('neepsend-afterhours', 'yellow-arch', 'Abbeydale Afterhours', 'Jazz / soul', '2026-05-14T19:00:00Z', '2026-05-14T22:30:00Z', 'Yellow Arch what''s on'),
('courtyard-wildcards', 'sidney-and-matilda', 'Courtyard Wildcards', 'Punk / garage', '2026-05-22T17:45:00Z', '2026-05-22T21:45:00Z', 'Sidney & Matilda listings'),
('leadmill-late-room', 'leadmill', 'Late Room', 'DJ / club', '2026-06-05T21:00:00Z', '2026-06-06T00:00:00Z', 'The Leadmill live music listings')) AS t(slug, venue_slug, name, genre, start_at, end_at, source_name)""")
def seed_star(spark, sf_dir):
    """The star of the given tables with the seed in it."""
    columns = ("slug", "venue_slug", "name", "genre", "start_at", "end_at", "source_name", "source_url")
    seeded = catalog.events_star(seed.events(spark), seed.venues(spark), seed.sources(spark)).select(*columns, origin_label(F.col("origin")).alias("origin"))
    return _star(spark, sf_dir).select(*columns, origin_label(F.lit("live")).alias("origin")).unionByName(seeded)


def _page(spark, sf_dir, window, venue=""):
    star, venues = _star(spark, sf_dir), model.venues(spark, sf_dir)
    found = calendar.in_window(calendar.at_venue(star, venue, venues), window, TODAY)
    return calendar.displayed(found).select("id", "slug", "venue_slug", "start_at", local_day(F.col("start_at")).cast("string").alias("local_date"))


_PAGE = f"{model.SQL} SELECT id, slug, venue_slug, start_at, CAST(local_day AS VARCHAR) AS local_date FROM star WHERE local_day >= {_DAY}"


@query(f"{_PAGE} ORDER BY start_at, slug")
def calendar_all(spark, sf_dir):
    return _page(spark, sf_dir, "all")


@query(f"{_PAGE} AND local_day < {_DAY} + 1 ORDER BY start_at, slug")
def calendar_today(spark, sf_dir):
    return _page(spark, sf_dir, "today")


@query(f"{_PAGE} AND local_day < {_DAY} + 7 ORDER BY start_at, slug")
def calendar_week(spark, sf_dir):
    return _page(spark, sf_dir, "week", "no-such-venue")


@query(f"{_PAGE} AND venue_slug = 'customer-000000007' ORDER BY start_at, slug")
def venue_page(spark, sf_dir):
    return calendar.venue_page(_star(spark, sf_dir), "customer-000000007", TODAY).select("id", "slug", "venue_slug", "start_at", local_day(F.col("start_at")).cast("string").alias("local_date"))


@query(f"{model.SQL} SELECT CAST(local_day AS VARCHAR) AS local_date, count(*) AS n, string_agg(slug, ',' ORDER BY start_at, slug) AS slugs FROM star WHERE local_day >= {_DAY} AND local_day < {_DAY} + 7 GROUP BY ALL ORDER BY 1")
def group_by_local_date(spark, sf_dir):
    star = _star(spark, sf_dir)
    days = calendar.day_lines(calendar.events_page(star, model.venues(spark, sf_dir), "week", "", TODAY))
    return days.select(F.col("local_date").cast("string").alias("local_date"), "n", F.array_join("slugs", ",").alias("slugs"))


@query(f"""{model.SQL}, coming AS (SELECT * FROM star WHERE local_day >= {_DAY})
SELECT * FROM (SELECT 'featured' AS part, slug FROM coming ORDER BY start_at, slug LIMIT 1) UNION ALL SELECT * FROM (SELECT 'top', slug FROM coming ORDER BY start_at, slug LIMIT 3)
UNION ALL SELECT 'today', slug FROM coming WHERE local_day = {_DAY} UNION ALL SELECT 'week', slug FROM coming WHERE local_day > {_DAY} AND local_day < {_DAY} + 7""")
def home(spark, sf_dir):
    parts = calendar.home(_star(spark, sf_dir), TODAY)
    rows = [parts[p].select(F.lit(p).alias("part"), "slug") for p in ("featured", "top", "today", "week")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query(f"{model.SQL} SELECT star.slug, star.start_at, venue.name AS venue_name, venue.neighbourhood FROM star JOIN venue ON venue.slug = star.venue_slug WHERE star.slug = 'order-42'")
def event_page(spark, sf_dir):
    page = calendar.event_page(_star(spark, sf_dir), model.venues(spark, sf_dir), "order-42")
    return page.select("slug", "start_at", F.col("venue.name").alias("venue_name"), F.col("venue.neighbourhood").alias("neighbourhood"))


_TS = "timezone('Europe/London', timezone('UTC', o_orderdate + to_hours(o_orderkey % 24)))"


@query(f"SELECT o_orderkey AS id, strftime({_TS}, '%A, %-d %B %Y') AS date_long, strftime({_TS}, '%a %-d %b') AS date_short, strftime({_TS}, '%H:%M') AS time_short, strftime({_TS}, '%Y') AS year FROM orders")
def time_labels(spark, sf_dir):
    e = model.events(spark, sf_dir)
    return e.select("id", *(c.alias(n) for n, c in labels(F.col("start_at")).items()))


@query(r"""SELECT p_partkey AS id, trim(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
lower(trim(regexp_replace('  ' || p_name || '   x ', '\s+', ' ', 'g'))) AS folded, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS first,
CASE WHEN p_size % 3 = 0 THEN 'yellow-arch' ELSE trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') END AS venue_slug, ' ' || p_name || ' ' AS plain FROM part""")
def text_functions(spark, sf_dir):
    p = model.table(spark, sf_dir, "part")
    name = F.col("p_name")
    place = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" The Yellow Arch "), F.col("p_brand"))).otherwise(F.col("p_brand"))
    return p.select(
        F.col("p_partkey").alias("id"),
        slug(F.concat(name, F.lit(" & "), F.col("p_brand"))).alias("slug"),
        folded(F.concat(F.lit("  "), name, F.lit("  \t x\n"))).alias("folded"),
        first_non_empty(F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lit("  ")), name).alias("first"),
        venue_slug(place).alias("venue_slug"),
        strip_tags(F.concat(F.lit("<b class='x'>"), name, F.lit("</B>"))).alias("plain"),
    )


@query(r"SELECT doc_id, lower(trim(regexp_replace(text, '[\s\p{Z}\x{85}\x0B]+', ' ', 'g'))) AS folded FROM documents")
def normalize_text(spark, sf_dir):
    return model.table(spark, sf_dir, "documents").select("doc_id", folded(F.col("text")).alias("folded"))


@query(f"{model.SQL} SELECT id, origin_run_id, notes FROM grp_run")
def parse_origin_run(spark, sf_dir):
    return model.groups(spark, sf_dir).select("id", origin_run_id(F.col("notes")).alias("origin_run_id"), "notes")


