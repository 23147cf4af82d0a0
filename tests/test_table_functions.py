"""Table functions in SQL against the DataFrame forms of the extractors."""

import pytest
from pyspark.sql import functions as F

from marquee.functions import tables
from marquee.sources import extract

PAGES = [
    ("https://s.test/e/", "<a href='/a.ics'>Google Calendar ICS</a> <a href=b?format=ical>ICS</a><a href='/a.ics'>Google <b>Calendar</b> ICS</a><a href='/c'>No</a>"),
    ("https://[bad", "<a href='/a.ics'>Google Calendar ICS</a>"),
    ("https://s.test/", "<script type='application/ld+json'>[{\"@type\":\"Event\",\"name\":\"One\",\"startDate\":\"2026-05-10T19:30\",\"endDate\":\"2026-05-10T23:00\",\"location\":\"Hall\",\"url\":\"x\"},{\"@type\":\"Event\",\"name\":\"Two\"}]</script><script type='application/ld+json'>{bad</script>"),
    ("https://s.test/", ""),
    (None, "<a href=x>y</a>"),
    ("https://s.test/", None),
]
CALENDARS = [b"BEGIN:VEVENT\r\nSUMMARY:One\r\nDTSTART:20260501T190000Z\r\nEND:VEVENT\r\nEND:VEVENT", b"", None, b"BEGIN:VEVENT\nBEGIN:VEVENT\n\xff\nSUMMARY:\xff\nDTSTART:1\nEND:VEVENT"]


@pytest.fixture
def pages(spark):
    tables.register(spark)
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(PAGES)], "id long, url string, html string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_functions_give_the_rows_of_the_dataframe_forms(spark, pages):
    sql = lambda text: spark.sql(text, p=pages)
    assert rows(sql("SELECT id, position, href, label FROM {p}, LATERAL anchors(html)")) == rows(extract.anchors(pages, "id"))
    for limit in (1, 5):
        links = sql(f"SELECT id, position, link, l.reason FROM {{p}}, LATERAL ics_links(html, url, {limit}) l")
        assert rows(links) == rows(extract.ics_links(pages, "id", limit))
    own = [c.split()[0] for c in extract.ROWS.split(", ")]
    named = ", ".join(f"e.{c}" for c in own)
    bodies = spark.createDataFrame([(str(i), b if b is None else bytearray(b)) for i, b in enumerate(CALENDARS)], "url string, body binary")
    assert rows(spark.sql(f"SELECT c.url, {named} FROM {{c}} c, LATERAL ics_events(body) e", c=bodies)) == rows(extract.ics_candidates(bodies))
    whole = pages.select("url", F.encode("html", "UTF-8").alias("body"))
    assert rows(sql(f"SELECT p.url, {named} FROM {{p}} p, LATERAL schema_org_events(html, url, 3) e")) == rows(extract.jsonld_candidates(whole, 3))


def test_pages_without_rows(spark, pages):
    assert spark.sql("SELECT DISTINCT id FROM {p}, LATERAL anchors(html)", p=pages).count() == 3
    assert spark.sql("SELECT id FROM {p}, LATERAL anchors(html)", p=pages.limit(0)).isEmpty()


@pytest.mark.parametrize("call", ["anchors(id)", "ics_links(html, url, 0)", "ics_links(html, url, 51)", "ics_links(html, url, id)", "ics_links(html, url, 'x')", "ics_events(id)", "schema_org_events(html, url, CAST(NULL AS INT))", "schema_org_events(html, 1, 2)"])
def test_arguments_are_checked_before_anything_runs(spark, pages, call):
    with pytest.raises(Exception, match="limit|is string|is binary"):
        spark.sql(f"SELECT * FROM {{p}}, LATERAL {call}", p=pages)
