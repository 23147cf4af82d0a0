"""Golden cases of the operators."""

from datetime import date, datetime
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from marquee.functions.text import blank_label, count_label, origin_run_id, slug, trim, venue_slug
from marquee.functions.time import from_local, parse_rfc3339, rfc3339
from marquee.operators import calendar, catalog, reviews, runs, staging
from marquee.sources import envelope, extract, seed

# A calendar with a case of each kind.
ICS = b"""BEGIN:VCALENDAR
BEGIN:VEVENT
UID:utc-1
SUMMARY:First
DESCRIPTION:First line
 continued line
LOCATION:Sidney & Matilda
DTSTART:20260501T190000Z
DTEND:20260501T220000Z
END:VEVENT
BEGIN:VEVENT
UID:london-1
SUMMARY:Second\\, with comma
DTSTART;TZID=Europe/London:20260502T193000
END:VEVENT
BEGIN:VEVENT
UID:floating-1
SUMMARY:Third
DTSTART:20260503T2000
END:VEVENT
BEGIN:VEVENT
UID:all-day-1
SUMMARY:Fourth
DTSTART;VALUE=DATE:20260504
END:VEVENT
BEGIN:VEVENT
UID:cancelled-1
SUMMARY:Fifth
STATUS:cancelled
END:VEVENT
BEGIN:VEVENT
UID:missing-summary-1
DTSTART:20260503T200000
END:VEVENT
BEGIN:VEVENT
UID:bad-start-1
SUMMARY:Sixth
DTSTART:tomorrow night
END:VEVENT
END:VCALENDAR
"""


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_calendar_file():
    found = extract.parse_ics(ICS.replace(b"\n", b"\r\n"))
    assert [(r["kind"], r["uid"]) for r in found] == [("candidate", "utc-1"), ("candidate", "london-1"), ("candidate", "floating-1"), ("skip", "all-day-1"), ("skip", "cancelled-1"), ("skip", "missing-summary-1"), ("skip", "bad-start-1")]
    assert found[0]["description"] == "First linecontinued line" and found[0]["end_at"] == "2026-05-01T22:00:00Z"
    assert found[1]["start_at"] == "2026-05-02T18:30:00Z" and found[1]["summary"] == "Second, with comma"
    assert found[2]["start_at"] == "2026-05-03T19:00:00Z"
    assert [r["reason"].split(":")[0] for r in found[3:]] == ["all-day event", "cancelled", "missing summary", "malformed DTSTART"]


def test_broken_calendars():
    assert [r["reason"] for r in extract.parse_ics(b"END:VEVENT")] == ["END:VEVENT without BEGIN:VEVENT"]
    assert [r["reason"] for r in extract.parse_ics(b"BEGIN:VEVENT\nBEGIN:VEVENT\nSUMMARY:a")] == ["nested VEVENT", "unterminated VEVENT"]
    assert extract.parse_ics(b"") == []


def test_links(spark):
    page = """<a name=top>ICS</a><a class="x" href="/one.ics?name=S&amp;kind=live">Google Calendar ICS</a><a href='https://c.test/two.ics'> google <b>Calendar</b>
    ICS </a><a href=/three?FORMAT=x&format=ICAL>ics</a><a href="/four.ics">ICS</a><a href="/one.ics?name=S&amp;kind=live">Google Calendar ICS</a><a href="/five.ics">Apple Calendar ICS</a>
    <a title='a > b' href="it's.ics">Google Calendar ICS</a><a href="http://[bad">Google Calendar ICS</a><a href="/open.ics">Google Calendar ICS"""
    pages = spark.createDataFrame([(1, "https://s.test/events/", page), (2, "https://s.test/", None), (3, "https://[s", page), (4, "https://s.test/", "")], "id long, url string, html string")
    links = lambda n: [r["link"] for r in extract.ics_links(pages.filter("id != 3"), "id", n).orderBy("position").collect()]
    whole = ["https://s.test/one.ics?name=S&kind=live", "https://c.test/two.ics", "https://s.test/three?FORMAT=x&format=ICAL", "https://s.test/events/it's.ics"]
    assert links(10) == whole and links(1) == whole[:1] and links(3) == whole[:3]
    assert [r["reason"] for r in extract.ics_links(pages.filter("id = 3"), "id", 5).collect()] == ["bad page URL 'https://[s'"]


HOSTILE = {
    "open tags": "<a " * 350_000,
    "quotes": "<a x=\"" * 170_000,
    "quoted ends": '<a x=">" ' * 110_000,
    "declarations": "<!" * 500_000,
    "comments": "<!--" * 250_000,
    "less-than": "<" * 1_000_000,
    "digits": "&#" + "1" * 1_000_000 + ";",
    "zeros": "&#" + "0" * 1_000_000 + "65;",
    "anchors": "<a href=x>" * 100_000,
    "spaces": "<a" + " " * 1_000_000 + ">",
    "scripts": '<script type="application/ld+json">' * 28_000,
    "equals": "<a x=" * 200_000 + ">",
    "deep data": '<script type="application/ld+json">' + "[" * 900_000 + "</script>",
}


@pytest.mark.parametrize("name", list(HOSTILE))
def test_hostile_pages_take_linear_time(name):
    from time import process_time

    from marquee.functions.markup import Scanner, attributes, links, plain

    page = HOSTILE[name]
    start = process_time()
    n = len(list(Scanner(page).tags()))
    list(links(page))
    plain(page)
    attributes(page)
    extract.parse_ics_links(page, "https://x.test/", 50)
    extract.parse_jsonld(page, "https://x.test/", 5)
    assert process_time() - start < 12 and n >= 0  # six readings of a page of 1 MB


def test_scanner_reads_like_a_browser():
    from marquee.functions.markup import Scanner, attributes, unescape

    tags = lambda text: [(t.name, t.closing, t.rest) for t in Scanner(text).tags()]
    assert tags("<p>1 < 2<!-- <b> --><A HREF='>'></a ><![x]><i") == [("p", False, ""), ("a", False, " HREF='>'"), ("a", True, " ")]
    assert tags('<a x="y>z</a>') == [("a", False, ' x="y'), ("a", True, "")]
    assert attributes(" a=1 A=2 b c = 'x y' d=\"q\"") == {"a": ("1", False), "b": ("", False), "c": ("x y", True), "d": ("q", True)}
    assert unescape("&lt;&#65;&#x41;&#0000000065;&#99999999999;") == "<AAA\ufffd"


def script(body):
    return f'<script type="application/ld+json">{body}</script>'


def test_schema_org():
    event = '{"@type": "Event", "name": "A &amp;amp; B", "url": "/e/", "startDate": "2026-05-10T19:30:00+01:00", "endDate": "2026-05-10T23:00", "location": {"name": "Hall"}}'
    page = script('[{"@graph": [' + event + ', {"@type": ["Thing", "event"], "name": "No start"}]}, ' + event + "]")
    found = extract.parse_jsonld(page, "https://p.test/events/", 1)
    assert [r["kind"] for r in found] == ["candidate", "skip"]
    assert (found[0]["summary"], found[0]["url"], found[0]["start_at"], found[0]["end_at"]) == ("A & B", "https://p.test/e/", "2026-05-10T18:30:00Z", "2026-05-10T22:00:00Z")
    assert found[1]["reason"] == "missing event start time"
    assert [r["kind"] for r in extract.parse_jsonld(script('{"@graph": []}'), "", 5)] == ["error"]
    assert [r["reason"] for r in extract.parse_jsonld("<p>", "", 5)] == ["no application/ld+json event data found"]
    bad = extract.parse_jsonld(script(event.replace("2026-05-10T23:00", "2026-05-10")), "", 5)
    assert bad[0]["kind"] == "error"


def test_schema_org_order_and_broken_values():
    inner = '{"@type": [["Event"]], "name": "inner", "startDate": "2026-05-10T19:30", "endDate": "2026-05-10T23:00", "location": "Hall", "url": "http://[bad"}'
    outer = '{"@type": "Event", "name": "outer", "startDate": "0001-01-01T00:00:00+01:00", "endDate": "2026-05-10T23:00", "location": "Hall", "@graph": [' + inner + "]}"
    found = extract.parse_jsonld(script(outer), "https://p.test/", 1)
    assert [(r["kind"], r.get("summary")) for r in found] == [("error", None), ("candidate", "inner"), ("error", None)] and found[1]["url"] == "http://[bad"
    assert "start time of 'outer'" in found[2]["reason"]
    assert [r["kind"] for r in extract.parse_jsonld(script(inner.replace("inner", "a\\ud800b")), "https://p.test/", 1)] == ["error", "candidate"]
    for text in ("[" * 100_000, "NaN", "{", '{"a": ' * 5000 + "1" + "}" * 5000):
        rows = extract.parse_jsonld(script(text), "", 5)
        assert {r["kind"] for r in rows} == {"error"}
    unquoted = "<script type=application/ld+json>" + inner + "</script>"
    assert [r["reason"] for r in extract.parse_jsonld(unquoted, "", 5)] == ["no application/ld+json event data found"]
    assert extract.parse_ics(b"BEGIN:VEVENT\nSUMMARY:a\nDTSTART:00010101T000000\nEND:VEVENT")[0]["kind"] in ("skip", "candidate")
    assert extract.parse_ics(b"BEGIN:VEVENT\nSUMMARY:a\nDTSTART:99991231T235959\nDTEND:00000101T000000Z\nEND:VEVENT")[0]["reason"].startswith("malformed DTEND")


@pytest.mark.parametrize(("name", "expected"), [("  ", ""), ("Sidney & Matilda", "sidney-and-matilda"), ("Yellow Arch Studios", "yellow-arch"), ("Rivelin Works", "rivelin-works"), ("The Leadmill", "the-leadmill")])
def test_venue_slug(spark, name, expected):
    assert one(spark, venue_slug(F.lit(name))) == expected


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=40))
def test_trim_is_unicode(spark, texts):
    import re

    texts = [t.replace("\x00", "").encode("utf-8", "ignore").decode() for t in texts]
    space = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", trim(F.col("t")).alias("trim"), slug(F.col("t")).alias("slug"))
    for r in df.collect():
        assert r["trim"] == r["t"].strip(space)
        assert re.fullmatch("([a-z0-9]+(-[a-z0-9]+)*)?", r["slug"])


@pytest.mark.parametrize(("notes", "expected"), [("Created from manual ingest run 12 review staging.", 12), ("import run 12; manual ingest run 7", 7), ("run 123", None), ("import run 12abc", None), ("import run 0, import run 5", 5), ("import run 99999999999999999999", None), ("", None)])
def test_origin_run(spark, notes, expected):
    assert one(spark, origin_run_id(F.lit(notes))) == expected


def test_labels(spark):
    assert one(spark, blank_label(F.lit("  "))) == "(blank)"
    assert one(spark, count_label(F.lit(1), "snapshot", "snapshots")) == "1 snapshot"


@pytest.mark.parametrize(("local", "utc"), [("2026-10-25 01:30:00", "2026-10-25T01:30:00Z"), ("2026-03-29 01:30:00", "2026-03-29T01:30:00Z"), ("2026-06-01 12:00:00", "2026-06-01T11:00:00Z")])
def test_clock_changes(spark, local, utc):
    assert one(spark, rfc3339(from_local(F.to_timestamp(F.lit(local))))) == utc
    assert extract.ics_time({}, local.replace("-", "").replace(" ", "T").replace(":", ""))[0] == utc


def test_rfc3339(spark):
    read = lambda x: one(spark, rfc3339(parse_rfc3339(F.lit(x))))
    assert read("2026-05-10T19:30:00.25+01:00") == "2026-05-10T18:30:00Z"
    assert read("2026-05-10") is None and read("2026-13-10T00:00:00Z") is None


def test_calendar_windows(spark):
    starts = {"past": (18, 20, 0), "tonight": (19, 20, 0), "tomorrow": (20, 19, 30), "friday": (24, 21, 0), "later": (27, 20, 0)}
    utc = lambda d, h, m: datetime(2026, 4, d, h, m, tzinfo=ZoneInfo("Europe/London")).astimezone(ZoneInfo("UTC")).strftime("%Y-%m-%dT%H:%M:%SZ")
    events = spark.createDataFrame([(k, "yellow-arch" if k == "tomorrow" else "leadmill", utc(*v)) for k, v in starts.items()], "slug string, venue_slug string, start_at string")
    venues = spark.createDataFrame([("leadmill",), ("yellow-arch",), ("empty-room",)], "slug string")
    today = date(2026, 4, 19)
    names = lambda df: [r["slug"] for r in calendar.displayed(df).collect()]
    assert names(calendar.in_window(events, "all", today)) == ["tonight", "tomorrow", "friday", "later"]
    assert names(calendar.in_window(events, "today", today)) == ["tonight"]
    assert names(calendar.in_window(events, "week", today)) == ["tonight", "tomorrow", "friday"]
    assert names(calendar.in_window(calendar.at_venue(events, "leadmill", venues), "week", today)) == ["tonight", "friday"]
    assert names(calendar.at_venue(events, "nowhere", venues)) == names(events)
    assert names(calendar.at_venue(events, "empty-room", venues)) == []
    page = calendar.events_page(events, venues, "week", "", today)
    days = [date(2026, 4, 19), date(2026, 4, 20), date(2026, 4, 24)]
    assert [r["local_date"] for r in page.collect()] == days and [(r["local_date"], r["n"], r["slugs"]) for r in calendar.day_lines(page).collect()] == list(zip(days, (1, 1, 1), (["tonight"], ["tomorrow"], ["friday"])))


def rows_of(spark, *candidates):
    base = {"run_id": 42, "calendar": 0, "candidate": 0, "uid": "", "summary": "", "description": "", "location": "", "url": "", "status": "CONFIRMED", "start_at": "2026-05-01T19:00:00Z", "end_at": "", "source_name": "Feed", "calendar_url": "https://c.test/", "report_url": "https://r.test/"}
    return spark.createDataFrame([tuple((base | c).values()) for c in candidates], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in base.items()))


def test_clusters(spark):
    found = staging.clustered(rows_of(spark, {"uid": "a", "summary": "First listing"}, {"candidate": 1, "summary": "  Big   Night  "}, {"candidate": 2, "summary": "Singleton"}, {"calendar": 1, "uid": " a ", "summary": "Other", "start_at": "2027-01-01T00:00:00Z"}, {"calendar": 1, "candidate": 1, "summary": "big night"}, {"calendar": 1, "candidate": 2, "summary": " "})).collect()
    assert [(r["title"], r["n_candidates"]) for r in found] == [("Duplicate review: First listing", 2), ("Duplicate review: Big Night", 2), ("New listing review: Singleton", 1)]
    assert found[0]["notes"] == "Created from manual ingest run 42 review staging."
    assert found[0]["source_url"] == "https://c.test/" and found[0]["source_name"] == "Feed"
    assert all(r["staging_key"].startswith("v1:") for r in found)


def test_members_of_clusters(spark):
    own = staging.members(rows_of(spark, {"summary": "  Big   Night  ", "candidate": 3}, {"summary": "big night", "calendar": 1, "candidate": 0, "url": "https://e.test/"})).orderBy("position").collect()
    assert [(r["position"], r["name"], r["status"], r["source_url"]) for r in own] == [(1, "Big   Night", "Listed", "https://c.test/"), (2, "big night", "Listed", "https://e.test/")]
    assert [r["provenance"] for r in own] == ["import run 42; calendar https://c.test/", "import run 42; calendar https://c.test/; URL https://e.test/"]


def test_staging_creates_each_key_once(spark):
    found = staging.clustered(rows_of(spark, {"uid": "a", "summary": "x"}, {"run_id": 43, "uid": "a", "summary": "x"}, {"uid": "b", "summary": "y", "candidate": 1}, {"run_id": 44, "uid": "c", "summary": "z", "source_name": " "}))
    old = [r["staging_key"] for r in found.filter("key like '%b'").collect()]
    groups = spark.createDataFrame([(7, old[0]), (8, None)], "id long, staging_key string")
    done = staging.staged(groups, found)
    got = {(r["run_id"], r["key"][-1]): (r["id"], r["result"], r["error"]) for r in done.collect()}
    assert got == {(42, "a"): (9, "created", None), (43, "a"): (9, "reused", None), (42, "b"): (7, "reused", None), (44, "c"): (None, None, "review source name is required")}
    assert [tuple(r) for r in staging.stage_totals(done).orderBy("run_id").collect()] == [(42, 1, 1, 2, 0), (43, 0, 1, 1, 0), (44, 0, 0, 1, 1)]
    assert [(r["id"], r["status"], r["title"]) for r in staging.new_groups(done, F.lit("now")).collect()] == [(9, "open", "New listing review: x")]


def test_fixture_groups(spark, tmp_path):
    (tmp_path / "one.ics").write_bytes(ICS)
    files = envelope.landed_files(spark, str(tmp_path / "*.ics")).withColumnRenamed("content", "body")
    rows = extract.ics_candidates(files).filter("kind = 'candidate'").withColumnRenamed("ordinal", "candidate")
    group, own = staging.fixture_group(rows, "a/one.ics")
    assert (group.first()["title"], group.first()["source_url"]) == ("Fixture review: one.ics", "file:a/one.ics")
    assert [(r["position"], r["external_id"], r["provenance"], r["source_url"]) for r in own.orderBy("position").collect()] == [(k + 1, u, f"fixture UID {u}", "file:a/one.ics") for k, u in enumerate(("utc-1", "london-1", "floating-1"))]
    with pytest.raises(ValueError):
        staging.fixture_group(rows.filter("false"), "a/one.ics")


def test_staging_key_depends_on_content_alone(spark):
    key = lambda *c: staging.clustered(rows_of(spark, *c)).first()["staging_key"]
    a, b = {"uid": "a", "summary": "x"}, {"uid": "a", "summary": "y"}
    assert key({**a, "candidate": 0}, {**b, "candidate": 1}) == key({**b, "candidate": 0}, {**a, "candidate": 1}) == key({**a, "run_id": 7, "source_name": "Z"}, {**b, "run_id": 7, "candidate": 1})
    assert key(a) != key(b)


def test_runs(spark):
    table = spark.createDataFrame([(10, "2026-01-01", None, "succeeded"), (20, "2026-01-02", "2026-01-02", " SUCCEEDED "), (30, "2026-01-03", "2026-01-03", "failed"), (40, "2026-01-04", "  ", "succeeded")], "id long, started_at string, finished_at string, status string")
    shots = spark.createDataFrame([(40,), (40,), (40,), (20,), (20,)], "import_run_id long")
    assert [(r["id"], r["snapshot_count"]) for r in runs.recent_runs(table, shots, 3).collect()] == [(40, 3), (30, 0), (20, 2)]
    assert runs.latest_successful(table, shots).first()["id"] == 20
    assert runs.latest_successful(table.filter("id != 20"), shots).isEmpty()
    with pytest.raises(ValueError):
        runs.recent_runs(table, shots, 0)
    with pytest.raises(LookupError):
        runs.run_header(table, 99)
    assert runs.run_limit(0) == 20
    for bad in ((0, True), (51, False), (-1, False)):
        with pytest.raises(ValueError):
            runs.run_limit(*bad)


def test_envelopes(spark):
    files = spark.createDataFrame([(1, bytearray(b"hello" * 40)), (2, bytearray(b""))], "id long, content binary")
    for c in ("url", "final_url", "status", "content_type", "captured_at"):
        files = files.withColumn(c, F.lit(c))
    files = files.withColumn("status_code", F.lit(200)).withColumn("content_length", F.lit(5).cast("long"))
    sealed = envelope.seal(envelope.capture(files, limit=100)).select("id", "payload").cache()
    good = {r["id"]: r for r in envelope.unseal(sealed).collect()}
    assert bytes(good[1]["body"]) == b"hello" * 20 and good[1]["truncated"] and good[1]["error"] is None and not good[2]["truncated"]
    text = sealed.filter("id = 1").first()["payload"]
    cases = {"{": "malformed envelope", text.replace('"version":1', '"version":2'): "unsupported version", text.replace("aGVs", "%%%%", 1): "malformed body", text.replace("aGVs", "aGVt", 1): "hash mismatch", None: "malformed envelope"}
    made = spark.createDataFrame([(k,) for k in cases], "payload string")
    assert [r["error"] for r in envelope.unseal(made).collect()] == list(cases.values())


def test_source_registry():
    assert seed.source_config(" ")["key"] == "sidney-and-matilda" and seed.source_config("yellow-arch")["page_mode"] == "source_page"
    with pytest.raises(LookupError):
        seed.source_config("elsewhere")


def test_store_checks(spark):
    venues, sources, events = seed.venues(spark), seed.sources(spark), seed.events(spark)
    assert catalog.validate_store(events, venues, sources) == []
    assert catalog.validate_store(events, venues.filter("id > 1"), sources) == ["event without venue"]
    assert catalog.validate_store(events.unionByName(events), venues, sources.filter("id > 1")) == ["event without source", "repeated event slug"]
    assert not catalog.table_exists(spark, "nothing_here")


def test_ids_go_on(spark):
    own = spark.createDataFrame([(7, "a", "u")], "id long, name string, url string")
    wanted = spark.createDataFrame([("a", "u"), ("b", "u"), ("b", "u"), ("c", "v")], "name string, url string")
    assert sorted(r["id"] for r in catalog.ensure_source(own, wanted).collect()) == [7, 8, 9]
    assert sorted(r["id"] for r in catalog.ensure_source(own.limit(0), wanted).collect()) == [1, 2, 3]


def test_resolution(spark):
    fields = {f: f for f in reviews.FIELDS} | {"start_at": "2026-05-01T19:00:00Z", "end_at": "2026-05-01T20:00:00Z", "genre": "", "source_name": " "}
    candidate = spark.createDataFrame([(1, 5, 1, *fields.values())], "group_id long, id long, position long, " + ", ".join(f"{f} string" for f in fields))
    groups = spark.createDataFrame([(1, "open", "Desk", "https://desk.test/"), (2, "resolved", "", "")], "id long, status string, source_name string, source_url string")
    wanted = spark.createDataFrame([(1, f, 5) for f in fields], "group_id long, field string, candidate_id long")
    event = reviews.resolved_events(reviews.checked_choices(wanted, groups, candidate), groups, F.lit("now")).first()
    assert (event["error"], event["slug"], event["source_name"]) == (None, "live-name-venue-slug-20260501190000", "Desk")
    short = reviews.checked_choices(wanted.filter("field != 'genre'"), groups, candidate)
    assert reviews.resolved_events(short, groups, F.lit("now")).first()["error"] == "not every field once"
    ask = spark.createDataFrame([(2, "name", 5), (9, "name", 5), (1, "colour", 5), (1, "name", 6)], "group_id long, field string, candidate_id long")
    assert [r["error"] for r in reviews.checked_choices(ask, groups, candidate).orderBy(F.desc("group_id"), "candidate_id").collect()] == ["no such group", "group is closed", "unknown field", "candidate is not in the group"]


def test_stream_stages_each_envelope_once(spark, tmp_path):
    from marquee.streaming.snapshots import snapshot_stream, stage_candidates

    files = spark.createDataFrame([(1, bytearray(ICS))], "id long, content binary")
    for c in ("url", "final_url", "status", "content_type", "captured_at"):
        files = files.withColumn(c, F.lit(c))
    sealed = envelope.seal(envelope.capture(files.withColumn("status_code", F.lit(200)).withColumn("content_length", F.lit(5).cast("long"))))
    shots = sealed.select("id", F.col("id").alias("import_run_id"), F.col("id").alias("source_id"), "captured_at", "payload")
    landed, out, state = (str(tmp_path / n) for n in ("landed", "out", "state"))
    for n in (7, 7):
        shots.write.mode("append").parquet(landed) if n and not (tmp_path / "landed").exists() else None
        stage_candidates(snapshot_stream(spark, landed), out, state).awaitTermination(120)
        assert spark.read.parquet(out).count() == n


# Runs and replay

LINKED, PAGED = seed.REGISTRY[0]["url"], seed.REGISTRY[1]["url"]
PAGE = b'<a href="/one.ics">Google Calendar ICS</a> <a href="/two.ics">Google Calendar ICS</a>'
EVENTS = b'<script type="application/ld+json">[{"@type":"Event","name":"a","location":"Yellow Arch","startDate":"2026-05-10T19:30","endDate":"2026-05-10T23:00"},{"@type":"Event","name":"b"}]</script>'
FILE = "url string, final_url string, status_code int, truncated boolean, body binary"


def landed(spark, *files):
    rows = spark.createDataFrame([(u, f or u, c, t, bytearray(b)) for u, f, c, t, b in files], FILE)
    return rows.withColumns({"status": F.lit(""), "content_type": F.lit(""), "content_length": F.lit(-1).cast("long"), "captured_at": F.lit("2026-04-19T09:00:00Z")})


def ran(spark, *files, source="sidney-and-matilda", limit=0):
    from marquee.operators import replay

    wanted = spark.createDataFrame([(5, source)], "run_id long, source string")
    return replay.ingest(wanted, landed(spark, *files), seed.registry(spark), limit)


def test_runs_over_landed_files(spark):
    one, two = LINKED + "one.ics", LINKED + "two.ics"
    report = ran(spark, (LINKED, None, 200, False, PAGE), (one, None, 200, False, ICS), (two, None, 200, True, ICS))
    r = report.runs.first()
    assert (r["status"], r["snapshots"], r["links"], r["candidates"], r["skips"], r["errors"]) == ("failed", 3, 2, 3, 4, 1)
    assert r["notes"] == f"links=2 candidates=3 skips=4 errors=1; {two}: ICS response was truncated"
    notes = lambda *files, **k: ran(spark, *files, **k).runs.first()["notes"].split("; ")[1:]
    assert notes((LINKED, None, 404, False, PAGE)) == ["source page returned HTTP 404"]
    assert notes((LINKED, None, 200, True, PAGE)) == ["source page response was truncated"]
    assert notes((one, None, 200, False, ICS)) == ["source page did not land"]
    assert notes((LINKED, None, 200, False, b"<p>")) == ["no ICS links found"]
    assert notes((LINKED, None, 200, False, PAGE), (one, None, 500, False, b"")) == ["no ICS calendars parsed successfully", f"{one}: ICS returned HTTP 500", f"{two}: ICS did not land"]
    good = ran(spark, (PAGED, None, 200, False, EVENTS), source="yellow-arch", limit=1)
    assert (good.runs.first()["status"], good.runs.first()["notes"]) == ("succeeded", "links=0 candidates=1 skips=1 errors=0")
    for bad in (-1, 51):
        with pytest.raises(ValueError):
            ran(spark, limit=bad)


def test_replay_gives_what_the_run_gave(spark):
    from marquee.operators import replay

    registry = seed.registry(spark)
    one, two, moved = LINKED + "one.ics", LINKED + "two.ics", "https://moved.test/two.ics"
    files = landed(spark, (LINKED, None, 200, False, PAGE), (one, None, 200, False, ICS), (two, moved, 200, False, ICS.replace(b"utc-1", b"utc-2")), (PAGED, None, 200, False, EVENTS))
    wanted = spark.createDataFrame([(5, "sidney-and-matilda"), (6, "yellow-arch")], "run_id long, source string")
    report = replay.ingest(wanted, files, registry, 10)
    shots = replay.captured(report, files, registry).withColumn("id", F.row_number().over(Window.orderBy("import_run_id", "source_url")).cast("long"))
    table = spark.createDataFrame([(5, "x", "succeeded"), (6, "x", " SUCCEEDED ")], "id long, finished_at string, status string")
    again = replay.replay(table, shots, registry, 10)
    columns = ["run_id", "source", "links", "snapshots", "candidates", "skips", "errors", "status", "notes"]
    assert again.runs.select(columns).orderBy("run_id").collect() == report.runs.select(columns).orderBy("run_id").collect()
    assert [(r["run_id"], r["links"], r["status"]) for r in again.runs.orderBy("run_id").collect()] == [(5, 2, "succeeded"), (6, 0, "succeeded")]
    groups = [(r["run_id"], r["title"], r["source_name"]) for r in replay.review_groups(again, seed.staged_names(spark)).collect()]
    desk = "Sidney & Matilda manual ingest"
    assert groups == [(5, "New listing review: First", desk), (5, "Duplicate review: Second, with comma", desk), (5, "Duplicate review: Third", desk), (5, "New listing review: First", desk), (6, "New listing review: a", "Yellow Arch manual ingest")]
    text = runs.as_json(again.runs.filter("run_id = 6")).first()["report"]
    assert '"run_id" : 6' in text and "\n" in text


REFUSED = {
    "final url": None,
    "json": "malformed envelope",
    "base64": "malformed body",
    "version": "unsupported version",
    "hash": "hash mismatch",
    "missing": "missing ICS snapshot",
    "duplicate": "duplicate ICS snapshot address",
    "unfinished": "unfinished",
    "failed": "not succeeded",
    "no snapshots": "no snapshots",
    "two pages": "several source page snapshots",
    "no page": "no source page snapshot",
}


def test_replay_refuses(spark):
    """Each case is a run of its own, all replayed at once."""
    from functools import reduce

    from marquee.operators import replay

    registry, one = seed.registry(spark), LINKED + "one.ics"
    page = PAGE[: PAGE.index(b" <a")]
    files = landed(spark, (LINKED, None, 200, False, page), (one, one, 200, False, ICS), ("https://old.test/one.ics", one, 200, False, ICS))
    named = files.withColumn("source_name", F.when(F.col("url") == LINKED, seed.REGISTRY[0]["name"]).otherwise("x")).withColumn("source_url", F.col("url"))
    number = F.when(F.col("url") == LINKED, 1).when(F.col("url") == one, 2).otherwise(3).cast("long")
    rows = spark.createDataFrame(envelope.seal(named).select(number.alias("id"), "source_name", "source_url", "captured_at", "payload").collect(), "id long, source_name string, source_url string, captured_at string, payload string")
    payload = F.col("payload")
    broken = {"json": F.lit("{"), "base64": F.regexp_replace(payload, '"body_base64":"', '"body_base64":"%'), "version": F.regexp_replace(payload, '"version":1', '"version":2'), "hash": F.regexp_replace(payload, '"sha256":"....', '"sha256":"zzzz')}
    keep = {"missing": "id = 1", "no page": "id = 2", "no snapshots": "false", "final url": "id != 2"}
    shots, table = [], []
    for k, change in enumerate(REFUSED):
        own = rows.filter(keep.get(change, "id != 3"))
        if change in broken:
            own = own.withColumn("payload", F.when(F.col("id") == 2, broken[change]).otherwise(payload))
        if change in ("duplicate", "two pages"):
            own = own.unionByName(own.filter(F.col("id") == (2 if change == "duplicate" else 1)).withColumn("id", F.col("id") + 10))
        shots.append(own.withColumn("import_run_id", F.lit(k).cast("long")))
        table.append((k, None if change == "unfinished" else "x", "failed" if change == "failed" else "succeeded"))
    runs_table = spark.createDataFrame(table, "id long, finished_at string, status string")
    report = replay.replay(runs_table, reduce(lambda a, b: a.unionByName(b), shots), registry, 10, keep=lambda df: df.persist())
    got = {r["run_id"]: (r["refused"], r["status"]) for r in report.runs.collect()}
    assert got == {k: (error, None if error else "succeeded") for k, error in enumerate(REFUSED.values())}
    assert {r["run_id"] for r in report.lines.collect()} == {0}
    with pytest.raises(ValueError):
        replay.replay(runs_table, shots[0], registry, 0)


def test_runs_finish(spark):
    table = spark.createDataFrame([(1, None, "running", ""), (2, None, "running", "")], "id long, finished_at string, status string, notes string")
    done = spark.createDataFrame([(1, " failed ", "n"), (2, " ", "n"), (3, "failed", "n")], "id long, status string, notes string")
    log = runs.run_finishes(table, done, F.lit("t"))
    assert sorted((r["id"], r["error"]) for r in log.collect() if r["error"]) == [(2, "run status is required"), (3, "run not found")]
    assert [tuple(r) for r in runs.finished(table, log).orderBy("id").collect()] == [(1, "t", "failed", "n"), (2, None, "running", "")]


def test_bootstrap_and_ids(spark):
    venues, events, sources = seed.venues(spark), seed.events(spark), seed.sources(spark)
    first = seed.bootstrapped(venues.limit(0), events.limit(0), sources.limit(0))
    assert [t.count() for t in first] == [3, 4, 3] and seed.bootstrapped(venues.limit(1), events.limit(0), sources)[1].isEmpty()
    from marquee.functions.text import field_label, strict_id

    found = {x: one(spark, strict_id(F.lit(x), "/runs/")) for x in ("/runs/12", "/runs/0", "/runs/1x", "/runs/", "/other/1", "/runs/99999999999999999999", "/runs/-1")}
    assert {k: v for k, v in found.items() if v is not None} == {"/runs/12": 12}
    assert one(spark, field_label(F.lit("venue_slug"))) == "Venue slug" and one(spark, field_label(F.lit("x"))) == "x"


def test_white_space_runs_take_linear_time(spark):
    from time import perf_counter

    from marquee.functions.text import collapse

    text = "a" + " \u3000" * 500_000 + "b"
    df = spark.createDataFrame([(text,)], "t string").select(trim(F.col("t")).alias("trim"), collapse(F.col("t")).alias("collapse"))
    start = perf_counter()
    r = df.first()
    assert r["trim"] == text and r["collapse"] == "a b" and perf_counter() - start < 10


def test_a_store_is_checked_in_one_job(spark):
    venues, sources, events = seed.venues(spark), seed.sources(spark), seed.events(spark)
    bad = events.withColumn("start_at", F.when(F.col("id") == 2, "soon").otherwise(F.col("start_at")))
    assert catalog.validate_store(bad.unionByName(events.filter("id = 3")), venues.unionByName(venues.filter("id = 1")), sources) == ["malformed event time", "repeated venue slug", "repeated event slug"]
    report = {r["problem"]: (r["n"], r["first"]) for r in catalog.store_report(bad, venues.filter("id > 1"), sources).collect()}
    assert report == {"event without venue": (2, "1"), "event without source": (0, None), "malformed event time": (1, "2"), "repeated venue slug": (0, None), "repeated event slug": (0, None)}
    assert {r["n"] for r in catalog.store_report(events.filter("false"), venues.filter("false"), sources).collect()} == {0}


def test_events_are_counted_as_they_are_written(spark, tmp_path):
    events = seed.events(spark)
    path = str(tmp_path / "events")
    spark.sparkContext.setJobGroup("one", "write")
    seen = catalog.write_events(events, seed.venues(spark).filter("id > 1"), seed.sources(spark), path)
    assert seen == {"events": 4, "event without venue": 2, "event without source": 0, "malformed event time": 0}
    assert spark.read.parquet(path).columns == events.columns and spark.read.parquet(path).count() == 4


def test_many_fixture_groups(spark):
    rows = spark.createDataFrame([("b/one.ics", 1, "u1", "Second"), ("b/one.ics", 0, "", "First"), ("two.ics", 0, "", "Other")], "path string, candidate int, uid string, summary string")
    rows = rows.withColumns({c: F.lit("") for c in ("description", "location", "url", "status", "end_at")}).withColumn("start_at", F.lit("2026-05-01T19:00:00Z"))
    groups, own = staging.fixture_groups(rows)
    assert sorted((r["path"], r["title"], r["n_candidates"]) for r in groups.collect()) == [("b/one.ics", "Fixture review: one.ics", 2), ("two.ics", "Fixture review: two.ics", 1)]
    assert sorted((r["path"], r["position"], r["name"], r["provenance"]) for r in own.collect()) == [("b/one.ics", 1, "First", "fixture ICS"), ("b/one.ics", 2, "Second", "fixture UID u1"), ("two.ics", 1, "Other", "fixture ICS")]
    group, one = staging.fixture_group(rows.filter("path = 'two.ics'"), "two.ics")
    assert group.first()["title"] == "Fixture review: two.ics" and one.columns == [c for c in own.columns if c != "path"]
    empty, none = staging.fixture_groups(rows.filter("false"))
    assert empty.isEmpty() and none.isEmpty()


def test_keys_of_sources(spark):
    wanted = spark.createDataFrame([(" ",), (None,), ("yellow-arch",), ("elsewhere",)], "key string")
    got = {r["key"]: (r["source_name"], r["error"]) for r in seed.configured(wanted, seed.registry(spark)).collect()}
    assert got[None] == got[" "] == ("Sidney & Matilda listings", None) and got["yellow-arch"][0] == "Yellow Arch listings" and got["elsewhere"] == (None, "unsupported source elsewhere")


def test_words_of_any_case_by_simple_folding(spark):
    from marquee.functions.text import same_word
    from marquee.sources.extract import parse_ics_links

    words = {"Kiss": True, "KIſſ": True, "kis": False, "kiß": False, "KISS": True, "kıss": False, "": False}
    assert {w: one(spark, same_word(F.lit(w), "kiss")) for w in words} == words and one(spark, same_word(F.lit(None).cast("string"), "x")) is None
    page = "".join(f"<a href='{i}.ics?format=ical'>{label}</a>" for i, label in enumerate(("ICſ", "ics", "icß", "Google Calendar ICſ", "googⅼe calendar ics")))
    assert [r["url"] for r in parse_ics_links(page, "https://s.test/", 9)] == [f"https://s.test/{i}.ics?format=ical" for i in (0, 1, 3)]
    runs = spark.createDataFrame([(1, "x", " ſUCCEEDED　"), (2, "x", "succeede")], "id long, finished_at string, status string")
    shots = spark.createDataFrame([(1,), (2,)], "import_run_id long")
    assert {r["id"]: r["error"] for r in envelope.replayable(runs, shots).collect()} == {1: None, 2: "not succeeded"}


def test_rows_that_are_no_link_are_dealt_over_all_tasks(spark):
    """Skips have no address: in the join of links with bodies their nulls met in one task."""
    from pyspark.sql import functions as F

    from marquee.operators.replay import parsed_lines

    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        body = '<script type="application/ld+json">{"@type": "Event", "name": "x"}</script>'
        pages = spark.range(200).select(F.col("id").alias("run_id"), F.lit("source_page").alias("page_mode"), F.lit("https://p.test/").alias("page_url"), F.lit(0).cast("long").alias("page_snapshot"), F.lit(body).cast("binary").alias("body"))
        answers = spark.createDataFrame([("https://c.test/", 0, False, 200, b"")], "link string, snapshot_id long, truncated boolean, status_code int, body binary")
        skips = parsed_lines(pages, answers, None, ["link"], 20, "gone").filter("kind = 'skip'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in skips) == 200 and max(r["count"] for r in skips) < 120


def test_runs_are_counted_where_bodies_are_parsed(spark):
    """What a run over files says comes from counts by calendar, a row each, and equals what its lines give; pages, which
    take long for their size, are dealt over all tasks and read once."""
    from marquee.operators import replay

    rows = [("a", "https://a.test/", "linked_ics"), ("b", "https://b.test/x/", "source_page"), ("c", "https://c.test/", "odd"), ("d", "https://[d", "linked_ics"), ("e", "https://e.test/", "linked_ics"), ("f", "https://f.test/", "source_page"), ("g", "https://g.test/", "linked_ics")]
    registry = spark.createDataFrame(rows, "key string, url string, page_mode string")
    links = "".join(f"<a href='{k}.ics'>Google Calendar ICS</a>" for k in (1, 2, 3, 4, 5, 1))
    event = "BEGIN:VEVENT\nSUMMARY:x\nDTSTART:20260501T190000Z\n{}END:VEVENT\n"
    bad = '<script type="application/ld+json">[{"@type":"Event","name":"a","location":"h","startDate":"2026-05-10T19:30","endDate":"2026-05-10T23:00","url":"http://[x"},{"@type":"Event","name":"b"}]</script><script type="application/ld+json">{</script>'
    bodies = {"https://a.test/": links, "https://b.test/x/": bad, "https://c.test/": "x", "https://[d": links, "https://e.test/": "no", "https://f.test/": "<p>", "https://a.test/1.ics": event.format("") * 3 + event.format("STATUS:CANCELLED\n"), "https://a.test/2.ics": "END:VEVENT\nBEGIN:VEVENT\nBEGIN:VEVENT", "https://a.test/3.ics": "", "https://a.test/4.ics": event.format(" folded\n")}
    files = landed(spark, *((u, None, 200, u.endswith("3.ics"), b.encode()) for u, b in bodies.items()))
    wanted = spark.createDataFrame([(i, k) for i, k in enumerate("abcdefgab")] + [(0, "b"), (3, "c")], "run_id long, source string")
    dealt = []
    counted = replay.ingest(wanted, files, registry, 4, keep_pages=lambda df: dealt.append(df.rdd.getNumPartitions()) or df)
    told = replay.ingest(wanted, files, registry, 4, keep=lambda df: df)
    columns = ["run_id", "source", "links", "snapshots", "candidates", "skips", "errors", "status", "notes"]
    got = sorted(map(tuple, counted.runs.select(columns).collect()))
    assert got == sorted(map(tuple, told.runs.select(columns).collect())) and len(got) == 11
    assert sorted(map(tuple, counted.lines.select("run_id", "kind", "ordinal").collect())) == sorted(map(tuple, told.lines.select("run_id", "kind", "ordinal").collect()))
    plan = counted.runs._jdf.queryExecution().optimizedPlan().toString()
    assert "start_at" not in plan and "start_at" in told.runs._jdf.queryExecution().optimizedPlan().toString()
    assert dealt == [max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))]


def test_regular_calendars_and_pages_are_read_as_all_others():
    """Whole events by one pattern, and what was read before by its text, give what reading line by line gives."""
    import random

    from marquee.functions import markup

    rnd = random.Random(4)
    lines = ["BEGIN:VEVENT", "END:VEVENT", "BEGIN:VCALENDAR", "END:VCALENDAR", "SUMMARY:Show", "SUMMARY;A=b:Sh\\, ow", "DTSTART:20260501T190000Z", "STATUS:CANCELLED", " folded", "", "begin:vevent", "End:VEVENT ", "BEG\u0131N:VEVENT", "UID:u", "BEGIN:VALARM", "EXDATE:1", "no colon", "BEGIN:VEVENTX", "BEGIN;A=1:VEVENT", "\x0bA:1", "\x85"]
    regular = 0
    for _ in range(4000):
        end = rnd.choice(["\r\n", "\n", "\r"])
        parts = []
        for _ in range(rnd.randint(0, 5)):
            own = [rnd.choice(lines[4:8] + lines[13:14] if rnd.random() < 0.9 else lines) for _ in range(rnd.randint(0, 4))]
            parts += ["BEGIN:VEVENT", *own, "END:VEVENT"] if rnd.random() < 0.8 else own
        text = end.join(parts) + rnd.choice(["", end])
        regular += extract._REGULAR.fullmatch(text) is not None
        assert extract.parse_ics(text.encode()) == extract._parse_ics(text), text
    assert 1000 < regular < 3900
    for _ in range(2):
        page = "<a href='x'>ICS</a><a href=\"/y?a='>'\">Google <b>Calendar</b> ICS</a><A HREF = 'z' >&amp;</a><a href='q' href='r'>t</a><a href=u>v</a><a href='w'><a href='n'>m</a>"
        assert list(markup.links(page)) == [("x", "ICS"), ("/y?a='>'", "Google <b>Calendar</b> ICS"), ("z", "&amp;"), ("q", "t"), ("u", "v"), ("w", "<a href='n'>m")]
        for base in ("https://a.test/", "https://b.test/x/"):
            script = '<script type="application/ld+json">{"@type":"Event","name":"a","location":"h","startDate":"2026-05-10T19:30","endDate":"2026-05-10T23:00","url":"e"}</script>'
            assert [r["url"] for r in extract.parse_jsonld(script, base, 1)] == [base + "e"]
