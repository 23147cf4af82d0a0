"""Calendars read in SQL against the parser of single bodies."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import ICS

from marquee.sources.extract import ROWS, parse_ics
from marquee.sources.ics import ics_rows

COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


def both(spark, bodies):
    rows = spark.createDataFrame([(i, b if b is None else bytearray(b)) for i, b in enumerate(bodies)], "id long, body binary")
    df = ics_rows(rows, ("id",))
    got = sorted((tuple(r[c] for c in ("id", *COLUMNS)) for r in df.collect()), key=lambda r: (r[0], r[2]))
    want = [(i, *(k if c == "ordinal" else row.get(c) for c in COLUMNS)) for i, b in enumerate(bodies) if b is not None for k, row in enumerate(parse_ics(b))]
    return df, got, want


FIXED = [
    ICS, ICS.replace(b"\n", b"\r\n"), ICS.replace(b"\n", b"\r"), b"", None, b"\n\n", b"END:VEVENT", b"BEGIN:VEVENT", b"BEGIN:VEVENT\nBEGIN:VEVENT\nSUMMARY:a", b" begin:vevent\nSUMMARY:x",
    b"begin : vevent \nsummary:S\ndtstart:20260501T1900Z\nEND:VeVENT", b"BEGIN:VEVENT\nSUMMARY:a\\\\nb\\nc\\,d\\;e\\x\\\\\\,f\\\nDTSTART:20260501T190000Z\nEND:VEVENT", b"BEGIN:VEVENT\nSUMMARY:\xff\xe2\x82 x\nDTSTART:20260501T190000\nEND:VEVENT",
    b"BEGIN:VEVENT\nSUMMARY:one\nSUMMARY:two\nBEGIN:VALARM\nSTATUS:CANCELLED\nEND:VALARM\nSTATUS:CONFIRMED\nEND:VEVENT", b"BEGIN:VEVENT\nSUM\n MARY:fol\n\tded\n\n  too\nDTSTART:20260501T190000Z\nEND:VEVENT", b"no colon\nBEGIN:VEVENT\nno colon\nSUMMARY:s\nDTSTART:20260501T190000Z\nDTEND:x\nEND:VEVENT",
]
TIMES = ["20260501T190000Z", "20260501T1900Z", "20260501T1900", "20260501T190000.5Z", "20260501T190000,123", "20260230T190000Z", "20260501T250000", "20260501T240000", "20260501T190060", "20261025T013000", "20260329T013000", "20260329T005959", "20260501", "2026-05-01", "tomorrow", "", " 20260501T190000 ", "20260501t190000", "20260501T190000ZZ", "00010101T000000Z", "00000101T000000Z", "99991231T235959Z", "20260501T19000", "20260501T190000.Z"]
PARAMS = ["", ";TZID=Europe/London", ";TZID=\"Europe/London\"", ";TZID=UTC", ";VALUE=DATE", ";value=date-time", ";VALUE=DATE;TZID=X", ";TZID=", ";X;TZID=Europe/Paris;TZID=Europe/London", "; tzid = Europe/London "]


def test_calendars_of_all_kinds(spark):
    times = [f"BEGIN:VEVENT\nSUMMARY:s\nDT{name}{p}:{t}\n{'DTSTART:20260501T190000Z' if name == 'END' else ''}\nEND:VEVENT".encode() for name in ("START", "END") for p in PARAMS for t in TIMES]
    df, got, want = both(spark, FIXED + times)
    assert got == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_random_calendars(spark, seed):
    rng = random.Random(seed)
    parts = ["BEGIN:VEVENT", "END:VEVENT", "SUMMARY:a", "UID:u", "STATUS:cancelled", "DTSTART:20260501T190000Z", "DTEND:20260501T200000", "DTSTART;VALUE=DATE:20260501", "LOCATION:Hall\\, London", " folded", "\tfolded", "", "junk", "DESCRIPTION:é\\n\\\\n", "URL: https://x.test/ ", "X:", ":", ";:", "BEGIN:VCALENDAR", "begin:vevent", "end:vevent "]
    bodies = [rng.choice(["\n", "\r\n", "\r"]).join(rng.choices(parts, k=rng.randrange(0, 25))).encode() for _ in range(400)]
    _, got, want = both(spark, bodies)
    assert got == want


def test_keys_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a", bytearray(ICS), "clash")], "id long, kind_of string, body binary, _lines string")
    assert ics_rows(rows, ("id", "kind_of")).columns == ["id", "kind_of", *COLUMNS] and ics_rows(rows.filter("false"), ("id",)).isEmpty()
    assert ics_rows(rows, ("id",)).filter(F.col("kind") == "candidate").count() == 3


def test_long_calendars_take_linear_time(spark):
    import time

    event = b"BEGIN:VEVENT\nSUMMARY:s\nDTSTART:20260501T190000Z\nEND:VEVENT\n"
    bodies = [event * 15_000, b"BEGIN:VEVENT\n" * 80_000, b"BEGIN:VEVENT\nSUMMARY:" + b"\\" * 1_000_000, b"BEGIN:VEVENT\n" + b"X:y\n" * 250_000 + b"END:VEVENT", b"BEGIN:VEVENT\nSUMMARY:" + b" " * 1_000_000 + b"x\nEND:VEVENT", b"\n " * 500_000]
    began = time.monotonic()
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)], "id long, body binary")
    counts = {r.id: r.n for r in ics_rows(rows, ("id",)).groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 15_000, 1: 80_000, 2: 1, 3: 1, 4: 1} and time.monotonic() - began < 90
