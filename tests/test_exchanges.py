"""Recorded exchanges: the data source, and fetching along redirects."""

import io

import pytest
from pyspark.sql import functions as F

from marquee.sources.exchanges import SCHEMA, STOPPED, UNRECORDED, ends, fetched, read_records, record, register

AT = "2026-04-19T09:00:00Z"


def row(url, code=200, location=None, body=b"x", at=AT, target=None):
    return (url, f"{code} Text", code, "text/plain", len(body), location, target if target is not None else location, at, bytearray(body))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


@pytest.fixture
def recorded(spark, tmp_path):
    register(spark)
    folder = str(tmp_path / "warc")
    rows = [row(f"https://a.test/{k}", 200 if k % 3 else 404, body=bytes([k]) * k * 1000) for k in range(40)] + [row("https://b.test/x?y=1", 301, "../z#part"), row("https://b.test/", 302, "http://[bad"), row("https://ü.test/", body="é\r\n\r\nWARC/1.0\r\n".encode())]
    frame(spark, *rows).repartition(4).write.format("exchanges").mode("append").save(folder)
    return folder, rows


def test_what_is_recorded_is_read(spark, recorded):
    folder, rows = recorded
    df = spark.read.format("exchanges").load(folder)
    got = {r.url: r for r in df.collect()}
    assert len(got) == len(rows) and df.rdd.getNumPartitions() == 4
    for url, status, code, kind, length, location, _, at, body in rows:
        r = got[url]
        assert (r.status, r.status_code, r.content_type, r.content_length, r.location, r.captured_at, bytes(r.body)) == (status, code, kind, length, location, at, bytes(body))
    assert got["https://b.test/x?y=1"].target == "https://b.test/z" and got["https://b.test/"].target is None
    assert all(r.body is None for r in spark.read.format("exchanges").option("bodies", "false").load(folder).collect())


def test_filters_are_pushed(spark, recorded):
    folder, _ = recorded
    df = spark.read.format("exchanges").load(folder)
    one = df.filter((F.col("url") == "https://a.test/7") & (F.col("content_length") > 5))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "content_length" in plan.split("Filter")[1].split("\n")[0] and "a.test/7" not in plan.split("Filter")[1].split("\n")[0]
    assert [r.url for r in one.collect()] == ["https://a.test/7"]
    assert df.filter(F.col("status_code").isin(301, 302) & F.col("url").startswith("https://b")).count() == 2
    assert df.filter("status_code = 404 and url = 'https://a.test/1'").isEmpty() and df.filter("url like '%test/3%'").count() == 11


def test_overwriting_replaces_and_a_lost_write_shows_nothing(spark, recorded):
    folder, _ = recorded
    bad = frame(spark, row("https://c.test/")).withColumn("status", F.expr("if(url is null, '', raise_error('lost'))").cast("string"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("exchanges").mode("append").save(folder)
    assert spark.read.format("exchanges").load(folder).count() == 43
    frame(spark, row("https://c.test/")).write.format("exchanges").mode("overwrite").save(folder)
    assert [r.url for r in spark.read.format("exchanges").load(folder).collect()] == ["https://c.test/"]


def test_records_of_other_writers():
    good = record("https://a.test/", "200 OK", "text/html", None, AT, b"body")
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 12\r\n\r\nsoftware: x\n\r\n\r\n"
    bare = b"WARC/1.0\nwarc-type: response\nwarc-target-uri: <https://b.test/>\ncontent-length: 29\n\nHTTP/1.0 302\nLocation: /q\n\nhi"
    data = info + good + b"noise\r\n" + bare + b"\r\n\r\n" + good
    rows = list(read_records(io.BytesIO(data)))
    assert [(r[0], r[2], bytes(r[8])) for r in rows] == [("https://a.test/", 200, b"body"), ("https://b.test/", 302, b"hi"), ("https://a.test/", 200, b"body")] and rows[1][6] == "https://b.test/q"
    for cut in range(len(good)):
        assert len(list(read_records(io.BytesIO(good[:cut])))) <= (cut >= len(good) - 4)
    assert list(read_records(io.BytesIO(b""))) == [] and list(read_records(io.BytesIO(b"\xff" * 3_000_000))) == []


def plain_fetch(url, by_url):
    """As a client does it, request by request."""
    requests, seen = 0, set()
    while True:
        requests += 1
        if requests > 10:
            while url in by_url and by_url[url][6] and url not in seen:
                seen.add(url)
                url = by_url[url][6]
            return None, STOPPED, url in seen
        r = by_url.get(url)
        if r is None:
            return url, UNRECORDED, False
        if r[2] in (301, 302, 303, 307, 308) and r[6]:
            url = r[6]
            continue
        return url, None, False


def test_chains_and_loops(spark):
    rows = []
    for n in range(14):
        rows += [row(f"{n}-{i}", 302 if i < n else 200, f"{n}-{i + 1}" if i < n else None, f"{n}".encode()) for i in range(n + 1)]
    rows += [row("self", 301, "self"), *(row(f"ring-{i}", 307, f"ring-{(i + 1) % 5}") for i in range(5)), *(row(f"tail-{i}", 308, f"tail-{i + 1}" if i < 29 else "ring-2") for i in range(30))]
    rows += [row("lost", 302, "nowhere"), row("no place", 302), row("not modified", 304, "0-0"), row("twice", 302, "0-0", at="2026-01-01T00:00:00Z"), row("twice", 200, body=b"late"), row("sent", 302, "twice")]
    wanted = [r[0] for r in rows] + ["nowhere", "0-0"]
    by_url = {r[0]: r for r in rows}
    exchanges = frame(spark, *rows).filter("not (url = 'twice' and status_code = 302)")
    got = fetched(spark.createDataFrame([(u,) for u in wanted] + [(None,)], "url string"), exchanges).collect()
    assert len(got) == len(wanted) + 1
    for r in got:
        if r.url is None:
            assert r.error == UNRECORDED and not r.loop
            continue
        final, error, loop = plain_fetch(r.url, by_url)
        assert (r.final_url, r.error, r.loop) == (final, error, loop), r.url
        assert error or bytes(r.body) == bytes(by_url[final][8])


def test_of_exchanges_of_one_url_the_latest_counts(spark):
    rows = [row("a", 200, body=b"old", at="2026-01-01T00:00:00Z"), row("a", 200, body=b"new"), row("m", 302, "a", at="2026-01-01T00:00:00Z"), row("m", 302, "b"), row("b", body=b"b" * 9)]
    got = {r.url: r for r in fetched(spark.createDataFrame([("a",), ("m",)], "url string"), frame(spark, *rows), limit=4).collect()}
    assert bytes(got["a"].body) == b"new" and not got["a"].truncated and got["m"].final_url == "b" and bytes(got["m"].body) == b"bbbb" and got["m"].truncated
    assert ends(frame(spark).filter("false")).isEmpty() and fetched(spark.createDataFrame([("a",)], "url string"), frame(spark, row("b"))).first().error == UNRECORDED


def test_recording_deals_exchanges_over_files(spark, tmp_path):
    """One task's rows are dealt over files, so that tasks share the reading."""
    from marquee.sources.exchanges import recorded

    register(spark)
    rows = spark.range(0, 200, 1, 1).selectExpr("concat('https://x.test/', id) AS url", "'200 OK' AS status", "200 AS status_code", "'text/plain' AS content_type", "-1L AS content_length", "cast(null AS string) AS location", "cast(null AS string) AS target", "'2026-04-19T09:00:00Z' AS captured_at", "cast('b' AS binary) AS body")
    recorded(rows, str(tmp_path))
    read = spark.read.format("exchanges").load(str(tmp_path))
    assert read.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and read.select("url").distinct().count() == 200


def test_records_by_the_batch_are_read_as_any_others(spark, tmp_path):
    """What the writer puts together by column is what the reader of any heads finds, and so are records whose heads it knows as a whole."""
    texts = ["", "x", " 200 OK", "a: b", "https://a.test/z", "../q#r", "<b>", "WARC/1.0", "é", "a\r\nb", None]
    rows = [row(f"https://a.test/{k}", 200 + k % 200, texts[k % 11], (b"", b"x\r\n\r\nWARC/1.0\r\n", b"y" * 3_000_000)[k % 3 if k < 9 else k % 2], texts[k % 7] or "") for k in range(300)]
    register(spark)
    frame(spark, *rows).repartition(2).write.format("exchanges").mode("append").save(str(tmp_path))
    data = b"".join(f.read_bytes() for f in sorted(tmp_path.iterdir()))
    own = list(read_records(io.BytesIO(data)))
    other = list(read_records(io.BytesIO(data.replace(b"WARC/1.0\r\nWARC-Type: response", b"WARC/1.0\r\nwarc-type: response"))))
    assert own == other and len({x for x in data.split() if x.startswith(b"<urn:uuid:")}) == 300
    got = {r[0]: r for r in own}
    for url, status, code, kind, length, location, _, at, body in rows:
        r = got[url]
        assert (r[1], r[2], r[3], r[4], r[7], bytes(r[8])) == (status, code, kind, length, at.replace("\r", " ").replace("\n", " ").strip(), bytes(body))
        assert r[5] == (location.replace("\r", " ").replace("\n", " ").strip() if location else None)
    assert data.count(b"Record-ID: <urn:uuid:") == 300


def test_an_older_redirect_of_a_url_does_not_count(spark):
    """Nor does an older answer where the latest sends on; exchanges are read once, or again for their bodies."""
    old = "2026-01-01T00:00:00Z"
    rows = [row("twice", 302, "0", at=old), row("twice", body=b"late"), row("sent", 302, "twice"), row("moved", body=b"old", at=old), row("moved", 302, "0"), row("0", body=b"zero"), row("undated", 302, "0", at=None), row("lost", 301)]
    wanted = spark.createDataFrame([(u,) for u in ("twice", "sent", "moved", "undated", "lost", "twice")], "url string")
    every = frame(spark, *rows)
    for heads in (None, every.drop("body")):
        got = sorted((r.url, r.final_url, r.hops, bytes(r.body), r.loop) for r in fetched(wanted, every, heads).collect())
        assert got == [("lost", "lost", 0, b"x", False), ("moved", "0", 1, b"zero", False), ("sent", "twice", 1, b"late", False), ("twice", "twice", 0, b"late", False), ("twice", "twice", 0, b"late", False), ("undated", "0", 1, b"zero", False)]
    led = {r.url: (r.final_url, r.hops) for r in ends(every).collect()}
    assert led == {"sent": ("twice", 1), "moved": ("0", 1), "undated": ("0", 1)}


def test_rounds_join_numbers_alone(spark, monkeypatch):
    """Of an address's text there is one join before the rounds; rounds write numbers, and only of ways that had not ended."""
    from marquee.sources import exchanges

    told = []
    monkeypatch.setattr(exchanges, "written", lambda rows, name: told.append((name, [t for _, t in rows.dtypes], rows.count())) or rows.localCheckpoint())
    ends(frame(spark, *(row(f"{n}-{i}", 302, f"{n}-{i + 1}") for n in range(3) for i in range(20))))
    rounds = [(types, n) for name, types, n in told if name == "jumps"]
    assert all(types == ["bigint", "bigint", "bigint", "boolean"] for types, _ in rounds) and [n for _, n in rounds] == [60, 57, 54, 48, 36, 12]


def test_urls_without_an_end_are_dealt_over_all_tasks(spark):
    """Those in loops, and those that don't send on, have no key in some joins: their nulls met in one task."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [row(f"{k}", 301, f"{k}") for k in range(200)]
        wanted = spark.createDataFrame([(f"{k}",) for k in range(400)], "url string")
        got = fetched(wanted, frame(spark, *rows))
        counts = {loop: [r["count"] for r in got.filter(F.col("loop") == loop).groupBy(F.spark_partition_id()).count().collect()] for loop in (True, False)}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert all(sum(n) == 200 and max(n) < 120 for n in counts.values())
