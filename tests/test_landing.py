"""Files landed by tasks, and read back."""

import hashlib
import os

import duckdb

import __spark_entry__ as entry
from marquee.sources import envelope
from marquee.store.place import new_path


def test_pages_with_repeated_and_missing_ids(spark, tmp_path):
    rows = [(1, "<p>one"), (1, "<p>again"), (-7, "minus"), (None, "no id"), (2, ""), (3, None), (None, None), (4, "ünï\n\n"), (5, "x" * 300_000)]
    pages = spark.createDataFrame([(i, f"https://p.test/{i}", h) for i, h in rows], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    found = entry.queries()["landed_pages"](spark, str(tmp_path)).select("page_id", "sha256", "n").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    wanted = con.execute(f"SELECT page_id, sha256, n FROM ({entry.oracle_sql()['landed_pages']})").fetchall()
    assert len(wanted) == len(rows)
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert entry.queries()["landed_pages"](spark, str(tmp_path)).isEmpty()


def test_folders_grow_with_tasks_and_not_with_files(spark):
    rows = spark.range(2000).selectExpr("concat(id % 10, '.txt') AS name", "cast(concat('body ', id) AS binary) AS content")
    folder = new_path(spark, "landing")
    folders = envelope.land(rows.repartition(3), folder)
    assert len(folders) == 3 and sum(len(os.listdir(f)) for f in folders) == 2000
    found = envelope.landed_files(spark, folders).collect()
    assert sorted(hashlib.sha256(r.content).hexdigest() for r in found) == sorted(hashlib.sha256(f"body {i}".encode()).hexdigest() for i in range(2000))
    assert len({r.url for r in found}) == 2000


def test_reading_takes_tasks_by_folders(spark):
    """2,500 files were 79 tasks and a folder each, now tasks are as many as folders or cores."""
    df = entry.queries()["landed_pages"](spark, "/root/testdata/sf0.1")
    assert df.filter("n > 0").rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
