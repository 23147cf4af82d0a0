"""The review desk on groups with many candidates."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marquee.operators import desk

NOW = "2026-04-19T09:00:00Z"


def test_groups_outside_the_tenth_can_have_every_field(spark, tmp_path):
    """compacted_store: 60 orders for each of 90 customers, so most groups have all nine fields."""
    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT * REPLACE (c_custkey % 90 AS c_custkey) FROM '/root/testdata/sf0.001/customer.parquet' WHERE c_custkey < 90")
    con.execute("CREATE TABLE orders AS SELECT CAST(k AS BIGINT) AS o_orderkey, CAST(hash(k) % 90 AS BIGINT) AS o_custkey, ['O', 'F', 'P'][k % 3 + 1] AS o_orderstatus, 1.0 AS o_totalprice, TIMESTAMP '1998-02-06' + to_days(CAST(k AS INT)) AS o_orderdate, '5-LOW' AS o_orderpriority FROM range(5400) t(k)")
    con.execute("CREATE TABLE nation AS FROM '/root/testdata/sf0.001/nation.parquet'")
    for t in ("customer", "orders", "nation"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    found = entry.queries()["compacted_store"](spark, str(tmp_path)).select("kind", "key", "value")
    wanted = con.execute(f"SELECT kind, key, value FROM ({entry.oracle_sql()['compacted_store']})").fetchall()
    assert sum(kind == "group" and value.startswith("resolved 2026-04-19") and int(key) % 10 != 1 for kind, key, value in wanted) > 10
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_choices_are_restored(spark, tmp_path):
    store = desk.open_desk(spark, str(tmp_path / "desk"), 4)
    choices = "group_id long, field string, candidate_id long, value string, updated_at string"
    rows = lambda *r: spark.createDataFrame(list(r), choices)
    store.create({"choices": rows((1, "name", 5, "old", NOW), (1, "genre", 5, "old", NOW), (2, "name", 6, "old", NOW))})
    change = store.begin()
    change.commit({"choices": rows((1, "name", 7, "new", NOW), (1, "status", 7, "new", NOW), (2, "name", 8, "new", NOW))})
    ids = lambda *g: spark.createDataFrame([(x,) for x in g], "group_id long")
    shown = lambda: sorted((r.group_id, r.field, r.value) for r in store.rows("choices", store.manifest()).collect())
    assert desk.restore_choices(store, ids(1, 3), 0) == 2
    assert shown() == [(1, "genre", "old"), (1, "name", "old"), (2, "name", "new")]
    desk.restore_choices(store, ids(), 0)
    assert shown() == [(1, "genre", "old"), (1, "name", "old"), (2, "name", "new")]
    store.compact("choices")
    assert shown() == [(1, "genre", "old"), (1, "name", "old"), (2, "name", "new")]
    assert store.rows("choices", store.manifest()).filter(F.col("updated_at").isNull()).isEmpty()
