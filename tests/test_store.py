"""The shelf of bodies and the versioned store."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from marquee.operators import replay
from marquee.plans import model
from marquee.store.shelf import shelve, unsealed

SF = "/root/testdata/sf0.001"


def exchanges(df):
    """What each shuffle or broadcast of the plan moves."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    return [m[1] for m in re.finditer(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_replay_moves_no_bodies(spark, no_broadcast):
    stored, runs, registry = model.stored_snapshots(spark, SF), model.runs(spark, SF), model.run_sources(spark)
    shelf = shelve(stored, f"shelf_{uuid.uuid4().hex}")
    report = replay.replay(runs, shelf, registry, 50)
    moved = exchanges(report.lines)
    assert len(moved) > 5 and not [x for x in moved if re.search(r"\b_?(body|payload|body_base64)#", x)]
    plain = replay.replay(runs, stored, registry, 50)
    assert [x for x in exchanges(plain.lines) if re.search(r"\b_?body#", x)]
    key = lambda df: sorted(map(str, df.collect()))
    assert key(report.runs) == key(plain.runs) and key(report.lines) == key(plain.lines)


def test_heads_are_read_without_bodies(spark):
    shelf = shelve(model.stored_snapshots(spark, SF), f"shelf_{uuid.uuid4().hex}")
    plan = shelf.heads.filter("error is null").select("id", "metadata")._jdf.queryExecution().executedPlan().toString()
    assert "body:binary" not in plan and "payload" not in plan


def test_shelf_edges(spark):
    rows = spark.createDataFrame([(1, 7, None, "x"), (2, 7, "", "x"), (3, None, "{}", None), (None, 7, "nonsense", "x"), (2, 7, "", "x")], "id long, import_run_id long, payload string, body_id string")
    for shelf in (shelve(rows, f"shelf_{uuid.uuid4().hex}", 3), unsealed(rows)):
        assert shelf.heads.count() == 5 and shelf.heads.filter("error is null").isEmpty() and shelf.bodies.filter("body is not null").isEmpty()
        assert shelf.heads.columns == ["id", "import_run_id", "body_id", "metadata", "truncated", "error"]
    empty = shelve(rows.filter("false"), f"shelf_{uuid.uuid4().hex}", 3)
    assert empty.heads.isEmpty() and empty.bodies.columns == ["id", "body"]


def test_rows_without_a_snapshot_keep_their_place(spark):
    from marquee.store.shelf import with_bodies

    bodies = spark.createDataFrame([(1, bytearray(b"one")), (-5, bytearray(b"five")), (None, bytearray(b"none"))], "id long, body binary")
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (None, "b"), (9, "c"), (-5, "d")], "snap long, body string").withColumn("n", F.lit(1))
    got = with_bodies(rows, "snap", bodies, "found", outer=True)
    assert sorted((r.body, bytes(r.found) if r.found else None) for r in got.collect()) == [("a", b"one"), ("b", None), ("b", None), ("c", None), ("d", b"five")]
    assert with_bodies(rows, "snap", bodies, "found").count() == 2


# versions

NOW = F.lit  # a time as a column


@pytest.fixture
def store(spark, tmp_path):
    from marquee.store.versioned import Kind, Store

    s = Store(spark, str(tmp_path / "store"), {"t": Kind(("id",), "id", numbered=True), "u": Kind(("k", "n"), "k")}, 8)
    s.create({"t": spark.range(40).select("id", F.lit("old").alias("x")), "u": spark.createDataFrame([("a", 1, "p"), ("b", 1, "q")], "k string, n int, x string")})
    return s


def content(store, name, version=None, buckets=None):
    return sorted(map(tuple, store.rows(name, store.manifest(version), buckets).collect()))


def row(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, x string")


def bucket_of(spark, store, i):
    return row(spark, (i, "")).select(store.bucket("t")).first()[0]


def test_versions_are_read_as_they_were(spark, store):
    t = store.begin()
    assert t.commit({"t": row(spark, (3, "new"), (99, "made")), "u": spark.createDataFrame([("a", 1, None, True), ("c", 5, "r", False)], "k string, n int, x string, _deleted boolean")}) == 1
    assert content(store, "t", 0) == [(i, "old") for i in range(40)]
    assert content(store, "t") == sorted([(i, "new" if i == 3 else "old") for i in range(40)] + [(99, "made")])
    assert content(store, "u") == [("b", 1, "q"), ("c", 5, "r")] and store.begin().top("t").first().id == 99
    later = store.begin()
    assert later.commit({"t": row(spark, (3, "newest"))}) == 2 and (3, "newest") in content(store, "t") and (3, "new") in content(store, "t", 1)


def test_a_batch_on_one_bucket_rewrites_one(spark, store):
    b = bucket_of(spark, store, 7)
    assert store.begin().commit({"t": row(spark, (7, "new"))}) == 1
    before = store.manifest()["tables"]["t"]
    assert before["deltas"][0]["buckets"] == [b] and before["base"] == store.manifest(0)["tables"]["t"]["base"]
    assert store.compact("t") == [b] and store.compact("t") == []
    after = store.manifest()["tables"]["t"]
    assert not after["deltas"] and {k for k in after["base"] if after["base"][k] != before["base"][k]} == {str(b)}
    assert content(store, "t") == sorted((i, "new" if i == 7 else "old") for i in range(40)) and len(content(store, "t", 0)) == 40
    deltas = store.begin()
    deltas.commit({"t": row(spark, (1, "n"), (2, "n"), (3, "n"), (4, "n"))})
    some = sorted({bucket_of(spark, store, i) for i in (1, 2)})
    assert store.compact("t", some) == some and [x for _, x in content(store, "t")].count("n") == 4


def test_reads_and_writes_touch_only_their_buckets(spark, store):
    t = store.begin()
    files = t.rows("t", row(spark, (7, ""), (7, ""), (None, "")).select("id")).inputFiles()
    assert files and all(f"bucket={bucket_of(spark, store, 7)}/" in f for f in files)
    assert t.read == {"t": {bucket_of(spark, store, 7)}}


def test_a_crash_before_the_manifest_changes_nothing(spark, store, monkeypatch):
    from marquee.store.versioned import Store

    def lost(self, manifest):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lost)
        with pytest.raises(OSError):
            store.begin().commit({"t": row(spark, (3, "half")), "u": spark.createDataFrame([("a", 1, "half")], "k string, n int, x string")})
        with pytest.raises(OSError):
            store.compact("t", [0])  # nothing to do, so no manifest
            store.begin().commit({"t": row(spark, (4, "half"))})
    again = Store(spark, store.root, store.kinds, store.buckets)
    assert again.versions() == [0] and content(again, "t") == [(i, "old") for i in range(40)] and content(again, "u") == [("a", 1, "p"), ("b", 1, "q")]
    assert again.begin().commit({"t": row(spark, (3, "whole"))}) == 1


def test_of_two_writers_one_is_refused(spark, store):
    from marquee.store.versioned import Conflict, transact

    a, b = store.begin(), store.begin()
    keys = row(spark, (7, "")).select("id")
    a.rows("t", keys), b.rows("t", keys)
    assert a.commit({"u": spark.createDataFrame([("z", 1, "a")], "k string, n int, x string"), "t": row(spark, (7, "a"))}) == 1
    with pytest.raises(Conflict):
        b.commit({"t": row(spark, (7, "b"))})
    assert (7, "a") in content(store, "t") and store.versions() == [0, 1]
    tried = []

    def batch(t):
        tried.append(t.began["version"])
        if len(tried) == 1:
            store.begin().commit({"t": row(spark, (8, "between"))})
        return {"t": row(spark, (8, "last"))}

    assert transact(store, batch) == 3 and tried == [1, 2] and (8, "last") in content(store, "t")
    with pytest.raises(Conflict):
        transact(store, lambda t: (store.begin().commit({"t": row(spark, (8, "x"))}), {"t": row(spark, (8, "y"))})[1], tries=1)


def test_writers_of_other_buckets_both_commit(spark, store):
    keys = [spark.createDataFrame([(k, 1, "w")], "k string, n int, x string") for k in ("a", "b", "d", "e", "f")]
    where = [k.select(store.bucket("u")).first()[0] for k in keys]
    other = next(i for i, b in enumerate(where) if b != where[0])
    first, second = store.begin(), store.begin()
    assert first.commit({"u": keys[0]}) == 1 and second.commit({"u": keys[other]}) == 2
    assert {("abdef"[0], 1, "w"), ("abdef"[other], 1, "w")} <= set(content(store, "u"))


def test_many_writers_at_once(spark, store):
    from concurrent.futures import ThreadPoolExecutor

    from marquee.store.versioned import transact

    def add(i):
        def batch(t):
            (old,) = t.rows("u", spark.createDataFrame([("a",)], "k string")).filter("k = 'a'").collect()
            return {"u": spark.createDataFrame([("a", 1, old.x + str(i))], "k string, n int, x string")}

        return transact(store, batch, tries=20)

    with ThreadPoolExecutor(4) as pool:
        versions = sorted(pool.map(add, range(4)))
    ((_, _, text),) = [r for r in content(store, "u") if r[0] == "a"]
    assert versions == [1, 2, 3, 4] and sorted(text) == sorted("p0123")


def test_vacuum_keeps_what_is_read(spark, store):
    for i in range(3):
        store.begin().commit({"t": row(spark, (i, "new"))})
        store.compact("t")
    whole = content(store, "t")
    assert store.vacuum(2) > 0 and store.versions() == [5, 6] and content(store, "t") == whole == content(store, "t", 6)
    assert len(content(store, "u")) == 2 and store.vacuum(2) == 0


def test_store_edges(spark, store, tmp_path):
    from marquee.store.versioned import Conflict, Store

    with pytest.raises(ValueError, match="no key"):
        store.begin().commit({"t": row(spark, (None, "x"))})
    assert store.versions() == [0]
    assert store.begin().commit({"t": row(spark).filter("false")}) == 1 and len(content(store, "t")) == 40
    with pytest.raises(Conflict):
        store.create({})
    with pytest.raises(LookupError):
        Store(spark, str(tmp_path / "none"), store.kinds).manifest()
    assert content(store, "t", buckets=[]) == []
    assert store.begin().commit({"t": row(spark).withColumn("more", F.lit(1)).unionByName(row(spark, (1, "n")).withColumn("more", F.lit(2)))}) == 2


def test_two_racing_resolves(spark, tmp_path):
    """Of two batches that close one group, the second is refused and then told that it is closed."""
    from marquee.operators import desk, reviews
    from marquee.plans.review import _store
    from marquee.store.versioned import Conflict

    old = _store(spark, SF)
    store = desk.open_desk(spark, str(tmp_path / "desk"), 8)
    store.create(old._asdict() | {"candidates": model.candidates(spark, SF)})
    wanted = model.choices(spark, SF).join(old.groups.filter("status = 'open' and id % 10 = 1").limit(1).select(F.col("id").alias("group_id")), "group_id", "left_semi").persist()
    (group,) = [r.group_id for r in wanted.select("group_id").distinct().collect()]
    now = F.lit("2026-04-19T09:00:00Z")
    a, b = store.begin(), store.begin()
    told, changes = desk.resolving(a, wanted, now)
    assert told.first().error is None
    a.commit(changes)
    with pytest.raises(Conflict):
        b.commit(desk.resolving(b, wanted, now)[1])
    assert [r.error for r in desk.resolve(store, wanted, now).collect()] == ["group is closed"]
    # The old version has none of it, the new one all.
    for version, status, more in ((0, "open", 0), (1, "resolved", 1)):
        m = store.manifest(version)
        assert store.rows("groups", m).filter(F.col("id") == group).first().status == status
        assert store.rows("events", m).count() == old.events.count() + more
        assert store.rows("choices", m).filter((F.col("group_id") == group) & (F.col("updated_at") == "2026-04-19T09:00:00Z")).count() == 9 * more
    assert store.rows("groups", store.manifest()).count() == old.groups.count() and reviews.FIELDS


def test_counts_equal_the_full_queries_after_any_batches(spark, tmp_path):
    import random

    from marquee.operators import maintained, reviews, runs

    rng = random.Random(4)
    store = maintained.open_counts(spark, str(tmp_path / "counts"), 4)
    notes = ["import run 1", "Manual ingest run 2 review", "import run 3x", None]
    there = {"snap": [], "cand": [], "choice": [], "group": []}
    schemas = {"snap": "import_run_id long", "cand": "group_id long", "choice": "group_id long, field string", "group": "notes string, status string"}
    count = {"snap": maintained.count_snapshots, "cand": maintained.count_candidates, "choice": maintained.count_choices, "group": maintained.count_groups}
    new = {"snap": lambda: (rng.choice([1, 2, 3, None]),), "cand": lambda: (rng.randrange(4),), "choice": lambda: (rng.randrange(4), rng.choice("abc")), "group": lambda: (rng.choice(notes), rng.choice(["open", "resolved", " ", "odd"]))}
    for _ in range(3):
        for name, rows in there.items():
            went = [rows.pop(rng.randrange(len(rows))) for _ in range(rng.randrange(len(rows) + 1))]
            came = [new[name]() for _ in range(rng.randrange(12))]
            rows += came
            changes = [(*r, 1) for r in came] + [(*r, -1) for r in went]
            count[name](store, spark.createDataFrame(changes, schemas[name] + ", d int"))
    table = {name: spark.createDataFrame(rows, schemas[name]) for name, rows in there.items()}
    key = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    headers, ids = spark.createDataFrame([(i,) for i in range(5)], "id long"), ("id", "candidate_count", "draft_count")
    assert key(maintained.runs_with_counts(store, headers), "id", "snapshot_count") == key(runs.with_snapshot_count(headers, table["snap"]), "id", "snapshot_count")
    assert key(maintained.groups_with_counts(store, headers), *ids) == key(reviews.with_counts(headers, table["cand"], table["choice"]), *ids)
    assert key(maintained.status_summary(store, headers), "id", "summary") == key(reviews.status_summary(headers, table["group"]), "id", "summary")
    assert store.rows("field_counts", store.manifest()).filter("n <= 0").isEmpty()
