"""Staging by keyed state against the batch form, however the stream is cut."""

import random

import pytest
from pyspark.sql import functions as F

from marquee.operators.staging import staged
from marquee.streaming.staging import CLUSTERS, settled, start_staging

GROUPS = "id long, staging_key string"


def clusters(rng, n):
    keys = [f"v1:{k:02}" for k in range(12)]
    rows = {}
    for _ in range(n):
        at = (rng.randrange(6), rng.randrange(3), rng.randrange(9))
        name = rng.choice(["Desk", "Desk", "Desk", " ", ""])
        rows[at] = (*at, "title", name, rng.choice(["https://d.test/", "https://d.test/", "\t"]), "notes", rng.randrange(1, 4), rng.choice(keys))
    return list(rows.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_split_with_a_restart_stages_alike(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = clusters(rng, 60)
    groups = spark.createDataFrame([(5, "v1:03"), (4, "v1:03"), (9, "v1:07"), (7, None)], GROUPS)
    frame = spark.createDataFrame(rows, CLUSTERS)
    want = staged(groups, frame.withColumn("ordinal", F.struct("calendar", "candidate")), ids_by_key=True)
    names = ["run_id", "calendar", "candidate", "staging_key", "id", "result", "error"]
    rng.shuffle(rows)
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    starts = rng.randrange(2, 4)
    for k in range(starts):
        for part in range(k % 2 + 1):
            own = rows[k::starts][part :: k % 2 + 1]
            spark.createDataFrame(own, CLUSTERS).coalesce(1).write.mode("append").parquet(folder)
        # Groups count when the stream first starts; later ones, such as its own, are in the state.
        known = groups if not k else spark.createDataFrame([(1, "v1:00")], GROUPS)
        query = start_staging(spark, folder, known, out, state, 1)
        query.awaitTermination()
        assert query.exception() is None
    got = settled(spark.read.parquet(out))
    key = lambda df: sorted((tuple(r[c] for c in names) for r in df.select(*names).collect()), key=repr)
    assert key(got) == key(want)


def test_nothing_to_stage(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], CLUSTERS).write.parquet(folder)
    start_staging(spark, folder, spark.createDataFrame([], GROUPS), out, str(tmp_path / "state")).awaitTermination()
    start_staging(spark, folder, spark.createDataFrame([], GROUPS), out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.schema("run_id long").parquet(out).isEmpty()
