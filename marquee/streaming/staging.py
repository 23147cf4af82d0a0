"""Clusters staged as they arrive: a keyed state for each staging key.

A key's state is its group's id and the first cluster that has the key, by run and ordinal. Which of a key's
clusters is first must not depend on how the stream is cut into batches, so a cluster that comes late but is
earlier than the one that made the group takes its place: the stream says so in a row for each of the two. Of
the rows of a cluster the last counts, see ``settled``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marquee.operators.catalog import latest
from marquee.operators.staging import key_id, source_error

#: Clusters as a stream has them: those of operators.staging.clustered(), with their ordinal in two columns.
CLUSTERS = "run_id long, calendar long, candidate long, title string, source_name string, source_url string, notes string, n_candidates long, staging_key string"
#: What staging tells of a cluster; of several rows for one the last seq counts.
STAGED = "run_id long, calendar long, candidate long, staging_key string, id long, result string, error string, seq long"
_STATE = "id long, known boolean, run_id long, calendar long, candidate long, seq long"
_Staged = Row(*(c.split()[0] for c in STAGED.split(", ")))
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def flat(clusters: DataFrame) -> DataFrame:
    """clustered()'s rows as the stream takes them."""
    own = {"calendar": F.col("ordinal.calendar").cast("long"), "candidate": F.col("ordinal.candidate").cast("long"), "run_id": F.col("run_id").cast("long")}
    return clusters.withColumns(own).select(*(c.split()[0] for c in CLUSTERS.split(", ")))


class Stager(StatefulProcessor):
    """Gives each cluster of a key its group: created for the first, reused for the others and for all if the
    group was there before the stream."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._first = handle.getValueState("first", _STATE)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:
        self._first.update((initialState["own_id"], True, None, None, None, 0))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        state = tuple(self._first.get()) if self._first.exists() else None
        for r in rows:
            at = (r["run_id"], r["calendar"], r["candidate"])
            if r["error"] is not None:
                yield _Staged(*at, key[0], None, None, r["error"], 0)
                continue
            if state is None:
                state = (r["new_id"], False, *at, 1)
                yield _Staged(*at, key[0], state[0], "created", None, 1)
                continue
            group, known, first, seq = state[0], state[1], state[2:5], state[5] + 1
            if not known and at < first:
                yield _Staged(*at, key[0], group, "created", None, seq)
                yield _Staged(*first, key[0], group, "reused", None, seq)
                first = at
            else:
                yield _Staged(*at, key[0], group, "created" if not known and at == first else "reused", None, seq)
            state = (group, known, *first, seq)
        if state is not None:
            self._first.update(state)

    def close(self) -> None:
        pass


def stage_stream(clusters: DataFrame, groups: DataFrame) -> DataFrame:
    """STAGED rows for a stream of CLUSTERS. ``groups`` (id, staging_key) are those before the stream; they are
    read when it first starts, and after a restart the state alone counts. New groups take the id of their
    key, see operators.staging.key_id. Clusters are told apart by run and ordinal; a null key is a key."""
    clusters.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = clusters.select("run_id", "calendar", "candidate", "staging_key", source_error().alias("error"), key_id(F.col("staging_key")).alias("new_id"))
    own = groups.filter("staging_key is not null").groupBy("staging_key").agg(F.min("id").alias("own_id"))
    return rows.groupBy("staging_key").transformWithState(Stager(), STAGED, "append", "none", initialState=own.groupBy("staging_key"))


def start_staging(spark: SparkSession, folder: str, groups: DataFrame, out: str, checkpoint: str, files: int | None = None) -> StreamingQuery:
    """Stages the clusters in ``folder`` (Parquet) that are new since the last start into ``out``, in batches of
    at most ``files`` files."""
    source = spark.readStream.schema(CLUSTERS)
    if files is not None:
        source = source.option("maxFilesPerTrigger", files)
    staged = stage_stream(source.parquet(folder), groups)
    return staged.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(log: DataFrame) -> DataFrame:
    """Of what the stream said of each cluster the last."""
    return latest(log, ["run_id", "calendar", "candidate", "staging_key"], "seq").drop("seq")
