"""Tables that change together, by versions.

A version is one manifest in the folder ``log``: for every table, the folders of its base by bucket and of
its deltas. Data files are never changed. A batch writes deltas of the rows that it changes, compaction writes
the buckets that have deltas anew, and both become visible, in all tables at once, when their manifest is
there. A crash before that leaves files that no manifest names; readers of older versions keep theirs.
(Dynamic partition overwrite would save the list of folders, but it replaces files that those still read.)

Manifests are numbered without gaps and none replaces another, so of two writers who start from one version
the second finds the number taken. It is refused if the first wrote a bucket that it has read or written, or
if both wrote a table whose ids go on from the largest; otherwise it takes the next number. A refused
batch is run again from the new version, where it sees what the first one did.

Manifests are renamed into place. That is atomic in HDFS, which refuses a name that is taken; a local
folder, which serves tests, looks first and renames then, so writers read back who has the number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.catalog import latest
from marquee.store.place import delete


class Kind(NamedTuple):
    """Of a table: its key, none of whose columns is null; the column of it that tells the bucket; whether it
    has an ``id`` that new rows go on with."""

    key: tuple[str, ...]
    by: str
    numbered: bool = False


class Conflict(RuntimeError):
    """Another writer was first; run the batch again from the present version."""


class Store:
    """The tables ``kinds`` in the folder ``root``, each in as many ``buckets``."""

    def __init__(self, spark: SparkSession, root: str, kinds: dict[str, Kind], buckets: int = 64):
        self.spark, self.root, self.kinds, self.buckets = spark, root.rstrip("/"), kinds, buckets

    # manifests

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        files, log = self._files(), self._path("log")
        if not files.exists(log):
            return []
        names = (s.getPath().getName() for s in files.listStatus(log))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            found = self.versions()
            if not found:
                raise LookupError(f"there is no store in {self.root}")
            version = found[-1]
        stream = self._files().open(self._path("log", f"{version:012}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> bool:
        """Whether the manifest got its number."""
        jvm, gateway, files = self.spark._jvm, self.spark.sparkContext._gateway, self._files()
        temp, path = self._path("log", f".{uuid.uuid4().hex}"), self._path("log", f"{manifest['version']:012}.json")
        if files.exists(path):
            return False
        out = files.create(temp, False)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        renames = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(renames, 1)
        how[0] = renames.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(temp, path, how)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            files.delete(temp, False)
            return False
        return self.manifest(manifest["version"])["writer"] == manifest["writer"]

    # rows

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(self.kinds[name].by)), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame, folder: str) -> list[int]:
        """Writes ``rows`` with their bucket, and returns the buckets."""
        kind, path = self.kinds[name], f"{self.root}/{name}/{folder}"
        dealt = rows.withColumn("bucket", self.bucket(name))
        dealt.repartition("bucket").write.partitionBy("bucket").parquet(path)
        there = self._files()
        found = [s.getPath().getName() for s in there.listStatus(self._path(name, folder))]
        buckets = sorted(int(n.removeprefix("bucket=")) for n in found if n.startswith("bucket=") and not n.endswith("PARTITION__"))
        if buckets:
            missing = F.lit(False)
            for c in kind.key:
                missing = missing | F.col(c).isNull()
            if not self.spark.read.parquet(path).filter(missing).isEmpty():
                raise ValueError(f"a row of {name} has no key")
        return buckets

    def _read(self, name: str, schema: str, folders: list[tuple[str, int]]) -> DataFrame:
        paths = [f"{self.root}/{name}/{folder}/bucket={b}" for folder, b in folders]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def rows(self, name: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """The table at a version, or its rows in ``buckets``. A changed key has its last delta."""
        table, kind = manifest["tables"][name], self.kinds[name]
        own = lambda b: buckets is None or int(b) in buckets
        base = self._read(name, table["schema"], [(folder, int(b)) for b, folder in table["base"].items() if own(b)])
        changed = [(d["folder"], b) for d in table["deltas"] for b in d["buckets"] if own(b)]
        if not changed:
            return base
        delta = latest(self._read(name, f"{table['schema']}, _deleted boolean, _version long", changed), list(kind.key), "_version")
        kept = base.join(delta.select(*kind.key), list(kind.key), "left_anti")
        return kept.unionByName(delta.filter("not _deleted").select(*base.columns))

    # writing

    def create(self, tables: dict[str, DataFrame]) -> None:
        """The first version. Keys of ``tables`` are distinct."""
        found = {}
        for name, rows in tables.items():
            folder = f"base-{uuid.uuid4().hex}"
            buckets = self._write(name, rows, folder)
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
            found[name] = {"schema": schema, "base": {str(b): folder for b in buckets}, "deltas": []}
            if self.kinds[name].numbered:
                found[name]["top"] = self._read(name, schema, [(folder, b) for b in buckets]).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        if not self._publish({"version": 0, "writer": uuid.uuid4().hex, "wrote": {}, "tables": found}):
            raise Conflict(f"there is a store in {self.root}")

    def begin(self) -> Transaction:
        return Transaction(self)

    def _check(self, since: int, version: int, touched: dict[str, set[int]], numbered: set[str]) -> None:
        for v in range(since + 1, version + 1):
            for name, buckets in self.manifest(v)["wrote"].items():
                if touched.get(name, set()) & set(buckets) or name in numbered:
                    raise Conflict(f"version {v} changed {name}")

    def _commit(self, began: dict, wrote: dict[str, list[int]], touched: dict[str, set[int]], numbered: set[str], apply: Callable[[dict], None]) -> int:
        """A new version: the last one with ``apply`` done to its tables, unless it conflicts."""
        seen, now = began["version"], self.manifest()
        while True:
            self._check(seen, now["version"], touched, numbered)
            seen = now["version"]
            tables = json.loads(json.dumps(now["tables"]))
            apply(tables)
            if self._publish({"version": seen + 1, "writer": uuid.uuid4().hex, "wrote": wrote, "tables": tables}):
                return seen + 1
            now = self.manifest()

    def compact(self, name: str, buckets: list[int] | None = None) -> list[int]:
        """Writes the buckets with deltas (of ``buckets``, or all) as base, and returns which these were."""
        began = self.manifest()
        dirty = {b for d in began["tables"][name]["deltas"] for b in d["buckets"]}
        dirty = sorted(dirty if buckets is None else dirty & set(buckets))
        if dirty:
            folder = f"base-{uuid.uuid4().hex}"
            full = self._write(name, self.rows(name, began, dirty), folder)

            def apply(tables: dict) -> None:
                table = tables[name]
                for b in dirty:
                    table["base"].pop(str(b), None)
                table["base"].update({str(b): folder for b in full})
                for d in table["deltas"]:
                    d["buckets"] = [b for b in d["buckets"] if b not in dirty]
                table["deltas"] = [d for d in table["deltas"] if d["buckets"]]

            self._commit(began, {name: dirty}, {name: set(dirty)}, set(), apply)
        return dirty

    def vacuum(self, keep: int) -> int:
        """Deletes what only versions before the last ``keep`` name, and returns how many folders these
        were. Folders that no version names, of batches under way or lost, stay."""
        versions = self.versions()
        old, new = versions[:-keep] if keep else versions[:-1], versions[-max(1, keep) :]
        named = lambda vs: {(n, f) for v in vs for n, t in self.manifest(v)["tables"].items() for f in [*t["base"].values(), *(d["folder"] for d in t["deltas"])]}
        gone = named(old) - named(new)
        for v in old:
            delete(self.spark, f"{self.root}/log/{v:012}.json")
        for name, folder in gone:
            delete(self.spark, f"{self.root}/{name}/{folder}")
        return len(gone)


class Transaction:
    """A batch on the version that was last when it began."""

    def __init__(self, store: Store):
        self.store, self.began, self.read = store, store.manifest(), {}

    def rows(self, name: str, keys: DataFrame | None = None) -> DataFrame:
        """The table, or its buckets with the values in ``keys`` (one column, like the table's ``by``). What is
        gathered is at most all numbers of buckets."""
        buckets = None
        if keys is not None:
            column = keys.columns[0]
            hit = F.pmod(F.xxhash64(F.col(column)), F.lit(self.store.buckets)).cast("int")
            buckets = sorted(keys.filter(F.col(column).isNotNull()).agg(F.collect_set(hit)).first()[0])
        self.read.setdefault(name, set()).update(range(self.store.buckets) if buckets is None else buckets)
        return self.store.rows(name, self.began, buckets)

    def top(self, name: str) -> DataFrame:
        """One row with the largest id that the table ever had."""
        return self.store.spark.createDataFrame([(self.began["tables"][name]["top"],)], "id long")

    def commit(self, changes: dict[str, DataFrame]) -> int:
        """Writes the changed rows, which have all columns of their table and perhaps _deleted, as one
        version, and returns its number. Raises Conflict, and changes nothing, if another writer was first."""
        store, version = self.store, self.began["version"] + 1
        deltas, tops, wrote = {}, {}, {}
        for name, rows in changes.items():
            columns = [f.name for f in store.spark.createDataFrame([], self.began["tables"][name]["schema"]).schema]
            gone = F.col("_deleted") if "_deleted" in rows.columns else F.lit(False)
            folder = f"delta-{uuid.uuid4().hex}"
            buckets = store._write(name, rows.select(*columns, gone.alias("_deleted"), F.lit(version).cast("long").alias("_version")), folder)
            if buckets:
                deltas[name], wrote[name] = {"folder": folder, "buckets": buckets}, buckets
                if store.kinds[name].numbered:
                    tops[name] = store._read(name, "id long", [(folder, b) for b in buckets]).agg(F.max("id")).first()[0]

        def apply(tables: dict) -> None:
            for name, delta in deltas.items():
                tables[name]["deltas"].append(delta)
                if name in tops:
                    tables[name]["top"] = max(tables[name]["top"], tops[name])

        touched = {name: self.read.get(name, set()) | set(wrote.get(name, [])) for name in {*self.read, *wrote}}
        return store._commit(self.began, wrote, touched, set(tops), apply)


def transact(store: Store, batch: Callable[[Transaction], dict[str, DataFrame]], tries: int = 5) -> int:
    """Runs ``batch`` until it isn't refused: each time on the present version, from the beginning."""
    for left in range(tries - 1, -1, -1):
        transaction = store.begin()
        try:
            return transaction.commit(batch(transaction))
        except Conflict:
            if not left:
                raise
    raise AssertionError("tries is positive")
