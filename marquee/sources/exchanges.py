"""Recorded HTTP exchanges as a data source, in the WARC format, and fetching from them.

``spark.read.format("exchanges").load(folder)`` gives a row for each response record of the folder's
``.warc`` files, a partition for each file. Filters on url and status_code are pushed into the reader: heads
are read first, and the body of a record that doesn't pass is skipped, as is every body with the option
``bodies`` set to false. ``df.write.format("exchanges")``
records rows, a file for each task. register() makes the format known to a session.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from marquee.sources.envelope import MAX_BODY
from marquee.sources.extract import resolve
from marquee.store.place import opened, written

SCHEMA = "url string, status string, status_code int, content_type string, content_length long, location string, target string, captured_at string, body binary"
_ARROW = pa.schema([(name, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))])
#: Rows, and bytes of bodies, of a batch that the reader gives.
_BATCH_ROWS, _BATCH_BYTES = 2000, 8 << 20
#: Responses that send a client on, and the request that a chain of them ends before.
REDIRECTS, MOST_REQUESTS = (301, 302, 303, 307, 308), 10
STOPPED, UNRECORDED = f"stopped after {MOST_REQUESTS} redirects", "no recorded exchange"
#: Exchanges of a file that recorded() writes.
FILE_ROWS = 100_000
#: Bytes of a line of a head at most, and of heads that are looked for as a whole.
_HEAD, _WHOLE = 1 << 20, 1 << 13
#: Both heads of a response as record() writes them, after empty lines; _Lines and _head() read all others.
_OWN = re.compile(
    rb"(?:\r\n)*+WARC/1\.[0-9]\r\nWARC-Type: response\r\nWARC-Record-ID: [^\r\n]*+\r\nWARC-Target-URI: ([^\r\n]*+)\r\nWARC-Date: ([^\r\n]*+)\r\nContent-Type: [^\r\n]*+\r\nContent-Length: ([0-9]{1,15})\r\n\r\n"
    rb"(HTTP/1\.[0-9] ([^\r\n]*+)\r\nContent-Type: ([^\r\n]*+)\r\nContent-Length: ([0-9]{0,15})\r\n(?:Location: ([^\r\n]*+)\r\n)?\r\n)"
)


def _head(lines: Iterator[bytes]) -> dict[str, str]:
    """Fields up to an empty line, by their names in lower case; the first of a name counts. Under the empty
    name stands that there was such a line."""
    out: dict[str, str] = {}
    for line in lines:
        if not line.strip():
            return out | {"": "whole"}
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon and name.strip():
            out.setdefault(name.strip().lower(), value.strip())
    return out


@lru_cache(1 << 10)
def _known(value: bytes) -> str:
    """A field whose values repeat, as text."""
    return value.decode("utf-8", "replace").strip()


class _Lines:
    """Buffered lines and bytes of a stream, read forward."""

    def __init__(self, stream: object, chunk: int = 1 << 20):
        self._stream, self._chunk, self._data, self._at, self._ended = stream, chunk, b"", 0, False

    def _more(self) -> bool:
        found = self._stream.read(self._chunk)
        self._data, self._at, self._ended = self._data[self._at :] + found, 0, not found
        return bool(found)

    def own(self) -> tuple[bytes, ...] | None:
        """The groups of _OWN if such heads come next, which are then passed."""
        while len(self._data) - self._at < _WHOLE and not self._ended:
            self._more()
        m = _OWN.match(self._data, self._at, self._at + _WHOLE)
        if m is None or m.end(4) - m.start(4) > int(m[3]):
            return None
        self._at = m.end()
        return m.groups()

    def line(self) -> bytes:
        end = self._data.find(b"\n", self._at)
        while end < 0 and len(self._data) - self._at < _HEAD:
            seen = len(self._data) - self._at
            if not self._more():
                end = len(self._data) - 1
                break
            end = self._data.find(b"\n", seen)
        end = end if end >= 0 else min(len(self._data), self._at + _HEAD) - 1
        out, self._at = self._data[self._at : end + 1], end + 1
        return out

    def lines(self) -> Iterator[bytes]:
        while line := self.line():
            yield line

    def take(self, n: int) -> bytes:
        own = self._data[self._at : self._at + n]
        self._at += len(own)
        return own + self._stream.read(n - len(own)) if len(own) < n else own

    def skip(self, n: int) -> None:
        own = min(n, len(self._data) - self._at)
        self._at += own
        if own < n:
            self._stream.seek(self._stream.tell() + n - own)
            self._ended = False


def read_records(stream: object, keeps: Callable[[str, int], bool] = lambda url, code: True, bodies: bool = True) -> Iterator[tuple]:
    """Rows of SCHEMA of the response records of a WARC file whose url and code ``keeps`` lets through. A
    record whose body is cut off at the end, or that is no response, is left out; without ``bodies`` none is
    read, and a cut is not seen."""
    source = _Lines(stream)
    while True:
        own = source.own()
        if own is not None:
            url, at, size, http, status, kind, length, location = own
            url, left = url.decode("utf-8", "replace").strip().strip("<>"), int(size) - len(http)
            status, kind, at, location = _known(status), _known(kind), _known(at), location.decode("utf-8", "replace").strip() if location is not None else None
        else:
            line = source.line()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                continue
            head = _head(source.lines())
            if "" not in head:
                return
            size = int(head["content-length"]) if head.get("content-length", "").isdigit() else 0
            if head.get("warc-type", "").lower() != "response" or "warc-target-uri" not in head:
                source.skip(size)
                continue
            before: list[int] = []

            def counted() -> Iterator[bytes]:
                while sum(before) < size and (x := source.line()):
                    before.append(len(x))
                    yield x

            http = counted()
            first = next(http, b"").decode("utf-8", "replace").split(None, 1)
            fields = _head(http)
            if sum(before) < size and "" not in fields:
                return
            status = first[1].strip() if len(first) > 1 else ""
            url, left = head["warc-target-uri"].strip("<>"), max(0, size - sum(before))
            at, kind, length, location = head.get("warc-date", ""), fields.get("content-type", ""), fields.get("content-length", ""), fields.get("location")
        code = int(status[:3]) if status[:3].isdigit() else 0
        if not keeps(url, code):
            source.skip(left)
            continue
        body = source.take(left) if bodies else source.skip(left)
        if bodies and len(body) < left:
            return
        yield url, status, code, kind, int(length) if length.isdigit() else -1, location, (resolve(url, location) or "").partition("#")[0] or None if location else None, at, body


_BYTES = pa.large_binary()


def _joined(*parts: str | pa.Array) -> pa.Array:
    """Texts and columns of texts put together, row by row."""
    return pc.binary_join_element_wise(*(pa.scalar(p.encode(), _BYTES) if isinstance(p, str) else p for p in parts), pa.scalar(b"", _BYTES))


def _records(rows: pa.RecordBatch, ids: str, first: int = 0) -> pa.Array:
    """The record of each of ``rows`` (columns of SCHEMA), numbered from ``first`` behind the id that they share.
    Null texts are empty; line ends in heads are spaces."""

    def text(name: str) -> pa.Array:
        own = pc.fill_null(rows.column(name).cast(pa.large_string()), "")
        for mark in "\r\n":
            own = pc.replace_substring(own, mark, " ")
        return own.cast(_BYTES)

    digits = lambda numbers: numbers.cast(pa.large_string()).cast(_BYTES)
    body = pc.fill_null(rows.column("body").cast(_BYTES), b"")
    place = text("location")
    location = pc.if_else(pc.equal(pc.binary_length(place), 0), pa.scalar(b"", _BYTES), _joined("\r\nLocation: ", place))
    http = _joined("HTTP/1.1 ", text("status"), "\r\nContent-Type: ", text("content_type"), "\r\nContent-Length: ", digits(pc.binary_length(body)), location, "\r\n\r\n")
    number = pa.array([b"%012x" % i for i in range(first, first + rows.num_rows)], _BYTES)
    size = digits(pc.add(pc.binary_length(http), pc.binary_length(body)))
    return _joined(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{ids[:24]}", number, ">\r\nWARC-Target-URI: ", text("url"), "\r\nWARC-Date: ", text("captured_at"), "\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: ", size, "\r\n\r\n", http, body, "\r\n\r\n")


def _slices(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``rows`` in parts whose bodies have _BATCH_BYTES at most, or of one row."""
    start, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(rows.column("body")), 0).to_pylist()):
        if i > start and size + n > _BATCH_BYTES:
            yield rows.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < rows.num_rows:
        yield rows.slice(start)


def record(url: str, status: str, content_type: str, location: str | None, captured_at: str, body: bytes) -> bytes:
    own = {"url": url, "status": status, "content_type": content_type, "location": location, "captured_at": captured_at, "body": body}
    rows = pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary() if k == "body" else pa.string()) for k, v in own.items()})
    return _records(rows, str(uuid.uuid4()))[0].as_py()


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, bodies: bool):
        self.path, self.bodies, self.urls, self.starts, self.codes = path, bodies, None, (), None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps what a head can answer, and hands back the rest."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("url",), ("status_code",)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                name = "urls" if f.attribute == ("url",) else "codes"
                setattr(self, name, values if getattr(self, name) is None else getattr(self, name) & values)
            elif isinstance(f, StringStartsWith) and f.attribute == ("url",):
                self.starts = (*self.starts, f.value)
            else:
                yield f

    def partitions(self) -> list[_File]:
        system, path = opened(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.path.endswith(".warc")]

    def _keeps(self, url: str, code: int) -> bool:
        return (self.urls is None or url in self.urls) and (self.codes is None or code in self.codes) and all(url.startswith(s) for s in self.starts)

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.path is None:
            return
        system, _ = opened(self.path)
        rows, size = [], 0
        with system.open_input_file(partition.path) as stream:
            for row in read_records(stream, self._keeps, self.bodies):
                rows.append(row)
                size += len(row[-1] or b"")
                if len(rows) == _BATCH_ROWS or size > _BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        """One file, under a name that no reader takes until the commit."""
        system, path = opened(self.path)
        system.create_dir(path, recursive=True)
        name = f"{path}/part-{uuid.uuid4().hex}.open"
        ids, n = str(uuid.uuid4()), 0
        with system.open_output_stream(name) as out:
            for b in batches:
                for rows in _slices(b):
                    own = _records(rows, ids, n)
                    # one buffer holds the column's records one behind the other
                    out.write(own.buffers()[2].slice(0, pc.sum(pc.binary_length(own)).as_py()))
                    n += rows.num_rows
        return _Written(name)

    def commit(self, messages: list[_Written | None]) -> None:
        system, path = opened(self.path)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if x.path.endswith(".warc"):
                    system.delete_file(x.path)
        for m in messages:
            if m is not None:
                system.move(m.path, m.path.removesuffix(".open") + ".warc")

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = opened(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.path)


class Exchanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "exchanges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], self.options.get("bodies", "true").lower() != "false")

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def recorded(rows: DataFrame, folder: str) -> None:
    """Records ``rows`` in files of at most about FILE_ROWS exchanges, and in as many as the session has cores:
    a file is written, and read, by one task."""
    spark = rows.sparkSession
    files = max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / FILE_ROWS))
    rows.repartition(files, "url").write.format("exchanges").mode("append").save(folder)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Exchanges)


def _sends_on() -> Column:
    return F.coalesce(F.col("status_code").isin(*REDIRECTS) & F.col("target").isNotNull(), F.lit(False))


def _jumps(exchanges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The addresses that send on (id, url, target), and where each leads (id, at, steps, moving): ``at`` is the last
    address of its way that sends on, by id, ``steps`` away. In a loop, and on the way to one, it is ``moving``.

    By pointer jumping: in each round every address takes over where the address that it points at points, so a
    chain of n takes log n rounds. Addresses that are still on the way after a round in which none arrived
    never will. Addresses are compared as text once, and rounds join their numbers; only those still on the way
    are joined and written again.
    """
    # dealt by url before it is grouped, which sorts the rows once
    last = exchanges.repartition("url").groupBy("url").agg(F.max(F.struct("captured_at", "status_code", "target")).alias("_last")).select("url", "_last.status_code", "_last.target")
    hops = written(last.filter(_sends_on()).select(F.monotonically_increasing_id().alias("id"), "url", "target"), "hops")
    onward = hops.select(F.col("url").alias("_url"), F.col("id").alias("_next"))
    first = hops.join(onward, F.col("target") == F.col("_url"), "left")
    moving = F.col("_next").isNotNull()
    state = written(first.select("id", F.coalesce("_next", "id").alias("at"), moving.cast("long").alias("steps"), moving.alias("moving")), "jumps")
    arrived, left = state.filter("not moving"), state.filter("moving").count()
    while left:
        way = state.filter("moving")
        known = arrived.unionByName(way).select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("moving").alias("_moving"))
        further = way.join(known, F.col("at") == F.col("_id"))
        state = written(further.select("id", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_moving").alias("moving")), "jumps")
        arrived, before, left = arrived.unionByName(state.filter("not moving")), left, state.filter("moving").count()
        if left == before:
            break
    return hops, arrived.unionByName(state.filter("moving"))


def _alone(rows: DataFrame) -> Column:
    """A negative number for each row, to join by where it has no key: nulls would meet in one task."""
    return -1 - F.pmod(F.xxhash64(*(rows[c] for c, kind in rows.dtypes if "map<" not in kind)), F.lit(1 << 40))


def _led(rows: DataFrame, url: str, exchanges: DataFrame) -> DataFrame:
    """``rows`` with _final, the address that their column ``url`` leads to, and _hops; both are null for one that doesn't
    send on. In a loop, and on the way to one, _hops is null alone."""
    hops, jumps = _jumps(exchanges)
    own = hops.select(F.col("id").alias("_id"), F.col("url").alias("_url"))
    ways = jumps.select(F.col("id").alias("_from"), F.col("at").alias("_to"), "steps", "moving")
    last = hops.select(F.col("id").alias("_last"), F.col("target").alias("_final"))
    started = rows.join(own, rows[url] == F.col("_url"), "left").withColumn("_start", F.coalesce("_id", _alone(rows)))
    led = started.join(ways, F.col("_start") == F.col("_from"), "left").withColumn("_end", F.coalesce("_to", _alone(rows)))
    at = led.join(last, F.col("_end") == F.col("_last"), "left")
    return at.select(*(rows[c] for c in rows.columns), "_final", F.when(~F.col("moving"), F.col("steps") + 1).alias("_hops"))


def ends(exchanges: DataFrame) -> DataFrame:
    """url, final_url and hops of every address that sends on; hops is null in a loop, and on the way to one. Of
    exchanges of one url the latest counts."""
    every = exchanges.filter(_sends_on()).select("url").distinct()
    return _led(every, "url", exchanges).filter("_final is not null").withColumnsRenamed({"_final": "final_url", "_hops": "hops"})


def fetched(wanted: DataFrame, exchanges: DataFrame, heads: DataFrame | None = None, limit: int = MAX_BODY) -> DataFrame:
    """What a client that follows redirects gets for each url of ``wanted``: final_url, hops, status,
    status_code, content_type, content_length, captured_at, body, truncated (over ``limit`` bytes), error and
    loop, beside the columns of ``wanted``. Of exchanges of one url the latest counts. Bodies are joined last,
    by the final address alone. Exchanges are read once, and written with the bodies of those that don't send on; given
    ``heads``, the exchanges without bodies, for all that comes before, they are read again for the bodies instead. A url
    that is null is not recorded."""
    names = ("status", "status_code", "content_type", "content_length", "captured_at", "body")
    head = ("url", "status_code", "target", "captured_at")
    if heads is None:
        exchanges = heads = written(exchanges.select("url", "target", *names[:-1], F.when(~_sends_on(), F.col("body")).alias("body")), "exchanges")
    else:
        heads = written(heads.select(*head), "heads")
    at = _led(wanted, "url", heads.select(*head))
    loop = F.col("_final").isNotNull() & F.col("_hops").isNull()
    stopped = loop | (F.coalesce("_hops", F.lit(0)) >= MOST_REQUESTS)
    at = at.select(*(wanted[c] for c in wanted.columns), F.when(stopped, None).otherwise(F.coalesce("_final", wanted["url"])).alias("final_url"), F.when(~stopped, F.coalesce("_hops", F.lit(0))).alias("hops"), stopped.alias("_stopped"), loop.alias("loop"))
    # whatever sends on last is no final address, so what doesn't send on is compared among itself
    last = F.max(F.struct("captured_at", *(n for n in names if n != "captured_at"))).alias("_row")
    one = exchanges.filter(~_sends_on()).repartition("url").groupBy(F.col("url").alias("_at")).agg(last).select("_at", *(F.col(f"_row.{n}").alias(f"_{n}") for n in names))
    keyed = at.withColumn("_key", F.coalesce("final_url", _alone(at).cast("string")))
    joined = keyed.join(one, F.col("final_url").isNotNull() & (F.col("_key") == F.col("_at")), "left")
    error = F.when(F.col("_stopped"), STOPPED).when(F.col("_at").isNull(), UNRECORDED)
    own = [F.col(f"_{n}").alias(n) for n in names if n != "body"]
    return joined.select(*at.drop("_stopped", "loop").columns, *own, F.substring("_body", 1, limit).alias("body"), (F.length("_body") > limit).alias("truncated"), error.alias("error"), "loop")
