"""Matroska media columns: parsing EBML into packet tables, and writing lossless PCM tracks.

A file is read element by element through variable-length ids and sizes: header, segment, tracks,
clusters with simple blocks and block groups, all four kinds of lacing, and cues. Each frame becomes
a packet with its track, timestamp, byte range, and whether it is a key frame. The frames of a lace
follow one another by their track's default duration, or by equal parts of the block's duration.
A file is read whole by one task; of a broken one, what is wrong is told and nothing is raised.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import batch, materialize, tidy

#: Element ids of Matroska.
EBML, DOC_TYPE, SEGMENT, INFO, SCALE = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1
EBML_VERSION, EBML_READ, MAX_ID, MAX_SIZE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4287, 0x4285
MUXER, WRITER = 0x4D80, 0x5741
TRACKS, TRACK, NUMBER, KIND, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86
TRACK_UID, TRACK_LACING, DEFAULT_DURATION, BLOCK_DURATION = 0x73C5, 0x9C, 0x23E383, 0x9B
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Master elements that may follow a cluster of unknown size, and so end it.
TOP_LEVEL = (CLUSTER, CUES, TRACKS, INFO, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367)
NO_LACING, XIPH, FIXED, EBML_LACING = range(4)

#: Bytes of a frame, frames of a block and blocks of a cluster that mux() writes; 8000 samples a second.
FRAME, LACE, CLUSTER_BLOCKS, SAMPLE_RATE = 1024, 8, 16, 8000
FRAME_NS = FRAME * 1_000_000_000 // SAMPLE_RATE
_MOST = (1 << 63) - 1


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, next place, unknown): a variable-length number; unknown if all its bits are set."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length number at byte {at}")
    n = 9 - first.bit_length()
    if at + n > len(data):
        raise ValueError(f"a number at byte {at} is cut off")
    value = int.from_bytes(data[at : at + n], "big")
    plain = value & ((1 << 7 * n) - 1)
    return (value if keep_marker else plain), at + n, plain == (1 << 7 * n) - 1


def write_vint(value: int, size: int = 0) -> bytes:
    """``value`` as a variable-length number of ``size`` bytes, or of as few as hold it."""
    n = size or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def elements(data: bytes, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end of the payload) of the elements from ``start`` on. An element of unknown size
    goes on to the next top-level one, or to ``end``."""
    at = start
    while at < end:
        key, at, _ = read_vint(data, at, keep_marker=True)
        size, at, unknown = read_vint(data, at)
        if unknown:
            stop = end
            if key == CLUSTER:
                stop = at
                while stop < end:
                    inner, after, _ = read_vint(data, stop, keep_marker=True)
                    if inner in TOP_LEVEL:
                        break
                    size, after, _ = read_vint(data, after)
                    stop = after + size
        else:
            stop = at + size
        if stop > end:
            raise ValueError(f"element {key:X} at byte {at} is cut off")
        yield key, at, stop
        at = stop


def _number(data: bytes, start: int, end: int) -> int:
    if end - start > 8:
        raise ValueError(f"the number at byte {start} has over eight bytes")
    return int.from_bytes(data[start:end], "big")


def _time(ticks: int, scale: int) -> int:
    ns = ticks * scale
    if not -_MOST <= ns <= _MOST:
        raise ValueError(f"the time {ns} ns does not fit 64 bits")
    return ns


def laced_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames, and where the first begins."""
    if lacing == NO_LACING:
        return [end - at], at
    if at >= end:
        raise ValueError(f"the block that ends at byte {end} lacks its lacing")
    n, at = data[at] + 1, at + 1
    if lacing == FIXED:
        if (end - at) % n:
            raise ValueError(f"fixed lacing at byte {at} does not divide evenly")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if lacing == XIPH:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        elif not k:
            size, at, _ = read_vint(data, at)
        else:
            begin = at
            value, at, _ = read_vint(data, at)
            size = sizes[-1] + value - ((1 << 7 * (at - begin) - 1) - 1)
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min([*sizes, 0]) < 0:
        raise ValueError(f"lacing at byte {at} has sizes that don't fit")
    return [*sizes, last], at


def _block(data: bytes, start: int, end: int, cluster_time: int, key: bool | None, scale: int, durations: dict[int, int], block_ticks: int | None = None) -> list[tuple]:
    track, at, _ = read_vint(data, start)
    if at + 3 > end:
        raise ValueError(f"the block at byte {start} is shorter than its head")
    if track >= 1 << 31:
        raise ValueError(f"the track number at byte {start} does not fit 31 bits")
    offset, flags = struct.unpack_from(">hB", data, at)
    lacing = flags >> 1 & 3
    sizes, at = laced_sizes(data, at + 3, end, lacing)
    begin = _time(cluster_time + offset, scale)
    step = durations.get(track) or (_time(block_ticks, scale) // len(sizes) if block_ticks else 0)
    out = []
    for k, size in enumerate(sizes):
        out.append((track, _time(begin + k * step, 1), at, size, bool(flags & 0x80) if key is None else key, lacing, k))
        at += size
    return out


def demux(data: bytes) -> dict:
    """tracks, packets and cues of a file. A packet: (track, timestamp in ns, first byte, bytes, key
    frame, lacing, place in its lace). Raises ValueError, and nothing else, if the bytes are no whole
    Matroska file: what is cut off, lacks an element that must be there, or has numbers too large."""
    out: dict = {"doc_type": "", "tracks": [], "packets": [], "cues": []}
    try:
        for key, start, end in elements(data, 0, len(data)):
            if key == EBML:
                out["doc_type"] = next((data[s:e].decode() for k, s, e in elements(data, start, end) if k == DOC_TYPE), "")
            elif key == SEGMENT:
                _segment(data, start, end, out)
    except (IndexError, struct.error) as e:
        raise ValueError("the file is cut off") from e
    except KeyError as e:
        raise ValueError(f"an element {e.args[0]:X} is missing") from e
    if not out["doc_type"]:
        raise ValueError("the file has no EBML header")
    return out


def _segment(data: bytes, segment: int, end: int, out: dict) -> None:
    scale, durations = 1_000_000, {}
    for key, s, e in elements(data, segment, end):
        if key == INFO:
            scale = next((_number(data, a, b) for k, a, b in elements(data, s, e) if k == SCALE), scale)
        elif key == TRACKS:
            for k, a, b in elements(data, s, e):
                if k == TRACK:
                    has = {k: (x, y) for k, x, y in elements(data, a, b)}
                    number = _number(data, *has[NUMBER])
                    out["tracks"].append({"number": number, "kind": _number(data, *has[KIND]), "codec": data[slice(*has[CODEC])].decode()})
                    if DEFAULT_DURATION in has:
                        durations[number] = _number(data, *has[DEFAULT_DURATION])
        elif key == CLUSTER:
            time = 0
            for k, a, b in elements(data, s, e):
                if k == TIME:
                    time = _number(data, a, b)
                elif k == SIMPLE_BLOCK:
                    out["packets"] += _block(data, a, b, time, None, scale, durations)
                elif k == BLOCK_GROUP:
                    inner = list(elements(data, a, b))
                    key_frame = all(x != REFERENCE for x, _, _ in inner)
                    ticks = next((_number(data, p, q) for x, p, q in inner if x == BLOCK_DURATION), None)
                    for x, p, q in inner:
                        if x == BLOCK:
                            out["packets"] += _block(data, p, q, time, key_frame, scale, durations, ticks)
        elif key == CUES:
            for k, a, b in elements(data, s, e):
                if k == CUE:
                    has = {k: (x, y) for k, x, y in elements(data, a, b)}
                    place = {k: _number(data, x, y) for k, x, y in elements(data, *has[CUE_PLACES])}
                    track, cluster = place.get(CUE_TRACK, 0), segment + place[CUE_CLUSTER]
                    if track >= 1 << 31 or cluster > _MOST:
                        raise ValueError(f"the cue at byte {a} has numbers that don't fit")
                    out["cues"].append((_time(_number(data, *has[CUE_TIME]), scale), track, cluster))


def _element(key: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + write_vint(len(body)) + body


def _uint(key: int, value: int) -> bytes:
    return _element(key, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], lacing: int) -> bytes:
    """Lacing header and frames of a block."""
    if lacing == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING and len(frames) > 1:
        head += write_vint(sizes[0])
        for before, n in zip(sizes, sizes[1:-1]):
            d = n - before
            width = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            head += write_vint(d + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


_HEADER = _element(EBML, _uint(EBML_VERSION, 1), _uint(EBML_READ, 1), _uint(MAX_ID, 4), _uint(MAX_SIZE, 8), _element(DOC_TYPE, b"matroska"), _uint(DOC_VERSION, 4), _uint(DOC_READ, 2))
_INFO = _element(INFO, _uint(SCALE, 1_000_000), _element(MUXER, b"marquee"), _element(WRITER, b"marquee"))
_AUDIO = _element(AUDIO, _element(RATE, struct.pack(">d", SAMPLE_RATE)), _uint(CHANNELS, 1), _uint(DEPTH, 8))
_TRACKS = _element(TRACKS, _element(TRACK, _uint(NUMBER, 1), _uint(TRACK_UID, 1), _uint(KIND, 2), _uint(TRACK_LACING, 1), _uint(DEFAULT_DURATION, FRAME_NS), _element(CODEC, b"A_PCM/INT/LIT"), _AUDIO))


def mux(payload: bytes) -> bytes:
    """A file with ``payload`` as 8-bit samples of one PCM track: clusters of laced blocks, with cues."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    body, cues, per_block = [_INFO, _TRACKS], [], FRAME * LACE
    at = len(_INFO) + len(_TRACKS)
    for c in range(0, len(frames), LACE * CLUSTER_BLOCKS):
        time = c * FRAME * 1000 // SAMPLE_RATE
        blocks = [_uint(TIME, time)]
        for b in range(c, min(len(frames), c + LACE * CLUSTER_BLOCKS), LACE):
            part = frames[b : b + LACE]
            lacing = NO_LACING if len(part) == 1 else FIXED if len(part[-1]) == FRAME else EBML_LACING
            offset = b * FRAME * 1000 // SAMPLE_RATE - time
            blocks.append(_element(SIMPLE_BLOCK, write_vint(1), struct.pack(">hB", offset, 0x80 | lacing << 1), lace(part, lacing)))
        cluster = _element(CLUSTER, *blocks)
        cues.append(_element(CUE, _uint(CUE_TIME, time), _element(CUE_PLACES, _uint(CUE_TRACK, 1), _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return _HEADER + _element(SEGMENT, *body, _element(CUES, *cues))


def padded(text: str | None, unit: int = 64) -> bytes:
    """UTF-8 of a text (null: empty) and zero bytes up to a positive multiple of ``unit``."""
    raw = (text or "").encode()
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text and media, the Matroska file of its padded bytes; see padded().

    A null or empty text is a file of 64 zero bytes, a very long one is a file in one task's memory.
    Rows that repeat stay, a null doc_id too; an empty table stays empty; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.large_binary())])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield batch(schema, [b.column(0), [len((t or "").encode()) for t in texts], [mux(padded(t)) for t in texts]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(write), "doc_id long, n_bytes long, media binary")


def stored_media(docs: DataFrame) -> DataFrame:
    """media_column(), written to the shared folder and read back."""
    return materialize(media_column(docs), "media")


PACKET = "struct<track: int, timestamp_ns: long, first: long, bytes: long, key: boolean, lacing: int, place: int>"
CUE_ROW = "struct<timestamp_ns: long, track: int, cluster: long>"
SAMPLES = "struct<n: long, sum: long, low: int, high: int, turns: long>"
_PACKET = pa.struct([("track", pa.int32()), ("timestamp_ns", pa.int64()), ("first", pa.int64()), ("bytes", pa.int64()), ("key", pa.bool_()), ("lacing", pa.int32()), ("place", pa.int32())])
_CUE = pa.struct([("timestamp_ns", pa.int64()), ("track", pa.int32()), ("cluster", pa.int64())])
_SAMPLES = pa.struct([("n", pa.int64()), ("sum", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("turns", pa.int64())])
_READ = [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("packets", pa.list_(_PACKET)), ("cues", pa.list_(_CUE)), ("samples", _SAMPLES), ("error", pa.string())]


def sample_levels(payload: bytes) -> dict:
    """n, sum, low, high of 8-bit samples, and turns: how often one is above 95 and the next is not,
    or the other way round."""
    x = np.frombuffer(payload, np.uint8)
    if not len(x):
        return {"n": 0, "sum": 0, "low": 0, "high": 0, "turns": 0}
    above = x > 95
    return {"n": len(x), "sum": int(x.sum(dtype=np.int64)), "low": int(x.min()), "high": int(x.max()), "turns": int(np.count_nonzero(above[1:] != above[:-1]))}


def read_file(data: bytes | None) -> tuple:
    """The values of _READ for a file."""
    if data is None:
        return (None, None, 0, None, None, [], [], None, "no file")
    sha = hashlib.sha256(data).hexdigest()
    try:
        found = demux(data)
    except ValueError as e:
        return (len(data), sha, 0, None, None, [], [], None, str(e)[:500])
    payload = b"".join(data[p[2] : p[2] + p[3]] for p in found["packets"])
    packets = [dict(zip(("track", "timestamp_ns", "first", "bytes", "key", "lacing", "place"), p)) for p in found["packets"]]
    cues = [dict(zip(("timestamp_ns", "track", "cluster"), c)) for c in found["cues"]]
    return (len(data), sha, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), packets, cues, sample_levels(payload), None)


def read_media(media: DataFrame) -> DataFrame:
    """The columns of ``media`` but media, then what its files hold: media_bytes, media_sha256,
    payload_bytes, payload_sha256 and tail_crc32 (of the last 64 bytes) of all frames in order,
    packets (array of PACKET), cues (array of CUE_ROW), samples (SAMPLES of the payload), and error.

    A null or broken file has an error, no packets and no samples; nothing is raised. Columns of
    ``media`` that clash with these names are left out.
    """
    own = [name for name, _ in _READ]
    others = [f for f in media.schema.fields if f.name not in (*own, "media")]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read_file(d) for d in b.column(len(others)).to_pylist()]
            new = [pa.array([r[k] for r in rows], type=t) for k, (_, t) in enumerate(_READ)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(others))), *new], names=[*(f.name for f in others), *own])

    kept = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [f"media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, packets array<{PACKET}>, cues array<{CUE_ROW}>, samples {SAMPLES}, error string"])
    return media.select(*(F.col(f"`{f.name}`") for f in others), "media").mapInArrow(tidy(read), kept)


def packet_table(read: DataFrame, *keys: str) -> DataFrame:
    """A row for each packet of read_media()'s rows, with the columns ``keys``."""
    return read.select(*keys, F.explode("packets").alias("p")).select(*keys, "p.*")


def feature() -> Column:
    """What a file holds, in a line: its packets, tracks, end in time, laces and cues, then the level,
    range and turns of its samples; null for a broken file."""
    p = F.col("packets")
    x = F.col("samples")
    parts = (
        ("packets", F.size(p)),
        ("tracks", F.size(F.array_distinct(F.transform(p, lambda k: k["track"])))),
        ("last_ns", F.array_max(F.transform(p, lambda k: k["timestamp_ns"]))),
        ("largest", F.array_max(F.transform(p, lambda k: k["bytes"]))),
        ("cues", F.size("cues")),
        ("lacing", F.array_join(F.array_sort(F.array_distinct(F.transform(p, lambda k: k["lacing"]))), "+")),
        ("sum", x["sum"]),
        ("range", F.concat_ws("-", x["low"].cast("string"), x["high"].cast("string"))),
        ("turns", x["turns"]),
    )
    return F.when(F.col("error").isNull(), F.concat_ws(";", *(F.concat(F.lit(f"{n}="), v.cast("string")) for n, v in parts)))
