"""Line quality by a linear-chain conditional random field.

Every line is labelled good or bad. A line's emission sees its own features and those of the lines
before and after it; a transition weight ties neighbouring labels. A document's quality is the mean
of its lines' forward-backward marginals of "good", weighted by line length and put through a
logistic fitted on the training documents.

Only documents are labelled, so lines start with their document's label, and the lines of bad
documents are relabelled by the fitted model (at least one stays bad) before it is fitted again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm.common import batch, byte_words, first_by_hash, materialize, range_hashes, steps, string_parts, tidy

#: The model is fitted on about this many labelled documents, the first by a hash of their id, as far
#: as they have this many lines together; documents of over LONG_DOC lines are not among them.
TRAIN_DOCS, TRAIN_LINES, LONG_DOC = 4000, 200_000, 10_000
RELABELLINGS = 2
N_FEATURES = 15


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SPACE = _bytes(" \t\r\n\v\f")
_WORD = ~_SPACE
_UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _bytes("0123456789")
_STOP = _bytes(".?,;:")
_BANG = _bytes("!")
_PIPE = _bytes("|")
_SYMBOL = _bytes("#$%&*+/<=>@[\\]^_`{}~")
_LETTER = _UPPER | _bytes("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0x80)
_CLASSES = (_UPPER, _DIGIT, _STOP, _BANG, _PIPE, _SYMBOL, _LETTER, _SPACE)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (a row for each line), bytes of each line, and the first line of each document with
    the number of all at the end. Lines end at line feeds; a document without text has one empty line."""
    n_docs = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    starts = starts[starts < len(data)] if len(data) else starts[:0]
    ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
    counts = np.stack([np.add.reduceat(c[data], starts, dtype=np.int64) for c in _CLASSES], axis=1) if len(starts) else np.zeros((0, len(_CLASSES)), np.int64)
    word_starts, word_ends = byte_words(data, offsets, _WORD)
    hashes = range_hashes(data, word_starts, word_ends)
    line_of = np.searchsorted(starts, word_starts, side="right") - 1
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    words = np.bincount(line_of, minlength=len(starts)).astype(float)
    repeats = np.bincount(line_of, same, minlength=len(starts))
    order = np.lexsort((hashes, line_of))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])
    distinct = np.bincount(line_of[order][fresh], minlength=len(starts))
    size = (ends - starts).astype(float)
    whole = range_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    order = np.lexsort((whole, doc))
    twin = np.zeros(len(order), bool)
    equal = (whole[order][1:] == whole[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twin[1:] |= equal
    twin[:-1] |= equal
    twins = np.zeros(len(order))
    twins[order] = twin
    upper, digit, stop, bang, pipe, symbol, letter, space = (counts[:, k].astype(float) for k in range(len(_CLASSES)))
    some, many = np.maximum(size, 1), np.maximum(words, 1)
    last = data[np.maximum(word_ends[np.maximum(np.cumsum(words).astype(int) - 1, 0)] - 1, 0)] if len(word_ends) else np.zeros(len(starts), np.uint8)
    found = np.stack([np.ones(len(starts)), np.log1p(size), np.log1p(words), upper / some, digit / some, stop / many, np.minimum(bang / many, 3), np.minimum(pipe / many, 3), np.minimum(symbol / many, 4), letter / some, np.log1p(size / many), repeats / many, distinct / many, twins, (_STOP[last] & (words > 0)).astype(float)], axis=1)
    per_doc = np.bincount(doc, minlength=n_docs)
    if (per_doc == 0).any():  # an empty line for each document that has none
        empty = np.flatnonzero(per_doc == 0)
        blank = np.zeros((len(empty), N_FEATURES))
        blank[:, 0] = 1
        order = np.argsort(np.concatenate([doc, empty]), kind="stable")
        found, size = np.concatenate([found, blank])[order], np.concatenate([size, np.zeros(len(empty))])[order]
        per_doc = np.maximum(per_doc, 1)
    return found, size, np.concatenate([[0], np.cumsum(per_doc)])


def with_neighbours(features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and after; zeros at a document's ends."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    before[bounds[:-1]] = 0
    after[bounds[1:] - 1] = 0
    return np.concatenate([features, before, after], axis=1)


class Chains:
    """Documents in order of falling length, so that step t of all that have it is one slice."""

    def __init__(self, bounds: np.ndarray):
        lengths = np.diff(bounds)
        self.order = np.argsort(-lengths, kind="stable")
        self.first, self.lengths = bounds[:-1][self.order], lengths[self.order]
        self.steps = int(self.lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-self.lengths, -np.arange(self.steps), side="left")

    def marginals(self, emission: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Posterior of each line's labels, expected transitions, and the log partition of all.
        emission: two scores of each line; transition[a, b]: score of a before b."""
        m = np.exp(transition - transition.max())
        top = emission.max(axis=1, keepdims=True)
        e = np.exp(emission - top)
        alpha, scale = np.empty_like(e), np.empty(len(e))
        beta = np.ones_like(e)
        for t in range(self.steps):
            at = self.first[: self.active[t]] + t
            a = e[at] if not t else (alpha[at - 1] @ m) * e[at]
            scale[at] = a.sum(axis=1)
            alpha[at] = a / scale[at][:, None]
        for t in range(self.steps - 2, -1, -1):
            at = self.first[: self.active[t + 1]] + t
            beta[at] = ((e[at + 1] * beta[at + 1]) @ m.T) / scale[at + 1][:, None]
        inner = np.ones(len(e), bool)
        inner[self.first] = False
        nxt = np.flatnonzero(inner)
        pairs = (alpha[nxt - 1].T @ (e[nxt] * beta[nxt] / scale[nxt][:, None])) * m
        p = alpha * beta
        return p / p.sum(axis=1, keepdims=True), pairs, float(np.log(scale).sum() + top.sum() + len(nxt) * transition.max())


@dataclass
class Model:
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray  # score of "good" over "bad" of a line
    transition: np.ndarray
    slope: float
    shift: float

    def lines(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Marginal probability that each line is good."""
        x = with_neighbours((features - self.mean) / self.deviation, bounds)
        x[:, 0] = 1
        score = x @ self.weights
        return Chains(bounds).marginals(np.stack([np.zeros_like(score), score], axis=1), self.transition)[0][:, 1]

    def documents(self, features: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        mean = weighted(self.lines(features, bounds), size, bounds)
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(mean) + self.shift, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def weighted(p: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    weight = size + 1
    return np.add.reduceat(p * weight, bounds[:-1]) / np.add.reduceat(weight, bounds[:-1])


def _adam(gradient, w: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def fit_chains(features: np.ndarray, size: np.ndarray, bounds: np.ndarray, good: np.ndarray, rounds: int = 120, penalty: float = 1e-3) -> Model:
    """Maximum likelihood of the line labels, by Adam on exact gradients; deterministic."""
    mean, deviation = features.mean(axis=0), features.std(axis=0) + 1e-6
    mean[0], deviation[0] = 0, 1
    x = with_neighbours((features - mean) / deviation, bounds)
    x[:, 0] = 1
    chains, lengths = Chains(bounds), np.diff(bounds)
    labels = np.repeat(good, lengths).astype(int)
    inner = np.ones(len(x), bool)
    inner[bounds[:-1]] = False
    nxt = np.flatnonzero(inner)
    w = np.zeros(x.shape[1] + 4)
    for _ in range(RELABELLINGS + 1):
        seen = np.zeros((2, 2))
        np.add.at(seen, (labels[nxt - 1], labels[nxt]), 1)

        def gradient(w: np.ndarray, labels=labels, seen=seen) -> np.ndarray:
            score = x @ w[:-4]
            p, pairs, _ = chains.marginals(np.stack([np.zeros_like(score), score], axis=1), w[-4:].reshape(2, 2))
            g = np.concatenate([x.T @ (p[:, 1] - labels), (pairs - seen).reshape(-1)]) / len(x)
            return g + penalty * w

        w = _adam(gradient, w, rounds, 0.1)
        model = Model(mean, deviation, w[:-4], w[-4:].reshape(2, 2), 1.0, 0.0)
        p = model.lines(features, bounds)
        labels = np.where(np.repeat(good, lengths) == 1, 1, (p >= 0.5).astype(int))
        for d in np.flatnonzero(good == 0):
            part = slice(bounds[d], bounds[d + 1])
            if labels[part].all():
                labels[bounds[d] + int(np.argmin(p[part]))] = 0
    z = _logit(weighted(p, size, bounds))

    def slope(v: np.ndarray) -> np.ndarray:
        off = 1 / (1 + np.exp(-np.clip(v[0] * z + v[1], -30, 30))) - good
        return np.array([(off * z).mean(), off.mean()]) + 1e-4 * v

    model.slope, model.shift = (float(v) for v in _adam(slope, np.array([1.0, 0.0]), 400, 0.05))
    return model


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> Model | None:
    """A model from text of ``docs`` and quality of ``labels`` on at most ``train_docs`` documents of at
    most ``train_lines`` lines together, which are all that the driver gets.

    A doc_id with both labels, or a null one, is left out; rows that repeat count once. None if no
    document is left.
    """
    per_doc = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    chosen = first_by_hash(per_doc.filter("quality = most"), train_docs, 11).select("doc_id", "_r", F.col("quality").cast("int").alias("_quality"))
    schema = pa.schema([("r", pa.int32()), ("quality", pa.int32()), ("lines", pa.int64()), ("features", pa.list_(pa.float32())), ("size", pa.list_(pa.float32()))])

    def lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = string_parts(b.column(2))
            for lo, hi in steps(offsets):
                f, size, bounds = line_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                parts = list(zip(bounds, bounds[1:]))
                yield batch(schema, [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), np.diff(bounds), [f[s:e].reshape(-1).astype(np.float32) if e - s <= LONG_DOC else [] for s, e in parts], [size[s:e].astype(np.float32) if e - s <= LONG_DOC else [] for s, e in parts]])

    sample = docs.join(F.broadcast(chosen), "doc_id").select("_r", "_quality", "text")  # train_docs rows
    found = sample.mapInArrow(tidy(lines), "r int, quality int, lines long, features array<float>, size array<float>").filter(F.col("lines") <= LONG_DOC)
    found = materialize(found.withColumn("own", F.xxhash64("features")), "line-features")
    # Ranks need no features: these follow once the bounds on documents and lines are met.
    keys = ["r", "lines", "own"]
    order = Window.partitionBy(F.lit(0)).orderBy(*keys)
    first = found.select(*keys).distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= train_docs)
    bounded = first.withColumn("so_far", F.sum("lines").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("so_far") <= train_lines)
    rows = found.join(F.broadcast(bounded), keys).dropDuplicates(keys).orderBy("n").select("quality", "features", "size").toPandas()
    if not len(rows):
        return None
    size = [np.asarray(s, float) for s in rows["size"]]
    features = np.concatenate([np.asarray(f, float) for f in rows["features"]]).reshape(-1, N_FEATURES)
    return fit_chains(features, np.concatenate(size), np.concatenate([[0], np.cumsum([len(s) for s in size])]), rows["quality"].to_numpy(np.int64))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, n_lines, bad_lines of every row of ``docs``.

    Null and empty texts are one empty line and get its score. Without a model every score is 0.5.
    Very long texts are scored whole, by one task. Rows that repeat stay, with the same score; other
    columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_lines", pa.int64()), ("bad_lines", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            data, offsets = string_parts(b.column(1))
            for lo, hi in steps(offsets):
                f, size, bounds = line_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                p = model.lines(f, bounds) if model else np.full(len(f), 0.5)
                s = 1 / (1 + np.exp(-np.clip(model.slope * _logit(weighted(p, size, bounds)) + model.shift, -30, 30))) if model else np.full(hi - lo, 0.5)
                yield batch(schema, [b.column(0).slice(lo, hi - lo), s, np.diff(bounds), np.add.reduceat((p < 0.5).astype(np.int64), bounds[:-1])])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(scored), "doc_id long, score double, n_lines long, bad_lines long")
