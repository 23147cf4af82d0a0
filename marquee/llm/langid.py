"""Word-first language identification with backoff to character n-grams.

A known word adds its log frequency in each language. An unseen word backs off: of its character
n-grams, with marks for its ends, the longest length counts for which any n-gram is known. The model
holds every word and n-gram of the documents it is fitted on, which are a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm.common import batch, first_by_hash, materialize, steps, string_parts, tidy

UNDETERMINED = "und"
LONGEST = 5
#: The model is fitted on about this many documents of each language, the first by a hash of their
#: id, as far as they have this many bytes together. They bound the model, and what the driver gets of it.
TRAIN_DOCS, TRAIN_BYTES = 1000, 4 << 20
_WORDS_CACHED = 100_000
#: The n-grams of w of k characters. Long words are taken in overlapping parts, as each substring
#: is counted from the start of its string.
GRAMS = """flatten(transform(transform(sequence(0, (length(w) - k) div 500), j -> substring(w, 500 * j + 1, 499 + k)),
    part -> transform(sequence(1, length(part) - k + 1), i -> substring(part, i, k))))"""


@dataclass
class Model:
    """Log frequencies by language (a column for each) of words and n-grams (a row for each)."""

    languages: list[str]
    words: list[str]
    grams: list[str]
    word_scores: np.ndarray
    gram_scores: np.ndarray


class Scorer:
    """Scores words under a model; one for each task. The cache is of bounded size and changes no result."""

    def __init__(self, model: Model):
        self.model = model
        self.words = {w: i for i, w in enumerate(model.words)}
        self.grams = {g: i for i, g in enumerate(model.grams)}
        self.none = np.zeros(len(model.languages), np.float32)
        self.cache: dict[str, tuple[np.ndarray, bool]] = {}

    def word(self, word: str) -> tuple[np.ndarray, bool]:
        """Log frequency of a word by language, and whether the model knows it or an n-gram of it."""
        at = self.words.get(word)
        if at is not None:
            return self.model.word_scores[at], True
        marked, grams = f"^{word}$", self.grams
        for n in range(min(LONGEST, len(marked)), 0, -1):
            known = [i for k in range(len(marked) - n + 1) if (i := grams.get(marked[k : k + n])) is not None]
            if known and (n > 1 or any(c in grams for c in word)):
                return self.model.gram_scores[known].mean(axis=0), True
        return self.none, False

    def table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cache = self.cache
        if len(cache) > _WORDS_CACHED:
            cache.clear()
        for w in words:
            if w not in cache:
                cache[w] = self.word(w)
        found = [cache[w] for w in words]
        return np.array([f[0] for f in found], np.float64).reshape(len(words), len(self.none)), np.array([f[1] for f in found], bool)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over the words (runs of letters, in lower case) of ``docs``."""
    words = F.explode(F.split(F.lower(F.col("text")), r"[^\p{L}\p{M}]+")).alias("word")
    return docs.select("lang", words).filter("word != ''").groupBy("lang", "word").agg(F.count("*").alias("n"))


def _log_frequencies(rows: pd.DataFrame, key: str, languages: list[str], totals: np.ndarray) -> tuple[list[str], np.ndarray]:
    place = {lang: i for i, lang in enumerate(languages)}
    keys, at = np.unique(rows[key].to_numpy(object).astype(str), return_inverse=True)
    counts = np.full((len(keys), len(languages)), 0.5)
    counts[at, rows["lang"].map(place).to_numpy(np.int64)] += rows["n"].to_numpy(np.float64)
    return keys.tolist(), np.log(counts / totals).astype(np.float32)


def gram_counts(counts: DataFrame) -> DataFrame:
    """lang, gram, n over the marked words of word_counts(): each distinct word is cut up once."""
    marked = counts.select("lang", "n", F.concat(F.lit("^"), "word", F.lit("$")).alias("w"))
    sizes = ", ".join(map(str, range(1, LONGEST + 1)))
    every = F.expr(f"flatten(transform(filter(array({sizes}), k -> length(w) >= k), k -> {GRAMS}))")
    return marked.select("lang", "n", F.explode(every).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model | None:
    """A model from text and lang of ``docs``; rows with a null are left out. None if none is left.

    It is fitted on at most ``train_docs`` documents of each language, in order of a hash of their id
    as long as they have at most ``train_bytes`` bytes together (the first counts in any case), and
    holds all their words and n-grams.
    """
    good = docs.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    so_far = Window.partitionBy("lang").orderBy("_r")
    picked = first_by_hash(good, train_docs, 7, by="lang").withColumn("_bytes", F.sum(F.octet_length("text")).over(so_far))
    counts = materialize(word_counts(picked.filter((F.col("_bytes") <= train_bytes) | (F.col("_r") == 1))), "word-counts")
    words = counts.toPandas()
    if not len(words):
        return None
    grams = gram_counts(counts).toPandas()
    totals = words.groupby("lang")["n"].sum()
    languages = sorted(totals.index)
    size = totals[languages].to_numpy(float) + 0.5 * words["word"].nunique()
    return Model(languages, *(x for pair in zip(_log_frequencies(words, "word", languages, size), _log_frequencies(grams, "gram", languages, size)) for x in pair))


def _predictions(column: pa.Array, scorer: Scorer | None) -> tuple[list, np.ndarray]:
    """Language and score of every text."""
    languages = np.array([*(scorer.model.languages if scorer else []), UNDETERMINED], object)
    offsets = string_parts(column)[1]
    found, scores = [], [np.zeros(0)]
    for lo, hi in steps(offsets):
        texts = pc.fill_null(column.slice(lo, hi - lo), "")
        lists = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL\pM]+", " "), " ")
        best, posterior = np.full(hi - lo, len(languages) - 1), np.zeros(hi - lo)
        if scorer:
            coded = lists.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            table, known = scorer.table(words)
            letters = np.array([any(map(str.isalpha, w)) for w in words], bool)
            row = np.repeat(np.arange(hi - lo), np.diff(lists.offsets.to_numpy()))
            place = coded.indices.to_numpy()
            with_letters = np.bincount(row, letters[place], hi - lo) > 0
            table *= (letters & known)[:, None]
            real = np.bincount(row, (letters & known)[place], hi - lo)
            sums = np.stack([np.bincount(row, table[place, j], hi - lo) for j in range(table.shape[1])], axis=1)
            best[with_letters] = 0
            some = real > 0
            if some.any():
                evidence = sums[some] / real[some, None] * np.minimum(real[some, None], 50)
                p = np.exp(evidence - evidence.max(axis=1, keepdims=True))
                best[some] = evidence.argmax(axis=1)
                posterior[some] = p.max(axis=1) / p.sum(axis=1)
        found += languages[best].tolist()
        scores.append(posterior)
    return found, np.concatenate(scores)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs``.

    score is the posterior of lang_pred, with word scores averaged to an evidence of at most 50
    words. Null, empty and letterless texts are ``und`` with score 0, and so are all texts if there
    is no model; ties go to the first language by name. A text with letters of which the model knows
    no word and no n-gram gets the first language with score 0. Very long texts are scored whole, by
    one task. Rows that repeat stay; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for b in batches:
            found, scores = _predictions(b.column(1), scorer)
            yield batch(schema, [b.column(0), found, scores])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(score), "doc_id long, lang_pred string, score double")


def keep_recognised(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is told with a score of at least
    ``least``. Null and letterless texts go. Without a model, all texts with a letter stay. Rows that
    repeat stay or go together, an empty table stays empty, and very long texts are read whole."""
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            found, scores = _predictions(b.column(at), scorer)
            yield b.filter(pa.array((scores >= least) & (np.array(found, object) != UNDETERMINED)))

    return docs.mapInArrow(tidy(told), docs.schema)
