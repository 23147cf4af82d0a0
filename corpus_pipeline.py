"""Corpus preparation: STAGES in order, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marquee.llm.common import delete_folder, scratch_path, scratch_tables
from marquee.llm.decontaminate import drop_contaminated
from marquee.llm.langid import fit, keep_recognised
from marquee.llm.packing import pack_documents
from marquee.llm.sentence_spans import without_repeats
from marquee.llm.simhash_golay import keep_one_of_each

#: A language must be this likely for a document to stay.
MIN_LANGUAGE_SCORE = 0.5
TOKENIZER, END_ID, CAPACITY = "byte_bpe_50k.json", 2, 1024


def _bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model, fitted on their lang column, tells apart. Documents
    without letters go, and those whose likeliest language is below MIN_LANGUAGE_SCORE. Where no
    document has a language, nothing can be told, and those with letters stay."""
    _bounded_batches(spark)
    return keep_recognised(docs, fit(docs), MIN_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    _bounded_batches(spark)
    return keep_one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; n_chars follows the text. A document that loses all its
    text stays as an empty one."""
    _bounded_batches(spark)
    return without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    _bounded_batches(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; see marquee.llm.packing."""
    import public_tokenizers

    _bounded_batches(spark)
    return pack_documents(docs, public_tokenizers.path(TOKENIZER), True, END_ID, CAPACITY)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's scratch tables go when its output is written, and its
    output when the next one's is."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        with scratch_tables():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            delete_folder(spark, last)
        last = path
    return docs
