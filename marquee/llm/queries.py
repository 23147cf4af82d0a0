"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Python workers get batches of bounded size: some texts are very long.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
        return f(spark, sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from marquee.llm.simple8b import token_file_digests

    return token_file_digests(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), False, 2)


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from marquee.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), True, 2, 1024)


@query
def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.simhash_golay import hexadecimal, near_duplicate_groups

    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.decontaminate import contamination, is_contaminated

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", is_contaminated().alias("contaminated"))


ORACLES["op8_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, len(x) AS n, array_to_string(x, ' ') AS t FROM (
    SELECT item, list_slice(w, i, i + least(13, len(w)) - 1) AS x
    FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
  )
), sizes AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT spots.doc_id, spots.i, spots.n, windows.item FROM spots JOIN windows ON spots.t = windows.t AND spots.n = windows.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AND 20 * coalesce(words.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""


@query
def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.sentence_spans import deduplicate_spans

    return deduplicate_spans(table(spark, sf_dir, "documents"))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.common import crc32_mod
    from marquee.llm.langid import fit, predict

    docs = table(spark, sf_dir, "documents")
    held_out = crc32_mod("doc_id", 4) == 2
    return predict(docs, fit(docs.filter(~held_out))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.common import crc32_mod
    from marquee.llm.quality_crf import fit, score

    docs = table(spark, sf_dir, "documents")
    held_out = crc32_mod("doc_id", 3) == 1
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels").filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "bad_lines")


@query
def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.matroska import feature, read_media, stored_media

    read = read_media(stored_media(table(spark, sf_dir, "documents")))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature().alias("feature"))


@query
def op4_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.html_layout import extract

    return extract(table(spark, sf_dir, "pages"))


@query
def op10_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.quotes import reply_order

    ordered = reply_order(table(spark, sf_dir, "conversations"))
    return ordered.withColumn("quoted", F.array_join("quoted", "\n\n"))


#: crc32 in SQL: the table of the polynomial, and the bytes of a text by way of its hexadecimal form.
_CRC32 = r"""
crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(0, 256) r(i)
  )
), crcs AS (
  SELECT s, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295) AS crc
  FROM crc_table, (
    SELECT s, list_transform(range(1, strlen(s) * 2, 2), lambda p: CAST(16 * instr('0123456789ABCDEF', substr(h, p, 1)) + instr('0123456789ABCDEF', substr(h, p + 1, 1)) - 17 AS BIGINT)) AS b
    FROM (SELECT s, hex(encode(s)) AS h FROM hashed)
  )
)"""


@query
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.importance import resample

    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op11_importance"] = r"""
WITH texts AS (
  SELECT true AS corpus, doc_id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark
), words AS (
  SELECT row_number() OVER () AS r, corpus, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), found AS (
  SELECT r, corpus, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT r, corpus, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, range(1, 4) sizes(n) WHERE len(w) >= n)
), hashed AS (SELECT DISTINCT s FROM found),""" + _CRC32 + r""",
buckets AS (SELECT r, corpus, crc % 10000 AS bucket FROM found JOIN crcs ON crcs.s = found.s),
counts AS (
  SELECT bucket, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t,
         sum(count(*) FILTER (corpus)) OVER () AS all_s, sum(count(*) FILTER (NOT corpus)) OVER () AS all_t
  FROM buckets GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(all_s AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(all_t AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM counts
), weights AS (
  SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM buckets JOIN gains ON gains.bucket = buckets.bucket WHERE corpus GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('42:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weights ON weights.r = words.r WHERE corpus
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.merkle import proofs, tampered_text

    found = proofs(table(spark, sf_dir, "documents"), tampered_text())
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _merkle_sql(levels: int) -> str:
    """Trees of up to 16**levels nodes: level by level the nodes above, then the folds along them. A level
    that has one node hands it on as it is."""
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"]
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in [*fields, text]) + ")"

    sql = [
        "WITH hashed AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL)," + _CRC32,
        f"a0 AS (SELECT doc_id, source, leaf, leaf AS d, CASE WHEN hit THEN changed ELSE leaf END AS fold, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, '' AS proof FROM (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf(lower)} AS changed, coalesce(crc % 5 = 0, false) AS hit FROM documents LEFT JOIN crcs ON s = CAST(doc_id AS VARCHAR)))",
    ]
    at, group, extra = "a0", "source", ""
    for k in range(2 * levels):
        if k == levels:
            sql += [
                f"tops AS (SELECT source, min(d) AS d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p FROM {at} GROUP BY source)",
                f"b AS (SELECT x.doc_id, x.source, x.leaf, x.d, x.fold, tops.p, x.proof, x.d AS subroot, 0 AS whole FROM {at} x JOIN tops ON tops.source IS NOT DISTINCT FROM x.source)",
            ]
            at, group, extra = "b", "whole", ", subroot, x.whole"
        others = "array_to_string(run[:p % 16], ''){} || array_to_string(run[p % 16 + 2:], '')"
        sql += [
            f"n{k} AS (SELECT DISTINCT {group}, p, d FROM {at})",
            f"r{k} AS (SELECT {group}, p // 16 AS q, list(d ORDER BY p) AS run, (SELECT count(*) FROM n{k} y WHERE y.{group} IS NOT DISTINCT FROM n{k}.{group}) AS many FROM n{k} GROUP BY {group}, p // 16)",
            f"a{k + 1} AS (SELECT doc_id, x.source, leaf{extra}, p // 16 AS p, CASE WHEN many = 1 THEN d ELSE sha256(array_to_string(run, '')) END AS d,"
            f" CASE WHEN many = 1 THEN fold ELSE sha256({others.format(' || fold')}) END AS fold, CASE WHEN many = 1 THEN proof ELSE proof || {others.format('')} END AS proof"
            f" FROM {at} x JOIN r{k} r ON r.{group} IS NOT DISTINCT FROM x.{group} AND r.q = x.p // 16)",
        ]
        at = f"a{k + 1}"
    return ",\n".join(sql) + f"\nSELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = d AS verified FROM {at}"


ORACLES["op13_merkle_manifest"] = _merkle_sql(5)


@query
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.pii_crf import KINDS, find, fit

    docs = table(spark, sf_dir, "documents")
    found = find(docs, fit(docs))
    told = {c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",") for c in ("base", "spans")}
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(told["base"], 256).alias("base_sha256"), told["spans"].alias("spans"))
