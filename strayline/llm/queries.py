"""The operators as queries over the driver's tables, and the SQL of those that have one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cut_forest import spread
from . import bpe_dp, crf_langid, decision_list, exact_dedup, mixing, quality_pu, simhash_bk, suffix_tree, toxicity_knn, warc
from .common import fold

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out where they lie in fewer pieces than there are cores."""
    return spread(table(spark, sf_dir, "documents"))


def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    model = quality_pu.fit(docs, table(spark, sf_dir, "labels"))
    found = quality_pu.score(docs, model).withColumn("held_out", fold(F.col("doc_id"), 4, 2))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= quality_pu.THRESHOLD).cast("int").alias("predicted"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")), carry=("page_id",))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(texts(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.build_index(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents
)
SELECT doc_id,
  min(doc_id) OVER g AS keep_id,
  count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept,
  sha256(s) AS text_sha256
FROM t WINDOW g AS (PARTITION BY s)
"""


def op5_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    found = crf_langid.spans(docs, crf_langid.fit(docs)).withColumn("held_out", fold(F.col("doc_id"), 4, 2))
    return found.select("doc_id", "held_out", "lang_pred", "score", "spans")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), keyed AS (
  SELECT *, md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR) AS key FROM sized
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source
), weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sums
), levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - (2 * coalesce(sum(source_size) OVER b, 0))::DOUBLE)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS own_level
  FROM weighed
  WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min(own_level, source_size / weight) AS level FROM levels WHERE own_level * weight < 2 * source_size
), goals AS (
  SELECT source, source_size,
    CASE WHEN level IS NULL OR level * weight >= 2 * source_size THEN (2 * source_size)::DOUBLE ELSE level * weight END AS target
  FROM levels, level
), budgets AS (
  SELECT *, round(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM goals
), summed AS (
  SELECT k.doc_id, k.size, g.source_size, g.target, g.epochs, g.budget - g.epochs * g.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.size ROWS UNBOUNDED PRECEDING) - k.size AS begin
  FROM keyed k JOIN budgets g ON k.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (size * epochs + greatest(0, least(size, rest - begin)))::BIGINT AS taken FROM summed
"""


def op7_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    index = toxicity_knn.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity_knn.score(docs, index).withColumn("held_out", fold(F.col("doc_id"), 3, 1))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= toxicity_knn.THRESHOLD).cast("int").alias("predicted"), "evidence")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.near_duplicates(texts(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_dp.digests(texts(spark, sf_dir), TOKENIZER)


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    found = decision_list.judged(docs, decision_list.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def queries() -> dict:
    return {
        "op1_quality_pu": op1_quality_pu,
        "op2_warc_derivatives": op2_warc_derivatives,
        "op3_suffix_tree": op3_suffix_tree,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_crf_language": op5_crf_language,
        "op6_mix_sources": op6_mix_sources,
        "op7_toxicity_knn": op7_toxicity_knn,
        "op8_simhash": op8_simhash,
        "op9_bpe": op9_bpe,
        "op10_decision_list": op10_decision_list,
    }


def oracle_sql() -> dict:
    return {"op4_exact_dedup": OP4_SQL, "op6_mix_sources": OP6_SQL}
