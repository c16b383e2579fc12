"""A corpus from documents: quality, exact and near duplicates, the mix, and its tokens.

Each stage takes what the one before it kept, written as Parquet and read again.
All but the last return the columns of documents. The last has a row for each row
of the mix: a document that the mix takes twice is there twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strayline.llm import bpe_dp, exact_dedup, mixing, quality_pu, simhash_bk
from strayline.llm.common import stored
from strayline.llm.queries import TOKENIZER, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores at its threshold or above."""
    return quality_pu.accepted(docs, quality_pu.fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the row with the smallest id."""
    return simhash_bk.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's budget takes them; the one at a cut with its first words."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_dp.digests(docs, TOKENIZER)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("mixing", mix), ("bpe", tokens)]

#: A fitted classifier decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
