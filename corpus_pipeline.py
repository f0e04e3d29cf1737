"""A corpus pipeline over `documents`: language ID, exact, near and suffix deduplication, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage is
written as Parquet and read again before the next one, so an executor that is lost costs no more than its stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact, language, nearjoin, packing, suffix
from millrace.llm.common import documents, free_name, partitions, table


def by_row(docs: DataFrame, own: str) -> DataFrame:
    """docs with a key of its own for every row in doc_id, and doc_id as it was in `own`, a name that docs does not have.

    Keys are in the order of doc_id, null last, then of text: the least key is the row that stays. Ids that are neither null nor
    repeated are keys already.
    """
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    docs = docs.withColumn(own, F.col("doc_id"))
    if not odd:
        return docs
    at = free_name(docs.columns, "at")
    order = [F.col(own).isNull(), F.col(own), F.xxhash64("text"), F.col(at)]
    dealt = docs.withColumn(at, F.monotonically_increasing_id()).repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)
    return table(dealt.withColumn("doc_id", F.monotonically_increasing_id()).drop(at), "pipeline-rows")


def on_rows(docs: DataFrame, stage) -> DataFrame:
    """What a stage makes of docs with a key for every row, with doc_id and columns as they were."""
    own = free_name(docs.columns, "own_id")
    return stage(by_row(docs, own)).withColumn("doc_id", F.col(own)).select(*(F.col(f"`{c}`") for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, with a score of 0.5 or more; those without a letter go."""
    return language.accepted(docs, language.learn(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row that stays of each group of equal ones; repeated rows are a group, as are all without text. Null ids lose ties. Other
    columns may have any names; an empty table stays empty."""

    def stage(rows: DataFrame) -> DataFrame:
        return rows.join(exact.exact_dedup(rows).where(~F.col("kept")).select("doc_id"), "doc_id", "left_anti")

    return on_rows(docs, stage)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least id of each group of near copies; rows without id come last, rows without words stay. Other columns may have
    any names; an empty table stays empty."""

    def stage(rows: DataFrame) -> DataFrame:
        return rows.join(nearjoin.near_groups(rows).where(F.col("component_id") != F.col("doc_id")).select("doc_id"), "doc_id", "left_anti")

    return on_rows(docs, stage)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated strings of 100 bytes, the first in the order of ids apart; those of which nothing is left go,
    null texts become empty. Other columns may have any names; an empty table stays empty."""
    return on_rows(docs, suffix.without_repeats)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, placed in sequences of 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, on documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
