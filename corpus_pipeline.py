"""From raw documents to token ids in five stages, each written as Parquet and read by the next.

1. quality: documents that the weak-label quality model rejects go.
2. toxicity: documents of high expected severity go.
3. near_dedup: one document of each group of near copies stays (five-word shingles, similarity 0.8).
4. decontamination: documents that hold a benchmark item go.
5. tokenise: ids of every whole text, with their digests.

Defined cases: a null or empty text, or one without words, is rejected by the first stage (later ones keep it: it isn't
toxic, has no copies, holds no item and has no ids); texts of any length are read whole; of equal rows and texts one
stays, of a tie that of the smallest doc_id; texts of one doc_id that aren't near each other each stay; a row without a
doc_id is judged like any other but takes no part in the search for copies and stays; labels and items without an id or a
text count for nothing; an empty table gives an empty result at every stage; further columns, whatever they are called,
go through all stages but the last, which returns its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxelake.llm import bpe, common, decontamination, near_dedup, quality, toxicity


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, words=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def tokenise_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("tokenise", tokenise_stage),
]

#: Stages train models and align texts, which SQL can't express; tests hold run() to plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
