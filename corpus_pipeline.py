"""Preparation of a training corpus: a fixed row of stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmetrics.llm.jaccard_join import jaccard_join
from shopmetrics.llm.mixing import mixed_documents
from shopmetrics.llm.packing import pack_documents
from shopmetrics.llm.staged import stage_and_release
from shopmetrics.llm.substring_dedup import substring_dedup
from shopmetrics.llm.tokens import default_path
from shopmetrics.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't take for toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs.select(COLUMNS), labels).where("predicted = 0").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by five-word shingles the one of smallest doc_id.

    Rows of one doc_id are told by a 64-bit hash of doc_id and text, which also decides
    between them. Rows that repeat doc_id and text count once (of smallest lang, source
    and n_chars). Documents without words and rows without a doc_id stay.
    """
    docs = docs.select(COLUMNS).withColumn("row", F.xxhash64("doc_id", "text"))
    named = docs.where("doc_id is not null")
    classes = jaccard_join(
        docs.select(F.col("row").alias("doc_id"), "text"), size=5, num=80, den=100
    ).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    rows = stage_and_release(
        classes.distinct().join(named.select("row", "doc_id").distinct(), "row"), "document-rows"
    )
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    others = stage_and_release(
        rows.select("row").join(first.select("first.row"), "row", "left_anti"), "near-duplicates"
    )
    again = stage_and_release(
        named.groupBy("row").count().where("count > 1").select("row"), "repeated-rows"
    )
    once = (
        named.join(again, "row", "left_semi")
        .join(others, "row", "left_anti")
        .groupBy("doc_id", "text")
        .agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
        .select("doc_id", "text", "rest.*")
    )
    rest = docs.join(others.unionByName(again), "row", "left_anti")
    return rest.select(COLUMNS).unionByName(once.select(COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without what a smaller doc_id has too; others keep their text as it is."""
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    length = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return substring_dedup(docs.select(COLUMNS), min_words=13).select(
        "doc_id", text.alias("text"), "lang", "source", length.alias("n_chars")
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight, a row for each time a document is taken."""
    return mixed_documents(docs.select(COLUMNS), weights=(5, 2, 1), share=1.0, most=3.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return pack_documents(docs, default_path("byte_bpe_50k.json"), length=1024, end_id=0)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("packing", pack),
]
# Scores, draws and tokens have no SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage_and_release(docs, f"after-{name}")
    return docs
