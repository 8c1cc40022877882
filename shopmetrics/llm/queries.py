"""Registered queries of this subpackage: operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmetrics.llm import sql
from shopmetrics.llm.alignment import align_documents
from shopmetrics.llm.ball_tree import exact_top_k
from shopmetrics.llm.chat import format_chats
from shopmetrics.llm.jaccard_join import jaccard_join
from shopmetrics.llm.mixing import mix
from shopmetrics.llm.multi_index import nearest
from shopmetrics.llm.packing import pack_documents
from shopmetrics.llm.positional_index import decontaminate
from shopmetrics.llm.resampling import importance_resample
from shopmetrics.llm.substring_dedup import substring_dedup
from shopmetrics.llm.tokens import default_path
from shopmetrics.llm.toxicity import toxicity
from shopmetrics.llm.warc import read_warc, write_warc
from shopmetrics.llm.wavelet import read_tokens, write_tokens

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_documents(spark, sf_dir).select("doc_id", "text"), 13).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_documents(spark, sf_dir), size=3, num=90, den=100)


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_embeddings(spark, sf_dir), every=20, k=20, target_recall=0.95)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(_documents(spark, sf_dir).select("doc_id", "text"), labels).select(
        "doc_id", "held_out", "score", "predicted"
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), least_bytes=0)
    return read_warc(folder, manifest).drop("url")


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(
        _documents(spark, sf_dir), default_path("byte_bpe_50k.json"), length=1024, end_id=0
    )
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = write_tokens(
        _documents(spark, sf_dir), default_path("word_bpe_49k.json"), end_id=2
    )
    return read_tokens(folder, manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir), weights=(5, 2, 1), share=1.0, most=3.0).drop("source")


def op9_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_embeddings(spark, sf_dir), every=20, k=20)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(
        _documents(spark, sf_dir), default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model")
    )


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return importance_resample(
        _documents(spark, sf_dir), target, most_terms=1, buckets=10_000, least_words=20,
        percent=10, seed="2024",
    ).drop("n_words")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(_documents(spark, sf_dir), items, size=10).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_multi_index": op3_multi_index,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_sum_of_squares_packing": op6_sum_of_squares_packing,
    "op7_wavelet_tokens": op7_wavelet_tokens,
    "op8_source_mixing": op8_source_mixing,
    "op9_chat_snapshots": op9_chat_snapshots,
    "op10_ball_tree": op10_ball_tree,
    "op11_alignment": op11_alignment,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_decontamination": op13_decontamination,
}
ORACLE_SQL: dict[str, str] = dict(sql.QUERIES)
