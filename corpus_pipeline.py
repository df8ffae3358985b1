"""A corpus pipeline: each stage reads what the one before it wrote, and calls one operator of deltagrove.llm.

The pipeline's toxicity stage drops the documents that the classifier predicts toxic; the Jaccard stage keeps of each class
the row with the least id; suffix dedup removes repeated bytes; the mix repeats or drops
documents to the targets; the last stage gives the sampled segmentations of every document. Each holds for empty tables too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltagrove.llm import jaccard, mixing, pieces, suffixes, toxicity
from deltagrove.llm.common import read, written

_ROW = "__row_of_this_document"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the row with the least id; of rows that share it, the first by a hash of the text. A class is one of rows,
    so different texts under one id, or without one, all stay."""
    rows = written(docs.withColumn(_ROW, F.monotonically_increasing_id()))
    classes = jaccard.components(rows.select(F.col(_ROW).alias("doc_id"), "text"), count_links=False).select(F.col("doc_id").alias(_ROW), "component_id")
    order = rows.select(_ROW, F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    least = order.join(classes, _ROW).groupBy("component_id").agg(F.min(F.struct("_id", "_hash", _ROW)).alias("_least"))
    return rows.join(least.select(F.col(f"_least.{_ROW}")), _ROW, "left_semi").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(suffixes.remove_repeats(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mixing.mix(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.sample_segmentations(docs)


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars as their texts are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("suffix dedup", drop_repeats),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: SQL can express neither the classifier nor the sampling; the tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
