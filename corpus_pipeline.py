"""The corpus pipeline: stages that each read what the one before them kept."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, lines, packing, quality, simhash
from tidemark.llm.common import ensure_checkpoint_dir, table
from tidemark.llm.queries import QUALITY_THRESHOLD, tokenizer_path
from tidemark.sources.trail import Folder


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality")
    return quality.score(docs, model, score_col="__score").where(F.col("__score") >= QUALITY_THRESHOLD).drop("__score")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of templates that recur across documents."""
    return lines.drop_recurring_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return simhash.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path(), size=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_quality),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
#: No stage but the last could be left out of SQL, and tokens can't be made there.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written as Parquet in the checkpoint folder and read again.

    A result goes when the next stage's is written, so at most two copies of the corpus are there; the last one stays, as
    the rows that are returned may still be read from it.
    """
    folder = Folder(spark, f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid4().hex}")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder.path}/{name}")
        docs = spark.read.parquet(f"{folder.path}/{name}")
        if before:
            folder.delete(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
