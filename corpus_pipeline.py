"""From raw documents to token ids, in five stages; each writes Parquet that the next one reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.llm import decontaminate, lines, near, pieces, quality
from curaspark.llm.common import Scratch, documents, join_counted
from curaspark.llm.queries import PIECE_MODEL


def _without(docs: DataFrame, removed: DataFrame, name: str) -> DataFrame:
    """docs without the ids listed; ids that are null stay."""
    removed = Scratch(docs.sparkSession, name).put(removed.select("doc_id").distinct(), "removed")
    return join_counted(docs, removed, "doc_id", "left_anti", removed.count())


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null, empty and blank texts have no words and go; null languages and sources are groups; repeated rows share a
    verdict; an empty table stays empty; other columns are kept.
    """
    return quality.keep_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which nothing is left; n_chars follows the text.

    Null texts and null ids stay as they are; repeated rows lose the same lines; other columns are kept, but columns
    called n_lines and n_removed hold the counts.
    """
    cut = lines.dedup_lines(docs)
    left = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return left.withColumns(changed).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Texts without words and rows with a null id stay; rows that repeat an id go or stay together.
    """
    return _without(docs, near.near_duplicates(docs).where("doc_id <> component_id"), "near_removed")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and blank texts and items match nothing; a null id stays; rows that repeat an id go together.
    """
    leaks = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, leaks, "leaks_removed")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids, with merge dropout. Null and empty texts have none."""
    return pieces.encode(docs, PIECE_MODEL).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL expresses none of the five; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
