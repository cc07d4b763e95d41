"""The corpus pipeline: quality rules, quality classifier, near duplicates, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.llm import decontam, kit, ngram_join, packing, quality, rules

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep, each by its own verdict; null and empty texts have too few words and go.

    Repeated rows count and go or stay each. An empty table stays empty. Columns beyond those
    of documents stay, whatever their names.
    """
    kit.ship(spark)
    row = kit.unused(docs, "row")
    own = kit.numbered(docs, row)
    return _without(own, row, rules.quality_rules(own, id_col=row).filter("not kept").select("doc_id"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, learned from labels among them, predicts to be good.

    A score of exactly one half is good. Without labels all stay. Nulls, repeated rows, empty
    tables and further columns as before.
    """
    kit.ship(spark)
    row = kit.unused(docs, "row")
    own = kit.numbered(docs, row)
    found = quality.classified(own.select("doc_id", "text", F.col(row).alias("row_")), kit.table(spark, sf_dir, "labels"), "row_")
    return _without(own, row, found.filter("predicted = 0").select("row_"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the least doc_id; a null one only where there is no other.

    Of repeated rows one stays. Rows without words are copies if their id and text are the same.
    """
    kit.ship(spark)
    return ngram_join.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark window; null texts have none and stay, repeated rows go or stay each."""
    kit.ship(spark)
    row = kit.unused(docs, "row")
    own = kit.numbered(docs, row)
    found = decontam.contamination(own, kit.table(spark, sf_dir, "benchmark"), id_col=row)
    return _without(own, row, found.filter(F.size("items") > 0).select("doc_id"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    kit.ship(spark)
    return packing.packed(docs)


def _without(own: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows of own, numbered by the column row, whose number is not the one column of gone."""
    gone = kit.stored(gone.toDF(row), "gone")
    kept = own.join(gone, row, "left_anti").drop(row)
    kit.tidy(own.sparkSession)
    return kept


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Robust estimates, trained networks and packing are beyond SQL; tests hold stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written as a table and read by the next, then removed."""
    docs, before = kit.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = kit.stored(stage(spark, docs, sf_dir), name)
        kit.release(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
