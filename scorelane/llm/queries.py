"""The ten queries and the pipeline, as the driver calls them: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scorelane.llm import codec, decontam, langid, maxent, ngram_join, packing, pages, quality, rules, shards
from scorelane.llm.kit import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_languages(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shards(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op9_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scored(table(spark, sf_dir, "documents"))


def op10_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.read_back(codec.written(table(spark, sf_dir, "documents")))


_ALL = [f for name, f in list(globals().items()) if name.startswith("op")]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op6_decontamination": decontam.ORACLE}
