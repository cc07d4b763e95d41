"""train, score and run_sweep: a configuration in, files and frames out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from scorelane import research
from scorelane.config import Config
from scorelane.operators import store
from scorelane.sources import read_table


def _config(given: Config | Mapping | str, overrides: Mapping | None = None) -> Config:
    cfg = given if isinstance(given, Config) else Config.load(given) if isinstance(given, str) else Config(given)
    return cfg.with_overrides(overrides) if overrides else cfg


def train(spark: SparkSession, config: Config | Mapping | str, frame: DataFrame | None = None, overrides: Mapping | None = None) -> research.Run:
    return research.Run(spark, _config(config, overrides), frame).all()


def score(spark: SparkSession, bundle: str, data: DataFrame | str, out: str | None = None, threshold: float | None = None, top_pct: float | None = None) -> tuple[DataFrame, dict]:
    """Scores a frame or a file (Parquet by suffix, else CSV); None as threshold means the bundle's."""
    scorer = research.Scorer(spark, bundle, threshold, top_pct)
    frame, report = scorer.score(read_table(spark, data) if isinstance(data, str) else data)
    if out:
        store.write_scores(frame, out, scorer.bundle["id"])
    return frame, report


def run_sweep(spark: SparkSession, configs: Sequence[str] | Mapping[str, Config], frame: DataFrame | None = None) -> DataFrame:
    named = configs if isinstance(configs, Mapping) else {c: Config.load(c) for c in configs}
    return research.sweep(spark, named, frame)
