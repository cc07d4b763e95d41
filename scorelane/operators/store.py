"""What a run leaves behind: predictions, folds, tables, reports, bundles, specifications."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from functools import reduce
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a prediction, levels of what is kept, stages of each level.
PREDICTION = "row_id string, y_true tinyint, y_score double, stage string, model string, k int, fold int, repeat int"
LEVELS = {"none": (), "holdout": ("holdout",), "cv": ("holdout", "cv"), "all": ("holdout", "cv", "cv_train")}
VERSION = "1"


def union_stages(chunks: Sequence[DataFrame]) -> DataFrame:
    """All rows of the chunks; columns meet by name, absent ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chunks)


class PredictionLog:
    """Chunks of predictions, appended as they come; stages beyond the level are not kept."""

    def __init__(self, path: str, level: str = "holdout") -> None:
        if level not in LEVELS:
            raise ValueError(f"unknown level {level!r}; known: {list(LEVELS)}")
        self.path, self.stages, self.written = path, LEVELS[level], 0

    def add(self, rows: DataFrame, stage: str, model: str, k: int, fold: int | None = None, repeat: int | None = None) -> None:
        """rows(row_id, y, s) of one model on one part."""
        if stage in self.stages:
            own = rows.select(F.col("row_id").cast("string").alias("row_id"), F.col("y").cast("tinyint").alias("y_true"), F.col("s").cast("double").alias("y_score"), F.lit(stage).alias("stage"), F.lit(model).alias("model"), F.lit(k).alias("k"), F.lit(fold).cast("int").alias("fold"), F.lit(repeat).cast("int").alias("repeat"))
            own.write.mode("append").partitionBy("stage", "model").parquet(f"{self.path}/predictions.parquet")
            self.written += 1

    def add_folds(self, folds: DataFrame) -> None:
        """row_id, fold, repeat; written once, the same again changes nothing."""
        folds.select(F.col("row_id").cast("string").alias("row_id"), F.col("fold").cast("int"), F.col("repeat").cast("int")).write.mode("overwrite").parquet(f"{self.path}/folds.parquet")

    def close(self, **meta: object) -> None:
        write_json({"version": VERSION, "chunks": self.written, "stages": list(self.stages)} | meta, f"{self.path}/predictions.meta.json")


def _loaded(spark: SparkSession, path: str, what: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            raise FileNotFoundError(f"no {what} at {path}: was the run told to keep them?") from None
        raise


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    return _loaded(spark, f"{path}/predictions.parquet", "predictions")


def load_folds(spark: SparkSession, path: str) -> DataFrame:
    return _loaded(spark, f"{path}/folds.parquet", "folds")


def safe(value: object) -> object:
    """value as JSON has it: no NaN, no infinities, dates and the like as text."""
    if isinstance(value, Mapping):
        return {str(k): safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [safe(v) for v in value]
    if isinstance(value, float):
        return value if value == value and abs(value) != float("inf") else None
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def rounded(value: object, digits: int = 6) -> object:
    if isinstance(value, Mapping):
        return {k: rounded(v, digits) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [rounded(v, digits) for v in value]
    return round(value, digits) if isinstance(value, float) else value


def write_json(value: object, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(safe(value), indent=2))


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text())


def write_reports(folder: str, tables: Mapping[str, DataFrame | None], reports: Mapping[str, object]) -> list[str]:
    """Small tables as one CSV file each, reports as JSON; empty and absent tables are left out."""
    os.makedirs(folder, exist_ok=True)
    written = []
    for name, df in tables.items():
        rows = [] if df is None else df.toPandas()
        if len(rows):
            rows.to_csv(f"{folder}/{name}.csv", index=False)
            written.append(f"{name}.csv")
    for name, value in reports.items():
        write_json(value, f"{folder}/{name}.json")
        written.append(f"{name}.json")
    return written


def write_scores(frame: DataFrame, path: str, id_col: str) -> None:
    """Scores with the id first; Parquet by suffix, CSV otherwise."""
    from scorelane.sources import write_table

    write_table(frame.select(id_col, *[c for c in frame.columns if c != id_col]), path)


def write_yaml(value: Mapping, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(safe(value), sort_keys=False))


class StepReport:
    """What each step found, in order: add, get, as JSON, as a table of one row a step, as a line."""

    def __init__(self) -> None:
        self.steps: list[dict] = []

    def add(self, step: str, **facts: object) -> StepReport:
        self.steps.append({"step": step} | rounded(safe(facts)))
        return self

    def get(self, step: str) -> dict:
        found = [x for x in self.steps if x["step"] == step]
        if not found:
            raise KeyError(f"no step {step!r}; known: {[x['step'] for x in self.steps]}")
        return found[-1]

    def json(self) -> str:
        return json.dumps(self.steps)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, x["step"], json.dumps({k: v for k, v in x.items() if k != "step"})) for i, x in enumerate(self.steps)], "position int, step string, facts string")

    def line(self) -> str:
        return " > ".join(f"{x['step']}({', '.join(f'{k}={v}' for k, v in x.items() if k != 'step' and not isinstance(v, (list, dict)))})" for x in self.steps)
