"""Fits of binary models by MLlib, scoring, and orderings of their variables.

Frames have an id, y (0/1) and numeric columns without nulls; variables are named by column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.operators import metrics


def class_weighted(train: DataFrame) -> DataFrame:
    """train with w = n / (2 * rows of the class), so that both classes weigh the same."""
    n = train.agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    of_class = F.when(F.col("y") == 1, F.col("pos")).otherwise(F.col("n") - F.col("pos"))
    return train.crossJoin(F.broadcast(n)).withColumn("w", F.col("n") / (2 * of_class)).drop("n", "pos")


def assembled(df: DataFrame, variables: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=variables, outputCol="features").transform(df)


def logistic(weight: float, strength: float = 1.0, max_iter: int = 200) -> LogisticRegression:
    """Squared-norm logistic regression; strength multiplies the data's part of a sum over rows of `weight` in all."""
    return LogisticRegression(labelCol="y", weightCol="w", regParam=1 / (strength * weight), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-9)


def forest(weight: float, trees: int = 20, depth: int = 5, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="y", weightCol="w", numTrees=trees, maxDepth=depth, seed=seed)


def boosted(weight: float, trees: int = 10, depth: int = 3, rate: float = 0.1, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(labelCol="y", weightCol="w", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)


FAMILIES: dict[str, Callable] = {"logistic": logistic, "forest": forest, "gbt": boosted}
#: Names that estimators and their parameters go by elsewhere, and the families and parameters here.
KNOWN = {"LogisticRegression": "logistic", "RandomForestClassifier": "forest", "ExtraTreesClassifier": "forest", "GradientBoostingClassifier": "gbt", "HistGradientBoostingClassifier": "gbt", "XGBClassifier": "gbt", "LGBMClassifier": "gbt"}
PARAMETERS = {"C": "strength", "n_estimators": "trees", "max_iter": {"logistic": "max_iter", "gbt": "trees"}, "max_depth": "depth", "learning_rate": "rate", "random_state": "seed", "strength": "strength", "trees": "trees", "depth": "depth", "rate": "rate", "seed": "seed"}


def family_of(estimator: str) -> str | None:
    """The family of a dotted name or of a family's own name; None for others."""
    last = estimator.rpartition(".")[2]
    return last if last in FAMILIES else KNOWN.get(last)


def arguments(family: str, params: Mapping, seed: int = 42) -> dict:
    """params under the names of the family; those it does not know are left out; the seed is given where it takes one."""
    takes = FAMILIES[family].__code__.co_varnames[1 : FAMILIES[family].__code__.co_argcount]
    out = {}
    for k, v in params.items():
        name = PARAMETERS.get(k)
        name = name.get(family) if isinstance(name, dict) else name
        if name in takes and v is not None:
            out[name] = v
    return ({"seed": seed} if "seed" in takes else {}) | out


def fit(train: DataFrame, variables: list[str], family: str = "logistic", params: Mapping | None = None, *, balanced: bool = True) -> Model:
    """The family's model, with classes weighted equally unless told otherwise; both classes must occur."""
    seen = {r["y"] for r in train.select("y").distinct().collect()}
    if seen != {0, 1}:
        raise ValueError(f"both classes are needed to fit, found {sorted(seen)}")
    weighted = class_weighted(train) if balanced else train.withColumn("w", F.lit(1.0))
    return portable(FAMILIES[family](weighted.agg(F.sum("w")).first()[0], **(params or {})).fit(assembled(weighted, variables)), train.sparkSession)


def portable(model: Model, spark: SparkSession) -> Model:
    """model without its training summary, which would go to the tasks that score.

    A binary summary holds the session, and a session cannot be sent once anything in it was observed or tagged.
    """
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(spark.sparkContext._jvm.scala.Option.empty())
    return model


def scored(model: Model, df: DataFrame, variables: list[str], *keep: str) -> DataFrame:
    """keep, y and s: the model's probability of class 1."""
    return model.transform(assembled(df, variables)).select(*keep, "y", vector_to_array("probability")[1].alias("s"))


def average_precision(model: Model, df: DataFrame, variables: list[str]) -> float | None:
    return metrics.rank_metrics(scored(model, df, variables)).first()["average_precision"]


def importance(model: Model, train: DataFrame, variables: list[str]) -> dict[str, float]:
    """Shares by variable, the largest first: |coefficient| times standard deviation, or the trees' gain."""
    if hasattr(model, "coefficients"):
        sd = train.agg(*[F.stddev_pop(v).alias(v) for v in variables]).first()
        raw = {v: abs(float(c)) * sd[v] for v, c in zip(variables, model.coefficients, strict=True)}
    else:
        raw = dict(zip(variables, map(float, model.featureImportances.toArray()), strict=True))
    total = sum(raw.values())
    return dict(sorted(((v, x / total if total else 0.0) for v, x in raw.items()), key=lambda p: -p[1]))


def permuted(df: DataFrame, id_col: str, variable: str, ranked: Callable[..., DataFrame], turn: int = 0) -> DataFrame:
    """df with the variable's values dealt to other rows, by the order of hashed ids; ranked numbers rows so."""
    shuffled = ranked(df.select(F.concat(F.lit(f"p{turn}"), F.col(id_col).cast("string")).alias("_other"), F.col(variable).alias("_value")), "_other").select("rank", "_value")
    return ranked(df, id_col).join(shuffled, "rank").withColumn(variable, F.col("_value")).select(*df.columns)


def permutation_importance(model: Model, df: DataFrame, variables: list[str], id_col: str, ranked: Callable[..., DataFrame], repeats: int = 1) -> dict[str, float]:
    """How much average precision falls when a variable's values are shuffled, on average over repeats; the largest first."""
    base = average_precision(model, df, variables) or 0.0
    fall = lambda v: sum(base - (average_precision(model, permuted(df, id_col, v, ranked, turn), variables) or 0.0) for turn in range(repeats)) / repeats
    return dict(sorted(((v, fall(v)) for v in variables), key=lambda p: -p[1]))


def eliminated(train: DataFrame, variables: list[str], family: str = "logistic", step: int | float = 1) -> list[str]:
    """Variables from the last one left to the first that went: each round drops the least important, `step` of them or that share."""
    left, gone = list(variables), []
    while len(left) > 1:
        n = max(1, int(step * len(left)) if isinstance(step, float) else step)
        least = list(importance(fit(train, left, family), train, left))[::-1][: min(n, len(left) - 1)]
        left = [v for v in left if v not in least]
        gone += least
    return left + gone[::-1]


def nested_grid(df: DataFrame, variables: list[str], families: tuple[str, ...], folds: int, most: int, at_once: int = 4) -> list[tuple[str, int, int, str, float | None]]:
    """(family, k, fold, variables, average precision) where each fold orders its variables by its own training rows.

    Cells of `at_once` folds and families run at a time. Where a fit fails the cells score null and the grid goes on.
    """
    def cells(fold: int, family: str) -> list[tuple]:
        train, held = df.filter(F.col("fold") != fold), df.filter(F.col("fold") == fold)
        try:
            order = list(importance(fit(train, variables, family), train, variables))
        except Exception:  # noqa: BLE001  a null cell says so
            return [(family, k, fold, "", None) for k in range(1, most + 1)]
        out = []
        for k in range(1, most + 1):
            try:
                out.append((family, k, fold, ",".join(order[:k]), average_precision(fit(train, order[:k], family), held, order[:k])))
            except Exception:  # noqa: BLE001
                out.append((family, k, fold, ",".join(order[:k]), None))
        return out

    with ThreadPoolExecutor(at_once) as pool:
        jobs = [pool.submit(cells, fold, family) for fold in range(folds) for family in families]
        return [c for j in jobs for c in j.result()]


def tuned(df: DataFrame, variables: list[str], family: str, points: list[dict], folds: int, at_once: int = 4) -> list[tuple[dict, float | None]]:
    """(parameters, mean average precision over the folds) of each point, the best first; failed fits count for nothing."""
    def one(point: dict, fold: int) -> float | None:
        try:
            train, held = df.filter(F.col("fold") != fold), df.filter(F.col("fold") == fold)
            return average_precision(fit(train, variables, family, point), held, variables)
        except Exception:  # noqa: BLE001  a null cell says so
            return None

    with ThreadPoolExecutor(at_once) as pool:
        jobs = [[pool.submit(one, p, fold) for fold in range(folds)] for p in points]
        found = [[x for j in row if (x := j.result()) is not None] for row in jobs]
    means = [(p, sum(x) / len(x) if x else None) for p, x in zip(points, found, strict=True)]
    return sorted(means, key=lambda x: -(x[1] if x[1] is not None else float("-inf")))
