"""From fold scores(model, k, fold, score) to one specification. These relations are small: cells by folds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Means are compared after rounding, so that engines agree on ties.
TIE = 9


def board(scores: DataFrame, n_splits: int = 5) -> DataFrame:
    """model, k, mean, sd, se, n of each cell over the folds that scored; se is corrected for folds that share training rows."""
    r = 1 / n_splits
    n = F.count("score")
    return scores.groupBy("model", "k").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), (F.stddev_samp("score") * F.sqrt(F.try_divide(F.lit(1.0), n) + r / (1 - r))).alias("se"), n.alias("n"))


def with_train(cells: DataFrame, train_scores: DataFrame) -> DataFrame:
    """Adds train_mean and overfit_gap, from train_scores(model, k, fold, score)."""
    t = train_scores.groupBy("model", "k").agg(F.avg("score").alias("train_mean"))
    return cells.join(t, ["model", "k"], "left").withColumn("overfit_gap", F.col("train_mean") - F.col("mean"))


def _best_first(better: bool) -> list:
    m = F.round("mean", TIE)
    return [m.desc_nulls_last() if better else m.asc_nulls_last(), "model", "k"]


def ranked_board(cells: DataFrame, better: bool = True) -> DataFrame:
    return cells.withColumn("rank", F.row_number().over(Window.orderBy(*_best_first(better))))


def best_per_model(cells: DataFrame, better: bool = True) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("model").orderBy(*_best_first(better)))
    return cells.filter("mean is not null").withColumn("_r", r).filter("_r = 1").drop("_r")


def top(cells: DataFrame, n: int, *, distinct: bool = False, better: bool = True) -> DataFrame:
    own = best_per_model(cells, better) if distinct else cells.filter("mean is not null")
    return own.orderBy(*_best_first(better)).limit(n)


def one_se(cells: DataFrame, *, rule: bool = True, better: bool = True) -> DataFrame:
    """Of the cells within one error of the best, the one of the least k, then of the best mean; without the rule the best."""
    own = cells.filter("mean is not null")
    best = own.orderBy(*_best_first(better)).limit(1).select(F.round("mean", TIE).alias("_mean"), F.coalesce("se", F.lit(0.0)).alias("_se"))
    near = F.col("mean") >= F.col("_mean") - F.col("_se") if better else F.col("mean") <= F.col("_mean") + F.col("_se")
    within = own.crossJoin(F.broadcast(best)).filter(near | (F.round("mean", TIE) == F.col("_mean"))) if rule else own
    return within.orderBy(*(["k"] if rule else []), *_best_first(better)).limit(1).select(*cells.columns)


def deltas(scores: DataFrame, better: bool = True) -> DataFrame:
    """model, fold, from_k, to_k, delta: the gain of each step of k in each fold, positive if better."""
    w = Window.partitionBy("model", "fold").orderBy("k")
    sign = 1 if better else -1
    own = scores.select("model", "fold", F.lag("k").over(w).alias("from_k"), F.col("k").alias("to_k"), F.lag("score").over(w).alias("_was"), (sign * (F.col("score") - F.lag("score").over(w))).alias("delta"))
    return own.filter("from_k is not null").withColumn("relative", F.try_divide("delta", F.abs("_was"))).drop("_was")


def gains(steps: DataFrame, n_splits: int = 5) -> DataFrame:
    """model, from_k, to_k, mean_delta, relative_pct, sd_delta, folds_improved, t (null without spread)."""
    r = 1 / n_splits
    sd = F.stddev_samp("delta")
    t = F.when(F.round(sd, TIE) > 0, F.avg("delta") / (sd * F.sqrt(F.try_divide(F.lit(1.0), F.count("delta")) + r / (1 - r))))
    return steps.groupBy("model", "from_k", "to_k").agg(F.avg("delta").alias("mean_delta"), (100 * F.avg("relative")).alias("relative_pct"), sd.alias("sd_delta"), F.count(F.when(F.round("delta", TIE) > 0, 1)).alias("folds_improved"), t.alias("t"))


def first_non_improving(steps: DataFrame) -> DataFrame:
    m = steps.groupBy("model", "to_k").agg(F.round(F.avg("delta"), TIE).alias("m")).filter("m <= 0")
    return m.groupBy("model").agg(F.min("to_k").alias("first_k"))


def stability(orders: DataFrame, cap: int, most: int | None = None) -> DataFrame:
    """model, variable, share of the folds of orders(model, fold, variable, r) that have it among the first cap."""
    folds = orders.groupBy("model").agg(F.count_distinct("fold").alias("_n"))
    g = orders.filter(F.col("r") <= cap).groupBy("model", "variable").agg(F.count("*").alias("n")).join(F.broadcast(folds), "model")
    out = g.select("model", "variable", F.round(F.col("n") / F.col("_n"), 6).alias("share"))
    return out.withColumn("_r", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("share"), "variable"))).filter(F.col("_r") <= most).drop("_r") if most else out


def agreement(orders: DataFrame) -> DataFrame:
    """model, mean over pairs of folds of: rank correlation, same first variable, overlap of the first five."""
    b = orders.select("model", "variable", F.col("fold").alias("fold2"), F.col("r").alias("r2"))
    n = lambda c: F.count(F.when(c, 1))
    a5, b5 = F.col("r") <= 5, F.col("r2") <= 5
    p = orders.join(b, ["model", "variable"]).filter("fold < fold2").groupBy("model", "fold", "fold2").agg(F.corr("r", "r2").alias("rho"), F.max(((F.col("r") == 1) & (F.col("r2") == 1)).cast("int")).alias("top1"), F.try_divide(n(a5 & b5), n(a5 | b5)).alias("j"))
    return p.groupBy("model").agg(F.round(F.avg("rho"), 6).alias("spearman"), F.round(F.avg("top1"), 6).alias("top1"), F.round(F.avg("j"), 6).alias("top5_jaccard"))


# --- tests of paired differences, on the driver: a handful of folds ---------------------------

def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + up * d, 1 + up / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def t_two_sided(t: float, freedom: float) -> float:
    return beta_share(freedom / 2, 0.5, freedom / (freedom + t * t))


def wilcoxon(values: Sequence[float]) -> float:
    """Two-sided p of the signed-rank test; zeros are ranked and their ranks split, signs are enumerated by counting sums."""
    size = [abs(v) for v in values]
    order = sorted(size)
    rank = [sum(2 * (i + 1) for i, o in enumerate(order) if o == s) / order.count(s) for s in size]  # twice the mean rank, so whole
    zero = sum(r for r, v in zip(rank, values, strict=True) if v == 0) / 2
    plus = sum(r for r, v in zip(rank, values, strict=True) if v > 0) + zero
    ways = {zero: 1.0}
    for r, v in zip(rank, values, strict=True):
        if v:
            new: dict[float, float] = {}
            for s, w in ways.items():
                for to in (s, s + r):
                    new[to] = new.get(to, 0.0) + w / 2
            ways = new
    least = min(plus, sum(rank) - plus)
    return min(1.0, 2 * sum(w for s, w in ways.items() if s <= least + 1e-9))


def verdict(values: Sequence[float | None], n_splits: int, test: str = "paired_t", level: float = 0.05) -> tuple[float | None, str]:
    """p and what it says of the oriented differences of the folds."""
    x = [v for v in values if v is not None and v == v]
    if not x:
        return None, "all_folds_failed"
    if len(x) < 2:
        return None, "insufficient_folds"
    if all(abs(v) < 1e-12 for v in x):
        return None, "no_change"
    mean = sum(x) / len(x)
    if test == "none":
        return None, "improves" if mean > 0 else "degrades"
    if test == "wilcoxon":
        if 2 ** len(x) * level < 2:  # no outcome can be significant
            return wilcoxon(x), "underpowered"
        p = wilcoxon(x)
    else:
        sd = math.sqrt(sum((v - mean) ** 2 for v in x) / (len(x) - 1))
        r = 1 / n_splits
        p = 0.0 if sd < 1e-12 else t_two_sided(mean / (sd * math.sqrt(1 / len(x) + r / (1 - r))), len(x) - 1)
    return p, "not_significant" if p >= level else "improves" if mean > 0 else "degrades"


def tested(steps: DataFrame, n_splits: int = 5, test: str = "paired_t") -> DataFrame:
    """model, to_k, p, verdict of each step of deltas()."""
    rows = steps.groupBy("model", "to_k").agg(F.array_sort(F.collect_list(F.struct("fold", "delta"))).alias("d")).collect()
    out = [(r["model"], r["to_k"], *verdict([x["delta"] for x in r["d"]], n_splits, test)) for r in rows]
    kind = dict(steps.dtypes)["model"]
    return steps.sparkSession.createDataFrame(out, f"model {kind}, to_k {dict(steps.dtypes)['to_k']}, p double, verdict string")
