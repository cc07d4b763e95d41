"""Metrics of binary scores. Frames have y (0/1) and s (score); keys group them.

Running sums go over distinct scores, not rows, within `keys`; without keys they are taken
inside BUCKETS ranges of scores and shifted by the totals of the ranges before.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelane.functions import finite, safe_ratio
from scorelane.operators.ranks import BUCKETS, banded, ranked


def curve(preds: DataFrame, *keys: str) -> DataFrame:
    """Per distinct score: tp, fp at it, tps, fps at or above it, P and N."""
    g = preds.groupBy(*keys, "s").agg(F.sum("y").alias("tp"), F.sum(1 - F.col("y")).alias("fp"))
    if keys:
        up = Window.partitionBy(*keys).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
        al = Window.partitionBy(*keys)
        return g.select(*keys, "s", "tp", "fp", F.sum("tp").over(up).alias("tps"), F.sum("fp").over(up).alias("fps"), F.sum("tp").over(al).alias("P"), F.sum("fp").over(al).alias("N"))
    edges = preds.agg(F.coalesce(F.percentile_approx("s", F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)]), 1000), F.array().cast("array<double>")).alias("_e"))
    dealt = g.crossJoin(F.broadcast(edges)).withColumn("b", F.size(F.filter("_e", lambda x: x > F.col("s")))).drop("_e")
    up = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    totals = dealt.groupBy("b").agg(F.sum("tp").alias("bt"), F.sum("fp").alias("bf"))
    al = Window.partitionBy()
    totals = totals.select("b", (F.sum("bt").over(up) - F.col("bt")).alias("t0"), (F.sum("bf").over(up) - F.col("bf")).alias("f0"), F.sum("bt").over(al).alias("P"), F.sum("bf").over(al).alias("N"))
    inside = Window.partitionBy("b").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.select("b", "s", "tp", "fp", F.sum("tp").over(inside).alias("t1"), F.sum("fp").over(inside).alias("f1"))
    return own.join(F.broadcast(totals), "b").select("s", "tp", "fp", (F.col("t0") + F.col("t1")).alias("tps"), (F.col("f0") + F.col("f1")).alias("fps"), "P", "N")


def rank_metrics(preds: DataFrame, *keys: str) -> DataFrame:
    """average_precision, roc_auc and ks; null where a class is missing."""
    both = (F.max("P") > 0) & (F.max("N") > 0)
    ap = F.sum(safe_ratio(F.col("tp"), F.col("P")) * safe_ratio(F.col("tps"), F.col("tps") + F.col("fps")))
    auc = F.sum(safe_ratio((F.col("tps") - F.col("tp") / 2) * F.col("fp"), F.col("P") * F.col("N")))
    ks = F.greatest(F.lit(0.0), F.max(safe_ratio(F.col("tps"), F.col("P")) - safe_ratio(F.col("fps"), F.col("N"))))
    c = curve(preds, *keys)
    return (c.groupBy(*keys) if keys else c.groupBy()).agg(*[F.round(F.when(both, m), 6).alias(n) for n, m in (("average_precision", ap), ("roc_auc", auc), ("ks", ks))])


def kept_points(preds: DataFrame, *keys: str) -> DataFrame:
    """The ROC without collinear points, from (0, 0): f, t, threshold."""
    o = Window.partitionBy(*keys).orderBy(F.desc("s"))
    c = curve(preds, *keys).withColumns({"ltp": F.lag("tp").over(o), "ntp": F.lead("tp").over(o), "nfp": F.lead("fp").over(o)})
    kept = c.filter(F.col("ltp").isNull() | F.col("ntp").isNull() | (F.col("tp") != F.col("ntp")) | (F.col("fp") != F.col("nfp")))
    points = kept.select(*keys, safe_ratio(F.col("fps"), F.col("N")).alias("f"), safe_ratio(F.col("tps"), F.col("P")).alias("t"), F.col("s").alias("threshold"))
    origin = c.groupBy(*keys) if keys else c.groupBy()
    return points.union(origin.agg(F.lit(0.0), F.lit(0.0), F.max("s")))


def at_fpr(preds: DataFrame, budget: float, *keys: str, digits: int | None = 6) -> DataFrame:
    """recall_at_fpr and threshold_at_fpr, interpolated; not rounded with digits=None, as cuts have to be. Null where a class is missing."""
    p = kept_points(preds, *keys)
    low = F.max(F.when(F.col("f") <= budget, F.struct("f", "t", (-F.col("threshold")).alias("n")))).alias("lo")
    high = F.min(F.when(F.col("f") > budget, F.struct("f", "t", (-F.col("threshold")).alias("n")))).alias("hi")
    r = (p.groupBy(*keys) if keys else p.groupBy()).agg(low, high, (F.max("t") > 0).alias("pos"), (F.max("f") > 0).alias("neg"))
    part = safe_ratio(F.lit(budget) - F.col("lo.f"), F.col("hi.f") - F.col("lo.f"))
    rounded = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    mix = lambda k, sign: rounded(F.when(F.col("pos") & F.col("neg"), sign * F.when(F.col("hi").isNull(), F.col(f"lo.{k}")).otherwise(F.col(f"lo.{k}") + part * (F.col(f"hi.{k}") - F.col(f"lo.{k}")))))
    return r.select(*keys, mix("t", 1).alias("recall_at_fpr"), mix("n", -1).alias("threshold_at_fpr"))


def pointwise(preds: DataFrame, *keys: str) -> DataFrame:
    """brier, log_loss, prevalence, mean_predicted."""
    eps = 2.220446049250313e-16
    s = F.least(F.greatest("s", F.lit(eps)), F.lit(1 - eps))
    loss = -F.avg(F.col("y") * F.log(s) + (1 - F.col("y")) * F.log(1 - s))
    return (preds.groupBy(*keys) if keys else preds.groupBy()).agg(
        F.round(F.avg(F.pow(F.col("s") - F.col("y"), 2)), 6).alias("brier"), F.round(loss, 6).alias("log_loss"),
        F.round(F.avg("y"), 6).alias("prevalence"), F.round(F.avg("s"), 6).alias("mean_predicted"),
    )


def lift_at_top(preds: DataFrame, share: float, order: str) -> DataFrame:
    own = ranked(preds, F.col("s"), order, descending=True)
    top = F.col("rank") <= F.greatest(F.ceil(F.lit(share) * F.col("n")), F.lit(1))
    return own.agg(F.round(safe_ratio(F.avg(F.when(top, F.col("y"))), F.avg("y")), 6).alias("lift"))


def calibration_error(preds: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over quantile bins; (low, high] bins."""
    grid = [i / bins for i in range(bins + 1)]
    edges = preds.agg(F.array_distinct(F.percentile("s", F.array(*map(F.lit, grid)))).alias("e"))
    inner = F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0)))
    b = preds.crossJoin(F.broadcast(edges)).select("y", "s", F.size(F.filter(inner, lambda e: e < F.col("s"))).alias("b"))
    g = b.groupBy("b").agg(F.count("*").alias("n"), F.avg("s").alias("ms"), F.avg("y").alias("my"))
    return g.agg(F.round(F.sum(F.col("n") * F.abs(F.col("ms") - F.col("my"))) / F.sum("n"), 6).alias("ece"))


def decile_table(preds: DataFrame, order: str, bands: int = 10) -> DataFrame:
    own = ranked(preds, F.col("s"), order, descending=True)
    g = own.withColumn("band", banded(F.col("rank"), F.col("n"), bands)).groupBy("band").agg(F.count("*").alias("n"), F.min("s").alias("score_min"), F.max("s").alias("score_max"), F.sum("y").alias("n_positive"))
    al, up = Window.partitionBy(), Window.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    rate = F.col("n_positive") / F.col("n")
    return g.select(
        F.col("band").cast("int"), F.col("n").cast("long"), F.round("score_min", 6).alias("score_min"), F.round("score_max", 6).alias("score_max"), F.col("n_positive").cast("long"),
        F.round(rate, 6).alias("positive_rate"), F.round(safe_ratio(rate, F.sum("n_positive").over(al) / F.sum("n").over(al)), 4).alias("lift"),
        F.round(safe_ratio(F.sum("n_positive").over(up), F.sum("n_positive").over(al)), 6).alias("cumulative_capture"),
    )


def psi(reference: DataFrame, current: DataFrame, bins: int = 10, epsilon: float = 1e-6) -> DataFrame:
    """Population stability index of x; [low, high) bins at the reference's quantiles."""
    edges = reference.filter("x is not null and not isnan(x) and abs(x) != double('inf')").agg(F.array_distinct(F.percentile("x", F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).alias("e"))
    inner = F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0)))
    both = reference.select("x", F.lit(1).alias("r")).union(current.select("x", F.lit(0).alias("r"))).filter("x is not null and not isnan(x) and abs(x) != double('inf')")
    g = both.crossJoin(F.broadcast(edges)).groupBy(F.size(F.filter(inner, lambda e: e <= F.col("x"))).alias("b")).agg(F.sum("r").alias("r"), F.sum(1 - F.col("r")).alias("c"))
    al = Window.partitionBy()
    p = F.greatest(F.col("r") / F.sum("r").over(al), F.lit(epsilon))
    q = F.greatest(F.col("c") / F.sum("c").over(al), F.lit(epsilon))
    d = g.select(((q - p) * F.log(q / p)).alias("d")).agg(F.round(F.sum("d"), 6).alias("psi"))
    return d.withColumn("band", psi_band(F.col("psi")))


def psi_band(psi_: Column) -> Column:
    """stable, watch, investigate; unknown where there is no number."""
    known = psi_.isNotNull() & ~F.isnan(psi_) & (F.abs(psi_) != float("inf"))
    return F.when(~known, "unknown").when(psi_ < 0.1, "stable").when(psi_ < 0.25, "watch").otherwise("investigate")


def psi_per_feature(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """variable, psi, band of each numeric column; values that are not finite are left out."""
    each = [psi(reference.select(finite(F.col(c).cast("double")).alias("x")), current.select(finite(F.col(c).cast("double")).alias("x"))).select(F.lit(c).alias("variable"), "psi", "band") for c in columns]
    return reduce(DataFrame.union, each)


def reference_quantiles(rows: DataFrame, id_col: str, levels: int = 100) -> DataFrame:
    """level, quantile: observed values of x at even levels, the least whose share of rows reaches the level."""
    own = ranked(rows.filter("x is not null and not isnan(x)"), F.col("x"), id_col)
    grid = own.sparkSession.range(levels + 1).select(F.col("id").cast("int").alias("level"))
    n = own.agg(F.max("n").alias("total"))
    places = grid.crossJoin(F.broadcast(n)).select("level", F.greatest(F.lit(1), F.ceil(F.col("level") / float(levels) * F.col("total"))).alias("rank"))
    return own.join(F.broadcast(places), "rank").select("level", F.col("x").alias("quantile"))


def operating_points(preds: DataFrame, thresholds: DataFrame | None = None, *keys: str) -> DataFrame:
    """Confusion counts and rates per threshold (a few rows; default_cuts() without any) and keys."""
    thresholds = default_cuts(preds) if thresholds is None else thresholds
    flag = F.col("s") >= F.col("threshold")
    c = lambda cond: F.count(F.when(cond, 1))
    g = preds.crossJoin(F.broadcast(thresholds)).groupBy(*keys, "threshold").agg(c(flag & (F.col("y") == 1)).alias("tp"), c(flag & (F.col("y") == 0)).alias("fp"), c(~flag & (F.col("y") == 1)).alias("fn"), c(~flag & (F.col("y") == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return g.select(*keys, "threshold", "tp", "fp", "fn", "tn", *[F.round(safe_ratio(a, b), 6).alias(n) for n, a, b in (("flag_rate", tp + fp, tp + fp + fn + tn), ("precision", tp, tp + fp), ("recall", tp, tp + fn), ("fpr", fp, fp + tn), ("f1", 2 * tp, 2 * tp + fp + fn))])


def psi_from_quantiles(stored: DataFrame, current: DataFrame, bins: int = 10, epsilon: float = 1e-6) -> DataFrame:
    """PSI of current(x) against one row of stored(q), the reference's quantiles at even levels.

    A bin expects the levels between its edges' first places in q, so a tied block counts whole.
    Null where either side is empty, 0 with fewer than two bins.
    """
    last = F.size("q") - 1
    places = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.element_at("q", (F.round(i * last / bins) + 1).cast("int")))
    edges = stored.select("q", F.array_sort(F.array_distinct(places)).alias("e"))
    inner = edges.select(F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0))).alias("inner"))
    seen = current.filter("x is not null and not isnan(x)").join(F.broadcast(inner))
    seen = seen.groupBy(F.size(F.filter("inner", lambda v: v <= F.col("x"))).alias("bin")).agg(F.count("*").alias("c"))
    below = lambda i: (F.array_position(F.col("q"), F.element_at("e", i)) - 1) / last
    final = F.greatest(F.size("e") - 2, F.lit(0))
    ranges = edges.select("q", "e", F.explode(F.sequence(F.lit(0), final)).alias("bin"))
    lo = F.when(F.col("bin") == 0, 0.0).otherwise(below(F.col("bin") + 1))
    hi = F.when(F.col("bin") == final, 1.0).otherwise(below(F.col("bin") + 2))
    each = ranges.select("bin", (hi - lo).alias("p")).join(seen, "bin", "left").select("p", F.coalesce("c", F.lit(0)).alias("c"))
    total = each.agg(F.sum("c").alias("total"))
    p, a = F.greatest("p", F.lit(epsilon)), F.greatest(F.col("c") / F.col("total"), F.lit(epsilon))
    return each.join(F.broadcast(total)).filter("total > 0").agg(F.round(F.sum((a - p) * F.ln(a / p)), 6).alias("psi"))


def at_thresholds(preds: DataFrame, cuts: DataFrame) -> DataFrame:
    """Flag rate, precision and recall at each of a few cuts(source, threshold)."""
    flagged = (F.col("s") >= F.col("threshold")).cast("int")
    rows = preds.join(F.broadcast(cuts)).withColumn("flag", flagged)
    hits = F.sum(F.col("flag") * F.col("y"))
    share = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    return rows.groupBy("source", "threshold").agg(F.round(F.avg("flag"), 6).alias("flag_rate"), share(hits, F.sum("flag")).alias("precision"), share(hits, F.sum("y")).alias("recall"))


# --- registry -------------------------------------------------------------------------

#: Name -> is more better; those with a budget take one or several.
METRICS = {"average_precision": True, "roc_auc": True, "ks": True, "recall_at_fpr": True, "lift_at_top_pct": True, "ece": False, "brier": False, "log_loss": False}
BUDGETS = {"recall_at_fpr": 0.01, "lift_at_top_pct": 0.05}


def columns_of(names: Sequence[str], budgets: Mapping[str, float | Sequence[float]] | None = None, primary: str | None = None) -> list[tuple[str, str, float | None]]:
    """(column, metric, budget): a single budget has the metric's name, several are name@budget, and name@budget may be asked for itself.

    The primary metric comes first and must be one column.
    """
    given = {k: list(v) if isinstance(v, (list, tuple)) else v for k, v in (BUDGETS | dict(budgets or {})).items()}
    out: dict[str, tuple[str, str, float | None]] = {}

    def add(name: str) -> list[str]:
        base, _, at = name.partition("@")
        if base not in METRICS or (at and base not in BUDGETS):
            raise ValueError(f"unknown metric {name!r}; known: {sorted(METRICS)}")
        values = [float(at)] if at else given.get(base, None)
        several = isinstance(values, list)
        made = []
        for v in values if several else [values]:
            column = f"{base}@{v:g}" if several else base
            out.setdefault(column, (column, base, v))
            made.append(column)
        return made

    first = add(primary) if primary else []
    if len(first) > 1:
        raise ValueError(f"the primary metric must be one column, {primary!r} is {first}")
    for name in names:
        add(name)
    return list(out.values())


def greater_is_better(column: str) -> bool:
    return METRICS[column.partition("@")[0]]


def oriented(column: str, value: float | None) -> float | None:
    """value such that more is better."""
    return value if value is None or greater_is_better(column) else -value


def evaluated(preds: DataFrame, wanted: Sequence[tuple[str, str, float | None]], order: str) -> DataFrame:
    """One row: the wanted columns, prevalence, mean_predicted, calibration_ratio, calibration_error."""
    base = {m for _, m, _ in wanted}
    parts = [pointwise(preds)]
    if base & {"average_precision", "roc_auc", "ks"}:
        parts.append(rank_metrics(preds))
    if "ece" in base:
        parts.append(calibration_error(preds))
    for column, metric, budget in wanted:
        if metric == "recall_at_fpr":
            parts.append(at_fpr(preds, budget).select(F.col("recall_at_fpr").alias(column)))
        elif metric == "lift_at_top_pct":
            parts.append(lift_at_top(preds, budget, order).select(F.col("lift").alias(column)))
    one = reduce(DataFrame.crossJoin, parts)
    extra = preds.agg(F.round(safe_ratio(F.avg("s"), F.avg("y")), 6).alias("calibration_ratio"), F.round(F.avg("s") - F.avg("y"), 6).alias("calibration_error"))
    return one.crossJoin(extra).select(*[F.col(f"`{c}`") for c, _, _ in wanted], "prevalence", "mean_predicted", "calibration_ratio", "calibration_error")


def default_cuts(preds: DataFrame) -> DataFrame:
    """threshold: the distinct quantiles of all rows that groups share."""
    q = F.percentile("s", F.array(*map(F.lit, (0.8, 0.9, 0.95, 0.98, 0.99))))
    return preds.agg(q.alias("q")).select(F.explode(F.array_distinct(F.transform("q", lambda x: F.round(x, 6)))).alias("threshold"))
