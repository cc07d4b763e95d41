"""Learned projections: each fits a small relation and applies it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.functions import clipped, finite


def winsorize(df: DataFrame, c: str, low: float, high: float) -> DataFrame:
    b = df.agg(F.percentile(c, F.array(F.lit(low), F.lit(high))).alias("_b"))
    return df.crossJoin(F.broadcast(b)).withColumn(c, clipped(F.col(c), F.col("_b")[0], F.col("_b")[1])).drop("_b")


def with_fit(df: DataFrame, **fits: Column) -> DataFrame:
    """df beside one row of aggregates of it."""
    return df.crossJoin(F.broadcast(df.agg(*[v.alias(k) for k, v in fits.items()])))


def mode_of(df: DataFrame, c: str) -> DataFrame:
    """The most frequent value; the smallest of ties."""
    g = df.filter(F.col(c).isNotNull()).groupBy(c).count()
    return g.agg(F.min_by(c, F.struct(-F.col("count"), F.col(c))).alias("_mode"))


def kept_levels(df: DataFrame, c: str, least: float) -> DataFrame:
    """Levels with at least that share of the non-null rows, or the most frequent one."""
    g = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("level")).agg(F.count("*").alias("n"))
    t = g.agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    kept = g.crossJoin(F.broadcast(t)).filter((F.col("n") / F.col("total") >= least) | ((F.col("top") / F.col("total") < least) & (F.col("n") == F.col("top"))))
    return kept.select("level", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def woe_table(df: DataFrame, c: str, y: str, smoothing: float = 0.5, clip: float = 4.0) -> DataFrame:
    """Weight of evidence per level; null is a level."""
    g = df.groupBy(F.col(c).alias("level")).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    t = g.agg(F.sum("pos").alias("all_pos"), (F.sum("n") - F.sum("pos")).alias("all_neg"), F.count("*").alias("levels"))
    p = (F.col("pos") + smoothing) / (F.col("all_pos") + smoothing * F.col("levels"))
    q = (F.col("n") - F.col("pos") + smoothing) / (F.col("all_neg") + smoothing * F.col("levels"))
    full = g.crossJoin(F.broadcast(t)).withColumns({"p": p, "q": q})
    return full.select("level", "n", "pos", "p", "q", F.least(F.lit(clip), F.greatest(F.lit(-clip), F.log(F.col("p") / F.col("q")))).alias("woe"))


def information_value(woe: DataFrame) -> DataFrame:
    iv = woe.agg(F.round(F.sum((F.col("p") - F.col("q")) * F.col("woe")), 6).alias("iv"))
    band = F.when(F.col("iv") < 0.02, "not_predictive").when(F.col("iv") < 0.1, "weak").when(F.col("iv") < 0.3, "medium").when(F.col("iv") < 0.5, "strong").otherwise("suspiciously_strong")
    return iv.withColumn("band", band)


def looked_up(df: DataFrame, c: str, levels: DataFrame, value: str, default: Column) -> DataFrame:
    """value of each row's level, null-safe, the default where it was never seen."""
    t = levels.select(F.col("level").alias("_level"), F.col(value).alias("_value"))
    return df.join(t, df[c].eqNullSafe(t["_level"]), "left").withColumn(value, F.coalesce("_value", default)).drop("_level", "_value")


def target_means(df: DataFrame, c: str, y: str, m: float) -> DataFrame:
    """Smoothed mean per level: (sum + m * prior) / (n + m)."""
    g = df.groupBy(F.col(c).alias("level")).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    t = g.agg((F.sum("pos") / F.sum("n")).alias("prior"))
    return g.crossJoin(F.broadcast(t)).select("level", ((F.col("pos") + m * F.col("prior")) / (F.col("n") + m)).alias("encoded"), "prior")


def target_out_of_fold(df: DataFrame, c: str, y: str, fold: str, m: float) -> DataFrame:
    """Each row encoded from the other folds: totals less its own fold's."""
    g = df.groupBy(c, fold).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    level = g.groupBy(c).agg(F.sum("n").alias("ln"), F.sum("pos").alias("lp"))
    folds = g.groupBy(fold).agg(F.sum("n").alias("fn"), F.sum("pos").alias("fp"))
    al = g.agg(F.sum("n").alias("an"), F.sum("pos").alias("ap"))
    null_safe = lambda a, b, on: a.join(b.withColumnsRenamed({x: f"_{x}" for x in on}), [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in on]).drop(*[f"_{x}" for x in on])
    t = null_safe(null_safe(g, level, [c]), folds, [fold]).crossJoin(F.broadcast(al))
    prior = (F.col("ap") - F.col("fp")) / (F.col("an") - F.col("fn"))
    t = t.select(c, fold, ((F.col("lp") - F.col("pos") + m * prior) / (F.col("ln") - F.col("n") + m)).alias("encoded"))
    return null_safe(df, t, [c, fold])


def one_hot(df: DataFrame, c: str, *, drop_first: bool = False, most: int | None = None) -> list[str]:
    """Sorted levels that get a column: of the `most` frequent ones, without the first if asked; learned from df."""
    g = df.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c)
    levels = sorted(r[0] for r in (g.limit(most) if most else g).collect())
    return levels[1:] if drop_first else levels


def one_hot_columns(c: str, levels: list[str]) -> list[Column]:
    """A column per level, zero in each for null and unknown values."""
    return [F.coalesce((F.col(c) == x).cast("double"), F.lit(0.0)).alias(f"{c}_{x}") for x in levels]


def winsorize_report(df: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """variable, low, high, clipped_rate of its finite cells."""
    q = df.agg(*[F.percentile(finite(F.col(c).cast("double")), F.array(F.lit(low), F.lit(high))).alias(c) for c in columns])
    bounds = q.withColumnsRenamed({c: f"_{c}" for c in columns})
    out = lambda c: (F.col(c) < F.col(f"_{c}")[0]) | (F.col(c) > F.col(f"_{c}")[1])
    one = df.crossJoin(F.broadcast(bounds)).agg(*[a for c in columns for a in (F.max(f"_{c}").alias(f"b_{c}"), F.avg(out(c).cast("int")).alias(f"r_{c}"))])
    rows = [F.struct(F.lit(c).alias("variable"), F.round(F.col(f"b_{c}")[0], 6).alias("low"), F.round(F.col(f"b_{c}")[1], 6).alias("high"), F.round(f"r_{c}", 6).alias("clipped_rate")) for c in columns]
    return one.select(F.inline(F.array(*rows)))


def kept_by_variance(df: DataFrame, columns: list[str], least: float) -> DataFrame:
    """variable, variance, kept: those above `least`, or else the one of the largest variance."""
    v = df.agg(*[F.var_pop(c).alias(c) for c in columns]).unpivot([], columns, "variable", "v")
    best = v.agg(F.max_by("variable", F.struct("v", F.col("variable"))).alias("_best"), F.max("v").alias("_top"))
    kept = (F.col("v") > least) | ((F.col("_top") <= least) & (F.col("variable") == F.col("_best")))
    return v.crossJoin(F.broadcast(best)).select("variable", F.round("v", 6).alias("variance"), kept.alias("kept"))
