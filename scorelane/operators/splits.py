"""Holdouts and folds. Membership follows hashes of ids, times and groups, never row positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelane.operators.ranks import hash_ranked, ranked


def holdout(df: DataFrame, id_col: str, strategy: str = "random", *, share: float = 0.25, y: str = "y", group: str | None = None, time: str | None = None) -> DataFrame:
    """df with part (train or holdout): stratified at random, by whole groups, by time, or by groups in order of their first time."""
    part = lambda out: F.when(out, "holdout").otherwise("train").alias("part")
    if strategy == "random":
        return hash_ranked(df, id_col, y).select(*df.columns, part(F.col("rank") <= F.round(F.col("n") * share)))
    if strategy == "time":
        own = ranked(df, F.unix_micros(F.col(time).cast("timestamp")), id_col)
        return own.select(*df.columns, part(F.col("rank") > F.bround(F.col("n") * (1 - share))))
    if strategy == "group":
        groups = hash_ranked(df.select(F.col(group).alias("_g")).distinct(), "_g").select("_g", (F.col("rank") <= F.ceil(F.col("n") * share)).alias("_out"))
    elif strategy == "group_time":
        first = df.groupBy(F.col(group).alias("_g")).agg(F.unix_micros(F.min(time).cast("timestamp")).alias("_t"))
        groups = ranked(first, F.col("_t"), "_g").select("_g", (F.col("rank") > F.col("n") - F.greatest(F.lit(1), F.round(F.col("n") * share))).alias("_out"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}: random, group, time, group_time")
    return df.join(groups, F.col(group).eqNullSafe(F.col("_g"))).select(*df.columns, part(F.col("_out")))


def split_report(parts: DataFrame, y: str = "y", time: str | None = None) -> DataFrame:
    """part, n, n_positive, prevalence and, with a time, its first and last day."""
    days = [F.date_format(f(F.col(time).cast("timestamp")), "yyyy-MM-dd").alias(n) for f, n in ((F.min, "first_day"), (F.max, "last_day"))] if time else []
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.sum(y).cast("long").alias("n_positive"), F.round(F.avg(y), 6).alias("prevalence"), *days)


def groups_leaked(parts: DataFrame, group: str) -> DataFrame:
    """One row: n_groups, and n_leaked that have rows on both sides."""
    per = parts.groupBy(group).agg(F.count_distinct("part").alias("sides"))
    return per.agg(F.count("*").alias("n_groups"), F.count(F.when(F.col("sides") > 1, 1)).alias("n_leaked"))


def stratified_folds(df: DataFrame, id_col: str, y: str = "y", folds: int = 5, repeats: int = 1) -> DataFrame:
    """id, fold, repeat: classes are dealt evenly; each repeat hashes ids anew."""
    salted = lambda r: F.col(id_col).cast("string") if not r else F.concat(F.lit(f"{r}:"), F.col(id_col).cast("string"))
    each = df.select(id_col, y, F.explode(F.array(*[F.struct(F.lit(r).alias("repeat"), salted(r).alias("_i")) for r in range(repeats)])).alias("_r")).select(id_col, y, "_r.*")
    return hash_ranked(each, "_i", y, "repeat").select(id_col, ((F.col("rank") - 1) % folds).cast("int").alias("fold"), "repeat")


def group_folds(df: DataFrame, group: str, y: str = "y", folds: int = 5) -> DataFrame:
    """group, fold: whole groups, dealt to and fro in order of their positives and sizes, so that classes stay balanced."""
    per = df.groupBy(group).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    top = per.agg(F.max("n").alias("_top"))
    own = ranked(per.crossJoin(F.broadcast(top)), F.col("pos") * (F.col("_top") + 1) + F.col("n"), group, descending=True)
    turn, place = F.floor((F.col("rank") - 1) / folds), (F.col("rank") - 1) % folds
    return own.select(group, F.when(turn % 2 == 0, place).otherwise(folds - 1 - place).cast("int").alias("fold"))


def time_folds(df: DataFrame, id_col: str, time: str, folds: int = 5) -> DataFrame:
    """id, fold of the expanding window: folds test blocks of n // (folds + 1) rows; -1 is always training."""
    own = ranked(df, F.unix_micros(F.col(time).cast("timestamp")), id_col)
    size = F.floor(F.col("n") / (folds + 1))
    k = F.col("rank") - 1 - (F.col("n") - folds * size)
    return own.select(id_col, F.when(k < 0, -1).otherwise(F.floor(k / size)).cast("int").alias("fold"))
