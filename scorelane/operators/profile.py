"""Profiles of tables: numbers, levels, targets, matrices, fingerprints, slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.functions import safe_ratio
from scorelane.operators import metrics
from scorelane.operators.roles import is_number


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """variable, missing_rate, n_unique, mean, std, p01, p50, p99, skew (null with fewer than three values), in one pass."""
    def row(i: int, c: str) -> Column:
        n = F.col(f"n{i}")
        skew = F.when(n > 2, F.col(f"k{i}") * F.sqrt(n * (n - 1)) / (n - 2))
        return F.struct(F.lit(c).alias("variable"), F.round(1 - n / F.col("_n"), 6).alias("missing_rate"), F.col(f"u{i}").alias("n_unique"), *[F.round(x, 6).alias(k) for k, x in (("mean", F.col(f"m{i}")), ("std", F.col(f"s{i}")), ("p01", F.col(f"q{i}")[0]), ("p50", F.col(f"q{i}")[1]), ("p99", F.col(f"q{i}")[2]), ("skew", skew))])

    q = F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))
    aggs = [a for i, c in enumerate(columns) for a in (F.count(c).alias(f"n{i}"), F.count_distinct(c).alias(f"u{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"), F.percentile(c, q).alias(f"q{i}"), F.skewness(c).alias(f"k{i}"))]
    return df.agg(F.count("*").alias("_n"), *aggs).select(F.inline(F.array(*[row(i, c) for i, c in enumerate(columns)])))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: the share of rows that equal an earlier one in every column."""
    per = df.groupBy(*df.columns).count()
    return per.agg(F.round(1 - F.count("*") / F.sum("count"), 6).alias("duplicate_row_rate"))


def target_counts(df: DataFrame, target: str) -> DataFrame:
    """class (null is one) and n."""
    return df.groupBy(F.col(target).cast("string").alias("class")).agg(F.count("*").alias("n"))


def matrix_profile(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, missing_rate, and the constant numeric columns by name."""
    numeric = [c for c, t in df.dtypes if is_number(t)]
    one = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"c_{c}") for c in df.columns], *[F.var_pop(F.col(c).cast("double")).alias(f"v_{c}") for c in numeric])
    cells = sum((F.col(f"c_{c}") for c in df.columns), F.lit(0))
    constant = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"v_{c}") == 0, F.lit(c)) for c in numeric]) if numeric else F.array().cast("array<string>"))), ",")
    return one.select(F.col("n").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.round(1 - safe_ratio(cells, F.col("n") * len(df.columns)), 6).alias("missing_rate"), constant.alias("constant"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: n_rows, data_hash (whatever the order of rows), columns_hash."""
    names = F.sha2(F.lit("|".join(sorted(df.columns))), 256)
    h = F.xxhash64(*sorted(df.columns))
    both = F.concat_ws(":", F.hex(F.coalesce(F.bit_xor(h), F.lit(0))), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string"))
    return df.agg(F.count("*").alias("n_rows"), F.substring(F.sha2(both, 256), 1, 16).alias("data_hash"), F.substring(F.first(names), 1, 16).alias("columns_hash"))


def aggregate_to_source(shares: DataFrame, how: str = "sum") -> DataFrame:
    """source, value of shares(source, value): how encoded columns' values add up for the column they come from."""
    return shares.groupBy("source").agg(F.round({"sum": F.sum, "max": F.max, "mean": F.avg, "min": F.min}[how]("value"), 6).alias("value"))


def slice_report(preds: DataFrame, columns: Sequence[str], cut: float | Column, least: int = 50) -> DataFrame:
    """variable, level (null is the level nan), n, prevalence, average_precision, roc_auc, mean_score, flag_rate at one cut for all.

    A level of one class keeps its row, without the two metrics; levels of fewer than `least` rows are left out.
    """
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    long = preds.select("y", "s", F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), level(c).alias("level")) for c in columns])))
    flag = (F.col("s") >= cut).cast("int")
    g = long.groupBy("variable", "level").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("prevalence"), F.round(F.avg("s"), 6).alias("mean_score"), F.round(F.avg(flag), 6).alias("flag_rate")).filter(F.col("n") >= least)
    return g.join(metrics.rank_metrics(long, "variable", "level").drop("ks"), ["variable", "level"])


def flag_rate_disparity(slices: DataFrame) -> DataFrame:
    """One row: over the variables, the largest ratio of the highest to the lowest flag rate."""
    per = slices.groupBy("variable").agg((F.max("flag_rate") / F.greatest(F.min("flag_rate"), F.lit(1e-9))).alias("r"))
    return per.agg(F.round(F.max("r"), 3).alias("flag_rate_disparity"))
