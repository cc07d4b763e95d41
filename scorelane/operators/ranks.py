"""Ranks over whole tables without a window over all rows in one task.

Rows are dealt to buckets that follow the order, ranked inside them, and shifted by the
counts of the buckets before; only those counts meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def hash_ranked(df: DataFrame, id_col: str, *keys: str) -> DataFrame:
    """rank of each row by md5 of its id within keys, and n, how many there are."""
    hashed = df.withColumn("h", F.md5(F.col(id_col).cast("string").cast("binary"))).withColumn("b", F.substring("h", 1, 3))
    return _shifted(hashed, ["h", id_col], *keys)


def _shifted(df: DataFrame, order: list, *keys: str) -> DataFrame:
    """rank and n within keys of rows with a bucket b that follows the order."""
    counts = df.groupBy(*keys, "b").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy(*keys).orderBy("b")) - F.col("c")
    counts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("b").alias("_b"), before.alias("before"), F.sum("c").over(Window.partitionBy(*keys)).alias("n"))
    inside = F.row_number().over(Window.partitionBy(*keys, "b").orderBy(*order))
    same = [df[k].eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("b") == F.col("_b")]
    on = same[0]
    for x in same[1:]:
        on = on & x
    whole = df.withColumn("inside", inside).join(F.broadcast(counts) if not keys else counts, on)
    return whole.withColumn("rank", F.col("inside") + F.col("before")).drop("_b", "inside", "before", *[f"_{k}" for k in keys])


def ranked(df: DataFrame, by: Column, id_col: str, *, descending: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """rank of each row by a number, then by its id, and n.

    Buckets lie between percentiles of the number; one that holds a single value, however
    many rows have it, is cut once more by percentiles of the (numeric) id. Nulls come last.
    """
    levels = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    rows = df.withColumn("_v", -by.cast("double") if descending else by.cast("double"))
    number = dict(df.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint", "float", "double")
    ids = F.percentile_approx(id_col, levels, 1000) if number else F.array().cast(f"array<{dict(df.dtypes)[id_col]}>")
    edges = rows.agg(F.percentile_approx("_v", levels, 1000).alias("_e"), (ids if number else F.first(ids)).alias("_i"))
    above = lambda c, e: F.size(F.filter(e, lambda x: x < c))
    single = lambda c, e: F.exists(e, lambda x: x == c) & F.coalesce(F.size(F.filter(e, lambda x: x == c)) > 1, F.lit(False))
    v, e = F.col("_v"), F.coalesce("_e", F.array().cast("array<double>"))
    # A value between two equal edges fills whole buckets: it is a bucket of its own, after the lesser values of its bucket.
    first = F.when(v.isNull(), 4.0 * buckets).otherwise(2.0 * above(v, e) + F.when(single(v, e), 1.0).otherwise(0.0))
    second = F.when(single(v, e), above(F.col(id_col), F.coalesce("_i", F.array().cast(f"array<{dict(df.dtypes)[id_col]}>")))).otherwise(F.lit(0))
    dealt = rows.crossJoin(F.broadcast(edges)).withColumn("b", F.coalesce(first, F.lit(4.0 * buckets)) * (buckets + 1) + F.coalesce(second, F.lit(0))).drop("_e", "_i")
    return _shifted(dealt, [F.col("_v").asc_nulls_last(), id_col]).drop("_v", "b")


def banded(rank: Column, n: Column, bands: int) -> Column:
    """The band 1..bands of a rank of n, the larger bands first, as ntile deals them."""
    k = F.least(F.lit(bands), F.greatest(n, F.lit(1)))
    small, extra = F.floor(n / k), n % k
    cut = extra * (small + 1)
    return F.when(rank <= cut, F.floor((rank - 1) / (small + 1))).otherwise(extra + F.floor((rank - 1 - cut) / F.greatest(small, F.lit(1)))) + 1
