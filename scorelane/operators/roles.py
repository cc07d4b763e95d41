"""Typing of columns: what they parse as, the roles that follow, targets, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.functions import epoch_days, finite, lenient_days, lenient_number
from scorelane.operators.ranks import hash_ranked

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def reject_duplicates(df: DataFrame) -> DataFrame:
    twice = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if twice:
        raise ValueError(f"column names must be unique, found twice: {twice}")
    return df


def selected(df: DataFrame, columns: Sequence[str], *, missing: str = "raise") -> DataFrame:
    """The columns in that order; absent ones raise, or are passed over with missing="skip"."""
    absent = [c for c in columns if c not in df.columns]
    if absent and missing == "raise":
        raise ValueError(f"columns are missing: {absent}")
    return df.select(*[F.col(f"`{c}`") for c in columns if c not in absent])


def is_number(kind: str) -> bool:
    return kind in NUMBERS or kind.startswith("decimal")


def is_date(kind: str) -> bool:
    return kind == "date" or kind.startswith("timestamp")


def parsed(name: str, kind: str, *, as_date: bool = False) -> Column:
    """A column as a number: numbers as they are, dates and date texts as days, other text leniently."""
    c = F.col(f"`{name}`")
    if is_number(kind):
        return finite(c.cast("double"))
    if is_date(kind):
        return epoch_days(c)
    return lenient_days(c.cast("string")) if as_date else lenient_number(c)


def frame_to_numeric(df: DataFrame, kinds: dict[str, str | None]) -> DataFrame:
    """Every column of kinds as a number of its kind (numeric or datetime); a second time it changes nothing."""
    types = dict(df.dtypes)
    return df.withColumns({c: parsed(c, types[c], as_date=kind == "datetime") for c, kind in kinds.items()})


def parse_kinds(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """variable, kind (numeric, datetime or null), rate; one pass over the table.

    Typed columns have rate 1, a column without values is numeric, numbers are tried before dates.
    """
    types = dict(df.dtypes)
    text = [c for c in columns if not is_number(types[c]) and not is_date(types[c])]
    rate = lambda c, x: F.sum(F.when(F.col(f"`{c}`").isNotNull(), x.isNotNull().cast("int")))
    aggs = [a for i, c in enumerate(text) for a in (F.count(f"`{c}`").alias(f"n{i}"), rate(c, parsed(c, types[c])).alias(f"x{i}"), rate(c, parsed(c, types[c], as_date=True)).alias(f"d{i}"))]
    one = df.agg(F.lit(1).alias("_"), *aggs)

    def row(c: str) -> Column:
        if c not in text:
            return F.struct(F.lit(c).alias("variable"), F.lit("datetime" if is_date(types[c]) else "numeric").alias("kind"), F.lit(1.0).alias("rate"))
        i = text.index(c)
        x, d = F.try_divide(f"x{i}", f"n{i}"), F.try_divide(f"d{i}", f"n{i}")
        none = F.col(f"n{i}") == 0
        kind = F.when(none | (x >= threshold), "numeric").when(d >= threshold, "datetime")
        found = F.when(none, 1.0).when((x < threshold) & (d >= threshold), d).otherwise(x)
        return F.struct(F.lit(c).alias("variable"), kind.alias("kind"), found.alias("rate"))

    return one.select(F.inline(F.array(*[row(c) for c in columns])))


def infer_roles(df: DataFrame, columns: Sequence[str] | None = None, *, declared: dict[str, str] | None = None, threshold: float = 0.95, max_codes: int = 25, ratio: float = 0.5, drop_constant: bool = True) -> DataFrame:
    """variable, role, kind, n_unique of each column.

    Declared roles win and are not dropped. Of the others, in this order: all_missing, constant,
    identifier_like_cardinality (for what looks categorical), numeric, categorical. Numbers with
    at most min(10, max_codes) distinct whole values are codes, hence categorical; booleans never.
    """
    declared, columns = declared or {}, list(columns or df.columns)
    types = dict(df.dtypes)
    kinds = parse_kinds(df, columns, threshold)
    whole = lambda c: F.bool_and(F.col(f"`{c}`") % 1 == 0) if is_number(types[c]) and types[c] != "boolean" else F.lit(False)
    one = df.agg(F.count("*").alias("_n"), *[a for i, c in enumerate(columns) for a in (F.count_distinct(f"`{c}`").alias(f"u{i}"), F.coalesce(whole(c), F.lit(False)).alias(f"w{i}"))])
    facts = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col("_n").alias("n_rows"), F.col(f"u{i}").alias("n_unique"), F.col(f"w{i}").alias("whole"), F.lit(declared.get(c)).cast("string").alias("declared")) for i, c in enumerate(columns)])))
    code = F.col("whole") & (F.col("n_unique") <= min(10, max_codes))
    numeric = F.col("kind").isNotNull() & ~code
    role = (
        F.when(F.col("declared").isNotNull(), F.col("declared"))
        .when(F.col("n_unique") == 0, "all_missing")
        .when((F.col("n_unique") <= 1) & drop_constant, "constant")
        .when(numeric, "numeric")
        .when(~code & (F.col("n_unique") / F.col("n_rows") > ratio), "identifier_like_cardinality")
        .otherwise("categorical")
    )
    return facts.join(F.broadcast(kinds), "variable").select("variable", role.alias("role"), F.when(role == "numeric", F.col("kind")).alias("kind"), "n_unique")


def coercer_report(df: DataFrame, kinds: dict[str, str | None]) -> DataFrame:
    """variable, parse_rate, n_coerced (values that no longer parse), n_not_finite, below_90."""
    types = dict(df.dtypes)

    def row(i: int, c: str) -> Column:
        rate = F.coalesce(F.try_divide(f"x{i}", f"n{i}"), F.lit(1.0))
        return F.struct(F.lit(c).alias("variable"), F.round(rate, 6).alias("parse_rate"), (F.col(f"n{i}") - F.col(f"x{i}")).alias("n_coerced"), F.col(f"f{i}").alias("n_not_finite"), (rate < 0.9).alias("below_90"))

    odd = lambda c: F.isnan(f"`{c}`") | (F.abs(f"`{c}`") == float("inf")) if types[c] in ("float", "double") else F.lit(False)
    aggs = [a for i, (c, kind) in enumerate(kinds.items()) for a in (F.count(f"`{c}`").alias(f"n{i}"), F.count(parsed(c, types[c], as_date=kind == "datetime")).alias(f"x{i}"), F.count(F.when(odd(c), 1)).alias(f"f{i}"))]
    return df.agg(*aggs).select(F.inline(F.array(*[row(i, c) for i, c in enumerate(kinds)])))


def binarized(df: DataFrame, target: str, positive: object = "auto") -> tuple[DataFrame, object]:
    """df with y and without the target, and the label that is 1; the rarer one if positive is "auto"."""
    counts = [(r[0], r[1]) for r in df.filter(F.col(target).isNotNull()).groupBy(target).count().orderBy("count", target).limit(3).collect()]
    if len(counts) != 2:
        raise ValueError(f"the target {target!r} needs two classes, found {[v for v, _ in counts]}{' and more' if len(counts) > 2 else ''}")
    label = counts[0][0] if positive == "auto" else next((v for v, _ in counts if str(v) == str(positive)), None)
    if label is None:
        raise ValueError(f"the label {positive!r} is not in {target!r}, observed {sorted(str(v) for v, _ in counts)}")
    return df.withColumn("y", (F.col(target) == F.lit(label)).cast("int")).drop(*([target] if target != "y" else [])), label


def check_positives(n_pos: int, n_splits: int, holdout: float = 0.0) -> bool:
    """Raises with fewer than two positives a fold; True if folds have fewer than ten."""
    if n_pos < 2 * n_splits:
        raise ValueError(f"{n_pos} positives are too few for {n_splits} folds")
    return n_pos * (1 - holdout) / n_splits < 10


def sample_exact(df: DataFrame, share: float, id_col: str) -> DataFrame:
    """max(round(n * share), 1) rows, picked by the hash of their id."""
    own = hash_ranked(df, id_col)
    return own.filter(F.col("rank") <= F.greatest(F.round(F.col("n") * share), F.lit(1))).select(*df.columns)
