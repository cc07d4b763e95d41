"""Guard of batches to score: what training saw, what is done to values beyond it, flags and verdicts.

Bounds of numeric columns (a few numbers a column) are literals of the plan; levels of
categorical columns are a relation that rows are joined with, so their number is free.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.functions import clipped
from scorelane.operators.ranks import ranked
from scorelane.operators.roles import parsed, reject_duplicates

#: Names of the outputs, as users of the scores know them.
FLAGS = ["n_out_of_range", "n_unseen_category", "n_coerced", "n_newly_missing"]
UNSEEN = "__UNSEEN__"
NOVEL = 20
LEAST_BATCH = 50


@dataclass
class Guard:
    """Learned by fit(); policies say what happens to values that training has not seen."""

    numeric: dict[str, str | None]
    categorical: list[str]
    bounds: dict[str, tuple[float | None, float | None, float | None]] = field(default_factory=dict)
    levels: DataFrame | None = None
    tolerance: float = 0.0
    numeric_policy: str = "clip"
    unseen_policy: str = "sentinel"
    missing_policy: str = "fill"
    max_rate: float = 0.05

    @classmethod
    def fit(cls, train: DataFrame, numeric: dict[str, str | None] | Sequence[str], categorical: Sequence[str], **policies: object) -> Guard:
        """One pass for the bounds of all numeric columns, one for the levels of all categorical ones."""
        kinds = numeric if isinstance(numeric, dict) else dict.fromkeys(numeric)
        types = dict(train.dtypes)
        own = cls(dict(kinds), list(categorical), **policies)
        x = {c: parsed(c, types[c], as_date=k == "datetime") for c, k in kinds.items()}
        one = train.agg(F.lit(1), *[a for c in x for a in (F.min(x[c]), F.max(x[c]), F.percentile(x[c], 0.5))]).first()
        own.bounds = {c: tuple(one[1 + 3 * i : 4 + 3 * i]) for i, c in enumerate(x)}
        pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("string").alias("level")) for c in own.categorical]) if own.categorical else F.array().cast("array<struct<variable:string,level:string>>")
        own.levels = train.select(F.inline(pairs)).filter("level is not null").distinct()
        return own

    @property
    def required(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def edges(self, c: str) -> tuple[float, float]:
        """Bounds widened by the tolerance; infinite where training had no value."""
        low, high, _ = self.bounds[c]
        if low is None or high is None:
            return float("-inf"), float("inf")
        return low - self.tolerance * (high - low), high + self.tolerance * (high - low)

    def envelope(self, spark: SparkSession) -> DataFrame:
        """variable, type, train_min, train_max, train_median, guard_min, guard_max, n_levels."""
        rows = [(c, "numeric", *self.bounds[c], *self.edges(c), 0) for c in self.numeric]
        rows = [(c, t, lo, hi, mid, *(None if abs(e) == float("inf") else e for e in (a, b)), n) for c, t, lo, hi, mid, a, b, n in rows]
        schema = "variable string, type string, train_min double, train_max double, train_median double, guard_min double, guard_max double, n_levels long"
        some = spark.createDataFrame(rows, schema)
        counts = spark.createDataFrame([(c,) for c in self.categorical], "variable string").join(self.levels.groupBy("variable").agg(F.count("*").alias("n_levels")), "variable", "left")
        return some.unionByName(counts.select("variable", F.lit("categorical").alias("type"), F.coalesce("n_levels", F.lit(0)).alias("n_levels")), allowMissingColumns=True)

    def schema(self, columns: Sequence[str]) -> dict[str, list[str]]:
        return {"required": self.required, "missing": [c for c in self.required if c not in columns], "extra": [c for c in columns if c not in self.required]}

    def applied(self, df: DataFrame) -> DataFrame:
        """df with guarded columns, FLAGS, and _issues: (variable, issue, value) of each cell that was changed or flagged."""
        reject_duplicates(df)
        missing = self.schema(df.columns)["missing"]
        if len(missing) == len(self.required):
            raise ValueError(f"none of the expected columns is present: {self.required}")
        if missing and self.missing_policy == "error":
            raise ValueError(f"columns are missing: {missing}")
        for c in missing:
            df = df.withColumn(c, F.lit(None).cast("double" if c in self.numeric else "string"))
        types = dict(df.dtypes)
        values, checks = {}, []
        for c, kind in self.numeric.items():
            x, (low, high) = parsed(c, types[c], as_date=kind == "datetime"), self.edges(c)
            out = F.coalesce((x < low) | (x > high), F.lit(False))
            values[c] = clipped(x, F.lit(low), F.lit(high)) if self.numeric_policy == "clip" else F.when(~out, x) if self.numeric_policy == "nan" else x
            checks += [(c, "n_out_of_range", out), (c, "n_coerced", F.col(f"`{c}`").isNotNull() & x.isNull())]
        for i, c in enumerate(self.categorical):
            known = self.levels.filter(F.col("variable") == c).select(F.col("level").alias(f"_level{i}"))
            level = F.col(f"`{c}`").cast("string")
            df = df.join(known, level == F.col(f"_level{i}"), "left")
            unseen = level.isNotNull() & F.col(f"_level{i}").isNull()
            values[c] = F.when(~unseen, level).otherwise(F.lit(UNSEEN if self.unseen_policy == "sentinel" else None).cast("string"))
            checks.append((c, "n_unseen_category", unseen))
        flags = {f: sum((F.when(x, 1).otherwise(0) for _, k, x in checks if k == f), F.lit(0)) for f in FLAGS[:3]}
        issues = F.array_compact(F.array(*[F.when(x, F.struct(F.lit(c).alias("variable"), F.lit(k[2:]).alias("issue"), F.col(f"`{c}`").cast("string").alias("value"))) for c, k, x in checks]))
        out = df.withColumns({f"_new_{k}": v for k, v in values.items()} | flags | {"n_newly_missing": F.lit(len(missing)), "_issues": issues})
        out = out.drop(*values, *[f"_level{i}" for i in range(len(self.categorical))]).withColumnsRenamed({f"_new_{k}": k for k in values})
        for policy, flag in ((self.numeric_policy, "n_out_of_range"), (self.unseen_policy, "n_unseen_category")):
            if policy == "error" and (n := out.filter(F.col(flag) > 0).count()):
                raise ValueError(f"{n} rows have {flag[2:]} values")
        return out

    def report(self, guarded: DataFrame) -> DataFrame:
        """One row: n_rows, guarded_cells, guarded_rate, n_missing_columns, safe, escalation."""
        cells = F.coalesce(F.sum(F.col("n_out_of_range") + F.col("n_unseen_category") + F.col("n_coerced")), F.lit(0)).cast("long")
        one = guarded.agg(F.count("*").alias("n_rows"), cells.alias("guarded_cells"), F.coalesce(F.max("n_newly_missing"), F.lit(0)).cast("long").alias("n_missing_columns"))
        rate = F.coalesce(F.try_divide("guarded_cells", F.col("n_rows") * len(self.required)), F.lit(0.0))
        safe = (rate <= self.max_rate) & (F.col("n_missing_columns") == 0)
        text = F.when(safe, "ok").when(F.col("n_missing_columns") > 0, "columns are missing: review the whole batch").otherwise("too many guarded cells: review the whole batch")
        return one.select("n_rows", "guarded_cells", F.round(rate, 6).alias("guarded_rate"), "n_missing_columns", safe.alias("safe"), text.alias("escalation"))

    def explained(self, guarded: DataFrame) -> DataFrame:
        """variable, issue, n of each intervention, and the first NOVEL values of unseen categories in order."""
        found = guarded.select(F.inline("_issues")).groupBy("variable", "issue", "value").agg(F.count("*").alias("n"))
        per = found.groupBy("variable", "issue").agg(F.sum("n").alias("n"), F.count("*").alias("n_values"))
        novel = found.filter("issue = 'unseen_category'").withColumn("h", F.row_number().over(_by("variable"))).filter(F.col("h") <= NOVEL).groupBy("variable").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("novel"))
        return per.join(novel, "variable", "left").select("variable", "issue", "n", F.when(F.col("issue") == "unseen_category", F.col("novel")).alias("novel"))


def _by(key: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("value")


def decision_cut(scores: DataFrame, threshold: float | None = None, top_pct: float | None = 0.05, score: str = "fraud_probability") -> Column | float:
    """The absolute threshold; else one half without a share; else the quantile of the batch, which needs LEAST_BATCH rows."""
    if threshold is not None:
        return threshold
    if not top_pct:
        return 0.5
    one = scores.agg(F.count(score), F.percentile(score, 1 - top_pct)).first()
    if one[0] < LEAST_BATCH:
        raise ValueError(f"{one[0]} rows are too few to cut at their top share: give a threshold")
    return one[1]


def score_frame(scored: DataFrame, id_col: str, cut: float, safe: bool = True, *, review_on_flag: bool = True, score: str = "fraud_probability") -> DataFrame:
    """Of rows(id, score, FLAGS): probability, rank, flags, data_quality, decision, action; an unsafe batch guards every row."""
    own = ranked(scored, F.col(score), id_col, descending=True)
    guarded = F.lit(not safe) | (F.col("n_out_of_range") + F.col("n_unseen_category") + F.col("n_coerced") > 0)
    flag = F.col(score) >= cut
    review = (guarded & F.lit(review_on_flag)) | flag
    return own.select(
        id_col, F.col(score).alias("fraud_probability"), F.col("rank").cast("int").alias("score_rank"), *FLAGS, F.when(guarded, "guarded").otherwise("ok").alias("data_quality"),
        F.when(flag, "flag_fraud").otherwise("pass").alias("decision"), F.when(review, "manual_review").otherwise("auto_action").alias("action"),
    )


def score_summary(frame: DataFrame, cut: float) -> DataFrame:
    """cut, n_flagged, flag_rate, n_manual_review, mean_score, p99 of score_frame()'s rows."""
    flag = F.col("decision") == "flag_fraud"
    return frame.agg(F.round(F.lit(cut), 6).alias("cut"), F.count(F.when(flag, 1)).alias("n_flagged"), F.round(F.avg(flag.cast("int")), 6).alias("flag_rate"), F.count(F.when(F.col("action") == "manual_review", 1)).alias("n_manual_review"), F.round(F.avg("fraud_probability"), 6).alias("mean_score"), F.round(F.percentile("fraud_probability", 0.99), 6).alias("p99"))
