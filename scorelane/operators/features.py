"""Typed columns to model columns, learned from training rows: a few aggregates, then one projection.

Numeric: lenient parse, winsorize, impute with an indicator for what was missing at the fit,
scale, drop what does not vary. Categorical: impute, collapse rare levels, encode. What is
learned is small (a few numbers a column, at most 1 / min_frequency levels) and goes into the
plan as literals. Every made column knows its source.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.config import Config
from scorelane.functions import clipped
from scorelane.operators import encode
from scorelane.operators.roles import parsed


@dataclass
class Features:
    numeric: dict[str, dict] = field(default_factory=dict)
    categorical: dict[str, dict] = field(default_factory=dict)
    passthrough: list[str] = field(default_factory=list)
    source: dict[str, str] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)

    def as_dict(self) -> dict:
        return asdict(self)

    # --- numeric ---

    def _value(self, c: str, types: Mapping[str, str]) -> Column:
        """Parsed and winsorized."""
        p = self.numeric[c]
        x = parsed(c, types[c], as_date=p["kind"] == "datetime")
        return x if p.get("low") is None else clipped(x, F.lit(p["low"]), F.lit(p["high"]))

    def _columns(self, types: Mapping[str, str]) -> dict[str, Column]:
        out = {}
        for c, p in self.numeric.items():
            x = self._value(c, types)
            scaled = lambda v, a, b: (v - F.lit(a)) / F.lit(b) if b is not None else v
            out[f"num__{c}"] = scaled(F.coalesce(x, F.lit(p["fill"])), p.get("centre", 0.0), p.get("width"))
            if p["indicator"]:
                out[f"num__missingindicator_{c}"] = scaled(x.isNull().cast("double"), p.get("icentre", 0.0), p.get("iwidth"))
        for c, p in self.categorical.items():
            level = self._level(c)
            if p["encoder"] == "onehot":
                shown = p["levels"][1:] if p["drop_first"] else p["levels"]
                out |= {f"cat__{c}_{x}": (level == x).cast("double") for x in shown}
            else:
                table = F.lit(None).cast("double")
                for x, v in zip(p["levels"], p["values"], strict=True):
                    table = F.when(level == x, F.lit(float(v))).otherwise(table)
                out[f"cat__{c}_woe" if p["encoder"] == "woe" else f"cat__{c}"] = F.coalesce(table, F.lit(float(p["default"])))
        out |= {f"pass__{c}": F.col(f"`{c}`") for c in self.passthrough}
        return {k: v for k, v in out.items() if k not in self.dropped}

    def _level(self, c: str) -> Column:
        """Imputed, with rare levels as one."""
        p = self.categorical[c]
        filled = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(p["fill"]))
        return F.when(filled.isin(p["kept"]), filled).otherwise(F.lit(p["other"])) if p["other"] is not None else filled

    # --- fit and transform ---

    @classmethod
    def fit(cls, train: DataFrame, numeric: Mapping[str, str | None], categorical: Sequence[str], cfg: Config, passthrough: Sequence[str] = ()) -> Features:
        """train has y; three passes over it at most, whatever the number of columns."""
        own, types = cls(passthrough=list(passthrough)), dict(train.dtypes)
        n = cfg["preprocessing.numeric"]
        if numeric:
            x = {c: parsed(c, types[c], as_date=k == "datetime") for c, k in numeric.items()}
            w = n["winsorize"]
            q = F.array(F.lit(w["lower_quantile"]), F.lit(w["upper_quantile"]))
            one = train.agg(F.count("*"), *[a for c in x for a in (F.count(x[c]), F.percentile(x[c], q))]).first()
            for i, (c, kind) in enumerate(numeric.items()):
                low, high = (one[2 + 2 * i] or (None, None)) if w["enabled"] else (None, None)
                own.numeric[c] = {"kind": kind, "low": low, "high": high, "fill": 0.0, "indicator": bool(n["add_missing_indicator"] and one[1 + 2 * i] < one[0])}
            fill = {"median": lambda v: F.percentile(v, 0.5), "mean": F.avg, "constant": lambda v: F.max(F.lit(float(n["imputer_fill_value"])))}[n["imputer"]]
            one = train.agg(F.lit(1), *[fill(own._value(c, types)) for c in numeric]).first()
            for i, c in enumerate(numeric):
                own.numeric[c]["fill"] = float(one[1 + i]) if one[1 + i] is not None else 0.0
        own._fit_levels(train, categorical, cfg)
        made = own._columns(types)
        own.source = {k: own._source_of(k) for k in made}
        scaler, least = n["scaler"], n["variance_threshold"]
        flat = [k for k in made if k.startswith("num__")]
        if flat and (scaler != "none" or least is not None):
            rows = train.select(*[made[k].alias(str(i)) for i, k in enumerate(flat)])
            centre, width = {"standard": (F.avg, F.stddev_pop), "robust": (lambda c: F.percentile(c, 0.5), lambda c: F.percentile(c, 0.75) - F.percentile(c, 0.25)), "minmax": (F.min, lambda c: F.max(c) - F.min(c)), "none": (lambda c: F.lit(0.0), lambda c: F.lit(1.0))}[scaler]
            one = rows.agg(*[a for i in range(len(flat)) for a in (centre(str(i)), width(str(i)), F.var_pop(str(i)))]).first()
            for i, k in enumerate(flat):
                a, b, v = (float(z) if z is not None else 0.0 for z in one[3 * i : 3 * i + 3])
                p, mark = own.numeric[own.source[k]], "i" if k.startswith("num__missingindicator_") else ""
                if scaler != "none":
                    p[f"{mark}centre"], p[f"{mark}width"] = a, b or 1.0
                if least is not None and v / (b or 1.0) ** 2 <= least and not (scaler != "none" and v / (b or 1.0) ** 2 > least):
                    own.dropped.append(k)
            if len(own.dropped) == len(made):
                own.dropped.pop()
        return own

    def _source_of(self, made: str) -> str:
        stem = made.split("__", 1)[1].removeprefix("missingindicator_") if made.startswith("num__missingindicator_") else made.split("__", 1)[1]
        names = [c for c in [*self.numeric, *self.categorical, *self.passthrough] if stem == c or stem.startswith(f"{c}_")]
        return max(names, key=len)

    def _fit_levels(self, train: DataFrame, categorical: Sequence[str], cfg: Config) -> None:
        p = cfg["preprocessing.categorical"]
        if not categorical:
            return
        long = train.select("y", F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("string").alias("level")) for c in categorical])))
        counts = long.groupBy("variable", "level").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
        totals = counts.groupBy("variable").agg(F.sum("n").alias("all"), F.sum("pos").alias("all_pos"), F.sum(F.when(F.col("level").isNotNull(), F.col("n"))).alias("known"), F.min_by("level", F.when(F.col("level").isNotNull(), F.struct(-F.col("n"), F.col("level")))).alias("top"))
        share = p["rare_level"]["min_frequency"] if p["rare_level"]["enabled"] else 0.0
        kept = counts.join(totals, "variable").filter(F.col("level").isNull() | (F.col("n") >= share * F.col("known")) | (F.col("level") == F.col("top")))
        rows: dict[str, list] = {c: [] for c in categorical}
        for r in kept.collect():
            rows[r["variable"]].append(r)
        for c in categorical:
            self.categorical[c] = self._encoded(rows[c], p, share)

    @staticmethod
    def _encoded(rows: list, p: Mapping, share: float) -> dict:
        """Levels of one column and what each becomes; rows: kept levels, null among them, with the column's totals."""
        fill = p["imputer_fill_value"] if p["imputer"] == "constant" else next((r["top"] for r in rows if r["top"] is not None), p["imputer_fill_value"])
        group: dict[str, list[float]] = {}
        for r in rows:
            g = group.setdefault(r["level"] if r["level"] is not None else fill, [0.0, 0.0])
            g[0], g[1] = g[0] + r["n"], g[1] + (r["pos"] or 0)
        total, positive = (float(rows[0]["all"]), float(rows[0]["all_pos"] or 0)) if rows else (0.0, 0.0)
        regular = [x for x, (n, _) in group.items() if n >= share * total]
        kept = sorted(regular or sorted(group, key=lambda x: (-group[x][0], x))[:1])
        other = p["rare_level"]["other_label"] if p["rare_level"]["enabled"] else None
        rest = [total - sum(group[x][0] for x in kept), positive - sum(group[x][1] for x in kept)]
        table = {x: group[x] for x in kept} | ({other: rest} if other is not None and rest[0] > 0 else {})
        levels = sorted(table)
        out = {"fill": fill, "kept": kept, "other": other, "levels": levels, "encoder": p["encoder"], "values": [], "default": 0.0, "drop_first": p["onehot"]["drop_first"]}
        if p["encoder"] == "onehot" and p["onehot"]["max_categories"]:
            out["levels"] = sorted(sorted(levels, key=lambda x: (-table[x][0], x))[: p["onehot"]["max_categories"]])
        elif p["encoder"] == "ordinal":
            out["values"], out["default"] = [float(i) for i in range(len(levels))], -1.0
        elif p["encoder"] == "woe":
            s, clip = p["woe"]["smoothing"], p["woe"]["clip"]
            if not 0 < positive < total:
                raise ValueError("weight of evidence needs both classes")
            share_of = lambda n, pos: math.log(((pos + s) / (positive + s * len(levels))) / ((n - pos + s) / (total - positive + s * len(levels))))
            out["values"] = [max(-clip, min(clip, share_of(*table[x]))) for x in levels]
        elif p["encoder"] == "target":
            prior = positive / total if total else 0.0
            m = 10.0 if p["target"]["smooth"] == "auto" else float(p["target"]["smooth"])
            out["values"], out["default"], out["smooth"], out["cv"] = [(pos + m * prior) / (n + m) for n, pos in (table[x] for x in levels)], prior, m, p["target"]["cv"]
        return out

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        """keep and the made columns."""
        return df.select(*keep, *[v.alias(k) for k, v in self._columns(dict(df.dtypes)).items()])

    def fit_transform(self, train: DataFrame, id_col: str, *keep: str) -> DataFrame:
        """transform() of the rows of the fit: target encodings come from the other folds, as new rows' do from all."""
        made = self._columns(dict(train.dtypes))
        target = [c for c, p in self.categorical.items() if p["encoder"] == "target"]
        if not target:
            return self.transform(train, *keep)
        df = train.withColumns({f"_level{i}": self._level(c) for i, c in enumerate(target)})
        for i, c in enumerate(target):
            p = self.categorical[c]
            df = df.withColumn("_fold", F.pmod(F.xxhash64(F.lit(i), id_col), F.lit(p["cv"])))
            df = encode.target_out_of_fold(df, f"_level{i}", "y", "_fold", p["smooth"]).withColumnRenamed("encoded", f"_made{i}").drop("_fold")
            made[f"cat__{c}"] = F.col(f"_made{i}")
        return df.select(*keep, *[v.alias(k) for k, v in made.items()])

    def report(self) -> list[dict]:
        """Per source, the columns made of it."""
        per: dict[str, list[str]] = {}
        for k, v in self.source.items():
            per.setdefault(v, []).append(k)
        return [{"source": c, "n_columns": len(x), "columns": x} for c, x in per.items()]
