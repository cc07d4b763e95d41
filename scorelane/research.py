"""Training runs: split, grid of models and variables inside folds, selection, confirmation, a bundle to score with."""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.config import Config
from scorelane.operators import guard, metrics, models, profile, roles, selection, splits, store
from scorelane.operators.features import Features
from scorelane.operators.ranks import hash_ranked
from scorelane.sources import read_table

LOADERS = {"logistic": LogisticRegressionModel, "forest": RandomForestClassificationModel, "gbt": GBTClassificationModel}
_AT_ONCE = 4


@dataclass
class Fitted:
    """Features and a model over them for one choice of variables."""

    features: Features
    model: object
    columns: list[str]

    def scored(self, df: DataFrame, *keep: str) -> DataFrame:
        return models.scored(self.model, self.features.transform(df, *keep, "y"), self.columns, *keep)


class Run:
    """One run over a table; every stage leaves its facts in report."""

    def __init__(self, spark: SparkSession, cfg: Config, frame: DataFrame | None = None) -> None:
        self.spark, self.cfg, self.report, self.began = spark, cfg, store.StepReport(), time.time()
        self.primary = metrics.columns_of([], primary=cfg["metrics.primary"])[0]
        self.better = metrics.greater_is_better(self.primary[0])
        self.id = cfg["data.id_column"] or "row_id"
        self.folder = f"{cfg['run.output_dir']}/{cfg['run.name']}"
        self.load(frame)

    # --- data ---

    def load(self, frame: DataFrame | None) -> None:
        cfg = self.cfg
        df = frame if frame is not None else read_table(self.spark, cfg["data.path"], **cfg["data.read_kwargs"])
        roles.reject_duplicates(df)
        if cfg["data.target"] not in df.columns:
            raise ValueError(f"the target {cfg['data.target']!r} is not among {df.columns}")
        if self.id not in df.columns:
            raise ValueError(f"data.id_column must name a column that tells rows apart, {self.id!r} is not among {df.columns}")
        df, label = roles.binarized(df, cfg["data.target"], cfg["data.positive_label"])
        if cfg["data.sample_frac"]:
            df = roles.sample_exact(df, cfg["data.sample_frac"], self.id)
        self.keys = [c for c in (cfg["split.group_column"], cfg["split.time_column"]) if c]
        parts = splits.holdout(df.drop(*cfg["columns.drop"]), self.id, cfg["split.strategy"], share=cfg["split.holdout_size"], group=cfg["split.group_column"], time=cfg["split.time_column"])
        folds = self.folds(parts.filter("part = 'train'"), cfg["split.cv.n_splits"], cfg["split.cv.n_repeats"])
        self.fold_map = folds.cache()
        self.data = parts.join(folds.filter("repeat = 0").select(F.col(self.id).alias("_id"), "fold"), F.col(self.id) == F.col("_id"), "left").drop("_id").cache()
        self.train, self.held = self.data.filter("part = 'train'"), self.data.filter("part = 'holdout'")
        n_pos = self.train.agg(F.sum("y")).first()[0] or 0
        thin = roles.check_positives(n_pos, cfg["split.cv.n_splits"])
        facts = [r.asDict() for r in splits.split_report(self.data).orderBy("part").collect()]
        self.report.add("load", target=cfg["data.target"], positive=str(label), fingerprint=profile.fingerprint(self.data.drop("part", "fold")).first()["data_hash"])
        self.report.add("split", strategy=cfg["split.strategy"], parts=facts, thin_positive_folds=thin)

    def folds(self, train: DataFrame, n: int, repeats: int = 1, salt: str = "") -> DataFrame:
        """id, fold, repeat by the strategy of the split."""
        strategy, group, at = (self.cfg[f"split.{k}"] for k in ("strategy", "group_column", "time_column"))
        if strategy == "time":
            return splits.time_folds(train, self.id, at, n).withColumn("repeat", F.lit(0))
        if group:
            per = splits.group_folds(train, group, "y", n).withColumnRenamed(group, "_g")
            return train.join(per, F.col(group).eqNullSafe(F.col("_g"))).select(self.id, "fold", F.lit(0).alias("repeat"))
        return splits.stratified_folds(train, self.id, "y", n, repeats)

    def candidates(self) -> None:
        c = self.cfg["columns"]
        taken = {self.id, "y", "part", "fold", *self.keys, *c["passthrough"]}
        declared = {x: "numeric" for x in c["numeric"]} | {x: "categorical" for x in c["categorical"]}
        columns = [x for x in self.data.columns if x not in taken and (c["auto_infer"] or x in declared)]
        found = roles.infer_roles(self.train, columns, declared=declared, threshold=c["numeric_parse_threshold"], max_codes=c["auto_infer_max_cardinality"], ratio=c["max_categorical_cardinality_ratio"], drop_constant=c["drop_constant"]).collect()
        self.numeric = {r["variable"]: r["kind"] for r in found if r["role"] == "numeric"}
        self.categorical = [r["variable"] for r in found if r["role"] == "categorical"]
        self.report.add("candidates", numeric=sorted(self.numeric), categorical=sorted(self.categorical), dropped={r["variable"]: r["role"] for r in found if r["role"] not in ("numeric", "categorical")})

    def zoo(self) -> None:
        """The enabled models that there is a family for: name -> (family, parameters, balanced)."""
        self.models, skipped = {}, {}
        for name, spec in self.cfg["models"].items():
            family = models.family_of(spec["estimator"])
            if not spec["enabled"] or family is None:
                skipped[name] = "disabled" if not spec["enabled"] else f"no family for {spec['estimator']!r}"
                continue
            self.models[name] = (family, models.arguments(family, spec["params"], self.cfg["run.random_state"]), spec["imbalance"] is not None or spec["params"].get("class_weight") == "balanced")
        if not self.models:
            raise ValueError(f"no model can be built: {skipped}")
        self.report.add("zoo", models=sorted(self.models), skipped=skipped)

    # --- fits ---

    def prepared(self, train: DataFrame, name: str) -> tuple[Features, DataFrame]:
        f = Features.fit(train, self.numeric, self.categorical, self.cfg.for_model(name), self.cfg["columns.passthrough"])
        return f, f.fit_transform(train, self.id, self.id, "y").cache()

    def order(self, f: Features, made: DataFrame, name: str) -> list[str]:
        """Sources, the most important first."""
        family, params, balanced = self.models[name]
        columns, s = list(f.source), self.cfg["selection"]
        columns = [c for c in columns if c not in f.dropped]
        if s["ordering_strategy"] == "rfe":
            ranks = {c: i for i, c in enumerate(models.eliminated(made, columns, family, s["rfe"]["step"]))}
            per: dict[str, list[float]] = {}
            for c, r in ranks.items():
                per.setdefault(f.source[c], []).append(r)
            how = min if s["rfe"]["aggregate"] == "min_rank" else lambda x: sum(x) / len(x)
            return sorted(per, key=lambda c: (how(per[c]), c))
        model = models.fit(made, columns, family, params, balanced=balanced)
        if s["importance"]["method"] == "permutation":
            shares = models.permutation_importance(model, made, columns, self.id, hash_ranked, s["importance"]["permutation_repeats"])
        else:
            shares = models.importance(model, made, columns)
        total: dict[str, list[float]] = {}
        for c, v in shares.items():
            total.setdefault(f.source[c], []).append(v)
        how = {"sum": sum, "max": max, "mean": lambda x: sum(x) / len(x)}[s["importance"]["aggregate"]]
        return sorted(total, key=lambda c: (-how(total[c]), c))

    def fitted(self, f: Features, made: DataFrame, name: str, variables: list[str], params: Mapping | None = None) -> Fitted:
        family, own, balanced = self.models[name]
        columns = [c for c, source in f.source.items() if source in variables and c not in f.dropped]
        return Fitted(f, models.fit(made, columns, family, own | dict(params or {}), balanced=balanced), columns)

    def metric(self, scored: DataFrame) -> float | None:
        own = scored.select(self.id, "y", "s").cache()
        found = metrics.evaluated(own, [self.primary], self.id).first()[self.primary[0]]
        own.unpersist()
        return found

    def ks(self) -> list[int]:
        s, n = self.cfg["selection"], len(self.numeric) + len(self.categorical)
        return list(range(s["k_min"], min(s["k_max"] or n, n) + 1, s["k_step"]))

    def fold_rows(self, repeat: int, fold: int) -> tuple[DataFrame, DataFrame]:
        own = self.train.drop("fold").join(self.fold_map.filter(F.col("repeat") == repeat).select(F.col(self.id).alias("_id"), "fold"), F.col(self.id) == F.col("_id")).drop("_id")
        before = F.col("fold") < fold if self.cfg["split.strategy"] == "time" else F.col("fold") != fold
        return own.filter(before), own.filter(F.col("fold") == fold)

    def grid(self) -> None:
        """Fold scores of every model and k; variables are ordered anew in each fold."""
        log = store.PredictionLog(self.folder, self.cfg["run.save_predictions"])
        self.log = log

        def cell(repeat: int, fold: int, name: str) -> list[tuple]:
            rest, valid = (x.cache() for x in self.fold_rows(repeat, fold))
            at = repeat * self.cfg["split.cv.n_splits"] + fold
            try:
                f, made = self.prepared(rest, name)
                order = self.order(f, made, name)
            except Exception as e:  # noqa: BLE001  null cells say so
                return [(name, k, at, None, None, "", str(e)[:200]) for k in self.ks()]
            out = []
            for k in self.ks():
                try:
                    own = self.fitted(f, made, name, order[:k])
                    scored = own.scored(valid, self.id)
                    over = self.metric(own.scored(rest, self.id)) if self.cfg["metrics.compute_train_scores"] else None
                    log.add(scored.withColumnRenamed(self.id, "row_id"), "cv", name, k, fold, repeat)
                    out.append((name, k, at, self.metric(scored), over, ",".join(order[:k]), ""))
                except Exception as e:  # noqa: BLE001
                    out.append((name, k, at, None, None, ",".join(order[:k]), str(e)[:200]))
            for x in (made, rest, valid):
                x.unpersist()
            return out

        jobs = itertools.product(range(self.cfg["split.cv.n_repeats"] if self.cfg["split.strategy"] == "random" else 1), range(self.cfg["split.cv.n_splits"]), self.models)
        with ThreadPoolExecutor(_AT_ONCE) as pool:
            rows = [r for part in pool.map(lambda x: cell(*x), jobs) for r in part]
        self.cells = self.spark.createDataFrame(rows, "model string, k int, fold int, score double, train_score double, variables string, error string").cache()
        if not any(r[3] is not None for r in rows):
            raise ValueError(f"no cell could be scored: {rows[0][-1]}")
        n = self.cfg["split.cv.n_splits"]
        scores = self.cells.select("model", "k", "fold", "score")
        board = selection.with_train(selection.board(scores, n), self.cells.select("model", "k", "fold", F.col("train_score").alias("score")))
        self.board = selection.ranked_board(board, self.better).cache()
        steps = selection.deltas(scores, self.better)
        self.gains = selection.gains(steps, n).join(selection.tested(steps, n, self.cfg["selection.marginal_gain_test"]), ["model", "to_k"]).cache()
        orders = self.cells.filter("error = ''").groupBy("model", "fold").agg(F.max_by("variables", "k").alias("v")).select("model", "fold", F.posexplode(F.split("v", ",")).alias("r", "variable")).withColumn("r", F.col("r") + 1)
        self.stable = selection.stability(orders, max(self.ks()), 15)
        self.report.add("grid", n_cells=len(rows), n_failed=sum(r[3] is None for r in rows))

    # --- choice ---

    def select(self) -> None:
        s = self.cfg["selection"]
        self.best = selection.best_per_model(self.board, self.better)
        self.top = [r.asDict() for r in selection.top(self.board, s["top_n"], distinct=s["top_n_distinct_models"], better=self.better).collect()]
        self.chosen = selection.one_se(self.board, rule=s["one_se_rule"], better=self.better).first().asDict()
        best = self.top[0]
        sign = 1 if self.better else -1
        self.params: dict = {}
        self.report.add("select", model=self.chosen["model"], k=self.chosen["k"], mean=self.chosen["mean"], cost_of_parsimony=sign * (best["mean"] - self.chosen["mean"]))

    def tune(self) -> None:
        """Parameters of the chosen cell by inner folds, then scored again on the outer ones; the better row counts."""
        t = self.cfg["tuning"]
        space = t["param_spaces"].get(self.chosen["model"], {}) if t["enabled"] else {}
        if not space:
            return
        family = self.models[self.chosen["model"]][0]
        points = [dict(zip(space, v, strict=True)) for v in itertools.product(*space.values())]
        if t["strategy"] == "random" and len(points) > t["n_iter"]:
            points = random.Random(self.cfg["run.random_state"]).sample(points, t["n_iter"])
        inner = self.folds(self.train.drop("fold"), t["inner_splits"]).filter("repeat = 0").select(F.col(self.id).alias("_id"), F.col("fold").alias("inner")).cache()
        own = self.train.join(inner, F.col(self.id) == F.col("_id")).drop("_id")
        total: dict[int, list[float]] = {i: [] for i in range(len(points))}
        for fold in range(t["inner_splits"]):
            rest, valid = own.filter(F.col("inner") != fold).drop("inner"), own.filter(F.col("inner") == fold).drop("inner")
            f, made = self.prepared(rest, self.chosen["model"])
            variables = self.order(f, made, self.chosen["model"])[: self.chosen["k"]]
            for i, p in enumerate(points):
                total[i].append(self.metric(self.fitted(f, made, self.chosen["model"], variables, models.arguments(family, p)).scored(valid, self.id)) or 0.0)
            made.unpersist()
        sign = 1 if self.better else -1
        win = max(total, key=lambda i: (sign * sum(total[i]) / len(total[i]), -i))
        params = models.arguments(family, points[win])
        outer = []
        for fold in range(self.cfg["split.cv.n_splits"]):
            rest, valid = self.fold_rows(0, fold)
            f, made = self.prepared(rest, self.chosen["model"])
            outer.append(self.metric(self.fitted(f, made, self.chosen["model"], self.order(f, made, self.chosen["model"])[: self.chosen["k"]], params).scored(valid, self.id)))
            made.unpersist()
        outer = [x for x in outer if x is not None]
        mean = sum(outer) / len(outer) if outer else None
        better = mean is not None and sign * (mean - self.chosen["mean"]) > 0
        self.params = params if better else {}
        self.report.add("tune", tuned=f"{self.chosen['model']}__tuned", params=points[win], mean=mean, taken=better)

    def confirm(self) -> None:
        """The choice, fitted on the training rows, on the holdout; then the model that ships, fitted on all rows."""
        name, k, cfg = self.chosen["model"], self.chosen["k"], self.cfg
        f, made = self.prepared(self.train, name)
        self.variables = self.order(f, made, name)[:k]
        own = self.fitted(f, made, name, self.variables, self.params)
        slices = [c for c in cfg["metrics.slice_columns"] if c in self.held.columns]
        scored = own.scored(self.held, self.id, *slices).cache()
        self.log.add(scored.withColumnRenamed(self.id, "row_id"), "holdout", name, k)
        self.log.add_folds(self.fold_map.withColumnRenamed(self.id, "row_id"))
        self.log.close(model=name, k=k)
        wanted = metrics.columns_of(cfg["metrics.secondary"], {"recall_at_fpr": cfg["metrics.recall_at_fpr"], "lift_at_top_pct": cfg["metrics.lift_top_pct"]}, cfg["metrics.primary"])
        self.holdout = metrics.evaluated(scored, wanted, self.id).first().asDict()
        gap = self.chosen["mean"] - self.holdout[self.primary[0]] if self.holdout[self.primary[0]] is not None else None
        self.deciles = metrics.decile_table(scored, self.id)
        first = self.deciles.orderBy("band").first()
        top = cfg["metrics.lift_top_pct"]
        self.top_pct = float(top[0] if isinstance(top, list) else top)
        cut = scored.agg(F.percentile("s", 1 - self.top_pct)).first()[0]
        self.slices = profile.slice_report(scored, slices, cut, cfg["metrics.min_slice_n"]) if slices else None
        disparity = profile.flag_rate_disparity(self.slices).first()[0] if self.slices is not None else None
        budget = cfg["metrics.recall_at_fpr"]
        at = metrics.at_fpr(scored, float(budget[0] if isinstance(budget, list) else budget), digits=None).first()["threshold_at_fpr"]
        whole = self.data if cfg["run.refit_on_full_data"] else self.train
        f, made = self.prepared(whole, name)
        self.shipped = self.fitted(f, made, name, self.variables, self.params)
        held = self.shipped.scored(self.held, self.id).cache()
        self.thresholds = {"top_pct": held.agg(F.percentile("s", 1 - self.top_pct)).first()[0], "fpr": at}
        self.quantiles = [r["quantile"] for r in metrics.reference_quantiles(held.select(self.id, F.col("s").alias("x")), self.id).orderBy("level").collect()]
        g = cfg["preprocessing.inference_guard"]
        mine = {c: k for c, k in self.numeric.items() if c in self.variables}
        self.guard = guard.Guard.fit(whole, mine, [c for c in self.categorical if c in self.variables], tolerance=g["numeric_tolerance"], numeric_policy=g["numeric_policy"], unseen_policy=g["unseen_category_policy"], missing_policy=g["missing_column_policy"], max_rate=g["max_guarded_rate"])
        self.report.add("confirm", holdout=self.holdout, cv_minus_holdout=gap, within_one_se=None if gap is None else abs(gap) <= (self.chosen["se"] or 0.0), top_decile_lift=first["lift"], top_decile_capture=first["cumulative_capture"], flag_rate_disparity=disparity, thresholds=self.thresholds)

    def write(self) -> None:
        tables = {"leaderboard": self.board, "marginal_gains": self.gains, "best_per_model": self.best, "selection_stability": self.stable, "holdout_deciles": self.deciles, "holdout_slices": self.slices}
        spec = {"model": self.chosen["model"], "k": self.chosen["k"], "variables": self.variables, "params": self.params, "thresholds": self.thresholds}
        self.report.add("total", seconds=time.time() - self.began)
        store.write_reports(self.folder, tables, {"top_specs": self.top, "selected_spec": spec, "holdout_metrics": self.holdout, "feature_pipeline_report": self.shipped.features.report(), "run_report": self.report.steps})
        final = self.cfg.with_overrides({"columns.numeric": [c for c in self.numeric if c in self.variables], "columns.categorical": [c for c in self.categorical if c in self.variables], "columns.auto_infer": False, "selection.k_min": self.chosen["k"], "selection.k_max": self.chosen["k"], "tuning.enabled": False})
        tree = final.tree
        tree["models"] = {self.chosen["model"]: tree["models"][self.chosen["model"]]}
        tree["models"][self.chosen["model"]]["params"] |= self.params
        store.write_yaml(tree, f"{self.folder}/final_spec.yaml")
        if self.cfg["run.save_fitted_model"]:
            self.save(f"{self.folder}/bundle")

    def save(self, folder: str) -> None:
        self.shipped.model.write().overwrite().save(f"{folder}/model")
        self.guard.levels.write.mode("overwrite").parquet(f"{folder}/levels.parquet")
        state = {k: getattr(self.guard, k) for k in ("numeric", "categorical", "bounds", "tolerance", "numeric_policy", "unseen_policy", "missing_policy", "max_rate")}
        policy = self.cfg["metrics.decision_threshold_policy"]
        store.write_json({"version": store.VERSION, "family": self.models[self.chosen["model"]][0], "columns": self.shipped.columns, "features": self.shipped.features.as_dict(), "guard": state, "threshold": self.thresholds.get(policy), "policy": policy, "top_pct": self.top_pct, "quantiles": self.quantiles, "id": self.id, "lineage": self.report.get("load"), "config": self.cfg.tree}, f"{folder}/bundle.json")

    def all(self) -> Run:
        for stage in (self.candidates, self.zoo, self.grid, self.select, self.tune, self.confirm, self.write):
            stage()
        return self

    @property
    def ok(self) -> bool:
        """Whether the holdout lies within one error of the folds."""
        return bool(self.report.get("confirm")["within_one_se"])


class Scorer:
    """A saved bundle; the bundle's threshold counts unless another is given."""

    def __init__(self, spark: SparkSession, folder: str, threshold: float | None = None, top_pct: float | None = None) -> None:
        b = store.read_json(f"{folder}/bundle.json")
        self.warning = None if b["version"] == store.VERSION else f"the bundle is of version {b['version']}, this is {store.VERSION}"
        self.spark, self.bundle = spark, b
        self.features = Features(**b["features"])
        #: A bundle scores with the columns of its variables alone.
        used = {self.features.source[c] for c in b["columns"]}
        self.features.numeric = {c: p for c, p in self.features.numeric.items() if c in used}
        self.features.categorical = {c: p for c, p in self.features.categorical.items() if c in used}
        self.model = LOADERS[b["family"]].load(f"{folder}/model")
        g = dict(b["guard"])
        g["bounds"] = {c: tuple(x) for c, x in g["bounds"].items()}
        self.guard = guard.Guard(**g, levels=spark.read.parquet(f"{folder}/levels.parquet"))
        self.threshold = threshold if threshold is not None else None if top_pct else b["threshold"]
        self.top_pct = top_pct or b["top_pct"]

    def rows(self, batch: DataFrame) -> DataFrame:
        """id, fraud_probability, flags."""
        guarded = self.guard.applied(batch)
        made = self.features.transform(guarded.withColumn("y", F.lit(0)), self.bundle["id"], *guard.FLAGS, "_issues", "y")
        return models.scored(self.model, made, self.bundle["columns"], self.bundle["id"], *guard.FLAGS, "_issues").drop("y").withColumnRenamed("s", "fraud_probability")

    def score(self, batch: DataFrame) -> tuple[DataFrame, dict]:
        """The score frame and a report: verdict of the guard, summary, drift of the scores, schema."""
        rows = self.rows(batch)
        verdict = self.guard.report(rows).first().asDict()
        cut = guard.decision_cut(rows, self.threshold, self.top_pct)
        frame = guard.score_frame(rows, self.bundle["id"], cut, verdict["safe"])
        stored = self.spark.createDataFrame([(self.bundle["quantiles"],)], "q array<double>")
        psi = metrics.psi_from_quantiles(stored, rows.select(F.col("fraud_probability").alias("x"))).withColumn("band", metrics.psi_band(F.col("psi"))).first().asDict()
        return frame, {"guard": verdict, "summary": guard.score_summary(frame, cut).first().asDict(), "drift": psi, "schema": self.guard.schema(batch.columns), "warning": self.warning}

    def score_one(self, record: Mapping) -> dict:
        """The row of one record; needs an absolute threshold."""
        if self.threshold is None:
            raise ValueError("one record has no top share: give a threshold")
        batch = self.spark.createDataFrame([{self.bundle["id"]: 0} | {k: v if isinstance(v, (int, float)) or v is None else str(v) for k, v in record.items()}])
        return self.score(batch)[0].first().asDict()


def sweep(spark: SparkSession, configs: Mapping[str, Config], frame: DataFrame | None = None) -> DataFrame:
    """name, model, k, mean, holdout, comparable of a run per configuration, the best first.

    Runs compare only if they share seed, strategy, holdout, folds, repeats and path.
    """
    same = lambda c: tuple(c[k] for k in ("run.random_state", "split.strategy", "split.holdout_size", "split.cv.n_splits", "split.cv.n_repeats", "data.path"))
    first, rows, better = same(next(iter(configs.values()))), [], True
    for name, cfg in configs.items():
        run = Run(spark, cfg, frame).all()
        better = run.better
        rows.append((name, run.chosen["model"], run.chosen["k"], run.chosen["mean"], run.holdout[run.primary[0]], same(cfg) == first))
    out = spark.createDataFrame(rows, "name string, model string, k int, mean double, holdout double, comparable boolean")
    return out.orderBy(F.col("mean").desc() if better else F.col("mean"), "name")
