"""Runs end to end on a planted panel; configuration, store, selection statistics, guard policies."""

import json
import math
import os

import numpy as np
import pytest

from scorelane import api, cli, research
from scorelane.config import Config
from scorelane.operators import encode, guard, metrics, profile, roles, selection, splits, store
from scorelane.operators.features import Features


@pytest.fixture(scope="module")
def disputes(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(900):
        x, z, c = float(rng.normal()), float(rng.gamma(2)), str(rng.choice(["web", "shop", "phone"], p=[0.5, 0.3, 0.2]))
        p = 1 / (1 + math.exp(-(1.8 * x + (1.2 if c == "phone" else -0.6) - 1)))
        rows.append((i, "FRAUD" if rng.random() < p else "GENUINE", None if i % 31 == 0 else x, f"${z * 1000:,.2f}", c, float(rng.normal()), f"ref{i}", "same", i % 60, f"2024-0{1 + i // 300}-{1 + i % 28:02}"))
    return spark.createDataFrame(rows, "id long, label string, ratio double, amount string, channel string, noise double, ref string, constant string, customer long, booked string").cache()


def settings(folder, **more):
    tree = {
        "run": {"name": "t", "output_dir": str(folder), "save_predictions": "all"}, "data": {"target": "label", "positive_label": "FRAUD", "id_column": "id"}, "columns": {"drop": ["booked", "customer"]},
        "split": {"holdout_size": 0.25, "cv": {"n_splits": 3}}, "selection": {"k_max": 3}, "metrics": {"slice_columns": ["channel"], "min_slice_n": 20},
        "preprocessing": {"categorical": {"encoder": "woe"}, "inference_guard": {"numeric_tolerance": 0.1}},
        "models": {"lin": {"estimator": "sklearn.linear_model.LogisticRegression", "params": {"C": 1.0}, "requires_scaling": True, "imbalance": "balanced"}, "none": {"estimator": "other.Thing"}},
    }
    return Config(tree).with_overrides(more)


@pytest.fixture(scope="module")
def run(spark, disputes, tmp_path_factory):
    return api.train(spark, settings(tmp_path_factory.mktemp("run")), disputes)


def test_a_run_finds_the_signal_and_writes_its_files(spark, run):
    assert run.report.get("candidates")["dropped"] == {"ref": "identifier_like_cardinality", "constant": "constant"}
    assert "amount" in run.report.get("candidates")["numeric"] and "none" in run.report.get("zoo")["skipped"]
    assert run.variables[0] == "ratio" and run.holdout["roc_auc"] > 0.75
    files = os.listdir(run.folder)
    for name in ("leaderboard.csv", "marginal_gains.csv", "best_per_model.csv", "holdout_deciles.csv", "holdout_slices.csv", "run_report.json", "selected_spec.json", "final_spec.yaml", "bundle"):
        assert name in files
    again = Config.load(f"{run.folder}/final_spec.yaml")
    assert again["selection.k_max"] == run.chosen["k"] and not again["columns.auto_infer"]
    log = store.load_predictions(spark, run.folder)
    cv = log.filter(f"stage = 'cv' and k = {run.chosen['k']}").selectExpr("fold", "y_true as y", "y_score as s")
    mean = np.mean([r["average_precision"] for r in metrics.rank_metrics(cv, "fold").collect()])
    assert mean == pytest.approx(run.chosen["mean"], abs=1e-6)
    assert store.load_folds(spark, run.folder).count() == run.train.count()
    assert "split(" in run.report.line() and run.report.frame(spark).count() == len(run.report.steps)


def test_a_bundle_scores_drifted_batches(spark, run, disputes):
    from pyspark.sql import functions as F

    i = F.col("id")
    batch = disputes.drop("label").withColumns({"channel": F.when(i % 40 == 0, "crypto").otherwise(F.col("channel")), "ratio": F.when(i % 30 == 1, 90.0).otherwise(F.col("ratio"))})
    frame, report = api.score(spark, f"{run.folder}/bundle", batch)
    assert frame.columns == ["id", "fraud_probability", "score_rank", *guard.FLAGS, "data_quality", "decision", "action"] and frame.count() == 900
    assert frame.filter("data_quality = 'guarded' and action != 'manual_review'").count() == 0
    assert sorted(r[0] for r in frame.select("score_rank").collect()) == list(range(1, 901))
    assert report["guard"]["safe"] and report["drift"]["band"] in ("stable", "watch") and report["summary"]["n_flagged"] > 0
    missing, report = api.score(spark, f"{run.folder}/bundle", batch.drop("ratio"))
    assert not report["guard"]["safe"] and missing.filter("action != 'manual_review'").count() == 0
    with pytest.raises(ValueError, match="none of the expected"):
        api.score(spark, f"{run.folder}/bundle", batch.select("id"))
    one = research.Scorer(spark, f"{run.folder}/bundle", threshold=0.5).score_one({"ratio": 3.0, "amount": "$10", "channel": "phone", "noise": 0.0})
    assert one["decision"] == "flag_fraud"
    same = {r["id"]: r["fraud_probability"] for r in api.score(spark, f"{run.folder}/bundle", batch.repartition(7))[0].collect()}
    assert all(same[r["id"]] == pytest.approx(r["fraud_probability"]) for r in frame.collect())


def test_command_line(spark, run, disputes, tmp_path, capsys):
    disputes.drop("label").write.parquet(f"{tmp_path}/batch.parquet")
    assert cli.main(["score", "--bundle", f"{run.folder}/bundle", "--data", f"{tmp_path}/batch.parquet", "--out", f"{tmp_path}/scores.csv"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["guard"]["safe"]
    assert spark.read.option("header", "true").csv(f"{tmp_path}/scores.csv").columns[0] == "id"
    disputes.write.parquet(f"{tmp_path}/train.parquet")
    cfg = settings(tmp_path).with_overrides({"data.path": f"{tmp_path}/train.parquet", "data.format": "parquet", "selection.k_max": 1, "columns.drop": ["booked", "customer", "noise", "amount"], "columns.numeric": ["ratio"], "columns.auto_infer": False, "run.save_predictions": "none"})
    store.write_yaml(cfg.tree, f"{tmp_path}/c.yaml")
    assert cli.main(["--config", f"{tmp_path}/c.yaml", "--set", "run.name=two"], spark) == 0
    with pytest.raises(FileNotFoundError):
        store.load_predictions(spark, f"{tmp_path}/two")


def test_a_sweep_says_what_compares(spark, monkeypatch):
    class Stub:
        def __init__(self, spark, cfg, frame):
            self.better, self.primary, self.chosen, self.holdout = True, ("average_precision",), {"model": "lin", "k": cfg["selection.k_min"], "mean": cfg["selection.k_min"] / 10}, {"average_precision": 0.5}

        def all(self):
            return self

    monkeypatch.setattr(research, "Run", Stub)
    base = Config()
    got = research.sweep(spark, {"a": base, "b": base.with_overrides({"selection.k_min": 3}), "c": base.with_overrides({"run.random_state": 7})}).collect()
    assert [(r["name"], r["comparable"]) for r in got] == [("b", True), ("a", True), ("c", False)]


def test_configuration_is_strict():
    for bad in ({"rnu": {}}, {"run": {"nmae": "x"}}, {"data": 3}, {"split": {"strategy": "group"}}, {"split": {"strategy": "sideways"}}, {"models": {"a": {"estimater": "x"}}}, {"selection": {"k_min": 3, "k_max": 2}}):
        with pytest.raises(ValueError):
            Config(bad)
    cfg = Config({"models": {"a": {"estimator": "LogisticRegression"}}})
    assert Config(cfg.tree).tree == cfg.tree and cfg.for_model("a")["preprocessing.numeric.scaler"] == "none"
    with pytest.raises(ValueError, match="unknown"):
        cfg.with_overrides({"run.nothing": 1})


def test_paired_tests():
    assert selection.t_two_sided(2.776445, 4) == pytest.approx(0.05, abs=1e-6) and selection.t_two_sided(0.0, 3) == pytest.approx(1)
    assert selection.t_two_sided(12.7062, 1) == pytest.approx(0.05, abs=1e-5)
    assert selection.wilcoxon([1, 2, 3, 4, 5, 6]) == pytest.approx(2 / 64) and selection.wilcoxon([1, -1]) == 1
    assert selection.verdict([0.1, 0.11, 0.09, 0.1, 0.1], 5)[1] == "improves"
    assert selection.verdict([-0.1, -0.11, -0.09, -0.1, -0.1], 5)[1] == "degrades"
    assert [selection.verdict(x, 5)[1] for x in ([], [None], [0.1], [0.0, 0.0], [0.1, -0.1, 0.05])] == ["all_folds_failed", "all_folds_failed", "insufficient_folds", "no_change", "not_significant"]
    assert selection.verdict([0.1, 0.2, 0.3], 3, "wilcoxon")[1] == "underpowered"


def test_metric_columns():
    got = metrics.columns_of(["recall_at_fpr", "lift_at_top_pct@0.2", "roc_auc"], {"recall_at_fpr": [0.01, 0.05]}, "average_precision")
    assert [c for c, _, _ in got] == ["average_precision", "recall_at_fpr@0.01", "recall_at_fpr@0.05", "lift_at_top_pct@0.2", "roc_auc"]
    assert metrics.oriented("brier", 0.2) == -0.2 and metrics.greater_is_better("recall_at_fpr@0.01")
    for bad in (lambda: metrics.columns_of(["gini"]), lambda: metrics.columns_of([], {"recall_at_fpr": [0.1, 0.2]}, "recall_at_fpr")):
        with pytest.raises(ValueError):
            bad()


def test_degenerate_slices_are_null_not_zero(spark):
    rows = spark.createDataFrame([("a", 0, 0.1)] * 30 + [("b", i % 2, i / 30) for i in range(30)] + [(None, 1, 0.5)] * 30 + [("c", 1, 0.2)], "g string, y int, s double")
    got = {r["level"]: r for r in profile.slice_report(rows, ["g"], 0.5, 20).collect()}
    assert set(got) == {"a", "b", "nan"} and got["a"]["roc_auc"] is None and got["nan"]["average_precision"] is None and got["b"]["roc_auc"] > 0.5
    assert metrics.at_fpr(rows.filter("g = 'a'"), 0.05).first()["recall_at_fpr"] is None
    same = rows.select("s").withColumnRenamed("s", "x")
    assert metrics.psi(same.limit(0), same.limit(0)).first()["band"] == "unknown"


def test_guard_policies(spark):
    train = spark.createDataFrame([(float(i), f"l{i % 3}") for i in range(11)], "x double, c string")
    batch = spark.createDataFrame([("5", "l1"), ("12", "new"), ("N/A", None), ("10.5", "l0")], "x string, c string")
    got = [tuple(r)[:-1] for r in guard.Guard.fit(train, ["x"], ["c"], tolerance=0.1).applied(batch).select("x", "c", *guard.FLAGS, "_issues").collect()]
    assert sorted(got, key=repr) == sorted([(5.0, "l1", 0, 0, 0, 0), (11.0, "__UNSEEN__", 1, 1, 0, 0), (None, None, 0, 0, 1, 0), (10.5, "l0", 0, 0, 0, 0)], key=repr)
    strict = guard.Guard.fit(train, ["x"], ["c"], numeric_policy="error")
    with pytest.raises(ValueError, match="rows have"):
        strict.applied(batch)
    with pytest.raises(ValueError, match="missing"):
        guard.Guard.fit(train, ["x"], ["c"], missing_policy="error").applied(batch.drop("x"))
    with pytest.raises(ValueError, match="too few"):
        guard.decision_cut(batch.selectExpr("0.5D as fraud_probability"))
    assert guard.decision_cut(batch, top_pct=None) == 0.5


def test_typing_and_targets(spark):
    rows = spark.createDataFrame([(i, "$1,234.50", f"3/{1 + i % 28}/2024", i % 3 + 1, None, "same", f"r{i}", i % 2 == 0) for i in range(200)], "id int, amount string, day string, tier int, nothing string, constant string, ref string, flag boolean")
    got = {r["variable"]: (r["role"], r["kind"]) for r in roles.infer_roles(rows, rows.columns[1:]).collect()}
    assert got == {"amount": ("constant", None), "day": ("numeric", "datetime"), "tier": ("categorical", None), "nothing": ("all_missing", None), "constant": ("constant", None), "ref": ("identifier_like_cardinality", None), "flag": ("numeric", "numeric")}
    days = roles.frame_to_numeric(rows, {"day": "datetime"})
    assert days.agg({"day": "min"}).first()[0] == 19783.0 and roles.frame_to_numeric(days, {"day": "datetime"}).agg({"day": "min"}).first()[0] == 19783.0
    for bad in ("constant", "tier"):
        with pytest.raises(ValueError, match="two classes"):
            roles.binarized(rows, bad)
    with pytest.raises(ValueError, match="observed"):
        roles.binarized(rows.selectExpr("if(id < 9, 'a', 'b') as t"), "t", "c")
    assert roles.binarized(rows.selectExpr("if(id < 9, 'a', 'b') as t"), "t")[1] == "a"
    with pytest.raises(ValueError, match="missing"):
        roles.selected(rows, ["amount", "none"])
    assert roles.selected(rows, ["none", "id"], missing="skip").columns == ["id"]
    with pytest.raises(ValueError):
        roles.check_positives(5, 3)


def test_target_encoding_does_not_leak(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, int(rng.random() < 0.5), f"m{rng.integers(0, 200)}") for i in range(1200)], "id long, y int, m string")
    cfg = Config({"preprocessing": {"categorical": {"encoder": "target", "rare_level": {"enabled": False}}}})
    f = Features.fit(rows, {}, ["m"], cfg)
    fold, full = f.fit_transform(rows, "id", "y").toPandas(), f.transform(rows, "y").toPandas()
    assert abs(fold["y"].corr(fold["cat__m"])) < 0.12 < full["y"].corr(full["cat__m"])
    assert f.transform(spark.createDataFrame([(1, 0, "never")], "id long, y int, m string")).first()[0] == pytest.approx(rows.agg({"y": "avg"}).first()[0])
    assert encode.one_hot(rows, "m", most=3, drop_first=True) == sorted(encode.one_hot(rows, "m", most=3))[1:]


def test_group_folds_keep_groups_and_balance(spark):
    rows = spark.createDataFrame([(i, i % 40, int(i % 7 == 0)) for i in range(800)], "id long, g long, y int")
    per = rows.join(splits.group_folds(rows, "g"), "g").groupBy("fold").agg({"y": "sum", "id": "count"}).collect()
    assert len(per) == 5 and max(r["count(id)"] for r in per) - min(r["count(id)"] for r in per) <= 20
    assert max(r["sum(y)"] for r in per) - min(r["sum(y)"] for r in per) <= 6
