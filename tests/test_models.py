"""Fits, orderings and streamed scoring on small panels."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from scorelane.operators import models
from scorelane.operators.ranks import hash_ranked
from scorelane.streaming import decided, to_parquet


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(i, int((i * 7919 % 101) / 101 + (i * 31 % 17) / 40 > 0.7), i % 3, (i * 7919 % 101) / 101, (i * 104729 % 89) / 89) for i in range(600)]
    return spark.createDataFrame(rows, "id long, y int, fold int, signal double, noise double").cache()


@pytest.fixture
def observed(spark):
    """The session, after something in it was observed."""
    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 3}
    return spark


def test_classes_weigh_the_same(panel):
    sums = {r["y"]: r["sum(w)"] for r in models.class_weighted(panel).groupBy("y").sum("w").collect()}
    assert sums[0] == pytest.approx(300) and sums[1] == pytest.approx(300)


@pytest.mark.parametrize("family", ["logistic", "forest"])
def test_signal_outranks_noise(panel, family):
    shares = models.importance(models.fit(panel, ["noise", "signal"], family), panel, ["noise", "signal"])
    assert next(iter(shares)) == "signal" and sum(shares.values()) == pytest.approx(1)


@pytest.mark.parametrize("family", models.FAMILIES)
def test_fits_score_where_something_was_observed(observed, panel, family):
    model = models.fit(panel, ["signal", "noise"], family)
    rows = models.scored(model, panel, ["signal", "noise"], "id").collect()
    assert sorted(r["id"] for r in rows) == list(range(600)) and all(0 <= r["s"] <= 1 for r in rows)
    assert models.average_precision(model, panel, ["signal", "noise"]) > 0.9


def test_permuting_keeps_rows_and_values(panel):
    after = models.permuted(panel, "id", "signal", hash_ranked).toPandas().sort_values("id")
    before = panel.toPandas().sort_values("id")
    assert list(after.columns) == list(before.columns)
    assert sorted(after["signal"]) == sorted(before["signal"]) and list(after["noise"]) == list(before["noise"])
    assert abs(after["signal"].corr(before["signal"].set_axis(after.index))) < 0.2


@pytest.mark.parametrize("family", ["logistic", "forest"])
def test_permutation_and_tuning_where_something_was_observed(observed, panel, family):
    both = ["noise", "signal"]
    falls = models.permutation_importance(models.fit(panel, both, family), panel, both, "id", hash_ranked)
    assert next(iter(falls)) == "signal" and falls["signal"] > 0.2 > falls["noise"]
    assert all(mean is not None for _, mean in models.tuned(panel, both, family, [{}], 2))


def test_elimination_keeps_the_signal(panel):
    assert models.eliminated(panel, ["noise", "signal"]) == ["signal", "noise"]


def test_grid_scores_null_where_a_class_is_missing(panel):
    cells = models.nested_grid(panel.filter("y = 1 or fold = 0"), ["signal"], ("logistic",), 1, 1)
    assert cells == [("logistic", 1, 0, "", None)]
    with pytest.raises(ValueError):
        models.fit(panel.filter("y = 1"), ["signal"])


def test_stream_decides_as_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.2), (2, 0.9), (3, None)], "id long, s double")
    rows.write.parquet(f"{tmp_path}/in")
    stream = decided(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), 0.5)
    assert to_parquet(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted(tuple(r) for r in decided(rows, 0.5).collect())
    assert [r[2:] for r in got] == [("pass", "auto_action"), ("flag_fraud", "manual_review"), (None, "manual_review")]
