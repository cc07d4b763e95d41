"""Every registered query against its SQL twin, and literal cases."""

import duckdb
import pytest

import __spark_entry__ as entry
from scorelane.functions import lenient_number
from scorelane.operators import encode, metrics
from scorelane.plans.queries import ORACLES, QUERIES

WHERE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{WHERE}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sql, name):
    got, want = QUERIES[name](spark, WHERE).toPandas(), sql.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(map(str, f[columns].astype(object).where(f[columns].notna(), None).values.tolist())) for f in (got, want)]
    assert rows[0] == rows[1]


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(ORACLES) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())


def test_lenient_numbers(spark):
    rows = spark.createDataFrame([("$1,234.50",), ("1 234",), ("12.5%",), ("N/A",), ("5d",), ("inf",), (None,)], "x string")
    got = [r[0] for r in rows.select(lenient_number(rows["x"])).collect()]
    assert got == [1234.5, 1234.0, 12.5, None, None, None, None]


def test_single_class_is_null_not_zero(spark):
    rows = spark.createDataFrame([(0, 0.1), (0, 0.7)], "y int, s double")
    assert metrics.rank_metrics(rows).first().asDict() == {"average_precision": None, "roc_auc": None, "ks": None}
    assert metrics.pointwise(rows).first()["prevalence"] == 0


def test_five_rows_make_five_bands(spark):
    rows = spark.createDataFrame([(i, i % 2, i / 10) for i in range(5)], "i int, y int, s double")
    assert metrics.decile_table(rows, "i").count() == 5


def test_no_frequent_level_keeps_the_top_one(spark):
    rows = spark.createDataFrame([(x,) for x in "aabcd"], "c string")
    assert [r["level"] for r in encode.kept_levels(rows, "c", 0.9).collect()] == ["a"]


def test_psi_from_quantiles_of_ties_constants_and_nothing(spark):
    tied = spark.createDataFrame([([0.0] * 51 + [i / 50 for i in range(1, 51)],)], "q array<double>")
    same = spark.createDataFrame([(0.0,)] * 50 + [(i / 50 + 0.001,) for i in range(1, 51)], "x double")
    assert metrics.psi_from_quantiles(tied, same).first()["psi"] < 0.05
    constant = spark.createDataFrame([([1.0] * 101,)], "q array<double>")
    assert metrics.psi_from_quantiles(constant, same).first()["psi"] == 0
    assert metrics.psi_from_quantiles(tied, same.limit(0)).first()["psi"] is None
