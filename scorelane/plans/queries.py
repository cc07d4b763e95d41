"""One query per operator, over views of the test tables; ORACLES has the same in DuckDB's SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelane.functions import epoch_days, lenient_number, safe_ratio
from scorelane.operators import encode, guard, metrics, models, profile, roles, selection, splits, store
from scorelane.operators.ranks import hash_ranked
from scorelane.sources import read_table, scratch_dir, write_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c: Column) -> Column:
    return F.round(c, 6)


# --- views --------------------------------------------------------------------------

PREDS = "preds AS (SELECT event_id AS row_id, CAST(event_type IN ('purchase','error') AND value > 40 AS INT) AS y, round(value / (value + 50), 9) AS s, event_id % 5 AS fold, event_type AS slice FROM events)"
NULLS = "nulls AS (SELECT event_id AS id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 23 = 0 THEN NULL ELSE event_type END AS t, CAST(event_type IN ('purchase','error') AND value > 40 AS INT) AS y, event_id % 5 AS fold FROM events)"
ORD = "ord AS (SELECT o_orderkey AS id, o_totalprice AS price, o_orderpriority AS priority, o_orderdate AS d, o_custkey AS g, CAST(o_orderstatus = 'F' AS INT) AS y, o_orderdate < TIMESTAMP '1999-01-01' AS train FROM orders)"
CURVE = "g AS (SELECT s, sum(y) tp, sum(1 - y) fp FROM preds GROUP BY s), c AS (SELECT s, tp, fp, sum(tp) OVER w tps, sum(fp) OVER w fps, sum(tp) OVER () P, sum(fp) OVER () N FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def preds(spark: SparkSession, d: str) -> DataFrame:
    y = (F.col("event_type").isin("purchase", "error") & (F.col("value") > 40)).cast("int")
    return t(spark, d, "events").select(F.col("event_id").alias("row_id"), y.alias("y"), F.round(F.col("value") / (F.col("value") + 50), 9).alias("s"), (F.col("event_id") % 5).alias("fold"), F.col("event_type").alias("slice"))


def nulls(spark: SparkSession, d: str) -> DataFrame:
    y = (F.col("event_type").isin("purchase", "error") & (F.col("value") > 40)).cast("int")
    i = F.col("event_id")
    return t(spark, d, "events").select(i.alias("id"), F.when(i % 17 != 0, F.col("value")).alias("v"), F.when(i % 23 != 0, F.col("event_type")).alias("t"), y.alias("y"), (i % 5).alias("fold"))


def ord_(spark: SparkSession, d: str) -> DataFrame:
    when = F.col("o_orderdate").cast("timestamp")
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), when.alias("d"), F.col("o_custkey").alias("g"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), (when < "1999-01-01").alias("train"))


# --- metrics ------------------------------------------------------------------------

@query(f"WITH {PREDS}, {CURVE} SELECT round(sum(tp / P * tps / (tps + fps)), 6) AS average_precision FROM c")
def metric_average_precision(spark, d):
    return metrics.rank_metrics(preds(spark, d)).select("average_precision")


@query(f"WITH {PREDS}, {CURVE} SELECT round(sum((tps - tp / 2.0) * fp) / (max(P) * max(N)), 6) AS roc_auc FROM c")
def metric_roc_auc(spark, d):
    return metrics.rank_metrics(preds(spark, d)).select("roc_auc")


@query(f"WITH {PREDS}, {CURVE} SELECT round(greatest(0.0, max(tps / P - fps / N)), 6) AS ks FROM c")
def metric_ks(spark, d):
    return metrics.rank_metrics(preds(spark, d)).select("ks")


ROC = f"""WITH {PREDS}, {CURVE}, e AS (SELECT *, lag(tp) OVER o ltp, lead(tp) OVER o ntp, lead(fp) OVER o nfp FROM c WINDOW o AS (ORDER BY s DESC)),
k AS (SELECT fps / N AS f, tps / P AS t, s AS th FROM e WHERE ltp IS NULL OR ntp IS NULL OR tp <> ntp OR fp <> nfp UNION ALL SELECT 0.0, 0.0, max(s) FROM c),
lo AS (SELECT * FROM k WHERE f <= 0.05 ORDER BY f DESC, t DESC LIMIT 1), hi AS (SELECT f AS hf, t AS ht, th AS hth FROM k WHERE f > 0.05 ORDER BY f, t LIMIT 1)"""


@query(ROC + " SELECT round(t + (0.05 - f) / (hf - f) * (ht - t), 6) AS recall_at_fpr FROM lo, hi")
def metric_recall_at_fpr(spark, d):
    return metrics.at_fpr(preds(spark, d), 0.05).select("recall_at_fpr")


@query(ROC + " SELECT round(th + (0.05 - f) / (hf - f) * (hth - th), 6) AS threshold_at_fpr FROM lo, hi")
def threshold_at_fpr(spark, d):
    return metrics.at_fpr(preds(spark, d), 0.05).select("threshold_at_fpr")


@query(f"WITH {PREDS}, r AS (SELECT y, row_number() OVER (ORDER BY s DESC, row_id) AS r, greatest(ceil(0.05 * count(*) OVER ()), 1) AS k FROM preds) SELECT round(avg(y) FILTER (r <= k) / avg(y), 6) AS lift FROM r")
def metric_lift_at_top_pct(spark, d):
    return metrics.lift_at_top(preds(spark, d), 0.05, "row_id")


@query(f"WITH {PREDS}, e AS (SELECT list_sort(list_distinct(quantile_cont(s, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM preds), b AS (SELECT y, s, len(list_filter(e[2:len(e)-1], lambda x: x < s)) AS b FROM preds, e) SELECT round(sum(n * abs(ms - my)) / sum(n), 6) AS ece FROM (SELECT b, count(*) n, avg(s) ms, avg(y) my FROM b GROUP BY b)")
def metric_ece(spark, d):
    return metrics.calibration_error(preds(spark, d))


@query(f"WITH {PREDS} SELECT round(avg((s - y) * (s - y)), 6) AS brier FROM preds")
def metric_brier(spark, d):
    return metrics.pointwise(preds(spark, d)).select("brier")


@query(f"WITH {PREDS}, q AS (SELECT y, least(greatest(s, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS s FROM preds) SELECT round(-avg(y * ln(s) + (1 - y) * ln(1 - s)), 6) AS log_loss FROM q")
def metric_log_loss(spark, d):
    return metrics.pointwise(preds(spark, d)).select("log_loss")


@query(f"WITH {PREDS}, {CURVE} SELECT (SELECT round(sum(tp / P * tps / (tps + fps)), 6) FROM c) AS average_precision, (SELECT round(sum((tps - tp / 2.0) * fp) / (max(P) * max(N)), 6) FROM c) AS roc_auc, (SELECT round(greatest(0.0, max(tps / P - fps / N)), 6) FROM c) AS ks, round(avg((s - y) * (s - y)), 6) AS brier, round(avg(y), 6) AS prevalence, round(avg(s), 6) AS mean_predicted, round(avg(s) / avg(y), 6) AS calibration_ratio, round(avg(s) - avg(y), 6) AS calibration_error FROM preds")
def evaluate_predictions(spark, d):
    p = preds(spark, d)
    extra = p.agg(r6(safe_ratio(F.avg("s"), F.avg("y"))).alias("calibration_ratio"), r6(F.avg("s") - F.avg("y")).alias("calibration_error"))
    return metrics.rank_metrics(p).crossJoin(metrics.pointwise(p).drop("log_loss")).crossJoin(extra)


@query(f"""WITH {PREDS}, g AS (SELECT slice, s, sum(y) tp, sum(1 - y) fp FROM preds GROUP BY ALL), c AS (SELECT slice, s, tp, fp, sum(tp) OVER w tps, sum(fp) OVER w fps, sum(tp) OVER (PARTITION BY slice) P, sum(fp) OVER (PARTITION BY slice) N FROM g WINDOW w AS (PARTITION BY slice ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT slice, CASE WHEN max(P) > 0 AND max(N) > 0 THEN round(sum(tp / P * tps / (tps + fps)), 6) END AS average_precision, CASE WHEN max(P) > 0 AND max(N) > 0 THEN round(sum((tps - tp / 2.0) * fp) / (max(P) * max(N)), 6) END AS roc_auc FROM c GROUP BY slice)
SELECT slice, average_precision, roc_auc, round(avg((s - y) * (s - y)), 6) AS brier, round(avg(y), 6) AS prevalence FROM m JOIN preds USING (slice) GROUP BY ALL""")
def metrics_by_group(spark, d):
    p = preds(spark, d)
    return metrics.rank_metrics(p, "slice").drop("ks").join(metrics.pointwise(p, "slice").select("slice", "brier", "prevalence"), "slice")


@query(f"""WITH {PREDS}, b AS (SELECT *, ntile(10) OVER (ORDER BY s DESC, row_id) AS band FROM preds), g AS (SELECT band, count(*) n, min(s) score_min, max(s) score_max, sum(y) p FROM b GROUP BY band)
SELECT CAST(band AS INT) AS band, CAST(n AS BIGINT) AS n, round(score_min, 6) AS score_min, round(score_max, 6) AS score_max, CAST(p AS BIGINT) AS n_positive, round(p / n, 6) AS positive_rate, round((p / n) / (sum(p) OVER () / sum(n) OVER ()), 4) AS lift, round(sum(p) OVER (ORDER BY band ROWS UNBOUNDED PRECEDING) / sum(p) OVER (), 6) AS cumulative_capture FROM g""")
def decile_table(spark, d):
    return metrics.decile_table(preds(spark, d), "row_id")


PSI = """r AS (SELECT value AS x FROM events WHERE ts < TIMESTAMP '2024-01-16'), u AS (SELECT value AS x FROM events WHERE ts >= TIMESTAMP '2024-01-16'), e AS (SELECT list_sort(list_distinct(quantile_cont(x, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM r),
b AS (SELECT len(list_filter(e[2:len(e)-1], lambda z: z <= x)) AS b, sum(o) AS r, sum(1 - o) AS c FROM (SELECT x, 1 AS o FROM r UNION ALL SELECT x, 0 FROM u), e GROUP BY 1), q AS (SELECT greatest(r / sum(r) OVER (), 1e-6) AS p, greatest(c / sum(c) OVER (), 1e-6) AS q FROM b), v AS (SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM q)"""


@query(f"WITH {PSI} SELECT psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'watch' ELSE 'investigate' END AS band FROM v")
def psi(spark, d):
    x = t(spark, d, "events").select(F.col("value").alias("x"), F.col("ts").cast("timestamp").alias("ts"))
    return metrics.psi(x.filter("ts < '2024-01-16'"), x.filter("ts >= '2024-01-16'"))


@query("WITH o AS (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events) SELECT CAST(q AS INT) AS level, value AS quantile FROM range(0, 101) x(q) JOIN o ON r = greatest(1, ceil((q / 100e0) * n))")
def reference_quantiles(spark, d):
    return metrics.reference_quantiles(t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("x")), "id")


@query(f"WITH {PREDS}, th AS (SELECT unnest([0.2, 0.5, 0.7, 0.8]) AS threshold), g AS (SELECT threshold, count(*) FILTER (s >= threshold AND y = 1) tp, count(*) FILTER (s >= threshold AND y = 0) fp, count(*) FILTER (s < threshold AND y = 1) fn, count(*) FILTER (s < threshold AND y = 0) tn FROM preds, th GROUP BY 1) SELECT CAST(threshold AS DOUBLE) AS threshold, tp, fp, fn, tn, round((tp + fp) / (tp + fp + fn + tn), 6) AS flag_rate, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM g")
def operating_points(spark, d):
    return metrics.operating_points(preds(spark, d), spark.createDataFrame([(0.2,), (0.5,), (0.7,), (0.8,)], "threshold double"))


@query(f"WITH {PREDS} SELECT round(quantile_cont(s, 0.95), 6) AS cut, round(avg(CAST(s >= (SELECT quantile_cont(s, 0.95) FROM preds) AS INT)), 6) AS flag_rate FROM preds")
def decision_cut_top_pct(spark, d):
    p = preds(spark, d)
    return p.crossJoin(F.broadcast(p.agg(F.percentile("s", 0.95).alias("cut")))).agg(r6(F.max("cut")).alias("cut"), r6(F.avg((F.col("s") >= F.col("cut")).cast("int"))).alias("flag_rate"))


# --- learned projections --------------------------------------------------------------

@query(f"WITH {NULLS}, b AS (SELECT quantile_cont(v, 0.01) lo, quantile_cont(v, 0.99) hi FROM nulls) SELECT id, round(CASE WHEN v IS NOT NULL THEN least(hi, greatest(lo, v)) END, 6) AS v FROM nulls, b")
def winsorize(spark, d):
    return encode.winsorize(nulls(spark, d).select("id", "v"), "v", 0.01, 0.99).select("id", r6(F.col("v")).alias("v"))


def _filled(name: str, sql: str, fit: Callable[[], Column]) -> None:
    def run(spark, d):
        return encode.with_fit(nulls(spark, d).select("id", "v"), m=fit()).select("id", r6(F.coalesce("v", "m")).alias("v"))

    QUERIES[name] = run
    ORACLES[name] = f"WITH {NULLS} SELECT id, round(coalesce(v, (SELECT {sql} FROM nulls)), 6) AS v FROM nulls"


_filled("impute_median", "median(v)", lambda: F.percentile("v", 0.5))
_filled("impute_mean", "avg(v)", lambda: F.avg("v"))
_filled("impute_constant", "max(-1.0)", lambda: F.max(F.lit(-1.0)))


@query(f"WITH {NULLS} SELECT id, CAST(v IS NULL AS DOUBLE) AS missing FROM nulls")
def missing_indicator(spark, d):
    return nulls(spark, d).select("id", F.col("v").isNull().cast("double").alias("missing"))


def _scaled(name: str, centre: str, width: str, fit: Callable[[], tuple[Column, Column]]) -> None:
    def run(spark, d):
        a, b = fit()
        return encode.with_fit(nulls(spark, d).select("id", "v"), a=a, b=b).select("id", r6((F.col("v") - F.col("a")) / F.when(F.col("b") == 0, 1.0).otherwise(F.col("b"))).alias("v"))

    QUERIES[name] = run
    ORACLES[name] = f"WITH {NULLS}, f AS (SELECT {centre} AS a, {width} AS b FROM nulls) SELECT id, round((v - a) / CASE WHEN b = 0 THEN 1.0 ELSE b END, 6) AS v FROM nulls, f"


_scaled("scale_standard", "avg(v)", "stddev_pop(v)", lambda: (F.avg("v"), F.stddev_pop("v")))
_scaled("scale_robust", "median(v)", "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)", lambda: (F.percentile("v", 0.5), F.percentile("v", 0.75) - F.percentile("v", 0.25)))
_scaled("scale_minmax", "min(v)", "max(v) - min(v)", lambda: (F.min("v"), F.max("v") - F.min("v")))


@query("WITH v AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS variable, unnest([var_pop(l_quantity), var_pop(l_discount), var_pop(l_tax)]) AS v FROM lineitem) SELECT variable, round(v, 6) AS variance, v > 0.001 OR (v = max(v) OVER () AND max(v) OVER () <= 0.001) AS kept FROM v")
def variance_threshold(spark, d):
    return encode.kept_by_variance(t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], 0.001)


@query(f"WITH {NULLS}, b AS (SELECT quantile_cont(v, 0.01) lo, quantile_cont(v, 0.99) hi FROM nulls) SELECT 'v' AS variable, round(max(lo), 6) AS low, round(max(hi), 6) AS high, round(avg(CAST(v < lo OR v > hi AS INT)), 6) AS clipped_rate FROM nulls, b")
def winsorize_report(spark, d):
    return encode.winsorize_report(nulls(spark, d), ["v"], 0.01, 0.99)


@query(f"WITH {NULLS}, m AS (SELECT t AS mode FROM nulls WHERE t IS NOT NULL GROUP BY t ORDER BY count(*) DESC, t LIMIT 1) SELECT id, coalesce(t, mode) AS t FROM nulls, m")
def impute_mode(spark, d):
    n = nulls(spark, d).select("id", "t")
    return n.crossJoin(F.broadcast(encode.mode_of(n, "t"))).select("id", F.coalesce("t", "_mode").alias("t"))


BRANDS = "k AS (SELECT p_brand AS level, count(*) AS n FROM part GROUP BY 1), z AS (SELECT level, n, n / sum(n) OVER () AS share, max(n) OVER () AS top, sum(n) OVER () AS total FROM k), kept AS (SELECT * FROM z WHERE share >= 0.04 OR (top / total < 0.04 AND n = top))"


@query(f"WITH {BRANDS} SELECT p_partkey AS id, coalesce(level, '__RARE__') AS brand FROM part LEFT JOIN kept ON p_brand = level")
def rare_collapse(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand")
    kept = encode.kept_levels(p, "p_brand", 0.04).select("level", F.col("level").alias("brand"))
    return encode.looked_up(p, "p_brand", kept, "brand", F.lit("__RARE__")).select("id", "brand")


@query(f"WITH {BRANDS} SELECT level, CAST(n AS BIGINT) AS n, round(share, 6) AS share FROM kept")
def rare_report(spark, d):
    return encode.kept_levels(t(spark, d, "part"), "p_brand", 0.04)


@query("SELECT event_id AS id, " + ", ".join(f"CAST(event_type = '{x}' AS DOUBLE) AS t_{x}" for x in ("click", "error", "purchase", "signup", "view")) + " FROM events")
def encode_onehot(spark, d):
    e = t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("t"))
    return e.select("id", *encode.one_hot_columns("t", encode.one_hot(e, "t")))


@query(f"WITH {NULLS}, l AS (SELECT t, dense_rank() OVER (ORDER BY t) - 1 AS code FROM nulls WHERE t IS NOT NULL GROUP BY t) SELECT id, CAST(CASE WHEN nulls.t IS NULL THEN -2 ELSE coalesce(code, -1) END AS INT) AS code FROM nulls LEFT JOIN l USING (t)")
def encode_ordinal(spark, d):
    n = nulls(spark, d).select("id", "t")
    levels = n.filter("t is not null").select("t").distinct().select(F.col("t").alias("level"), (F.dense_rank().over(Window.orderBy("t")) - 1).alias("code"))
    return encode.looked_up(n, "t", levels, "code", F.when(F.col("t").isNull(), -2).otherwise(-1)).select("id", F.col("code").cast("int").alias("code"))


WOE = f"{NULLS}, k AS (SELECT t AS level, count(*) AS n, sum(y) AS pos FROM nulls GROUP BY 1), w AS (SELECT level, n, pos, (pos + 0.5e0) / (sum(pos) OVER () + 0.5e0 * count(*) OVER ()) AS p, (n - pos + 0.5e0) / (sum(n - pos) OVER () + 0.5e0 * count(*) OVER ()) AS q FROM k), woe AS (SELECT *, least(4.0e0, greatest(-4.0e0, ln(p / q))) AS woe FROM w)"


@query(f"WITH {WOE} SELECT level, CAST(n AS BIGINT) AS n, CAST(pos AS BIGINT) AS pos, round(woe, 6) AS woe FROM woe")
def woe_table(spark, d):
    return encode.woe_table(nulls(spark, d), "t", "y").select("level", "n", "pos", r6(F.col("woe")).alias("woe"))


@query(f"WITH {WOE} SELECT id, round(coalesce(woe, 0), 6) AS woe FROM nulls LEFT JOIN woe ON t IS NOT DISTINCT FROM level")
def encode_woe(spark, d):
    n = nulls(spark, d)
    return encode.looked_up(n, "t", encode.woe_table(n, "t", "y"), "woe", F.lit(0.0)).select("id", r6(F.col("woe")).alias("woe"))


@query(f"WITH {WOE}, i AS (SELECT round(sum((p - q) * woe), 6) AS iv FROM woe) SELECT iv, CASE WHEN iv < 0.02 THEN 'not_predictive' WHEN iv < 0.1 THEN 'weak' WHEN iv < 0.3 THEN 'medium' WHEN iv < 0.5 THEN 'strong' ELSE 'suspiciously_strong' END AS band FROM i")
def information_value(spark, d):
    return encode.information_value(encode.woe_table(nulls(spark, d), "t", "y"))


@query(f"WITH {NULLS}, k AS (SELECT t AS level, count(*) AS n, sum(y) AS pos FROM nulls GROUP BY 1), f AS (SELECT level, (pos + 10 * (SELECT avg(y) FROM nulls)) / (n + 10) AS e FROM k) SELECT id, round(e, 6) AS encoded FROM nulls JOIN f ON t IS NOT DISTINCT FROM level")
def encode_target(spark, d):
    n = nulls(spark, d)
    means = encode.target_means(n, "t", "y", 10.0)
    prior = n.agg(F.avg("y").alias("_prior"))
    return encode.looked_up(n.crossJoin(F.broadcast(prior)), "t", means, "encoded", F.col("_prior")).select("id", r6(F.col("encoded")).alias("encoded"))


@query(f"WITH {NULLS}, k AS (SELECT t, fold, count(*) n, sum(y) p FROM nulls GROUP BY ALL), z AS (SELECT *, sum(n) OVER (PARTITION BY t) ln, sum(p) OVER (PARTITION BY t) lp, sum(n) OVER (PARTITION BY fold) fn, sum(p) OVER (PARTITION BY fold) fp, sum(n) OVER () an, sum(p) OVER () ap FROM k) SELECT id, round((lp - p + 10 * (ap - fp) / (an - fn)) / (ln - n + 10), 6) AS encoded FROM nulls JOIN z ON nulls.t IS NOT DISTINCT FROM z.t AND nulls.fold = z.fold")
def encode_target_oof(spark, d):
    return encode.target_out_of_fold(nulls(spark, d), "t", "y", "fold", 10.0).select("id", r6(F.col("encoded")).alias("encoded"))


# --- typing, scans and projections ----------------------------------------------------

@query("SELECT CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem")
def scan_parquet(spark, d):
    return t(spark, d, "lineitem").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def project_select(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice")


@query("SELECT * EXCLUDE (c_name, c_nationkey) FROM customer")
def project_drop(spark, d):
    return t(spark, d, "customer").drop("c_name", "c_nationkey")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE round(l_extendedprice, 2) END AS price FROM lineitem")
def lenient_numeric(spark, d):
    text = F.when(F.col("l_linenumber") == 7, "N/A").otherwise(F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(lenient_number(text), 2).alias("price"))


@query("SELECT round(avg(CAST(l_linenumber <> 7 AS INT)), 6) AS price_rate, 0.0e0 AS flag_rate FROM lineitem")
def parse_kind_rates(spark, d):
    text = F.when(F.col("l_linenumber") == 7, "N/A").otherwise(F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)))
    rate = lambda c: r6(F.avg(lenient_number(c).isNotNull().cast("int")))
    return t(spark, d, "lineitem").agg(rate(text).alias("price_rate"), rate(F.col("l_returnflag")).alias("flag_rate"))


@query("SELECT o_orderkey, round(epoch_us(o_orderdate) / 86400000000.0, 6) AS days FROM orders")
def epoch_days_of_orders(spark, d):
    return t(spark, d, "orders").select("o_orderkey", r6(epoch_days(F.col("o_orderdate"))).alias("days"))


@query("SELECT (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*), 1 LIMIT 1) AS label, CAST(count(*) AS BIGINT) AS n_positive FROM orders WHERE o_orderstatus = (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*), 1 LIMIT 1)")
def binarize_target(spark, d):
    g = t(spark, d, "orders").groupBy("o_orderstatus").count()
    return g.agg(F.min_by("o_orderstatus", F.struct("count", "o_orderstatus")).alias("label"), F.min("count").alias("n_positive"))


#: The panel of the typing queries: formatted numbers, dates as text, codes, constants, identifiers, nothing.
TYPED = "typed AS (SELECT l_orderkey AS k, '$' || format('{:,.2f}', l_extendedprice) AS amount, CASE WHEN l_linenumber = 7 THEN 'N/A' ELSE CAST(l_quantity AS VARCHAR) END AS mixed, l_linenumber AS code, l_returnflag AS flag, 'same' AS constant, CAST(NULL AS VARCHAR) AS nothing, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_extendedprice AS ident, strftime(l_shipdate, '%Y-%m-%d') AS shipped, l_shipdate AS day FROM lineitem)"
COLUMNS = ["amount", "mixed", "code", "flag", "constant", "nothing", "shipped", "day"]


def typed(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem")
    amount = F.concat(F.lit("$"), F.format_number("l_extendedprice", 2))
    mixed = F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("string")).otherwise("N/A")
    return li.select(amount.alias("amount"), mixed.alias("mixed"), F.col("l_linenumber").alias("code"), F.col("l_returnflag").alias("flag"), F.lit("same").alias("constant"), F.lit(None).cast("string").alias("nothing"), F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd").alias("shipped"), F.col("l_shipdate").alias("day"))


_MIXED = "(SELECT avg(CAST(l_linenumber <> 7 AS INT)) FROM lineitem)"


@query(f"SELECT unnest(['amount', 'mixed', 'code', 'flag', 'constant', 'nothing', 'shipped', 'day']) AS variable, unnest(['numeric', CASE WHEN {_MIXED} >= 0.95 THEN 'numeric' END, 'numeric', NULL, NULL, 'numeric', 'datetime', 'datetime']) AS kind, unnest([1, round({_MIXED}, 6), 1, 0, 0, 1, 1, 1]::DOUBLE[]) AS rate")
def parse_kinds(spark, d):
    return roles.parse_kinds(typed(spark, d), COLUMNS).select("variable", "kind", r6(F.col("rate")).alias("rate"))


_ROLE = "CASE WHEN n_unique = 0 THEN 'all_missing' WHEN n_unique <= 1 THEN 'constant' WHEN numeric AND NOT (code AND n_unique <= 10) THEN 'numeric' WHEN NOT (code AND n_unique <= 10) AND n_unique / n > 0.5 THEN 'identifier_like_cardinality' ELSE 'categorical' END"
_FACTS = " UNION ALL ".join(f"SELECT '{v}' AS variable, count(*) AS n, count(DISTINCT {x}) AS n_unique, {k} AS numeric, {c} AS code, '{kind}' AS kind FROM lineitem" for v, x, k, c, kind in (("amount", "round(l_extendedprice, 2)", "true", "false", "numeric"), ("mixed", "CASE WHEN l_linenumber <> 7 THEN l_quantity ELSE -1 END", f"{_MIXED} >= 0.95", "false", "numeric"), ("code", "l_linenumber", "true", "bool_and(l_linenumber % 1 = 0)", "numeric"), ("flag", "l_returnflag", "false", "false", ""), ("constant", "'same'", "false", "false", ""), ("nothing", "CAST(NULL AS VARCHAR)", "true", "false", "numeric"), ("shipped", "CAST(l_shipdate AS DATE)", "true", "false", "datetime"), ("day", "l_shipdate", "true", "false", "datetime")))


@query(f"WITH f AS ({_FACTS}), r AS (SELECT variable, {_ROLE} AS role, kind, CAST(n_unique AS BIGINT) AS n_unique FROM f) SELECT variable, role, CASE WHEN role = 'numeric' THEN kind END AS kind, n_unique FROM r")
def infer_roles(spark, d):
    return roles.infer_roles(typed(spark, d), COLUMNS)


@query(f"SELECT 'amount' AS variable, 1.0e0 AS parse_rate, CAST(0 AS BIGINT) AS n_coerced, CAST(0 AS BIGINT) AS n_not_finite, false AS below_90 UNION ALL SELECT 'mixed', round({_MIXED}, 6), CAST((SELECT count(*) FROM lineitem WHERE l_linenumber = 7) AS BIGINT), 0, {_MIXED} < 0.9 UNION ALL SELECT 'shipped', 1.0e0, 0, 0, false")
def coercer_report(spark, d):
    return roles.coercer_report(typed(spark, d), {"amount": "numeric", "mixed": "numeric", "shipped": "datetime"})


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r <= greatest(round(n * 0.1e0), 1)")
def sample_exact(spark, d):
    return roles.sample_exact(t(spark, d, "orders").select("o_orderkey"), 0.1, "o_orderkey")


# --- guard and scoring ------------------------------------------------------------------

ENV = f"{ORD}, env AS (SELECT lo, hi, mid, lo - 0.1e0 * (hi - lo) AS glo, hi + 0.1e0 * (hi - lo) AS ghi FROM (SELECT min(price) lo, max(price) hi, median(price) mid FROM ord WHERE train))"
DRIFT = f"{ENV}, drift AS (SELECT id, y, CASE WHEN id % 30 = 2 THEN NULL WHEN id % 50 = 1 THEN price * 50 ELSE price END AS price, id % 30 = 2 AS coerced, CASE WHEN id % 25 = 3 THEN NULL WHEN id % 20 = 0 THEN '9-NEW' WHEN id % 40 = 5 THEN '8-NEW' ELSE priority END AS priority FROM ord WHERE NOT train)"
FLAGS = f"{DRIFT}, flags AS (SELECT id, y, price, priority, CAST(coalesce(price < glo OR price > ghi, false) AS INT) AS n_out_of_range, CAST(coalesce(priority NOT IN (SELECT priority FROM ord WHERE train), false) AS INT) AS n_unseen_category, CAST(coerced AS INT) AS n_coerced, 0 AS n_newly_missing, glo, ghi FROM drift, env)"


def drifted(o: DataFrame) -> DataFrame:
    """Later orders with prices as text, some of them none or fifty times as high, and new and null priorities."""
    i = F.col("id")
    price = F.when(i % 30 == 2, "N/A").when(i % 50 == 1, (F.col("price") * 50).cast("string")).otherwise(F.col("price").cast("string"))
    priority = F.when(i % 25 == 3, None).when(i % 20 == 0, "9-NEW").when(i % 40 == 5, "8-NEW").otherwise(F.col("priority"))
    return o.filter("not train").select("id", "y", price.alias("price"), priority.alias("priority"))


def fitted_guard(o: DataFrame, **policies: object) -> guard.Guard:
    return guard.Guard.fit(o.filter("train"), ["price"], ["priority"], tolerance=0.1, **policies)


def guarded(spark: SparkSession, d: str, **policies: object) -> DataFrame:
    o = ord_(spark, d)
    return fitted_guard(o, **policies).applied(drifted(o))


@query(f"WITH {ENV} SELECT 'price' AS variable, 'numeric' AS type, round(lo, 6) AS train_min, round(hi, 6) AS train_max, round(mid, 6) AS train_median, round(glo, 6) AS guard_min, round(ghi, 6) AS guard_max, CAST(0 AS BIGINT) AS n_levels FROM env UNION ALL SELECT 'priority', 'categorical', NULL, NULL, NULL, NULL, NULL, (SELECT count(DISTINCT priority) FROM ord WHERE train)")
def training_envelope(spark, d):
    e = fitted_guard(ord_(spark, d)).envelope(spark)
    return e.select("variable", "type", *[r6(F.col(c)).alias(c) for c in ("train_min", "train_max", "train_median", "guard_min", "guard_max")], "n_levels")


@query(f"WITH {FLAGS} SELECT id, round(CASE WHEN price IS NOT NULL THEN least(ghi, greatest(glo, price)) END, 6) AS price, n_out_of_range FROM flags")
def guard_numeric_clip(spark, d):
    return guarded(spark, d).select("id", r6(F.col("price")).alias("price"), "n_out_of_range")


@query(f"WITH {FLAGS} SELECT id, CASE WHEN n_out_of_range = 0 THEN round(price, 6) END AS price FROM flags")
def guard_numeric_nan(spark, d):
    return guarded(spark, d, numeric_policy="nan").select("id", r6(F.col("price")).alias("price"))


@query(f"WITH {FLAGS} SELECT id, CASE WHEN n_unseen_category = 1 THEN '__UNSEEN__' ELSE priority END AS priority, n_unseen_category FROM flags")
def guard_unseen(spark, d):
    return guarded(spark, d).select("id", "priority", "n_unseen_category")


@query(f"WITH {FLAGS} SELECT id, n_out_of_range, n_unseen_category, n_coerced, n_newly_missing FROM flags")
def guard_row_flags(spark, d):
    return guarded(spark, d).select("id", *guard.FLAGS)


@query(f"WITH {DRIFT} SELECT id, CAST(NULL AS DOUBLE) AS price, 0 AS n_out_of_range, 1 AS n_newly_missing, false AS safe FROM drift")
def guard_missing_column(spark, d):
    o = ord_(spark, d)
    g = fitted_guard(o)
    rows = g.applied(drifted(o).drop("price"))
    return rows.crossJoin(F.broadcast(g.report(rows).select("safe"))).select("id", "price", "n_out_of_range", "n_newly_missing", "safe")


@query(f"WITH {FLAGS} SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(n_out_of_range + n_unseen_category + n_coerced) AS BIGINT) AS guarded_cells, round(sum(n_out_of_range + n_unseen_category + n_coerced) / (count(*) * 2), 6) AS guarded_rate, CAST(0 AS BIGINT) AS n_missing_columns, sum(n_out_of_range + n_unseen_category + n_coerced) / (count(*) * 2) <= 0.05 AS safe, CASE WHEN sum(n_out_of_range + n_unseen_category + n_coerced) / (count(*) * 2) <= 0.05 THEN 'ok' ELSE 'too many guarded cells: review the whole batch' END AS escalation FROM flags")
def guard_batch_report(spark, d):
    o = ord_(spark, d)
    g = fitted_guard(o)
    return g.report(g.applied(drifted(o)))


@query(f"WITH {FLAGS}, x AS (SELECT 'price' AS variable, 'out_of_range' AS issue, sum(n_out_of_range) AS n, NULL AS novel FROM flags UNION ALL SELECT 'price', 'coerced', sum(n_coerced), NULL FROM flags UNION ALL SELECT 'priority', 'unseen_category', sum(n_unseen_category), (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT priority AS p FROM flags WHERE n_unseen_category = 1 ORDER BY p LIMIT 20)) FROM flags) SELECT variable, issue, CAST(n AS BIGINT) AS n, CAST(novel AS VARCHAR) AS novel FROM x WHERE n > 0")
def explain_guard(spark, d):
    o = ord_(spark, d)
    g = fitted_guard(o)
    return g.explained(g.applied(drifted(o)))


CARD = f"{FLAGS}, k AS (SELECT priority AS level, count(*) AS n, sum(y) AS pos FROM ord WHERE train GROUP BY 1), w AS (SELECT level, ln(((pos + 0.5e0) / (sum(pos) OVER () + 0.5e0 * count(*) OVER ())) / ((n - pos + 0.5e0) / (sum(n - pos) OVER () + 0.5e0 * count(*) OVER ()))) AS woe FROM k), pr AS (SELECT ln(avg(y) / (1 - avg(y))) AS prior FROM ord WHERE train), sc AS (SELECT flags.*, round(1 / (1 + exp(-(prior + coalesce(woe, 0)))), 9) AS s FROM flags LEFT JOIN w ON CASE WHEN n_unseen_category = 1 THEN '__UNSEEN__' ELSE priority END IS NOT DISTINCT FROM level, pr)"


def scorecard(spark: SparkSession, d: str) -> DataFrame:
    """id, y, flags and s: weight-of-evidence score of guarded later orders, learned from the earlier ones."""
    o = ord_(spark, d)
    train = o.filter("train")
    prior = train.agg(F.log(F.avg("y") / (1 - F.avg("y"))).alias("prior"))
    x = encode.looked_up(guarded(spark, d), "priority", encode.woe_table(train, "priority", "y"), "woe", F.lit(0.0)).crossJoin(F.broadcast(prior))
    return x.select("id", "y", *guard.FLAGS, F.round(1 / (1 + F.exp(-(F.col("prior") + F.col("woe")))), 9).alias("s"))


@query(f"""WITH {CARD}, b AS (SELECT *, ntile(10) OVER (ORDER BY s DESC, id) AS band FROM sc), g AS (SELECT band, count(*) n, min(s) score_min, max(s) score_max, sum(y) p FROM b GROUP BY band)
SELECT CAST(band AS INT) AS band, CAST(n AS BIGINT) AS n, round(score_min, 6) AS score_min, round(score_max, 6) AS score_max, CAST(p AS BIGINT) AS n_positive, round(p / n, 6) AS positive_rate, round((p / n) / (sum(p) OVER () / sum(n) OVER ()), 4) AS lift, round(sum(p) OVER (ORDER BY band ROWS UNBOUNDED PRECEDING) / sum(p) OVER (), 6) AS cumulative_capture FROM g""")
def flagship_scorecard(spark, d):
    return metrics.decile_table(scorecard(spark, d), "id")


FRAME = f"{CARD}, cut AS (SELECT quantile_cont(s, 0.95) AS cut FROM sc), verdict AS (SELECT sum(n_out_of_range + n_unseen_category + n_coerced) / (count(*) * 2) <= 0.05 AS safe FROM sc), frame AS (SELECT id, s AS fraud_probability, CAST(row_number() OVER (ORDER BY s DESC, id) AS INT) AS score_rank, n_out_of_range, n_unseen_category, n_coerced, n_newly_missing, CASE WHEN NOT safe OR n_out_of_range + n_unseen_category + n_coerced > 0 THEN 'guarded' ELSE 'ok' END AS data_quality, CASE WHEN s >= cut THEN 'flag_fraud' ELSE 'pass' END AS decision, CASE WHEN s >= cut OR NOT safe OR n_out_of_range + n_unseen_category + n_coerced > 0 THEN 'manual_review' ELSE 'auto_action' END AS action, cut FROM sc, cut, verdict)"


def framed(spark: SparkSession, d: str) -> tuple[DataFrame, float]:
    s = scorecard(spark, d).withColumnRenamed("s", "fraud_probability")
    g = fitted_guard(ord_(spark, d))
    cut = guard.decision_cut(s)
    return guard.score_frame(s, "id", cut, g.report(s).first()["safe"]), cut


@query(f"WITH {FRAME} SELECT * EXCLUDE (cut) FROM frame")
def score_batch(spark, d):
    return framed(spark, d)[0]


@query(f"WITH {FRAME} SELECT round(max(cut), 6) AS cut, CAST(count(*) FILTER (decision = 'flag_fraud') AS BIGINT) AS n_flagged, round(avg(CAST(decision = 'flag_fraud' AS INT)), 6) AS flag_rate, CAST(count(*) FILTER (action = 'manual_review') AS BIGINT) AS n_manual_review, round(avg(fraud_probability), 6) AS mean_score, round(quantile_cont(fraud_probability, 0.99), 6) AS p99 FROM frame")
def score_summary(spark, d):
    return guard.score_summary(*framed(spark, d))


# --- profiles ---------------------------------------------------------------------------

_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS variable, round(1 - count({c}) / count(*), 6) AS missing_rate, CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(quantile_cont({c}, 0.01), 6) AS p01, round(median({c}), 6) AS p50, round(quantile_cont({c}, 0.99), 6) AS p99, round(skewness({c}), 6) AS skew FROM nulls" for c in ("v", "id", "y"))


@query(f"WITH {NULLS} {_PROFILE}")
def profile_numeric(spark, d):
    return profile.numeric_profile(nulls(spark, d), ["v", "id", "y"])


@query(f"WITH {NULLS} SELECT t AS top, round(count(*) / (SELECT count(t) FROM nulls), 6) AS top_share FROM nulls WHERE t IS NOT NULL GROUP BY t ORDER BY count(*) DESC, t LIMIT 1")
def profile_categorical(spark, d):
    g = nulls(spark, d).filter("t is not null").groupBy("t").count()
    return g.agg(F.min_by("t", F.struct(-F.col("count"), F.col("t"))).alias("top"), r6(F.max("count") / F.sum("count")).alias("top_share"))


@query(f"WITH {NULLS} SELECT round((count(*) - count(v) + count(*) - count(t)) / (2 * count(*)), 6) AS missing_rate FROM nulls")
def profile_missing(spark, d):
    return nulls(spark, d).agg(r6((2 * F.count("*") - F.count("v") - F.count("t")) / (2 * F.count("*"))).alias("missing_rate"))


@query("SELECT round(1 - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem)) / count(*), 6) AS duplicate_row_rate FROM lineitem")
def duplicate_row_rate(spark, d):
    return profile.duplicate_rows(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query(f"WITH {PREDS} SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg, round(avg(y), 6) AS prevalence, round(sum(1 - y) / sum(y), 6) AS neg_pos_ratio FROM preds")
def target_profile(spark, d):
    return preds(spark, d).agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"), r6(F.avg("y")).alias("prevalence"), r6(safe_ratio(F.sum(1 - F.col("y")), F.sum("y"))).alias("neg_pos_ratio"))


SLICED = f"""{PREDS}, cut AS (SELECT quantile_cont(s, 0.95) AS cut FROM preds), long AS (SELECT y, s, 'slice' AS variable, CASE WHEN row_id % 23 = 0 THEN 'nan' ELSE slice END AS level FROM preds UNION ALL SELECT y, s, 'fold', CAST(fold AS VARCHAR) FROM preds),
lg AS (SELECT variable, level, s, sum(y) tp, sum(1 - y) fp FROM long GROUP BY ALL), lc AS (SELECT variable, level, s, tp, fp, sum(tp) OVER w tps, sum(fp) OVER w fps, sum(tp) OVER (PARTITION BY variable, level) P, sum(fp) OVER (PARTITION BY variable, level) N FROM lg WINDOW w AS (PARTITION BY variable, level ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
lm AS (SELECT variable, level, CASE WHEN max(P) > 0 AND max(N) > 0 THEN round(sum(tp / P * tps / (tps + fps)), 6) END AS average_precision, CASE WHEN max(P) > 0 AND max(N) > 0 THEN round(sum((tps - tp / 2.0) * fp) / (max(P) * max(N)), 6) END AS roc_auc FROM lc GROUP BY ALL),
sl AS (SELECT variable, level, CAST(count(*) AS BIGINT) AS n, round(avg(y), 6) AS prevalence, round(avg(s), 6) AS mean_score, round(avg(CAST(s >= cut AS INT)), 6) AS flag_rate FROM long, cut GROUP BY variable, level HAVING count(*) >= 20)"""


def slices(spark: SparkSession, d: str) -> DataFrame:
    p = preds(spark, d).withColumn("slice", F.when(F.col("row_id") % 23 != 0, F.col("slice")))
    return profile.slice_report(p, ["slice", "fold"], guard.decision_cut(p, None, 0.05, "s"), 20)


@query(f"WITH {SLICED} SELECT * FROM sl JOIN lm USING (variable, level)")
def slice_report(spark, d):
    return slices(spark, d)


@query(f"WITH {SLICED} SELECT round(max(r), 3) AS flag_rate_disparity FROM (SELECT max(flag_rate) / greatest(min(flag_rate), 1e-9) AS r FROM sl GROUP BY variable)")
def flag_rate_disparity(spark, d):
    return profile.flag_rate_disparity(slices(spark, d))


@query("SELECT median(n) AS median_rows FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def group_size_median(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").count().agg(F.percentile("count", 0.5).alias("median_rows"))


# --- splits -----------------------------------------------------------------------------

@query(f"WITH {ORD} SELECT id, CASE WHEN row_number() OVER (ORDER BY d, id) <= round_even(count(*) OVER () * 0.75e0, 0) THEN 'train' ELSE 'holdout' END AS part FROM ord")
def split_time(spark, d):
    return splits.holdout(ord_(spark, d), "id", "time", time="d").select("id", "part")


@query(f"WITH {ORD}, gr AS (SELECT g, min(d) AS m FROM ord GROUP BY g), k AS (SELECT g, row_number() OVER (ORDER BY m DESC, g DESC) <= greatest(1, round(count(*) OVER () * 0.25e0)) AS out FROM gr) SELECT id, CASE WHEN out THEN 'holdout' ELSE 'train' END AS part FROM ord JOIN k USING (g)")
def split_group_time(spark, d):
    return splits.holdout(ord_(spark, d), "id", "group_time", group="g", time="d").select("id", "part")


@query(f"WITH {PREDS} SELECT row_id, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(CAST(row_id AS VARCHAR)), row_id) - 1) % 5 AS INT) AS fold FROM preds")
def cv_stratified_folds(spark, d):
    return splits.stratified_folds(preds(spark, d), "row_id").select("row_id", "fold")


@query(f"WITH {ORD}, r AS (SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS r, count(*) OVER () AS n FROM ord), f AS (SELECT id, (r - (n - 5 * (n // 6))) // (n // 6) AS fold, r - (n - 5 * (n // 6)) AS k FROM r) SELECT id, CAST(CASE WHEN k < 0 THEN -1 ELSE fold END AS INT) AS fold FROM f")
def cv_time_folds(spark, d):
    return splits.time_folds(ord_(spark, d), "id", "d")


@query(f"WITH {PREDS} SELECT CAST(fold AS INT) AS fold, CAST(count(*) AS BIGINT) AS n, round(avg(y), 6) AS prevalence FROM preds GROUP BY fold")
def fold_prevalence(spark, d):
    return preds(spark, d).groupBy(F.col("fold").cast("int").alias("fold")).agg(F.count("*").alias("n"), r6(F.avg("y")).alias("prevalence"))


# --- selection --------------------------------------------------------------------------

#: Stored fold scores of three models and five sizes: mean errors over growing shares of the events.
GRID = f"{PREDS}, grid AS (SELECT m.m AS model, k.k AS k, CAST(fold AS BIGINT) AS fold, round(1 - avg(abs(s - y)), 9) AS score FROM preds, range(0, 3) m(m), range(1, 6) k(k) WHERE (row_id // 5 + m.m) % 6 < k.k GROUP BY ALL)"


def grid(spark: SparkSession, d: str) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("model"), F.lit(k).cast("long").alias("k")) for m in range(3) for k in range(1, 6)])).alias("c")
    rows = preds(spark, d).select("row_id", "fold", "y", "s", cells).filter((F.floor(F.col("row_id") / 5) + F.col("c.model")) % 6 < F.col("c.k"))
    return rows.groupBy("c.model", "c.k", F.col("fold").cast("long").alias("fold")).agg(F.round(1 - F.avg(F.abs(F.col("s") - F.col("y"))), 9).alias("score"))


BOARD = f"{GRID}, board AS (SELECT model, k, avg(score) AS mean, stddev_samp(score) AS sd, stddev_samp(score) * sqrt(1 / count(*) + 0.2e0 / 0.8e0) AS se FROM grid GROUP BY ALL)"


def board(spark: SparkSession, d: str) -> DataFrame:
    return selection.board(grid(spark, d))


@query(f"WITH {BOARD} SELECT model, k, round(mean, 6) AS mean, round(sd, 6) AS sd, round(se, 6) AS se FROM board")
def leaderboard(spark, d):
    return board(spark, d).select("model", "k", *[r6(F.col(c)).alias(c) for c in ("mean", "sd", "se")])


@query(f"WITH {BOARD} SELECT model, k, CAST(row_number() OVER (ORDER BY round(mean, 9) DESC, model, k) AS INT) AS rank FROM board")
def leaderboard_rank(spark, d):
    return selection.ranked_board(board(spark, d)).select("model", "k", "rank")


@query(f"WITH {BOARD}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(mean, 9) DESC, k) AS r FROM board) SELECT model, k, round(mean, 6) AS mean FROM r WHERE r = 1")
def best_per_model(spark, d):
    return selection.best_per_model(board(spark, d)).select("model", "k", r6(F.col("mean")).alias("mean"))


@query(f"WITH {BOARD}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(mean, 9) DESC, k) AS r FROM board) SELECT model, k FROM r WHERE r = 1 ORDER BY round(mean, 9) DESC, model LIMIT 2")
def top_n_distinct(spark, d):
    return selection.top(board(spark, d), 2, distinct=True).select("model", "k")


@query(f"WITH {BOARD}, b AS (SELECT round(mean, 9) AS top, round(mean, 9) - se AS bar FROM board ORDER BY round(mean, 9) DESC, model, k LIMIT 1) SELECT model, k, round(mean, 6) AS mean FROM board, b WHERE mean >= bar OR round(mean, 9) = top ORDER BY k, round(mean, 9) DESC, model LIMIT 1")
def one_se_selection(spark, d):
    return selection.one_se(board(spark, d)).select("model", "k", r6(F.col("mean")).alias("mean"))


GAINS = f"{GRID}, dl AS (SELECT model, k, fold, score - lag(score) OVER w AS delta, (score - lag(score) OVER w) / abs(lag(score) OVER w) AS rel FROM grid WINDOW w AS (PARTITION BY model, fold ORDER BY k))"


@query(f"WITH {GAINS} SELECT model, k AS to_k, round(avg(delta), 6) AS mean_delta, round(100 * avg(rel), 4) AS relative_pct, round(stddev_samp(delta), 6) AS sd_delta, CAST(count(*) FILTER (round(delta, 9) > 0) AS BIGINT) AS folds_improved FROM dl WHERE delta IS NOT NULL GROUP BY ALL")
def marginal_gains(spark, d):
    g = selection.gains(selection.deltas(grid(spark, d)))
    return g.select("model", "to_k", r6(F.col("mean_delta")).alias("mean_delta"), F.round("relative_pct", 4).alias("relative_pct"), r6(F.col("sd_delta")).alias("sd_delta"), "folds_improved")


@query(f"WITH {GAINS} SELECT model, k AS to_k, round(avg(delta) / (stddev_samp(delta) * sqrt(1 / count(*) + 0.2e0 / 0.8e0)), 4) AS t FROM dl WHERE delta IS NOT NULL GROUP BY ALL HAVING round(stddev_samp(delta), 9) > 0")
def paired_t_statistic(spark, d):
    return selection.gains(selection.deltas(grid(spark, d))).filter("t is not null").select("model", "to_k", F.round("t", 4).alias("t"))


@query(None)
def marginal_gain_tests(spark, d):
    return selection.tested(selection.deltas(grid(spark, d)))


@query(f"WITH {PREDS} SELECT round(count(*) / (2.0e0 * sum(y)), 6) AS weight_pos, round(count(*) / (2.0e0 * sum(1 - y)), 6) AS weight_neg, round(sum(1 - y) / sum(y), 6) AS scale_pos_weight FROM preds")
def class_weights(spark, d):
    p, n = F.sum("y"), F.sum(1 - F.col("y"))
    return preds(spark, d).agg(r6(safe_ratio(F.count("*"), 2 * p)).alias("weight_pos"), r6(safe_ratio(F.count("*"), 2 * n)).alias("weight_neg"), r6(safe_ratio(n, p)).alias("scale_pos_weight"))


# --- sources, stored predictions and reference levels -----------------------------------

@query("SELECT event_id, event_type, value FROM events")
def scan_csv_roundtrip(spark, d):
    path = f"{scratch_dir(spark)}/events_csv"
    events = t(spark, d, "events").select("event_id", "event_type", "value")
    write_table(events, path)
    return spark.read.schema(events.schema).option("header", "true").csv(path)


@query(f"WITH {PREDS} SELECT row_id, y, s, CASE WHEN fold = 4 THEN 'holdout' ELSE 'cv' END AS stage, 'm' || (row_id % 2) AS model FROM preds")
def pred_store_roundtrip(spark, d):
    path = f"{scratch_dir(spark)}/preds.parquet"
    stage = F.when(F.col("fold") == 4, "holdout").otherwise("cv").alias("stage")
    model = F.concat(F.lit("m"), (F.col("row_id") % 2).cast("string")).alias("model")
    write_table(preds(spark, d).select("row_id", "y", "s", stage, model), path, ("stage", "model"))
    return read_table(spark, path)


@query(f"WITH {PREDS}, r AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(row_id AS VARCHAR)), row_id) AS r, count(*) OVER (PARTITION BY y) AS n FROM preds) SELECT row_id, y, CASE WHEN r <= round(n * 0.25e0) THEN 'holdout' ELSE 'train' END AS part FROM r")
def split_random_stratified(spark, d):
    return splits.holdout(preds(spark, d).select("row_id", "y"), "row_id")


@query(f"WITH {ORD}, gr AS (SELECT DISTINCT g FROM ord), k AS (SELECT g, row_number() OVER (ORDER BY md5(CAST(g AS VARCHAR)), g) <= ceil(count(*) OVER () * 0.25e0) AS out FROM gr) SELECT id, CASE WHEN out THEN 'holdout' ELSE 'train' END AS part FROM ord JOIN k USING (g)")
def split_group(spark, d):
    return splits.holdout(ord_(spark, d), "id", "group", group="g").select("id", "part")


_LEVELS = [i / 100 for i in range(101)]


@query(f"""WITH q AS (SELECT quantile_cont(value, {_LEVELS}) AS q FROM events WHERE ts < TIMESTAMP '2024-01-16'),
e AS (SELECT q, list_sort(list_distinct([q[i * 10 + 1] FOR i IN range(0, 11)])) AS e FROM q),
b AS (SELECT unnest(range(0, len(e) - 1)) AS bin, q, e FROM e),
x AS (SELECT bin, CASE WHEN bin = 0 THEN 0e0 ELSE (list_position(q, e[bin + 1]) - 1) / 100e0 END AS lo, CASE WHEN bin = len(e) - 2 THEN 1e0 ELSE (list_position(q, e[bin + 2]) - 1) / 100e0 END AS hi FROM b),
o AS (SELECT len([v FOR v IN e[2:len(e) - 1] IF v <= value]) AS bin, count(*) AS c FROM events, e WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1),
f AS (SELECT greatest(hi - lo, 1e-6) AS p, greatest(coalesce(c, 0) / (SELECT sum(c) FROM o), 1e-6) AS a FROM x LEFT JOIN o USING (bin))
SELECT round(sum((a - p) * ln(a / p)), 6) AS psi FROM f""")
def psi_from_quantiles(spark, d):
    x = t(spark, d, "events").select(F.col("value").alias("x"), F.col("ts").cast("timestamp").alias("ts"))
    stored = x.filter("ts < '2024-01-16'").agg(F.percentile("x", F.array(*map(F.lit, _LEVELS))).alias("q"))
    return metrics.psi_from_quantiles(stored, x.filter("ts >= '2024-01-16'"))


@query(ROC + ", th AS (SELECT 'fpr' AS source, th + (0.05 - f) / (hf - f) * (hth - th) AS threshold FROM lo, hi UNION ALL SELECT 'top_pct', quantile_cont(s, 0.95) FROM preds) SELECT source, round(threshold, 6) AS threshold, round(avg(CAST(s >= threshold AS INT)), 6) AS flag_rate, round(sum(CASE WHEN s >= threshold THEN y END) / nullif(count(*) FILTER (s >= threshold), 0), 6) AS precision, round(sum(CASE WHEN s >= threshold THEN y ELSE 0 END) / sum(y), 6) AS recall FROM preds, th GROUP BY source, th.threshold")
def implied_thresholds(spark, d):
    p = preds(spark, d)
    top = p.agg(F.percentile("s", 0.95).alias("threshold")).select(F.lit("top_pct").alias("source"), "threshold")
    fpr = metrics.at_fpr(p, 0.05, digits=None).select(F.lit("fpr").alias("source"), F.col("threshold_at_fpr").alias("threshold"))
    return metrics.at_thresholds(p, fpr.unionByName(top)).withColumn("threshold", r6(F.col("threshold")))


# --- orderings and stability of selections ----------------------------------------------

_PARTS = "parts AS (SELECT 'event_type' AS variable, event_type AS level, CAST(event_type IN ('purchase','error') AND value > 40 AS INT) AS y FROM events UNION ALL SELECT 'user', CAST(user_id % 7 AS VARCHAR), CAST(event_type IN ('purchase','error') AND value > 40 AS INT) FROM events UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR), CAST(event_type IN ('purchase','error') AND value > 40 AS INT) FROM events)"


@query(f"WITH {_PARTS}, k AS (SELECT variable, level, count(*) AS n, sum(y) AS pos FROM parts GROUP BY ALL), w AS (SELECT variable, (pos + 0.5e0) / (sum(pos) OVER v + 0.5e0 * count(*) OVER v) AS p, (n - pos + 0.5e0) / (sum(n - pos) OVER v + 0.5e0 * count(*) OVER v) AS q FROM k WINDOW v AS (PARTITION BY variable)), i AS (SELECT variable, round(sum((p - q) * least(4.0e0, greatest(-4.0e0, ln(p / q)))), 6) AS iv FROM w GROUP BY variable) SELECT variable, iv, CAST(row_number() OVER (ORDER BY iv DESC, variable) AS INT) AS rank FROM i")
def ordering_iv(spark, d):
    e = t(spark, d, "events")
    y = (F.col("event_type").isin("purchase", "error") & (F.col("value") > 40)).cast("int")
    levels = {"event_type": F.col("event_type"), "user": (F.col("user_id") % 7).cast("string"), "hour": F.hour(F.col("ts").cast("timestamp")).cast("string")}
    rows = e.select(y.alias("y"), F.explode(F.create_map(*[x for k, v in levels.items() for x in (F.lit(k), v)])).alias("variable", "level"))
    v = Window.partitionBy("variable")
    k = rows.groupBy("variable", "level").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    share = lambda c: (c + 0.5) / (F.sum(c).over(v) + 0.5 * F.count("*").over(v))
    w = k.select("variable", share(F.col("pos")).alias("p"), share(F.col("n") - F.col("pos")).alias("q"))
    bounded = F.least(F.lit(4.0), F.greatest(F.lit(-4.0), F.log(F.col("p") / F.col("q"))))
    iv = w.groupBy("variable").agg(r6(F.sum((F.col("p") - F.col("q")) * bounded)).alias("iv"))
    return iv.select("variable", "iv", F.row_number().over(Window.orderBy(F.desc("iv"), "variable")).alias("rank"))


#: Orders of eight parts of the day by fold and for odd and even events.
RANKS = "ranks AS (SELECT model, fold, variable, row_number() OVER (PARTITION BY model, fold ORDER BY m DESC, variable) AS r FROM (SELECT event_id % 2 AS model, event_id % 5 AS fold, hour(ts) // 3 AS variable, round(avg(value), 9) AS m FROM events GROUP BY ALL))"


def ranks(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select((F.col("event_id") % 2).alias("model"), (F.col("event_id") % 5).alias("fold"), F.floor(F.hour(F.col("ts").cast("timestamp")) / 3).alias("variable"), "value")
    m = e.groupBy("model", "fold", "variable").agg(F.round(F.avg("value"), 9).alias("m"))
    return m.select("model", "fold", "variable", F.row_number().over(Window.partitionBy("model", "fold").orderBy(F.desc("m"), "variable")).alias("r"))


@query(f"WITH {RANKS}, n AS (SELECT model, count(DISTINCT fold) AS n FROM ranks GROUP BY model) SELECT model, variable, round(count(*) FILTER (r <= 3) / max(n), 6) AS share FROM ranks JOIN n USING (model) GROUP BY model, variable HAVING count(*) FILTER (r <= 3) > 0")
def selection_stability(spark, d):
    return selection.stability(ranks(spark, d), 3)


@query(f"WITH {RANKS}, p AS (SELECT a.model, a.fold AS f1, b.fold AS f2, corr(a.r, b.r) AS rho, CAST(bool_or(a.r = 1 AND b.r = 1) AS INT) AS top1, count(*) FILTER (a.r <= 5 AND b.r <= 5) / count(*) FILTER (a.r <= 5 OR b.r <= 5) AS j FROM ranks a JOIN ranks b ON a.model = b.model AND a.variable = b.variable AND a.fold < b.fold GROUP BY ALL) SELECT model, round(avg(rho), 6) AS spearman, round(avg(top1), 6) AS top1, round(avg(j), 6) AS top5_jaccard FROM p GROUP BY model")
def ordering_agreement(spark, d):
    return selection.agreement(ranks(spark, d))


@query(f"WITH {GAINS}, g AS (SELECT model, k, round(avg(delta), 9) AS m FROM dl WHERE delta IS NOT NULL GROUP BY ALL) SELECT model, min(k) AS first_k FROM g WHERE m <= 0 GROUP BY model")
def first_non_improving_k(spark, d):
    return selection.first_non_improving(selection.deltas(grid(spark, d)))


# --- further reports -----------------------------------------------------------------------

@query(f"WITH {PREDS}, {CURVE}, e AS (SELECT *, lag(tp) OVER o ltp, lead(tp) OVER o ntp, lead(fp) OVER o nfp FROM c WINDOW o AS (ORDER BY s DESC)), k AS (SELECT fps / N AS f, tps / P AS t FROM e WHERE ltp IS NULL OR ntp IS NULL OR tp <> ntp OR fp <> nfp UNION ALL SELECT 0.0, 0.0), bu AS (SELECT unnest([0.01e0, 0.05e0, 0.1e0]) AS b), ra AS (SELECT b, (SELECT t FROM k WHERE f <= b ORDER BY f DESC, t DESC LIMIT 1) AS t, (SELECT f FROM k WHERE f <= b ORDER BY f DESC, t DESC LIMIT 1) AS f, (SELECT f FROM k WHERE f > b ORDER BY f, t LIMIT 1) AS hf, (SELECT t FROM k WHERE f > b ORDER BY f, t LIMIT 1) AS ht FROM bu), li AS (SELECT y, row_number() OVER (ORDER BY s DESC, row_id) AS r, count(*) OVER () AS n FROM preds) SELECT (SELECT round(sum(tp / P * tps / (tps + fps)), 6) FROM c) AS average_precision, (SELECT round(t + (b - f) / (hf - f) * (ht - t), 6) FROM ra WHERE b = 0.01e0) AS recall_at_001, (SELECT round(t + (b - f) / (hf - f) * (ht - t), 6) FROM ra WHERE b = 0.05e0) AS recall_at_005, (SELECT round(t + (b - f) / (hf - f) * (ht - t), 6) FROM ra WHERE b = 0.1e0) AS recall_at_010, round(avg(y) FILTER (r <= greatest(ceil(0.05 * n), 1)) / avg(y), 6) AS lift_at_005, round(avg(y) FILTER (r <= greatest(ceil(0.1 * n), 1)) / avg(y), 6) AS lift_at_010, round(avg(y), 6) AS prevalence FROM li")
def metrics_multi_budget(spark, d):
    wanted = metrics.columns_of(["recall_at_fpr", "lift_at_top_pct"], {"recall_at_fpr": [0.01, 0.05, 0.1], "lift_at_top_pct": [0.05, 0.1]}, "average_precision")
    one = metrics.evaluated(preds(spark, d), wanted, "row_id")
    names = {"recall_at_fpr@0.01": "recall_at_001", "recall_at_fpr@0.05": "recall_at_005", "recall_at_fpr@0.1": "recall_at_010", "lift_at_top_pct@0.05": "lift_at_005", "lift_at_top_pct@0.1": "lift_at_010"}
    return one.withColumnsRenamed(names).select("average_precision", *names.values(), "prevalence")


_DRIFTING = {"value": "value", "user": "CAST(user_id AS DOUBLE)", "hour": "CAST(hour(ts) AS DOUBLE)"}
_EACH = " UNION ALL ".join(f"SELECT '{k}' AS variable, {x} AS x, ts < TIMESTAMP '2024-01-16' AS r FROM events" for k, x in _DRIFTING.items())


@query(f"WITH a AS ({_EACH}), e AS (SELECT variable, list_sort(list_distinct(quantile_cont(x, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM a WHERE r GROUP BY variable), b AS (SELECT variable, len(list_filter(e[2:len(e)-1], lambda z: z <= x)) AS b, sum(CAST(r AS INT)) AS r, sum(CAST(NOT r AS INT)) AS c FROM a JOIN e USING (variable) GROUP BY ALL), q AS (SELECT variable, greatest(r / sum(r) OVER v, 1e-6) AS p, greatest(c / sum(c) OVER v, 1e-6) AS q FROM b WINDOW v AS (PARTITION BY variable)), f AS (SELECT variable, round(sum((q - p) * ln(q / p)), 6) AS psi FROM q GROUP BY variable) SELECT variable, psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'watch' ELSE 'investigate' END AS band FROM f")
def psi_per_feature(spark, d):
    ts = F.col("ts").cast("timestamp")
    x = t(spark, d, "events").select(F.col("value"), F.col("user_id").cast("double").alias("user"), F.hour(ts).cast("double").alias("hour"), ts.alias("ts"))
    return metrics.psi_per_feature(x.filter("ts < '2024-01-16'"), x.filter("ts >= '2024-01-16'"), list(_DRIFTING))


@query(f"WITH {NULLS} SELECT CAST(count(*) AS BIGINT) AS n_rows, 4 AS n_columns, round(1 - (count(id) + count(v) + count(y)+ count(*)) / (4 * count(*)), 6) AS missing_rate, 'one' AS constant FROM nulls")
def matrix_profile(spark, d):
    return profile.matrix_profile(nulls(spark, d).select("id", "v", "y", F.lit(1).alias("one")))


@query(None)
def data_fingerprint(spark, d):
    return profile.fingerprint(t(spark, d, "orders"))


@query(f"WITH {NULLS} SELECT CASE WHEN fold < 3 THEN 'v' ELSE 't' END AS source, round(sum(m), 6) AS value FROM (SELECT fold, avg(v) AS m FROM nulls GROUP BY fold) GROUP BY 1")
def aggregate_to_source(spark, d):
    shares = nulls(spark, d).groupBy("fold").agg(F.avg("v").alias("value")).select(F.when(F.col("fold") < 3, "v").otherwise("t").alias("source"), "value")
    return profile.aggregate_to_source(shares)


@query(f"WITH {PREDS} SELECT row_id, s, 'cv' AS stage FROM preds WHERE fold < 4 UNION ALL SELECT row_id, s, 'holdout' FROM preds WHERE fold = 4")
def union_stages(spark, d):
    p = preds(spark, d)
    chunks = [(p.filter("fold < 4"), "cv"), (p.filter("fold = 4"), "holdout")]
    return store.union_stages([x.select("row_id", "s", F.lit(stage).alias("stage")) for x, stage in chunks])


PARTS = f"{ORD}, parts AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY d, id) <= round_even(count(*) OVER () * 0.75e0, 0) THEN 'train' ELSE 'holdout' END AS part FROM ord)"


@query(f"WITH {PARTS} SELECT part, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS n_positive, round(avg(y), 6) AS prevalence, strftime(min(d), '%Y-%m-%d') AS first_day, strftime(max(d), '%Y-%m-%d') AS last_day FROM parts GROUP BY part")
def split_report(spark, d):
    return splits.split_report(splits.holdout(ord_(spark, d), "id", "time", time="d"), time="d")


@query(f"WITH {PARTS} SELECT CAST(count(*) AS BIGINT) AS n_groups, CAST(count(*) FILTER (s > 1) AS BIGINT) AS n_leaked FROM (SELECT g, count(DISTINCT part) AS s FROM parts GROUP BY g)")
def groups_leaked(spark, d):
    return splits.groups_leaked(splits.holdout(ord_(spark, d), "id", "time", time="d"), "g")


@query(f"WITH {ORD}, r AS (SELECT g, row_number() OVER (ORDER BY pos DESC, n DESC, g) - 1 AS r FROM (SELECT g, sum(y) AS pos, count(*) AS n FROM ord GROUP BY g)) SELECT g, CAST(CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS INT) AS fold FROM r")
def cv_group_folds(spark, d):
    return splits.group_folds(ord_(spark, d), "g")


@query(f"WITH {PREDS}, e AS (SELECT row_id, y, r AS repeat, CASE WHEN r = 0 THEN CAST(row_id AS VARCHAR) ELSE r || ':' || row_id END AS i FROM preds, range(0, 2) x(r)) SELECT row_id, CAST((row_number() OVER (PARTITION BY y, repeat ORDER BY md5(i), i) - 1) % 3 AS INT) AS fold, CAST(repeat AS INT) AS repeat FROM e")
def fold_assignments(spark, d):
    return splits.stratified_folds(preds(spark, d), "row_id", folds=3, repeats=2)


# --- fits: rows only, SQL has none -------------------------------------------------------

PANEL = ["value", "log_value", "hour", "user"]


def panel(spark: SparkSession, d: str) -> DataFrame:
    """id, y, fold and four variables of events, near unit scale."""
    y = (F.col("event_type").isin("purchase", "error") & (F.col("value") > 40)).cast("int")
    e = t(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), y.alias("y"), (F.col("event_id") % 3).alias("fold"), (F.col("value") / 100).alias("value"), F.log1p("value").alias("log_value"), (F.hour(F.col("ts").cast("timestamp")) / 24).alias("hour"), ((F.col("user_id") % 7) / 7).alias("user"))


@query(None)
def fit_logistic(spark, d):
    model = models.fit(panel(spark, d), PANEL)
    return spark.createDataFrame([*zip(PANEL, map(float, model.coefficients), strict=True), ("intercept", float(model.intercept))], "variable string, coefficient double")


def _held_out(spark: SparkSession, d: str, family: str) -> DataFrame:
    p = panel(spark, d)
    return metrics.rank_metrics(models.scored(models.fit(p.filter("fold != 0"), PANEL, family), p.filter("fold = 0"), PANEL))


@query(None)
def fit_forest(spark, d):
    return _held_out(spark, d, "forest")


@query(None)
def fit_gbt(spark, d):
    return _held_out(spark, d, "gbt")


def _ranked(spark: SparkSession, values: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(v, float(x), i) for i, (v, x) in enumerate(values.items(), 1)], "variable string, value double, rank int")


@query(None)
def ordering_importance(spark, d):
    p = panel(spark, d)
    return _ranked(spark, models.importance(models.fit(p, PANEL, "forest"), p, PANEL))


@query(None)
def ordering_permutation(spark, d):
    p = panel(spark, d)
    return _ranked(spark, models.permutation_importance(models.fit(p, PANEL), p, PANEL, "id", hash_ranked))


@query(None)
def ordering_rfe(spark, d):
    return _ranked(spark, {v: 1 / i for i, v in enumerate(models.eliminated(panel(spark, d), PANEL), 1)})


@query(None)
def cv_grid(spark, d):
    """The nested grid over the three families and one to four variables, its board and its choice."""
    cells = models.nested_grid(panel(spark, d).cache(), PANEL, tuple(models.FAMILIES), 3, 4)
    scores = spark.createDataFrame(cells, "model string, k int, fold int, variables string, score double")
    cells = selection.ranked_board(selection.board(scores, 3))
    best = selection.one_se(cells).select("model", "k", F.lit(True).alias("chosen"))
    return cells.join(best, ["model", "k"], "left").select("model", "k", r6(F.col("mean")).alias("mean"), r6(F.col("se")).alias("se"), "rank", F.coalesce("chosen", F.lit(False)).alias("chosen"))


@query(None)
def tune_grid(spark, d):
    points = [{"strength": c, "max_iter": 20} for c in (0.01, 1.0)]
    rows = [(json.dumps(p), mean, i) for i, (p, mean) in enumerate(models.tuned(panel(spark, d).cache(), PANEL, "logistic", points, 2), 1)]
    return spark.createDataFrame(rows, "params string, mean double, rank int")
