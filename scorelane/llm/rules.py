"""Quality rules: text statistics, two fixed rules, then robust multivariate outliers.

Everything here is DataFrame expressions. The statistics come from one projection
over each whole text. The second part fits, per language and source, a minimum
covariance determinant estimate. There are three starts: medians with absolute deviations,
with the covariance of squashed deviations, and with that of their directions. Of each, the
share H of rows nearest to the centre is kept, their mean and covariance taken, and so on
(concentration steps) until no determinant falls by SETTLED of itself; the start with the
least determinant counts. Covariances are regularised by the diagonal FLOORS ** 2, as in the
regularised form of the estimate, since features may be constant. Rows whose Mahalanobis
distance is beyond CUTOFF are rejected. A pass over the table yields only sums per stratum
and start; these are joined back by broadcast while their number is below MAX_BROADCAST,
else by a shuffled join. Edges of the kept share are percentiles to a 10,000th of the rows.

A stratum of fewer than MIN_ROWS rows is pooled with the others of its language.
Null languages and sources are values of their own. Null and empty texts have no words
and fail the base rule. Repeated rows count as often as they occur. An empty table
gives no rows; other columns are ignored. A doc_id may be null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from scorelane.llm import kit

#: Fixed values of the contract.
SPACES = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

H = 0.75
STARTS = 3
STEPS = 10
SETTLED = 0.01
ACCURACY = 10_000
MIN_ROWS = 200
MAX_BROADCAST = 10_000
#: Mean of the inner H of a 5-dimensional normal makes its covariance too small by this.
CONSISTENCY = 1.41
#: Squared distance; all but one in a million rows of a normal lie within.
CUTOFF = 36.0
#: Least standard deviation of each feature: below it differences are no sign of bad text.
FLOORS = (0.5, 0.35, 0.6, 0.7, 0.06)
P = len(FLOORS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more among `hashes`."""
    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        places = F.sort_array(F.transform(again, lambda x: x["p"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        add = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(places, start, add, lambda a: a["n"])

    places = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(places(h), covered)))


def statistics(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """keep, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(*keep, text.alias("_t"), F.array_remove(F.split(text, SPACES + "+"), "").alias("_w"))
    pairs = lambda h, apart: F.zip_with(h, F.slice(h, apart + 1, F.greatest(F.size(h) - apart, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    eights = lambda w: let(let(let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: pairs(h, 1)), lambda h: pairs(h, 2)), lambda h: pairs(h, 4))
    windows = lambda w: F.when(F.size(w) >= WINDOW, F.slice(eights(w), 1, F.size(w) - (WINDOW - 1))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = split.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(F.col("_w"), lambda w: _repeated(windows(w))).alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def features() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log1p("n_words"), F.col("word_chars") / n, F.log1p(100 * F.col("n_symbols") / n), F.log1p("n_dup_lines"), F.col("n_repeat_words") / n]


def _joined(rows: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    side = F.broadcast(estimates) if few else estimates
    return rows.join(side.select(F.col("stratum").alias("_s"), *[c for c in estimates.columns if c != "stratum"]), F.col("stratum") == F.col("_s")).drop("_s")


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d: the squared distance under mean m0.. and Cholesky factor l00.. (forward substitution)."""
    for i in range(P):
        rest = reduce(lambda a, j, i=i: a - F.col(f"l{i}{j}") * F.col(f"z{j}"), range(i), F.col(f"x{i}") - F.col(f"m{i}"))
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("d", reduce(lambda a, b: a + b, (F.col(f"z{i}") * F.col(f"z{i}") for i in range(P))))


def _factored(moments: DataFrame) -> DataFrame:
    """stratum, mean and Cholesky factor from n, s0.., q00..; variances get the floors added."""
    for i in range(P):
        moments = moments.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n"))
    for i in range(P):
        for j in range(i + 1):
            cov = (F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENCY
            cov = F.greatest(cov, F.lit(0.0)) + FLOORS[i] ** 2 if i == j else cov
            rest = reduce(lambda a, k, i=i, j=j: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), cov)
            moments = moments.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    log = reduce(lambda a, b: a + b, (2 * F.log(f"l{i}{i}") for i in range(P)))
    return moments.select("stratum", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)], log.alias("logdet"))


def _of_start(k: int) -> Column:
    return F.concat("stratum", F.lit(f"\x02{k}"))


def starts(rows: DataFrame, few: bool) -> DataFrame:
    """A first mean and factor for each stratum and start."""
    mid = rows.groupBy("stratum").agg(*[F.percentile_approx(f"x{i}", 0.5, ACCURACY).alias(f"m{i}") for i in range(P)])
    apart = _joined(rows, mid, few).groupBy("stratum").agg(*[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, ACCURACY).alias(f"a{i}") for i in range(P)])
    wide = mid.join(apart, "stratum").select("stratum", *[f"m{i}" for i in range(P)], *[F.sqrt((1.4826 * F.col(f"a{i}")) ** 2 + FLOORS[i] ** 2).alias(f"w{i}") for i in range(P)])
    wide = kit.stored(wide, "mcd")
    z = _joined(rows, wide, few).select("stratum", *[((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"w{i}")).alias(f"z{i}") for i in range(P)])
    norm = F.sqrt(reduce(lambda a, b: a + b, (F.col(f"z{i}") ** 2 for i in range(P))) + 1e-9)
    shapes = {1: [F.tanh(f"z{i}") for i in range(P)], 2: [F.col(f"z{i}") / norm for i in range(P)]}
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    sums = z.groupBy("stratum").agg(*[F.avg(y[i] * y[j]).alias(f"c{k}_{i}{j}") for k, y in shapes.items() for i, j in pairs])
    both = wide.join(sums, "stratum")
    out = []
    for k in range(STARTS):
        scale = {0: 0.0, 1: 2.0, 2: float(P)}[k]  # squashing and directions make variances smaller
        q = lambda i, j, k=k, scale=scale: (F.col(f"c{k}_{i}{j}") * scale * F.col(f"w{i}") * F.col(f"w{j}") if k else (F.col(f"w{i}") ** 2 if i == j else F.lit(0.0)))
        moments = both.select(_of_start(k).alias("stratum"), F.lit(1).alias("n"), *[F.col(f"m{i}").alias(f"s{i}") for i in range(P)], *[(q(i, j) / CONSISTENCY + F.col(f"m{i}") * F.col(f"m{j}")).alias(f"q{i}{j}") for i, j in pairs])
        out.append(_factored(moments))
    return reduce(DataFrame.union, out)


def mcd(rows: DataFrame) -> DataFrame:
    """Estimates per stratum of rows(stratum, x0..): mean, factor and log determinant of the covariance. rows is read many times."""
    few = STARTS * rows.select("stratum").distinct().count() <= MAX_BROADCAST
    estimates = kit.stored(starts(rows, few), "mcd")
    each = rows.select(F.explode(F.array(*[_of_start(k) for k in range(STARTS)])).alias("stratum"), *[f"x{i}" for i in range(P)])
    for _ in range(STEPS):
        near = _distance(_joined(each, estimates.drop("logdet"), few))
        edge = near.groupBy("stratum").agg(F.percentile_approx("d", H, ACCURACY).alias("edge"))
        inner = _joined(near.select("stratum", "d", *[f"x{i}" for i in range(P)]), edge, few).filter(F.col("d") <= F.col("edge"))
        moments = inner.groupBy("stratum").agg(
            F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)],
            *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)],
        )
        seen = Observation()
        after = _factored(moments).join(estimates.select("stratum", F.col("logdet").alias("_was")), "stratum")
        after = after.observe(seen, F.max(F.col("_was") - F.col("logdet")).alias("fall"), F.count("*").alias("n"))
        estimates = kit.stored(after.drop("_was"), "mcd")
        if not seen.get["n"] or seen.get["fall"] < SETTLED:
            break
    cols = [c for c in estimates.columns if c != "stratum"]
    best = estimates.groupBy(F.substring_index("stratum", "\x02", 1).alias("stratum")).agg(F.min_by(F.struct(*cols), F.struct("logdet", "stratum")).alias("b"))
    return kit.stored(best.select("stratum", *[F.col(f"b.{c}").alias(c) for c in cols]), "mcd")


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the statistics, base_failed, distance (null where the base rule failed), kept."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    keys = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), name(lang_col).alias("_lang"), name(source_col).alias("_source"))
    stats = kit.stored(statistics(keys, "doc_id", "_lang", "_source", text_col="_text"), "stats")
    sizes = stats.filter(~F.col("base_failed")).groupBy("_lang", "_source").agg(F.count("*").alias("_n"))
    large = kit.stored(sizes.filter(F.col("_n") >= MIN_ROWS).select(F.col("_lang").alias("_l"), F.col("_source").alias("_o")), "strata")
    side = F.broadcast(large) if large.count() <= MAX_BROADCAST else large
    named = stats.join(side, (F.col("_lang") == F.col("_l")) & (F.col("_source") == F.col("_o")), "left").select(
        "doc_id", *STATS, F.concat_ws("\x01", "_lang", "_o").alias("stratum"), *[f.cast("double").alias(f"x{i}") for i, f in enumerate(features())]
    )
    rows = kit.stored(named, "rows")
    estimates = mcd(rows.filter(~F.col("base_failed")).select("stratum", *[f"x{i}" for i in range(P)]))
    side = estimates.drop("logdet").withColumnRenamed("stratum", "_s")
    side = F.broadcast(side) if side.count() <= MAX_BROADCAST else side
    scored = _distance(rows.join(side, F.col("stratum") == F.col("_s"), "left"))
    distance = F.when(~F.col("base_failed"), F.col("d"))
    return scored.select("doc_id", *STATS, distance.alias("distance"), (~F.col("base_failed") & F.coalesce(distance <= CUTOFF, F.lit(True))).alias("kept"))
