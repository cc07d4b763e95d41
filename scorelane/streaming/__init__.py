"""Streams of rows to score: what is local to a row runs as it does in a batch.

Cuts relative to a batch (a top share) mean nothing in a stream, so the threshold is absolute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def decided(stream: DataFrame, threshold: float, score: str = "s") -> DataFrame:
    """stream with decision and action by an absolute threshold; a null score goes to review."""
    flag = F.col(score) >= threshold
    decision = F.when(flag, "flag_fraud").when(F.col(score).isNull(), None).otherwise("pass")
    return stream.withColumn("decision", decision).withColumn("action", F.when(flag | F.col(score).isNull(), "manual_review").otherwise("auto_action"))


def windowed_rates(stream: DataFrame, threshold: float, ts: str, score: str = "s", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows, flagged rows and mean score by tumbling window; rows later than `late` behind are left out."""
    flagged = F.count(F.when(F.col(score) >= threshold, 1))
    rates = stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("n"), flagged.alias("n_flagged"), F.avg(score).alias("mean_score"))
    return rates.select(F.col("w.start").alias("start"), "n", "n_flagged", "mean_score")


def to_parquet(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Writes what has arrived and ends; started again with the same checkpoint it goes on from there."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
