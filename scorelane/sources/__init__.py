"""Tables in and out, by suffix or kind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Parquet by its suffix, CSV with a header otherwise."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.options(**options).parquet(path)
    return spark.read.options(**({"header": "true", "inferSchema": "true"} | options)).csv(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    writer.parquet(path) if path.rstrip("/").endswith(".parquet") else writer.option("header", "true").csv(path)


def ordered_source(spark: SparkSession, query: str, order_by: str) -> DataFrame:
    """A warehouse query; the order key is mandatory since rows have no order of their own."""
    if not order_by:
        raise ValueError("order_by is needed: rows of a table have no order")
    return spark.sql(query).orderBy(order_by)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the shared place the session names; a local one where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{(named or 'file:///tmp/checkpoints').rstrip('/')}/scratch-{uuid.uuid4().hex}"
