"""The driver's tables as series."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the folder that spark.checkpoint.dir names, which driver and executors share; a temporary one in local sessions without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(named or tempfile.mkdtemp(prefix='foldwise-')).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, idx, day, y): revenue by day of all orders, one series."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("y"))
    w = Window.partitionBy("series_id").orderBy("day")
    return days.withColumn("series_id", F.lit("all")).withColumn("idx", F.row_number().over(w) - 1).select("series_id", "idx", "day", "y")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, idx, event_id, event_type, ts, y): a user's events in time, many series."""
    w = Window.partitionBy("series_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), "event_id", "event_type", "ts", F.col("value").alias("y"))
    return rows.withColumn("idx", F.row_number().over(w) - 1).select("series_id", "idx", "event_id", "event_type", "ts", "y")


def with_forecasts(series: DataFrame, by: list[str]) -> DataFrame:
    """Adds p_last, p_week (seven rows before), p_mean7 (mean of the last seven) and p_all (mean of all before)."""
    w = Window.partitionBy(*by).orderBy("idx")
    mean = lambda a: F.avg("y").over(w.rowsBetween(a, -1))
    return series.select("*", F.lag("y").over(w).alias("p_last"), F.lag("y", 7).over(w).alias("p_week"), mean(-7).alias("p_mean7"), mean(Window.unboundedPreceding).alias("p_all"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with forecasts, rows with seven values before them, so that all models are there."""
    return with_forecasts(panel(spark, sf_dir), ["series_id"]).where("idx >= 7")


def daily_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_forecasts(daily(spark, sf_dir), ["series_id"]).where("idx >= 7")


MODELS = ("p_last", "p_week", "p_mean7", "p_all")


def errors_long(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model, e): errors of every model, one row each."""
    return df.unpivot([*keys, "y"], list(MODELS), "model", "p").select(*keys, "model", (F.col("p") - F.col("y")).alias("e"))
