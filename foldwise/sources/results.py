"""Results of comparisons as files: JSON reports and per-dataset checkpoints, through Spark's readers and writers."""

from __future__ import annotations

import os
import re
import sys
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "dataset string, model string, mae double, rmse double, mape double, direction_accuracy double, rank int"


def create_run_metadata(models: list[str] | None = None, datasets: list[str] | None = None) -> dict:
    return {"run_id": uuid.uuid4().hex[:8], "time": datetime.now(UTC).isoformat(), "python": sys.version.split()[0], "cpus": os.cpu_count(), "models": models or [], "datasets": datasets or []}


def save_benchmark_results(results: DataFrame, path: str, metadata: dict | None = None) -> None:
    """JSON lines below path/results, and the metadata as one row below path/metadata."""
    results.select(*[c.split(" ")[0] for c in RESULT.split(", ")]).write.mode("overwrite").json(f"{path}/results")
    one = results.sparkSession.createDataFrame([({k: str(v) for k, v in (metadata or {}).items()},)], "metadata map<string,string>")
    one.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_benchmark_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).json(f"{path}/results")


def _slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def save_checkpoint(result: DataFrame, path: str, dataset: str) -> None:
    result.write.mode("overwrite").json(f"{path}/{_slug(dataset)}")


def has_checkpoint(spark: SparkSession, path: str, dataset: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_slug(dataset)}/_SUCCESS")
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def load_checkpoint(spark: SparkSession, path: str, dataset: str) -> DataFrame | None:
    """The rows of a finished dataset, or None."""
    return spark.read.schema(RESULT).json(f"{path}/{_slug(dataset)}") if has_checkpoint(spark, path, dataset) else None


def list_checkpoints(spark: SparkSession, path: str) -> list[str]:
    """Names of finished datasets, as titles."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n.replace("_", " ").title() for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, f"{n}/_SUCCESS")))


def result_to_json(df: DataFrame, schema_version: int = 1) -> DataFrame:
    """(json): every row as JSON with its schema version; maps keep string keys, dates are ISO."""
    return df.select(F.to_json(F.struct(F.lit(schema_version).alias("schema_version"), *df.columns)).alias("json"))
