"""Small helpers the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session without spark.checkpoint.dir gets a temporary one; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foldwise-"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there: lineage ends, lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_unsized(df: DataFrame) -> DataFrame:
    """As `cut`, but the rows' size counts as unknown from here on.

    A checkpoint hands on the size that the planner guessed, and the guess for a join is the product of its sides. Where tables that
    were written are joined round after round, its digits more than double each round, and in the end the guesses alone fill the driver.
    """
    plan, session, jvm = cut(df)._jdf.queryExecution().analyzed(), df.sparkSession, df.sparkSession._jvm
    none = jvm.scala.Option.empty()
    rows = jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session._jsparkSession, none, none
    )
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, rows), session)


def done_with(*written: DataFrame) -> None:
    """Remove what `cut` wrote for these rows; nothing may read them any more."""
    for df in written:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, actions hand batches of `rows` small rows to Python; the session's setting comes back after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that what a worker makes of them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


#: Rows of an Arrow batch between Spark and its Python workers; whole texts come in it, so memory follows it.
BATCH_ROWS = "250"


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same rows; from here on the session hands them to Python in batches of BATCH_ROWS at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(name)) > int(BATCH_ROWS) or int(df.sparkSession.conf.get(name)) <= 0:
        df.sparkSession.conf.set(name, BATCH_ROWS)
    return df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns of any name cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])
