"""Frames ready to plot: what charts of folds, gates, intervals and model metrics would show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.operators.splits import Splitter


def cv_folds(spark: SparkSession, splitter: Splitter, n: int) -> DataFrame:
    """(fold, part, start, stop): bars of train, gap and test of each fold."""
    bars = F.array(*[F.struct(F.lit(p).alias("part"), F.col(a).alias("start"), F.col(b).alias("stop")) for p, a, b in (("train", "train_lo", "train_hi"), ("gap", "train_hi", "test_lo"), ("test", "test_lo", "test_hi"))])
    return splitter.folds(spark, n).select("fold", F.inline(bars)).where("stop > start")


def gate_gauge(gates: DataFrame) -> DataFrame:
    """(gate, scope, status, severity, value): severity 0 PASS or SKIP, 1 WARN, 2 HALT; value is the metric over its threshold."""
    severity = F.when(F.col("status") == "HALT", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    return gates.select("gate", "scope", "status", severity.alias("severity"), F.when(F.col("threshold") != 0, F.col("metric") / F.col("threshold")).alias("value"))


def interval_band(df: DataFrame, order: str, point: str, lower: str, upper: str, actual: str | None = None) -> DataFrame:
    """(x, point, lower, upper, width, actual, covered)."""
    a = F.col(actual) if actual else F.lit(None).cast("double")
    return df.select(F.col(order).alias("x"), F.col(point).alias("point"), F.col(lower).alias("lower"), F.col(upper).alias("upper"), (F.col(upper) - F.col(lower)).alias("width"), a.alias("actual"), a.between(F.col(lower), F.col(upper)).alias("covered"))


def metric_bars(results: DataFrame, model: str, metrics: list[str], baseline: str | None = None) -> DataFrame:
    """(model, metric, value, relative): long form for grouped bars; relative to the baseline model's value if one is named."""
    long = results.unpivot([model], metrics, "metric", "value")
    if baseline is None:
        return long.withColumn("relative", F.lit(None).cast("double"))
    base = long.where(F.col(model) == baseline).select("metric", F.col("value").alias("_b"))
    return long.join(F.broadcast(base), "metric").select(model, "metric", "value", F.when(F.col("_b") != 0, F.col("value") / F.col("_b")).alias("relative"))


def interval_width(df: DataFrame, order: str, lower: str, upper: str) -> DataFrame:
    """(x, width, mean_width): the width at each place, and its mean as a reference line."""
    width = F.col(upper) - F.col(lower)
    mean = df.agg(F.avg(width).alias("mean_width"))
    return df.select(F.col(order).alias("x"), width.alias("width")).crossJoin(F.broadcast(mean))


def gate_comparison(gates: DataFrame) -> DataFrame:
    """(gate, status, n, severity): bars of how often each gate came out how."""
    return gate_gauge(gates).groupBy("gate", "status").agg(F.count(F.lit(1)).alias("n"), F.max("severity").alias("severity"))


class BaseDisplay:
    """A chart as a frame: subclasses say how it is made from what; there is no drawing library here."""

    make = None

    def __init__(self, frame: DataFrame, title: str = "") -> None:
        self.frame, self.title = frame, title

    @classmethod
    def of(cls, *args, title: str = "", **options) -> BaseDisplay:
        return cls(cls.make(*args, **options), title)

    def rows(self, most: int = 10_000) -> list[dict]:
        """What a drawing library would be given; an error beyond `most` points, as a chart can't show them."""
        got = self.frame.limit(most + 1).collect()
        if len(got) > most:
            raise ValueError(f"more than {most} points; aggregate them first")
        return [r.asDict() for r in got]


class CVFoldsDisplay(BaseDisplay):
    make = staticmethod(cv_folds)


class GateResultDisplay(BaseDisplay):
    make = staticmethod(gate_gauge)


class GateComparisonDisplay(BaseDisplay):
    make = staticmethod(gate_comparison)


class PredictionIntervalDisplay(BaseDisplay):
    make = staticmethod(interval_band)


class MetricComparisonDisplay(BaseDisplay):
    make = staticmethod(metric_bars)


# The names under which users look for these charts.
plot_cv_folds, plot_gate_result, plot_gate_comparison = cv_folds, gate_gauge, gate_comparison
plot_prediction_intervals, plot_interval_width, plot_metric_comparison = interval_band, interval_width, metric_bars
