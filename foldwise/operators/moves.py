"""Move-conditional metrics: values are changes, and only large ones count as moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.operators.metrics import col, percentiles, share, with_group_values

#: Moves of either direction below which a result isn't reliable.
RELIABLE = 10


def compute_move_threshold(df: DataFrame, actuals: str, percentile: float = 70.0, by: list[str] | None = None) -> DataFrame:
    """(by, move_threshold): the linear percentile of the sizes of changes."""
    return percentiles(df, F.abs(F.col(actuals)), [percentile / 100], by or [], ["move_threshold"])


def classify_moves(values, threshold) -> Column:
    v, t = col(values), threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(v > t, "UP").when(v < -t, "DOWN").when(v.isNotNull(), "FLAT")


def compute_move_conditional_metrics(df: DataFrame, predictions: str, actuals: str, threshold: float | None = None, percentile: float = 70.0, by: list[str] | None = None) -> DataFrame:
    """(by, mae_up, mae_down, mae_flat, n_up, n_down, n_flat, skill_score, move_threshold, reliable).

    The skill score is 1 - MAE on moves / mean size of moves, as persistence predicts no change; null
    if moves are no larger than max(1e-10, 1e-8 of their median size) or there are none.
    """
    by = by or []
    rows = df.where(F.col(predictions).isNotNull() & F.col(actuals).isNotNull())
    if threshold is None:
        rows = with_group_values(rows, compute_move_threshold(rows, actuals, percentile, by), by)
    else:
        rows = rows.withColumn("move_threshold", F.lit(float(threshold)))
    rows = rows.withColumn("_move", classify_moves(actuals, F.col("move_threshold")))
    a, e, m = F.abs(F.col(actuals)), F.abs(F.col(predictions) - F.col(actuals)), F.col("_move")
    moved = m != "FLAT"
    least = F.greatest(F.lit(1e-10), F.coalesce(F.percentile(F.when(moved & (a > 0), a), F.lit(0.5)), F.lit(0.0)) * 1e-8)
    size = F.avg(F.when(moved, a))
    return rows.groupBy(*by).agg(
        *[F.avg(F.when(m == k, e)).alias(f"mae_{k.lower()}") for k in ("UP", "DOWN", "FLAT")],
        *[F.count_if(m == k).alias(f"n_{k.lower()}") for k in ("UP", "DOWN", "FLAT")],
        F.when(size > least, 1 - F.avg(F.when(moved, e)) / size).alias("skill_score"),
        F.max("move_threshold").alias("move_threshold"),
        ((F.count_if(m == "UP") >= RELIABLE) & (F.count_if(m == "DOWN") >= RELIABLE)).alias("reliable"),
    )


def mc_skill_score(df: DataFrame, actuals: str, predictions: str, threshold: float | None = None, percentile: float = 70.0, by: list[str] | None = None) -> DataFrame:
    return compute_move_conditional_metrics(df, predictions, actuals, threshold, percentile, by).select(*(by or []), "skill_score")


def compute_direction_accuracy(predictions, actuals, move_threshold=None) -> Column:
    """Agreement of classes given a threshold, else of signs where the actual isn't zero; 0 if nothing is left."""
    p, a = col(predictions), col(actuals)
    if move_threshold is not None:
        return F.coalesce(share(classify_moves(p, move_threshold) == classify_moves(a, move_threshold)), F.lit(0.0))
    return F.coalesce(share(F.when(F.abs(a) > 1e-10, F.signum(p) == F.signum(a))), F.lit(0.0))


def compute_move_only_mae(predictions, actuals, threshold) -> tuple[Column, Column]:
    """MAE on moves, and their number."""
    a = col(actuals)
    moved = F.abs(a) > threshold
    return F.avg(F.when(moved, F.abs(col(predictions) - a))), F.count_if(moved)


def compute_persistence_mae(actuals, threshold=None) -> Column:
    a = F.abs(col(actuals))
    return F.avg(a if threshold is None else F.when(a > threshold, a))
