"""Models as plain numpy objects with fit and predict, and out-of-sample evaluation of any of them per series.

A series is one group; the fold loop runs inside its kernel, so rows aren't copied for every fold. Work spreads over
series, replicates and parameters.
"""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.draws import HashDraws
from foldwise.operators.splits import CrossFitCV, Splitter, WalkForwardCV


class Ridge:
    """Least squares with a penalty on the coefficients but not on the intercept."""

    def __init__(self, alpha: float = 1.0) -> None:
        self.alpha = alpha

    def fit(self, x: np.ndarray, y: np.ndarray) -> Ridge:
        self.mean_x, self.mean_y = x.mean(axis=0), y.mean()
        c = x - self.mean_x
        self.coef = np.linalg.lstsq(c.T @ c + self.alpha * np.eye(x.shape[1]), c.T @ (y - self.mean_y), rcond=None)[0]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.mean_y + (x - self.mean_x) @ self.coef


class Mean:
    """The mean of the training targets."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Mean:
        self.value = y.mean()
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


class Column0:
    """The first feature itself: persistence, if that is the last value."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Column0:
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x[:, 0].astype(float)


def with_lags(df: DataFrame, value: str, by: list[str], order: list[str], lags: Iterable[int]) -> DataFrame:
    """Adds y_lag{k}; rows without full history are left out."""
    from foldwise.operators.metrics import ordered

    w = ordered(by, order)
    df = df.select("*", *[F.lag(value, k).over(w).alias(f"y_lag{k}") for k in lags])
    return df.where(" and ".join(f"y_lag{k} is not null" for k in lags))


def _arrays(pdf: pd.DataFrame, features: list[str], target: str) -> tuple[np.ndarray, np.ndarray]:
    return pdf[features].to_numpy(float), pdf[target].to_numpy(float)


def _grouped(df: DataFrame, by: list[str], order: list[str], used: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    kinds = dict(df.dtypes)
    keys = ", ".join(f"`{b}` {kinds[b]}" for b in by)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf.sort_values(order).reset_index(drop=True))
        for k, b in enumerate(by):
            out.insert(k, b, [key[k]] * len(out))
        return out

    names = list(dict.fromkeys([*by, *order, *used]))
    if by:
        return df.select(*names).groupBy(*by).applyInPandas(run, f"{keys}, {schema}")
    return df.select(*names).groupBy().applyInPandas(lambda pdf: f(pdf.sort_values(order).reset_index(drop=True)), schema)


def walk_forward_evaluate(df: DataFrame, model, features: list[str], target: str, by: list[str], order: list[str], cv: WalkForwardCV | None = None) -> DataFrame:
    """(by, fold, position, prediction, actual, error, abs_error, train_lo, train_hi): one row a prediction. Series too short give none."""
    cv = cv or WalkForwardCV()
    names = ["fold", "position", "prediction", "actual", "error", "abs_error", "train_lo", "train_hi"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _arrays(pdf, features, target)
        parts = []
        for k, (a, b, c, d) in enumerate(cv.bounds(len(y)) if cv.get_n_splits(len(y), strict=False) else []):
            p = np.asarray(copy.deepcopy(model).fit(x[a:b], y[a:b]).predict(x[c:d]), float)
            e = p - y[c:d]
            parts.append(pd.DataFrame({"fold": k, "position": np.arange(c, d), "prediction": p, "actual": y[c:d], "error": e, "abs_error": np.abs(e), "train_lo": a, "train_hi": b}))
        return pd.concat(parts)[names] if parts else pd.DataFrame({n: [] for n in names})

    return _grouped(df, by, order, [*features, target], one, "fold int, position long, prediction double, actual double, error double, abs_error double, train_lo long, train_hi long")


def per_split_metrics(result: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, fold, n, mae, rmse, bias) of walk_forward_evaluate's rows."""
    return result.groupBy(*(by or []), "fold").agg(F.count("error").alias("n"), F.avg("abs_error").alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.avg("error").alias("bias"))


def _crossfit(x: np.ndarray, ys: list[np.ndarray], models: list, cv: Splitter) -> list[np.ndarray]:
    out = [np.full(len(y), np.nan) for y in ys]
    for a, b, c, d in cv.bounds(len(x)) if cv.get_n_splits(len(x), strict=False) else []:
        for y, m, o in zip(ys, models, out, strict=True):
            o[c:d] = copy.deepcopy(m).fit(x[a:b], y[a:b]).predict(x[c:d])
    return out


def crossfit_predict(df: DataFrame, model, features: list[str], target: str, by: list[str], order: list[str], cv: Splitter | None = None) -> DataFrame:
    """(by, position, prediction, residual): out-of-fold predictions of every row, null where no fold covers it."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _arrays(pdf, features, target)
        (p,) = _crossfit(x, [y], [model], cv or CrossFitCV())
        return pd.DataFrame({"position": np.arange(len(y)), "prediction": p, "residual": y - p})

    return _nan_to_null(_grouped(df, by, order, [*features, target], one, "position long, prediction double, residual double"), ["prediction", "residual"])


def cross_fit_residualize(df: DataFrame, model_a, model_b, features: list[str], a: str, b: str, by: list[str], order: list[str], cv: Splitter | None = None) -> DataFrame:
    """(by, position, residual_a, residual_b): both targets less their out-of-fold predictions from the same features; later folds win."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ya = _arrays(pdf, features, a)
        yb = pdf[b].to_numpy(float)
        pa, pb = _crossfit(x, [ya, yb], [model_a, model_b], cv or CrossFitCV())
        return pd.DataFrame({"position": np.arange(len(ya)), "residual_a": ya - pa, "residual_b": yb - pb})

    return _nan_to_null(_grouped(df, by, order, [*features, a, b], one, "position long, residual_a double, residual_b double"), ["residual_a", "residual_b"])


def _nan_to_null(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


def nested_walk_forward(df: DataFrame, make_model: Callable[..., object], param_grid: dict[str, Sequence], features: list[str], target: str, by: list[str], order: list[str], n_outer_splits: int = 3, n_inner_splits: int = 5, horizon: int = 1, extra_gap: int = 0, n_iter: int | None = None, seed: int = 0) -> DataFrame:
    """(by, fold, params, inner_score, outer_mae, best_params): a parameter search inside every outer fold.

    Both loops test one row a fold. A fold takes the parameters of least mean inner error; over all, the ones chosen
    most often (first seen on ties). n_iter draws that many combinations instead of all.
    """
    grid = [dict(zip(param_grid, v, strict=True)) for v in product(*param_grid.values())]
    if n_iter is not None and n_iter < len(grid):
        grid = [grid[k] for k in HashDraws(seed).choice(len(grid), n_iter, replace=False)]
    names = ["fold", "params", "inner_score", "outer_mae", "best_params"]

    def score(x, y, params, cv) -> float:
        e = [abs(float(make_model(**params).fit(x[a:b], y[a:b]).predict(x[c:d])[0] - y[c])) for a, b, c, d in cv.bounds(len(y))]
        return -float(np.mean(e))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _arrays(pdf, features, target)
        outer, inner = WalkForwardCV(n_outer_splits, horizon, extra_gap=extra_gap), WalkForwardCV(n_inner_splits, horizon, extra_gap=extra_gap)
        rows = []
        for k, (a, b, c, d) in enumerate(outer.bounds(len(y)) if outer.get_n_splits(len(y), strict=False) else []):
            if not inner.get_n_splits(b - a, strict=False):
                continue
            scores = [score(x[a:b], y[a:b], p, inner) for p in grid]
            best = int(np.argmax(scores))
            mae = float(np.abs(make_model(**grid[best]).fit(x[a:b], y[a:b]).predict(x[c:d]) - y[c:d]).mean())
            rows.append((k, repr(sorted(grid[best].items())), scores[best], mae))
        vote = Counter(r[1] for r in rows).most_common(1)[0][0] if rows else ""
        return pd.DataFrame([(*r, vote) for r in rows], columns=names)

    return _grouped(df, by, order, [*features, target], one, "fold int, params string, inner_score double, outer_mae double, best_params string")


def gap_sensitivity_analysis(df: DataFrame, model, features: list[str], target: str, by: list[str], order: list[str], gap_range: Sequence[int] = range(10), n_splits: int = 5, metric: str = "mae", window_type: str = "expanding", window_size: int | None = None) -> DataFrame:
    """(by, gap, metric): the walk-forward error at each gap, one test row a fold; null where the series is too short."""
    names = {"mae": lambda e: np.abs(e).mean(), "mse": lambda e: (e * e).mean(), "rmse": lambda e: np.sqrt((e * e).mean())}
    if metric not in names:
        raise ValueError(f"unknown metric {metric!r}")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _arrays(pdf, features, target)
        rows = []
        for g in gap_range:
            cv = WalkForwardCV(n_splits, None, window_type, window_size, g)
            bounds = cv.bounds(len(y)) if cv.get_n_splits(len(y), strict=False) else []
            e = [copy.deepcopy(model).fit(x[a:b], y[a:b]).predict(x[c:d]) - y[c:d] for a, b, c, d in bounds]
            rows.append((g, float(names[metric](np.concatenate(e))) if e else np.nan))
        return pd.DataFrame(rows, columns=["gap", "metric"])

    return _nan_to_null(_grouped(df, by, order, [*features, target], one, "gap int, metric double"), ["metric"])


def gap_summary(result: DataFrame, by: list[str], degradation_threshold: float = 0.1) -> DataFrame:
    """(by, break_even_gap, sensitivity): the first gap whose error exceeds that at the smallest gap by the threshold; deviation over mean."""
    base = F.min_by("metric", "gap")
    first = result.groupBy(*by).agg(base.alias("_base"))
    rows = result.join(F.broadcast(first), by) if by else result.crossJoin(F.broadcast(first))
    worse = F.col("metric") > F.col("_base") * (1 + degradation_threshold)
    return rows.groupBy(*by).agg(F.min(F.when(worse, F.col("gap"))).alias("break_even_gap"), F.when(F.avg("metric") > 0, F.stddev_pop("metric") / F.avg("metric")).alias("sensitivity"))


def check_temporal_estimator(model, n_samples: int = 60) -> None:
    """Raise AssertionError unless fit and predict give finite values of the right shape and cross-fitting covers all but the first fold."""
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((n_samples, 3)), rng.standard_normal(n_samples)
    p = np.asarray(copy.deepcopy(model).fit(x, y).predict(x))
    assert p.shape == (n_samples,) and np.isfinite(p).all(), "predictions must be finite, one a row"
    cv = CrossFitCV()
    (oof,) = _crossfit(x, [y], [model], cv)
    assert np.isfinite(oof[cv.bounds(n_samples)[0][2] :]).all(), "covered rows must be predicted"
