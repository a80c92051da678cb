"""Block, stationary and wild bootstraps, and bagging over them; replicates are dealt over the cluster.

Draws depend on the seed and the number of rows alone, so results don't depend on partitions, and series of one length share them.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.draws import HashDraws
from foldwise.operators.accuracy_tests import stationary_bootstrap_indices

# The six weights that the wild bootstrap uses for few folds.
SIX_POINT = (-1.5, -1.0, -0.5, 0.5, 1.0, 1.5)
FEW_FOLDS = 13


def compute_block_length(n: int) -> int:
    return max(1, math.floor(round(n ** (1 / 3), 9)))


def block_indices(n: int, length: int, rng: HashDraws) -> np.ndarray:
    """Row positions of a moving-block resample of n rows."""
    length = min(length, n)
    starts = rng.integers(0, n - length + 1, -(-n // length))
    return (starts[:, None] + np.arange(length)).ravel()[:n]


@lru_cache(64)
def block_draws(n: int, length: int, n_bootstrap: int, seed: int) -> np.ndarray:
    """Replicate by row: the positions of all resamples of n rows."""
    rng = HashDraws(seed, n, length)
    length = min(length, n)
    starts = rng.integers(0, n - length + 1, (n_bootstrap, -(-n // length)))
    return (starts[:, :, None] + np.arange(length)).reshape(n_bootstrap, -1)[:, :n]


@lru_cache(64)
def wild_weights(n: int, kind: str, n_bootstrap: int, seed: int) -> np.ndarray:
    """Replicate by fold: random signs, or the six-point weights."""
    values = np.array({"webb": SIX_POINT, "rademacher": (-1.0, 1.0)}[kind])
    return values[HashDraws(seed, n).integers(0, len(values), (n_bootstrap, n))]


def moving_block_bootstrap(df: DataFrame, value: str, by: list[str], order: list[str], statistic: Callable[[np.ndarray], float] = np.mean, n_bootstrap: int = 100, block_length: int | str = "auto", alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(by, estimate, ci_lower, ci_upper, std_error, n_valid, block_length): any statistic of a series on moving-block resamples; failing draws are left out.

    One series is one group; null below two rows or two valid draws.
    """
    kinds = dict(df.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.dropna(subset=[value]).sort_values(order)[value].to_numpy(float)
        n = len(y)
        length = compute_block_length(n) if block_length == "auto" else int(block_length)
        draws = []
        for at in block_draws(n, length, n_bootstrap, seed) if n > 1 else ():
            try:
                draws.append(float(statistic(y[at])))
            except (ValueError, ZeroDivisionError, FloatingPointError):
                continue
        d = np.array([v for v in draws if np.isfinite(v)])
        ok = len(d) > 1
        lo, hi = np.percentile(d, [50 * alpha, 100 - 50 * alpha]) if ok else (None, None)
        row = (*key, float(statistic(y)) if n else None, lo, hi, float(d.std(ddof=1)) if ok else None, len(d), length)
        return pd.DataFrame([row], columns=[*by, "estimate", "ci_lower", "ci_upper", "std_error", "n_valid", "block_length"])

    schema = ", ".join([*[f"`{b}` {kinds[b]}" for b in by], "estimate double, ci_lower double, ci_upper double, std_error double, n_valid int, block_length int"])
    rows = df.select(*by, *order, value)
    return rows.groupBy(*by).applyInPandas(run, schema) if by else rows.groupBy().applyInPandas(lambda p: run((), p), schema)


def bootstrap_ci_mean(df: DataFrame, value: str, by: list[str], order: list[str], **options) -> DataFrame:
    return moving_block_bootstrap(df, value, by, order, np.mean, **options)


def _mean_size(e: np.ndarray) -> float:
    return float(np.abs(e).mean())


def bootstrap_ci_mae(df: DataFrame, errors: str, by: list[str], order: list[str], **options) -> DataFrame:
    return moving_block_bootstrap(df, errors, by, order, _mean_size, **options)


def wild_cluster_bootstrap(df: DataFrame, statistic: str, fold: str, by: list[str], n_bootstrap: int = 999, weight_type: str = "auto", alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(by, estimate, std_error, ci_lower, ci_upper, p_value, n_folds, weight_type) of the mean of fold statistics, by random
    signs or six-point weights; p is the share of centred draws at least as large as the estimate.

    The folds of a series are one array; the series of an Arrow batch that have equally many take one matrix product.
    """
    kinds = dict(df.dtypes)
    names = ["estimate", "std_error", "ci_lower", "ci_upper", "p_value"]
    pairs = F.array_sort(F.collect_list(F.struct(F.col(fold).alias("f"), F.col(statistic).cast("double").alias("s"))))
    rows = df.groupBy(*by).agg(F.filter(F.transform(pairs, lambda x: x["s"]), lambda v: v.isNotNull()).alias("_x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                pdf = whole.iloc[at : at + 1024].reset_index(drop=True)
                sizes = pdf["_x"].map(len).to_numpy()
                got = np.full((len(pdf), len(names)), np.nan)
                words = np.array([("webb" if n < FEW_FOLDS else "rademacher") if weight_type == "auto" else weight_type for n in sizes], object)
                for n in np.unique(sizes[sizes > 0]):
                    some = np.flatnonzero(sizes == n)
                    x = np.array([list(v) for v in pdf["_x"].iloc[some]], float)
                    est = x.mean(axis=1)
                    got[some, 0] = est
                    if n > 1:
                        d = x @ wild_weights(int(n), words[some[0]], n_bootstrap, seed).T / n
                        got[some, 1], (got[some, 2], got[some, 3]) = d.std(axis=1, ddof=1), np.percentile(d, [50 * alpha, 100 - 50 * alpha], axis=1)
                        share = (np.abs(d - d.mean(axis=1, keepdims=True)) >= np.abs(est)[:, None]).mean(axis=1)
                        got[some, 4] = np.where(np.abs(est) < 1e-15, 1.0, share)
                yield pdf[by].assign(**{c: got[:, k] for k, c in enumerate(names)}, n_folds=sizes.astype(np.int32), weight_type=words)

    schema = ", ".join([*[f"`{b}` {kinds[b]}" for b in by], *[f"{c} double" for c in names], "n_folds int, weight_type string"])
    out = rows.mapInPandas(run, schema)
    return out.select(*by, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names], "n_folds", "weight_type")


# --- bagging ---


class MovingBlockBootstrap:
    """Resamples of overlapping blocks."""

    def __init__(self, block_length: int | None = None) -> None:
        self.block_length = block_length

    def sample(self, x: np.ndarray, y: np.ndarray, rng: HashDraws):
        """(rows of x, y, columns of x) of one replicate."""
        at = block_indices(len(y), self.block_length or max(1, int(round(len(y) ** (1 / 3), 9))), rng)
        return x[at], y[at], np.arange(x.shape[1])


class StationaryBootstrap:
    """Resamples of circular blocks of geometric length."""

    def __init__(self, expected_block_length: float | None = None) -> None:
        self.expected = expected_block_length

    def sample(self, x: np.ndarray, y: np.ndarray, rng: HashDraws):
        at = stationary_bootstrap_indices(len(y), self.expected or max(1.0, len(y) ** (1 / 3)), rng)
        return x[at], y[at], np.arange(x.shape[1])


class FeatureBagging:
    """All rows, a random part of the columns."""

    def __init__(self, max_features: float = 0.7) -> None:
        if not 0 < max_features <= 1:
            raise ValueError("max_features must be in (0, 1]")
        self.max_features = max_features

    def sample(self, x: np.ndarray, y: np.ndarray, rng: HashDraws):
        k = max(1, int(self.max_features * x.shape[1]))
        cols = np.sort(rng.choice(x.shape[1], k, replace=False))
        return x[:, cols], y, cols


def loess(y: np.ndarray, at: np.ndarray, x: np.ndarray, span: int, weights: np.ndarray) -> np.ndarray:
    """Locally linear fits of y over x at the points `at`, by tricube weights of the span nearest points."""
    out = np.empty(len(at))
    for k, p in enumerate(at):
        d = np.abs(x - p)
        reach = np.partition(d, min(span, len(d)) - 1)[min(span, len(d)) - 1]
        reach *= max(1.0, span / len(x))
        w = np.clip(1 - (d / max(reach, 1e-12)) ** 3, 0, 1) ** 3 * weights
        s = w.sum()
        if s <= 0:
            out[k] = y.mean()
            continue
        mx, my = (w @ x) / s, (w @ y) / s
        v = w @ (x - mx) ** 2
        out[k] = my + ((w @ ((x - mx) * (y - my))) / v * (p - mx) if v > 1e-9 * s else 0.0)
    return out


def stl(y: np.ndarray, period: int, robust: bool = True, inner_iter: int = 2, outer_iter: int = 3, seasonal: int = 7, trend: int | None = None, low_pass: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, season and rest by loess (Cleveland et al. 1990); seasonal, trend and low_pass are the spans of the smoothers."""
    n = len(y)
    if min(seasonal, trend or 3, low_pass or 3) < 3:
        raise ValueError("spans must be 3 at least")
    x = np.arange(n, dtype=float)
    span = trend or int(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    span += span % 2 == 0
    low = low_pass or period + (period % 2 == 0)
    inner, outer = inner_iter, outer_iter
    level, season, weight = np.zeros(n), np.zeros(n), np.ones(n)
    for o in range(outer if robust else 1):
        for _ in range(inner):
            cycle = np.empty(n + 2 * period)
            detrended = y - level
            for k in range(period):
                at = np.arange(k, n, period)
                t = np.arange(len(at), dtype=float)
                fit = loess(detrended[at], np.arange(-1, len(at) + 1, dtype=float), t, seasonal, weight[at])
                cycle[k : k + period * (len(at) + 2) : period][: len(fit)] = fit
            box = lambda v, m: np.convolve(v, np.ones(m) / m, "valid")
            smooth = box(box(box(cycle, period), period), 3)
            smooth = loess(smooth, x[: len(smooth)], x[: len(smooth)], low, np.ones(len(smooth)))
            season = cycle[period : period + n] - smooth[:n]
            level = loess(y - season, x, x, span, weight)
        rest = y - level - season
        if robust and o < outer - 1:
            h = 6 * np.median(np.abs(rest))
            weight = np.clip(1 - (np.abs(rest) / max(h, 1e-12)) ** 2, 0, 1) ** 2
    return level, season, y - level - season


@lru_cache(4)
def _parts(y: bytes, period: int, robust: bool, options: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """stl, once for all replicates of a target."""
    return stl(np.frombuffer(y), period, robust, **dict(options))


class ResidualBootstrap:
    """Targets rebuilt from trend, season and block-resampled rests; stl_kwargs are further settings of stl."""

    def __init__(self, seasonal_period: int | None = None, block_length: int | None = None, robust: bool = True, stl_kwargs: dict | None = None) -> None:
        self.period, self.block_length, self.robust, self.options = seasonal_period, block_length, robust, dict(stl_kwargs or {})

    def sample(self, x: np.ndarray, y: np.ndarray, rng: HashDraws):
        n = len(y)
        period = self.period or min(52, max(2, n // 2 - 1))
        if period >= n // 2:
            period = max(2, n // 3)
        trend, season, rest = _parts(np.ascontiguousarray(y, float).tobytes(), period, self.robust, tuple(sorted(self.options.items())))
        return x, trend + season + rest[block_indices(n, self.block_length or compute_block_length(n), rng)], np.arange(x.shape[1])


class TimeSeriesBagger:
    """Models fitted to resamples of one training frame; each replicate is one task row, predictions meet by aggregation."""

    def __init__(self, base_model, strategy, n_estimators: int = 20, aggregation: str = "mean", seed: int = 0) -> None:
        if aggregation not in ("mean", "median"):
            raise ValueError(f"unknown aggregation {aggregation!r}")
        self.base, self.strategy, self.n, self.aggregation, self.seed = base_model, strategy, n_estimators, aggregation, seed

    def fit(self, train: DataFrame, features: list[str], target: str, order: list[str]) -> TimeSeriesBagger:
        """Bring the training rows (bounded by one series' length) to the driver as arrays; models are fitted on the executors."""
        pdf = train.select(*order, *features, target).orderBy(*order).toPandas()
        self.features, self.x, self.y = features, pdf[features].to_numpy(float), pdf[target].to_numpy(float)
        return self

    def replicate_predictions(self, rows: DataFrame, key: list[str]) -> DataFrame:
        """(key, estimator, prediction): every row by every estimator, in one pass over the rows.

        Estimators are fitted once a worker process from the broadcast training arrays."""
        shared = rows.sparkSession.sparkContext.broadcast((self.base, self.strategy, self.x, self.y, self.n, self.seed))
        features, kinds = self.features, dict(rows.dtypes)

        def run(batches):
            base, strategy, x, y, n, seed = shared.value
            models = []
            for b in range(n):
                xs, ys, cols = strategy.sample(x, y, HashDraws(seed, b))
                models.append((copy.deepcopy(base).fit(xs, ys), cols))
            for pdf in batches:
                z = pdf[features].to_numpy(float)
                for b, (m, cols) in enumerate(models):
                    yield pdf[key].assign(estimator=b, prediction=np.asarray(m.predict(z[:, cols]), float))

        schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in key], "estimator int, prediction double"])
        return rows.select(*dict.fromkeys([*key, *features])).mapInPandas(run, schema)

    def predict(self, rows: DataFrame, key: list[str]) -> DataFrame:
        agg = F.avg("prediction") if self.aggregation == "mean" else F.percentile("prediction", F.lit(0.5))
        return self.replicate_predictions(rows, key).groupBy(*key).agg(agg.alias("prediction"))

    def predict_with_uncertainty(self, rows: DataFrame, key: list[str]) -> DataFrame:
        return self.replicate_predictions(rows, key).groupBy(*key).agg(F.avg("prediction").alias("prediction"), F.stddev_pop("prediction").alias("std"))

    def predict_interval(self, rows: DataFrame, key: list[str], alpha: float = 0.05) -> DataFrame:
        p = lambda q, n: F.percentile("prediction", F.lit(q)).alias(n)
        return self.replicate_predictions(rows, key).groupBy(*key).agg(F.avg("prediction").alias("prediction"), p(alpha / 2, "lower"), p(1 - alpha / 2, "upper"))


def create_block_bagger(base_model, n_estimators: int = 20, block_length: int | None = None, aggregation: str = "mean", seed: int = 0) -> TimeSeriesBagger:
    return TimeSeriesBagger(base_model, MovingBlockBootstrap(block_length), n_estimators, aggregation, seed)


def create_stationary_bagger(base_model, n_estimators: int = 20, expected_block_length: float | None = None, aggregation: str = "mean", seed: int = 0) -> TimeSeriesBagger:
    return TimeSeriesBagger(base_model, StationaryBootstrap(expected_block_length), n_estimators, aggregation, seed)


def create_feature_bagger(base_model, n_estimators: int = 20, max_features: float = 0.7, aggregation: str = "mean", seed: int = 0) -> TimeSeriesBagger:
    return TimeSeriesBagger(base_model, FeatureBagging(max_features), n_estimators, aggregation, seed)


def create_residual_bagger(base_model, seasonal_period: int | None = None, block_length: int | None = None, robust: bool = True, n_estimators: int = 50, aggregation: str = "mean", seed: int = 0, stl_kwargs: dict | None = None) -> TimeSeriesBagger:
    return TimeSeriesBagger(base_model, ResidualBootstrap(seasonal_period, block_length, robust, stl_kwargs), n_estimators, aggregation, seed)


def check_bootstrap_strategy(strategy, n_samples: int = 40, n_boot: int = 5) -> None:
    """Raise AssertionError unless resamples have the right shapes, repeat with their seed and differ with another."""
    rng = HashDraws(0)
    x, y = rng.standard_normal(n_samples * 4).reshape(n_samples, 4), rng.standard_normal(n_samples)
    one = [strategy.sample(x, y, HashDraws(1, b)) for b in range(n_boot)]
    two = [strategy.sample(x, y, HashDraws(1, b)) for b in range(n_boot)]
    other = [strategy.sample(x, y, HashDraws(2, b)) for b in range(n_boot)]
    assert all(len(a[0]) == len(a[1]) == n_samples and a[0].shape[1] == len(a[2]) for a in one), "shapes"
    same = lambda p, q: all(np.array_equal(a[k], b[k]) for a, b in zip(p, q, strict=True) for k in range(3))
    assert same(one, two), "not the same with the same seed"
    assert not same(one, other), "the same with another seed"
