"""What users plug in (models, resamplers, forecasters, volatility estimators), and operators as objects with settings."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol, runtime_checkable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.draws import HashDraws
from foldwise.operators import compare, conformal, metrics, models, regimes
from foldwise.operators.splits import CrossFitCV


@runtime_checkable
class SupportsFitPredict(Protocol):
    def fit(self, x: np.ndarray, y: np.ndarray): ...

    def predict(self, x: np.ndarray) -> np.ndarray: ...


@runtime_checkable
class SupportsBootstrap(Protocol):
    def sample(self, x: np.ndarray, y: np.ndarray, rng: HashDraws): ...


BootstrapStrategy = SupportsBootstrap


@runtime_checkable
class SupportsForecast(Protocol):
    def forecast(self, train: DataFrame, test: DataFrame) -> DataFrame: ...


@runtime_checkable
class VolatilityEstimator(Protocol):
    def estimate(self, df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame: ...


class RollingVolatility:
    def __init__(self, window: int = 13, min_periods: int | None = None) -> None:
        self.window, self.min_periods = window, min_periods

    def estimate(self, df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
        return metrics.rolling_volatility(df, value, by, order, self.window, self.min_periods)


class EWMAVolatility:
    """adjust is kept for callers that set it; it changes nothing."""

    def __init__(self, span: int = 13, adjust: bool = True) -> None:
        self.span, self.adjust = span, adjust

    def estimate(self, df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
        return regimes.ewma_volatility(df, value, by, order, self.span)


class GARCHVolatility:
    def __init__(self, p: int = 1, q: int = 1) -> None:
        self.p, self.q = p, q

    def estimate(self, df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
        return regimes.garch_volatility(df, value, by, order, p=self.p, q=self.q)


class CrossFitter:
    """Cross-fitting of one splitter: out-of-fold predictions and residuals of any model."""

    def __init__(self, cv: CrossFitCV | None = None) -> None:
        self.cv = cv or CrossFitCV()

    def fit_predict(self, df: DataFrame, model: SupportsFitPredict, features: list[str], target: str, by: list[str], order: list[str]) -> DataFrame:
        return models.crossfit_predict(df, model, features, target, by, order, self.cv).drop("residual")

    def fit_predict_residuals(self, df: DataFrame, model: SupportsFitPredict, features: list[str], target: str, by: list[str], order: list[str]) -> DataFrame:
        return models.crossfit_predict(df, model, features, target, by, order, self.cv).drop("prediction")


class NestedWalkForwardCV:
    """A nested parameter search; fit keeps the folds' rows, get_result returns them, predict refits the winner on all rows."""

    def __init__(self, make_model: Callable[..., SupportsFitPredict], param_grid: dict, n_outer_splits: int = 3, n_inner_splits: int = 5, horizon: int = 1, extra_gap: int = 0, n_iter: int | None = None) -> None:
        self.make, self.grid = make_model, param_grid
        self.options = {"n_outer_splits": n_outer_splits, "n_inner_splits": n_inner_splits, "horizon": horizon, "extra_gap": extra_gap, "n_iter": n_iter}

    def fit(self, df: DataFrame, features: list[str], target: str, order: list[str]) -> NestedWalkForwardCV:
        import ast

        self.result = models.nested_walk_forward(df, self.make, self.grid, features, target, [], order, **self.options)
        best = self.result.select("best_params").limit(1).collect()
        if not best:
            raise ValueError("the series is too short for the folds")
        self.best_params = dict(ast.literal_eval(best[0][0]))
        pdf = df.select(*order, *features, target).orderBy(*order).toPandas()
        self.features = features
        self.model = self.make(**self.best_params).fit(pdf[features].to_numpy(float), pdf[target].to_numpy(float))
        return self

    def get_result(self) -> DataFrame:
        return self.result

    def predict(self, df: DataFrame, key: list[str]) -> DataFrame:
        """(key, prediction) in Arrow batches, with the refitted model in the closure."""
        model, features, kinds = self.model, self.features, dict(df.dtypes)

        def run(batches):
            for pdf in batches:
                yield pdf[key].assign(prediction=np.asarray(model.predict(pdf[features].to_numpy(float)), float))

        schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in key], "prediction double"])
        return df.select(*dict.fromkeys([*key, *features])).mapInPandas(run, schema)


class AdaptiveConformalPredictor:
    """Adaptive conformal inference over ordered rows; streams use foldwise.streaming.online."""

    def __init__(self, alpha: float = 0.05, gamma: float = 0.1) -> None:
        self.alpha, self.gamma = alpha, gamma

    def run(self, df: DataFrame, error: Column, by: list[str], order: list[str], q0: float | str) -> DataFrame:
        return conformal.adaptive_conformal(df, error, by, order, q0, self.alpha, self.gamma)

    def update(self, q: float, prediction: float, actual: float) -> float:
        return conformal.aci_step(q, abs(actual - prediction), self.alpha, self.gamma)


class BellmanConformalPredictor(conformal.Bellman):
    """The Bellman predictor of one series, from calibration residuals."""

    def solve_optimal_sequence(self, n_steps: int) -> np.ndarray:
        return self.sequence(n_steps)

    def predict_intervals_batch(self, predictions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = self.sequence(len(predictions))
        return np.asarray(predictions) - q, np.asarray(predictions) + q


class BootstrapUncertainty:
    def __init__(self, n_bootstrap: int = 100, alpha: float = 0.05, seed: int = 42) -> None:
        self.n_bootstrap, self.alpha, self.seed = n_bootstrap, alpha, seed

    def predict_interval(self, df: DataFrame, predictions: str, residuals: DataFrame, residual: str, key: list[str]) -> DataFrame:
        return conformal.bootstrap_uncertainty(df, predictions, residuals, residual, key, self.n_bootstrap, self.alpha, self.seed)


class MultiSeriesAdapter(compare.ForecastAdapter):
    """Any adapter over many series, which all adapters here take anyway; series that fail get null."""

    def __init__(self, base_adapter: SupportsForecast) -> None:
        self.base, self.name = base_adapter, f"{base_adapter.name}_multi"

    def forecast(self, train: DataFrame, test: DataFrame) -> DataFrame:
        return self.base.forecast(train, test)

    def get_params(self) -> dict:
        return self.base.get_params()


class ProgressAdapter(MultiSeriesAdapter):
    """Calls back with (series done, all series) once the forecasts are counted; stages show finer progress in Spark's own listeners."""

    def __init__(self, base_adapter: SupportsForecast, progress_callback: Callable[[int, int], None]) -> None:
        super().__init__(base_adapter)
        self.callback = progress_callback

    def forecast(self, train: DataFrame, test: DataFrame) -> DataFrame:
        out = super().forecast(train, test)
        done = out.where("prediction is not null").agg(F.count_distinct("series_id")).first()[0]
        self.callback(done, test.agg(F.count_distinct("series_id")).first()[0])
        return out


def StatsforecastAdapter(model: str = "AutoAR", season_length: int = 1, **options) -> compare.ForecastAdapter:  # noqa: N802
    return compare.statsforecast_adapter(model, season_length, **options)
