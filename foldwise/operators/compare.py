"""Comparing forecasting models over panels: adapters, metrics, ranking, baselines, reports.

A dataset is a long panel (series_id, idx, y) with a split point: rows with idx < train_end train, the others test. Adapters
forecast a series at a time; simple ones are joins and aggregates, the others numpy kernels per series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.accuracy_tests import dm_test


class ForecastAdapter:
    """forecast(train, test) gives test's (series_id, idx) with a prediction each."""

    name = "adapter"

    def forecast(self, train: DataFrame, test: DataFrame) -> DataFrame:
        raise NotImplementedError

    def get_params(self) -> dict:
        return {}


class NaiveAdapter(ForecastAdapter):
    """The last training value."""

    name = "Naive"

    def forecast(self, train: DataFrame, test: DataFrame) -> DataFrame:
        last = train.groupBy("series_id").agg(F.max_by("y", "idx").alias("prediction"))
        return test.select("series_id", "idx").join(last, "series_id")


class SeasonalNaiveAdapter(ForecastAdapter):
    """The value of the same place in the last training season; the last value where a series is shorter than that."""

    def __init__(self, season_length: int = 52) -> None:
        self.season, self.name = season_length, f"SeasonalNaive_{season_length}"

    def forecast(self, train: DataFrame, test: DataFrame) -> DataFrame:
        size = train.groupBy("series_id").agg((F.max("idx") + 1).alias("_n"), F.max_by("y", "idx").alias("_last"))
        at = F.col("_n") - self.season + (F.col("idx") - F.col("_n")) % self.season
        rows = test.select("series_id", "idx").join(size, "series_id").withColumn("_at", at)
        past = train.select("series_id", F.col("idx").alias("_at"), F.col("y").alias("_y"))
        return rows.join(past, ["series_id", "_at"], "left").select("series_id", "idx", F.coalesce("_y", "_last").alias("prediction"))

    def get_params(self) -> dict:
        return {"season_length": self.season}


class HistoricAverageAdapter(ForecastAdapter):
    """The mean of the training values, or of the last `window` of them."""

    def __init__(self, window: int | None = None) -> None:
        self.window, self.name = window, "HistoricAverage" if window is None else f"WindowAverage_{window}"

    def forecast(self, train: DataFrame, test: DataFrame) -> DataFrame:
        if self.window is not None:
            last = F.max("idx").over(Window.partitionBy("series_id"))
            train = train.withColumn("_m", last).where(F.col("idx") > F.col("_m") - self.window)
        return test.select("series_id", "idx").join(train.groupBy("series_id").agg(F.avg("y").alias("prediction")), "series_id")


class KernelAdapter(ForecastAdapter):
    """f(values, steps) for each series in numpy; a series that fails gets no prediction."""

    def __init__(self, name: str, f: Callable[[np.ndarray, int], np.ndarray]) -> None:
        self.name, self.f = name, f

    def forecast(self, train: DataFrame, test: DataFrame) -> DataFrame:
        f, kind = self.f, dict(train.dtypes)["series_id"]

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(b):
                return pd.DataFrame({"series_id": [], "idx": [], "prediction": []})
            b = b.sort_values("at").rename(columns={"key": "series_id", "at": "idx"})[["series_id", "idx"]]
            try:
                p = np.asarray(f(a.sort_values("idx")["y"].to_numpy(float), len(b)), float) if len(a) else np.full(len(b), np.nan)
            except (ValueError, ArithmeticError, IndexError, np.linalg.LinAlgError):
                p = np.empty(0)
            return b.assign(prediction=p if p.shape == (len(b),) else np.nan)

        # both come from one panel, so the right side's columns get names and identities of their own
        right = test.select(F.col("series_id").alias("key"), F.col("idx").alias("at"))
        both = train.select("series_id", "idx", "y").groupBy("series_id").cogroup(right.groupBy("key"))
        out = both.applyInPandas(run, f"series_id {kind}, idx long, prediction double")
        return out.select("series_id", "idx", F.when(~F.isnan("prediction"), F.col("prediction")).alias("prediction"))


def ses(y: np.ndarray, grid: Sequence[float] = tuple(np.linspace(0.01, 0.99, 50))) -> tuple[float, float]:
    """(level after the last value, alpha): simple exponential smoothing of least squared one-step error."""
    best = (math.inf, y[-1], 0.5)
    for a in grid:
        level, sse = y[0], 0.0
        for v in y[1:]:
            sse += (v - level) ** 2
            level += a * (v - level)
        best = min(best, (sse, level, a))
    return float(best[1]), float(best[2])


def theta(y: np.ndarray, steps: int) -> np.ndarray:
    """The standard theta method: half the trend line, half simple smoothing of the other line."""
    t = np.arange(len(y))
    slope = np.polyfit(t, y, 1)[0] if len(y) > 1 else 0.0
    level, a = ses(y)
    n = len(y)
    return level + slope / 2 * (np.arange(steps) + (1 - (1 - a) ** n) / a)


def demand(y: np.ndarray, zeros: bool) -> np.ndarray:
    """The places at which there is demand: where the value isn't zero, or with `zeros` everywhere, as in rows of events."""
    return np.arange(len(y)) if zeros else np.flatnonzero(y)


def croston(y: np.ndarray, steps: int, alpha: float = 0.1, zeros: bool = False) -> np.ndarray:
    """Demand size over interval, both smoothed at demand."""
    at = demand(y, zeros)
    if not len(at):
        return np.zeros(steps)
    size, gap = y[at[0]], at[0] + 1.0
    for i, k in zip(at[1:], np.diff(at), strict=True):
        size += alpha * (y[i] - size)
        gap += alpha * (k - gap)
    return np.full(steps, size / gap)


def adida(y: np.ndarray, steps: int, zeros: bool = False) -> np.ndarray:
    """Aggregate over the mean demand interval, smooth, spread evenly."""
    at = demand(y, zeros)
    if not len(at):
        return np.zeros(steps)
    m = max(1, int(round(np.diff(np.concatenate([[-1], at])).mean())))
    cut = y[len(y) % m :] if len(y) >= m else y
    return np.full(steps, ses(cut.reshape(-1, m).sum(axis=1) if len(cut) % m == 0 else cut)[0] / m)


def imapa(y: np.ndarray, steps: int, zeros: bool = False) -> np.ndarray:
    """The mean of such forecasts over aggregation levels up to the mean demand interval."""
    at = demand(y, zeros)
    if not len(at):
        return np.zeros(steps)
    most = max(1, int(round(np.diff(np.concatenate([[-1], at])).mean())))
    return np.full(steps, np.mean([ses(y[len(y) % m :].reshape(-1, m).sum(axis=1))[0] / m for m in range(1, most + 1)]))


def auto_ets(y: np.ndarray, steps: int, season: int = 1) -> np.ndarray:
    """Additive exponential smoothing; level, damped or linear trend and season chosen by corrected AIC over a grid."""
    n, best = len(y), (math.inf, np.full(steps, y[-1]))
    for phi in (None, 0.9, 1.0):
        for m in (1, season) if season > 1 and n >= 2 * season else (1,):
            for a in (0.1, 0.3, 0.5, 0.8):
                for b in (0.05, 0.2) if phi is not None else (0.0,):
                    for g in (0.1, 0.3) if m > 1 else (0.0,):
                        s = list(y[:m] - y[:m].mean()) if m > 1 else [0.0]
                        level, slope, sse = float(y[:m].mean()), 0.0, 0.0
                        f = phi or 0.0
                        for t in range(m if m > 1 else 1, n):
                            e = y[t] - (level + f * slope + s[t % m])
                            sse += e * e
                            level, slope = level + f * slope + a * e, f * slope + b * e
                            s[t % m] += g * e
                        k = 2 + 2 * (phi is not None) + (m if m > 1 else 0)
                        score = n * math.log(max(sse, 1e-12) / n) + 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1)
                        if score < best[0]:
                            damp = np.cumsum([f ** (h + 1) for h in range(steps)])
                            best = (score, level + slope * damp + np.array([s[(n + h) % m] for h in range(steps)]))
    return best[1]


def auto_arima(y: np.ndarray, steps: int) -> np.ndarray:
    """Autoregressions of 0 to 5 lags on the series or its differences (if the unit root isn't rejected), by corrected AIC."""
    from foldwise.operators.unit_roots import LEAST, adf

    d = int(len(y) >= LEAST and adf(y)[1] >= 0.05)
    z = np.diff(y) if d else y
    n, best = len(z), (math.inf, 0, np.array([z.mean()]))
    for p in range(min(5, n // 4) + 1):
        x = np.column_stack([np.ones(n - p), *[z[p - j : n - j] for j in range(1, p + 1)]])
        b = np.linalg.lstsq(x, z[p:], rcond=None)[0]
        m, k = n - p, p + 2
        score = m * math.log(max(((z[p:] - x @ b) ** 2).sum(), 1e-12) / m) + 2 * k + 2 * k * (k + 1) / max(m - k - 1, 1)
        best = min(best, (score / m, p, b), key=lambda v: v[0])
    _, p, b = best
    path = list(z)
    for _ in range(steps):
        path.append(b[0] + sum(b[j] * path[-j] for j in range(1, p + 1)))
    out = np.array(path[n:])
    return y[-1] + np.cumsum(out) if d else out


def statsforecast_adapter(model: str, season_length: int = 1, window: int = 3, zeros: bool = False) -> ForecastAdapter:
    """An adapter by the usual name of its model. GridETS and AutoAR are smaller than the library's AutoETS and AutoARIMA, which aren't offered.

    The library's models of intermittent demand take a zero as no demand; with `zeros` it is a demand of that size.
    """
    kernels = {"AutoTheta": theta, "CrostonClassic": partial(croston, zeros=zeros), "ADIDA": partial(adida, zeros=zeros), "IMAPA": partial(imapa, zeros=zeros), "AutoAR": auto_arima, "GridETS": lambda y, h: auto_ets(y, h, season_length)}
    if model in kernels:
        return KernelAdapter(model, kernels[model])
    simple = {"Naive": NaiveAdapter, "SeasonalNaive": lambda: SeasonalNaiveAdapter(season_length), "HistoricAverage": HistoricAverageAdapter, "WindowAverage": lambda: HistoricAverageAdapter(window)}
    if model not in simple:
        raise ValueError(f"unknown model {model!r}")
    return simple[model]()


def check_forecast_adapter(adapter: ForecastAdapter, panel: DataFrame, test_size: int = 5) -> None:
    """Raise AssertionError unless every test row gets one finite prediction."""
    train, test = split_panel(panel, test_size)
    got = adapter.forecast(train, test)
    n, good, distinct = got.agg(F.count(F.lit(1)), F.count_if(F.col("prediction").isNotNull() & ~F.isnan("prediction")), F.count_distinct("series_id", "idx")).first()
    assert n == good == distinct == test.count(), "a finite prediction for every row, once"
    assert isinstance(adapter.get_params(), dict)


def split_panel(panel: DataFrame, test_size: int) -> tuple[DataFrame, DataFrame]:
    """(train, test): the last test_size rows of each series test."""
    n = F.max("idx").over(Window.partitionBy("series_id")) + 1
    rows = panel.withColumn("_n", n)
    return rows.where(F.col("idx") < F.col("_n") - test_size).drop("_n"), rows.where(F.col("idx") >= F.col("_n") - test_size).drop("_n")


def run_forecasts(train: DataFrame, test: DataFrame, adapters: Sequence[ForecastAdapter]) -> DataFrame:
    """(model, series_id, idx, prediction, actual) of all adapters; missing predictions stay null."""
    actual = test.select("series_id", "idx", F.col("y").alias("actual"))
    out = None
    for a in adapters:
        rows = actual.join(a.forecast(train, test), ["series_id", "idx"], "left").select(F.lit(a.name).alias("model"), "series_id", "idx", "prediction", "actual")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no adapters")
    return out


def comparison_aggregates() -> dict[str, Column]:
    """Metrics of rows (prediction, actual, dp, da): dp and da are the steps to the row before."""
    e = F.col("prediction") - F.col("actual")
    return {
        "mae": F.avg(F.abs(e)),
        "rmse": F.sqrt(F.avg(e * e)),
        "mape": 100 * F.avg(F.when(F.col("actual") != 0, F.abs(e / F.col("actual")))),
        "direction_accuracy": F.avg((F.signum("dp") == F.signum("da")).cast("double")),
    }


def compute_comparison_metrics(forecasts: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, mae, rmse, mape, direction_accuracy); steps are taken in `order` within `by`.

    With by=[model] and order=[series_id, idx] steps cross from one series to the next, as pooled results always had it;
    with series_id in `by` they don't.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    rows = forecasts.where("prediction is not null and actual is not null")
    rows = rows.withColumn("dp", F.col("prediction") - F.lag("prediction").over(w)).withColumn("da", F.col("actual") - F.lag("actual").over(w))
    return rows.groupBy(*by).agg(*[c.alias(k) for k, c in comparison_aggregates().items()])


def compare_forecasts(forecasts: DataFrame, aggregation_mode: str = "flatten", primary_metric: str = "mae") -> DataFrame:
    """(model, mae, rmse, mape, direction_accuracy, rank): pooled, or the mean or median of the series' own metrics."""
    if aggregation_mode == "flatten":
        out = compute_comparison_metrics(forecasts, ["model"], ["series_id", "idx"])
    elif aggregation_mode in ("per_series_mean", "per_series_median"):
        each = compute_comparison_metrics(forecasts, ["model", "series_id"], ["idx"])
        agg = F.avg if aggregation_mode == "per_series_mean" else lambda c: F.percentile(c, F.lit(0.5))
        out = each.groupBy("model").agg(*[agg(c).alias(c) for c in ("mae", "rmse", "mape", "direction_accuracy")])
    else:
        raise ValueError(f"unknown aggregation mode {aggregation_mode!r}")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last(primary_metric), "model")))


def run_comparison(panel: DataFrame, test_size: int, adapters: Sequence[ForecastAdapter], primary_metric: str = "mae", aggregation_mode: str = "flatten") -> DataFrame:
    train, test = split_panel(panel, test_size)
    return compare_forecasts(run_forecasts(train, test, adapters), aggregation_mode, primary_metric)


def dm_against_best(forecasts: DataFrame, ranking: DataFrame, horizon: int = 1) -> DataFrame:
    """(model, statistic, p_value): absolute errors of the best model against each other one, all series pooled in order."""
    best = ranking.where("rank = 1").select(F.col("model").alias("best"))
    rows = forecasts.withColumn("e", F.col("actual") - F.col("prediction")).select("model", "series_id", "idx", "e")
    top = rows.join(F.broadcast(best), rows["model"] == best["best"], "left_semi").select("series_id", "idx", F.col("e").alias("e_best"))
    others = rows.join(F.broadcast(best), rows["model"] == best["best"], "left_anti")
    return dm_test(others.join(top, ["series_id", "idx"]), "e_best", "e", ["model"], ["series_id", "idx"], h=horizon, loss="absolute").select("model", "n", "statistic", "p_value")


def run_benchmark_suite(datasets: dict[str, tuple[DataFrame, int]], adapters: Sequence[ForecastAdapter], checkpoint_path: str | None = None, primary_metric: str = "mae") -> DataFrame:
    """(dataset, model, metrics, rank) over named (panel, test_size) pairs; with a path each dataset's rows are written there and
    found again on the next run."""
    from foldwise.sources.results import has_checkpoint, load_checkpoint, save_checkpoint

    out = None
    for name, (panel, test_size) in datasets.items():
        if checkpoint_path and has_checkpoint(panel.sparkSession, checkpoint_path, name):
            rows = load_checkpoint(panel.sparkSession, checkpoint_path, name)
        else:
            rows = run_comparison(panel, test_size, adapters, primary_metric).withColumn("dataset", F.lit(name))
            if checkpoint_path:
                save_checkpoint(rows, checkpoint_path, name)
                rows = load_checkpoint(panel.sparkSession, checkpoint_path, name)
        out = rows if out is None else out.unionByName(rows)
    return out


def comparison_report(results: DataFrame) -> DataFrame:
    """(model, wins, n_datasets, mean_mae, mean_rmse): wins and unweighted means over datasets."""
    return results.groupBy("model").agg(F.count_if(F.col("rank") == 1).alias("wins"), F.count(F.lit(1)).alias("n_datasets"), F.avg("mae").alias("mean_mae"), F.avg("rmse").alias("mean_rmse"))


def compare_to_baseline(ranking: DataFrame, model: str, baseline: str = "Naive", metric: str = "mae") -> DataFrame:
    """(model, baseline, model_metric, baseline_metric, improvement_pct, better) from one pass over the ranking."""
    m, b = F.max(F.when(F.col("model") == model, F.col(metric))), F.max(F.when(F.col("model") == baseline, F.col(metric)))
    return ranking.agg(m.alias("model_metric"), b.alias("baseline_metric")).select(
        F.lit(model).alias("model"), F.lit(baseline).alias("baseline"), "model_metric", "baseline_metric",
        F.when(F.col("baseline_metric") > 0, 100 * (1 - F.col("model_metric") / F.col("baseline_metric"))).alias("improvement_pct"),
        (F.col("model_metric") < F.col("baseline_metric")).alias("better"),
    )


def generate_ranking_table(ranking: DataFrame) -> str:
    """Markdown of a ranking (one row a model, so small)."""
    rows = ranking.orderBy("rank").collect()
    head = "| Rank | Model | MAE | RMSE | MAPE | Direction |\n|---|---|---|---|---|---|\n"
    show = lambda v: "-" if v is None else f"{v:.4f}"
    return head + "".join(f"| {r['rank']} | {r['model']} | {show(r['mae'])} | {show(r['rmse'])} | {show(r['mape'])} | {show(r['direction_accuracy'])} |\n" for r in rows)


def generate_summary_table(results: DataFrame) -> str:
    """Markdown of a suite's wins and mean errors, a row a model."""
    rows = comparison_report(results).orderBy(F.desc("wins"), "model").collect()
    return "| Model | Wins | Datasets | Mean MAE |\n|---|---|---|---|\n" + "".join(f"| {r['model']} | {r['wins']} | {r['n_datasets']} | {r['mean_mae']:.4f} |\n" for r in rows)


def generate_benchmark_docs(results: DataFrame, metadata: dict | None = None) -> str:
    """Markdown of a whole suite: summary, then a table a dataset."""
    text = "# Benchmark results\n\n" + "".join(f"- {k}: {v}\n" for k, v in (metadata or {}).items()) + "\n" + generate_summary_table(results)
    for (name,) in results.select("dataset").distinct().orderBy("dataset").collect():
        text += f"\n## {name}\n\n" + generate_ranking_table(results.where(F.col("dataset") == name))
    return text
