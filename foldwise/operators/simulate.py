"""Simulated series and the error bounds that theory gives for them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.draws import HashDraws


def _check_ar(ar: Sequence[float]) -> None:
    """Step down from the last coefficient: an autoregression is stationary if every partial autocorrelation is within (-1, 1)."""
    a = np.asarray(ar, float)
    while len(a):
        last, rest = a[-1], a[:-1]
        if not abs(last) < 1:
            raise ValueError("the autoregression isn't stationary")
        a = (rest + last * rest[::-1]) / (1 - last * last)


def arma(ar: Sequence[float], ma: Sequence[float], n: int, sigma: float, burn: int, rng: HashDraws) -> np.ndarray:
    e = rng.standard_normal(n + burn) * sigma
    shock = np.convolve(e, np.concatenate([[1.0], np.asarray(ma, float)]))[: n + burn]
    y = np.zeros(n + burn)
    a = np.asarray(ar, float)
    for t in range(n + burn):
        k = min(t, len(a))
        y[t] = shock[t] + (a[:k] @ y[t - k : t][::-1] if k else 0.0)
    return y[burn:]


def ar1(phi: float, sigma: float, n: int, rng: HashDraws) -> np.ndarray:
    """AR(1), with a longer start for more persistence."""
    _check_ar([phi])
    return arma([phi], [], n, sigma, max(100, int(10 / (1 - abs(phi)))), rng)


def simulate_arma(spark: SparkSession, ar: Sequence[float], ma: Sequence[float], n: int, n_paths: int = 1, sigma: float = 1.0, burn_in: int | None = None, seed: int = 0) -> DataFrame:
    """(path, idx, y): Gaussian paths, each with its own generator, dealt over the cluster."""
    _check_ar(ar)
    burn = max(100, 10 * (len(ar) + len(ma))) if burn_in is None else burn_in

    def run(batches):
        for b in batches:
            for k in b["id"]:
                yield pd.DataFrame({"path": int(k), "idx": np.arange(n), "y": arma(ar, ma, n, sigma, burn, HashDraws(seed, int(k)))})

    return spark.range(n_paths).mapInPandas(run, "path long, idx long, y double")


def simulate_ar(spark: SparkSession, ar: Sequence[float], n: int, n_paths: int = 1, sigma: float = 1.0, burn_in: int | None = None, seed: int = 0) -> DataFrame:
    return simulate_arma(spark, ar, (), n, n_paths, sigma, burn_in, seed)


def generate_ar1_series(spark: SparkSession, phi: float, sigma: float, n: int, seed: int = 0) -> DataFrame:
    return simulate_ar(spark, [phi], n, sigma=sigma, burn_in=max(100, int(10 / (1 - abs(phi)))) if abs(phi) < 1 else None, seed=seed).drop("path")


def generate_ar2_series(spark: SparkSession, phi1: float, phi2: float, sigma: float, n: int, seed: int = 0) -> DataFrame:
    return simulate_ar(spark, [phi1, phi2], n, sigma=sigma, seed=seed).drop("path")


def theoretical_ar1_mse_bound(phi, sigma_sq, h: int = 1) -> Column:
    """sigma^2 (1 - phi^(2h)) / (1 - phi^2); null outside stationarity."""
    p, s = _lit(phi), _lit(sigma_sq)
    return F.when((F.abs(p) < 1) & (s > 0), s * (1 - F.pow(p, F.lit(2 * h))) / (1 - p * p))


def theoretical_ar1_mae_bound(sigma, phi=0.0, h: int = 1) -> Column:
    s = _lit(sigma)
    return F.sqrt(theoretical_ar1_mse_bound(phi, s * s, h)) * math.sqrt(2 / math.pi)


def theoretical_ar2_mse_bound(phi1, phi2, sigma_sq, h: int = 1) -> Column:
    """sigma^2 times the sum of the first h squared impulse responses; null outside stationarity."""
    a, b = _lit(phi1), _lit(phi2)
    psi, before, total = F.lit(1.0), F.lit(0.0), F.lit(1.0)
    for _ in range(h - 1):
        psi, before = a * psi + b * before, psi
        total = total + psi * psi
    ok = (a + b < 1) & (b - a < 1) & (F.abs(b) < 1)
    return F.when(ok, _lit(sigma_sq) * total)


def check_against_ar1_bounds(model_mse, phi, sigma_sq, h: int = 1, tolerance: float = 1.5) -> tuple[Column, Column]:
    """(ratio to the bound, status): HALT below 1 / tolerance, WARN below 1.2, SKIP without a bound."""
    ratio = _lit(model_mse) / theoretical_ar1_mse_bound(phi, sigma_sq, h)
    return ratio, F.when(ratio.isNull(), "SKIP").when(ratio < 1 / tolerance, "HALT").when(ratio < 1.2, "WARN").otherwise("PASS")


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))


def synthetic_panel(spark: SparkSession, n_obs: int = 200, n_series: int = 1, ar_coef: float = 0.9, noise_std: float = 0.1, seed: int = 42) -> DataFrame:
    """(series_id, idx, y): a panel of AR(1) series."""
    return simulate_ar(spark, [ar_coef], n_obs, n_series, noise_std, seed=seed).select(F.concat(F.lit("s"), F.col("path").cast("string")).alias("series_id"), "idx", "y")
