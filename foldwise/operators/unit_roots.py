"""Stationarity tests and lag selection, one series a group, in numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.special import norm_cdf, norm_ppf

#: Rows that the tests and the selection need.
LEAST, LEAST_LAGS = 20, 10

# MacKinnon's (1994, 2010) response surfaces for one variable, by trend: the bounds of the statistic, the
# coefficients of the p-value below and above tau_star, and the 1, 5 and 10 % values as polynomials in 1/n.
MACKINNON = {
    "n": {"max": math.inf, "min": -19.04, "star": -1.04, "small": (0.6344, 1.2378, 0.032496), "large": (0.4797, 0.93557, -0.06999, 0.033066), "crit": ((-2.56574, -2.2358, -3.627, 0.0), (-1.94100, -0.2686, -3.365, 31.223), (-1.61682, 0.2656, -2.714, 25.364))},
    "c": {"max": 2.74, "min": -18.83, "star": -1.61, "small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368), "crit": ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.040), (-2.56677, -1.5384, -2.809, 0.0))},
    "ct": {"max": 0.7, "min": -16.18, "star": -2.89, "small": (3.2512, 1.6047, 0.049588), "large": (2.5261, 0.61654, -0.37956, -0.060285), "crit": ((-3.95877, -9.0531, -28.428, -134.155), (-3.41049, -4.3904, -9.036, -45.374), (-3.12705, -2.5856, -3.925, -22.380))},
    "ctt": {"max": 0.54, "min": -17.17, "star": -3.21, "small": (4.0003, 1.658, 0.048288), "large": (3.0778, 0.49529, -0.41477, -0.059359), "crit": ((-4.37113, -11.5882, -35.819, -334.047), (-3.83239, -5.9057, -12.490, -118.284), (-3.55326, -3.6596, -5.293, -63.559))},
}
# Critical values of the KPSS statistic at 10, 5, 2.5 and 1 %.
KPSS = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}


def mackinnon_p(stat: float, trend: str) -> float:
    t = MACKINNON[trend]
    if stat > t["max"]:
        return 1.0
    if stat < t["min"]:
        return 0.0
    c = t["small"] if stat <= t["star"] else t["large"]
    return norm_cdf(sum(v * stat**k for k, v in enumerate(c)))


def _trend(n: int, kind: str) -> np.ndarray:
    t = np.arange(1, n + 1, dtype=float)
    return np.column_stack([np.ones(n), t, t * t])[:, : {"n": 0, "c": 1, "ct": 2, "ctt": 3}[kind]]


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    r = y - x @ b
    return b, float(r @ r), np.linalg.pinv(x.T @ x)


def adf(y: np.ndarray, max_lags: int | None = None, trend: str = "c", choose: bool = True) -> tuple[float, float, int]:
    """(statistic, p, lags) of the augmented Dickey-Fuller regression; lags by AIC over a common sample unless fixed."""
    n = len(y)
    d = np.diff(y)
    k = {"n": 0, "c": 1, "ct": 2, "ctt": 3}[trend]
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - k - 1) if max_lags is None else max_lags

    def design(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(skip, len(d))
        return np.column_stack([y[rows], *[d[rows - j] for j in range(1, lags + 1)], _trend(len(rows), trend)]), d[rows]

    lags = most
    if choose and max_lags is None:
        best = math.inf
        for p in range(most + 1):
            x, z = design(p, most)
            ssr = max(_ols(x, z)[1], 1e-300)
            aic = len(z) * math.log(ssr / len(z)) + 2 * x.shape[1]
            if aic < best - 1e-12:
                best, lags = aic, p
    x, z = design(lags, lags)
    b, ssr, inv = _ols(x, z)
    se = math.sqrt(max(ssr / (len(z) - x.shape[1]) * inv[0, 0], 0.0))
    stat = float(b[0] / se) if se > 0 else -math.inf if b[0] < 0 else math.inf
    return stat, mackinnon_p(stat, trend), lags


def kpss(y: np.ndarray, trend: str = "c", nlags: int | str = "auto") -> tuple[float, float, int]:
    """(statistic, p within 0.01 to 0.1, lags); automatic lags after Hobijn et al. (1998)."""
    n = len(y)
    x = _trend(n, trend)
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    if nlags == "auto":
        cov = int(n ** (2 / 9))
        s0 = e @ e / n
        s1 = 0.0
        for j in range(1, cov + 1):
            p = e[j:] @ e[:-j] / (n / 2)
            s0, s1 = s0 + p, s1 + j * p
        lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1) if s0 else 0
    else:
        lags = int(math.ceil(12 * (n / 100) ** 0.25)) if nlags == "legacy" else int(nlags)
    lrv = e @ e
    for j in range(1, lags + 1):
        lrv += 2 * (1 - j / (lags + 1)) * (e[j:] @ e[:-j])
    stat = float((np.cumsum(e) ** 2).sum() / n / lrv) if lrv > 0 else math.inf
    return stat, float(np.interp(stat, KPSS[trend], (0.10, 0.05, 0.025, 0.01))), lags


def _per_series(df: DataFrame, value: str, by: list[str], order: list[str], f, schema: str, names: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *f(pdf.dropna(subset=[value]).sort_values(order)[value].to_numpy(float)))], columns=[*by, *names])

    ddl = ", ".join([*[f"`{b}` {kinds[b]}" for b in by], schema])
    rows = df.select(*by, *order, value)
    return rows.groupBy(*by).applyInPandas(run, ddl) if by else rows.groupBy().applyInPandas(lambda p: run((), p), ddl)


_TEST = "statistic double, p_value double, lags int, is_stationary boolean"
_NAMES = ["statistic", "p_value", "lags", "is_stationary"]


def adf_test(df: DataFrame, value: str, by: list[str], order: list[str], max_lags: int | None = None, regression: str = "c", alpha: float = 0.05) -> DataFrame:
    """(by, statistic, p_value, lags, is_stationary); nulls below LEAST rows."""

    def one(y):
        if len(y) < LEAST:
            return None, None, None, None
        s, p, k = adf(y, max_lags, regression)
        return s, p, k, p < alpha

    return _per_series(df, value, by, order, one, _TEST, _NAMES)


def pp_test(df: DataFrame, value: str, by: list[str], order: list[str], regression: str = "c", alpha: float = 0.05) -> DataFrame:
    """The Dickey-Fuller regression without lags, which is what users of this test get (no Newey-West correction)."""
    return adf_test(df, value, by, order, 0, regression, alpha)


def kpss_test(df: DataFrame, value: str, by: list[str], order: list[str], regression: str = "c", nlags: int | str = "auto", alpha: float = 0.05) -> DataFrame:
    def one(y):
        if len(y) < LEAST:
            return None, None, None, None
        s, p, k = kpss(y, regression, nlags)
        return s, p, k, p >= alpha

    return _per_series(df, value, by, order, one, _TEST, _NAMES)


def check_stationarity(df: DataFrame, value: str, by: list[str], order: list[str], alpha: float = 0.05, regression: str = "c") -> DataFrame:
    """(by, adf_p, kpss_p, conclusion): stationary, difference_stationary, non_stationary or insufficient_evidence, by which tests reject."""

    def one(y):
        if len(y) < LEAST:
            return None, None, None
        a, k = adf(y, None, regression)[1], kpss(y, regression)[1]
        reject_root, reject_level = a < alpha, k < alpha
        word = {(True, False): "stationary", (False, True): "non_stationary", (True, True): "difference_stationary", (False, False): "insufficient_evidence"}
        return a, k, word[reject_root, reject_level]

    return _per_series(df, value, by, order, one, "adf_p double, kpss_p double, conclusion string", ["adf_p", "kpss_p", "conclusion"])


def difference_until_stationary(df: DataFrame, value: str, by: list[str], order: list[str], max_diff: int = 2, alpha: float = 0.05) -> DataFrame:
    """(by, d, values): the fewest differences after which the unit root is rejected; null if max_diff don't do."""

    def one(y):
        for d in range(max_diff + 1):
            x = np.diff(y, d)
            if len(x) >= LEAST and adf(x)[1] < alpha:
                return d, x.tolist()
        return None, None

    return _per_series(df, value, by, order, one, "d int, values array<double>", ["d", "values"])


# --- lag selection ---


def compute_max_lag(n: int, max_lag: int | None = None) -> int:
    if max_lag is not None:
        return max(1, min(max_lag, n // 2 - 1))
    return max(1, min(int(10 * math.log10(n)), n // 4, n // 2 - 1))


def pacf(y: np.ndarray, lags: int) -> np.ndarray:
    """Partial autocorrelations from Levinson's recursion on autocovariances divided by n - lag."""
    x = y - y.mean()
    n = len(x)
    r = np.array([x[k:] @ x[: n - k] / (n - k) for k in range(lags + 1)])
    out, phi, err = [], np.empty(0), r[0]
    for k in range(1, lags + 1):
        a = (r[k] - phi @ r[k - 1 : 0 : -1]) / err if err > 0 else 0.0
        phi = np.append(phi - a * phi[::-1], a)
        err *= 1 - a * a
        out.append(a)
    return np.array(out)


def information_criteria(y: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """AIC and BIC of autoregressions of 1 to `lags` lags, each on its own rows, by the Gaussian likelihood."""
    aic, bic = [], []
    for p in range(1, lags + 1):
        z = y[p:]
        x = np.column_stack([np.ones(len(z)), *[y[p - j : len(y) - j] for j in range(1, p + 1)]])
        m = len(z)
        llf = -m / 2 * (math.log(2 * math.pi) + math.log(max(_ols(x, z)[1] / m, 1e-300)) + 1)
        k = p + 2
        aic.append(-2 * llf + 2 * k)
        bic.append(-2 * llf + math.log(m) * k)
    return np.array(aic), np.array(bic)


def choose_lag(y: np.ndarray, method: str, max_lag: int | None, alpha: float) -> tuple[int | None, dict[int, float] | None]:
    if method not in ("aic", "bic", "pacf"):
        raise ValueError(f"unknown method {method!r}")
    if len(y) < LEAST_LAGS:
        return None, None
    most = compute_max_lag(len(y), max_lag)
    if method == "pacf":
        v = pacf(y, most)
        big = np.abs(v) > norm_ppf(1 - alpha / 2) / math.sqrt(len(y))
        best = int(np.argmin(big)) if not big.all() else most
    else:
        v = information_criteria(y, most)[method == "bic"]
        best = int(v.argmin()) + 1
    return best, {k + 1: float(x) for k, x in enumerate(v)}


def auto_select_lag(df: DataFrame, value: str, by: list[str], order: list[str], method: str = "bic", max_lag: int | None = None, alpha: float = 0.05) -> DataFrame:
    """(by, lag, criterion): criterion maps each lag to its value."""
    return _per_series(df, value, by, order, lambda y: choose_lag(y, method, max_lag, alpha), "lag int, criterion map<int,double>", ["lag", "criterion"])


def select_lag_pacf(df: DataFrame, value: str, by: list[str], order: list[str], max_lag: int | None = None, alpha: float = 0.05) -> DataFrame:
    """The longest run of lags from 1 on whose partial autocorrelation is significant."""
    return auto_select_lag(df, value, by, order, "pacf", max_lag, alpha)


def select_lag_aic(df: DataFrame, value: str, by: list[str], order: list[str], max_lag: int | None = None) -> DataFrame:
    return auto_select_lag(df, value, by, order, "aic", max_lag)


def select_lag_bic(df: DataFrame, value: str, by: list[str], order: list[str], max_lag: int | None = None) -> DataFrame:
    return auto_select_lag(df, value, by, order, "bic", max_lag)


def suggest_cv_gap(df: DataFrame, value: str, by: list[str], order: list[str], horizon: int = 1, method: str = "bic") -> DataFrame:
    return auto_select_lag(df, value, by, order, method).select(*by, F.greatest(F.lit(horizon), "lag").alias("gap"))
