"""Long-run variances that allow for autocorrelation, by lag windows and one aggregation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.metrics import ordered

KERNELS = ("bartlett", "parzen", "quadratic_spectral")


def bartlett_kernel(lag: int, bandwidth: int) -> float:
    return max(0.0, 1 - abs(lag) / (bandwidth + 1))


def parzen_kernel(lag: int, bandwidth: int) -> float:
    z = abs(lag) / (bandwidth + 1)
    return 1 - 6 * z**2 + 6 * z**3 if z <= 0.5 else max(0.0, 2 * (1 - z) ** 3)


def quadratic_spectral_kernel(lag: int, bandwidth: int) -> float:
    if lag == 0:
        return 1.0
    x = 6 * math.pi * abs(lag) / (5 * (bandwidth + 1))
    return 3 / x**2 * (math.sin(x) / x - math.cos(x))


def kernel_weight(kernel: str, lag: int, bandwidth: int) -> float:
    return {"bartlett": bartlett_kernel, "parzen": parzen_kernel, "quadratic_spectral": quadratic_spectral_kernel}[kernel](lag, bandwidth)


def test_bandwidth(n: int) -> int:
    """The automatic bandwidth of the accuracy tests."""
    return max(1, math.floor(4 * (n / 100) ** (2 / 9)))


test_bandwidth.__test__ = False  # not a test case


def _andrews(n: int, rho: float, kernel: str) -> int:
    rho = min(max(rho, -0.99), 0.99)
    if kernel == "bartlett":
        b = int(1.1447 * (4 * rho**2 / (1 - rho**2) ** 2 * n) ** (1 / 3))
    else:
        b = int((2.6614 if kernel == "parzen" else 1.3221) * (4 * rho**2 / (1 - rho) ** 4 * n) ** (1 / 5))
    return min(max(b, 0), n - 1)


def optimal_bandwidth(df: DataFrame, value: str, order: list[str], method: str = "newey_west", kernel: str = "bartlett") -> int:
    """For one series: floor(n ** (1/3)), or Andrews' plug-in of the first autocorrelation."""
    w = Window.orderBy(*order)
    n, rho = df.select(value, F.lag(value).over(w).alias("_l")).agg(F.count(value), F.corr(value, "_l")).first()
    if method in ("newey_west", "auto"):
        return min(math.floor(round(n ** (1 / 3), 9)), max(n - 1, 0))
    if method != "andrews":
        raise ValueError(f"unknown method {method!r}")
    return _andrews(n, 0.0 if rho is None or math.isnan(rho) else rho, kernel)


def demeaned_lags(df: DataFrame, value: str, by: list[str], order: list[str], lags: int, name: str = "u") -> DataFrame:
    """Adds u (value less its series' mean) and u_1 to u_lags, its lags, in one window pass."""
    mean = F.avg(value).over(Window.partitionBy(*by))
    df = df.withColumn(name, F.col(value) - mean)
    w = ordered(by, order)
    return df.select("*", *[F.lag(name, j).over(w).alias(f"{name}_{j}") for j in range(1, lags + 1)])


def hac_mean_variance(bandwidth: int, name: str = "u") -> Column:
    """Aggregate of demeaned_lags' columns: the variance of the mean as the accuracy tests take it, autocovariances
    being means over the pairs that there are."""
    total = F.avg(F.col(name) * F.col(name))
    for j in range(1, bandwidth + 1):
        total = total + 2 * bartlett_kernel(j, bandwidth) * F.coalesce(F.avg(F.col(name) * F.col(f"{name}_{j}")), F.lit(0.0))
    return total / F.count(name)


def compute_hac_variance(df: DataFrame, value: str, by: list[str], order: list[str], bandwidth: int) -> DataFrame:
    """(by, n, hac_variance) of the mean of each series."""
    return demeaned_lags(df, value, by, order, bandwidth).groupBy(*by).agg(F.count("u").alias("n"), hac_mean_variance(bandwidth).alias("hac_variance"))


def compute_self_normalized_variance(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """(by, n, sn_variance): the sum of squared partial sums of deviations over n squared."""
    u = demeaned_lags(df, value, by, order, 0)
    s = F.sum("u").over(ordered(by, order).rowsBetween(Window.unboundedPreceding, 0))
    n = F.count("_s")
    return u.withColumn("_s", s).groupBy(*by).agg(n.alias("n"), (F.sum(F.col("_s") * F.col("_s")) / (n * n)).alias("sn_variance"))


def long_run_covariance(df: DataFrame, values: list[str], by: list[str], order: list[str], bandwidth: int, kernel: str = "bartlett") -> DataFrame:
    """(by, i, j, covariance): kernel-weighted autocovariances of already centred scores, each divided by n; symmetric.

    One pass over lag columns gives all sums.
    """
    w = ordered(by, order)
    lagged = df.select(*by, *values, *[F.lag(v, h).over(w).alias(f"_{v}_{h}") for v in values for h in range(1, bandwidth + 1)])
    n = F.count(values[0])
    cells = []
    for i, a in enumerate(values):
        for j, b in enumerate(values):
            total = F.sum(F.col(a) * F.col(b))
            for h in range(1, bandwidth + 1):
                k = kernel_weight(kernel, h, bandwidth)
                total = total + k * (F.coalesce(F.sum(F.col(a) * F.col(f"_{b}_{h}")), F.lit(0.0)) + F.coalesce(F.sum(F.col(f"_{a}_{h}") * F.col(b)), F.lit(0.0)))
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (total / n).alias("covariance")))
    return lagged.groupBy(*by).agg(F.array(*cells).alias("c")).select(*by, F.inline("c"))


def newey_west_se(df: DataFrame, value: str, by: list[str], order: list[str], bandwidth: int, kernel: str = "bartlett", prewhiten: bool = False) -> DataFrame:
    """(by, n, lrv, variance, se, dof): of the mean of residuals; prewhitened by an AR(1) whose coefficient is kept within 0.99."""
    rows = demeaned_lags(df, value, by, order, 0)
    n_all = rows.groupBy(*by).agg(F.count("u").alias("n"))
    phi = F.lit(0.0)
    w = ordered(by, order)
    if prewhiten:
        rows = rows.withColumn("_l", F.lag("u").over(w))
        fit = F.sum(F.col("u") * F.col("_l")).over(Window.partitionBy(*by)) / F.sum(F.col("_l") * F.col("_l")).over(Window.partitionBy(*by))
        rows = rows.withColumn("_phi", F.least(F.greatest(fit, F.lit(-0.99)), F.lit(0.99))).where("_l is not null").withColumn("u", F.col("u") - F.col("_phi") * F.col("_l"))
        phi = F.max("_phi")
    rows = rows.select("*", *[F.lag("u", j).over(w).alias(f"u_{j}") for j in range(1, bandwidth + 1)])
    m = F.count("u")
    total = F.sum(F.col("u") * F.col("u"))
    for j in range(1, bandwidth + 1):
        total = total + 2 * kernel_weight(kernel, j, bandwidth) * F.coalesce(F.sum(F.col("u") * F.col(f"u_{j}")), F.lit(0.0))
    lrv = rows.groupBy(*by).agg((total / m / ((1 - phi) * (1 - phi))).alias("lrv"))
    met = n_all.join(lrv, by) if by else n_all.crossJoin(lrv)
    return met.withColumn("variance", F.col("lrv") / F.col("n")).withColumn("se", F.when(F.col("variance") >= 0, F.sqrt("variance"))).withColumn("dof", F.col("n") - bandwidth)


def newey_west_covariance(df: DataFrame, residual: str, features: list[str], order: list[str], bandwidth: int, kernel: str = "bartlett") -> np.ndarray:
    """Sandwich covariance of a regression's coefficients for one series: two aggregations of sums, and a solve of k x k on the driver."""
    k = len(features)
    w = Window.orderBy(*order)
    xu = [F.col(f) * F.col(residual) for f in features]
    rows = df.select(*features, *[c.alias(f"_s{i}") for i, c in enumerate(xu)])
    rows = df.select(*features, *[c.alias(f"_s{i}") for i, c in enumerate(xu)], *[F.lag(c, h).over(w).alias(f"_s{i}_{h}") for i, c in enumerate(xu) for h in range(1, bandwidth + 1)])
    sums = [F.sum(F.col(a) * F.col(b)) for a in features for b in features]
    for i in range(k):
        for j in range(k):
            t = F.sum(F.col(f"_s{i}") * F.col(f"_s{j}"))
            for h in range(1, bandwidth + 1):
                g = kernel_weight(kernel, h, bandwidth)
                t = t + g * (F.coalesce(F.sum(F.col(f"_s{i}") * F.col(f"_s{j}_{h}")), F.lit(0.0)) + F.coalesce(F.sum(F.col(f"_s{i}_{h}") * F.col(f"_s{j}")), F.lit(0.0)))
            sums.append(t)
    got = np.array([float(v) for v in rows.agg(*[s.alias(f"c{n}") for n, s in enumerate(sums)]).first()]).reshape(2, k, k)
    if np.linalg.matrix_rank(got[0]) < k:
        raise ValueError("the features are collinear")
    inv = np.linalg.inv(got[0])
    cov = inv @ got[1] @ inv
    if (np.diag(cov) < 0).any():
        raise ValueError("a variance came out negative")
    return (cov + cov.T) / 2


def autocorrelations(df: DataFrame, value: str, by: list[str], order: list[str], lags: int) -> DataFrame:
    """(by, n, lag, acf): biased autocorrelations at lags 1 to `lags`."""
    rows = demeaned_lags(df, value, by, order, lags)
    var = F.sum(F.col("u") * F.col("u"))
    cells = [F.struct(F.lit(j).alias("lag"), F.when(var > 0, F.coalesce(F.sum(F.col("u") * F.col(f"u_{j}")), F.lit(0.0)) / var).alias("acf")) for j in range(1, lags + 1)]
    return rows.groupBy(*by).agg(F.count("u").alias("n"), F.array(*cells).alias("c")).select(*by, "n", F.inline("c"))


def ljung_box(df: DataFrame, value: str, by: list[str], order: list[str], lags: int) -> DataFrame:
    """(by, n, q): n (n + 2) times the sum of squared autocorrelations over n - lag."""
    acf = autocorrelations(df, value, by, order, lags)
    n = F.max("n")
    return acf.groupBy(*by).agg(n.alias("n"), (n * (n + 2) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))).alias("q"))
