"""Validation gates and guardrails: checks that give rows (gate, scope, status, metric, threshold, message, details)."""

from __future__ import annotations

import copy
import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.functions.draws import HashDraws
from foldwise.functions.special import p_value_col
from foldwise.operators.hac import autocorrelations, ljung_box
from foldwise.operators.metrics import col, ordered
from foldwise.operators.regimes import mask_low_n_regimes
from foldwise.operators.resampling import block_draws, compute_block_length
from foldwise.operators.splits import WalkForwardCV

#: Statuses from the worst on.
STATUSES = ("HALT", "WARN", "PASS", "SKIP")
GATES = "gate string, scope string, status string, metric double, threshold double, message string, details map<string,string>"
#: Rows that distribution checks need.
LEAST = 30
ABS_NORMAL = math.sqrt(2 / math.pi)


def _row(df: DataFrame, gate: str, status: Column, metric: Column, threshold: Column | float, message: Column, scope: Column | None = None, details: dict[str, Column] | None = None) -> DataFrame:
    pairs = [x for k, v in (details or {}).items() for x in (F.lit(k), v.cast("string"))]
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return df.select(
        F.lit(gate).alias("gate"), (F.lit("overall") if scope is None else scope).alias("scope"), status.alias("status"), metric.cast("double").alias("metric"),
        thr.cast("double").alias("threshold"), message.alias("message"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("details"),
    )


def gate_suspicious_improvement(df: DataFrame, model_metric: str, baseline_metric: str, threshold: float = 0.2, warn_threshold: float = 0.1, scope: Column | None = None) -> DataFrame:
    """One gate row for each row of metrics: HALT above threshold, WARN above warn_threshold, SKIP without a positive baseline."""
    m, b = F.col(model_metric), F.col(baseline_metric)
    gain = F.when(b > 0, 1 - m / b)
    status = F.when(b.isNull() | (b <= 0), "SKIP").when(gain > threshold, "HALT").when(gain > warn_threshold, "WARN").otherwise("PASS")
    return _row(df, "suspicious_improvement", status, gain, threshold, F.concat(F.lit("improvement over the baseline: "), F.coalesce(F.round(gain, 4).cast("string"), F.lit("undefined"))), scope, {"model": m, "baseline": b})


def gate_temporal_boundary(folds: DataFrame, horizon: int, extra_gap: int = 0) -> DataFrame:
    """One gate row for each row of a fold table: HALT if its gap is below horizon + extra_gap."""
    gap = F.col("test_lo") - F.col("train_hi")
    need = horizon + extra_gap
    return _row(folds, "temporal_boundary", F.when(gap < need, "HALT").otherwise("PASS"), gap, need, F.concat(F.lit("gap of "), gap.cast("string"), F.lit(f", {need} needed")), F.concat(F.lit("fold "), F.col("fold").cast("string")))


def innovation_stats(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """(by, n, phi, sigma): first autocorrelation, and the sample deviation of y less phi times the value before."""
    phi = autocorrelations(df, value, by, order, 1).select(*by, "n", F.coalesce("acf", F.lit(0.0)).alias("phi"))
    from foldwise.operators.metrics import with_group_values

    rows = with_group_values(df.withColumn("_l", F.lag(value).over(ordered(by, order))), phi, by)
    return rows.groupBy(*by).agg(F.max("n").alias("n"), F.max("phi").alias("phi"), F.stddev_samp(F.col(value) - F.col("phi") * F.col("_l")).alias("sigma"))


def gate_theoretical_bounds(df: DataFrame, value: str, model_mae: Column | float, by: list[str], order: list[str], tolerance: float = 0.1) -> DataFrame:
    """One gate row a series: HALT if the model's MAE is below what the series' own AR(1) innovations allow, less the tolerance.

    model_mae: a number, or a Column over (by, n, phi, sigma) such as a join put there.
    """
    s = innovation_stats(df, value, by, order)
    mae = model_mae if isinstance(model_mae, Column) else F.lit(float(model_mae))
    bound = F.col("sigma") * ABS_NORMAL * (1 - tolerance)
    status = F.when(F.col("n") < LEAST, "SKIP").when(mae < bound, "HALT").otherwise("PASS")
    scope = F.concat_ws("/", *[F.col(b).cast("string") for b in by]) if by else None
    return _row(s, "theoretical_bounds", status, mae, bound, F.lit("model MAE against the AR(1) bound"), scope, {"phi": F.col("phi"), "sigma": F.col("sigma"), "n": F.col("n")})


def residual_statistics(df: DataFrame, residual: str, by: list[str], order: list[str], max_lag: int = 10) -> DataFrame:
    """(by, n, q, jb, t): Ljung-Box, Jarque-Bera and the t statistic of a zero mean."""
    q = ljung_box(df, residual, by, order, max_lag).select(*by, "q")
    n, g, k = F.count(residual), F.skewness(residual), F.kurtosis(residual)
    sd = F.stddev_samp(residual)
    rest = df.groupBy(*by).agg(n.alias("n"), (n / 6 * (g * g + k * k / 4)).alias("jb"), F.when(sd > 0, F.avg(residual) / sd * F.sqrt(n)).alias("t"))
    return rest.join(q, by) if by else rest.crossJoin(q)


def gate_residual_diagnostics(df: DataFrame, residual: str, by: list[str], order: list[str], max_lag: int = 10, significance: float = 0.05, halt_on_autocorr: bool = False, halt_on_normality: bool = False) -> DataFrame:
    """One gate row a series: SKIP below LEAST rows; HALT for bias, and for the others if asked; else WARN for any failure."""
    s = residual_statistics(df, residual, by, order, max_lag)
    p = s.withColumn("_q", p_value_col(F.col("q"), F.lit(float(max_lag)), "two-sided", "chi2")).withColumn("_j", p_value_col(F.col("jb"), F.lit(2.0), "two-sided", "chi2")).withColumn("_t", p_value_col(F.col("t"), F.col("n") - 1, "two-sided", "t"))
    auto, normal, bias = (F.col(c) < significance for c in ("_q", "_j", "_t"))
    failed = sum((c.cast("int") for c in (auto, normal, bias)), F.lit(0))
    halt = bias | (auto & F.lit(halt_on_autocorr)) | (normal & F.lit(halt_on_normality))
    status = F.when(F.col("n") < LEAST, "SKIP").when(halt, "HALT").when(failed > 0, "WARN").otherwise("PASS")
    scope = F.concat_ws("/", *[F.col(b).cast("string") for b in by]) if by else None
    return _row(p, "residual_diagnostics", status, failed, significance, F.lit("failed tests of residuals"), scope, {"ljung_box_p": F.col("_q"), "jarque_bera_p": F.col("_j"), "mean_zero_p": F.col("_t"), "n": F.col("n")})


def _cv_errors(model, x: np.ndarray, y: np.ndarray, n_splits: int) -> np.ndarray:
    cv = WalkForwardCV(n_splits, test_size=max(1, len(y) // (n_splits + 1)))
    e = [np.abs(y[c:d] - np.asarray(copy.deepcopy(model).fit(x[a:b], y[a:b]).predict(x[c:d]), float)) for a, b, c, d in cv.bounds(len(y))]
    return np.concatenate(e) if e else np.empty(0)


def _interval(errors: np.ndarray, n_bootstrap: int, alpha: float, block_length: int | str, seed: int) -> dict[str, Column]:
    """Details of a moving-block interval of the mean of a series of absolute errors; none below two of them."""
    if len(errors) < 2:
        return {}
    length = compute_block_length(len(errors)) if block_length == "auto" else int(block_length)
    means = errors[block_draws(len(errors), length, n_bootstrap, seed)].mean(axis=1)
    lower, upper = np.percentile(means, [50 * alpha, 100 - 50 * alpha])
    found = {"ci_lower": lower, "ci_upper": upper, "bootstrap_std": means.std(ddof=1), "n_bootstrap": n_bootstrap, "bootstrap_block_length": length}
    return {k: F.lit(float(v)) for k, v in found.items()}


def permuted(y: np.ndarray, block: int, rng: HashDraws) -> np.ndarray:
    """y with its blocks in random order."""
    parts = [y[a : a + block] for a in range(0, len(y) // block * block, block)]
    if len(y) % block:
        parts.append(y[len(y) // block * block :])
    return np.concatenate([parts[k] for k in rng.permutation(len(parts))])


def gate_signal_verification(df: DataFrame, model, features: list[str], target: str, order: list[str], n_shuffles: int = 100, threshold: float = 0.05, n_cv_splits: int = 3, permutation: str = "block", block_size: int | str = "auto", method: str = "permutation", seed: int = 0, bootstrap_ci: bool = False, n_bootstrap: int = 100, bootstrap_alpha: float = 0.05, bootstrap_block_length: int | str = "auto") -> DataFrame:
    """Does the model find signal in the real target that shuffled targets lack? HALT calls for a look at leakage.

    bootstrap_ci adds a moving-block interval of the real MAE to the details.

    One series' arrays are broadcast; shuffles are dealt over the cluster. permutation: p = (1 + shuffles as good) / (1 + shuffles), HALT
    below threshold; effect_size: HALT if 1 - MAE / mean shuffled MAE exceeds it.
    """
    if method not in ("permutation", "effect_size") or permutation not in ("block", "iid"):
        raise ValueError(f"unknown method {method!r} or permutation {permutation!r}")
    spark = df.sparkSession
    pdf = df.select(*order, *features, target).orderBy(*order).toPandas()
    x, y = pdf[features].to_numpy(float), pdf[target].to_numpy(float)
    block = 1 if permutation == "iid" else max(1, round(len(y) ** (1 / 3))) if block_size == "auto" else int(block_size)
    shared = spark.sparkContext.broadcast((model, x, y))

    def run(batches):
        m, xs, ys = shared.value
        for b in batches:
            yield pd.DataFrame({"mae": [float(_cv_errors(m, xs, permuted(ys, block, HashDraws(seed, int(k))), n_cv_splits).mean()) for k in b["id"]]})

    errors = _cv_errors(model, x, y, n_cv_splits)
    real = float(errors.mean())
    more = _interval(errors, n_bootstrap, bootstrap_alpha, bootstrap_block_length, seed) if bootstrap_ci else {}
    got = spark.range(n_shuffles).mapInPandas(run, "mae double").agg(F.avg("mae").alias("mean"), F.count_if(F.col("mae") <= real).alias("as_good"))
    gain = F.when(F.col("mean") > 0, 1 - F.lit(real) / F.col("mean")).otherwise(0.0)
    p = (1 + F.col("as_good")) / (1 + F.lit(n_shuffles))
    metric, bad = (p, p < threshold) if method == "permutation" else (gain, gain > threshold)
    return _row(got, "signal_verification", F.when(bad, "HALT").otherwise("PASS"), metric, threshold, F.lit("model against shuffled targets"), None, {"mae_real": F.lit(real), "mae_shuffled": F.col("mean"), "improvement": gain, "p_value": p, "block_size": F.lit(block), **more})


def gate_synthetic_ar1(spark: SparkSession, model, phi: float = 0.95, sigma: float = 1.0, n_samples: int = 500, n_lags: int = 5, tolerance: float = 1.5, n_cv_splits: int = 3, seed: int = 0, bootstrap_ci: bool = False, n_bootstrap: int = 100, bootstrap_alpha: float = 0.05, bootstrap_block_length: int | str = "auto") -> DataFrame:
    """HALT if the model beats the least possible MAE of a simulated AR(1) by more than the tolerance; bootstrap_ci as above."""
    from foldwise.operators.simulate import ar1

    y = ar1(phi, sigma, n_samples, HashDraws(seed))
    x = np.column_stack([y[n_lags - k - 1 : len(y) - k - 1] for k in range(n_lags)])
    errors = _cv_errors(model, x, y[n_lags:], n_cv_splits)
    mae = float(errors.mean())
    more = _interval(errors, n_bootstrap, bootstrap_alpha, bootstrap_block_length, seed) if bootstrap_ci else {}
    ratio = mae / (sigma * ABS_NORMAL)
    one = spark.createDataFrame([(ratio, mae)], "ratio double, mae double")
    return _row(one, "synthetic_ar1", F.when(F.col("ratio") < 1 / tolerance, "HALT").otherwise("PASS"), F.col("ratio"), 1 / tolerance, F.lit("MAE over the AR(1) optimum"), None, {"mae": F.col("mae"), **more})


def run_gates(*gates: DataFrame) -> DataFrame:
    """All gate rows together."""
    return reduce(DataFrame.unionByName, gates)


def report_status(gates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, status, n_gates, n_halt, n_warn): HALT before WARN before PASS; PASS if all were skipped."""
    s = F.col("status")
    worst = F.when(F.bool_or(s == "HALT"), "HALT").when(F.bool_or(s == "WARN"), "WARN").otherwise("PASS")
    return gates.groupBy(*(by or [])).agg(worst.alias("status"), F.count(F.lit(1)).alias("n_gates"), F.count_if(s == "HALT").alias("n_halt"), F.count_if(s == "WARN").alias("n_warn"))


def regime_metrics(df: DataFrame, predictions: str, actuals: str, regime: str, order: list[str], min_n: int = 10) -> DataFrame:
    """(regime, n, model_mae, persistence_mae) of regimes with min_n rows; persistence differences neighbours within the regime's
    own rows, though other rows may lie between them."""
    rows = mask_low_n_regimes(df.where(F.col(actuals).isNotNull() & F.col(predictions).isNotNull()), regime, min_n).where("masked <> 'MASKED'")
    step = F.abs(F.col(actuals) - F.lag(actuals).over(Window.partitionBy(regime).orderBy(*order)))
    rows = rows.withColumn("_step", step)
    return rows.groupBy(F.col(regime).alias("regime")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(predictions) - F.col(actuals))).alias("model_mae"), F.avg("_step").alias("persistence_mae"))


def run_gates_stratified(df: DataFrame, predictions: str, actuals: str, regime: str, order: list[str], min_n_per_regime: int = 10, improvement_threshold: float = 0.2, warning_threshold: float = 0.1, overall: DataFrame | None = None) -> DataFrame:
    """Gate rows by regime (improvement over persistence; the AR(1) bound from LEAST rows on) besides the overall ones."""
    m = regime_metrics(df, predictions, actuals, regime, order, min_n_per_regime)
    better = gate_suspicious_improvement(m.where("persistence_mae > 0"), "model_mae", "persistence_mae", improvement_threshold, warning_threshold, F.col("regime"))
    kept = df.join(m.where(F.col("n") >= LEAST).select(F.col("regime").alias(regime)), regime, "left_semi")
    stats = innovation_stats(kept, actuals, [regime], order).join(m.select(F.col("regime").alias(regime), "model_mae"), regime)
    bound = F.col("sigma") * ABS_NORMAL * 0.9
    limits = _row(stats, "theoretical_bounds", F.when(F.col("model_mae") < bound, "HALT").otherwise("PASS"), F.col("model_mae"), bound, F.lit("model MAE against the AR(1) bound"), F.col(regime), {"phi": F.col("phi"), "sigma": F.col("sigma")})
    out = better.unionByName(limits)
    return out if overall is None else overall.unionByName(out)


# --- guardrails: rows (check, level, value, message); level error, warning, ok or skipped ---

CHECKS = "check string, level string, value double, message string"


def _check(spark: SparkSession, check: str, level: str, value: float | None, message: str) -> DataFrame:
    return spark.createDataFrame([(check, level, None if value is None else float(value), message)], CHECKS)


def check_suspicious_improvement(spark: SparkSession, model_metric: float, baseline_metric: float, threshold: float = 0.2) -> DataFrame:
    """Error above threshold, warning above three quarters of it, skipped without a positive baseline."""
    if baseline_metric <= 0:
        return _check(spark, "suspicious_improvement", "skipped", None, "the baseline isn't positive")
    gain = 1 - model_metric / baseline_metric
    level = "error" if gain > threshold else "warning" if gain > 0.75 * threshold else "ok"
    return _check(spark, "suspicious_improvement", level, gain, "improvement over the baseline")


def check_minimum_sample_size(spark: SparkSession, n: int, min_n: int = 50) -> DataFrame:
    return _check(spark, "minimum_sample_size", "error" if n < min_n else "warning" if n < 2 * min_n else "ok", n, f"rows, {min_n} needed")


def check_stratified_sample_size(spark: SparkSession, n_up: int, n_down: int, min_n: int = 10) -> DataFrame:
    least, most = min(n_up, n_down), max(n_up, n_down)
    level = "error" if least < min_n else "warning" if most > 3 * least else "ok"
    return _check(spark, "stratified_sample_size", level, least, f"moves of the rarer direction, {min_n} needed; at most 3 times as many of the other")


def check_forecast_horizon_consistency(spark: SparkSession, horizons: Sequence[float], max_ratio: float = 2.0) -> DataFrame:
    """The mean of the later horizons' metrics over the first one's."""
    if len(horizons) < 2 or horizons[0] <= 0:
        return _check(spark, "horizon_consistency", "skipped", None, "two horizons and a positive first metric are needed")
    ratio = sum(horizons[1:]) / (len(horizons) - 1) / horizons[0]
    return _check(spark, "horizon_consistency", "error" if ratio > max_ratio else "ok", ratio, "later horizons over the first")


def check_residual_autocorrelation(df: DataFrame, residual: str, by: list[str], order: list[str], max_lag: int = 5, threshold: float = 0.2) -> DataFrame:
    """(by, lag, r, high): the correlation of residuals with each lag; high above the threshold (a warning, never an error)."""
    w = ordered(by, order)
    rows = df.select(*by, residual, *[F.lag(residual, j).over(w).alias(f"_l{j}") for j in range(1, max_lag + 1)])
    cells = [F.struct(F.lit(j).alias("lag"), F.corr(residual, f"_l{j}").alias("r")) for j in range(1, max_lag + 1)]
    return rows.groupBy(*by).agg(F.array(*cells).alias("c")).select(*by, F.inline("c")).withColumn("high", F.abs("r") > threshold)


def run_all_guardrails(spark: SparkSession, model_metric: float, baseline_metric: float, n_samples: int, n_up: int | None = None, n_down: int | None = None, horizon_metrics: Sequence[float] | None = None, residuals: DataFrame | None = None, residual: str = "residual", order: list[str] | None = None) -> DataFrame:
    """All checks that the arguments allow; passed if no level is error."""
    out = [check_suspicious_improvement(spark, model_metric, baseline_metric), check_minimum_sample_size(spark, n_samples)]
    if n_up is not None and n_down is not None:
        out.append(check_stratified_sample_size(spark, n_up, n_down))
    if horizon_metrics is not None:
        out.append(check_forecast_horizon_consistency(spark, horizon_metrics))
    if residuals is not None:
        r = check_residual_autocorrelation(residuals, residual, [], order or [])
        worst = F.max(F.abs("r"))
        out.append(r.agg(F.lit("residual_autocorrelation").alias("check"), F.when(F.bool_or("high"), "warning").otherwise("ok").alias("level"), worst.alias("value"), F.lit("largest correlation with a lag").alias("message")))
    return reduce(DataFrame.unionByName, out)


# --- validators of numbers ---


def finite_se(df: DataFrame, se: str) -> None:
    """Raise unless every standard error is finite and positive."""
    c = F.col(se)
    if df.where(c.isNull() | F.isnan(c) | (c <= 0) | (c == float("inf"))).limit(1).count():
        raise ValueError(f"{se} isn't finite and positive everywhere")


def psd(cov: np.ndarray, tol: float = 1e-8, rtol: float = 1e-12) -> None:
    """Raise unless the matrix is symmetric and positive semi-definite within the tolerance."""
    cov = np.asarray(cov, float)
    size = np.abs(cov).max(initial=0.0)
    if cov.ndim != 2 or cov.shape[0] != cov.shape[1] or not np.isfinite(cov).all() or not np.allclose(cov, cov.T, atol=tol + rtol * size):
        raise ValueError("the matrix isn't symmetric")
    if np.linalg.eigvalsh((cov + cov.T) / 2).min(initial=0.0) < -(tol + rtol * size):
        raise ValueError("the matrix isn't positive semi-definite")


def ci_ordered(df: DataFrame, lower: str, upper: str) -> None:
    lo, hi = F.col(lower), F.col(upper)
    if df.where(lo.isNull() | hi.isNull() | F.isnan(lo) | F.isnan(hi) | (lo > hi)).limit(1).count():
        raise ValueError("interval bounds are missing or out of order")


def coverage_in_unit(df: DataFrame, coverage: str) -> None:
    if df.where(~F.coalesce(col(coverage).between(0, 1), F.lit(False))).limit(1).count():
        raise ValueError("a coverage is outside [0, 1]")
