"""Tests of equal predictive accuracy over long error frames: statistics by aggregation, p-values on the result rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.draws import HashDraws
from foldwise.functions.special import p_value_col
from foldwise.operators.hac import bartlett_kernel, demeaned_lags, hac_mean_variance, test_bandwidth
from foldwise.operators.metrics import col, ordered

#: Rows that the tests need (fewer give null statistics and p-value 1).
LEAST, LEAST_ENCOMPASSING, LEAST_GW = 30, 20, 50
# Critical values of the self-normalised statistic at 1, 5 and 10 %.
SN_TWO_SIDED, SN_ONE_SIDED = (3.24, 2.22, 1.82), (2.70, 1.95, 1.60)


def loss_of(e, loss: str) -> Column:
    if loss not in ("squared", "absolute"):
        raise ValueError(f"unknown loss {loss!r}")
    return col(e) * col(e) if loss == "squared" else F.abs(col(e))


def harvey_factor(n: Column, h: int) -> Column:
    return F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)


def sn_p_value(stat: Column, alternative: str) -> Column:
    """Piecewise linear between the critical values; built-in."""
    c1, c5, c10 = SN_TWO_SIDED if alternative == "two-sided" else SN_ONE_SIDED
    s = F.abs(stat)
    p = (
        F.when(s >= c1, 0.01)
        .when(s >= c5, 0.01 + 0.04 * (c1 - s) / (c1 - c5))
        .when(s >= c10, 0.05 + 0.05 * (c5 - s) / (c5 - c10))
        .otherwise(F.least(F.lit(1.0), 0.10 + 0.90 * (c10 - s) / c10))
    )
    wrong = {"two-sided": F.lit(False), "less": stat > 0, "greater": stat < 0}[alternative]
    return F.when(stat.isNull() | wrong, 1.0).otherwise(p)


def dm_statistics(df: DataFrame, d: str, by: list[str], order: list[str], h: int = 1, harvey: bool = True) -> DataFrame:
    """(by, n, mean_diff, variance, statistic) of loss differences d; null statistic without variance or with too few rows."""
    rows = df.where(F.col(d).isNotNull())
    if h == 1:
        # without lags the variance is that of the rows: one partial aggregation, however few and large the groups are
        variance = F.var_pop(d) / F.count(d)
    else:
        rows, variance = demeaned_lags(rows, d, by, order, h - 1), hac_mean_variance(h - 1)
    out = rows.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), variance.alias("variance"))
    stat = F.col("mean_diff") / F.sqrt("variance") * (harvey_factor(F.col("n"), h) if harvey else F.lit(1.0))
    return out.withColumn("statistic", F.when((F.col("variance") > 0) & (F.col("n") >= LEAST), stat))


def dm_test(df: DataFrame, errors_1: str, errors_2: str, by: list[str], order: list[str], h: int = 1, loss: str = "squared", alternative: str = "two-sided", harvey_correction: bool = True, variance_method: str = "hac") -> DataFrame:
    """Diebold-Mariano: (by, n, mean_diff, variance, statistic, p_value), the first model better where it is negative.

    With the Harvey factor p is that of t(n - 1), else normal. The self-normalised statistic has its own table.
    """
    rows = df.withColumn("_d", loss_of(errors_1, loss) - loss_of(errors_2, loss))
    if variance_method == "self_normalized":
        from foldwise.operators.hac import compute_self_normalized_variance

        rows = rows.where("_d is not null")
        var = compute_self_normalized_variance(rows, "_d", by, order).withColumnRenamed("sn_variance", "variance")
        mean = rows.groupBy(*by).agg(F.avg("_d").alias("mean_diff"))
        out = var.join(mean, by) if by else var.crossJoin(mean)
        stat = F.when((F.col("variance") > 0) & (F.col("n") >= LEAST), F.col("mean_diff") / F.sqrt("variance"))
        out = out.withColumn("statistic", stat)
        return out.withColumn("p_value", sn_p_value(F.col("statistic"), alternative)).select(*by, "n", "mean_diff", "variance", "statistic", "p_value")
    if variance_method != "hac":
        raise ValueError(f"unknown variance method {variance_method!r}")
    out = dm_statistics(rows, "_d", by, order, h, harvey_correction)
    p = p_value_col(F.col("statistic"), F.col("n") - 1, alternative, "t" if harvey_correction else "normal")
    return out.withColumn("p_value", p)


def cw_test(df: DataFrame, errors_u: str, errors_r: str, pred_u: str, pred_r: str, by: list[str], order: list[str], h: int = 1, loss: str = "squared", alternative: str = "two-sided", harvey_correction: bool = True) -> DataFrame:
    """Clark-West for nested models: the loss difference (unrestricted - restricted) less the squared distance of
    the predictions; normal p-values; the Harvey factor only beyond one step."""
    d = loss_of(errors_u, loss) - loss_of(errors_r, loss)
    gap = F.pow(F.col(pred_r) - F.col(pred_u), 2)
    rows = df.withColumn("_raw", d).withColumn("_d", d - gap)
    out = dm_statistics(rows, "_d", by, order, h, harvey_correction and h > 1)
    plain = rows.where("_d is not null").groupBy(*by).agg(F.avg("_raw").alias("mean_unadjusted"))
    out = out.join(plain, by) if by else out.crossJoin(plain)
    return out.withColumn("p_value", p_value_col(F.col("statistic"), None, alternative, "normal"))


def gw_moments(df: DataFrame, errors_1: str, errors_2: str, by: list[str], order: list[str], n_lags: int = 1, loss: str = "squared") -> DataFrame:
    """(by, n_eff, mean_diff, zz, z): the sums that the Giacomini-White regression of ones on instrumented differences needs.

    Instruments are 1 and the n_lags last differences, multiplied with the demeaned current one.
    """
    rows = df.withColumn("_d", loss_of(errors_1, loss) - loss_of(errors_2, loss)).where("_d is not null")
    w = ordered(by, order)
    rows = rows.select(*by, "_d", *[F.lag("_d", j).over(w).alias(f"_d{j}") for j in range(1, n_lags + 1)]).where(F.col(f"_d{n_lags}").isNotNull())
    rows = rows.withColumn("_c", F.col("_d") - F.avg("_d").over(Window.partitionBy(*by)))
    z = [F.col("_c"), *[F.col("_c") * F.col(f"_d{j}") for j in range(1, n_lags + 1)]]
    return rows.groupBy(*by).agg(
        F.count("_d").alias("n_eff"),
        F.avg("_d").alias("mean_diff"),
        F.array(*[F.array(*[F.sum(a * b) for b in z]) for a in z]).alias("zz"),
        F.array(*[F.sum(a) for a in z]).alias("z"),
    )


def gw_test(df: DataFrame, errors_1: str, errors_2: str, by: list[str], order: list[str], n_lags: int = 1, loss: str = "squared", alternative: str = "two-sided") -> DataFrame:
    """(by, n_eff, mean_diff, r_squared, statistic, p_value): n times the R2 of that regression, chi-squared with 1 + n_lags degrees.

    One-sided p-values are halved, or one minus that against the sign.
    """
    if not 1 <= n_lags <= 10:
        raise ValueError("n_lags must be 1 to 10")
    m = gw_moments(df, errors_1, errors_2, by, order, n_lags, loss)

    @F.pandas_udf("double")
    def r2(zz: pd.Series, z: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for a, b, k in zip(zz, z, n, strict=True):
            a, b = np.array([list(r) for r in a], float), np.array(list(b), float)
            beta = np.linalg.lstsq(a, b, rcond=None)[0]
            out.append(min(max(float(b @ beta) / k, 0.0), 1.0) if k else np.nan)
        return pd.Series(out, dtype=float)

    out = m.withColumn("r_squared", r2("zz", "z", F.col("n_eff").cast("double"))).drop("zz", "z")
    out = out.withColumn("statistic", F.when(F.col("n_eff") >= LEAST_GW, F.col("n_eff") * F.col("r_squared")))
    p = p_value_col(F.col("statistic"), F.lit(1.0 + n_lags), "two-sided", "chi2")
    out = out.withColumn("p_value", p)
    if alternative != "two-sided":
        right = F.col("mean_diff") < 0 if alternative == "less" else F.col("mean_diff") > 0
        out = out.withColumn("p_value", F.when(right, F.col("p_value") / 2).otherwise(1 - F.col("p_value") / 2))
    return out


def pt_statistics(actual, predicted) -> dict[str, Column]:
    """Aggregates of the Pesaran-Timmermann test of sign agreement on rows whose actual isn't zero."""
    a, p = col(actual), col(predicted)
    used = (a != 0) & p.isNotNull()
    mean = lambda c: F.avg(F.when(used, c.cast("double")))
    n = F.count_if(used)
    hit, py, px = mean(F.signum(a) == F.signum(p)), mean(a > 0), mean(p > 0)
    star = py * px + (1 - py) * (1 - px)
    qy, qx = py * (1 - py), px * (1 - px)
    var = star * (1 - star) / n + F.pow(2 * py - 1, 2) * qx / n + F.pow(2 * px - 1, 2) * qy / n + 4 * py * px * (1 - py) * (1 - px) / n
    stat = F.when((var > 0) & (n >= LEAST), (hit - star) / F.sqrt(var))
    return {"n": n, "accuracy": hit, "expected": star, "statistic": stat}


def pt_test(df: DataFrame, actual: str, predicted: str, by: list[str], move_threshold: float | None = None) -> DataFrame:
    """(by, n, accuracy, expected, statistic, p_value), p one-sided; three classes given a threshold."""
    if move_threshold is None:
        stats = pt_statistics(actual, predicted)
    else:
        cls = lambda c: F.when(F.col(c) > move_threshold, 1).when(F.col(c) < -move_threshold, -1).when(F.col(c).isNotNull(), 0)
        a, p = cls(actual), cls(predicted)
        n = F.count(F.when(a.isNotNull() & p.isNotNull(), 1))
        mean = lambda c: F.avg(c.cast("double"))
        star = sum((mean(a == k) * mean(p == k) for k in (-1, 0, 1)), F.lit(0.0))
        var = 5 * star * (1 - star) / n
        hit = mean(a == p)
        stats = {"n": n, "accuracy": hit, "expected": star, "statistic": F.when((var > 0) & (n >= LEAST), (hit - star) / F.sqrt(var))}
    out = df.groupBy(*by).agg(*[c.alias(k) for k, c in stats.items()])
    return out.withColumn("p_value", p_value_col(F.col("statistic"), None, "greater", "normal"))


# --- many models and horizons ---


def model_pairs(errors: DataFrame, keys: list[str], model: str, e: str, loss: str) -> DataFrame:
    """(keys, model_a, model_b, d) of all pairs of models on the same rows: an equi-join on the row's keys."""
    rows = errors.where(F.col(e).isNotNull()).select(*keys, F.col(model).alias("m"), loss_of(e, loss).alias("l"))
    a = rows.select(*keys, F.col("m").alias("model_a"), F.col("l").alias("la"))
    b = rows.select(*keys, F.col("m").alias("model_b"), F.col("l").alias("lb"))
    return a.join(b, keys).where("model_a < model_b").select(*keys, "model_a", "model_b", (F.col("la") - F.col("lb")).alias("d"))


def compare_multiple_models(errors: DataFrame, keys: list[str], order: list[str], model: str = "model", e: str = "e", h: int = 1, alpha: float = 0.05, loss: str = "squared", harvey_correction: bool = True) -> DataFrame:
    """(better, worse, n, mean_diff, statistic, p_value, significant): every pair, the better one by mean loss first, one-sided,
    at alpha over the number of pairs."""
    out = dm_statistics(model_pairs(errors, keys, model, e, loss), "d", ["model_a", "model_b"], order, h, harvey_correction)
    swap = F.col("mean_diff") > 0
    out = out.select(
        F.when(swap, F.col("model_b")).otherwise(F.col("model_a")).alias("better"),
        F.when(swap, F.col("model_a")).otherwise(F.col("model_b")).alias("worse"),
        "n",
        (-F.abs("mean_diff")).alias("mean_diff"),
        (-F.abs("statistic")).alias("statistic"),
    )
    out = out.withColumn("p_value", p_value_col(F.col("statistic"), F.col("n") - 1, "less", "t" if harvey_correction else "normal"))
    return out.withColumn("significant", F.col("p_value") < F.lit(alpha) / F.count(F.lit(1)).over(Window.partitionBy()))


def rank_models(errors: DataFrame, model: str = "model", e: str = "e", loss: str = "squared", by: list[str] | None = None) -> DataFrame:
    """(by, model, mean_loss, rank)."""
    by = by or []
    means = errors.groupBy(*by, model).agg(F.avg(loss_of(e, loss)).alias("mean_loss"))
    return means.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("mean_loss", model)))


def compare_horizons(df: DataFrame, errors_1: str, errors_2: str, by: list[str], order: list[str], horizons: Sequence[int] = (1, 2, 3, 4), loss: str = "squared", alternative: str = "two-sided", harvey_correction: bool = True) -> DataFrame:
    """(by, h, n, mean_diff, statistic, p_value): the same errors tested at each horizon; lags are computed once, for the longest."""
    most = max(horizons)
    rows = df.withColumn("_d", loss_of(errors_1, loss) - loss_of(errors_2, loss)).where("_d is not null")
    rows = demeaned_lags(rows, "_d", by, order, most - 1)
    cells = [F.struct(F.lit(h).alias("h"), hac_mean_variance(h - 1).alias("variance")) for h in horizons]
    out = rows.groupBy(*by).agg(F.count("_d").alias("n"), F.avg("_d").alias("mean_diff"), F.array(*cells).alias("c")).select(*by, "n", "mean_diff", F.inline("c"))
    h, n = F.col("h"), F.col("n")
    factor = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n) if harvey_correction else F.lit(1.0)
    out = out.withColumn("statistic", F.when((F.col("variance") > 0) & (n >= LEAST), F.col("mean_diff") / F.sqrt("variance") * factor))
    out = out.withColumn("p_value", p_value_col(F.col("statistic"), n - 1, alternative, "t" if harvey_correction else "normal"))
    return out.select(*by, "h", "n", "mean_diff", "statistic", "p_value")


def horizon_pattern(result: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """(by, pattern, best_h, first_insignificant_h): none, consistent, degrading (p falls at most once) or irregular.

    Of horizons with the same p-value (1 where a series is too short to test) the smallest is best.
    """
    w = Window.partitionBy(*by).orderBy("h")
    rows = result.withColumn("_fall", (F.col("p_value") < F.lag("p_value").over(w)).cast("int"))
    good = F.col("p_value") < alpha
    falls = F.coalesce(F.sum("_fall"), F.lit(0))
    pattern = F.when(~F.bool_or(good), "none").when(F.bool_and(good), "consistent").when(falls <= 1, "degrading").otherwise("irregular")
    return rows.groupBy(*by).agg(pattern.alias("pattern"), F.min(F.when(F.col("p_value").isNotNull(), F.struct("p_value", "h")))["h"].alias("best_h"), F.min(F.when(~good, F.col("h"))).alias("first_insignificant_h"))


def compare_models_horizons(errors: DataFrame, keys: list[str], order: list[str], model: str = "model", e: str = "e", horizons: Sequence[int] = (1, 2, 3, 4), loss: str = "squared", harvey_correction: bool = True) -> DataFrame:
    """(h, model_a, model_b, n, mean_diff, statistic, p_value) of all pairs at all horizons."""
    pairs = model_pairs(errors, keys, model, e, loss).withColumn("_zero", F.lit(0.0)).withColumn("_root", F.col("d"))
    most = max(horizons)
    rows = demeaned_lags(pairs, "d", ["model_a", "model_b"], order, most - 1)
    cells = [F.struct(F.lit(h).alias("h"), hac_mean_variance(h - 1).alias("variance")) for h in horizons]
    out = rows.groupBy("model_a", "model_b").agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.array(*cells).alias("c")).select("model_a", "model_b", "n", "mean_diff", F.inline("c"))
    h, n = F.col("h"), F.col("n")
    factor = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n) if harvey_correction else F.lit(1.0)
    out = out.withColumn("statistic", F.when((F.col("variance") > 0) & (n >= LEAST), F.col("mean_diff") / F.sqrt("variance") * factor))
    return out.withColumn("p_value", p_value_col(F.col("statistic"), n - 1, "two-sided", "t" if harvey_correction else "normal")).drop("variance")


# --- encompassing ---


def forecast_encompassing_test(df: DataFrame, actual: str, forecast_a: str, forecast_b: str, by: list[str], order: list[str], h: int = 1, alpha: float = 0.05) -> DataFrame:
    """(by, n, lambda, intercept, statistic, p_value, encompasses): regress A's error on the difference of the forecasts;
    A encompasses B if the slope isn't significant, t(n - 2).

    Beyond one step the slope's variance uses the autocorrelation-robust variances of products of scores.
    """
    e, x = F.col(actual) - F.col(forecast_a), F.col(forecast_b) - F.col(forecast_a)
    rows = df.select(*by, *order, e.alias("_e"), x.alias("_x")).where("_e is not null and _x is not null")
    n, sxx, sxy, syy = F.regr_count("_e", "_x"), F.regr_sxx("_e", "_x"), F.regr_sxy("_e", "_x"), F.regr_syy("_e", "_x")
    fit = rows.groupBy(*by).agg(n.alias("n"), F.regr_slope("_e", "_x").alias("lambda"), F.regr_intercept("_e", "_x").alias("intercept"), sxx.alias("sxx"), sxy.alias("sxy"), syy.alias("syy"), F.avg("_x").alias("mx"))
    if h == 1:
        ssr = F.col("syy") - F.col("lambda") * F.col("sxy")
        var = ssr / (F.col("n") - 2) / F.col("sxx")
        out = fit.withColumn("variance", var)
    else:
        from foldwise.operators.metrics import with_group_values

        u = with_group_values(rows, fit.select(*by, "lambda", "intercept", "sxx", "mx"), by)
        # this test's middle matrix holds the robust variances of the sums of u^2, u^2 x and u^2 x^2
        resid = F.col("_e") - F.col("intercept") - F.col("lambda") * F.col("_x")
        for i in range(3):
            u = demeaned_lags(u.withColumn(f"_p{i}", resid * resid * F.pow("_x", F.lit(float(i)))), f"_p{i}", by, order, h - 1, f"_q{i}")
        var = [hac_mean_variance(h - 1, f"_q{i}") * F.count("_e") for i in range(3)]
        n, sx, raw = F.count("_e"), F.sum("_x"), F.sum(F.col("_x") * F.col("_x"))
        det = n * raw - sx * sx
        lrv = u.groupBy(*by).agg(((sx * sx * var[0] - 2 * sx * n * var[1] + n * n * var[2]) / (det * det)).alias("variance"))
        out = fit.join(lrv, by) if by else fit.crossJoin(lrv)
    stat = F.when((F.col("variance") > 0) & (F.col("n") >= LEAST_ENCOMPASSING), F.col("lambda") / F.sqrt("variance"))
    out = out.withColumn("statistic", stat).withColumn("p_value", p_value_col(F.col("statistic"), F.col("n") - 2, "two-sided", "t"))
    return out.withColumn("encompasses", F.col("p_value") >= alpha).select(*by, "n", "lambda", "intercept", "statistic", "p_value", "encompasses")


def forecast_encompassing_bidirectional(df: DataFrame, actual: str, forecast_a: str, forecast_b: str, by: list[str], order: list[str], h: int = 1, alpha: float = 0.05) -> DataFrame:
    """(by, lambda_a, lambda_b, a_encompasses, b_encompasses, recommendation)."""
    one = forecast_encompassing_test(df, actual, forecast_a, forecast_b, by, order, h, alpha).select(*by, F.col("lambda").alias("lambda_a"), F.col("encompasses").alias("a_encompasses"))
    two = forecast_encompassing_test(df, actual, forecast_b, forecast_a, by, order, h, alpha).select(*by, F.col("lambda").alias("lambda_b"), F.col("encompasses").alias("b_encompasses"))
    both = one.join(two, by) if by else one.crossJoin(two)
    a, b = F.col("a_encompasses"), F.col("b_encompasses")
    return both.withColumn("recommendation", F.when(a & b, "equivalent").when(a, "use_a").when(b, "use_b").otherwise("combine"))


# --- data snooping ---


def stationary_bootstrap_indices(n: int, mean_block: float, rng: HashDraws) -> np.ndarray:
    """One replicate's row positions: blocks of geometric length, wrapped around."""
    fresh = rng.random(n) < 1 / mean_block
    fresh[0] = True
    starts = rng.integers(0, n, n)
    run = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return (starts[run] + np.arange(n) - run) % n


def _hac(d: np.ndarray, b: int) -> np.ndarray:
    """Variance of each column's mean."""
    u = d - d.mean(axis=0)
    total = (u * u).mean(axis=0)
    for j in range(1, b + 1):
        total = total + 2 * bartlett_kernel(j, b) * (u[j:] * u[:-j]).mean(axis=0)
    return total / len(d)


def _snooping(errors: DataFrame, benchmark: str, order: list[str], model: str, e: str, h: int, loss: str, n_bootstrap: int, block_size: float | None, seed: int, kind: str) -> DataFrame:
    """Loss differences of all models against the benchmark become one matrix of rows by models, bounded by one series'
    length; replicates are dealt over the cluster, each seeded by its own number, and come back as one p-value row."""
    spark = errors.sparkSession
    names = sorted(r[0] for r in errors.select(model).distinct().collect() if r[0] != benchmark)
    if not names:
        raise ValueError("no model but the benchmark")
    wide = errors.where(F.col(e).isNotNull()).groupBy(*order).pivot(model, [benchmark, *names]).agg(F.first(loss_of(e, loss))).dropna().orderBy(*order)
    mat = wide.select(*[f"`{m}`" for m in [benchmark, *names]]).toPandas().to_numpy(float)
    n = len(mat)
    if n < LEAST:
        raise ValueError(f"{n} rows are too few, {LEAST} are needed")
    d = mat[:, :1] - mat[:, 1:]
    b = h - 1 if h > 1 else test_bandwidth(n)
    block = block_size or max(1.0, math.floor(round(n ** (1 / 3), 9)))
    mean, se = d.mean(axis=0), np.sqrt(np.maximum(_hac(d, b), 1e-300))
    stat = math.sqrt(n) * mean / se
    shared = spark.sparkContext.broadcast(d)

    def run(batches):
        x = shared.value
        for pdf in batches:
            out = []
            for k in pdf["id"]:
                draw = x[stationary_bootstrap_indices(n, block, HashDraws(seed, int(k)))]
                if kind == "rc":
                    own = np.sqrt(np.maximum(_hac(draw, b), 1e-300))
                    out.append((float((math.sqrt(n) * (draw.mean(axis=0) - mean) / own).max()), 0.0, 0.0))
                else:
                    c = math.sqrt(n) * (draw.mean(axis=0) - mean) / se
                    out.append((float(c.max()), float((c + np.maximum(0, stat)).max()), float((c - math.sqrt(n) * mean.min() / se).max())))
            yield pd.DataFrame(out, columns=["c", "m", "l"])

    draws = spark.range(n_bootstrap).mapInPandas(run, "c double, m double, l double")
    top = float(stat.max())
    share = lambda c: F.avg((F.col(c) >= top).cast("double"))
    best = names[int(stat.argmax())]
    base = [F.lit(top).alias("statistic"), F.lit(best).alias("best_model"), F.lit(n).alias("n"), F.count(F.lit(1)).alias("n_bootstrap")]
    if kind == "rc":
        return draws.agg(*base, share("c").alias("p_value"))
    return draws.agg(*base, share("m").alias("p_value"), share("c").alias("p_value_consistent"), share("l").alias("p_value_lower"))


def reality_check_test(errors: DataFrame, benchmark: str, order: list[str], model: str = "model", e: str = "e", h: int = 1, loss: str = "squared", n_bootstrap: int = 1000, block_size: float | None = None, seed: int = 0) -> DataFrame:
    """White's reality check: (statistic, best_model, n, n_bootstrap, p_value); errors are estimated anew in every resample."""
    return _snooping(errors, benchmark, order, model, e, h, loss, n_bootstrap, block_size, seed, "rc")


def spa_test(errors: DataFrame, benchmark: str, order: list[str], model: str = "model", e: str = "e", h: int = 1, loss: str = "squared", n_bootstrap: int = 1000, block_size: float | None = None, seed: int = 0) -> DataFrame:
    """Hansen's superior predictive ability: as above with three p-values; errors are those of the full sample."""
    return _snooping(errors, benchmark, order, model, e, h, loss, n_bootstrap, block_size, seed, "spa")


def compute_dm_influence(df: DataFrame, errors_1: str, errors_2: str, by: list[str], order: list[str], n: int, h: int = 1, loss: str = "squared", influence_threshold: float = 2.0) -> DataFrame:
    """Adds d, influence (deviation over the root of n times the variance of the mean), high, block and block_influence (what leaving out
    the row's block of h does to the mean, times the root of n). n sets the automatic bandwidth at h = 1."""
    rows = df.withColumn("d", loss_of(errors_1, loss) - loss_of(errors_2, loss)).where("d is not null")
    b = h - 1 if h > 1 else test_bandwidth(n)
    lagged = demeaned_lags(rows, "d", by, order, b)
    stats = lagged.groupBy(*by).agg(F.count("d").alias("_n"), F.sum("d").alias("_sum"), hac_mean_variance(b).alias("_v"))
    from foldwise.operators.metrics import with_group_values

    rows = with_group_values(lagged.drop(*[f"u_{j}" for j in range(1, b + 1)]), stats, by)
    rows = rows.withColumn("influence", F.when(F.col("_v") > 0, F.col("u") / F.sqrt(F.col("_v") * F.col("_n"))).otherwise(0.0))
    part = Window.partitionBy(*by)
    sd = F.stddev_pop("influence").over(part)
    rows = rows.withColumn("high", (sd > 0) & (F.abs("influence") > influence_threshold * sd))
    size = max(h, 1)
    place = F.floor((F.row_number().over(ordered(by, order)) - 1) / size)
    rows = rows.withColumn("block", F.when(place < F.floor(F.col("_n") / size), place))
    within = Window.partitionBy(*by, "block")
    left = (F.col("_sum") - F.sum("d").over(within)) / (F.col("_n") - F.count("d").over(within))
    return rows.withColumn("block_influence", F.when(F.col("block").isNotNull(), (F.col("_sum") / F.col("_n") - left) * F.sqrt("_n"))).drop("_n", "_sum", "_v", "u")
