"""Forecast metrics as aggregate Columns, for groupBy(...).agg(...) or over a whole frame.

Each takes Columns (or names) of one long frame and is one built-in aggregate, so any number of
them shares a single pass with map-side partial sums. Undefined results are null. Argument order
follows convention: (predictions, actuals) for point metrics, (actuals, ...) for quantile metrics.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from foldwise.functions.special import norm_cdf_col


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def share(cond: Column) -> Column:
    """The share of rows that meet a condition; rows where it is null count in neither part."""
    return F.avg(cond.cast("double"))


# --- point forecasts ---


def compute_mae(predictions, actuals) -> Column:
    return F.avg(F.abs(col(predictions) - col(actuals)))


def compute_mse(predictions, actuals) -> Column:
    e = col(predictions) - col(actuals)
    return F.avg(e * e)


def compute_rmse(predictions, actuals) -> Column:
    return F.sqrt(compute_mse(predictions, actuals))


def compute_bias(predictions, actuals) -> Column:
    return F.avg(col(predictions) - col(actuals))


def compute_mape(predictions, actuals, epsilon: float = 1e-8) -> Column:
    a = col(actuals)
    return 100 * F.avg(F.abs(col(predictions) - a) / F.greatest(F.abs(a), F.lit(epsilon)))


def compute_smape(predictions, actuals) -> Column:
    """Rows with both values zero are left out; 0 if no other is there."""
    p, a = col(predictions), col(actuals)
    size = F.abs(p) + F.abs(a)
    return F.coalesce(100 * F.avg(F.when(size > 0, 2 * F.abs(p - a) / size)), F.lit(0.0))


def compute_mase(predictions, actuals, naive_mae) -> Column:
    """naive_mae: an aggregate or literal; not positive gives null."""
    n = naive_mae if isinstance(naive_mae, Column) else F.lit(naive_mae)
    return F.when(n > 0, compute_mae(predictions, actuals) / n)


mase = compute_mase


def compute_mrae(predictions, actuals, naive_predictions) -> Column:
    a = col(actuals)
    base = F.abs(col(naive_predictions) - a)
    return F.avg(F.when(base > 0, F.abs(col(predictions) - a) / base))


def compute_theils_u(predictions, actuals, naive_predictions) -> Column:
    """RMSE against that of the naive forecast; without naive error 1 if the model has none either, else infinite.

    The usual naive forecast is the last actual; see `naive_forecast`. Rows without one are left out of both.
    """
    n = col(naive_predictions)
    model = F.avg(F.when(n.isNotNull(), F.pow(col(predictions) - col(actuals), 2)))
    naive = F.avg(F.pow(n - col(actuals), 2))
    return F.when(naive > 0, F.sqrt(model / naive)).when(model > 0, F.lit(float("inf"))).when(model == 0, 1.0)


def compute_r_squared(predictions, actuals) -> Column:
    p, a = col(predictions), col(actuals)
    sse, sst = F.sum(F.pow(a - p, 2)), F.var_pop(a) * F.count(a)
    return F.when(sst > 0, 1 - sse / sst).when(sse == 0, 1.0).when(sse > 0, F.lit(float("-inf")))


def compute_forecast_correlation(predictions, actuals) -> Column:
    """Pearson; for Spearman give it columns of `average_rank`."""
    return F.corr(col(predictions), col(actuals))


def average_rank(value, by: list[str] | None = None) -> Column:
    """Ranks from 1 with ties at their mean, within groups."""
    by = by or []
    return F.rank().over(Window.partitionBy(*by).orderBy(col(value))) + (F.count(F.lit(1)).over(Window.partitionBy(*by, col(value))) - 1) / 2


def ordered(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def naive_forecast(df: DataFrame, value: str, by: list[str], order: list[str], lag: int = 1, name: str = "naive") -> DataFrame:
    """The value `lag` rows before, within series."""
    return df.withColumn(name, F.lag(value, lag).over(ordered(by, order)))


def compute_naive_error(df: DataFrame, value: str, by: list[str], order: list[str], method: str = "persistence") -> DataFrame:
    """One row a series: the mean size of last-value or of mean-value errors; null for fewer than two rows."""
    if method == "persistence":
        return naive_forecast(df, value, by, order).groupBy(*by).agg(F.avg(F.abs(F.col(value) - F.col("naive"))).alias("naive_error"))
    if method != "mean":
        raise ValueError(f"unknown method {method!r}")
    far = df.withColumn("_m", F.avg(value).over(Window.partitionBy(*by)))
    return far.groupBy(*by).agg(F.when(F.count(value) > 1, F.avg(F.abs(F.col(value) - F.col("_m")))).alias("naive_error"))


# --- asymmetric losses: error = actual - prediction ---


def compute_linex_loss(predictions, actuals, a: float = 1.0, b: float = 1.0) -> Column:
    if a == 0 or b <= 0:
        raise ValueError("a must not be 0 and b must be positive")
    x = F.lit(a) * (col(actuals) - col(predictions))
    return F.avg(b * (F.exp(F.least(F.greatest(x, F.lit(-700.0)), F.lit(700.0))) - x - 1))


def compute_asymmetric_mape(predictions, actuals, alpha: float = 0.5, epsilon: float = 1e-8) -> Column:
    a = col(actuals)
    e = a - col(predictions)
    return F.avg(F.when(e > 0, F.lit(alpha)).otherwise(1 - alpha) * F.abs(e) / (F.abs(a) + epsilon))


def compute_directional_loss(predictions, actuals, up_miss_weight: float = 1.0, down_miss_weight: float = 1.0, previous_actuals=None) -> Column:
    """Weighted rate of missed rises and falls; of values, or of changes from previous_actuals."""
    p, a = col(predictions), col(actuals)
    if previous_actuals is not None:
        p, a = p - col(previous_actuals), a - col(previous_actuals)
    up, down = (a > 0) & (p <= 0), (a < 0) & (p >= 0)
    return F.avg(up.cast("double") * up_miss_weight + down.cast("double") * down_miss_weight)


def compute_squared_log_error(predictions, actuals, epsilon: float = 1e-8) -> Column:
    """Null if a value is negative."""
    p, a = col(predictions), col(actuals)
    return F.when(F.min(F.least(p, a)) >= 0, F.avg(F.pow(F.log(a + 1 + epsilon) - F.log(p + 1 + epsilon), 2)))


def compute_huber_loss(predictions, actuals, delta: float = 1.0) -> Column:
    e = F.abs(col(actuals) - col(predictions))
    return F.avg(F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - delta / 2)))


# --- quantiles and intervals: actuals first ---


def compute_pinball_loss(actuals, quantile_preds, tau: float) -> Column:
    e = col(actuals) - col(quantile_preds)
    return F.avg(F.when(e >= 0, tau * e).otherwise((tau - 1) * e))


def compute_interval_score(actuals, lower, upper, alpha: float) -> Column:
    """Null if a lower bound is above its upper one."""
    a, lo, hi = col(actuals), col(lower), col(upper)
    zero = F.lit(0.0)
    score = F.avg((hi - lo) + 2 / alpha * (F.greatest(lo - a, zero) + F.greatest(a - hi, zero)))
    return F.when(F.bool_and(lo <= hi), score)


compute_winkler_score = compute_interval_score


def compute_quantile_coverage(actuals, lower, upper) -> Column:
    a = col(actuals)
    return share((a >= col(lower)) & (a <= col(upper)))


def crps_of(actuals, samples) -> Column:
    """Row value: E|X - y| - E|X - X'| / 2 of an array of samples, from sorted order sums. Null without samples."""
    y, xs = col(actuals), F.array_sort(F.filter(samples, lambda v: v.isNotNull()))
    m = F.size(xs).cast("double")
    near = F.aggregate(xs, F.lit(0.0), lambda s, v: s + F.abs(v - y)) / m
    ranked = F.zip_with(xs, F.sequence(F.lit(0), F.size(xs) - 1), lambda v, k: v * (2 * k + 1 - m))
    spread = F.aggregate(ranked, F.lit(0.0), lambda s, v: s + v) / (m * m)
    return F.when(F.size(xs) > 0, near - spread)


def compute_crps(actuals, samples, energy: bool = True) -> Column:
    """Mean over rows of the energy distance between the samples and the actual, sqrt(2 * CRPS) (what users of
    this metric get by default); energy=False gives the CRPS itself."""
    c = crps_of(actuals, samples)
    return F.avg(F.sqrt(F.greatest(2 * c, F.lit(0.0))) if energy else c)


# --- events and direction probabilities ---


def brier_bin(p, n_bins: int = 10) -> Column:
    return F.least(F.floor(col(p) * n_bins), F.lit(n_bins - 1)).cast("int")


def compute_direction_brier(p, outcome) -> Column:
    return F.avg(F.pow(col(p) - col(outcome), 2))


def compute_multiclass_brier(probs, outcome) -> Column:
    """probs: array of class probabilities, outcome: class number from 0."""
    o = col(outcome)
    return F.avg(F.aggregate(F.transform(probs, lambda q, k: F.pow(q - (k == o).cast("double"), 2)), F.lit(0.0), lambda s, v: s + v))


def calibration(df: DataFrame, p: str, outcome: str, n_bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """(by, bin, n, mean_predicted, observed) for each bin, empty ones with n = 0."""
    by = by or []
    got = df.where(F.col(p).isNotNull() & F.col(outcome).isNotNull()).groupBy(*by, brier_bin(p, n_bins).alias("bin"))
    got = got.agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_predicted"), F.avg(F.col(outcome).cast("double")).alias("observed"))
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    grid = df.select(*by).distinct().crossJoin(F.broadcast(bins)) if by else bins
    return grid.join(got, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def compute_calibrated_direction_brier(df: DataFrame, p: str, outcome: str, n_bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """calibration's rows with the group's Brier score beside them."""
    by = by or []
    score = df.groupBy(*by).agg(compute_direction_brier(p, F.col(outcome).cast("double")).alias("brier"))
    return with_group_values(calibration(df, p, outcome, n_bins, by), score, by)


def brier_decomposition(df: DataFrame, p: str, outcome: str, n_bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """(by, brier, reliability, resolution, uncertainty, skill_score, n): Murphy's decomposition over equal bins; two-level aggregation."""
    by = by or []
    o = F.col(outcome).cast("double")
    bins = df.where(F.col(p).isNotNull() & o.isNotNull()).groupBy(*by, brier_bin(p, n_bins).alias("bin"))
    bins = bins.agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(o).alias("so"), F.sum(F.pow(F.col(p) - o, 2)).alias("se"))
    n, so = F.sum("n"), F.sum("so")
    rel = F.sum(F.pow(F.col("sp") / F.col("n") - F.col("so") / F.col("n"), 2) * F.col("n")) / n
    # sum of n (o_b - o)^2 = sum of so^2/n - (sum so)^2 / sum n
    res = (F.sum(F.col("so") * F.col("so") / F.col("n")) - so * so / n) / n
    unc = so / n * (1 - so / n)
    brier = F.sum("se") / n
    skill = F.when(unc > 0, 1 - brier / unc)
    return bins.groupBy(*by).agg(brier.alias("brier"), rel.alias("reliability"), res.alias("resolution"), unc.alias("uncertainty"), skill.alias("skill_score"), n.alias("n"))


def compute_pr_auc(df: DataFrame, p: str, outcome: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """(by, pr_auc, baseline, precision_at_50_recall, n_positive, n_total): trapezoid under the
    precision-recall curve from (0, baseline); ties in p go by `tie`. 0 (and no precision) without positives, 1 without negatives.

    Rows of a group are ordered in a window; for a group too large for one task, give `by` a key of parts.
    """
    by = by or []
    o = F.col(outcome).cast("double")
    w = Window.partitionBy(*by).orderBy(F.desc(p), F.asc(tie))
    part = Window.partitionBy(*by)
    tp = F.sum(o).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.select(*by, p, tie, o.alias("_o"), tp.alias("_tp"), F.row_number().over(w).alias("_k"), F.sum(o).over(part).alias("_pos"), F.count(F.lit(1)).over(part).alias("_n"))
    rows = rows.withColumn("_pr", F.col("_tp") / F.col("_k")).withColumn("_rc", F.when(F.col("_pos") > 0, F.col("_tp") / F.col("_pos")))
    base = F.col("_pos") / F.col("_n")
    before_p, before_r = F.coalesce(F.lag("_pr").over(w), base), F.coalesce(F.lag("_rc").over(w), F.lit(0.0))
    rows = rows.withColumn("_area", (F.col("_rc") - before_r) * (F.col("_pr") + before_p) / 2)
    pos, n = F.max("_pos"), F.max("_n")
    near = F.min_by("_pr", F.struct(F.abs(F.col("_rc") - 0.5), F.col("_k")))
    area = F.when(pos == 0, 0.0).when(pos == n, 1.0).otherwise(F.sum("_area"))
    half = F.when(pos == n, 1.0).when(pos > 0, near)
    return rows.groupBy(*by).agg(area.alias("pr_auc"), F.max(base).alias("baseline"), half.alias("precision_at_50_recall"), pos.cast("long").alias("n_positive"), n.alias("n_total"))


def convert_predictions_to_direction_probs(point_predictions, prediction_std, threshold: float = 0.0) -> Column:
    """Row value: the normal probability of exceeding the threshold."""
    sd = F.greatest(col(prediction_std), F.lit(1e-10))
    return 1 - norm_cdf_col((F.lit(threshold) - col(point_predictions)) / sd)


# --- trading ---


def _ratio(mean: Column, sd: Column, annualization: float) -> Column:
    none = F.when(mean > 0, F.lit(float("inf"))).when(mean < 0, F.lit(float("-inf"))).otherwise(0.0)
    return F.when(sd > 0, mean / sd * F.sqrt(F.lit(annualization))).when(sd == 0, none)


def compute_sharpe_ratio(returns, risk_free_rate: float = 0.0, annualization: float = 252.0) -> Column:
    r = col(returns) - risk_free_rate
    return _ratio(F.avg(r), F.stddev_samp(r), annualization)


def compute_information_ratio(portfolio_returns, benchmark_returns, annualization: float = 252.0) -> Column:
    r = col(portfolio_returns) - col(benchmark_returns)
    return _ratio(F.avg(r), F.stddev_samp(r), annualization)


def compute_cumulative_return(returns, method: str = "geometric") -> Column:
    if method not in ("geometric", "arithmetic"):
        raise ValueError(f"unknown method {method!r}")
    return F.product(1 + col(returns)) - 1 if method == "geometric" else F.sum(col(returns))


def compute_hit_rate(predicted_changes, actual_changes) -> Column:
    """Equal signs; a change of zero on either side counts as a hit."""
    p, a = F.signum(col(predicted_changes)), F.signum(col(actual_changes))
    return share((p == a) | (p == 0) | (a == 0))


def compute_profit_factor(predicted_changes, actual_changes, returns=None) -> Column:
    r = col(actual_changes if returns is None else returns)
    gain = F.signum(col(predicted_changes)) * r
    won, lost = F.coalesce(F.sum(F.when(gain > 0, gain)), F.lit(0.0)), F.coalesce(F.sum(F.when(gain < 0, -gain)), F.lit(0.0))
    return F.when(lost > 0, won / lost).when(won > 0, F.lit(float("inf"))).otherwise(0.0)


def drawdown(df: DataFrame, returns: str, by: list[str], order: list[str]) -> DataFrame:
    """Adds `curve` (running product of 1 + r) and `drawdown` from its running maximum, which starts at the first value."""
    w = ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("curve", F.product(1 + F.col(returns)).over(w))
    top = F.max("curve").over(w)
    return df.withColumn("drawdown", F.when(top != 0, (top - F.col("curve")) / top).otherwise(0.0))


def compute_max_drawdown(df: DataFrame, returns: str, by: list[str], order: list[str]) -> DataFrame:
    return drawdown(df, returns, by, order).groupBy(*by).agg(F.max("drawdown").alias("max_drawdown"))


def compute_calmar_ratio(df: DataFrame, returns: str, by: list[str], order: list[str], annualization: float = 252.0) -> DataFrame:
    """Annualised geometric return over the greatest drawdown; infinite or 0 without one."""
    grown = F.pow(F.product(1 + F.col(returns)), F.lit(annualization) / F.count(returns)) - 1
    deep = F.max("drawdown")
    calmar = F.when(deep > 0, grown / deep).when(grown > 0, F.lit(float("inf"))).otherwise(0.0)
    return drawdown(df, returns, by, order).groupBy(*by).agg(calmar.alias("calmar"))


# --- volatility ---


def rolling_volatility(df: DataFrame, value: str, by: list[str], order: list[str], window: int = 13, min_periods: int | None = None, name: str = "volatility") -> DataFrame:
    """Trailing sample deviation; leading gaps take the first value that follows (a look-ahead that users of this estimator get)."""
    least = window // 2 if min_periods is None else min_periods
    w = ordered(by, order).rowsBetween(-(window - 1), 0)
    raw = F.when(F.count(value).over(w) >= max(least, 2), F.stddev_samp(value).over(w))
    df = df.withColumn("_raw", raw)
    first = F.first("_raw", ignorenulls=True).over(ordered(by, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(name, F.coalesce("_raw", first)).drop("_raw")


def compute_volatility_normalized_mae(predictions, actuals, volatility, epsilon: float = 1e-8) -> Column:
    return F.avg(F.abs(col(predictions) - col(actuals)) / (col(volatility) + epsilon))


def compute_volatility_weighted_mae(predictions, actuals, volatility, weighting: str = "inverse", epsilon: float = 1e-8) -> Column:
    if weighting not in ("inverse", "importance"):
        raise ValueError(f"unknown weighting {weighting!r}")
    w = 1 / (col(volatility) + epsilon) if weighting == "inverse" else col(volatility)
    return F.sum(w * F.abs(col(predictions) - col(actuals))) / F.sum(w)


def percentiles(df: DataFrame, value: Column, shares: list[float], by: list[str], names: list[str]) -> DataFrame:
    """Linear percentiles of each group, one row a group; nulls don't count.

    Values are counted, and the two neighbours of each percentile found by running counts, in sorted partitions that can spill.
    """
    counts = df.select(*by, value.cast("double").alias("_v")).groupBy(*by, "_v").agg(F.count("_v").alias("_c"))
    w = Window.partitionBy(*by)
    counts = counts.withColumn("_to", F.sum("_c").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    at = [(F.col("_n") - 1) * F.lit(float(s)) for s in shares]
    holds = lambda k: F.max(F.when((F.col("_to") - F.col("_c") <= k) & (k < F.col("_to")), F.col("_v")))
    found = [c.alias(f"_{k}{i}") for i, p in enumerate(at) for k, c in (("lo", holds(F.floor(p))), ("hi", holds(F.ceil(p))), ("d", F.max(p - F.floor(p))))]
    out = counts.groupBy(*by).agg(*found)
    return out.select(*by, *[between(F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_d{i}")).alias(n) for i, n in enumerate(names)])


def between(lo: Column, hi: Column, d: Column) -> Column:
    """lo * (1 - d) + hi * d with the first product unrounded, as a fused multiply-add gives it.

    A percentile between values that differ by a rounding error only must fall on the same one as in SQL engines, or all rows
    tied there change their class. Products and sums carry their rounding errors along (Dekker, Knuth).
    """
    w, c, split = 1 - d, hi * d, F.lit(134217729.0)
    top = lambda x: x * split - (x * split - x)
    p, s = lo * w, lo * w + c
    a, b = top(lo), top(w)
    lost = a * b - p + a * (w - b) + (lo - a) * b + (lo - a) * (w - b)
    lost += p - (s - (s - p)) + (c - (s - p))
    return F.when((d == 0) | (lo == hi), lo).when(F.isnan(lost), s).otherwise(s + lost)


def with_group_values(df: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """df with the columns of one row a group; one row in all if there is no group."""
    if not by:
        return df.crossJoin(F.broadcast(values))
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(values[k]) for k in by])
    return df.join(values, on).select(df["*"], *[values[c] for c in values.columns if c not in by])


def compute_volatility_stratified_metrics(df: DataFrame, predictions: str, actuals: str, volatility: str, by: list[str] | None = None, epsilon: float = 1e-8) -> DataFrame:
    """MAE in the terciles of volatility (cuts at 33.33 and 66.67 %), their sizes, overall and normalised MAE."""
    by = by or []
    cuts = percentiles(df, F.col(volatility), [0.3333, 0.6667], by, ["_p33", "_p67"])
    rows = with_group_values(df, cuts, by)
    v, e = F.col(volatility), F.abs(F.col(predictions) - F.col(actuals))
    low, high = v <= F.col("_p33"), v > F.col("_p67")
    parts = {"low": low, "med": ~low & ~high, "high": high}
    return rows.groupBy(*by).agg(
        *[F.avg(F.when(c, e)).alias(f"{k}_mae") for k, c in parts.items()],
        *[F.count_if(c).alias(f"n_{k}") for k, c in parts.items()],
        F.avg(e).alias("overall_mae"),
        compute_volatility_normalized_mae(predictions, actuals, volatility, epsilon).alias("vn_mae"),
    )
