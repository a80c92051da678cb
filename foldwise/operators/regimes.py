"""Regimes of volatility and direction, metrics by regime, changepoints and what follows from them."""

from __future__ import annotations


from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.metrics import col, ordered, percentiles, with_group_values


def classify_volatility_regime(df: DataFrame, value: str, by: list[str], order: list[str], window: int = 13, basis: str = "changes", low: float = 33.0, high: float = 67.0, name: str = "vol_regime") -> DataFrame:
    """Adds LOW, MED or HIGH by the rolling deviation (full windows only) of changes or levels against the
    series' own percentiles; MED without history."""
    if basis not in ("changes", "levels"):
        raise ValueError(f"unknown basis {basis!r}")
    w = ordered(by, order)
    df = df.withColumn("_x", F.col(value) - F.lag(value).over(w) if basis == "changes" else F.col(value))
    frame = w.rowsBetween(-(window - 1), 0)
    df = df.withColumn("_sd", F.when(F.count("_x").over(frame) == window, F.stddev_samp("_x").over(frame)))
    df = with_group_values(df, percentiles(df, F.col("_sd"), [low / 100, high / 100], by, ["_lo", "_hi"]), by)
    regime = F.when(F.col("_sd") <= F.col("_lo"), "LOW").when(F.col("_sd") > F.col("_hi"), "HIGH").otherwise("MED")
    return df.withColumn(name, regime).drop("_x", "_sd", "_lo", "_hi")


def classify_direction_regime(values, threshold: float) -> Column:
    v = col(values)
    return F.when(F.abs(v) <= threshold, "FLAT").when(v > 0, "UP").when(v < 0, "DOWN")


def get_combined_regimes(vol, direction) -> Column:
    return F.concat_ws("-", col(vol), col(direction))


def get_regime_counts(df: DataFrame, regime: str) -> DataFrame:
    return df.groupBy(regime).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), regime)


def mask_low_n_regimes(df: DataFrame, regime: str, min_n: int = 10, mask_value: str = "MASKED", name: str = "masked") -> DataFrame:
    """Labels with fewer rows than min_n become mask_value. Counts are aggregated and joined back, so a hot label isn't one task's window."""
    rare = df.groupBy(F.col(regime).alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    met = df.join(rare, df[regime].eqNullSafe(rare["_r"]))
    return met.withColumn(name, F.when(F.col("_n") < min_n, mask_value).otherwise(F.col(regime))).drop("_r", "_n")


def compute_stratified_metrics(df: DataFrame, predictions: str, actuals: str, regime: str, min_n: int = 10, by: list[str] | None = None) -> DataFrame:
    """(by, regime, mae, rmse, n, pct, kept) by regime and overall (regime null) in one pass of grouping sets;
    regimes of fewer than min_n rows have kept false and no metrics."""
    by = by or []
    e = F.col(predictions) - F.col(actuals)
    rows = df.where(e.isNotNull() & F.col(regime).isNotNull()).select(*by, F.col(regime).alias("regime"), e.alias("e"))
    sets = rows.groupingSets([[*[F.col(b) for b in by], F.col("regime")], [F.col(b) for b in by]], *[F.col(b) for b in by], F.col("regime"))
    out = sets.agg(F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.count(F.lit(1)).alias("n"))
    total = F.max(F.when(F.col("regime").isNull(), F.col("n"))).over(Window.partitionBy(*by))
    kept = F.col("regime").isNull() | (F.col("n") >= min_n)
    out = out.withColumn("pct", 100.0 * F.col("n") / total)
    return out.select(*by, "regime", F.when(kept, F.col("mae")).alias("mae"), F.when(kept, F.col("rmse")).alias("rmse"), "n", "pct", kept.alias("kept"))


# --- changepoints ---


def level_shifts(df: DataFrame, value: str, by: list[str], order: list[str], window: int = 8, penalty: float = 3.0, min_segment_length: int = 4) -> DataFrame:
    """Adds `score` (distance of the means of the next and the last `window` values), `threshold` (penalty times the
    robust deviation of changes) and `peak`, whether the score is a local maximum above it."""
    w = ordered(by, order)
    part = Window.partitionBy(*by)
    df = df.withColumn("_d", F.col(value) - F.lag(value).over(w)).withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(part))
    med = percentiles(df, F.col("_d"), [0.5], by, ["_med"])
    df = with_group_values(df, med, by)
    spread = df.groupBy(*by).agg(F.percentile(F.abs(F.col("_d") - F.col("_med")), F.lit(0.5)).alias("_mad"), F.stddev_pop(value).alias("_sd"))
    df = with_group_values(df, spread, by)
    base = F.when(F.col("_mad") * 1.4826 >= 1e-10, F.col("_mad") * 1.4826).when(F.col("_sd") >= 1e-10, F.col("_sd"))
    inside = (F.col("_k") >= window) & (F.col("_k") <= F.col("_n") - window)
    score = F.abs(F.avg(value).over(w.rowsBetween(0, window - 1)) - F.avg(value).over(w.rowsBetween(-window, -1)))
    df = df.withColumn("score", F.when(inside, score)).withColumn("threshold", penalty * base)
    m = min_segment_length
    before = F.coalesce(F.max("score").over(w.rowsBetween(-m, -1)), F.lit(-1.0)) if m else F.lit(-1.0)
    after = F.coalesce(F.max("score").over(w.rowsBetween(1, m - 1)), F.lit(-1.0)) if m > 1 else F.lit(-1.0)
    peak = (F.col("score") > F.col("threshold")) & (before < F.col("score")) & (after <= F.col("score"))
    return df.withColumn("peak", F.coalesce(peak, F.lit(False))).drop("_d", "_n", "_med", "_mad", "_sd").withColumnRenamed("_k", "position")


def detect_changepoints_variance(df: DataFrame, value: str, by: list[str], order: list[str], penalty: float = 3.0, min_segment_length: int = 4, window: int = 8) -> DataFrame:
    """(by, position, cost_reduction) of the level shifts, from the left and at least min_segment_length apart.

    The spacing is a fold over a series' ordered peaks, of which there are few.
    """
    peaks = level_shifts(df, value, by, order, window, penalty, min_segment_length).where("peak")
    found = peaks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("position", "score"))).alias("p"))
    spaced = F.aggregate(
        F.col("p"),
        F.filter("p", lambda x: F.lit(False)),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["position"] - F.element_at(acc, -1)["position"] < min_segment_length), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return found.select(*by, F.explode(spaced).alias("c")).select(*by, F.col("c.position").alias("position"), F.col("c.score").alias("cost_reduction"))


def pelt(y: np.ndarray, penalty: float, min_size: int = 2, cost_model: str = "l2") -> list[int]:
    """Changepoints (first positions of new segments) of least cost by pruned exact search (Killick et al. 2012)."""
    n = len(y)
    s1, s2 = np.concatenate([[0.0], np.cumsum(y)]), np.concatenate([[0.0], np.cumsum(y * y)])
    if cost_model == "rbf":
        far = np.abs(y[:, None] - y[None, :]) ** 2
        gamma = 1 / np.median(far[np.triu_indices(n, 1)]) if n > 1 and np.median(far[np.triu_indices(n, 1)]) > 0 else 1.0
        gram = np.exp(-np.clip(gamma * far, 1e-2, 1e2))
        area = np.zeros((n + 1, n + 1))
        area[1:, 1:] = gram.cumsum(0).cumsum(1)
        diag = np.concatenate([[0.0], np.cumsum(np.diag(gram))])

    def cost(a: int, b: int) -> float:
        if cost_model == "l2":
            return s2[b] - s2[a] - (s1[b] - s1[a]) ** 2 / (b - a)
        if cost_model == "l1":
            return float(np.abs(y[a:b] - np.median(y[a:b])).sum())
        if cost_model == "rbf":
            return diag[b] - diag[a] - (area[b, b] - area[a, b] - area[b, a] + area[a, a]) / (b - a)
        raise ValueError(f"unknown cost model {cost_model!r}")

    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    # a start that is beaten at t stays until a segment that begins at t may end
    alive, until = [0], {}
    for t in range(min_size, n + 1):
        alive = [s for s in alive if until.get(s, t + 1) > t]
        tried = [(best[s] + cost(s, t) + penalty, s) for s in alive if t - s >= min_size and np.isfinite(best[s])]
        if tried:
            best[t], last[t] = min(tried)
            for value, s in tried:
                if value - penalty > best[t]:
                    until.setdefault(s, t + min_size)
        alive.append(t)
    out, t = [], n
    while t > 0 and last[t] > 0:
        t = int(last[t])
        out.append(t)
    return out[::-1]


def detect_changepoints_pelt(df: DataFrame, value: str, by: list[str], order: list[str], penalty: float | str = "bic", min_size: int = 2, cost_model: str = "l2") -> DataFrame:
    """(by, position, cost_reduction) by pelt, one series a task group; penalty bic is log n, aic 2. cost_reduction is the difference of
    the variances of the min_size values on either side."""
    kinds = dict(df.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order)[value].to_numpy(float)
        pen = {"bic": np.log(max(len(y), 1)), "aic": 2.0}.get(penalty, penalty)
        at = pelt(y, float(pen), min_size, cost_model) if len(y) >= 2 * min_size else []
        cost = [abs(np.var(y[max(0, i - min_size) : i]) - np.var(y[i : i + min_size])) for i in at]
        return pd.DataFrame({**{b: [k] * len(at) for b, k in zip(by, key, strict=True)}, "position": np.array(at, int), "cost_reduction": np.array(cost, float)})

    schema = ", ".join([*[f"`{b}` {kinds[b]}" for b in by], "position long, cost_reduction double"])
    return df.select(*by, *order, value).groupBy(*by).applyInPandas(run, schema)


def detect_changepoints(df: DataFrame, value: str, by: list[str], order: list[str], method: str = "auto", penalty: float | str = "bic", min_segment_length: int = 4) -> DataFrame:
    if method in ("auto", "pelt"):
        return detect_changepoints_pelt(df, value, by, order, penalty, min_segment_length)
    if method != "variance":
        raise ValueError(f"unknown method {method!r}")
    return detect_changepoints_variance(df, value, by, order, 3.0 if isinstance(penalty, str) else penalty, min_segment_length)


def with_segments(df: DataFrame, by: list[str], order: list[str], changepoints: DataFrame) -> DataFrame:
    """Adds `position` and `segment` (from 0): the running number of changepoints."""
    w = ordered(by, order)
    df = df.drop("position").withColumn("position", (F.row_number().over(w) - 1).cast("long"))
    cp = changepoints.select(*by, F.col("position").cast("long").alias("position"), F.lit(1).alias("_cp"))
    return df.join(cp, [*by, "position"], "left").withColumn("segment", F.sum(F.coalesce("_cp", F.lit(0))).over(w)).drop("_cp")


def get_segment_boundaries(df: DataFrame, by: list[str], order: list[str], changepoints: DataFrame) -> DataFrame:
    """(by, segment, start, stop), stop exclusive."""
    return with_segments(df, by, order, changepoints).groupBy(*by, "segment").agg(F.min("position").alias("start"), (F.max("position") + 1).alias("stop"))


def classify_regimes_from_changepoints(df: DataFrame, value: str, by: list[str], order: list[str], changepoints: DataFrame, method: str = "volatility", thresholds: tuple[float, float] | None = None) -> DataFrame:
    """Adds `segment`, `segment_value` and `regime` (LOW, MEDIUM, HIGH): a segment's deviation of changes, level or
    slope against the 33rd and 67th percentiles of the series' segments (half and one and a half of their mean below three)."""
    rows = with_segments(df, by, order, changepoints)
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*by, "segment").orderBy(*order))
    kinds = {"volatility": F.stddev_pop("_step"), "level": F.avg(value), "trend": F.regr_slope(F.col(value), F.col("position").cast("double"))}
    if method not in kinds:
        raise ValueError(f"unknown method {method!r}")
    rows = rows.withColumn("_step", step)
    values = rows.groupBy(*by, "segment").agg(F.coalesce(kinds[method], F.lit(0.0)).alias("segment_value"))
    if thresholds is None:
        pct = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"), F.percentile("segment_value", F.lit(0.33)).alias("_a"), F.percentile("segment_value", F.lit(0.67)).alias("_b"), F.avg("segment_value").alias("_v"))
        cuts = pct.select(*by, F.when(F.col("_m") >= 3, F.col("_a")).otherwise(F.col("_v") * 0.5).alias("_lo"), F.when(F.col("_m") >= 3, F.col("_b")).otherwise(F.col("_v") * 1.5).alias("_hi"))
        values = with_group_values(values, cuts, by)
    else:
        values = values.withColumn("_lo", F.lit(thresholds[0])).withColumn("_hi", F.lit(thresholds[1]))
    v = F.col("segment_value")
    values = values.withColumn("regime", F.when(v < F.col("_lo"), "LOW").when(v > F.col("_hi"), "HIGH").otherwise("MEDIUM")).drop("_lo", "_hi")
    return rows.drop("_step").join(values, [*by, "segment"])


def create_regime_indicators(df: DataFrame, value: str, by: list[str], order: list[str], changepoints: DataFrame, recent_window: int = 4) -> DataFrame:
    """Adds periods_since_change, is_regime_change (within recent_window after one), and regime with its three 0/1 columns."""
    rows = classify_regimes_from_changepoints(df, value, by, order, changepoints)
    since = F.col("position") - F.min("position").over(Window.partitionBy(*by, "segment"))
    rows = rows.withColumn("periods_since_change", since).withColumn("is_regime_change", F.col("periods_since_change").between(1, recent_window).cast("int"))
    return rows.select("*", *[(F.col("regime") == r).cast("int").alias(f"regime_{r.lower()}") for r in ("LOW", "MEDIUM", "HIGH")])


def ewma_volatility(df: DataFrame, value: str, by: list[str], order: list[str], span: float = 13, name: str = "volatility") -> DataFrame:
    """Adds the root of the recursive mean of squared deviations from the series' mean, with alpha = 2 / (span + 1).

    The recursion needs a series in order, so a series is one group; it streams through numpy.
    """
    alpha = 2 / (span + 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        d = (pdf[value] - pdf[value].mean()) ** 2
        return pdf.assign(**{name: np.sqrt(d.ewm(alpha=alpha, adjust=False).mean())})

    return df.groupBy(*by).applyInPandas(run, f"{df._jdf.schema().toDDL()}, `{name}` double")


def garch_path(x: np.ndarray, a: Sequence[float], b: Sequence[float]) -> np.ndarray:
    """Variances of a GARCH with weights a of past squares and b of past variances, around the variance of x, at which it starts."""
    v, sq = max(x.var(), 1e-12), x * x
    base, h = v * (1 - sum(a) - sum(b)), np.empty(len(x))
    first = max(len(a), len(b))
    for t in range(len(x)):
        if t < first:
            # before the first row, squares and variances are v
            h[t] = base + sum(w * (sq[t - i] if t >= i else v) for i, w in enumerate(a, 1)) + sum(w * (h[t - j] if t >= j else v) for j, w in enumerate(b, 1))
        else:
            h[t] = base + sum(w * sq[t - i] for i, w in enumerate(a, 1)) + sum(w * h[t - j] for j, w in enumerate(b, 1))
    return h


def garch_fit(x: np.ndarray, p: int = 1, q: int = 1) -> tuple[list[float], list[float]]:
    """Weights by Gaussian quasi-likelihood: the best of a few starts, refined coordinate by coordinate."""

    def loss(w: tuple[float, ...]) -> float:
        if min(w) < 0 or sum(w) >= 0.999:
            return np.inf
        h = garch_path(x, w[:p], w[p:])
        return float((np.log(h) + x * x / h).sum())

    best = min((tuple([a / p] * p + [b / q] * q) for a in (0.02, 0.05, 0.1, 0.2, 0.3) for b in (0.0, 0.3, 0.6, 0.8, 0.9)), key=loss)
    step, value = 0.05, loss(best)
    while step > 1e-3:
        moves = [(*best[:k], best[k] + d, *best[k + 1 :]) for k in range(p + q) for d in (-step, step)]
        moves += [tuple(v + d * (k == i) - d * (k == j) for k, v in enumerate(best)) for i in range(p + q) for j in range(p + q) if i != j for d in (step,)]
        near = min(moves, key=loss)
        if (new := loss(near)) < value:
            best, value = near, new
        else:
            step /= 2
    return list(best[:p]), list(best[p:])


def garch_volatility(df: DataFrame, value: str, by: list[str], order: list[str], name: str = "volatility", p: int = 1, q: int = 1) -> DataFrame:
    """Adds the deviation of a Gaussian GARCH(p, q) fitted to 100 times a series' values, less their mean, by quasi-likelihood; null for fewer than 10 rows."""
    if p < 1 or q < 1:
        raise ValueError("p and q must be 1 at least")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[value].to_numpy(float)
        if len(x) < 10:
            return pdf.assign(**{name: np.nan})
        x = (x - x.mean()) * 100
        return pdf.assign(**{name: np.sqrt(garch_path(x, *garch_fit(x, p, q))) / 100})

    return df.groupBy(*by).applyInPandas(run, f"{df._jdf.schema().toDDL()}, `{name}` double")


def compute_local_volatility(df: DataFrame, value: str, by: list[str], order: list[str], window: int = 13, method: str = "rolling_std", name: str = "volatility") -> DataFrame:
    from foldwise.operators.metrics import rolling_volatility

    if method == "rolling_std":
        return rolling_volatility(df, value, by, order, window, name=name)
    if method not in ("ewm", "garch"):
        raise ValueError(f"unknown method {method!r}")
    return ewma_volatility(df, value, by, order, window, name) if method == "ewm" else garch_volatility(df, value, by, order, name)
