"""Prediction intervals with finite-sample coverage, in batch form (streaming ones are in foldwise.streaming)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.metrics import col, compute_interval_score, compute_quantile_coverage, ordered, share, with_group_values

#: Calibration rows that a quantile needs.
LEAST = 10
#: Buckets that part residuals for numbering, and log2 of the residuals in a block.
BUCKETS, BLOCK_BITS = 256, 10


def conformal_quantile(df: DataFrame, score: Column, by: list[str], alpha: float = 0.05, name: str = "q") -> DataFrame:
    """(by, n, q): the order statistic at level min(1, ceil((n + 1)(1 - alpha)) / n), rounded up to a value that occurs;
    null below LEAST rows.

    Exact by a count of equal scores and a running total, so ties and hot scores cost one row each.
    """
    rows = df.select(*by, score.alias("_s")).where("_s is not null").groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_s"))
    n = F.sum("_c").over(Window.partitionBy(*by))
    rows = rows.withColumn("_upto", upto).withColumn("n", n)
    level = F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * (1 - alpha)) / F.col("n"))
    place = F.ceil(level * (F.col("n") - 1))
    return rows.groupBy(*by).agg(F.max("n").alias("n"), F.min(F.when((F.col("_upto") > place) & (F.col("n") >= LEAST), F.col("_s"))).alias(name))


class SplitConformalPredictor:
    """Symmetric intervals whose half width is a quantile of calibration errors."""

    def __init__(self, alpha: float = 0.05) -> None:
        if not 0 < alpha < 1:
            raise ValueError("alpha must be between 0 and 1")
        self.alpha = alpha

    def calibrate(self, df: DataFrame, predictions: str, actuals: str, by: list[str]) -> DataFrame:
        """(by, n, q); nothing is held on the driver, so pass it to predict_interval."""
        self.by = by
        return conformal_quantile(df, F.abs(F.col(actuals) - F.col(predictions)), by, self.alpha)

    def predict_interval(self, df: DataFrame, predictions: str, quantiles: DataFrame) -> DataFrame:
        """Adds lower and upper."""
        rows = with_group_values(df, quantiles.select(*self.by, "q"), self.by)
        return rows.withColumn("lower", F.col(predictions) - F.col("q")).withColumn("upper", F.col(predictions) + F.col("q"))


def walk_forward_conformal(df: DataFrame, predictions: str, actuals: str, by: list[str], order: list[str], calibration_fraction: float = 0.3, alpha: float = 0.05) -> DataFrame:
    """The rows after the first share of each series, with q, lower and upper of the rows before; both parts need LEAST rows."""
    w = ordered(by, order)
    part = Window.partitionBy(*by)
    rows = df.where(F.col(predictions).isNotNull() & F.col(actuals).isNotNull()).withColumn("_k", F.row_number().over(w)).withColumn("_cal", F.floor(F.count(F.lit(1)).over(part) * calibration_fraction)).withColumn("_n", F.count(F.lit(1)).over(part))
    rows = rows.where((F.col("_cal") >= LEAST) & (F.col("_n") - F.col("_cal") >= LEAST))
    q = conformal_quantile(rows.where("_k <= _cal"), F.abs(F.col(actuals) - F.col(predictions)), by, alpha).select(*by, "q")
    out = with_group_values(rows.where("_k > _cal"), q, by)
    return out.withColumn("lower", F.col(predictions) - F.col("q")).withColumn("upper", F.col(predictions) + F.col("q")).drop("_k", "_cal", "_n")


def evaluate_interval_quality(df: DataFrame, point: str, lower: str, upper: str, actuals: str, confidence: float, by: list[str] | None = None) -> DataFrame:
    """(by, n, coverage, coverage_gap, mean_width, interval_score, low_coverage, high_coverage, conditional_gap), the last ones
    for sizes of the point below or from its median on, given 20 rows."""
    by = by or []
    size = F.abs(F.col(point))
    rows = with_group_values(df, df.groupBy(*by).agg(F.percentile(size, F.lit(0.5)).alias("_med")), by)
    hit = (F.col(actuals) >= F.col(lower)) & (F.col(actuals) <= F.col(upper))
    low, enough = size < F.col("_med"), F.count(actuals) >= 20
    lo, hi = F.when(enough, share(F.when(low, hit))), F.when(enough, share(F.when(~low, hit)))
    return rows.groupBy(*by).agg(
        F.count(actuals).alias("n"),
        compute_quantile_coverage(actuals, lower, upper).alias("coverage"),
        (compute_quantile_coverage(actuals, lower, upper) - confidence).alias("coverage_gap"),
        F.avg(F.col(upper) - F.col(lower)).alias("mean_width"),
        compute_interval_score(actuals, lower, upper, 1 - confidence).alias("interval_score"),
        lo.alias("low_coverage"),
        hi.alias("high_coverage"),
        F.abs(lo - hi).alias("conditional_gap"),
    )


def compute_coverage_diagnostics(df: DataFrame, idx: str, lower: str, upper: str, actuals: str, target_coverage: float, window_size: int = 50, regime: str | None = None, undercoverage_threshold: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """(by, kind, part, n, coverage, undercovered): overall, by stretch of window_size rows (the last may be shorter) and by regime, in one pass."""
    by = by or []
    hit = ((F.col(actuals) >= F.col(lower)) & (F.col(actuals) <= F.col(upper))).cast("double")
    parts = [F.struct(F.lit("overall").alias("kind"), F.lit("all").alias("part")), F.struct(F.lit("window").alias("kind"), F.floor(F.col(idx) / window_size).cast("string").alias("part"))]
    if regime:
        parts.append(F.struct(F.lit("regime").alias("kind"), F.col(regime).alias("part")))
    rows = df.select(*by, hit.alias("_hit"), F.explode(F.array(*parts)).alias("_p")).groupBy(*by, F.col("_p.kind").alias("kind"), F.col("_p.part").alias("part"))
    out = rows.agg(F.count("_hit").alias("n"), F.avg("_hit").alias("coverage"))
    return out.withColumn("undercovered", F.col("coverage") - target_coverage < -undercoverage_threshold)


# --- online predictors, as ordered folds of a series ---


def aci_step(q: float, error: float, alpha: float, gamma: float) -> float:
    """Adaptive conformal inference: the next half width after an absolute error."""
    return max(0.0, q - gamma * alpha if error <= q else q + gamma * (1 - alpha))


def adaptive_conformal(df: DataFrame, error: Column, by: list[str], order: list[str], q0: float | str, alpha: float = 0.05, gamma: float = 0.1) -> DataFrame:
    """(by, order, error, q, next_q): the half width before and after each row.

    q0 is a number, or a column that holds a series' first half width. The recursion needs a series in order, so a series is
    one group, gone through once.
    """
    kinds = dict(df.dtypes)
    start = F.col(q0) if isinstance(q0, str) else F.lit(float(q0))
    rows = df.select(*by, *order, F.abs(error).cast("double").alias("error"), start.cast("double").alias("_q0")).where("error is not null")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        q, path = float(pdf["_q0"].iloc[0]), []
        for e in pdf["error"].tolist():
            path.append(q)
            q = aci_step(q, e, alpha, gamma)
        return pdf[[*by, *order, "error"]].assign(q=path, next_q=[*path[1:], q])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*by, *order]], "error double, q double, next_q double"])
    return rows.groupBy(*by).applyInPandas(run, schema)


class Bellman:
    """Half widths by value iteration over a grid: least width plus change cost over a horizon at the coverage asked for."""

    def __init__(self, residuals: np.ndarray, alpha: float = 0.05, horizon: int = 5, n_grid: int = 50, gamma: float = 0.1, lambda_reg: float = 0.01) -> None:
        r = np.sort(np.abs(np.asarray(residuals, float)))
        if len(r) < LEAST:
            raise ValueError(f"{len(r)} residuals are too few, {LEAST} are needed")
        self.alpha, self.gamma, self.pool, self.seen = alpha, gamma, r, 1
        lo, hi = max(0.0, np.percentile(r, 5) / 2), max(2 * np.percentile(r, 99), 5 * r.std())
        self.grid = np.linspace(lo, hi, n_grid)
        self.change = lambda_reg * (self.grid[None, :] - self.grid[:, None]) ** 2
        ok = self._feasible()
        value = np.zeros(n_grid)
        for h in range(horizon):
            if h == horizon - 1:
                self.after = value
            if ok.any():
                value = np.where(ok[None, :], 2 * self.grid[None, :] + self.change + value[None, :], np.inf).min(axis=1)
            else:
                value = np.full(n_grid, 2 * self.grid[-1] + value[-1])
        self.value, self.lambda_reg = value, lambda_reg
        n = len(r)
        level = min(1.0, math.ceil((n + 1) * (1 - alpha)) / n)
        self.q = float(r[math.ceil(level * (n - 1))])

    def _feasible(self) -> np.ndarray:
        return np.searchsorted(self.pool, self.grid, side="right") / len(self.pool) >= 1 - self.alpha - 0.01

    def best(self, q: float) -> float:
        """The first step of the best path from q."""
        ok = self._feasible()
        if not ok.any():
            return float(self.grid[-1])
        cost = np.where(ok, 2 * self.grid + self.lambda_reg * (self.grid - q) ** 2 + self.after, np.inf)
        return float(self.grid[int(cost.argmin())])

    def update(self, error: float) -> float:
        """Half way to the best step, and half an adaptive step; every 50 steps the error joins the last 100 of the pool."""
        step = -self.gamma * self.alpha if error <= self.q else self.gamma * (1 - self.alpha)
        self.q = max(0.0, self.q + 0.5 * (self.best(self.q) - self.q) + 0.5 * step)
        self.seen += 1
        if self.seen % 50 == 0:
            self.pool = np.sort(np.append(self.pool[-100:], error))
        return self.q

    def sequence(self, steps: int) -> np.ndarray:
        out, q = np.empty(steps), self.q
        for t in range(steps):
            out[t] = q = self.best(q)
        return out


def bellman_conformal(df: DataFrame, error: str, by: list[str], order: list[str], calibration: int = 30, **options) -> DataFrame:
    """(by, order, error, q, next_q) of the rows after the first `calibration` of each series, which start its grid; shorter series give none."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[error]).sort_values(order)
        e = pdf[error].abs().to_numpy(float)
        out = pdf.iloc[calibration:][[*by, *order]].copy()
        if not len(out) or calibration < LEAST:
            return pdf.iloc[:0][[*by, *order]].assign(error=0.0, q=0.0, next_q=0.0)
        b = Bellman(e[:calibration], **options)
        before, after = [], []
        for x in e[calibration:]:
            before.append(b.q)
            after.append(b.update(x))
        return out.assign(error=e[calibration:], q=before, next_q=after)

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*by, *order]], "error double, q double, next_q double"])
    return df.select(*by, *order, error).groupBy(*by).applyInPandas(run, schema)


def _residual_blocks(counted: DataFrame, marks: list[float]) -> DataFrame:
    """(block, values): all residuals in order, 2**BLOCK_BITS to a block, from the distinct ones and their counts.

    Values are parted at `marks` into buckets, whose counts are summed up on the driver, and ordered within a bucket alone.
    A hot residual is one row until it is dealt to the blocks that it fills. Marks change the work, never the numbers.
    """
    bucket = F.size(F.filter(F.array(*[F.lit(x) for x in marks]), lambda x: x < F.col("r"))) if marks else F.lit(0)
    rows = counted.withColumn("b", bucket)
    sums = {x["b"]: x["c"] for x in rows.groupBy("b").agg(F.sum("c").alias("c")).collect()}
    before, at = [], 0
    for b in sorted(sums):
        before.append((b, at))
        at += sums[b]
    offsets = counted.sparkSession.createDataFrame(before, "b int, before long")
    above = F.coalesce(F.sum("c").over(Window.partitionBy("b").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("above", above).join(F.broadcast(offsets), "b").select("r", "c", (F.col("before") + F.col("above")).alias("start"))
    end = F.col("start") + F.col("c")
    rows = rows.withColumn("block", F.explode(F.sequence(F.shiftright("start", BLOCK_BITS), F.shiftright(end - 1, BLOCK_BITS))))
    lo = F.greatest("start", F.shiftleft("block", BLOCK_BITS))
    times = (F.least(end, F.shiftleft(F.col("block") + 1, BLOCK_BITS)) - lo).cast("int")
    held = rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(lo.alias("lo"), "r", times.alias("times")))).alias("held"))
    return held.select("block", F.flatten(F.transform("held", lambda x: F.array_repeat(x["r"], x["times"]))).alias("values"))


def bootstrap_uncertainty(df: DataFrame, predictions: str, residuals: DataFrame, residual: str, key: list[str], n_bootstrap: int = 100, alpha: float = 0.05, seed: int = 42, most: int = 100_000) -> DataFrame:
    """Adds lower and upper: percentiles of the prediction plus resampled residuals.

    All residuals are numbered by value, and numbers are drawn by a hash of the row's key and the replicate, so intervals don't depend
    on partitions. As values rise with their numbers, only the drawn numbers beside the two percentiles are looked up.
    At most `most` residuals are broadcast as one array (after they were counted); more are joined by number, with the same result.
    """
    counted = residuals.where(F.col(residual).isNotNull()).select(F.col(residual).cast("double").alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("c"))
    n, marks = counted.agg(F.sum("c"), F.percentile_approx("r", [k / BUCKETS for k in range(1, BUCKETS)])).first()
    draw = lambda names: F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n_bootstrap - 1)), lambda b: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), *[F.col(x).cast("string") for x in names], b.cast("string"))), 1, 13), 16, 10).cast("long") % F.lit(n).cast("long")))
    at = {p: p * (n_bootstrap - 1) for p in (alpha / 2, 1 - alpha / 2)}
    places = {p: (math.floor(x) + 1, min(math.floor(x) + 2, n_bootstrap)) for p, x in at.items()}
    wanted = sorted({i for pair in places.values() for i in pair})

    if (n or 0) <= most:
        pool = counted.agg(F.array_sort(F.flatten(F.collect_list(F.array_repeat("r", F.col("c").cast("int"))))).alias("_pool"))
        rows = df.crossJoin(F.broadcast(pool)).withColumn("_d", draw(key))
        rows = rows.withColumns({f"_v{i}": F.element_at("_pool", (F.element_at("_d", i) + 1).cast("int")) for i in wanted}).drop("_pool", "_d")
    else:
        blocks = _residual_blocks(counted, sorted({x for x in marks if not math.isnan(x)}))
        named = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)])
        asked = df.select(named.alias("_key")).distinct().withColumn("_d", draw([f"_key.k{i}" for i in range(len(key))]))
        asked = asked.select("_key", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.element_at("_d", i).alias("at")) for i in wanted])))
        met = asked.withColumn("block", F.shiftright("at", BLOCK_BITS)).join(blocks, "block")
        met = met.select("_key", "i", F.element_at("values", (F.col("at") - F.shiftleft("block", BLOCK_BITS) + 1).cast("int")).alias("v"))
        found = met.groupBy("_key").agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"_v{i}") for i in wanted])
        rows = df.withColumn("_key", named).join(found, "_key", "left").drop("_key")

    def pct(p: float) -> Column:
        a, b = (F.col(f"_v{i}") for i in places[p])
        return F.col(predictions) + a + (b - a) * (at[p] - math.floor(at[p]))

    return rows.withColumn("lower", pct(alpha / 2)).withColumn("upper", pct(1 - alpha / 2)).drop(*[f"_v{i}" for i in wanted])
