"""Leak-safe temporal splits as fold tables, and what joins them to series.

A fold table has a row a fold with half-open bounds (fold, train_lo, train_hi, test_lo, test_hi), computed for a
series length on the driver; `assign` joins it to the rows of every series. Purged splitters also have
rows of removed training stretches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = "fold int, train_lo long, train_hi long, test_lo long, test_hi long"
Fold = tuple[int, int, int, int]


@dataclass(frozen=True)
class TemporalTags:
    """What a splitter promises."""

    forward_only: bool = True
    deterministic: bool = True
    produces_oof: bool = False
    requires_groups: bool = False


class Splitter:
    """Common surface: bounds(n) gives (train_lo, train_hi, test_lo, test_hi) of each fold."""

    tags = TemporalTags()

    def bounds(self, n: int) -> list[Fold]:
        raise NotImplementedError

    def get_n_splits(self, n: int | None = None, strict: bool = True) -> int:
        """Folds for a series of n rows (the configured number without n); 0 instead of an error if not strict."""
        if n is None:
            return self.n_splits
        try:
            return len(self.bounds(n))
        except ValueError:
            if strict:
                raise
            return 0

    def folds(self, spark: SparkSession, n: int) -> DataFrame:
        return spark.createDataFrame([(k, *b) for k, b in enumerate(self.bounds(n))], FOLDS)

    def get_split_info(self, spark: SparkSession, n: int) -> DataFrame:
        """The fold table with the gap between train and test."""
        return self.folds(spark, n).withColumn("gap", F.col("test_lo") - F.col("train_hi"))

    def by_length(self, series: DataFrame, by: list[str]) -> DataFrame:
        """(by, n, fold bounds) of each series, by its own length; series too short have no folds.

        Lengths are aggregated first; bounds are worked out once for each distinct length, of which the driver gets at most MOST_LENGTHS.
        """
        lengths = series.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        seen = [r["n"] for r in lengths.select("n").distinct().limit(MOST_LENGTHS + 1).collect()]
        if len(seen) > MOST_LENGTHS:
            raise ValueError(f"more than {MOST_LENGTHS} different series lengths")
        rows = []
        for n in seen:
            if self.get_n_splits(n, strict=False):
                rows += [(n, k, *b) for k, b in enumerate(self.bounds(n))]
        table = series.sparkSession.createDataFrame(rows, f"n long, {FOLDS}")
        return lengths.join(F.broadcast(table), "n")


#: Different series lengths for which fold bounds are worked out on the driver.
MOST_LENGTHS = 100_000


@dataclass(frozen=True)
class WalkForwardCV(Splitter):
    """Folds laid out backwards from the end; train ends horizon + extra_gap rows before the test."""

    n_splits: int = 5
    horizon: int | None = None
    window_type: str = "expanding"
    window_size: int | None = None
    extra_gap: int = 0
    test_size: int = 1

    def __post_init__(self) -> None:
        if self.window_type not in ("expanding", "sliding"):
            raise ValueError(f"unknown window type {self.window_type!r}")
        if self.window_type == "sliding" and self.window_size is None:
            raise ValueError("a sliding window needs a window_size")
        if self.n_splits < 1 or self.test_size < 1 or self.extra_gap < 0:
            raise ValueError("n_splits and test_size must be positive, extra_gap not negative")

    def bounds(self, n: int) -> list[Fold]:
        gap, s = (self.horizon or 0) + self.extra_gap, self.test_size
        least = self.window_size or max(1, n - gap - self.n_splits * s)
        if n < least + gap + s:
            raise ValueError(f"{n} rows are too few")
        out = []
        for k in range(self.n_splits):
            lo = n - (self.n_splits - k) * s
            hi = lo - gap
            start = hi - self.window_size if self.window_type == "sliding" else 0
            if start >= 0 and hi > start:
                out.append((start, hi, lo, lo + s))
        return out


@dataclass(frozen=True)
class TimeSeriesCrossValidator(Splitter):
    """Walk-forward with gap and purge; a sliding window grows by a test size a fold."""

    n_splits: int = 5
    gap: int = 0
    purge_length: int = 0
    test_size: int | None = None
    expanding: bool = True
    min_train_size: int | None = None

    def bounds(self, n: int) -> list[Fold]:
        s = self.test_size or n // (self.n_splits + 1)
        least = self.min_train_size or n // (self.n_splits + 1)
        out = []
        for k in range(self.n_splits):
            lo = n - (self.n_splits - 1 - k) * s - s
            hi = lo - self.gap - self.purge_length
            start = 0 if self.expanding else max(0, hi - (least + k * s))
            if hi - start < least:
                start = max(0, hi - least)
            if s < 1 or hi <= start:
                raise ValueError(f"fold {k} has no train rows for {n} rows")
            out.append((start, hi, lo, lo + s))
        return out


@dataclass(frozen=True)
class BlockedTimeSeriesCV(Splitter):
    """Whole blocks of rows; train is every block before the gap."""

    n_splits: int = 5
    block_size: int | None = None
    gap_blocks: int = 1
    test_blocks: int | None = None

    def bounds(self, n: int) -> list[Fold]:
        b = self.block_size or n // (2 * self.n_splits + self.gap_blocks + 1)
        if b < 1:
            raise ValueError(f"{n} rows are too few")
        blocks = n // b
        t = self.test_blocks or max(1, blocks // (self.n_splits + 1))
        out = []
        for k in range(self.n_splits):
            lo = blocks - (self.n_splits - 1 - k) * t - t
            if lo - self.gap_blocks < 1:
                raise ValueError(f"fold {k} has no train blocks for {n} rows")
            out.append((0, (lo - self.gap_blocks) * b, lo * b, (lo + t) * b))
        return out


@dataclass(frozen=True)
class CrossFitCV(Splitter):
    """Contiguous folds predicted from everything before them; the first is never predicted."""

    n_splits: int = 5
    extra_gap: int = 0
    test_size: int | None = None
    tags = TemporalTags(produces_oof=True)

    def bounds(self, n: int) -> list[Fold]:
        f = self.test_size or n // self.n_splits
        if f < 1 or self.n_splits < 2:
            raise ValueError(f"{n} rows are too few for {self.n_splits} folds")
        out = []
        for j in range(1, self.n_splits):
            lo, hi = j * f, n if j == self.n_splits - 1 else min((j + 1) * f, n)
            if lo - self.extra_gap > 0 and hi > lo:
                out.append((0, lo - self.extra_gap, lo, hi))
        if not out:
            raise ValueError(f"no fold has train rows for {n} rows")
        return out


def assign(series: DataFrame, folds: DataFrame, idx: str, by: list[str]) -> DataFrame:
    """Rows of each fold with `role` train or test.

    folds: a fold table for all series, or one by series (by_length) with their keys. The few bounds are broadcast
    if they are for all series, else joined by key; the range test then runs in the join.
    """
    keyed = [b for b in by if b in folds.columns]
    inside = F.col(idx).between(F.col("train_lo"), F.col("train_hi") - 1)
    tested = F.col(idx).between(F.col("test_lo"), F.col("test_hi") - 1)
    bounds = folds.select(*keyed, "fold", "train_lo", "train_hi", "test_lo", "test_hi")
    met = series.join(bounds, keyed) if keyed else series.crossJoin(F.broadcast(bounds))
    return met.where(inside | tested).withColumn("role", F.when(inside, "train").otherwise("test"))


# --- purged splitters ---


def estimate_purge_gap(horizon: int, decay_factor: float = 1.0) -> int:
    return math.ceil(horizon * decay_factor)


def compute_label_overlap(series: DataFrame, idx: str, by: list[str], horizon: int) -> DataFrame:
    """Pairs (by, i, j), i <= j, of rows whose labels overlap: closer than the horizon.

    A band join by buckets of the horizon's width: a row meets its own bucket and the next one.
    """
    if horizon < 1:
        raise ValueError("horizon must be positive")
    left = series.select(*by, F.col(idx).alias("i"), F.explode(F.array(F.floor(F.col(idx) / horizon), F.floor(F.col(idx) / horizon) + 1)).alias("_b"))
    right = series.select(*by, F.col(idx).alias("j"), F.floor(F.col(idx) / horizon).alias("_b"))
    return left.join(right, [*by, "_b"]).where((F.col("j") - F.col("i")).between(0, horizon - 1)).drop("_b")


def runs_of(groups: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of half-open stretches in order."""
    out: list[tuple[int, int]] = []
    for a, b in groups:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


class PurgedSplitter(Splitter):
    """Splitters that remove training rows near (purge) and after (embargo) every contiguous run of test rows."""

    purge_gap: int
    embargo_pct: float
    tags = TemporalTags(forward_only=False)

    def tests(self, n: int) -> list[tuple[tuple[int, int], list[tuple[int, int]]]]:
        """Of each fold the train stretch before removal and the runs of test rows."""
        raise NotImplementedError

    def runs(self, spark: SparkSession, n: int) -> DataFrame:
        rows = [(k, lo, hi, a, b) for k, ((lo, hi), runs) in enumerate(self.tests(n)) for a, b in runs]
        return spark.createDataFrame(rows, "fold int, train_lo long, train_hi long, run_lo long, run_hi long")

    def get_n_splits(self, n: int | None = None, strict: bool = True) -> int:
        if n is None:
            return self.n_splits
        try:
            return len(self.tests(n))
        except ValueError:
            if strict:
                raise
            return 0

    def split_rows(self, series: DataFrame, idx: str, by: list[str], n: int) -> DataFrame:
        """Every row in every fold with role test, train, purged or embargoed (rows purged and embargoed are embargoed;
        rows outside the fold's stretch are left out). Runs are few and broadcast; the flags of a row's runs are aggregated."""
        runs = self.runs(series.sparkSession, n)
        width = math.ceil(self.embargo_pct * n)
        span = F.array_agg(F.struct("run_lo", "run_hi"))
        folds = runs.groupBy("fold", "train_lo", "train_hi").agg(span.alias("runs"))
        i = F.col(idx)
        test = F.exists("runs", lambda r: (i >= r["run_lo"]) & (i < r["run_hi"]))
        purge = F.exists("runs", lambda r: (i >= r["run_lo"] - self.purge_gap) & (i < r["run_hi"] + self.purge_gap))
        embargo = F.exists("runs", lambda r: (i >= r["run_hi"]) & (i < r["run_hi"] + width))
        inside = (i >= F.col("train_lo")) & (i < F.col("train_hi"))
        role = F.when(test, "test").when(inside & embargo, "embargoed").when(inside & purge, "purged").when(inside, "train")
        return series.crossJoin(F.broadcast(folds)).withColumn("role", role).where("role is not null").drop("runs", "train_lo", "train_hi")

    def split_detailed(self, series: DataFrame, idx: str, by: list[str], n: int) -> DataFrame:
        """(by, fold, n_train, n_test, n_purged, n_embargoed); raises if a fold keeps no train row."""
        rows = self.split_rows(series, idx, by, n).groupBy(*by, "fold")
        return rows.agg(*[F.count_if(F.col("role") == r).alias(c) for r, c in (("train", "n_train"), ("test", "n_test"), ("purged", "n_purged"), ("embargoed", "n_embargoed"))])

    def check(self, n: int) -> None:
        """Raise if a fold keeps no train row."""
        width = math.ceil(self.embargo_pct * n)
        for k, ((lo, hi), runs) in enumerate(self.tests(n)):
            if not any(all(i < a - self.purge_gap or i >= max(b + self.purge_gap, b + width) for a, b in runs) for i in range(lo, hi)):
                raise ValueError(f"fold {k} keeps no train row of {n}")


@dataclass(frozen=True)
class PurgedKFold(PurgedSplitter):
    """Contiguous test folds, train on both sides."""

    n_splits: int = 5
    purge_gap: int = 0
    embargo_pct: float = 0.01

    def tests(self, n: int):
        if n < self.n_splits:
            raise ValueError(f"{n} rows are too few")
        return [((0, n), [g]) for g in groups(n, self.n_splits)]


def groups(n: int, k: int) -> list[tuple[int, int]]:
    """k contiguous stretches of 0..n, the first n % k one row longer."""
    at, out = 0, []
    for i in range(k):
        size = n // k + (i < n % k)
        out.append((at, at + size))
        at += size
    return out


@dataclass(frozen=True)
class CombinatorialPurgedCV(PurgedSplitter):
    """Every choice of n_test_splits of n_splits groups as test rows."""

    n_splits: int = 5
    n_test_splits: int = 2
    purge_gap: int = 0
    embargo_pct: float = 0.01

    def tests(self, n: int):
        if n < self.n_splits:
            raise ValueError(f"{n} rows are too few")
        parts = groups(n, self.n_splits)
        return [((0, n), runs_of([parts[g] for g in chosen])) for chosen in combinations(range(self.n_splits), self.n_test_splits)]


@dataclass(frozen=True)
class PurgedWalkForward(PurgedSplitter):
    """Walk-forward folds with extra_gap + purge_gap between train and test."""

    n_splits: int = 5
    train_size: int | None = None
    test_size: int | None = None
    purge_gap: int = 0
    embargo_pct: float = 0.01
    extra_gap: int = 0
    tags = TemporalTags()

    def tests(self, n: int):
        s = self.test_size
        if s is None:
            left = n - (self.train_size or n // (self.n_splits + 1)) - self.extra_gap
            if left <= 0:
                raise ValueError(f"{n} rows leave none for tests")
            s = max(1, left // self.n_splits)
        out = []
        for k in range(self.n_splits):
            lo = n - (self.n_splits - k) * s
            hi = lo - self.extra_gap - self.purge_gap
            start = 0 if self.train_size is None else hi - self.train_size
            if start < 0 or hi <= start:
                raise ValueError(f"fold {k} has no room for its train rows in {n}")
            out.append(((start, hi), [(lo, lo + s)]))
        return out


def check_temporal_splitter(splitter: Splitter, spark: SparkSession, n: int = 60) -> None:
    """Raise AssertionError if a splitter breaks its contract: folds not empty, in range, disjoint, forward, deterministic and as many as it says."""
    first, again = splitter.bounds(n), splitter.bounds(n)
    assert first and first == again, "no folds, or not the same twice"
    assert len(first) == splitter.get_n_splits(n), "the number of folds differs"
    for a, b, c, d in first:
        assert 0 <= a < b <= c < d <= n, f"fold {(a, b, c, d)} isn't in order within {n} rows"
