"""Online conformal intervals as stateful streams: errors come in any order within the watermark and are applied in time order."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from foldwise.operators.conformal import Bellman, aci_step


class Adaptive:
    """The half width of adaptive conformal inference."""

    def __init__(self, q0: float, alpha: float = 0.05, gamma: float = 0.1) -> None:
        self.q, self.alpha, self.gamma = q0, alpha, gamma

    def update(self, error: float) -> tuple[float, float]:
        before = self.q
        self.q = aci_step(before, error, self.alpha, self.gamma)
        return before, self.q


class OnlineBellman:
    """The Bellman half width; the first `calibration` errors start its grid and give no interval."""

    def __init__(self, calibration: int = 30, **options) -> None:
        self.need, self.options, self.seen, self.model = calibration, options, [], None

    def update(self, error: float) -> tuple[float, float] | None:
        if self.model is None:
            self.seen.append(error)
            if len(self.seen) == self.need:
                self.model, self.seen = Bellman(np.array(self.seen), **self.options), []
            return None
        before = self.model.q
        return before, self.model.update(error)


STATE = "model binary, at array<long>, ids array<long>, errors array<double>"


def online_intervals(stream: DataFrame, key: str, ts: str, tie: str, error: str, make: Callable[[], object], delay: str = "1 hour") -> DataFrame:
    """(key, ts, tie, error, q, next_q) of a stream of absolute errors, one predictor a key.

    Rows wait in state until the watermark passes them and are then applied by (ts, tie); rows later than the watermark
    are dropped by Spark, which counts them. State is what waits and one predictor. The last rows of a stream come out
    when later ones move the watermark.
    """
    kind = dict(stream.dtypes)[key]

    def run(group: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        model, at, ids, errors = state.get if state.exists else (None, [], [], [])
        model = make() if model is None else pickle.loads(model)
        rows = list(zip(at, ids, errors, strict=True))
        if not state.hasTimedOut:
            for pdf in pdfs:
                rows += list(zip((pdf["ms"]).tolist(), pdf["tie"].tolist(), pdf["error"].tolist(), strict=True))
        mark = state.getCurrentWatermarkMs()
        ready, wait = sorted(r for r in rows if r[0] < mark), [r for r in rows if r[0] >= mark]
        out = []
        for ms, i, e in ready:
            if (got := model.update(e)) is not None:
                out.append((group[0], ms, i, e, *got))
        state.update((pickle.dumps(model), *([r[k] for r in wait] for k in range(3))))
        if wait:
            state.setTimeoutTimestamp(max(min(r[0] for r in wait), mark) + 1)
        yield pd.DataFrame(out, columns=["key", "ms", "tie", "error", "q", "next_q"])

    rows = stream.withWatermark(ts, delay).select(F.col(key).alias("key"), F.col(ts), F.unix_millis(ts).alias("ms"), F.col(tie).cast("long").alias("tie"), F.abs(F.col(error)).cast("double").alias("error"))
    out = rows.where("error is not null").groupBy("key").applyInPandasWithState(run, f"key {kind}, ms long, tie long, error double, q double, next_q double", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("key").alias(key), F.timestamp_millis("ms").alias(ts), F.col("tie").alias(tie), "error", "q", "next_q")


def windowed_coverage(stream: DataFrame, ts: str, actual: str, lower: str, upper: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(window, n, coverage) of tumbling time windows, closed by the watermark."""
    hit = F.col(actual).between(F.col(lower), F.col(upper)).cast("double")
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("window")).agg(F.count(hit).alias("n"), F.avg(hit).alias("coverage"))
