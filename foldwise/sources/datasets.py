"""Panels (series_id, idx, ts, y) from files that others publish, with what is known of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Forecast horizons of the M3 and M4 subsets.
M3_HORIZONS = {"yearly": 6, "quarterly": 8, "monthly": 18, "other": 8}
M4_HORIZONS = {"yearly": 6, "quarterly": 8, "monthly": 18, "weekly": 13, "daily": 14, "hourly": 48}
M5_HORIZON, GLUON_HORIZON, GLUON_TEST = 28, 24, 168
# Interest-rate series that are usually asked for.
FRED_SERIES = {"DGS1": "1-year treasury", "DGS2": "2-year treasury", "DGS5": "5-year treasury", "DGS10": "10-year treasury", "DGS30": "30-year treasury", "FEDFUNDS": "federal funds", "T10Y2Y": "10-year less 2-year"}


class DatasetNotFoundError(FileNotFoundError):
    """Files of a dataset aren't where they were looked for."""

    def __init__(self, name: str, url: str = "", instructions: str = "") -> None:
        super().__init__(f"{name} not found. {instructions} {url}".strip())


@dataclass(frozen=True)
class DatasetMetadata:
    name: str
    frequency: str
    horizon: int
    n_series: int
    total_observations: int
    train_end_idx: int
    official_split: bool = False
    truncated: bool = False
    split_source: str = "computed"
    characteristics: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class TimeSeriesDataset:
    """A panel with its metadata; the split is a filter."""

    metadata: DatasetMetadata
    panel: DataFrame

    def get_train_test_split(self) -> tuple[DataFrame, DataFrame]:
        end = self.metadata.train_end_idx
        return self.panel.where(F.col("idx") < end), self.panel.where(F.col("idx") >= end)


def validate_dataset(dataset: TimeSeriesDataset) -> None:
    """Raise unless the panel has rows, finite values, and rows on either side of the split."""
    n, bad, train = dataset.panel.agg(F.count(F.lit(1)), F.count_if(F.col("y").isNull() | F.isnan("y")), F.count_if(F.col("idx") < dataset.metadata.train_end_idx)).first()
    if not n or bad or not 0 < train < n:
        raise ValueError(f"{dataset.metadata.name}: {n} rows, {bad} without a value, {train} to train on")


def create_synthetic_dataset(spark: SparkSession, n_obs: int = 200, n_series: int = 1, frequency: str = "W", horizon: int = 2, train_fraction: float = 0.8, ar_coef: float = 0.9, noise_std: float = 0.1, seed: int = 42) -> TimeSeriesDataset:
    """A panel of AR(1) series with its split."""
    from foldwise.operators.simulate import synthetic_panel

    panel = synthetic_panel(spark, n_obs, n_series, ar_coef, noise_std, seed)
    return TimeSeriesDataset(DatasetMetadata("synthetic", frequency, horizon, n_series, n_series * n_obs, int(n_obs * train_fraction), False, False, "train fraction", {"ar_coef": str(ar_coef), "noise_std": str(noise_std)}), panel)


def _found(spark: SparkSession, path: str, name: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise DatasetNotFoundError(name, instructions=f"Put it at {path}.")


def sample_series(long: DataFrame, sample_size: int | None, seed: int = 42) -> DataFrame:
    """Rows of sample_size series, chosen by a hash of their name; all without a size."""
    if sample_size is None:
        return long
    ids = long.select("series_id").distinct().orderBy(F.xxhash64("series_id", F.lit(seed)), "series_id").limit(sample_size)
    return long.join(ids, "series_id", "left_semi")


def truncate_to_shortest(long: DataFrame) -> tuple[DataFrame, int]:
    """The first rows of every series, as many as the shortest has; and how many that is."""
    least = long.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
    return long.where(F.col("idx") < least), least


def with_positions(long: DataFrame, time: str, by: str = "series_id") -> DataFrame:
    """Adds idx, a row's place in its series from 0."""
    return long.withColumn("idx", (F.row_number().over(Window.partitionBy(by).orderBy(time)) - 1).cast("long"))


def _panel(spark: SparkSession, path: str, name: str, sample_size: int | None, horizon: int, frequency: str) -> TimeSeriesDataset:
    """A long file (unique_id, ds, y): sampled, cut to the shortest series; the last `horizon` rows of the cut series test."""
    _found(spark, path, name)
    long = spark.read.parquet(path).select(F.col("unique_id").cast("string").alias("series_id"), F.col("ds").alias("ts"), F.col("y").cast("double").alias("y"))
    rows, n = truncate_to_shortest(with_positions(sample_series(long, sample_size), "ts"))
    k = rows.select("series_id").distinct().count()
    return TimeSeriesDataset(DatasetMetadata(name, frequency, horizon, k, k * n, n - horizon, False, True, "tail of the truncated series"), rows)


def load_m3(spark: SparkSession, path: str, subset: str = "monthly", sample_size: int | None = None) -> TimeSeriesDataset:
    return _panel(spark, path, f"m3_{subset}", sample_size, M3_HORIZONS[subset], subset[0].upper())


def load_m4(spark: SparkSession, path: str, subset: str = "monthly", sample_size: int | None = 100) -> TimeSeriesDataset:
    return _panel(spark, path, f"m4_{subset}", sample_size, M4_HORIZONS[subset], subset[0].upper())


def load_m5(spark: SparkSession, path: str, sample_size: int | None = 100, aggregate: bool = True) -> TimeSeriesDataset:
    """A wide CSV with a column d_1, d_2, ... a day, unpivoted; summed over the (sampled) series if asked. An empty cell is no row."""
    _found(spark, path, "m5")
    wide = spark.read.option("header", True).csv(path)
    days = [c for c in wide.columns if c.startswith("d_")]
    long = wide.unpivot(["id"], days, "d", "v").select(F.col("id").alias("series_id"), (F.substring("d", 3, 9).cast("long") - 1).alias("idx"), F.col("v").cast("double").alias("y"))
    long = sample_series(long.where("y is not null"), sample_size)
    if aggregate:
        long = long.groupBy("idx").agg(F.sum("y").alias("y")).select(F.lit("total").alias("series_id"), "idx", "y")
    k, n = long.agg(F.count_distinct("series_id"), F.count(F.lit(1))).first()
    return TimeSeriesDataset(DatasetMetadata("m5", "D", M5_HORIZON, k, n, len(days) - M5_HORIZON), long)


def load_fred_rates(spark: SparkSession, path: str, series: str | list[str] = "DGS10", frequency: str = "W", train_fraction: float = 0.8) -> TimeSeriesDataset:
    """A CSV snapshot (date, a column a series): the last value of each week (to Friday) or month, periods with a gap left out."""
    _found(spark, path, "fred")
    names = [series] if isinstance(series, str) else list(series)
    raw = spark.read.option("header", True).csv(path)
    day = F.to_date(raw.columns[0])
    # the Friday on or after a day ends its week
    ends = {"D": day, "W": F.next_day(F.date_sub(day, 1), "FRI"), "M": F.last_day(day)}
    long = raw.select(ends[frequency].alias("ts"), day.alias("day"), *[F.expr(f"try_cast(`{n}` as double)").alias(n) for n in names])
    last = long.groupBy("ts").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("day"))).alias(n) for n in names]).dropna()
    rows = with_positions(last.unpivot(["ts"], names, "series_id", "y"), "ts")
    n = rows.groupBy("series_id").count().agg(F.max("count")).first()[0] or 0
    return TimeSeriesDataset(DatasetMetadata("fred_" + "_".join(names), frequency, 2, len(names), n * len(names), int(n * train_fraction)), rows)


def list_available_series() -> dict[str, str]:
    return dict(FRED_SERIES)


def _gluon(spark: SparkSession, path: str, name: str) -> TimeSeriesDataset:
    d = _panel(spark, path, name, None, GLUON_HORIZON, "H")
    m = d.metadata
    n = m.total_observations // max(m.n_series, 1)
    return TimeSeriesDataset(DatasetMetadata(name, "H", GLUON_HORIZON, m.n_series, m.total_observations, n - GLUON_TEST, False, True), d.panel)


def load_electricity(spark: SparkSession, path: str) -> TimeSeriesDataset:
    return _gluon(spark, path, "electricity")


def load_traffic(spark: SparkSession, path: str) -> TimeSeriesDataset:
    return _gluon(spark, path, "traffic")
