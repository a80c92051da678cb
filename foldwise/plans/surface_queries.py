"""Queries of kernels, validators, objects with settings, files of results and panels, reports and chart frames, with their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions import results as kinds
from foldwise.functions.draws import draw_sql
from foldwise.operators import compare, conformal, gates, hac, metrics, models, moves, protocols, regimes, resampling, splits
from foldwise.plans import display
from foldwise.plans.inference_queries import BY, FORECASTS, LAGS3, LENGTHS, ADAPTERS, QS, improvements, one_series, simple_forecasts, split_conformal, suite, supervised
from foldwise.plans.kernel_queries import ONE, fitted, ridge
from foldwise.plans.metric_queries import SPACED, VOL, EVENTS, event_probabilities
from foldwise.plans.registry import DAILY, FC, PANEL, add, rounded
from foldwise.sources import datasets
from foldwise.sources import results as files
from foldwise.sources.tables import daily, forecasts, panel, scratch_path
from foldwise.streaming import online

WEIGHT = {"bartlett": hac.bartlett_kernel, "parzen": hac.parzen_kernel, "quadratic_spectral": hac.quadratic_spectral_kernel}
add("kernel_weights", lambda s, d: s.createDataFrame([(k, b, j, round(f(j, b), 9)) for k, f in WEIGHT.items() for b in (1, 4, 9) for j in range(8)], "kernel string, bandwidth int, lag int, weight double"), """with g as (select b::int as bandwidth, j::int as lag, j / (b + 1) as z, 6 * pi() * j / (5 * (b + 1)) as x from (select unnest([1, 4, 9]) as b), range(8) t(j))
select 'bartlett' as kernel, bandwidth, lag, round(greatest(0.0, 1 - z), 9) as weight from g union all select 'parzen', bandwidth, lag, round(case when z <= 0.5 then 1 - 6 * z * z + 6 * z * z * z else greatest(0.0, 2 * pow(1 - z, 3)) end, 9) from g
union all select 'quadratic_spectral', bandwidth, lag, round(case when lag = 0 then 1.0 else 3 / (x * x) * (sin(x) / x - cos(x)) end, 9) from g""")
PLUGS = [("newey_west", "bartlett"), *[("andrews", k) for k in hac.KERNELS]]
add("optimal_bandwidth", lambda s, d: s.createDataFrame([(m, k, hac.optimal_bandwidth(daily(s, d), "y", ["idx"], m, k)) for m, k in PLUGS], "method string, kernel string, bandwidth int"), f"""with {DAILY}, l as (select y, lag(y) over (order by idx) as l from s), c as (select count(y) as n, least(greatest(corr(y, l), -0.99), 0.99) as r from l)
select 'newey_west' as method, 'bartlett' as kernel, floor(round(pow(n, 1.0 / 3), 9))::int as bandwidth from c union all select 'andrews', 'bartlett', least(floor(1.1447 * pow(4 * r * r / pow(1 - r * r, 2) * n, 1.0 / 3)), n - 1)::int from c
union all select 'andrews', 'parzen', least(floor(2.6614 * pow(4 * r * r / pow(1 - r, 4) * n, 0.2)), n - 1)::int from c union all select 'andrews', 'quadratic_spectral', least(floor(1.3221 * pow(4 * r * r / pow(1 - r, 4) * n, 0.2)), n - 1)::int from c""")


def sandwich(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.with_lags(daily(spark, sf_dir), "y", BY, ["idx"], (1,)).select("idx", F.lit(1.0).alias("one"), (F.col("y_lag1") / 1e6).alias("x"), ((F.col("y") - F.col("y_lag1")) / 1e6).alias("u"))
    cov = hac.newey_west_covariance(rows, "u", ["one", "x"], ["idx"], 3)
    return spark.createDataFrame([(i, j, round(float(cov[i, j]), 9)) for i in range(2) for j in range(2)], "i int, j int, covariance double")


add("newey_west_covariance", sandwich, f"""with {DAILY}, r as (select idx, l / 1e6 as x, (y - l) / 1e6 as u from (select idx, y, lag(y) over (order by idx) as l from s) where l is not null), z as (select idx, x, u as a, x * u as b from r),
l as (select *, {", ".join(f"lag(a, {h}) over (order by idx) as a{h}, lag(b, {h}) over (order by idx) as b{h}" for h in (1, 2, 3))} from z),
c as (select count(*) as n, sum(x) as sx, sum(x * x) as sxx, {" + ".join(["sum(a * a)", *[f"2 * {1 - h / 4} * sum(a * a{h})" for h in (1, 2, 3)]])} as aa, {" + ".join(["sum(a * b)", *[f"{1 - h / 4} * (sum(a * b{h}) + sum(a{h} * b))" for h in (1, 2, 3)]])} as ab, {" + ".join(["sum(b * b)", *[f"2 * {1 - h / 4} * sum(b * b{h})" for h in (1, 2, 3)]])} as bb from l),
v as (select *, n * sxx - sx * sx as d from c), i as (select aa, ab, bb, sxx / d as p, -sx / d as q, n / d as r from v)
select 0 as i, 0 as j, round(p * p * aa + 2 * p * q * ab + q * q * bb, 9) as covariance from i union all select 1, 1, round(q * q * aa + 2 * q * r * ab + r * r * bb, 9) from i
union all select 0, 1, round(p * q * aa + (p * r + q * q) * ab + q * r * bb, 9) from i union all select 1, 0, round(p * q * aa + (p * r + q * q) * ab + q * r * bb, 9) from i""")
SPLITTERS = {"walk_forward": splits.WalkForwardCV(7, 2, test_size=3), "time_series": splits.TimeSeriesCrossValidator(4, 1), "blocked": splits.BlockedTimeSeriesCV(3, 4, 1), "cross_fit": splits.CrossFitCV(5)}


def split_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By length of series, as many rows as there are lengths."""
    return spark.createDataFrame([(name, n, cv.get_n_splits(n, strict=False), splits.estimate_purge_gap(n % 7 + 1, 1.5), resampling.compute_block_length(n), hac.test_bandwidth(n)) for n in range(20, 120, 3) for name, cv in SPLITTERS.items()], "splitter string, n int, folds int, purge_gap int, block_length int, bandwidth int")


add("split_numbers", split_numbers, """with k as (select name, n::int as n from (select unnest(['walk_forward', 'time_series', 'blocked', 'cross_fit']) as name), range(20, 120, 3) t(n))
select name as splitter, n, case name when 'walk_forward' then case when n >= 24 then 7 else least(7, (n - 2 - 1) // 3) end when 'time_series' then 4 when 'blocked' then 3 else 4 end::int as folds, ceil((n % 7 + 1) * 1.5)::int as purge_gap, greatest(1, floor(round(pow(n, 1.0 / 3), 9)))::int as block_length, greatest(1, floor(4 * pow(n / 100, 2.0 / 9)))::int as bandwidth from k""")
add("calibrated_direction_brier", lambda s, d: rounded(metrics.compute_calibrated_direction_brier(event_probabilities(s, d), "p", "o", 5, ["g"]), "mean_predicted", "observed", "brier"), f"""with {EVENTS}, b as (select user_id % 10 as g, least(floor(p * 5), 4)::int as bin, count(*) as n, avg(p) as mp, avg(o) as ob from e group by all), t as (select user_id % 10 as g, avg(pow(p - o, 2)) as brier from e group by 1)
select t.g, k::int as bin, coalesce(n, 0) as n, round(mp, 6) as mean_predicted, round(ob, 6) as observed, round(brier, 6) as brier from t cross join range(5) r(k) left join b on b.g = t.g and b.bin = k""")
EWM = f"""{PANEL}, z as (select series_id, idx, pow(y - avg(y) over (partition by series_id), 2) as v from s), w(series_id, idx, v) as (select series_id, idx, v from z where idx = 0 union all select z.series_id, z.idx, 2.0 / 14 * z.v + (1 - 2.0 / 14) * w.v from w join z on z.series_id = w.series_id and z.idx = w.idx + 1)"""
add("local_volatility", lambda s, d: rounded(regimes.compute_local_volatility(forecasts(s, d), "y", BY, ["idx"], 13).select("series_id", "idx", "volatility"), "volatility"), f"with {VOL} select series_id, idx, round(vol, 6) as volatility from v")


def estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir).select("series_id", "idx", "y")
    ewm = [e.estimate(rows, "y", BY, ["idx"]).select(F.lit(n).alias("estimator"), "series_id", "idx", "volatility") for n, e in (("ewma", protocols.EWMAVolatility(13)), ("local_ewm", type("L", (), {"estimate": lambda self, *a: regimes.compute_local_volatility(*a, 13, "ewm")})()))]
    return rounded(ewm[0].unionByName(ewm[1]), "volatility", digits=4)


add("volatility_estimators", estimators, f"with recursive {EWM} select unnest(['ewma', 'local_ewm']) as estimator, series_id, idx, round(sqrt(v), 4) as volatility from w")
add("rolling_estimator", lambda s, d: rounded(protocols.RollingVolatility(13).estimate(forecasts(s, d), "y", BY, ["idx"]).select("series_id", "idx", "volatility"), "volatility"), f"with {VOL} select series_id, idx, round(vol, 6) as volatility from v")
add("detect_changepoints", lambda s, d: rounded(regimes.detect_changepoints(daily(s, d), "y", BY, ["idx"], "variance", 0.4, 4).withColumn("position", F.col("position").cast("long")), "cost_reduction", digits=3), f"{SPACED} select 'all' as series_id, idx as position, round(score, 3) as cost_reduction from sp")
add("move_direction", lambda s, d: forecasts(s, d).select(moves.classify_moves(F.col("y") - F.col("p_last"), 20.0).alias("direction")).groupBy("direction").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(s.createDataFrame([(m.value,) for m in kinds.MoveDirection], "direction string")), "direction"), f"with {FC} select case when y - p_last > 20 then 'UP' when y - p_last < -20 then 'DOWN' else 'FLAT' end as direction, count(*) as n from f group by 1")

# --- objects with settings ---

ACI = """w(series_id, k, idx, error, q, next_q) as (select series_id, k, idx, e, 60.0::double, greatest(0.0, case when e <= 60.0 then 60.0 - 0.2 * 4.0 else 60.0 + 4.0 * 0.8 end)::double from e where k = 1
  union all select e.series_id, e.k, e.idx, e.e, w.next_q, greatest(0.0, case when e.e <= w.next_q then w.next_q - 0.2 * 4.0 else w.next_q + 4.0 * 0.8 end) from w join e on e.series_id = w.series_id and e.k = w.k + 1)"""
add("adaptive_predictor", lambda s, d: rounded(protocols.AdaptiveConformalPredictor(0.2, 4.0).run(forecasts(s, d), F.col("y") - F.col("p_mean7"), BY, ["idx"], 60.0), "error", "q", "next_q"), f"with recursive {FC}, e as (select series_id, row_number() over (partition by series_id order by idx) as k, idx, abs(y - p_mean7) as e from f), {ACI} select series_id, idx, round(error, 6) as error, round(q, 6) as q, round(next_q, 6) as next_q from w")
add("adaptive_update", lambda s, d: s.createDataFrame([(q, e, round(protocols.AdaptiveConformalPredictor(0.1, 0.5).update(q / 4, 0.0, e / 4), 9)) for q in range(6) for e in range(6)], "q long, e long, next_q double"), "select q, e, round(greatest(0.0, case when e <= q then q / 4 - 0.05 else q / 4 + 0.45 end), 9) as next_q from range(6) a(q), range(6) b(e)")


def uncertain(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts(spark, sf_dir)
    out = protocols.BootstrapUncertainty(40, 0.2, 7).predict_interval(f.where("idx >= 40").select("series_id", "idx", "p_mean7"), "p_mean7", f.withColumn("r", F.col("y") - F.col("p_mean7")), "r", ["series_id", "idx"])
    return rounded(out, "p_mean7", "lower", "upper")


add("bootstrap_uncertainty_object", uncertain, f"""with {FC}, rk as (select y - p_mean7 as v, row_number() over (order by y - p_mean7) - 1 as pos from f), nn as (select count(*) as n from f), dr as (select series_id, idx, p_mean7, ('0x' || substr(md5('7:' || series_id || ':' || idx || ':' || b), 1, 13))::bigint % n as pos from f, nn, range(40) x(b) where idx >= 40),
dv as (select dr.*, v from dr join rk using (pos)) select series_id, idx, round(any_value(p_mean7), 6) as p_mean7, round(any_value(p_mean7) + quantile_cont(v, 0.1), 6) as lower, round(any_value(p_mean7) + quantile_cont(v, 0.9), 6) as upper from dv group by series_id, idx""")


def bagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = one_series(spark, sf_dir)
    n = rows.count()
    test = rows.where(F.col("idx") >= n * 0.8)
    fit = lambda how: resampling.TimeSeriesBagger(models.Ridge(1.0), resampling.FeatureBagging(0.7), 9, how, 3).fit(rows.where(F.col("idx") < n * 0.8), LAGS3, "y", ["idx"])
    mean = fit("mean")
    out = mean.predict_with_uncertainty(test, ["idx"]).join(mean.predict(test, ["idx"]).withColumnRenamed("prediction", "mean"), "idx").join(fit("median").predict(test, ["idx"]).withColumnRenamed("prediction", "median"), "idx")
    return rounded(out, "prediction", "std", "mean", "median", digits=3)


add("bagger_predict", bagger, f"""with recursive {ONE}, ch as (select b, c, row_number() over (partition by b order by {draw_sql("('3:' || b)", "c")}, c) <= 2 as used from range(9) x(b), range(3) y(c)), cu as (select b, max(used::int) filter (where c = 0) as u1, max(used::int) filter (where c = 1) as u2, max(used::int) filter (where c = 2) as u3 from ch group by b),
tr as (select b, x1 * u1 as x1, x2 * u2 as x2, x3 * u3 as x3, y from cu, tn), {ridge("b")}, pr as (select te.idx, b, {fitted()} as p from te, co) select idx, round(avg(p), 3) as prediction, round(stddev_pop(p), 3) as std, round(avg(p), 3) as mean, round(quantile_cont(p, 0.5), 3) as median from pr group by idx""")
CROSS = f"""{PANEL}, r as (select series_id, idx - 3 as position, y, count(*) over (partition by series_id) as n from s where idx >= 3), k as (select *, least(position // (n // 5), 4) as fold from r),
c as (select a.series_id, a.position, avg(b.y) as p, any_value(a.y) - avg(b.y) as e from k a join k b on a.series_id = b.series_id and b.position < a.fold * (a.n // 5) where a.fold > 0 group by a.series_id, a.position)"""


def cross_fitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = protocols.CrossFitter(splits.CrossFitCV(5))
    rows = supervised(spark, sf_dir)
    return rounded(c.fit_predict(rows, models.Mean(), LAGS3, "y", BY, ["idx"]).join(c.fit_predict_residuals(rows, models.Mean(), LAGS3, "y", BY, ["idx"]), ["series_id", "position"]).where("prediction is not null"), "prediction", "residual", digits=9)


add("cross_fitter", cross_fitter, f"with {CROSS} select series_id, position, round(p, 9) as prediction, round(e, 9) as residual from c")


def nested_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = one_series(spark, sf_dir).select("idx", "y", *LAGS3)
    cv = protocols.NestedWalkForwardCV(models.Ridge, {"alpha": [1.0, 1e13]}, 2, 3).fit(rows, LAGS3, "y", ["idx"])
    best = F.broadcast(cv.get_result().select("best_params").distinct())
    return cv.predict(rows, ["idx"]).select("idx", F.round("prediction", 2).alias("prediction")).crossJoin(best)


ONE_SUP = f"{DAILY}, sl as (select idx, y, lag(y) over w as x1, lag(y, 2) over w as x2, lag(y, 3) over w as x3 from s window w as (order by idx)), sup as (select *, row_number() over (order by idx) - 1 as r, count(*) over () as n from sl where x3 is not null)"
add("nested_object", nested_object, f"""with recursive {ONE_SUP}, al as (select unnest([1.0, 1e13]) as alpha), inn as (select k::int as fold, i::int as inner_fold, alpha, n - 3 + k - 3 + i as ilo from (select any_value(n) as n from sup), range(2) t(k), range(3) u(i), al),
tr as (select fold, inner_fold, alpha, x1, x2, x3, y from inn join sup on r < ilo - 1), {ridge("fold, inner_fold, alpha", "alpha")}, te as (select fold, inner_fold, alpha, x1, x2, x3, y from inn join sup on r = ilo), sc as (select fold, alpha, -avg(abs({fitted()} - y)) as score from te join co using (fold, inner_fold, alpha) group by all),
bs as (select fold, arg_max(alpha, score) as alpha from sc group by fold), bb as (select alpha from bs group by alpha order by count(*) desc, min(fold) limit 1), ztr as (select alpha, x1, x2, x3, y from sup, bb), {ridge("alpha", "alpha", name="z")}
select sup.idx, round({fitted(te="sup", co="zco")}, 2) as prediction, '[(''alpha'', ' || case when zco.alpha = 1 then '1.0' else '10000000000000.0' end || ')]' as best_params from sup, zco""")


def passes(*checks: tuple[str, Callable[[], object]]) -> list[tuple[str, bool]]:
    out = []
    for name, f in checks:
        try:
            f()
            out.append((name, True))
        except (ValueError, AssertionError, TypeError, FileNotFoundError):
            out.append((name, False))
    return out


def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = split_conformal(spark, sf_dir).select("series_id", "lower", "upper", "y")
    se = q.groupBy("series_id").agg((F.stddev_samp("y") / F.sqrt(F.count("y"))).alias("se"), F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("double")).alias("coverage"))
    corr = np.array([[1.0, 0.5], [0.5, 1.0]])
    rows = passes(
        ("finite_se", lambda: gates.finite_se(se, "se")), ("finite_se_zero", lambda: gates.finite_se(se.withColumn("se", F.col("se") * 0), "se")), ("psd", lambda: gates.psd(corr)), ("psd_negative", lambda: gates.psd(corr - 1)),
        ("ci_ordered", lambda: gates.ci_ordered(q, "lower", "upper")), ("ci_reversed", lambda: gates.ci_ordered(q, "upper", "lower")), ("coverage_in_unit", lambda: gates.coverage_in_unit(se, "coverage")), ("coverage_percent", lambda: gates.coverage_in_unit(se.withColumn("coverage", F.col("coverage") * 100), "coverage")),
    )
    return spark.createDataFrame(rows, "validator string, passed boolean")


add("validators", validators, f"""with {QS}, g as (select series_id, stddev_samp(y) / sqrt(count(y)) as se, avg((y between lower and upper)::int) as coverage from iv group by series_id)
select 'finite_se' as validator, bool_and(se is not null and se > 0) as passed from g union all select 'finite_se_zero', bool_and(se * 0 > 0) from g union all select 'psd', 1 - 0.5 >= 0 union all select 'psd_negative', 0 - 0.5 >= 0 union all select 'ci_ordered', bool_and(lower <= upper) from iv union all select 'ci_reversed', bool_and(upper <= lower) from iv
union all select 'coverage_in_unit', bool_and(coverage between 0 and 1) from g union all select 'coverage_percent', bool_and(100 * coverage between 0 and 1) from g""")


def protocol_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each kind of object passes the checks of its protocol, and whether one that breaks it fails."""
    broken = type("Broken", (), {"sample": lambda self, x, y, rng: (x[:-1], y, np.arange(x.shape[1]))})()
    nothing = type("Nothing", (), {"fit": lambda self, x, y: self, "predict": lambda self, x: np.full(len(x), np.nan)})()
    p = panel(spark, sf_dir).where("series_id % 5 = 0").select("series_id", "idx", "y")
    rows = passes(
        ("splitter", lambda: splits.check_temporal_splitter(splits.WalkForwardCV(4, 1), spark)), ("estimator", lambda: models.check_temporal_estimator(models.Ridge(1.0))), ("estimator_broken", lambda: models.check_temporal_estimator(nothing)), ("bootstrap", lambda: resampling.check_bootstrap_strategy(resampling.MovingBlockBootstrap())),
        ("bootstrap_broken", lambda: resampling.check_bootstrap_strategy(broken)), ("adapter", lambda: compare.check_forecast_adapter(compare.NaiveAdapter(), p)),
    )
    shown = [("fit_predict", isinstance(models.Ridge(), protocols.SupportsFitPredict)), ("sample", isinstance(resampling.FeatureBagging(), protocols.SupportsBootstrap)), ("forecast", isinstance(compare.NaiveAdapter(), protocols.SupportsForecast)), ("forward_only", splits.TemporalTags().forward_only)]
    return spark.createDataFrame(rows + shown, "check string, passed boolean")


add("protocol_checks", protocol_checks, "select unnest(['splitter', 'estimator', 'estimator_broken', 'bootstrap', 'bootstrap_broken', 'adapter', 'fit_predict', 'sample', 'forecast', 'forward_only']) as \"check\", unnest([true, true, false, true, false, true, true, true, true, true]) as passed")


def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = compare.split_panel(panel(spark, sf_dir).select("series_id", "idx", "y"), 6)
    told: list[tuple[int, int]] = []
    adapters = [protocols.MultiSeriesAdapter(compare.NaiveAdapter()), protocols.ProgressAdapter(compare.HistoricAverageAdapter(), lambda done, of: told.append((done, of))), protocols.StatsforecastAdapter("SeasonalNaive", 7), protocols.StatsforecastAdapter("WindowAverage", window=5)]
    out = compare.run_forecasts(train, test, adapters)
    return rounded(out, "prediction").withColumn("told", F.lit(told[0][0]).cast("long"))


add("adapter_objects", wrapped, f"with {FORECASTS}, k as (select count(distinct series_id) as told from s) select case model when 'Naive' then 'Naive_multi' when 'HistoricAverage' then 'HistoricAverage_multi' else model end as model, series_id, idx, round(prediction, 6) as prediction, actual, told from fc, k")

# --- files ---

SUITE = f"""{FORECASTS}, c as (select series_id % 2 as ds, model, avg(abs(prediction - actual)) as mae, sqrt(avg(pow(prediction - actual, 2))) as rmse from fc group by all), r as (select *, row_number() over (partition by ds order by mae, model)::int as rank from c)"""


def suite_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as a report and as checkpoints, and read back."""
    path = scratch_path(spark, "results")
    p = panel(spark, sf_dir)
    sets = {k: (p.where(F.col("series_id") % 2 == r).select("series_id", "idx", "y"), 6) for k, r in (("even set", 0), ("odd set", 1))}
    got = compare.run_benchmark_suite(sets, ADAPTERS, f"{path}/checkpoints")
    files.save_benchmark_results(got, f"{path}/report", files.create_run_metadata([a.name for a in ADAPTERS], list(sets)))
    names = files.list_checkpoints(spark, f"{path}/checkpoints")
    known = files.load_checkpoint(spark, f"{path}/checkpoints", "even set").select("model", F.col("mae").alias("again"))
    back = files.load_benchmark_results(spark, f"{path}/report").join(known, "model").select("dataset", "model", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), "rank", F.round("again", 6).alias("even_mae"))
    return back.withColumn("checkpoints", F.lit(",".join(names)))


add("result_files", suite_files, f"with {SUITE} select case r.ds when 0 then 'even set' else 'odd set' end as dataset, r.model, round(r.mae, 6) as mae, round(r.rmse, 6) as rmse, r.rank, round(e.mae, 6) as even_mae, 'Even Set,Odd Set' as checkpoints from r join r e on e.ds = 0 and e.model = r.model")


def long_file(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "panel")
    panel(spark, sf_dir).select(F.col("series_id").alias("unique_id"), F.col("ts").alias("ds"), "y").write.parquet(path)
    return path


def of_panel(load: Callable[[SparkSession, str], datasets.TimeSeriesDataset]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = load(spark, long_file(spark, sf_dir))
        train, test = data.get_train_test_split()
        m = data.metadata
        rows = train.select("series_id", "idx", "y", F.lit("train").alias("part")).unionByName(test.select("series_id", "idx", "y", F.lit("test").alias("part")))
        rows = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 2).alias("total"), F.max("idx").alias("last"))
        return rows.withColumns({"name": F.lit(m.name), "horizon": F.lit(m.horizon), "n_series": F.lit(m.n_series).cast("long"), "observations": F.lit(m.total_observations).cast("long")})

    return run


def of_panel_sql(name: str, horizon: int, test: int) -> str:
    # rows of one time stand in the order of their event ids in the panel and in that of their values here, so times decide alone
    return f"""with p as (select user_id::varchar as series_id, value as y, row_number() over (partition by user_id order by ts) - 1 as idx from events), m as (select min(n) as n, count(*) as k from (select count(*) as n from p group by series_id)), c as (select p.*, m.n, m.k, case when idx < m.n - {test} then 'train' else 'test' end as part from p, m where idx < m.n)
select part, count(*) as n, round(sum(y), 2) as total, max(idx) as last, '{name}' as name, {horizon} as horizon, any_value(k) as n_series, any_value(k * c.n) as observations from c group by part"""


add("load_m3", of_panel(lambda s, p: datasets.load_m3(s, p, "quarterly")), of_panel_sql("m3_quarterly", 8, 8))
add("load_m4", of_panel(lambda s, p: datasets.load_m4(s, p, "weekly", None)), of_panel_sql("m4_weekly", 13, 13))
add("load_electricity", of_panel(datasets.load_electricity), of_panel_sql("electricity", 24, 168))
add("load_traffic", of_panel(datasets.load_traffic), of_panel_sql("traffic", 24, 168))


def wide_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "m5")
    p = panel(spark, sf_dir).where("idx < 40").withColumn("d", F.concat(F.lit("d_"), (F.col("idx") + 1).cast("string")))
    p.groupBy(F.concat(F.lit("id_"), F.col("series_id")).alias("id")).pivot("d", [f"d_{k}" for k in range(1, 41)]).agg(F.first("y")).write.option("header", True).csv(path)
    one, each = datasets.load_m5(spark, path, None), datasets.load_m5(spark, path, None, aggregate=False)
    datasets.validate_dataset(one)
    return one.panel.unionByName(each.panel.select("series_id", "idx", "y")).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 2).alias("total"), F.round(F.max_by("y", "idx"), 2).alias("last"))


add("load_m5", wide_file, f"""with {PANEL}, p as (select 'id_' || series_id as series_id, idx, y from s where idx < 40), t as (select * from p union all select 'total', idx, sum(y) from p group by idx) select series_id, count(*) as n, round(sum(y), 2) as total, round(arg_max(y, idx), 2) as last from t group by series_id""")


def fred_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "fred")
    daily(spark, sf_dir).select(F.col("day").alias("DATE"), F.when(F.col("idx") % 9 == 0, F.lit(".")).otherwise(F.round(F.col("y") / 1e6, 4).cast("string")).alias("DGS10")).coalesce(1).write.option("header", True).csv(path)
    weeks = datasets.load_fred_rates(spark, path, "DGS10", "W").panel.select(F.lit("W").alias("frequency"), "series_id", "idx", F.col("ts").cast("string").alias("ts"), "y")
    months = datasets.load_fred_rates(spark, path, ["DGS10"], "M").panel.select(F.lit("M").alias("frequency"), "series_id", "idx", F.col("ts").cast("string").alias("ts"), "y")
    known = F.broadcast(spark.createDataFrame(list(datasets.list_available_series().items()), "series_id string, title string"))
    return rounded(weeks.unionByName(months).join(known, "series_id"), "y", digits=4)


add("load_fred_rates", fred_file, f"""with {DAILY}, v as (select day, case when idx % 9 <> 0 then round(y / 1e6, 4) end as y from s), w as (select (day + ((12 - dayofweek(day)) % 7)::int)::date as ts, arg_max(y, day) as y from v where y is not null group by 1), m as (select last_day(day) as ts, arg_max(y, day) as y from v where y is not null group by 1)
select 'W' as frequency, 'DGS10' as series_id, row_number() over (order by ts) - 1 as idx, ts::varchar as ts, round(y, 4) as y, '10-year treasury' as title from w union all select 'M', 'DGS10', row_number() over (order by ts) - 1, ts::varchar, round(y, 4), '10-year treasury' from m""")


def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = scratch_path(spark, "nothing")
    loads: Sequence = (("m3", datasets.load_m3), ("m4", datasets.load_m4), ("m5", datasets.load_m5), ("fred", datasets.load_fred_rates), ("electricity", datasets.load_electricity), ("traffic", datasets.load_traffic))
    return spark.createDataFrame(passes(*[(n, lambda f=f: f(spark, where)) for n, f in loads]), "dataset string, found boolean")


add("missing_datasets", missing_files, "select unnest(['m3', 'm4', 'm5', 'fred', 'electricity', 'traffic']) as dataset, false as found")

# --- reports and result forms ---


def lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(k, x) for k, x in enumerate(text.rstrip("\n").split("\n"))], "line int, text string")


ROW = "'| ' || rank || ' | ' || model || ' | ' || printf('%.4f', mae) || ' | ' || printf('%.4f', rmse) || ' | ' || printf('%.4f', mape) || ' | ' || printf('%.4f', da) || ' |'"
add("ranking_table", lambda s, d: lines(s, compare.generate_ranking_table(compare.compare_forecasts(simple_forecasts(s, d)))), f"""with {FORECASTS}, k as (select *, prediction - lag(prediction) over w as dp, actual - lag(actual) over w as da from fc window w as (partition by model order by series_id, idx)), c as (select model, avg(abs(prediction - actual)) as mae, sqrt(avg(pow(prediction - actual, 2))) as rmse, 100 * avg(case when actual <> 0 then abs((prediction - actual) / actual) end) as mape, avg((sign(dp) = sign(da))::int) as da from k group by model), r as (select *, row_number() over (order by mae, model) as rank from c)
select 0 as line, '| Rank | Model | MAE | RMSE | MAPE | Direction |' as text union all select 1, '|---|---|---|---|---|---|' union all select (rank + 1)::int, {ROW} from r""")
add("summary_table", lambda s, d: lines(s, compare.generate_summary_table(suite_rows(s, d))), f"""with {SUITE}, t as (select model, count(*) filter (where rank = 1) as wins, count(*) as n, avg(mae) as mae from r group by model), o as (select *, row_number() over (order by wins desc, model) as k from t)
select 0 as line, '| Model | Wins | Datasets | Mean MAE |' as text union all select 1, '|---|---|---|---|' union all select (k + 1)::int, '| ' || model || ' | ' || wins || ' | ' || n || ' | ' || printf('%.4f', mae) || ' |' from o""")
add("benchmark_docs", lambda s, d: lines(s, compare.generate_benchmark_docs(suite_rows(s, d), {"seed": 1})).where("line < 8 or text like '## %'").drop("line"), f"""with {SUITE}, t as (select model, count(*) filter (where rank = 1) as wins, count(*) as n, avg(mae) as mae from r group by model), o as (select *, row_number() over (order by wins desc, model) as k from t)
select unnest(['# Benchmark results', '', '- seed: 1', '', '| Model | Wins | Datasets | Mean MAE |', '|---|---|---|---|', '## even', '## odd']) as text union all select '| ' || model || ' | ' || wins || ' | ' || n || ' | ' || printf('%.4f', mae) || ' |' from o where k <= 2""")


def suite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    return compare.run_benchmark_suite({k: (p.where(F.col("series_id") % 2 == r).select("series_id", "idx", "y"), 6) for k, r in (("even", 0), ("odd", 1))}, ADAPTERS)


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result row as JSON, its keys in order."""
    row = daily(spark, sf_dir).agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count(F.lit(1)).alias("n")).first()
    text = json.dumps(kinds.result_to_dict(row), sort_keys=True)
    other = json.dumps({kinds.jsonify_key(kinds.GateStatus.HALT): kinds.array_to_list(np.arange(row["n"] % 5)), kinds.jsonify_key(3): kinds.date_to_json(row["first"])}, sort_keys=True)
    return spark.createDataFrame([(text, other)], "result string, other string")


add("result_forms", forms, f"""with {DAILY}, c as (select min(day) as a, max(day) as b, count(*) as n from s) select '{{"first": "' || a || '", "last": "' || b || '", "n": ' || n || ', "schema_version": 1}}' as result, '{{"3": "' || a || '", "HALT": [' || coalesce(array_to_string(range(0, n % 5), ', '), '') || ']}}' as other from c""")
add("result_schemas", lambda s, d: s.createDataFrame([(k, len(kinds.schema_of(k).fields)) for k in ("DMTestResult", "GateResult", "PredictionInterval", "StationarityTestResult")] + [(v.value, 0) for v in kinds.StationarityConclusion], "name string, fields int"), "select unnest(['DMTestResult', 'GateResult', 'PredictionInterval', 'StationarityTestResult', 'stationary', 'non_stationary', 'difference_stationary', 'insufficient_evidence']) as name, unnest([5, 7, 3, 4, 0, 0, 0, 0])::int as fields")

# --- chart frames ---

add("plot_cv_folds", lambda s, d: display.plot_cv_folds(s, splits.WalkForwardCV(4, 2, test_size=3), 60), """with k as (select k::int as fold, 60 - (4 - k) * 3 as lo from range(4) t(k)) select fold, 'train' as part, 0::bigint as start, lo - 2 as stop from k union all select fold, 'gap', lo - 2, lo from k union all select fold, 'test', lo, lo + 3 from k""")
GAUGE = f"with {FC}, c as (select event_type, 1 - avg(abs(p_mean7 - y)) / avg(abs(p_last - y)) as g from f group by event_type), k as (select event_type as scope, case when g > 0.2 then 'HALT' when g > 0.1 then 'WARN' else 'PASS' end as status, g / 0.2 as value from c)"
add("plot_gate_result", lambda s, d: rounded(display.plot_gate_result(gates.gate_suspicious_improvement(improvements(s, d), "model", "base", scope=F.col("event_type"))), "value"), f"{GAUGE} select 'suspicious_improvement' as gate, scope, status, case status when 'HALT' then 2 when 'WARN' then 1 else 0 end as severity, round(value, 6) as value from k")
add("plot_gate_comparison", lambda s, d: display.plot_gate_comparison(gates.gate_suspicious_improvement(improvements(s, d), "model", "base", scope=F.col("event_type"))), f"{GAUGE} select 'suspicious_improvement' as gate, status, count(*) as n, max(case status when 'HALT' then 2 when 'WARN' then 1 else 0 end)::int as severity from k group by status")
add("plot_prediction_intervals", lambda s, d: rounded(display.plot_prediction_intervals(split_conformal(s, d), "event_id", "p_mean7", "lower", "upper", "y"), "point", "lower", "upper", "width"), f"with {QS} select event_id as x, round(p_mean7, 6) as point, round(lower, 6) as lower, round(upper, 6) as upper, round(upper - lower, 6) as width, y as actual, y between lower and upper as covered from iv")
add("plot_interval_width", lambda s, d: rounded(display.plot_interval_width(split_conformal(s, d), "event_id", "lower", "upper"), "width", "mean_width", digits=5), f"with {QS} select event_id as x, round(upper - lower, 5) as width, round(avg(upper - lower) over (), 5) as mean_width from iv")
add("plot_metric_comparison", lambda s, d: rounded(display.plot_metric_comparison(compare.compare_forecasts(simple_forecasts(s, d)), "model", ["mae", "rmse"], "Naive"), "value", "relative"), f"""with {FORECASTS}, c as (select model, avg(abs(prediction - actual)) as mae, sqrt(avg(pow(prediction - actual, 2))) as rmse from fc group by model), l as (select model, 'mae' as metric, mae as value from c union all select model, 'rmse', rmse from c)
select l.model, l.metric, round(l.value, 6) as value, round(l.value / b.value, 6) as relative from l join l b on b.model = 'Naive' and b.metric = l.metric""")

# --- streams ---


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive intervals of a stream of errors: files are read one at a time, the last two only move the watermark."""
    path = scratch_path(spark, "stream")
    rows = forecasts(spark, sf_dir).where("series_id % 5 = 0").select("series_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), F.abs(F.col("y") - F.col("p_mean7")).alias("e"))
    rows.coalesce(1).write.parquet(f"{path}/in/a")
    last = rows.agg(F.max("ts").alias("ts"))
    for k in (1, 2):
        later = rows.select("series_id").distinct().crossJoin(F.broadcast(last)).select("series_id", (F.col("ts") + F.expr(f"interval {30 * k} days")).alias("ts"), F.lit(-k).cast("long").alias("event_id"), F.lit(0.0).alias("e"))
        later.coalesce(1).write.parquet(f"{path}/in/b{k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")
    out = online.online_intervals(stream, "series_id", "ts", "event_id", "e", lambda: online.Adaptive(60.0, 0.2, 4.0), "1 hour")
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{path}/out").where("event_id >= 0")
    return got.select("series_id", "event_id", F.round("error", 6).alias("error"), F.round("q", 6).alias("q"), F.round("next_q", 6).alias("next_q"))


add("streaming_adaptive", streamed, f"with recursive {FC}, e as (select series_id, event_id as idx, row_number() over (partition by series_id order by ts, event_id) as k, abs(y - p_mean7) as e from f where series_id % 5 = 0), {ACI} select series_id, idx as event_id, round(error, 6) as error, round(q, 6) as q, round(next_q, 6) as next_q from w")
