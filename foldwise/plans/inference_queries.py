"""Queries of splits, tests, intervals, gates, resampling and comparisons over the driver's tables, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.operators import accuracy_tests as at
from foldwise.operators import compare, conformal, gates, hac, models, resampling, simulate, splits, unit_roots
from foldwise.operators import metrics as m
from foldwise.plans.metric_queries import regime_rows, returns
from foldwise.plans.registry import DAILY, FC, PANEL, add, rounded
from foldwise.sources.tables import daily, daily_forecasts, errors_long, forecasts, panel

BY = ["series_id"]

# --- splits ---

LENGTHS = f"{PANEL}, n as (select series_id, count(*) as n from s group by series_id)"


def fold_table(cv: splits.Splitter):
    return lambda s, d: cv.by_length(panel(s, d), BY)


def bounds_of(lo: str, hi: str, a: str, b: str, n_splits: int, where: str = "true") -> str:
    return f"with {LENGTHS}, k as (select unnest(range({n_splits})) as k), x as (select series_id, n, k from n, k) select n, series_id, (row_number() over (partition by series_id order by k) - 1)::int as fold, {lo} as train_lo, {hi} as train_hi, {a} as test_lo, {b} as test_hi from x where {where}"


add("walk_forward_folds", fold_table(splits.WalkForwardCV(5, 2, extra_gap=1, test_size=3)), bounds_of("0::bigint", "n - (5 - k) * 3 - 3", "n - (5 - k) * 3", "n - (5 - k) * 3 + 3", 5))
add("walk_forward_sliding", fold_table(splits.WalkForwardCV(4, 1, "sliding", 20, 0, 5)), bounds_of("n - (4 - k) * 5 - 21", "n - (4 - k) * 5 - 1", "n - (4 - k) * 5", "n - (4 - k) * 5 + 5", 4, "n - (4 - k) * 5 - 21 >= 0"))
add("ts_cv_folds", fold_table(splits.TimeSeriesCrossValidator(4, 1, 1)), bounds_of("0::bigint", "n - (4 - k) * (n // 5) - 2", "n - (4 - k) * (n // 5)", "n - (3 - k) * (n // 5)", 4))
add("blocked_folds", fold_table(splits.BlockedTimeSeriesCV(3, 4, 1)), bounds_of("0::bigint", "(n // 4 - (3 - k) * greatest(1, n // 4 // 4) - 1) * 4", "(n // 4 - (3 - k) * greatest(1, n // 4 // 4)) * 4", "(n // 4 - (2 - k) * greatest(1, n // 4 // 4)) * 4", 3))
add("crossfit_folds", fold_table(splits.CrossFitCV(5, 1)), bounds_of("0::bigint", "k * (n // 5) - 1", "k * (n // 5)", "case when k = 4 then n else (k + 1) * (n // 5) end", 5, "k > 0"))
add("temporal_boundary_gate", lambda s, d: gates.gate_temporal_boundary(splits.WalkForwardCV(5, 2).by_length(panel(s, d), BY), 3).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("metric").alias("least")), f"with {LENGTHS} select 'HALT' as status, 5 * count(*) as n, 2.0 as least from n")


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = panel(spark, sf_dir)
    folds = splits.WalkForwardCV(5, 2, test_size=3).by_length(series, BY)
    return splits.assign(series, folds, "idx", BY).groupBy("series_id", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 4).alias("total"))


add("walk_forward_membership", membership, f"""with {LENGTHS}, k as (select unnest(range(5)) as k), b as (select series_id, k::int as fold, n - (5 - k) * 3 as lo from n, k)
select s.series_id, fold, case when idx < lo - 2 then 'train' else 'test' end as role, count(*) as n, round(sum(y), 4) as total from s join b on s.series_id = b.series_id and (idx < lo - 2 or idx between lo and lo + 2) group by all""")


def counts(splitter: splits.PurgedSplitter):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        series = daily(spark, sf_dir)
        n = series.count()
        splitter.check(n)
        return splitter.split_detailed(series, "idx", BY, n).drop("series_id")

    return run


def purged_sql(runs: str, purge: int, pct: float, inside: str = "true") -> str:
    """runs: SQL of (fold, a, b), inclusive runs of test rows; n is the length."""
    return f"""with {DAILY}, c as (select count(*) as n, ceil({pct} * count(*)) as w from s), r as ({runs}), f as (select distinct fold from r),
x as (select f.fold, s.idx, bool_or(s.idx between a and b) as test, bool_or(s.idx between a - {purge} and b + {purge}) as purged, bool_or(s.idx > b and s.idx <= b + w) as emb from s, f, c, r where r.fold = f.fold group by all),
y as (select x.*, {inside} as inside from x, c)
select fold::int as fold, count(*) filter (where not test and inside and not purged and not emb) as n_train, count(*) filter (where test) as n_test, count(*) filter (where not test and inside and purged and not emb) as n_purged, count(*) filter (where not test and inside and emb) as n_embargoed from y group by fold"""


GROUPS = "select k as g, k * (n // {k}) + least(k, n % {k}) as a, (k + 1) * (n // {k}) + least(k + 1, n % {k}) - 1 as b from c, range({k}) t(k)"
add("purged_kfold_counts", counts(splits.PurgedKFold(5, 3, 0.02)), purged_sql("select g as fold, a, b from (" + GROUPS.format(k=5) + ")", 3, 0.02))
add("cpcv_counts", counts(splits.CombinatorialPurgedCV(5, 2, 3, 0.01)), purged_sql("with gr as (" + GROUPS.format(k=5) + "), pr as (select row_number() over (order by p.g, q.g) - 1 as fold, p.g as g1, q.g as g2 from gr p join gr q on p.g < q.g) select fold, p.a, case when g2 = g1 + 1 then q.b else p.b end as b from pr join gr p on p.g = g1 join gr q on q.g = g2 union all select fold, q.a, q.b from pr join gr q on q.g = g2 where g2 > g1 + 1", 3, 0.01))
add("purged_walk_forward", counts(splits.PurgedWalkForward(4, None, 100, 2, 0.01, 1)), purged_sql("select k as fold, n - (4 - k) * 100 as a, n - (3 - k) * 100 - 1 as b from c, range(4) t(k)", 2, 0.01, "idx < n - (4 - fold) * 100 - 3"))
add("label_overlap_counts", lambda s, d: splits.compute_label_overlap(panel(s, d), "idx", BY, 5).groupBy("series_id").agg(F.count(F.lit(1)).alias("n_pairs")), f"with {PANEL} select a.series_id, count(*) as n_pairs from s a join s b on a.series_id = b.series_id and b.idx between a.idx and a.idx + 4 group by a.series_id")

# --- long-run variances and accuracy tests ---

D = f"{FC}, d1 as (select series_id, idx, event_type, pow(p_last - y, 2) - pow(p_mean7 - y, 2) as d, y, p_last, p_week, p_mean7, p_all from f), u as (select *, d - avg(d) over (partition by series_id) as u from d1)"
LAGS = "l as (select *, lag(u, 1) over (partition by series_id order by idx) as u1, lag(u, 2) over (partition by series_id order by idx) as u2, lag(u, 3) over (partition by series_id order by idx) as u3 from u)"


def hac_sql(b: int) -> str:
    terms = "avg(u * u)" + "".join(f" + 2 * {1 - j / (b + 1)} * avg(u * u{j})" for j in range(1, b + 1))
    return f"(({terms}) / count(u))"


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(spark, sf_dir).withColumn("d", F.pow(F.col("p_last") - F.col("y"), 2) - F.pow(F.col("p_mean7") - F.col("y"), 2)).withColumn("e1", F.col("p_last") - F.col("y")).withColumn("e2", F.col("p_mean7") - F.col("y"))


add("hac_variance", lambda s, d: rounded(hac.compute_hac_variance(differences(s, d), "d", BY, ["idx"], 3), "hac_variance", digits=3), f"with {D}, {LAGS} select series_id, count(u) as n, round({hac_sql(3)}, 3) as hac_variance from l group by series_id")
add("self_normalized_variance", lambda s, d: rounded(hac.compute_self_normalized_variance(differences(s, d), "d", BY, ["idx"]), "sn_variance", digits=3), f"with {D}, c as (select series_id, sum(u) over (partition by series_id order by idx) as s from u) select series_id, count(*) as n, round(sum(s * s) / (count(*) * count(*)), 3) as sn_variance from c group by series_id")
add("long_run_covariance", lambda s, d: rounded(hac.long_run_covariance(hac.demeaned_lags(hac.demeaned_lags(differences(s, d), "e1", BY, ["idx"], 0, "a"), "e2", BY, ["idx"], 0, "b"), ["a", "b"], BY, ["idx"], 2, "parzen"), "covariance", digits=4), f"""with {FC}, z as (select series_id, idx, p_last - y - avg(p_last - y) over (partition by series_id) as a, p_mean7 - y - avg(p_mean7 - y) over (partition by series_id) as b from f),
l as (select *, lag(a) over w as a1, lag(a, 2) over w as a2, lag(b) over w as b1, lag(b, 2) over w as b2 from z window w as (partition by series_id order by idx)),
k as (select {hac.parzen_kernel(1, 2)!r} as k1, {hac.parzen_kernel(2, 2)!r} as k2),
c as (select series_id, (sum(a * a) + 2 * k1 * sum(a * a1) + 2 * k2 * sum(a * a2)) / count(*) as aa, (sum(a * b) + k1 * (sum(a * b1) + sum(a1 * b)) + k2 * (sum(a * b2) + sum(a2 * b))) / count(*) as ab, (sum(b * b) + 2 * k1 * sum(b * b1) + 2 * k2 * sum(b * b2)) / count(*) as bb from l, k group by series_id, k1, k2)
select series_id, 0 as i, 0 as j, round(aa, 4) as covariance from c union all select series_id, 0, 1, round(ab, 4) from c union all select series_id, 1, 0, round(ab, 4) from c union all select series_id, 1, 1, round(bb, 4) from c""")
add("newey_west_se", lambda s, d: rounded(hac.newey_west_se(differences(s, d), "e2", BY, ["idx"], 3), "lrv", "variance", "se", digits=5), f"""with {FC}, u as (select series_id, idx, p_mean7 - y - avg(p_mean7 - y) over (partition by series_id) as u from f), {LAGS},
c as (select series_id, count(*) as n, (sum(u * u) + 2 * (0.75 * sum(u * u1) + 0.5 * sum(u * u2) + 0.25 * sum(u * u3))) / count(*) as lrv from l group by series_id)
select series_id, n, round(lrv, 5) as lrv, round(lrv / n, 5) as variance, round(case when lrv >= 0 then sqrt(lrv / n) end, 5) as se, n - 3 as dof from c""")
add("newey_west_prewhitened", lambda s, d: rounded(hac.newey_west_se(differences(s, d), "e2", BY, ["idx"], 1, prewhiten=True), "lrv", "variance", "se", digits=5), f"""with {FC}, u0 as (select series_id, idx, p_mean7 - y - avg(p_mean7 - y) over (partition by series_id) as u from f), l0 as (select *, lag(u) over (partition by series_id order by idx) as l from u0),
f1 as (select *, least(greatest(sum(u * l) over (partition by series_id) / sum(l * l) over (partition by series_id), -0.99), 0.99) as phi from l0), v as (select series_id, idx, phi, u - phi * l as u from f1 where l is not null), l as (select *, lag(u) over (partition by series_id order by idx) as u1 from v),
c as (select series_id, count(*) + 1 as n, (sum(u * u) + 2 * 0.5 * sum(u * u1)) / count(*) / pow(1 - max(phi), 2) as lrv from l group by series_id)
select series_id, n, round(lrv, 5) as lrv, round(lrv / n, 5) as variance, round(case when lrv >= 0 then sqrt(lrv / n) end, 5) as se, n - 1 as dof from c""")
add("acf", lambda s, d: rounded(hac.autocorrelations(panel(s, d), "y", BY, ["idx"], 3), "acf"), f"""with {PANEL}, u as (select series_id, idx, y - avg(y) over (partition by series_id) as u from s), {LAGS}, c as (select series_id, count(*) as n, sum(u * u) as v, sum(u * u1) as c1, sum(u * u2) as c2, sum(u * u3) as c3 from l group by series_id)
select series_id, n, 1 as lag, round(c1 / v, 6) as acf from c union all select series_id, n, 2, round(c2 / v, 6) from c union all select series_id, n, 3, round(c3 / v, 6) from c""")
add("ljung_box_q", lambda s, d: rounded(hac.ljung_box(panel(s, d), "y", BY, ["idx"], 3), "q"), f"""with {PANEL}, u as (select series_id, idx, y - avg(y) over (partition by series_id) as u from s), {LAGS}
select series_id, count(*) as n, round(count(*) * (count(*) + 2) * (pow(sum(u * u1) / sum(u * u), 2) / (count(*) - 1) + pow(sum(u * u2) / sum(u * u), 2) / (count(*) - 2) + pow(sum(u * u3) / sum(u * u), 2) / (count(*) - 3)), 6) as q from l group by series_id""")
add("dm_stat", lambda s, d: rounded(at.dm_statistics(differences(s, d), "d", BY, ["idx"], 3), "mean_diff", "variance", "statistic", digits=4), f"""with {D}, {LAGS}, c as (select series_id, count(u) as n, avg(d) as md, {hac_sql(2)} as v from l group by series_id)
select series_id, n, round(md, 4) as mean_diff, round(v, 4) as variance, round(case when v > 0 and n >= 30 then md / sqrt(v) * sqrt((n + 1 - 6 + 6.0 / n) / n) end, 4) as statistic from c""")
add("dm_self_normalized", lambda s, d: rounded(at.dm_test(differences(s, d), "e1", "e2", BY, ["idx"], variance_method="self_normalized"), "mean_diff", "variance", "statistic", "p_value", digits=4), f"""with {D}, c as (select series_id, d, sum(u) over (partition by series_id order by idx) as s from u), t as (select series_id, count(*) as n, avg(d) as md, sum(s * s) / (count(*) * count(*)) as v from c group by series_id), z as (select *, case when v > 0 and n >= 30 then md / sqrt(v) end as st from t)
select series_id, n, round(md, 4) as mean_diff, round(v, 4) as variance, round(st, 4) as statistic, round(case when st is null then 1.0 when abs(st) >= 3.24 then 0.01 when abs(st) >= 2.22 then 0.01 + 0.04 * (3.24 - abs(st)) / (3.24 - 2.22) when abs(st) >= 1.82 then 0.05 + 0.05 * (2.22 - abs(st)) / (2.22 - 1.82) else least(1.0, 0.1 + 0.9 * (1.82 - abs(st)) / 1.82) end, 4) as p_value from z""")
add("cw_stat", lambda s, d: rounded(at.cw_test(differences(s, d), "e2", "e1", "p_mean7", "p_last", BY, ["idx"], 2).drop("p_value"), "mean_diff", "variance", "statistic", "mean_unadjusted", digits=7).withColumn("variance", F.round("variance", 2)).withColumn("statistic", F.round("statistic", 4)), f"""with {FC}, d1 as (select series_id, idx, pow(p_mean7 - y, 2) - pow(p_last - y, 2) as raw, pow(p_mean7 - y, 2) - pow(p_last - y, 2) - pow(p_last - p_mean7, 2) as d from f), u as (select *, d - avg(d) over (partition by series_id) as u from d1), {LAGS},
c as (select series_id, count(u) as n, avg(d) as md, {hac_sql(1)} as v, avg(raw) as mu from l group by series_id)
select series_id, n, round(md, 7) as mean_diff, round(v, 2) as variance, round(case when v > 0 and n >= 30 then md / sqrt(v) * sqrt((n + 1 - 4 + 2.0 / n) / n) end, 4) as statistic, round(mu, 7) as mean_unadjusted from c""")
add("gw_moments", lambda s, d: at.gw_moments(differences(s, d), "e1", "e2", BY, ["idx"]).select("series_id", "n_eff", F.round("mean_diff", 3).alias("mean_diff"), F.round(F.col("zz")[0][0] / 1e6, 4).alias("z00"), F.round(F.col("zz")[0][1] / 1e9, 4).alias("z01"), F.round(F.col("zz")[1][1] / 1e12, 4).alias("z11"), F.round(F.col("z")[1] / 1e6, 4).alias("z1")), f"""with {D}, l as (select series_id, d, lag(d) over (partition by series_id order by idx) as d1 from d1), c as (select *, d - avg(d) over (partition by series_id) as c from l where d1 is not null)
select series_id, count(*) as n_eff, round(avg(d), 3) as mean_diff, round(sum(c * c) / 1e6, 4) as z00, round(sum(c * c * d1) / 1e9, 4) as z01, round(sum(c * d1 * c * d1) / 1e12, 4) as z11, round(sum(c * d1) / 1e6, 4) as z1 from c group by series_id""")
PT = """u as (select event_type, count(*) as n, avg((sign(a) = sign(b))::int) as hit, avg((a > 0)::int) as py, avg((b > 0)::int) as px from c where a <> 0 group by event_type),
v as (select *, py * px + (1 - py) * (1 - px) as st from u), w as (select *, st * (1 - st) / n + pow(2 * py - 1, 2) * px * (1 - px) / n + pow(2 * px - 1, 2) * py * (1 - py) / n + 4 * py * px * (1 - py) * (1 - px) / n as var from v)"""
add("pt_stat", lambda s, d: rounded(at.pt_test(differences(s, d).withColumn("a", F.col("y") - F.col("p_last")).withColumn("b", F.col("p_mean7") - F.col("p_last")), "a", "b", ["event_type"]).drop("p_value"), "accuracy", "expected", "statistic"), f"with {FC}, c as (select event_type, y - p_last as a, p_mean7 - p_last as b from f), {PT} select event_type, n, round(hit, 6) as accuracy, round(st, 6) as expected, round((hit - st) / sqrt(var), 6) as statistic from w")
CLASSES = "case when {0} > 15 then 1 when {0} < -15 then -1 else 0 end"
add("pt_three_class", lambda s, d: rounded(at.pt_test(differences(s, d).withColumn("a", F.col("y") - F.col("p_last")).withColumn("b", F.col("p_mean7") - F.col("p_last")), "a", "b", ["event_type"], 15.0).drop("p_value"), "accuracy", "expected", "statistic"), f"""with {FC}, c as (select event_type, {CLASSES.format("(y - p_last)")} as a, {CLASSES.format("(p_mean7 - p_last)")} as b from f),
v as (select event_type, count(*) as n, avg((a = b)::int) as hit, avg((a = -1)::int) * avg((b = -1)::int) + avg((a = 0)::int) * avg((b = 0)::int) + avg((a = 1)::int) * avg((b = 1)::int) as st from c group by event_type)
select event_type, n, round(hit, 6) as accuracy, round(st, 6) as expected, round((hit - st) / sqrt(5 * st * (1 - st) / n), 6) as statistic from v""")

ERRORS = f"{FC}, e as (unpivot (select series_id, idx, y, p_last, p_week, p_mean7, p_all from f) on p_last, p_week, p_mean7, p_all into name model value p), el as (select series_id, idx, model, p - y as e from e)"


def panel_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors_long(forecasts(spark, sf_dir), ["series_id", "idx"])


add("model_ranking", lambda s, d: rounded(at.rank_models(panel_errors(s, d)), "mean_loss", digits=4), f"with {ERRORS}, m as (select model, avg(e * e) as l from el group by model) select model, round(l, 4) as mean_loss, row_number() over (order by l)::int as rank from m")
PAIRS = "pr as (select a.series_id, a.idx, a.model as model_a, b.model as model_b, a.e * a.e - b.e * b.e as d from el a join el b on a.series_id = b.series_id and a.idx = b.idx and a.model < b.model), u as (select *, d - avg(d) over (partition by model_a, model_b) as u from pr)"
PLAGS = "l as (select *, lag(u, 1) over w as u1, lag(u, 2) over w as u2 from u window w as (partition by model_a, model_b order by series_id, idx))"
add("pairwise_dm", lambda s, d: rounded(at.compare_multiple_models(panel_errors(s, d), ["series_id", "idx"], ["series_id", "idx"]).select("better", "worse", "n", "mean_diff", "statistic"), "mean_diff", "statistic", digits=4), f"""with {ERRORS}, {PAIRS}, c as (select model_a, model_b, count(*) as n, avg(d) as md, avg(u * u) / count(*) as v from u group by all)
select case when md > 0 then model_b else model_a end as better, case when md > 0 then model_a else model_b end as worse, n, round(-abs(md), 4) as mean_diff, round(-abs(md) / sqrt(v) * sqrt((n - 1) / n), 4) as statistic from c""")
add("multi_horizon_dm", lambda s, d: rounded(at.compare_horizons(daily_forecasts(s, d).withColumn("e1", F.col("p_last") - F.col("y")).withColumn("e2", F.col("p_mean7") - F.col("y")), "e1", "e2", BY, ["idx"], (1, 2, 3)).select("h", "n", "statistic"), "statistic", digits=5), f"""with {DAILY}, f as (select idx, y, lag(y) over (order by idx) as p, avg(y) over (order by idx rows between 7 preceding and 1 preceding) as q from s), d1 as (select 'all' as series_id, idx, pow(p - y, 2) - pow(q - y, 2) as d from f where idx >= 7), u as (select *, d - avg(d) over () as u from d1), {LAGS},
c as (select count(*) as n, avg(d) as md, {hac_sql(0)} as v1, {hac_sql(1)} as v2, {hac_sql(2)} as v3 from l)
select 1 as h, n, round(md / sqrt(v1) * sqrt((n + 1 - 2) / n), 5) as statistic from c union all select 2, n, round(md / sqrt(v2) * sqrt((n + 1 - 4 + 2.0 / n) / n), 5) from c union all select 3, n, round(md / sqrt(v3) * sqrt((n + 1 - 6 + 6.0 / n) / n), 5) from c""")
add("pairwise_horizon_dm", lambda s, d: rounded(at.compare_models_horizons(panel_errors(s, d), ["series_id", "idx"], ["series_id", "idx"], horizons=(1, 3)).select("model_a", "model_b", "h", "n", "statistic"), "statistic", digits=4), f"""with {ERRORS}, {PAIRS}, {PLAGS}, c as (select model_a, model_b, count(*) as n, avg(d) as md, {hac_sql(0)} as v1, {hac_sql(2)} as v3 from l group by all)
select model_a, model_b, 1 as h, n, round(md / sqrt(v1) * sqrt((n - 1) / n), 4) as statistic from c union all select model_a, model_b, 3, n, round(md / sqrt(v3) * sqrt((n + 1 - 6 + 6.0 / n) / n), 4) from c""")
add("encompassing_ols", lambda s, d: rounded(at.forecast_encompassing_test(forecasts(s, d), "y", "p_mean7", "p_all", ["event_type"], ["series_id", "idx"]).select("event_type", "n", "lambda", "intercept", "statistic"), "lambda", "intercept", "statistic"), f"""with {FC}, x as (select event_type, y - p_mean7 as e, p_all - p_mean7 as x from f), c as (select event_type, count(*) as n, regr_slope(e, x) as l, regr_intercept(e, x) as a, regr_sxx(e, x) as sxx, regr_syy(e, x) as syy, regr_sxy(e, x) as sxy from x group by event_type)
select event_type, n, round(l, 6) as lambda, round(a, 6) as intercept, round(l / sqrt((syy - l * sxy) / (n - 2) / sxx), 6) as statistic from c""")
HACS = [f"((avg(q{i} * q{i}) + 2 * {2 / 3!r} * avg(q{i} * lag1_{i}) + 2 * {1 / 3!r} * avg(q{i} * lag2_{i})))" for i in range(3)]
add("encompassing_hac", lambda s, d: rounded(at.forecast_encompassing_test(forecasts(s, d), "y", "p_mean7", "p_all", ["event_type"], ["series_id", "idx"], h=3).select("event_type", "n", "lambda", "statistic"), "lambda", "statistic"), f"""with {FC}, x as (select event_type, series_id, idx, y - p_mean7 as e, p_all - p_mean7 as x from f), c as (select event_type, regr_slope(e, x) as l, regr_intercept(e, x) as a from x group by event_type),
p as (select x.*, l, pow(e - a - l * x, 2) as p0, pow(e - a - l * x, 2) * x as p1, pow(e - a - l * x, 2) * x * x as p2 from x join c using (event_type)), q as (select *, {", ".join(f"p{i} - avg(p{i}) over (partition by event_type) as q{i}" for i in range(3))} from p),
g as (select *, {", ".join(f"lag(q{i}, {j}) over (partition by event_type order by series_id, idx) as lag{j}_{i}" for i in range(3) for j in (1, 2))} from q),
v as (select event_type, count(*) as n, any_value(l) as l, sum(x) as sx, sum(x * x) as sxx, {", ".join(f"{h} as v{i}" for i, h in enumerate(HACS))} from g group by event_type)
select event_type, n, round(l, 6) as lambda, round(l / sqrt((sx * sx * v0 - 2 * sx * n * v1 + n * n * v2) / pow(n * sxx - sx * sx, 2)), 6) as statistic from v""")
add("dm_influence", lambda s, d: rounded(at.compute_dm_influence(differences(s, d), "e1", "e2", BY, ["idx"], 60, h=3).select("series_id", "idx", "influence", "high", F.coalesce(F.col("block").cast("long"), F.lit(-1)).alias("block"), "block_influence"), "influence", "block_influence", digits=4), f"""with {D}, {LAGS}, c as (select series_id, count(*) as n, sum(d) as t, {hac_sql(2)} as v from l group by series_id),
i as (select u.*, n, t, case when v > 0 then u / sqrt(v * n) else 0.0 end as inf, (row_number() over (partition by series_id order by idx) - 1) // 3 as b from u join c using (series_id)),
j as (select *, case when b < n // 3 then b end as block, stddev_pop(inf) over (partition by series_id) as sd from i)
select series_id, idx, round(inf, 4) as influence, sd > 0 and abs(inf) > 2 * sd as high, coalesce(block, -1) as block, round(case when block is not null then (t / n - (t - sum(d) over (partition by series_id, block)) / (n - count(d) over (partition by series_id, block))) * sqrt(n) end, 4) as block_influence from j""")

# --- intervals ---

SCORES = f"{FC}, sc as (select event_type, abs(y - p_mean7) as s, row_number() over (partition by event_type order by abs(y - p_mean7)) - 1 as k, count(*) over (partition by event_type) as n from f)"
add("split_conformal_quantile", lambda s, d: rounded(conformal.conformal_quantile(forecasts(s, d), F.abs(F.col("y") - F.col("p_mean7")), ["event_type"], 0.1), "q"), f"with {SCORES} select event_type, max(n) as n, round(min(s) filter (where k >= ceil(least(1.0, ceil((n + 1) * (1 - 0.1)) / n) * (n - 1))), 6) as q from sc group by event_type")


def split_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = conformal.SplitConformalPredictor(0.1)
    f = forecasts(spark, sf_dir)
    return p.predict_interval(f, "p_mean7", p.calibrate(f, "p_mean7", "y", ["event_type"]))


QS = f"{SCORES}, q as (select event_type, min(s) filter (where k >= ceil(least(1.0, ceil((n + 1) * (1 - 0.1)) / n) * (n - 1))) as q from sc group by event_type), iv as (select f.*, p_mean7 - q as lower, p_mean7 + q as upper from f join q using (event_type))"
add("interval_quality", lambda s, d: rounded(conformal.evaluate_interval_quality(split_conformal(s, d), "p_mean7", "lower", "upper", "y", 0.9, ["event_type"]), "coverage", "coverage_gap", "mean_width", "interval_score", "low_coverage", "high_coverage", "conditional_gap"), f"""with {QS}, md as (select event_type, quantile_cont(abs(p_mean7), 0.5) as md from iv group by event_type), h as (select iv.*, (y between lower and upper)::int as hit, abs(p_mean7) < md as low from iv join md using (event_type))
select event_type, count(*) as n, round(avg(hit), 6) as coverage, round(avg(hit) - 0.9, 6) as coverage_gap, round(avg(upper - lower), 6) as mean_width, round(avg(upper - lower + 2 / (1 - 0.9) * (greatest(lower - y, 0.0) + greatest(y - upper, 0.0))), 6) as interval_score,
  round(avg(hit) filter (where low), 6) as low_coverage, round(avg(hit) filter (where not low), 6) as high_coverage, round(abs(avg(hit) filter (where low) - avg(hit) filter (where not low)), 6) as conditional_gap from h group by event_type""")
add("coverage_diagnostics", lambda s, d: rounded(conformal.compute_coverage_diagnostics(split_conformal(s, d), "idx", "lower", "upper", "y", 0.9, 20, "event_type"), "coverage"), f"""with {QS}, h as (select idx, event_type, (y between lower and upper)::int as hit from iv), a as (select 'overall' as kind, 'all' as part, hit from h union all select 'window', (idx // 20)::varchar, hit from h union all select 'regime', event_type, hit from h)
select kind, part, count(*) as n, round(avg(hit), 6) as coverage, avg(hit) - 0.9 < -0.05 as undercovered from a group by all""")
add("walk_forward_conformal", lambda s, d: rounded(conformal.walk_forward_conformal(forecasts(s, d), "p_mean7", "y", BY, ["idx"], 0.5, 0.1).select("series_id", "idx", "q", "lower", "upper"), "q", "lower", "upper"), f"""with {FC}, k as (select *, row_number() over (partition by series_id order by idx) as k, floor(count(*) over (partition by series_id) * 0.5) as c, count(*) over (partition by series_id) as n from f), g as (select * from k where c >= 10 and n - c >= 10),
sc as (select series_id, c, abs(y - p_mean7) as s, row_number() over (partition by series_id order by abs(y - p_mean7)) - 1 as r from g where k <= c), q as (select series_id, min(s) filter (where r >= ceil(least(1.0, ceil((c + 1) * (1 - 0.1)) / c) * (c - 1))) as q from sc group by series_id)
select g.series_id, idx, round(q, 6) as q, round(p_mean7 - q, 6) as lower, round(p_mean7 + q, 6) as upper from g join q using (series_id) where k > c""")
add("adaptive_conformal", lambda s, d: rounded(conformal.adaptive_conformal(forecasts(s, d), F.col("y") - F.col("p_mean7"), BY, ["idx"], 80.0, 0.1, 5.0), "error", "q", "next_q"), f"""with recursive {FC}, e as (select series_id, row_number() over (partition by series_id order by idx) as k, idx, abs(y - p_mean7) as e from f),
w(series_id, k, idx, error, q, next_q) as (select series_id, k, idx, e, 80.0::double, greatest(0.0, case when e <= 80.0 then 80.0 - 0.5 else 80.0 + 5.0 * 0.9 end)::double from e where k = 1
  union all select e.series_id, e.k, e.idx, e.e, w.next_q, greatest(0.0, case when e.e <= w.next_q then w.next_q - 0.5 else w.next_q + 5.0 * 0.9 end) from w join e on e.series_id = w.series_id and e.k = w.k + 1)
select series_id, idx, round(error, 6) as error, round(q, 6) as q, round(next_q, 6) as next_q from w""")

# --- gates and guardrails ---


def improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(spark, sf_dir).groupBy("event_type").agg(m.compute_mae("p_mean7", "y").alias("model"), m.compute_mae("p_last", "y").alias("base"))


add("suspicious_improvement_gate", lambda s, d: gates.gate_suspicious_improvement(improvements(s, d), "model", "base", scope=F.col("event_type")).select("gate", "scope", "status", F.round("metric", 6).alias("metric"), "threshold"), f"""with {FC}, c as (select event_type, 1 - avg(abs(p_mean7 - y)) / avg(abs(p_last - y)) as g from f group by event_type)
select 'suspicious_improvement' as gate, event_type as scope, case when g > 0.2 then 'HALT' when g > 0.1 then 'WARN' else 'PASS' end as status, round(g, 6) as metric, 0.2::double as threshold from c""")
INNOVATION = f"""{PANEL}, u as (select series_id, idx, y, y - avg(y) over (partition by series_id) as u, lag(y) over (partition by series_id order by idx) as l from s), u2 as (select *, lag(u) over (partition by series_id order by idx) as u1 from u),
ph as (select series_id, count(*) as n, sum(u * u1) / sum(u * u) as phi from u2 group by series_id), sg as (select series_id, n, phi, stddev_samp(y - phi * l) as sigma from u2 join ph using (series_id) group by all)"""
add("innovation_stats", lambda s, d: rounded(gates.innovation_stats(panel(s, d), "y", BY, ["idx"]), "phi", "sigma"), f"with {INNOVATION} select series_id, n, round(phi, 6) as phi, round(sigma, 6) as sigma from sg")
add("theoretical_bound_gate", lambda s, d: gates.gate_theoretical_bounds(panel(s, d), "y", 35.0, BY, ["idx"]).select("scope", "status", F.round("threshold", 6).alias("threshold")), f"with {INNOVATION} select series_id::varchar as scope, case when n < 30 then 'SKIP' when 35.0 < sigma * sqrt(2 / pi()) * 0.9 then 'HALT' else 'PASS' end as status, round(sigma * sqrt(2 / pi()) * 0.9, 6) as threshold from sg")
add("residual_statistics", lambda s, d: rounded(gates.residual_statistics(differences(s, d), "e2", ["event_type"], ["series_id", "idx"], 2), "jb", "t", "q", digits=4), f"""with {FC}, r as (select event_type, series_id, idx, p_mean7 - y as r, p_mean7 - y - avg(p_mean7 - y) over (partition by event_type) as u from f), l as (select *, lag(u) over w as u1, lag(u, 2) over w as u2 from r window w as (partition by event_type order by series_id, idx)),
c as (select event_type, count(*) as n, avg(r) / stddev_samp(r) * sqrt(count(*)) as t, avg(u * u) as m2, avg(u * u * u) as m3, avg(u * u * u * u) as m4, sum(u * u1) / sum(u * u) as r1, sum(u * u2) / sum(u * u) as r2 from l group by event_type)
select event_type, n, round(n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4), 4) as jb, round(t, 4) as t, round(n * (n + 2) * (r1 * r1 / (n - 1) + r2 * r2 / (n - 2)), 4) as q from c""")
add("regime_gate_metrics", lambda s, d: rounded(gates.regime_metrics(regime_rows(s, d), "p_last", "y", "vol_regime", ["idx"]), "model_mae", "persistence_mae", digits=3), f"""with {DAILY}, x as (select *, y - lag(y) over (order by idx) as dy, lag(y) over (order by idx) as p from s), v as (select *, case when count(dy) over w = 13 then stddev_samp(dy) over w end as sd from x window w as (order by idx rows between 12 preceding and current row)), q as (select quantile_cont(sd, 0.33) as lo, quantile_cont(sd, 0.67) as hi from v),
g as (select idx, y, p, case when sd <= lo then 'LOW' when sd > hi then 'HIGH' else 'MED' end as regime from v, q where p is not null), st as (select *, abs(y - lag(y) over (partition by regime order by idx)) as step from g)
select regime, count(*) as n, round(avg(abs(p - y)), 3) as model_mae, round(avg(step), 3) as persistence_mae from st group by regime having count(*) >= 10""")
add("gate_report", lambda s, d: gates.report_status(gates.run_gates(gates.gate_suspicious_improvement(improvements(s, d), "model", "base"), gates.gate_temporal_boundary(splits.WalkForwardCV(5, 2).folds(s, 100), 2))), f"""with {FC}, c as (select 1 - avg(abs(p_mean7 - y)) / avg(abs(p_last - y)) as g from f group by event_type), k as (select count(*) as n, count(*) filter (where g > 0.2) as h, count(*) filter (where g > 0.1 and g <= 0.2) as w from c)
select case when h > 0 then 'HALT' when w > 0 then 'WARN' else 'PASS' end as status, n + 5 as n_gates, h as n_halt, w as n_warn from k""")
add("residual_autocorrelation", lambda s, d: rounded(gates.check_residual_autocorrelation(differences(s, d), "e2", BY, ["idx"], 3), "r"), f"""with {FC}, l as (select series_id, p_mean7 - y as r, lag(p_mean7 - y, 1) over w as r1, lag(p_mean7 - y, 2) over w as r2, lag(p_mean7 - y, 3) over w as r3 from f window w as (partition by series_id order by idx)),
c as (select series_id, corr(r, r1) as c1, corr(r, r2) as c2, corr(r, r3) as c3 from l group by series_id)
select series_id, 1 as lag, round(c1, 6) as r, abs(c1) > 0.2 as high from c union all select series_id, 2, round(c2, 6), abs(c2) > 0.2 from c union all select series_id, 3, round(c3, 6), abs(c3) > 0.2 from c""")
add("guardrails", lambda s, d: gates.run_all_guardrails(s, 0.7, 1.0, 80, 12, 40, [1.0, 1.5, 3.0]), "select * from (values ('suspicious_improvement', 'error', 1 - 0.7::double / 1, 'improvement over the baseline'), ('minimum_sample_size', 'warning', 80.0, 'rows, 50 needed'), ('stratified_sample_size', 'warning', 12.0, 'moves of the rarer direction, 10 needed; at most 3 times as many of the other'), ('horizon_consistency', 'error', 2.25, 'later horizons over the first')) t(\"check\", level, value, message)")
add("ar_bounds", lambda s, d: s.range(1, 10).select(F.col("id").alias("k"), *[F.round(c, 6).alias(n) for n, c in {
    "ar1_mse": simulate.theoretical_ar1_mse_bound(F.col("id") / 10, 2.0, 3), "ar1_mae": simulate.theoretical_ar1_mae_bound(2.0, F.col("id") / 10, 3), "ar2_mse": simulate.theoretical_ar2_mse_bound(F.col("id") / 20, 0.3, 2.0, 3)}.items()], simulate.check_against_ar1_bounds(1.5, F.col("id") / 10, 2.0, 1)[1].alias("status")),
    """select k, round(2.0 * (1 - pow(k / 10, 6)) / (1 - pow(k / 10, 2)), 6) as ar1_mse, round(sqrt(4.0 * (1 - pow(k / 10, 6)) / (1 - pow(k / 10, 2))) * sqrt(2 / pi()), 6) as ar1_mae,
  round(2.0 * (1 + pow(k / 20, 2) + pow(pow(k / 20, 2) + 0.3, 2)), 6) as ar2_mse, 'WARN' as status from range(1, 10) t(k)""")  # fmt: skip

# --- models, resampling, stationarity, comparison: kernels, so rows only ---

LAGS3 = ["y_lag1", "y_lag2", "y_lag3"]


def supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.with_lags(panel(spark, sf_dir), "y", BY, ["idx"], (1, 2, 3))


def one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.with_lags(daily(spark, sf_dir), "y", BY, ["idx"], (1, 2, 3))


add("walk_forward_evaluate", lambda s, d: models.per_split_metrics(models.walk_forward_evaluate(supervised(s, d), models.Column0(), LAGS3, "y", BY, ["idx"], splits.WalkForwardCV(5, 1, test_size=2))).select("fold", F.round("n", 0).cast("long").alias("n"), F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), F.round("bias", 6).alias("bias")), f"""with {PANEL}, l as (select series_id, idx, y, lag(y) over (partition by series_id order by idx) as p from s), r as (select *, idx - 3 as j, max(idx - 2) over (partition by series_id) as n from l where idx >= 3), k as (select *, ((j - (n - 10)) // 2)::int as fold from r where j >= n - 10)
select fold, count(*) as n, round(avg(abs(p - y)), 6) as mae, round(sqrt(avg(pow(p - y, 2))), 6) as rmse, round(avg(p - y), 6) as bias from k group by fold""")
add("crossfit_mean", lambda s, d: rounded(models.crossfit_predict(supervised(s, d), models.Mean(), LAGS3, "y", BY, ["idx"]).where("prediction is not null"), "prediction", "residual", digits=9), f"""with {PANEL}, r as (select series_id, idx - 3 as position, y, count(*) over (partition by series_id) as n from s where idx >= 3), k as (select *, least(position // (n // 5), 4) as fold from r)
select a.series_id, a.position, round(avg(b.y), 9) as prediction, round(any_value(a.y) - avg(b.y), 9) as residual from k a join k b on a.series_id = b.series_id and b.position < a.fold * (a.n // 5) where a.fold > 0 group by a.series_id, a.position""")


def bagged(make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = one_series(spark, sf_dir)
        n = rows.count()
        bagger = make(models.Ridge(1.0)).fit(rows.where(F.col("idx") < n * 0.8), LAGS3, "y", ["idx"])
        return bagger.predict_interval(rows.where(F.col("idx") >= n * 0.8), ["idx"], 0.1)

    return run


add("residual_bagging", bagged(lambda b: resampling.create_residual_bagger(b, 7)), None)
add("pp_test", lambda s, d: unit_roots.pp_test(panel(s, d), "y", BY, ["idx"]).select("series_id", F.round("statistic", 5).alias("statistic")), f"""with {PANEL}, x as (select series_id, y - lag(y) over (partition by series_id order by idx) as d, lag(y) over (partition by series_id order by idx) as l from s), c as (select series_id, count(d) as n, regr_slope(d, l) as b, regr_sxx(d, l) as sxx, regr_syy(d, l) as syy, regr_sxy(d, l) as sxy from x where l is not null group by series_id)
select series_id, round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 5) as statistic from c""")

ADAPTERS = (compare.NaiveAdapter(), compare.SeasonalNaiveAdapter(7), compare.HistoricAverageAdapter(), compare.HistoricAverageAdapter(5))


def simple_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = compare.split_panel(panel(spark, sf_dir).select("series_id", "idx", "y"), 6)
    return compare.run_forecasts(train, test, ADAPTERS)


FORECASTS = f"""{PANEL}, n as (select series_id, count(*) as n, (count(*) - 6) as t from s group by series_id), tr as (select s.*, t from s join n using (series_id) where idx < t), te as (select s.series_id, s.idx, s.y as actual, t from s join n using (series_id) where idx >= t),
st as (select series_id, arg_max(y, idx) as last, avg(y) as mean, avg(y) filter (where idx >= t - 5) as w5 from tr group by series_id),
fc as (select 'Naive' as model, series_id, idx, last as prediction, actual from te join st using (series_id) union all select 'HistoricAverage', series_id, idx, mean, actual from te join st using (series_id) union all select 'WindowAverage_5', series_id, idx, w5, actual from te join st using (series_id)
 union all select 'SeasonalNaive_7', te.series_id, te.idx, coalesce(tr.y, st.last), actual from te join st using (series_id) left join tr on tr.series_id = te.series_id and tr.idx = te.t - 7 + (te.idx - te.t) % 7)"""
add("adapter_forecasts", lambda s, d: rounded(simple_forecasts(s, d), "prediction"), f"with {FORECASTS} select model, series_id, idx, round(prediction, 6) as prediction, actual from fc")
METRICS = "round(avg(abs(prediction - actual)), 6) as mae, round(sqrt(avg(pow(prediction - actual, 2))), 6) as rmse, round(100 * avg(case when actual <> 0 then abs((prediction - actual) / actual) end), 6) as mape, round(avg((sign(dp) = sign(da))::int), 6) as direction_accuracy"
add("run_comparison", lambda s, d: rounded(compare.compare_forecasts(simple_forecasts(s, d)), "mae", "rmse", "mape", "direction_accuracy"), f"with {FORECASTS}, k as (select *, prediction - lag(prediction) over w as dp, actual - lag(actual) over w as da from fc window w as (partition by model order by series_id, idx)), c as (select model, {METRICS} from k group by model) select *, row_number() over (order by mae, model)::int as rank from c")
add("per_series_comparison", lambda s, d: rounded(compare.compute_comparison_metrics(simple_forecasts(s, d), ["model", "series_id"], ["idx"]), "mae", "rmse", "mape", "direction_accuracy"), f"with {FORECASTS}, k as (select *, prediction - lag(prediction) over w as dp, actual - lag(actual) over w as da from fc window w as (partition by model, series_id order by idx)) select model, series_id, {METRICS} from k group by model, series_id")
add("compare_to_baseline", lambda s, d: rounded(compare.compare_to_baseline(compare.compare_forecasts(simple_forecasts(s, d)), "HistoricAverage"), "model_metric", "baseline_metric", "improvement_pct"), f"with {FORECASTS}, c as (select avg(abs(prediction - actual)) filter (where model = 'HistoricAverage') as m, avg(abs(prediction - actual)) filter (where model = 'Naive') as b from fc) select 'HistoricAverage' as model, 'Naive' as baseline, round(m, 6) as model_metric, round(b, 6) as baseline_metric, round(100 * (1 - m / b), 6) as improvement_pct, m < b as better from c")


def dm_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = simple_forecasts(spark, sf_dir)
    return compare.dm_against_best(f, compare.compare_forecasts(f))


add("dm_against_best", lambda s, d: rounded(dm_best(s, d).drop("p_value"), "statistic", digits=5), f"""with {FORECASTS}, m as (select model, avg(abs(prediction - actual)) as mae from fc group by model), best as (select model from m order by mae, model limit 1),
b as (select series_id, idx, abs(actual - prediction) as e from fc where model = (select model from best)), x as (select f.model, b.e - abs(f.actual - f.prediction) as d from fc f join b using (series_id, idx) where f.model <> (select model from best))
select model, count(*) as n, round(avg(d) / sqrt(var_pop(d) / count(*)) * sqrt((count(*) - 1) / count(*)), 5) as statistic from x group by model""")


def kernel_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = compare.split_panel(panel(spark, sf_dir).select("series_id", "idx", "y"), 6)
    names = ("AutoAR", "GridETS", "AutoTheta", "CrostonClassic", "ADIDA", "IMAPA")
    return compare.run_forecasts(train, test, [compare.statsforecast_adapter(n) for n in names])


add("model_forecasts", kernel_forecasts, None)


def suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    sets = {k: (p.where(F.col("series_id") % 2 == r).select("series_id", "idx", "y"), 6) for k, r in (("even", 0), ("odd", 1))}
    return compare.comparison_report(compare.run_benchmark_suite(sets, ADAPTERS))


add("benchmark_suite", lambda s, d: rounded(suite(s, d), "mean_mae", "mean_rmse"), f"""with {FORECASTS}, c as (select series_id % 2 as ds, model, avg(abs(prediction - actual)) as mae, sqrt(avg(pow(prediction - actual, 2))) as rmse from fc group by all), r as (select *, row_number() over (partition by ds order by mae, model) as rank from c)
select model, count(*) filter (where rank = 1) as wins, count(*) as n_datasets, round(avg(mae), 6) as mean_mae, round(avg(rmse), 6) as mean_rmse from r group by model""")
RLAGS = ", ".join(f"lag(u, {j}) over (order by idx) as u{j}" for j in range(1, 8))
add("returns_volatility", lambda s, d: rounded(hac.compute_hac_variance(returns(s, d), "r", BY, ["idx"], hac.test_bandwidth(2000)), "hac_variance"), f"""with {DAILY}, r as (select idx, y / lag(y) over (order by idx) - 1 as r from s), u as (select idx, r - avg(r) over () as u from r where r is not null), l as (select *, {RLAGS} from u)
select 'all' as series_id, count(u) as n, round({hac_sql(7)}, 6) as hac_variance from l""")
