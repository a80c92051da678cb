"""Queries of the metrics over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.functions.special import norm_cdf_sql
from foldwise.operators import metrics as m
from foldwise.operators import moves, regimes
from foldwise.plans.registry import DAILY, FC, PANEL, add, rounded
from foldwise.sources.tables import daily, daily_forecasts, forecasts, panel

BY = ["series_id"]


def simple(name: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str]) -> None:
    """A query of aggregates by event type over the forecasts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return forecasts(spark, sf_dir).groupBy("event_type").agg(*[F.round(c, 6).alias(k) for k, c in columns().items()])

    add(name, run, f"with {FC} select event_type, {', '.join(f'round({e}, 6) as {k}' for k, e in sql.items())} from f group by event_type")


simple("mae", lambda: {"mae": m.compute_mae("p_mean7", "y")}, {"mae": "avg(abs(p_mean7 - y))"})
simple("mse_rmse", lambda: {"mse": m.compute_mse("p_mean7", "y"), "rmse": m.compute_rmse("p_mean7", "y")}, {"mse": "avg((p_mean7 - y) * (p_mean7 - y))", "rmse": "sqrt(avg((p_mean7 - y) * (p_mean7 - y)))"})
simple("mape", lambda: {"mape": m.compute_mape("p_mean7", "y")}, {"mape": "100 * avg(abs(p_mean7 - y) / greatest(abs(y), 1e-8))"})
simple("smape", lambda: {"smape": m.compute_smape("p_mean7", "y")}, {"smape": "coalesce(100 * avg(case when abs(p_mean7) + abs(y) > 0 then 2 * abs(p_mean7 - y) / (abs(p_mean7) + abs(y)) end), 0.0)"})
simple("bias", lambda: {"bias": m.compute_bias("p_mean7", "y")}, {"bias": "avg(p_mean7 - y)"})
simple("mase", lambda: {"mase": m.compute_mase("p_mean7", "y", m.compute_mae("p_last", "y"))}, {"mase": "avg(abs(p_mean7 - y)) / avg(abs(p_last - y))"})
simple("mrae", lambda: {"mrae": m.compute_mrae("p_mean7", "y", "p_last")}, {"mrae": "avg(case when abs(p_last - y) > 0 then abs(p_mean7 - y) / abs(p_last - y) end)"})
simple("theils_u", lambda: {"theils_u": m.compute_theils_u("p_mean7", "y", "p_last")}, {"theils_u": "sqrt(avg(pow(p_mean7 - y, 2)) / avg(pow(p_last - y, 2)))"})
simple("pearson", lambda: {"r": m.compute_forecast_correlation("p_mean7", "y")}, {"r": "corr(p_mean7, y)"})
simple("r_squared", lambda: {"r_squared": m.compute_r_squared("p_mean7", "y")}, {"r_squared": "1 - sum(pow(y - p_mean7, 2)) / (var_pop(y) * count(y))"})
simple("linex", lambda: {"linex": m.compute_linex_loss("p_mean7", "y", 0.01, 2.0)}, {"linex": "avg(2.0 * (exp(least(greatest(0.01 * (y - p_mean7), -700.0), 700.0)) - 0.01 * (y - p_mean7) - 1))"})
simple("asymmetric_mape", lambda: {"amape": m.compute_asymmetric_mape("p_mean7", "y", 0.7)}, {"amape": "avg(case when y > p_mean7 then 0.7 else 1 - 0.7 end * abs(y - p_mean7) / (abs(y) + 1e-8))"})
simple(
    "directional_loss",
    lambda: {"loss": m.compute_directional_loss("p_mean7", "y", 2.0, 1.0, "p_last")},
    {"loss": "avg(case when y - p_last > 0 and p_mean7 - p_last <= 0 then 2.0 when y - p_last < 0 and p_mean7 - p_last >= 0 then 1.0 else 0.0 end)"},
)
simple("msle", lambda: {"msle": m.compute_squared_log_error("p_mean7", "y")}, {"msle": "avg(pow(ln(y + 1 + 1e-8) - ln(p_mean7 + 1 + 1e-8), 2))"})
simple("huber", lambda: {"huber": m.compute_huber_loss("p_mean7", "y", 20.0)}, {"huber": "avg(case when abs(y - p_mean7) <= 20.0 then 0.5 * pow(y - p_mean7, 2) else 20.0 * (abs(y - p_mean7) - 10.0) end)"})
simple("pinball", lambda: {"pinball": m.compute_pinball_loss("y", "p_mean7", 0.9)}, {"pinball": "avg(case when y >= p_mean7 then 0.9 * (y - p_mean7) else (0.9 - 1) * (y - p_mean7) end)"})
simple(
    "interval_score",
    lambda: {"score": m.compute_interval_score("y", F.col("p_mean7") - 60, F.col("p_mean7") + 60, 0.1), "winkler": m.compute_winkler_score("y", F.col("p_mean7") - 60, F.col("p_mean7") + 60, 0.2)},
    {k: f"avg(120.0 + 2 / {a} * (greatest(p_mean7 - 60 - y, 0.0) + greatest(y - p_mean7 - 60, 0.0)))" for k, a in (("score", 0.1), ("winkler", 0.2))},
)
simple("quantile_coverage", lambda: {"coverage": m.compute_quantile_coverage("y", F.col("p_mean7") - 60, F.col("p_mean7") + 60)}, {"coverage": "avg((y between p_mean7 - 60 and p_mean7 + 60)::int)"})
simple("hit_rate", lambda: {"hit_rate": m.compute_hit_rate(F.col("p_mean7") - F.col("p_last"), F.col("y") - F.col("p_last"))}, {"hit_rate": "avg((sign(p_mean7 - p_last) = sign(y - p_last) or p_mean7 = p_last or y = p_last)::int)"})
simple(
    "profit_factor",
    lambda: {"profit_factor": m.compute_profit_factor(F.col("p_mean7") - F.col("p_last"), F.col("y") - F.col("p_last"))},
    {"profit_factor": "sum(greatest(sign(p_mean7 - p_last) * (y - p_last), 0)) / sum(greatest(-sign(p_mean7 - p_last) * (y - p_last), 0))"},
)
simple("direction_brier", lambda: {"brier": m.compute_direction_brier(F.least(F.lit(1.0), F.col("p_mean7") / 100), (F.col("y") > F.col("p_last")).cast("int"))}, {"brier": "avg(pow(least(1.0, p_mean7 / 100) - (y > p_last)::int, 2))"})
simple(
    "multiclass_brier",
    lambda: {"brier": m.compute_multiclass_brier(F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)), F.when(F.col("y") > 60, 2).when(F.col("y") > 20, 1).otherwise(0))},
    {"brier": "avg(case when y > 60 then 0.25 + 0.09 + 0.64 when y > 20 then 0.25 + 0.49 + 0.04 else 0.25 + 0.09 + 0.04 end)"},
)
simple("direction_probabilities", lambda: {"p": F.avg(m.convert_predictions_to_direction_probs("p_mean7", F.lit(30.0), 40.0))}, {"p": f"avg(1 - {norm_cdf_sql('((40.0 - p_mean7) / 30.0)')})"})
simple("direction_accuracy", lambda: {"signs": moves.compute_direction_accuracy(F.col("p_mean7") - F.col("p_last"), F.col("y") - F.col("p_last")), "classes": moves.compute_direction_accuracy(F.col("p_mean7") - F.col("p_last"), F.col("y") - F.col("p_last"), 15.0)}, {
    "signs": "coalesce(avg(case when abs(y - p_last) > 1e-10 then (sign(p_mean7 - p_last) = sign(y - p_last))::int end), 0.0)",
    "classes": "avg((case when p_mean7 - p_last > 15 then 1 when p_mean7 - p_last < -15 then -1 else 0 end = case when y - p_last > 15 then 1 when y - p_last < -15 then -1 else 0 end)::int)",
})
simple(
    "move_only_mae",
    lambda: dict(zip(("mae", "n"), moves.compute_move_only_mae(F.col("p_mean7") - F.col("p_last"), F.col("y") - F.col("p_last"), 20.0), strict=True)) | {"persistence": moves.compute_persistence_mae(F.col("y") - F.col("p_last"), 20.0)},
    {"mae": "avg(case when abs(y - p_last) > 20 then abs(p_mean7 - y) end)", "n": "count(*) filter (where abs(y - p_last) > 20)", "persistence": "avg(case when abs(y - p_last) > 20 then abs(y - p_last) end)"},
)


def naive_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = m.compute_naive_error(panel(spark, sf_dir), "y", BY, ["idx"]).withColumnRenamed("naive_error", "persistence")
    return rounded(a.join(m.compute_naive_error(panel(spark, sf_dir), "y", BY, ["idx"], "mean").withColumnRenamed("naive_error", "mean_error"), BY), "persistence", "mean_error")


add("naive_error", naive_error, f"with {PANEL}, l as (select *, lag(y) over (partition by series_id order by idx) as p, avg(y) over (partition by series_id) as a from s) select series_id, round(avg(abs(y - p)), 6) as persistence, round(avg(abs(y - a)), 6) as mean_error from l group by series_id")


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts(spark, sf_dir).select("event_type", m.average_rank("p_mean7", ["event_type"]).alias("rp"), m.average_rank("y", ["event_type"]).alias("ry"))
    return f.groupBy("event_type").agg(F.round(m.compute_forecast_correlation("rp", "ry"), 6).alias("rho"))


add("spearman", spearman, f"""with {FC}, r as (select event_type, rank() over (partition by event_type order by p_mean7) + (count(*) over (partition by event_type, p_mean7) - 1) / 2.0 as a,
  rank() over (partition by event_type order by y) + (count(*) over (partition by event_type, y) - 1) / 2.0 as b from f) select event_type, round(corr(a, b), 6) as rho from r group by event_type""")


def crps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("idx").rowsBetween(-10, -1)
    rows = panel(spark, sf_dir).withColumn("xs", F.collect_list("y").over(w)).where("idx >= 10")
    return rows.groupBy("event_type").agg(F.round(m.compute_crps("y", "xs", energy=False), 6).alias("crps"), F.round(m.compute_crps("y", "xs"), 6).alias("energy"))


add("crps", crps, f"""with {PANEL}, pairs as (select a.series_id, a.idx, a.event_type, a.y, b.y as x from s a join s b on a.series_id = b.series_id and b.idx between a.idx - 10 and a.idx - 1 where a.idx >= 10),
near as (select series_id, idx, event_type, avg(abs(x - y)) as d from pairs group by all),
far as (select p.series_id, p.idx, avg(abs(p.x - q.x)) as d from pairs p join pairs q on p.series_id = q.series_id and p.idx = q.idx group by all),
c as (select event_type, near.d - 0.5 * far.d as c from near join far using (series_id, idx))
select event_type, round(avg(c), 6) as crps, round(avg(sqrt(greatest(2 * c, 0.0))), 6) as energy from c group by event_type""")

EVENTS = "e as (select event_id, user_id, least(1.0, value / 500) as p, (event_type = 'purchase')::int as o from events)"


def event_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("event_id", (F.col("series_id") % 10).alias("g"), F.least(F.lit(1.0), F.col("y") / 500).alias("p"), (F.col("event_type") == "purchase").cast("int").alias("o"))


add("brier_decomposition", lambda s, d: rounded(m.brier_decomposition(event_probabilities(s, d), "p", "o", by=["g"]), "brier", "reliability", "resolution", "uncertainty", "skill_score"), f"""with {EVENTS},
b as (select user_id % 10 as g, least(floor(p * 10), 9) as bin, count(*) as n, avg(p) as f, avg(o) as a, sum(pow(p - o, 2)) as se from e group by all),
t as (select g, sum(n) as n, sum(n * a) / sum(n) as base, sum(se) / sum(n) as brier from b group by g)
select b.g, round(any_value(t.brier), 6) as brier, round(sum(b.n * pow(f - a, 2)) / any_value(t.n), 6) as reliability, round(sum(b.n * pow(a - base, 2)) / any_value(t.n), 6) as resolution,
  round(any_value(base * (1 - base)), 6) as uncertainty, round(1 - any_value(brier / (base * (1 - base))), 6) as skill_score, any_value(t.n)::bigint as n from b join t using (g) group by b.g""")
add("calibration_bins", lambda s, d: rounded(m.calibration(event_probabilities(s, d), "p", "o"), "mean_predicted", "observed"), f"""with {EVENTS}, b as (select least(floor(p * 10), 9)::int as bin, count(*) as n, avg(p) as mp, avg(o) as ob from e group by 1)
select k::int as bin, coalesce(n, 0) as n, round(mp, 6) as mean_predicted, round(ob, 6) as observed from range(10) r(k) left join b on bin = k""")
add("pr_auc", lambda s, d: rounded(m.compute_pr_auc(event_probabilities(s, d), "p", "o", "event_id", ["g"]), "pr_auc", "baseline", "precision_at_50_recall"), f"""with {EVENTS},
c as (select user_id % 10 as g, event_id, p, sum(o) over w as tp, row_number() over w as k, sum(o) over (partition by user_id % 10) as pos, count(*) over (partition by user_id % 10) as n from e window w as (partition by user_id % 10 order by p desc, event_id rows unbounded preceding)),
v as (select *, tp / k as pr, tp / pos as rc from c),
l as (select *, coalesce(lag(pr) over w, pos / n) as pr0, coalesce(lag(rc) over w, 0) as rc0 from v window w as (partition by g order by p desc, event_id))
select g, round(sum((rc - rc0) * (pr + pr0) / 2), 6) as pr_auc, round(max(pos / n), 6) as baseline, round(arg_min(pr, (abs(rc - 0.5), k)), 6) as precision_at_50_recall, max(pos)::bigint as n_positive, max(n) as n_total from l group by g""")

RETURNS = f"{DAILY}, r as (select idx, y / lag(y) over (order by idx) - 1 as r, lag(y) over (order by idx) as p from s)"


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("idx")
    return daily(spark, sf_dir).withColumn("r", F.col("y") / F.lag("y").over(w) - 1).where("r is not null")


def trading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns(spark, sf_dir).groupBy(*BY).agg(
        F.round(m.compute_sharpe_ratio("r", 0.01), 6).alias("sharpe"),
        F.round(m.compute_information_ratio("r", F.lit(0.02)), 6).alias("information_ratio"),
        F.round(m.compute_cumulative_return("r", "arithmetic"), 6).alias("total"),
        F.round(m.compute_cumulative_return(F.col("r") / 1000), 6).alias("geometric"),
    )


add("trading_ratios", trading, f"with {RETURNS} select 'all' as series_id, round(avg(r - 0.01) / stddev_samp(r - 0.01) * sqrt(252), 6) as sharpe, round(avg(r - 0.02) / stddev_samp(r - 0.02) * sqrt(252), 6) as information_ratio, round(sum(r), 6) as total, round(product(1 + r / 1000) - 1, 6) as geometric from r where r is not null")
CURVE = f"{RETURNS}, c as (select idx, r, product(1 + r / 100) over (order by idx rows unbounded preceding) as curve from r where r is not null), dd as (select *, (max(curve) over (order by idx rows unbounded preceding) - curve) / max(curve) over (order by idx rows unbounded preceding) as d from c)"
add("max_drawdown", lambda s, d: rounded(m.compute_max_drawdown(returns(s, d).withColumn("r", F.col("r") / 100), "r", BY, ["idx"]), "max_drawdown"), f"with {CURVE} select 'all' as series_id, round(max(d), 6) as max_drawdown from dd")
add("calmar", lambda s, d: rounded(m.compute_calmar_ratio(returns(s, d).withColumn("r", F.col("r") / 100), "r", BY, ["idx"]), "calmar"), f"with {CURVE} select 'all' as series_id, round((pow(product(1 + r / 100), 252.0 / count(*)) - 1) / max(d), 6) as calmar from dd")

VOL = f"""{FC}, v0 as (select *, case when count(y) over w >= 6 then stddev_samp(y) over w end as raw from f window w as (partition by series_id order by idx rows between 12 preceding and current row)),
v as (select *, coalesce(raw, first_value(raw ignore nulls) over (partition by series_id order by idx rows between unbounded preceding and unbounded following)) as vol from v0)"""


def volatile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.rolling_volatility(forecasts(spark, sf_dir), "y", BY, ["idx"], name="vol")


add("rolling_volatility", lambda s, d: rounded(volatile(s, d).select("series_id", "idx", "vol"), "vol"), f"with {VOL} select series_id, idx, round(vol, 6) as vol from v")
add("volatility_weighted", lambda s, d: volatile(s, d).groupBy("event_type").agg(*[F.round(c, 6).alias(k) for k, c in {
    "vn_mae": m.compute_volatility_normalized_mae("p_mean7", "y", "vol"), "inverse": m.compute_volatility_weighted_mae("p_mean7", "y", "vol"), "importance": m.compute_volatility_weighted_mae("p_mean7", "y", "vol", "importance")}.items()]),
    f"with {VOL} select event_type, round(avg(abs(p_mean7 - y) / (vol + 1e-8)), 6) as vn_mae, round(sum(abs(p_mean7 - y) / (vol + 1e-8)) / sum(1 / (vol + 1e-8)), 6) as inverse, round(sum(abs(p_mean7 - y) * vol) / sum(vol), 6) as importance from v group by event_type")
add("volatility_stratified", lambda s, d: rounded(m.compute_volatility_stratified_metrics(volatile(s, d), "p_mean7", "y", "vol", ["event_type"]), "low_mae", "med_mae", "high_mae", "overall_mae", "vn_mae"), f"""with {VOL},
c as (select event_type, quantile_cont(vol, 0.3333) as a, quantile_cont(vol, 0.6667) as b from v group by event_type)
select event_type, round(avg(abs(p_mean7 - y)) filter (where vol <= a), 6) as low_mae, round(avg(abs(p_mean7 - y)) filter (where vol > a and vol <= b), 6) as med_mae, round(avg(abs(p_mean7 - y)) filter (where vol > b), 6) as high_mae,
  count(*) filter (where vol <= a) as n_low, count(*) filter (where vol > a and vol <= b) as n_med, count(*) filter (where vol > b) as n_high, round(avg(abs(p_mean7 - y)), 6) as overall_mae, round(avg(abs(p_mean7 - y) / (vol + 1e-8)), 6) as vn_mae
from v join c using (event_type) group by event_type""")
add("ewma_volatility", lambda s, d: rounded(regimes.ewma_volatility(panel(s, d).select("series_id", "idx", "y"), "y", BY, ["idx"]).select("series_id", "idx", "volatility"), "volatility", digits=4), f"""with recursive {PANEL}, z as (select series_id, idx, pow(y - avg(y) over (partition by series_id), 2) as v from s),
w(series_id, idx, v) as (select series_id, idx, v from z where idx = 0 union all select z.series_id, z.idx, 2.0 / 14 * z.v + (1 - 2.0 / 14) * w.v from w join z on z.series_id = w.series_id and z.idx = w.idx + 1)
select series_id, idx, round(sqrt(v), 4) as volatility from w""")
add("garch_volatility", lambda s, d: regimes.garch_volatility(panel(s, d).select("series_id", "idx", "y"), "y", BY, ["idx"]).select("series_id", "idx", "volatility"), None)

CHANGES = f"{FC}, c as (select *, y - p_last as a, p_mean7 - p_last as b from f)"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(spark, sf_dir).withColumn("a", F.col("y") - F.col("p_last")).withColumn("b", F.col("p_mean7") - F.col("p_last"))


add("move_threshold", lambda s, d: rounded(moves.compute_move_threshold(changes(s, d), "a", by=["event_type"]), "move_threshold"), f"with {CHANGES} select event_type, round(quantile_cont(abs(a), 0.7), 6) as move_threshold from c group by event_type")
MOVES = f"{CHANGES}, t as (select event_type, quantile_cont(abs(a), 0.7) as t from c group by event_type), k as (select c.*, t, case when a > t then 'UP' when a < -t then 'DOWN' else 'FLAT' end as mv from c join t using (event_type))"
add("move_conditional", lambda s, d: rounded(moves.compute_move_conditional_metrics(changes(s, d), "b", "a", by=["event_type"]), "mae_up", "mae_down", "mae_flat", "skill_score", "move_threshold"), f"""with {MOVES}
select event_type, round(avg(abs(b - a)) filter (where mv = 'UP'), 6) as mae_up, round(avg(abs(b - a)) filter (where mv = 'DOWN'), 6) as mae_down, round(avg(abs(b - a)) filter (where mv = 'FLAT'), 6) as mae_flat,
  count(*) filter (where mv = 'UP') as n_up, count(*) filter (where mv = 'DOWN') as n_down, count(*) filter (where mv = 'FLAT') as n_flat,
  round(1 - avg(abs(b - a)) filter (where mv <> 'FLAT') / avg(abs(a)) filter (where mv <> 'FLAT'), 6) as skill_score, round(max(t), 6) as move_threshold,
  count(*) filter (where mv = 'UP') >= 10 and count(*) filter (where mv = 'DOWN') >= 10 as reliable from k group by event_type""")
add("mc_skill_score", lambda s, d: rounded(moves.mc_skill_score(changes(s, d), "a", "b", by=["event_type"]), "skill_score"), f"with {MOVES} select event_type, round(1 - avg(abs(b - a)) filter (where mv <> 'FLAT') / avg(abs(a)) filter (where mv <> 'FLAT'), 6) as skill_score from k group by event_type")

REGIME = f"""{DAILY}, x as (select *, y - lag(y) over (order by idx) as dy, lag(y) over (order by idx) as p_last from s),
v as (select *, case when count(dy) over w = 13 then stddev_samp(dy) over w end as sd from x window w as (order by idx rows between 12 preceding and current row)),
q as (select quantile_cont(sd, 0.33) as lo, quantile_cont(sd, 0.67) as hi from v),
g as (select v.*, case when sd <= lo then 'LOW' when sd > hi then 'HIGH' else 'MED' end as vol_regime, case when abs(dy) <= 50000 then 'FLAT' when dy > 0 then 'UP' when dy < 0 then 'DOWN' end as dir_regime from v, q)"""


def regime_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("idx")
    rows = regimes.classify_volatility_regime(daily(spark, sf_dir), "y", BY, ["idx"])
    rows = rows.withColumn("p_last", F.lag("y").over(w)).withColumn("dy", F.col("y") - F.col("p_last"))
    return rows.withColumn("dir_regime", regimes.classify_direction_regime("dy", 50000.0)).withColumn("regime", regimes.get_combined_regimes("vol_regime", "dir_regime"))


add("volatility_regime", lambda s, d: regime_rows(s, d).select("idx", "vol_regime"), f"with {REGIME} select idx, vol_regime from g")
add("direction_regime", lambda s, d: regimes.get_regime_counts(regime_rows(s, d), "dir_regime"), f"with {REGIME} select dir_regime, count(*) as n from g group by dir_regime")
add("combined_regimes", lambda s, d: regimes.get_regime_counts(regime_rows(s, d).where("dy is not null"), "regime"), f"with {REGIME} select vol_regime || '-' || dir_regime as regime, count(*) as n from g where dy is not null group by 1")
add("masked_regimes", lambda s, d: regimes.get_regime_counts(regimes.mask_low_n_regimes(regime_rows(s, d).where("dy is not null"), "regime", 150), "masked"), f"""with {REGIME}, c as (select vol_regime || '-' || dir_regime as r, count(*) as n from g where dy is not null group by 1)
select case when n < 150 then 'MASKED' else r end as masked, sum(n)::bigint as n from c group by 1""")
add("stratified_metrics", lambda s, d: rounded(regimes.compute_stratified_metrics(regime_rows(s, d), "p_last", "y", "regime", 100), "mae", "rmse", "pct"), f"""with {REGIME}, e as (select vol_regime || '-' || dir_regime as regime, p_last - y as e from g where dy is not null),
t as (select regime, avg(abs(e)) as mae, sqrt(avg(e * e)) as rmse, count(*) as n from e group by grouping sets ((regime), ()))
select regime, case when regime is null or n >= 100 then round(mae, 6) end as mae, case when regime is null or n >= 100 then round(rmse, 6) end as rmse, n, round(100.0 * n / (select count(*) from e), 6) as pct, regime is null or n >= 100 as kept from t""")

SHIFTS = f"""{DAILY}, x as (select *, y - lag(y) over (order by idx) as dy, count(*) over () as n from s), md as (select quantile_cont(dy, 0.5) as md from x), b as (select 0.4 * 1.4826 * quantile_cont(abs(dy - md), 0.5) as thr from x, md),
sc as (select x.*, thr, case when idx >= 8 and idx <= n - 8 then abs(avg(y) over (order by idx rows between current row and 7 following) - avg(y) over (order by idx rows between 8 preceding and 1 preceding)) end as score from x, b),
pk as (select *, coalesce(score > thr and coalesce(max(score) over (order by idx rows between 4 preceding and 1 preceding), -1) < score and coalesce(max(score) over (order by idx rows between 1 following and 3 following), -1) <= score, false) as peak from sc)"""
add("changepoint_scores", lambda s, d: rounded(regimes.level_shifts(daily(s, d), "y", BY, ["idx"], penalty=0.4).select("idx", "score", "threshold", "peak"), "score", "threshold", digits=3), f"with {SHIFTS} select idx, round(score, 3) as score, round(thr, 3) as threshold, peak from pk")


def changepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.detect_changepoints_variance(daily(spark, sf_dir), "y", BY, ["idx"], penalty=0.4).withColumn("position", F.col("position").cast("long"))


SPACED = f"""with recursive {SHIFTS}, p as (select idx, score from pk where peak), sp(idx, score) as ((select idx, score from p order by idx limit 1) union all
  (select q.idx, q.score from sp, lateral (select idx, score from p where p.idx >= sp.idx + 4 order by idx limit 1) q))"""
add("changepoints_variance", lambda s, d: rounded(changepoints(s, d), "cost_reduction", digits=3), f"{SPACED} select 'all' as series_id, idx as position, round(score, 3) as cost_reduction from sp")
SEGMENTS = f"{SPACED}, g as (select s.idx, s.y, sum((sp.idx is not null)::int) over (order by s.idx) as segment from s left join sp on s.idx = sp.idx), st as (select *, y - lag(y) over (partition by segment order by idx) as step from g), vs as (select segment, coalesce(stddev_pop(step), 0.0) as v, min(idx) as a, max(idx) + 1 as b from st group by segment), cu as (select case when count(*) >= 3 then quantile_cont(v, 0.33) else avg(v) * 0.5 end as lo, case when count(*) >= 3 then quantile_cont(v, 0.67) else avg(v) * 1.5 end as hi from vs)"
add("segment_boundaries", lambda s, d: regimes.get_segment_boundaries(daily(s, d), BY, ["idx"], changepoints(s, d)).withColumn("segment", F.col("segment").cast("long")), f"{SEGMENTS} select 'all' as series_id, segment::bigint as segment, a as start, b as stop from vs")
add("segment_regimes", lambda s, d: rounded(regimes.create_regime_indicators(daily(s, d), "y", BY, ["idx"], changepoints(s, d)).select("idx", "segment_value", "regime", F.col("periods_since_change").cast("long").alias("periods_since_change"), F.col("is_regime_change").cast("long").alias("is_regime_change")), "segment_value", digits=3),
    f"{SEGMENTS} select g.idx, round(v, 3) as segment_value, case when v < lo then 'LOW' when v > hi then 'HIGH' else 'MEDIUM' end as regime, g.idx - vs.a as periods_since_change, (g.idx - vs.a between 1 and 4)::bigint as is_regime_change from g join vs using (segment), cu")


def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: two models of daily revenue side by side with their loss difference's statistic."""
    from foldwise.operators.accuracy_tests import dm_statistics

    rows = daily_forecasts(spark, sf_dir)
    both = rows.groupBy("series_id").agg(m.compute_mae("p_last", "y").alias("mae_last"), m.compute_mae("p_mean7", "y").alias("mae_mean7"), m.compute_rmse("p_mean7", "y").alias("rmse_mean7"), m.compute_mase("p_mean7", "y", m.compute_mae("p_last", "y")).alias("mase_mean7"))
    d = rows.withColumn("d", F.pow(F.col("p_last") - F.col("y"), 2) - F.pow(F.col("p_mean7") - F.col("y"), 2))
    stat = dm_statistics(d, "d", BY, ["idx"]).select("series_id", "n", F.col("statistic").alias("dm"))
    return rounded(both.join(stat, "series_id"), "mae_last", "mae_mean7", "rmse_mean7", "mase_mean7", "dm", digits=4)


add("headline", headline, f"""with {DAILY}, f as (select idx, y, lag(y) over (order by idx) as p, avg(y) over (order by idx rows between 7 preceding and 1 preceding) as q from s), k as (select * from f where idx >= 7), dd as (select pow(p - y, 2) - pow(q - y, 2) as d from k)
select 'all' as series_id, round(avg(abs(p - y)), 4) as mae_last, round(avg(abs(q - y)), 4) as mae_mean7, round(sqrt(avg(pow(q - y, 2))), 4) as rmse_mean7, round(avg(abs(q - y)) / avg(abs(p - y)), 4) as mase_mean7, count(*) as n,
  round((select avg(d) / sqrt(var_pop(d) / count(*)) * sqrt((count(*) - 1) / count(*)) from dd), 4) as dm from k""")
