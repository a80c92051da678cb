"""Operators that have no SQL: sources, gates, bagging, nested search, comparison objects."""

from __future__ import annotations

import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.functions.results import conforms, schema_of
from foldwise.operators import accuracy_tests, compare, gates, metrics, models, protocols, regimes, resampling, simulate, splits
from foldwise.plans import all_queries, display
from foldwise.sources import datasets, results
from foldwise.sources.tables import errors_long


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(1)
    y = simulate.arma([0.8], [], 160, 1.0, 100, rng)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "idx long, y double").withColumn("s", F.lit("a"))
    return models.with_lags(df, "y", ["s"], ["idx"], (1, 2)).cache()


def test_walk_forward_rows(walk):
    cv = splits.WalkForwardCV(4, 2, test_size=5)
    out = models.walk_forward_evaluate(walk, models.Ridge(1.0), ["y_lag1", "y_lag2"], "y", ["s"], ["idx"], cv)
    assert conforms(out, "WalkForwardResults")
    pdf, got = walk.orderBy("idx").toPandas(), out.toPandas()
    x, y = pdf[["y_lag1", "y_lag2"]].to_numpy(), pdf["y"].to_numpy()
    for k, (a, b, c, d) in enumerate(cv.bounds(len(y))):
        want = models.Ridge(1.0).fit(x[a:b], y[a:b]).predict(x[c:d])
        assert np.allclose(got[got.fold == k].sort_values("position").prediction, want)


def test_crossfit_covers_all_but_the_first_fold(walk):
    fit = protocols.CrossFitter(splits.CrossFitCV(4))
    p = fit.fit_predict(walk, models.Ridge(), ["y_lag1"], "y", ["s"], ["idx"]).toPandas()
    n = len(p)
    assert p.prediction.isna().sum() == n // 4 and p.set_index("position").prediction[n // 4 :].notna().all()
    both = models.cross_fit_residualize(walk.withColumn("z", 2 * F.col("y")), models.Ridge(), models.Ridge(), ["y_lag1"], "y", "z", ["s"], ["idx"]).dropna().toPandas()
    assert np.allclose(both.residual_b, 2 * both.residual_a)


def test_nested_search(walk):
    cv = protocols.NestedWalkForwardCV(models.Ridge, {"alpha": [0.01, 1e6]}, 2, 40).fit(walk, ["y_lag1", "y_lag2"], "y", ["idx"])
    assert cv.best_params == {"alpha": 0.01} and cv.get_result().count() == 2
    assert cv.predict(walk, ["idx"]).count() == walk.count()


def test_gap_sensitivity(walk):
    rows = models.gap_sensitivity_analysis(walk, models.Column0(), ["y_lag1"], "y", ["s"], ["idx"], range(3), 10)
    assert rows.count() == 3 and models.gap_summary(rows, ["s"]).first().sensitivity == pytest.approx(0, abs=1e-9)


def test_signal_gate_halts_only_with_signal(spark, walk):
    found = gates.gate_signal_verification(walk, models.Ridge(), ["y_lag1", "y_lag2"], "y", ["idx"], 60).first()
    assert found.status == "HALT" and found.metric == pytest.approx(1 / 61)
    rng = np.random.default_rng(2)
    noise = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(120, 2)))], "idx long, x double, y double")
    assert gates.gate_signal_verification(noise, models.Ridge(), ["x"], "y", ["idx"], 60, permutation="iid").first().status == "PASS"
    y = np.arange(11)
    assert sorted(gates.permuted(y, 3, rng).tolist()) == y.tolist()
    assert gates.gate_synthetic_ar1(spark, models.Ridge()).first().status == "PASS"


def test_gates_and_reports(spark):
    rows = spark.createDataFrame([("a", 0.7, 1.0), ("b", 0.85, 1.0), ("c", 1.1, 1.0), ("d", 1.0, 0.0)], "k string, m double, b double")
    g = gates.gate_suspicious_improvement(rows, "m", "b", scope=F.col("k"))
    assert {r.scope: r.status for r in g.collect()} == {"a": "HALT", "b": "WARN", "c": "PASS", "d": "SKIP"} and conforms(g, "GateResult")
    assert gates.report_status(g).first().status == "HALT" and gates.report_status(g.where("scope in ('c', 'd')")).first().status == "PASS"
    assert {r.status for r in display.gate_gauge(g).where("severity = 2").collect()} == {"HALT"}
    few = spark.createDataFrame([(i, float(i % 3)) for i in range(20)], "i int, r double")
    assert gates.gate_residual_diagnostics(few, "r", [], ["i"]).first().status == "SKIP"
    biased = spark.createDataFrame([(i, 5.0 + float((i * 7919) % 13)) for i in range(60)], "i int, r double")
    assert gates.gate_residual_diagnostics(biased, "r", [], ["i"]).first().status == "HALT"


def test_validators(spark):
    good = spark.createDataFrame([(0.5, 1.0, 2.0)], "a double, b double, c double")
    gates.finite_se(good, "a")
    gates.ci_ordered(good, "b", "c")
    gates.coverage_in_unit(good, "a")
    gates.psd(np.eye(3))
    for bad in (lambda: gates.finite_se(good.withColumn("a", F.lit(0.0)), "a"), lambda: gates.ci_ordered(good, "c", "b"), lambda: gates.coverage_in_unit(good, "c"), lambda: gates.psd(-np.eye(2)), lambda: gates.psd(np.array([[1, 2], [0, 1.0]]))):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("make", [resampling.create_block_bagger, resampling.create_stationary_bagger, resampling.create_feature_bagger])
def test_bagging(walk, make):
    bag = make(models.Ridge(), 8).fit(walk.where("idx < 120"), ["y_lag1", "y_lag2"], "y", ["idx"])
    late = walk.where("idx >= 120")
    out = bag.predict_interval(late, ["idx"], 0.2).collect()
    assert len(out) == late.count() and all(r.lower <= r.prediction + 1e-9 and r.prediction <= r.upper + 1e-9 for r in out)
    again = {r.idx: r.prediction for r in bag.predict(late.repartition(3), ["idx"]).collect()}
    assert all(again[r.idx] == pytest.approx(r.prediction) for r in out)


def test_reality_check_and_spa(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 2, 80)
    rows = [(i, m, float(v)) for m, e in (("base", base), ("good", rng.normal(0, 0.5, 80)), ("bad", rng.normal(0, 2.5, 80))) for i, v in enumerate(e)]
    errors = spark.createDataFrame(rows, "t int, model string, e double")
    r = accuracy_tests.reality_check_test(errors, "base", ["t"], n_bootstrap=200).first()
    assert r.best_model == "good" and r.p_value < 0.05
    s = accuracy_tests.spa_test(errors.where("model <> 'good'"), "base", ["t"], n_bootstrap=200).first()
    assert s.p_value > 0.2 and s.p_value_lower <= 1
    assert accuracy_tests.spa_test(errors.where("model <> 'good'"), "base", ["t"], n_bootstrap=200).first() == s


def test_wild_bootstrap(spark):
    folds = spark.createDataFrame([(i, 1.0 + 0.01 * i, -0.1 if i % 2 else 0.1) for i in range(10)], "fold int, big double, none double")
    assert resampling.wild_cluster_bootstrap(folds, "big", "fold", []).first().p_value < 0.05
    r = resampling.wild_cluster_bootstrap(folds, "none", "fold", []).first()
    assert r.weight_type == "webb" and r.p_value > 0.5 and r.n_folds == 10


def test_comparison_runner(spark, tmp_path):
    panel = simulate.synthetic_panel(spark, 80, 4, 0.99).cache()
    adapters = [compare.NaiveAdapter(), compare.SeasonalNaiveAdapter(7), compare.HistoricAverageAdapter(), compare.statsforecast_adapter("AutoTheta"), compare.KernelAdapter("Broken", lambda y, h: 1 / 0)]
    for a in adapters[:4]:
        compare.check_forecast_adapter(a, panel)
    rank = compare.run_comparison(panel, 6, adapters)
    got = {r.model: r for r in rank.collect()}
    assert len(got) == 4 and got["Naive"].mae < got["HistoricAverage"].mae and conforms(rank, "ComparisonResult")
    path = str(tmp_path / "check")
    sets = {"First set": (panel, 6), "Second": (panel.where("series_id < 's2'"), 6)}
    one = compare.run_benchmark_suite(sets, adapters[:3], path)
    assert results.list_checkpoints(spark, path) == ["First Set", "Second"] and results.load_checkpoint(spark, path, "none") is None
    again = compare.run_benchmark_suite(sets, adapters[:3], path)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, again.collect()))
    report = compare.comparison_report(one)
    assert report.agg(F.sum("wins")).first()[0] == 2
    text = compare.generate_benchmark_docs(one, results.create_run_metadata(["Naive"]))
    assert "## First set" in text and "| Naive |" in text
    results.save_benchmark_results(one, str(tmp_path / "r"), {"run": "x"})
    assert results.load_benchmark_results(spark, str(tmp_path / "r")).count() == one.count()
    better = compare.compare_to_baseline(rank, "Naive", "HistoricAverage").first()
    assert better.better and better.improvement_pct > 0
    calls = []
    protocols.ProgressAdapter(compare.NaiveAdapter(), lambda a, b: calls.append((a, b))).forecast(*compare.split_panel(panel, 6))
    assert calls == [(4, 4)]
    bars = display.metric_bars(rank, "model", ["mae", "rmse"], "Naive")
    assert bars.where("model = 'Naive' and relative = 1").count() == 2


def test_long_panels_from_files(spark, tmp_path):
    rows = [(s, t, float(t + len(s))) for s, n in (("a", 30), ("bb", 40), ("ccc", 25)) for t in range(n)]
    spark.createDataFrame(rows, "unique_id string, ds int, y double").write.parquet(str(tmp_path / "m4"))
    d = datasets.load_m4(spark, str(tmp_path / "m4"), "yearly", None)
    assert (d.metadata.n_series, d.metadata.total_observations, d.metadata.train_end_idx) == (3, 75, 19)
    train, test = d.get_train_test_split()
    assert train.count() == 57 and test.count() == 18
    datasets.validate_dataset(d)
    assert datasets.load_m3(spark, str(tmp_path / "m4"), "yearly", 2).metadata.n_series == 2
    with pytest.raises(datasets.DatasetNotFoundError):
        datasets.load_m4(spark, str(tmp_path / "nowhere"))


def test_wide_and_calendar_files(spark, tmp_path):
    head = "id,store," + ",".join(f"d_{k}" for k in range(1, 41))
    (tmp_path / "m5.csv").write_text(head + "\n" + "\n".join(f"i{r},s," + ",".join(str(r * k) for k in range(1, 41)) for r in range(3)))
    total = datasets.load_m5(spark, str(tmp_path / "m5.csv"), None)
    assert total.panel.where("idx = 9").first().y == 30 and total.metadata.train_end_idx == 12
    assert datasets.load_m5(spark, str(tmp_path / "m5.csv"), 2, False).metadata.n_series == 2
    (tmp_path / "fred.csv").write_text("DATE,DGS10,DGS2\n2024-01-03,4.0,1\n2024-01-05,4.1,2\n2024-01-08,.,3\n2024-01-12,4.3,4\n2024-01-16,4.4,.\n")
    weekly = datasets.load_fred_rates(spark, str(tmp_path / "fred.csv"), ["DGS10", "DGS2"]).panel.orderBy("series_id", "idx").collect()
    assert [(r.series_id, str(r.ts), r.y) for r in weekly] == [("DGS10", "2024-01-05", 4.1), ("DGS10", "2024-01-12", 4.3), ("DGS2", "2024-01-05", 2.0), ("DGS2", "2024-01-12", 4.0)]
    assert "DGS10" in datasets.list_available_series()


def test_degenerate_metrics(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, 0.5, 0), (1, 1.0, 1.0, 0.6, 0), (2, 1.0, 1.0, 0.7, 0)], "i int, p double, a double, q double, o int")
    r = df.agg(metrics.compute_r_squared("p", "a").alias("r2"), metrics.compute_theils_u("p", "a", F.lit(1.0)).alias("u"), metrics.compute_theils_u("q", "a", F.lit(1.0)).alias("v"), metrics.compute_sharpe_ratio("a").alias("s"), metrics.compute_mase("p", "a", 0.0).alias("m"), metrics.compute_mrae("p", "a", "a").alias("z")).first()
    assert r.r2 == 1.0 and r.u == 1.0 and math.isinf(r.v) and math.isinf(r.s) and r.m is None and r.z is None
    assert metrics.compute_pr_auc(df, "q", "o", "i").first().pr_auc == 0.0
    assert metrics.compute_pr_auc(df.withColumn("o", F.lit(1)), "q", "o", "i").first().pr_auc == 1.0
    assert metrics.calibration(df, "q", "o").count() == 10
    assert df.agg(metrics.compute_squared_log_error(-F.col("p"), "a").alias("v")).first().v is None
    empty = df.limit(0).agg(metrics.compute_mae("p", "a").alias("mae"), metrics.compute_smape("p", "a").alias("smape")).first()
    assert empty.mae is None and empty.smape == 0.0


def test_regimes_on_a_short_series(spark):
    df = spark.createDataFrame([("a", i, float(i % 4)) for i in range(10)], "s string, i int, y double")
    assert {r.vol_regime for r in regimes.classify_volatility_regime(df, "y", ["s"], ["i"]).collect()} == {"MED"}
    for est in (protocols.RollingVolatility(4), protocols.EWMAVolatility(), protocols.GARCHVolatility()):
        assert est.estimate(df, "y", ["s"], ["i"]).where("volatility is not null").count() == 10
    assert errors_long(df.selectExpr("i", "y", "y as p_last", "y as p_week", "y as p_mean7", "y as p_all"), ["i"]).count() == 40
    assert "lambda" in schema_of("EncompassingTestResult").names


def test_smaller_models_do_not_stand_under_the_library_names():
    for name in ("AutoARIMA", "AutoETS"):
        with pytest.raises(ValueError, match=name):
            compare.statsforecast_adapter(name, 7)
    assert [compare.statsforecast_adapter(n, 7).name for n in ("AutoAR", "GridETS")] == ["AutoAR", "GridETS"]
    assert protocols.StatsforecastAdapter().name == "AutoAR"


@pytest.mark.parametrize(
    ("query", "module", "name", "given"),
    [
        ("residual_bagging", resampling, "create_residual_bagger", {"n_estimators", "robust"}),
        ("block_bagging", resampling, "create_block_bagger", {"n_estimators"}),
        ("stationary_bagging", resampling, "create_stationary_bagger", {"n_estimators"}),
        ("feature_bagging", resampling, "create_feature_bagger", {"n_estimators"}),
        ("reality_check", accuracy_tests, "reality_check_test", {"n_bootstrap"}),
        ("spa", accuracy_tests, "spa_test", {"n_bootstrap"}),
        ("signal_verification_gate", gates, "gate_signal_verification", {"n_shuffles"}),
    ],
)
def test_queries_take_the_default_replicates(spark, monkeypatch, query, module, name, given):
    real, seen = inspect.signature(getattr(module, name)), []

    def stop(*args, **kwargs):
        seen.append(set(real.bind(*args, **kwargs).arguments))
        raise InterruptedError

    monkeypatch.setattr(module, name, stop)
    with pytest.raises(InterruptedError):
        all_queries()[query](spark, "/root/testdata/sf0.001")
    assert not seen[0] & given


def test_horizon_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([("a", h, 1.0) for h in (4, 3, 2, 1)] + [("b", h, p) for h, p in ((1, 0.5), (2, 0.01), (3, 0.01), (4, None))], "s string, h int, p_value double").coalesce(1)
    got = {r.s: r.best_h for r in accuracy_tests.horizon_pattern(df, ["s"]).collect()}
    assert got == {"a": 1, "b": 2}


def test_empty_cells_of_wide_files_are_no_rows(spark, tmp_path):
    (tmp_path / "m5.csv").write_text("id," + ",".join(f"d_{k}" for k in range(1, 41)) + "\nlong," + ",".join(["1"] * 40) + "\nshort," + ",".join(["2"] * 38) + ",,\n")
    each = datasets.load_m5(spark, str(tmp_path / "m5.csv"), None, aggregate=False)
    rows = {r.series_id: (r.n, r.last) for r in each.panel.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("last")).collect()}
    assert rows == {"long": (40, 39), "short": (38, 37)} and each.metadata.total_observations == 78
    total = datasets.load_m5(spark, str(tmp_path / "m5.csv"), None)
    assert total.panel.agg(F.sum("y")).first()[0] == 116 and total.metadata.total_observations == 40


def test_percentiles_fall_where_sql_puts_them(spark):
    import duckdb

    rng, rows = np.random.default_rng(7), []
    for g in range(60):
        v = np.abs(np.diff(np.round(rng.exponential(50, 60 + g), 2)))
        # two neighbours of the percentile that differ by a rounding error
        at = int((len(v) - 1) * 0.7)
        v = np.sort(v)
        v[at + 1] = np.nextafter(v[at], np.inf)
        rows += [(g, float(x)) for x in v]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: (r.p, r.q) for r in metrics.percentiles(df, F.col("v"), [0.7, 0.33], ["g"], ["p", "q"]).collect()}
    pdf = df.toPandas()  # noqa: F841
    assert got == {g: (p, q) for g, p, q in duckdb.sql("select g, quantile_cont(v, 0.7), quantile_cont(v, 0.33) from pdf group by g").fetchall()}
    none = spark.createDataFrame([(1, None), (2, 3.0)], "g int, v double")
    assert {r.g: r.p for r in metrics.percentiles(none, F.col("v"), [0.5], ["g"], ["p"]).collect()} == {1: None, 2: 3.0}
    assert metrics.percentiles(none.where("g = 9"), F.col("v"), [0.5], [], ["p"]).collect()[0].p is None


def test_zeros_as_demand():
    y = np.array([4.0, 0, 2, 6, 0, 3])
    level = y[0]
    for v in y[1:]:
        level += 0.1 * (v - level)
    assert np.allclose(compare.croston(y, 2, zeros=True), level) and not np.allclose(compare.croston(y, 2), level)
    assert np.allclose(compare.adida(y, 2, zeros=True), compare.ses(y)[0]) and np.allclose(compare.imapa(y, 2, zeros=True), compare.ses(y)[0])
