"""Numpy kernels and special functions against known values and independent ways."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.functions import special
from foldwise.functions.results import jsonify_key, result_to_dict
from foldwise.operators import accuracy_tests as at
from foldwise.operators import compare, conformal, hac, models, regimes, resampling, simulate, unit_roots


def test_distribution_functions():
    assert special.t_cdf(2.0, 10) == pytest.approx(0.963306, abs=1e-6)
    assert special.t_cdf(-1.0, 3) == pytest.approx(0.195501, abs=1e-6)
    assert special.t_ppf(0.975, 29) == pytest.approx(2.045230, abs=1e-5)
    assert special.chi2_sf(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert special.chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.norm_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert special.beta_inc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-10)


def test_normal_column(spark):
    xs = [-40.0, -8.0, -2.5, -1.0, -1e-9, 0.0, 0.3, 1.96, 7.2, 39.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(special.norm_cdf_col(F.col("x")).alias("p")).collect()
    assert all(r.p == pytest.approx(special.norm_cdf(x), abs=1e-13) for r, x in zip(got, xs, strict=True))


def test_unit_root_tests_tell_walks_from_noise():
    rng = np.random.default_rng(1)
    noise = [unit_roots.adf(rng.standard_normal(150))[1] for _ in range(40)]
    walks = [unit_roots.adf(np.cumsum(rng.standard_normal(150)))[1] for _ in range(60)]
    assert np.mean(np.array(noise) < 0.05) > 0.95 and np.mean(np.array(walks) < 0.05) < 0.2
    assert np.mean([unit_roots.kpss(rng.standard_normal(150))[1] >= 0.05 for _ in range(40)]) > 0.8
    assert np.mean([unit_roots.kpss(np.cumsum(rng.standard_normal(150)))[1] < 0.05 for _ in range(40)]) > 0.5
    # tabulated: the 5 % point of the constant case at large n, and of no constant
    assert unit_roots.mackinnon_p(-2.8616, "c") == pytest.approx(0.05, abs=0.002)
    assert unit_roots.mackinnon_p(-1.9410, "n") == pytest.approx(0.05, abs=0.002)
    assert unit_roots.mackinnon_p(-3.4105, "ct") == pytest.approx(0.05, abs=0.002)


def test_dickey_fuller_statistic_is_a_t_ratio():
    y = np.cumsum(np.random.default_rng(3).standard_normal(80))
    x = np.column_stack([y[:-1], np.ones(79)])
    b = np.linalg.solve(x.T @ x, x.T @ np.diff(y))
    s2 = ((np.diff(y) - x @ b) ** 2).sum() / 77
    assert unit_roots.adf(y, 0)[0] == pytest.approx(b[0] / math.sqrt(s2 * np.linalg.inv(x.T @ x)[0, 0]))


def test_lag_selection():
    rng = np.random.default_rng(2)
    y = simulate.arma([0.5, 0.3], [], 800, 1.0, 100, rng)
    assert unit_roots.choose_lag(y, "bic", None, 0.05)[0] == 2 and unit_roots.choose_lag(y, "pacf", None, 0.05)[0] >= 2
    v = unit_roots.pacf(y, 3)
    assert v[1] == pytest.approx(0.3, abs=0.1) and abs(v[2]) < 0.1
    assert unit_roots.choose_lag(y[:9], "aic", None, 0.05) == (None, None)
    assert unit_roots.compute_max_lag(100) == 20 and unit_roots.compute_max_lag(12) == 3


@pytest.mark.parametrize("cost", ["l2", "l1", "rbf"])
def test_pelt_finds_the_shift(cost):
    rng = np.random.default_rng(4)
    y = np.concatenate([rng.normal(0, 1, 40), rng.normal(6, 1, 50)])
    assert regimes.pelt(y, 8.0, 3, cost) == [pytest.approx(40, abs=1)]


def test_pelt_is_optimal():
    rng = np.random.default_rng(5)
    y = rng.normal(size=14) + np.repeat([0, 3], 7)

    def cost(a, b):
        return ((y[a:b] - y[a:b].mean()) ** 2).sum()

    best = min((sum(cost(a, b) for a, b in zip((0, *c), (*c, 14), strict=True)) + 2.0 * len(c), c) for c in [(), *[(i,) for i in range(2, 13)], *[(i, j) for i in range(2, 13) for j in range(i + 2, 13)]])
    got = tuple(regimes.pelt(y, 2.0, 2))
    assert sum(cost(a, b) for a, b in zip((0, *got), (*got, 14), strict=True)) + 2.0 * len(got) <= best[0] + 1e-9


def test_resampling_shapes_and_means():
    rng = np.random.default_rng(6)
    for n, length in ((10, 3), (7, 7), (5, 9)):
        at_ = resampling.block_indices(n, length, rng)
        assert len(at_) == n and at_.min() >= 0 and at_.max() < n
    i = at.stationary_bootstrap_indices(200, 5.0, rng)
    assert len(i) == 200 and 0.7 < np.mean(np.diff(i) % 200 == 1) < 0.9
    assert resampling.compute_block_length(27) == 3 and resampling.compute_block_length(1) == 1
    for s in (resampling.MovingBlockBootstrap(), resampling.StationaryBootstrap(), resampling.FeatureBagging(0.5), resampling.ResidualBootstrap(4, robust=False)):
        resampling.check_bootstrap_strategy(s)


def test_stl_parts_add_up():
    t = np.arange(84)
    y = 0.1 * t + 3 * np.sin(2 * np.pi * t / 7) + np.random.default_rng(7).normal(0, 0.1, 84)
    trend, season, rest = resampling.stl(y, 7)
    assert np.allclose(trend + season + rest, y) and rest.std() < 0.3 and season.std() > 1.5


def test_kernels_of_long_run_variances():
    assert [hac.bartlett_kernel(j, 2) for j in (0, 1, 2, 3)] == [1.0, pytest.approx(2 / 3), pytest.approx(1 / 3), 0.0]
    assert hac.parzen_kernel(0, 3) == 1.0 and hac.parzen_kernel(3, 3) == pytest.approx(2 * 0.25**3)
    assert hac.quadratic_spectral_kernel(0, 3) == 1.0 and 0 < hac.quadratic_spectral_kernel(1, 3) < 1
    assert hac.test_bandwidth(100) == 4


def test_hac_and_dm_against_numpy(spark):
    rng = np.random.default_rng(8)
    e1, e2 = rng.normal(0, 1.0, 60), rng.normal(0, 1.4, 60)
    df = spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate(zip(e1, e2, strict=True))], "s string, i int, e1 double, e2 double")
    d = e1**2 - e2**2
    u = d - d.mean()
    v = ((u * u).mean() + 2 * (2 / 3) * (u[1:] * u[:-1]).mean() + 2 * (1 / 3) * (u[2:] * u[:-2]).mean()) / 60
    r = at.dm_test(df, "e1", "e2", ["s"], ["i"], h=3).first()
    stat = d.mean() / math.sqrt(v) * math.sqrt((60 + 1 - 6 + 6 / 60) / 60)
    assert r.statistic == pytest.approx(stat) and r.p_value == pytest.approx(2 * special.t_cdf(-abs(stat), 59))
    assert at.dm_test(df, "e1", "e2", ["s"], ["i"], alternative="less").first().p_value < 0.5
    same = at.dm_test(df, "e1", "e1", ["s"], ["i"]).first()
    assert same.statistic is None and same.p_value == 1.0
    few = at.dm_test(df.where("i < 20"), "e1", "e2", ["s"], ["i"]).first()
    assert few.statistic is None


def test_gw_against_least_squares(spark):
    rng = np.random.default_rng(9)
    e1, e2 = rng.normal(0, 1.0, 120), rng.normal(0, 1.2, 120)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(e1, e2, strict=True))], "i int, e1 double, e2 double")
    d = e1**2 - e2**2
    cur = d[2:] - d[2:].mean()
    z = cur[:, None] * np.column_stack([np.ones(118), d[1:-1], d[:-2]])
    fit = z @ np.linalg.lstsq(z, np.ones(118), rcond=None)[0]
    r = at.gw_test(df, "e1", "e2", [], ["i"], n_lags=2).first()
    assert r.statistic == pytest.approx(118 - ((1 - fit) ** 2).sum()) and r.p_value == pytest.approx(special.chi2_sf(r.statistic, 3))


def test_encompassing_with_autocorrelation(spark):
    rng = np.random.default_rng(10)
    n, h = 80, 3
    y, a, b = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(y, a, b, strict=True))], "i int, y double, a double, b double")
    x = np.column_stack([np.ones(n), b - a])
    beta = np.linalg.lstsq(x, y - a, rcond=None)[0]
    u = (y - a - x @ beta)[:, None] * x
    inv = np.linalg.inv(x.T @ x)
    meat = np.array([[at._hac((u[:, i] * u[:, j])[:, None], h - 1)[0] * n for j in range(2)] for i in range(2)])
    r = at.forecast_encompassing_test(df, "y", "a", "b", [], ["i"], h=h).first()
    assert r["lambda"] == pytest.approx(beta[1]) and r.statistic == pytest.approx(beta[1] / math.sqrt((inv @ meat @ inv)[1, 1]))


def test_newey_west_covariance(spark):
    rng = np.random.default_rng(11)
    x, u = np.column_stack([np.ones(50), rng.normal(size=50)]), rng.normal(size=50)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, u, strict=True))], "i int, x0 double, x1 double, u double")
    s = x * u[:, None]
    om = s.T @ s + 0.5 * (s[1:].T @ s[:-1] + s[:-1].T @ s[1:])
    inv = np.linalg.inv(x.T @ x)
    assert np.allclose(hac.newey_west_covariance(df, "u", ["x0", "x1"], ["i"], 1), inv @ om @ inv)
    with pytest.raises(ValueError, match="collinear"):
        hac.newey_west_covariance(df.withColumn("x1", F.col("x0")), "u", ["x0", "x1"], ["i"], 1)


def test_conformal_quantile_is_numpys_higher(spark):
    rng = np.random.default_rng(12)
    for n in (10, 37, 200):
        s = np.round(np.abs(rng.normal(size=n)), 1)
        df = spark.createDataFrame([(float(v),) for v in s], "s double")
        level = min(1.0, math.ceil((n + 1) * 0.9) / n)
        assert conformal.conformal_quantile(df, F.col("s"), [], 0.1).first().q == np.quantile(s, level, method="higher")
    assert conformal.conformal_quantile(df.limit(9), F.col("s"), [], 0.1).first().q is None


def test_bellman_by_slow_induction():
    r = np.abs(np.random.default_rng(13).normal(size=40))
    b = conformal.Bellman(r, 0.1, 3, 12)
    cov = [(np.sort(r) <= q).mean() for q in b.grid]
    value = np.zeros(12)
    for _ in range(3):
        value = np.array([min([2 * b.grid[j] + 0.01 * (b.grid[j] - b.grid[i]) ** 2 + value[j] for j in range(12) if cov[j] >= 0.89] or [2 * b.grid[-1] + value[-1]]) for i in range(12)])
    assert np.allclose(b.value, value)
    before = b.q
    assert b.update(1e9) > min(before, b.grid[0]) and len(b.sequence(4)) == 4


def test_coverage_of_split_conformal(spark):
    rng = np.random.default_rng(14)
    rows = [(i % 2, float(v)) for i, v in enumerate(rng.normal(size=4000))]
    df = spark.createDataFrame(rows, "part int, y double").withColumn("p", F.lit(0.0))
    c = conformal.SplitConformalPredictor(0.1)
    out = c.predict_interval(df.where("part = 1"), "p", c.calibrate(df.where("part = 0"), "p", "y", []))
    assert 0.87 < out.select(F.avg((F.col("y").between(F.col("lower"), F.col("upper"))).cast("int"))).first()[0] < 0.93


def test_forecast_kernels():
    y = np.array([5.0, 7.0, 6.0, 8.0, 7.0, 9.0, 8.0, 10.0])
    assert np.allclose(compare.croston(np.array([0, 3.0, 0, 0, 3.0, 0]), 2), 3 / (2 + 0.1 * (3 - 2)))
    for f in (compare.theta, compare.auto_arima, compare.auto_ets, compare.adida, compare.imapa):
        p = f(y, 3)
        assert len(p) == 3 and np.isfinite(p).all() and 5 < p[0] < 13
    assert (compare.croston(np.zeros(5), 2) == 0).all()


def test_models_and_estimator_contract():
    rng = np.random.default_rng(15)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3
    m = models.Ridge(1e-8).fit(x, y)
    assert np.allclose(m.coef, [1, -2, 0.5], atol=1e-6) and np.allclose(m.predict(x), y, atol=1e-5)
    for k in (models.Ridge(), models.Mean(), models.Column0()):
        models.check_temporal_estimator(k)


def test_rows_as_json(spark):
    row = spark.createDataFrame([(1, {"a": "b"}, [1.5])], "n int, d map<string,string>, x array<double>").first()
    assert result_to_dict(row) == {"schema_version": 1, "n": 1, "d": {"a": "b"}, "x": [1.5]}
    with pytest.raises(TypeError):
        jsonify_key((1, 2))


def test_bootstrap_draws_from_all_residuals(spark):
    # a third of the residuals are one value; few are broadcast at most
    values = [7.5] * 2000 + np.random.default_rng(4).normal(0, 3, 4000).tolist()
    residuals = spark.createDataFrame([(v,) for v in [*values, None]], "r double").repartition(3)
    rows = spark.createDataFrame([(i if i else None, i % 3, float(i)) for i in range(80)] + [(5, 2, 9.0)], "i long, j int, p double")
    run = lambda most: sorted(map(tuple, conformal.bootstrap_uncertainty(rows, "p", residuals, "r", ["i", "j"], most=most).collect()), key=str)
    whole, joined = run(100_000), run(10)
    assert joined == whole and len(whole) == 81
    pool = np.sort(values)
    drawn = lambda i, j: [int(hashlib.md5(":".join(str(x) for x in (42, i, j, b) if x is not None).encode()).hexdigest()[:13], 16) % 6000 for b in range(100)]
    want = {(r.i, r.j): np.percentile(pool[drawn(r.i, r.j)], [2.5, 97.5]) for r in rows.collect()}
    assert all(np.allclose((lower - p, upper - p), want[i, j]) for i, j, p, lower, upper in joined)


def test_garch_orders_against_a_plain_recursion():
    from foldwise.operators.regimes import garch_fit, garch_path

    rng = np.random.default_rng(21)
    x = rng.normal(0, 1, 60)
    a, b = [0.1, 0.05], [0.3, 0.2, 0.1]
    h, v = [], x.var()
    for t in range(len(x)):
        past = sum(w * (x[t - i] ** 2 if t >= i else v) for i, w in enumerate(a, 1)) + sum(w * (h[t - j] if t >= j else v) for j, w in enumerate(b, 1))
        h.append(v * (1 - sum(a) - sum(b)) + past)
    assert np.allclose(garch_path(x, a, b), h)
    # a series with clusters: the fit is no worse than any of many random weights
    y, s = [], 1.0
    for _ in range(400):
        s = 0.1 + 0.2 * (y[-1] ** 2 if y else 0) + 0.7 * s
        y.append(rng.normal() * math.sqrt(s))
    y = np.array(y)
    loss = lambda p, q: float((np.log(garch_path(y, p, q)) + y * y / garch_path(y, p, q)).sum())
    p, q = garch_fit(y, 2, 1)
    for w in rng.dirichlet([1, 1, 1, 1], 200):
        assert loss(p, q) <= loss(list(w[:2]), [w[2]]) + 0.5


def test_stl_settings():
    from foldwise.functions.draws import HashDraws
    from foldwise.operators.resampling import ResidualBootstrap, stl

    t = np.arange(70)
    y = 0.2 * t + 2 * np.sin(2 * np.pi * t / 7) + np.random.default_rng(23).normal(0, 0.3, 70)
    smooth, rough = stl(y, 7, False, trend=41)[0], stl(y, 7, False, trend=9)[0]
    assert np.abs(np.diff(smooth, 2)).sum() < np.abs(np.diff(rough, 2)).sum()
    sample = ResidualBootstrap(7, 5, False, {"trend": 41, "seasonal": 9}).sample(np.zeros((70, 1)), y, HashDraws(1))[1]
    trend, season, rest = stl(y, 7, False, seasonal=9, trend=41)
    assert np.isin(np.round(sample - trend - season, 9), np.round(rest, 9)).all()
    with pytest.raises(TypeError):
        ResidualBootstrap(7, stl_kwargs={"nonsense": 1}).sample(np.zeros((70, 1)), y, HashDraws(1))


def test_stationarity_by_step_down():
    from foldwise.operators.simulate import _check_ar

    rng = np.random.default_rng(24)
    for _ in range(300):
        ar = rng.normal(0, 0.7, rng.integers(1, 5))
        inside = (np.abs(np.roots(np.concatenate([[1.0], -ar]))) < 1).all()
        if inside:
            _check_ar(ar)
        else:
            with pytest.raises(ValueError):
                _check_ar(ar)


def test_styles_are_plain_data():
    from foldwise.plans import style

    assert style.muted_color("#ff0000", 1.0) == "#ff0000" and style.muted_color("#ff0000", 0.0) == "#4c4c4c"
    fig = style.create_tufte_figure(2, 1)
    panel = style.range_frame(style.set_tufte_labels(style.set_tufte_title(style.add_subtle_grid(fig["panels"][0]), "t"), "x", "y"), [1, 5, 3], [2, 0, 9])
    assert panel["spines"] == ["left", "bottom"] and panel["range"] == {"x": (1, 5), "y": (0, 9)} and panel["grid"]["axis"] == "y" and panel["title"]["text"] == "t"
    assert style.direct_label_line({}, [1, 2, 3], [4, 5, 6], "line")["labels"] == [{"x": 3, "y": 6, "text": "line", "offset": (5, 5)}]
    assert style.minimal_spines({}, left=False)["spines"] == ["bottom"]
