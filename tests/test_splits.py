"""Splitters: bounds against their definitions, properties for random settings, purging against sets."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foldwise.operators import splits
from foldwise.plans import display


@given(st.integers(50, 400), st.integers(1, 6), st.integers(0, 8), st.integers(1, 5), st.one_of(st.none(), st.integers(10, 25)))
@settings(max_examples=150, deadline=None)
def test_walk_forward_properties(n, k, gap, size, window):
    cv = splits.WalkForwardCV(k, gap, "sliding" if window else "expanding", window, 0, size)
    if not cv.get_n_splits(n, strict=False):
        return
    b = cv.bounds(n)
    assert b[-1][3] == n and len(b) <= k
    for lo, hi, a, z in b:
        assert 0 <= lo < hi and a - hi == gap and z - a == size and (window is None or hi - lo == window)
    assert all(p[3] == q[2] for p, q in zip(b, b[1:], strict=False))


def sets(n, runs, purge, pct):
    test = {i for a, b in runs for i in range(a, b)}
    near = {i for t in test for i in range(t - purge, t + purge + 1)} - test
    width = math.ceil(pct * n)
    after = {i for a, b in runs for i in range(b, min(b + width, n))} - test
    return test, near, after


@pytest.mark.parametrize(
    ("splitter", "n"),
    [(splits.PurgedKFold(5, 3, 0.02), 103), (splits.PurgedKFold(4, 0, 0.0), 40), (splits.CombinatorialPurgedCV(5, 2, 2, 0.03), 61), (splits.PurgedWalkForward(3, None, 10, 2, 0.02, 1), 80), (splits.PurgedWalkForward(3, 20, 10, 0, 0.0), 80)],
)
def test_purged_counts_equal_sets(spark, splitter, n):
    splitter.check(n)
    series = spark.range(n).selectExpr("'a' as s", "id as idx")
    got = {r.fold: r for r in splitter.split_detailed(series, "idx", ["s"], n).collect()}
    tests = splitter.tests(n)
    assert len(got) == len(tests) == splitter.get_n_splits(n)
    for k, ((lo, hi), runs) in enumerate(tests):
        test, near, after = sets(n, runs, splitter.purge_gap, splitter.embargo_pct)
        train = set(range(lo, hi)) - test
        assert (got[k].n_test, got[k].n_train, got[k].n_embargoed, got[k].n_purged) == (len(test), len(train - near - after), len(train & after), len((train & near) - after))


def test_combinations_and_errors():
    assert len(splits.CombinatorialPurgedCV(6, 2).tests(60)) == 15
    with pytest.raises(ValueError):
        splits.PurgedKFold(2, 50).check(20)
    with pytest.raises(ValueError):
        splits.WalkForwardCV(5, 3).bounds(4)
    with pytest.raises(ValueError):
        splits.WalkForwardCV(window_type="sliding")
    assert splits.WalkForwardCV(5).get_n_splits() == 5 and splits.WalkForwardCV(5, 3).get_n_splits(3, strict=False) == 0
    assert splits.estimate_purge_gap(5, 1.5) == 8


@pytest.mark.parametrize("cv", [splits.WalkForwardCV(4, 2, test_size=3), splits.TimeSeriesCrossValidator(4, 1), splits.BlockedTimeSeriesCV(3, 4), splits.CrossFitCV(4, 1)])
def test_contract(spark, cv):
    splits.check_temporal_splitter(cv, spark)
    assert cv.get_split_info(spark, 60).where("gap < 0").count() == 0
    parts = {(r.fold, r.part): (r.start, r.stop) for r in display.cv_folds(spark, cv, 60).collect()}
    assert all(parts[k, "train"][1] <= parts[k, "test"][0] for k in range(len(cv.bounds(60))))


def test_growing_sliding_window():
    cv = splits.TimeSeriesCrossValidator(3, 0, 0, 10, False, 20)
    assert [hi - lo for lo, hi, _, _ in cv.bounds(100)] == [20, 30, 40]


def test_assign_and_overlap(spark):
    series = spark.createDataFrame([(s, i) for s, n in (("a", 30), ("b", 40), ("c", 3)) for i in range(n)], "s string, i long")
    cv = splits.WalkForwardCV(3, 1, test_size=2)
    rows = splits.assign(series, cv.by_length(series, ["s"]), "i", ["s"]).collect()
    for s, n in (("a", 30), ("b", 40)):
        for k, (lo, hi, a, z) in enumerate(cv.bounds(n)):
            assert {r.i for r in rows if (r.s, r.fold, r.role) == (s, k, "train")} == set(range(lo, hi))
            assert {r.i for r in rows if (r.s, r.fold, r.role) == (s, k, "test")} == set(range(a, z))
    assert not [r for r in rows if r.s == "c"]
    pairs = {(r.s, r.i, r.j) for r in splits.compute_label_overlap(series, "i", ["s"], 4).collect()}
    assert pairs == {(s, i, j) for s, n in (("a", 30), ("b", 40), ("c", 3)) for i in range(n) for j in range(i, min(i + 4, n))}
