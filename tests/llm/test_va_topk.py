from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import va_topk


def brute(rows, k):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for q, a in good:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))
            out.update((q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1))
    return out


@pytest.mark.parametrize(("n", "spread"), [(300, 1.0), (300, 60.0), (200, 0.02), (15, 1.0), (120, 2e5)])
def test_equals_brute_force(spark, n, spread):
    r = random.Random(n)
    # float32 values; many ties where the spread is small, wide cells where it is large
    rows = [(i, [float(np.float32(r.gauss(0, spread))) for _ in range(8)]) for i in range(n)]
    rows += [(400, None), (420, []), (421, []), (440, [None] * 8), (460, [float("nan")] + [0.0] * 7), (480, [float("inf")] * 8), (None, [1.0] * 8), (501, [0.5] * 4), (500, [0.1] * 4), (7, rows[7][1])]
    # repeated query rows, and a query id with two vectors
    rows += [rows[0], (0, [0.25] * 8)]
    df = spark.createDataFrame([(*x, "s", 1) for x in rows], "vec_id long, embedding array<float>, score string, row int").repartition(3)
    got = va_topk.top_k(df, F.col("vec_id") % 20 == 0, 20, query_block=4, block=64).collect()
    assert [f for f in got[0].asDict()] == ["query_id", "rank", "vec_id", "score"]
    assert Counter(tuple(x) for x in got) == brute(rows, 20)


def test_a_very_common_vector_costs_a_query_few_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(400)] + [(400 + i, [float(i % 7), 1.0]) for i in range(100)] + [(0, [1.0, 2.0])] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    exact = df.selectExpr("monotonically_increasing_id() as row", "vec_id", "2 as dim", "transform(embedding, x -> cast(64 * x as long)) as v")
    grid, some = va_topk._grid(exact), va_topk.rivals(exact, 5)
    assert some.count() <= 8 * 10
    found = va_topk.candidates(exact.where("vec_id % 20 = 0"), va_topk.approximation(some, grid), grid, 5, 8, 128)
    assert max(r["count"] for r in found.groupBy("of").count().collect()) <= 20
    got = va_topk.top_k(df, F.col("vec_id") % 20 == 0, 5, query_block=8, block=128).collect()
    assert Counter(tuple(x) for x in got) == brute(rows, 5)


def test_few_exact_vectors_are_read(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 100) for _ in range(16)]) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    read, real = [], va_topk.read_exact
    monkeypatch.setattr(va_topk, "read_exact", lambda pairs, *a: read.append(pairs.count()) or real(pairs, *a))
    got = va_topk.top_k(df, F.col("vec_id") % 20 == 0, 10, block=256).collect()
    assert Counter(tuple(x) for x in got) == brute(rows, 10)
    assert sum(read) <= 50 * 20 < 50 * 999


def test_bounds_hold():
    v = np.random.default_rng(1).integers(-20000, 20000, (500, 16))
    low, high = v.min(axis=0), v.max(axis=0)
    cells = va_topk.quantise(v, low, high)
    lower, upper = va_topk.bounds(v[:50], cells, low, high)
    exact = v[:50] @ v.T
    assert (lower <= exact).all() and (exact <= upper).all() and (upper - lower).max() > 0
    assert (va_topk.quantise(np.full((3, 4), 7), np.full(4, 7), np.full(4, 7)) == 0).all()


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert va_topk.top_k(df, F.col("vec_id") % 20 == 0).count() == 0
