from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foldwise.operators import conformal
from foldwise.streaming import online

START = datetime(2024, 1, 1, tzinfo=UTC)


@pytest.fixture
def folder(spark, tmp_path):
    r = random.Random(5)
    rows = [(k, START + timedelta(minutes=10 * i), i, abs(r.gauss(0, 1 + k))) for i in range(60) for k in (1, 2)]
    for b in range(4):
        part = [x for x in rows if b * 15 <= x[2] < (b + 1) * 15]
        r.shuffle(part)  # any order within the watermark
        spark.createDataFrame(part, "k long, ts timestamp, id long, e double").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{b}"))
    late = [(k, START + timedelta(days=d), 1000 + d, 0.0) for d in (30, 60) for k in (1, 2)]
    for n, x in enumerate((late[:2], late[2:])):
        spark.createDataFrame(x, "k long, ts timestamp, id long, e double").coalesce(1).write.parquet(str(tmp_path / "in" / f"z{n}"))
    return tmp_path


def streamed(spark, folder, make):
    stream = spark.readStream.schema("k long, ts timestamp, id long, e double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder / "in"))
    out = online.online_intervals(stream, "k", "ts", "id", "e", make, "6 hours")
    q = out.writeStream.format("parquet").option("checkpointLocation", str(folder / "check")).option("path", str(folder / "out")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return {(r.k, r.id): (r.error, r.q, r.next_q) for r in spark.read.parquet(str(folder / "out")).collect() if r.id < 1000}


def test_adaptive_stream_equals_batch(spark, folder):
    got = streamed(spark, folder, lambda: online.Adaptive(2.0, 0.1, 0.5))
    rows = spark.read.option("recursiveFileLookup", True).parquet(str(folder / "in")).where("id < 1000")
    want = {(r.k, r.id): (r.error, r.q, r.next_q) for r in conformal.adaptive_conformal(rows, F.col("e"), ["k"], ["id"], 2.0, 0.1, 0.5).collect()}
    assert len(got) == 120 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_bellman_stream_equals_batch(spark, folder):
    got = streamed(spark, folder, lambda: online.OnlineBellman(30, alpha=0.1))
    rows = spark.read.option("recursiveFileLookup", True).parquet(str(folder / "in")).where("id < 1000")
    want = {(r.k, r.id): (r.error, r.q, r.next_q) for r in conformal.bellman_conformal(rows, "e", ["k"], ["id"], 30, alpha=0.1).collect()}
    assert len(got) == 60 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
