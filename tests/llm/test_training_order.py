from __future__ import annotations

from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from foldwise.llm import training_order as to


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    y = to.permute(np.arange(n), n)
    assert sorted(y.tolist()) == list(range(n))
    assert (to.unpermute(y, n) == np.arange(n)).all()
    if n > 100:
        assert (to.permute(np.arange(n), n, key=1) != y).any() and abs(np.corrcoef(np.arange(n), y)[0, 1]) < 0.15


def want(rows, length):
    out = Counter()
    for i, t in rows:
        if i is not None:
            data = (t or "").encode() + b"\xff"
            for k in range(0, len(data), length):
                out[i, k // length, data[k : k + length]] += 1
    return out


@pytest.mark.parametrize(("length", "shard_rows"), [(8, 16), (64, 1000), (5, 7)])
def test_shards_hold_every_sequence_at_its_slot(spark, tmp_path, length, shard_rows):
    rows = [(i, "é" * (i % 23) + f" text {i}\n" * (i % 5)) for i in range(80)] + [(100, None), (101, ""), (102, "x" * 5000), (None, "gone"), (3, "é" * 3 + " text 3\n" * 3), (3, "another text"), (4, ""), (102, "x" * 5000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, slot string").repartition(5)
    path = str(tmp_path / "out")
    layout = to.materialise(to.byte_tokens(docs), path, length=length, shard_rows=shard_rows)
    seqs = want(rows, length)
    assert layout.n == sum(seqs.values()) and layout == to.read_layout(spark, path)
    # read as plain files: shard and place follow from the slot
    raw = {}
    for f in Path(path, "data").glob("shard=*/part-*"):
        shard, data = int(f.parent.name[6:]), f.read_bytes()
        assert len(data) % layout.stride == 0
        for k in range(0, len(data), layout.stride):
            head = np.frombuffer(data[k : k + to.HEAD.itemsize], to.HEAD)[0]
            raw[shard * shard_rows + k // layout.stride] = (int(head["doc_id"]), int(head["seq_no"]), data[k + to.HEAD.itemsize :][: int(head["n"])])
    assert sorted(raw) == list(range(layout.n))
    assert Counter(raw.values()) == seqs
    got = to.read(spark, path).collect()
    assert {r.slot: (r.doc_id, r.seq_no, bytes(r.ids)[: r.n_tokens]) for r in got} == raw
    # the same whatever the partitions, and numbered in runs that permute sends to the slots
    again = str(tmp_path / "again")
    to.materialise(to.byte_tokens(docs.coalesce(1)), again, length=length, shard_rows=shard_rows)
    assert {r.slot: (r.doc_id, r.seq_no) for r in to.read(spark, again).collect()} == {s: v[:2] for s, v in raw.items()}
    order = {int(to.unpermute(np.array([s]), layout.n)[0]): v[:2] for s, v in raw.items()}
    assert all(order[k + 1] == (order[k][0], order[k][1] + 1) or order[k + 1][1] == 0 for k in range(layout.n - 1))
    part = {r.slot for r in to.read(spark, path, first_slot=layout.n // 2).collect()}
    assert part == set(range(layout.n // 2, layout.n))


@pytest.mark.parametrize("small", [to.SMALL, 0])
def test_repeated_documents_and_few_tasks(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(to, "SMALL", small)
    monkeypatch.setattr(to, "MOST_TASKS", 3)
    rows = [(1, "a" * 40)] * 30 + [(1, "b" * 20)] + [(i, f"text {i}") for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    layout = to.materialise(to.byte_tokens(docs), str(tmp_path / "a"), length=16, shard_rows=8)
    got = to.read(spark, str(tmp_path / "a")).collect()
    assert Counter((r.doc_id, r.seq_no, bytes(r.ids)[: r.n_tokens]) for r in got) == want(rows, 16)
    assert layout.shard_rows == 8 and sorted(r.slot for r in got) == list(range(layout.n)) and all(r.shard == r.slot // 8 for r in got)
    assert len(list(Path(tmp_path, "a", "data").glob("shard=*/part-*"))) == layout.shards


def test_wide_ids_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, list(range(1000))), (2, []), (3, None), (4, [65535])], "doc_id long, ids array<int>")
    layout = to.materialise(to.packed(docs), str(tmp_path / "a"), length=300, width=2, pad=50256)
    got = {(r.doc_id, r.seq_no): np.frombuffer(r.ids, "<u2") for r in to.read(spark, str(tmp_path / "a")).collect()}
    assert layout.n == 5 and np.concatenate([got[1, k] for k in range(4)])[:1000].tolist() == list(range(1000)) and got[1, 3][-1] == 50256 and got[4, 0][0] == 65535
    empty = to.materialise(to.byte_tokens(spark.createDataFrame([], "doc_id long, text string")), str(tmp_path / "b"))
    assert empty.n == 0 and to.read(spark, str(tmp_path / "b")).count() == 0
