from __future__ import annotations

import random
from collections import defaultdict

import pytest

from foldwise.llm import line_dedup


def brute(rows, min_sites):
    sites = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n") if t is not None else []:
            if line.strip(" "):
                sites[line].add(s)
    plate = {x for x, s in sites.items() if len(s - {None}) >= min_sites}
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        parts = t.split("\n")
        kept = [x for x in parts if x not in plate]
        out.append((i, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=str)


def corpus(seed: int, n: int):
    r = random.Random(seed)
    common = [f"common line {k}" for k in range(40)] + ["", "  ", "é\t|", "x"]
    rows = []
    for i in range(n):
        lines = [r.choice(common[: r.randrange(1, len(common))]) if r.random() < 0.3 else f"own {i} {k} " + "word " * r.randrange(12) for k in range(r.randrange(1, 9))]
        rows.append((i, "\n".join(lines), r.choice([None, *[f"s{k}" for k in range(r.choice((2, 14, 30)))]])))
    return rows


@pytest.mark.parametrize("min_sites", [10, 1, 2, 25])
def test_equals_brute_force(spark, min_sites):
    rows = [*corpus(min_sites, 300), (1000, None, "s1"), (1001, "", "s2"), (1002, "\n\n", None), (1003, "long " * 20_000 + "\ncommon line 0", "s3"), (None, "common line 1\nown", "s4")]
    # a repeated row, and one doc_id with two texts
    rows += [rows[0], (1, "own text\ncommon line 0\n\ncommon line 0", "s5")]
    docs = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, source string, n_removed int, h string").repartition(5)
    out = line_dedup.remove_boilerplate(docs, min_sites=min_sites)
    assert out.columns == ["doc_id", "source", "h", "text", "n_lines", "n_removed"]
    want = brute(rows, min_sites)
    assert sorted([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()], key=str) == sorted(want, key=str)


def test_shuffle_joins_give_the_same(spark, monkeypatch):
    rows = corpus(7, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(line_dedup, "SMALL", -1)
    got = sorted([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.remove_boilerplate(docs).collect()], key=str)
    assert got == brute(rows, 10)


def test_a_document_of_nothing_else_and_one_of_very_many_lines(spark):
    plate = "\n".join(["a license line", "another one"])
    rows = [(i, plate, f"s{i}") for i in range(12)] + [(50, "\n".join(["a license line", f"x{0}"] * 100_000), "s1")]
    got = {r.doc_id: r for r in line_dedup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all((got[i].text, got[i].n_lines, got[i].n_removed) == ("", 2, 2) for i in range(12))
    assert (got[50].text, got[50].n_lines, got[50].n_removed) == ("\n".join(["x0"] * 100_000), 200_000, 100_000)


def test_plan_is_native_and_empty_tables_work(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    out = line_dedup.remove_boilerplate(docs)
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
