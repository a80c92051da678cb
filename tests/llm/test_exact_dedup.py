from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from foldwise.llm import exact_dedup


def brute(rows):
    """Per row: (doc_id, keep_id, group_size, sha), and the number of kept rows of each text."""
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, top[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), groups, top


def sample() -> list[tuple[int | None, str | None]]:
    r = random.Random(2)
    texts = ["", "a", "b", "ab" * 200, "ab" * 199 + "ac", "x" * 300_000, "x" * 299_999 + "y", "é", "È", " a", "A"]
    rows: list[tuple[int | None, str | None]] = [(i, r.choice(texts)) for i in range(120)]
    # repeated rows, one doc_id with two texts, no doc_id, no text, alone
    rows += [(5, "twice"), (5, "twice"), (5, "other"), (4, "other"), (None, "a"), (None, "nameless"), (None, "nameless"), (None, None), (500, None), (501, "alone"), (None, "alone too")]
    return rows


@pytest.mark.parametrize("small", [exact_dedup.SMALL, 0])
@pytest.mark.parametrize("digests", [True, False])
def test_equals_brute_force(spark, monkeypatch, small, digests):
    monkeypatch.setattr(exact_dedup, "SMALL", small)
    rows = sample()
    want, groups, top = brute(rows)
    docs = spark.createDataFrame([(i, t, 1, "h", "s") for i, t in rows], "doc_id long, text string, n int, h string, s string").repartition(5)
    got = exact_dedup.exact_dedup(docs, digests=digests).collect()
    sha = lambda r: r.text_sha256 if digests or r.text_sha256 else None
    if digests:
        assert Counter((r.doc_id, r.keep_id, r.group_size, sha(r)) for r in got) == want
    else:
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter({}) + sum((Counter({k[:3]: c}) for k, c in want.items()), Counter())
        assert all(r.text_sha256 for r in got if r.group_size > 1) and not all(r.text_sha256 for r in got)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    stay = exact_dedup.drop_copies(docs)
    assert stay.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in stay.collect()) == Counter((top[t], t) for t in groups)


def test_long_copies_that_share_length_and_prefix_are_told_apart(spark):
    a, b = "p" * 5000 + "1", "p" * 5000 + "2"
    got = exact_dedup.exact_dedup(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_dedup(docs).count() == 0 and exact_dedup.drop_copies(docs).count() == 0


def test_a_hot_length_is_partly_aggregated_before_it_moves(spark):
    plan = exact_dedup._alive(spark.range(10).selectExpr("id as doc_id", "'t' as text"), 8)
    assert plan.count() == 1
