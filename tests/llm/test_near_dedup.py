from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from foldwise.llm import near_dedup, shingles
from foldwise.llm.graph import components


def word_sets(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def brute(rows, n, percent=80):
    ids, sets = [i for i, _ in rows], word_sets([t for _, t in rows], n)
    parent = list(range(len(ids)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    parent[find(a)] = find(b)
    low: dict[int, int] = {}
    for k, i in enumerate(ids):
        low[find(k)] = min(low.get(find(k), i), i)
    return {i: (len(sets[k]), low[find(k)]) for k, i in enumerate(ids)}


def corpus(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    base = [[r.choice(vocab) for _ in range(r.randrange(30, 200))] for _ in range(n // 8)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 2, 4, 8, 12))):
            w[r.randrange(len(w))] = r.choice(vocab).upper()
        out.append(r.choice((" ", "\n", "\t ")).join(w))
    return out


@pytest.mark.parametrize("words", [2, 5])
def test_equals_brute_force(spark, words):
    texts = [*corpus(words, 240), None, "", " \n\t ", "one", "ONE", "two words", "\x0bone\x0c", "é È", "É È", "x" * 5000]
    rows = list(enumerate(texts, start=10))
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in rows] + [(None, "one", "k", 0), (*rows[0], "k", 0)], "doc_id long, text string, key string, n int").repartition(5)
    got = [x for x in near_dedup.near_groups(docs, words).collect() if x.doc_id is not None]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, words) and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dedup.drop_near_copies(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), words)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_a_large_group_around_one_text(spark, monkeypatch):
    r = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(r.choice((3, 5, 8, 10, 14))):
            w[r.randrange(len(w))] = f"u{r.randrange(10**9)}"
        rows.append((1000 - i, " ".join(w)))
    w = list(base)
    w[:12] = [f"s{i}" for i in range(12)]
    rows += [(2000, " ".join(w)), (2001, " ".join(w + ["tail"])), (2002, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_groups(docs, 2).collect()}
    assert got == brute(rows, 2)
    monkeypatch.setattr(near_dedup, "SMALL", 0)
    for large, block, slab in ((3, 20, 50), (10**6, 256, 1000)):
        monkeypatch.setattr(near_dedup, "LARGE", large)
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "SLAB", slab)
        monkeypatch.setattr(near_dedup, "WIDE", block + 7)
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_groups(docs, 2).collect()} == got


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_groups(docs).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (7, 7)] + [(200 + r.randrange(40), 200 + r.randrange(40)) for _ in range(25)]
    parent: dict[int, int] = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()
    assert {x.id: x.component for x in got} == {i: find(i) for i in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [8, 64, 1 << 20])
def test_word_hashes_do_not_depend_on_the_batch(monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    texts = [*corpus(3, 20), "", None, "a  b\tc\x0bd", "Aa aA", "x" * 300, "é é"]
    arr = pa.array(texts)
    flat = [w for lists in shingles.word_lists(arr) for w in lists]
    one = [w for t in texts for lists in shingles.word_lists(pa.array([t])) for w in lists]
    assert len(flat) == len(texts) and all((a == b).all() for a, b in zip(flat, one, strict=True))
    for n in (1, 2, 5):
        assert [len(shingles.shingle_set(w, n)) for w in flat] == [len(s) for s in word_sets(texts, n)]
    assert flat[-3][0] == flat[-3][1]
    part = [w for lists in shingles.word_lists(arr.slice(3, 4)) for w in lists]
    assert all((a == b).all() for a, b in zip(part, flat[3:7], strict=True))


def test_long_words():
    word = np.frombuffer(b"abc" * 1000, np.uint8)
    text = np.concatenate([word, np.frombuffer(b" short", np.uint8)])
    h, _ = shingles.word_hashes(text, np.array([0, len(text)]))
    alone, _ = shingles.word_hashes(np.frombuffer(b"short", np.uint8), np.array([0, 5]))
    assert h[0] == shingles.word_hashes(word, np.array([0, len(word)]))[0][0] and h[1] == alone[0]
    # beside a word beyond TOP, short words are hashed one by one
    huge = np.concatenate([np.full(shingles.TOP, 97, np.uint8), np.frombuffer(b" short", np.uint8)])
    assert shingles.word_hashes(huge, np.array([0, len(huge)]))[0][1] == alone[0]
    # strings on which every polynomial modulo 2**64 agrees
    one = b"a"
    for _ in range(11):
        one += bytes(195 - c for c in one)
    pair = [np.frombuffer(x, np.uint8) for x in (one, bytes(195 - c for c in one))]
    assert len({int(shingles.word_hashes(w, np.array([0, len(w)]))[0][0]) for w in pair}) == 2


def _dispersed(n: int) -> list[tuple[int, str]]:
    r = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(1, 6)):
            w[r.randrange(len(w))] = f"u{r.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    return rows


def test_links_grow_with_a_group_and_not_with_its_square(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 100)
    monkeypatch.setattr(near_dedup, "WIDE", 150)
    made = []
    real = near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda edges: made.append(edges.count()) or real(edges))
    most = []
    for n in (300, 600):
        rows = _dispersed(n)
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
        assert got == brute(rows, 2)
        most.append(made[-1])
        made.clear()
    assert most[1] <= 2.5 * most[0], most


def test_members_tie_every_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "GATHER", 7)
    monkeypatch.setattr(near_dedup, "SMALL_ROWS", 11)
    r = np.random.default_rng(3)
    mh = r.integers(0, 2, (60, 40)).astype(np.uint16)
    reps = spark.createDataFrame([(int(i), m.tobytes()) for i, m in enumerate(mh)], "id long, mh binary").repartition(3)
    got = near_dedup.members(reps).collect()
    keys = near_dedup.table_keys(mh)
    want: dict[int, set] = {}
    for i, row in enumerate(keys.tolist()):
        for k in row:
            want.setdefault(k, set()).add(i)
    want = {k: v for k, v in want.items() if len(v) > 1}
    assert len({(x.key, x.id) for x in got}) == len(got)
    found: dict[int, dict] = {}
    for x in got:
        found.setdefault(x.key, {})[x.id] = x.first
    assert {k: set(v) for k, v in found.items()} == want
    for ties in found.values():
        # every member leads to one head
        heads = set()
        for i in ties:
            while ties[i] != i:
                i = ties[i]
            heads.add(i)
        assert len(heads) == 1


def test_rows_of_one_document_and_rows_without_id(spark):
    a, b, c = ("one two three four five six", "red green blue black white", "up down left right in out")
    rows = [(5, a), (3, a), (5, b), (9, b), (8, c), (8, c), (None, a), (None, None), (7, None)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got if x.doc_id is not None) == [(3, 5, 3, True), (5, 5, 3, False), (7, 0, 7, True), (8, 5, 8, True), (9, 4, 3, False)]
    assert sorted((x.n_shingles, x.component_id, x.kept) for x in got if x.doc_id is None) == [(0, None, True), (5, None, True)]


def test_components_by_joins(spark, monkeypatch):
    from foldwise.llm import graph

    monkeypatch.setattr(graph, "SMALL", 0)
    test_components(spark)


def test_guessed_sizes_stay_small_over_rounds_of_joins(spark, monkeypatch):
    from foldwise.llm import graph

    def guess(df):
        return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()

    monkeypatch.setattr(graph, "SMALL", 0)
    labels = components(spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long"))
    assert {(x.id, x.component) for x in labels.collect()} == {(i, 0) for i in range(21)}
    assert guess(labels) <= 64
    monkeypatch.setattr(near_dedup, "SMALL", 0)
    monkeypatch.setattr(near_dedup, "LARGE", 3)
    rows = _dispersed(60)
    found = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found.collect()} == brute(rows, 2)
    assert guess(found) <= 400
