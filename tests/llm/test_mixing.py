from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from foldwise.llm import mixing


def corpus(seed: int, n: int):
    r = random.Random(seed)
    return [(i, r.choice([None, "a", "a", "a", "a", "b", "b", "c", "d"]), " ".join(["w"] * r.randrange(0, 40))) for i in range(n)]


def brute(rows, lift, most, budget=None, seed="mix"):
    n = [len(t.split()) if t else 0 for *_, t in rows]
    tokens = Counter()
    for (_, s, _), k in zip(rows, n, strict=True):
        tokens[s or ""] += k
    tokens = {s: k for s, k in tokens.items() if k}
    total = sum(tokens.values())
    budget = total if budget is None else budget
    p = {s: k / total for s, k in tokens.items()}

    def weights(a):
        z = sum(x**a for x in p.values())
        return {s: x**a / z for s, x in p.items()}

    entropy = lambda a: -sum(w * math.log(w) for w in weights(a).values())
    repeats = lambda a: max(weights(a)[s] * budget / tokens[s] for s in tokens)
    goal = entropy(1) + lift * (math.log(len(p)) - entropy(1))

    def least(bad):
        lo, hi = 0.0, 1.0
        for _ in range(50):
            lo, hi = ((lo + hi) / 2, hi) if bad((lo + hi) / 2) else (lo, (lo + hi) / 2)
        return (lo + hi) / 2

    a = least(lambda x: entropy(x) > goal + 1e-13)
    if repeats(a) > most:
        a = max(a, least(lambda x: repeats(x) > most))
    out = []
    for s, w in weights(a).items():
        quota = round(w * budget)
        own = [(i, k) for (i, src, _), k in zip(rows, n, strict=True) if (src or "") == s]
        epochs, rest = divmod(quota, tokens[s])
        out += [(i, e) for i, _ in own for e in range(epochs)]
        by_key = defaultdict(list)
        for i, k in own:
            by_key[hashlib.md5(f"{seed}:{epochs}:{i}".encode()).hexdigest()].append((i, k))
        used = 0
        for _, group in sorted(by_key.items()) if rest else []:
            used += sum(k for _, k in group)
            if used > rest:
                break
            out += [(i, epochs) for i, _ in group]
    return Counter(out)


@pytest.mark.parametrize(("lift", "most", "budget"), [(0.5, 4.0, None), (1.0, 1.3, None), (0.0, 4.0, 700), (0.8, 9.0, 50_000)])
def test_equals_brute_force(spark, lift, most, budget):
    rows = [*corpus(3, 500), (900, "empty", ""), (901, "empty", None), (902, "a", "w " * 5000), (7, "b", "w w w"), (7, "b", "w w w"), (None, "c", "w")]
    docs = spark.createDataFrame([(i, s, t, 1, "k") for i, s, t in rows], "doc_id long, source string, text string, epoch int, key string").repartition(4)
    out = mixing.mix(docs, budget=budget, lift=lift, max_repeats=most)
    assert out.columns == ["doc_id", "source", "text", "key", "epoch", "order_key"]
    got = Counter((r.doc_id, r.epoch) for r in out.collect())
    want = brute([r for r in rows if r[0] is not None], lift, most, budget)
    # the row without an id weighs in, under the key of an empty place
    assert sum((got - want).values()) + sum((want - got).values()) <= 12 and {k for k in got if k[0] is not None}


def test_equals_brute_force_on_ids_alone(spark, monkeypatch):
    rows = corpus(5, 400)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = brute(rows, 0.5, 4.0)
    assert Counter((r.doc_id, r.epoch) for r in mixing.mix(docs).collect()) == want
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert Counter((r.doc_id, r.epoch) for r in mixing.mix(docs).collect()) == want


def test_blocks_are_permutations(spark):
    docs = spark.createDataFrame(corpus(6, 300), "doc_id long, source string, text string")
    rows = mixing.mix(docs, budget=20_000, max_repeats=50).collect()
    blocks = defaultdict(list)
    for r in rows:
        blocks[r.source, r.epoch].append(r.order_key)
    assert all(len(set(b)) == len(b) for b in blocks.values())
    full = {s: len(b) for (s, e), b in blocks.items() if e == 0}
    assert all(len(b) <= full[s] for (s, _), b in blocks.items())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(docs).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "a", ""), (2, "b", None)], docs.schema)).count() == 0
    one = mixing.mix(spark.createDataFrame([(1, "a", "x y"), (2, "a", "z")], docs.schema)).collect()
    assert sorted(r.doc_id for r in one) == [1, 2]
    assert "Python" not in mixing.mix(docs)._jdf.queryExecution().toString()
