from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from foldwise.llm import langid

WORDS = {"aa": ["bela", "mora", "tina", "losa", "ka"], "bb": ["xurk", "grut", "zwist", "prok", "ug"], "cc": ["éäü", "çöñ", "ßñé", "üüö", "ñé"]}


def sample(seed: int, n: int):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 40))), lang))
    return rows


def test_held_out_accuracy_and_rejection():
    rows = sample(1, 400)
    model = langid.fit([t for _, t, _ in rows], [v for *_, v in rows])
    test = sample(2, 200)
    p, letters = langid.probabilities(model, [t for _, t, _ in test])
    assert letters.all()
    assert np.mean([model.labels[k] == v for k, (*_, v) in zip(p.argmax(axis=1), test, strict=True)]) > 0.99
    assert (p.max(axis=1) >= model.threshold).mean() > 0.98
    assert 0 <= model.threshold <= 0.5


def test_segments_do_not_change_the_score(monkeypatch):
    rows = sample(3, 60)
    model = langid.fit([t for _, t, _ in rows], [v for *_, v in rows])
    texts = [t * 5 for _, t, _ in sample(4, 10)] + ["", "12 !"]
    whole = langid.probabilities(model, texts)
    monkeypatch.setattr(langid, "SEGMENT", 17)
    parts = langid.probabilities(model, texts)
    assert np.allclose(whole[0], parts[0], atol=1e-6) and (whole[1] == parts[1]).all()


def test_on_spark(spark):
    rows = sample(5, 300) + [(1000, None, "aa"), (1001, "12 34 !", None), (1002, "", "bb"), (None, "bela mora tina", None), (5, "mora bela mora", "aa")]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, lang string, score double")
    out = langid.identify(docs)
    assert [f.name for f in out.schema] == ["doc_id", "lang_pred", "score", "rejected"]
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (1000, 1001, 1002))
    assert by[None].lang_pred == "aa"
    held = [(v, by[i].lang_pred) for i, _, v in sample(5, 300) if zlib.crc32(str(i).encode()) % 4 == 2 and i != 5]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert {r[0] for r in docs.select(langid.fold("doc_id") == 2).where("doc_id = 7").collect()} == {zlib.crc32(b"7") % 4 == 2}
    kept = langid.keep_identified(docs)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} >= set(range(300)) and not {1000, 1001, 1002} & {r.doc_id for r in kept.collect()}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.identify(docs).collect()] == [(1, "und", 0.0, True)]
    assert langid.identify(docs.limit(0)).count() == 0
    assert langid.keep_identified(docs.limit(0)).count() == 0


def test_marks_are_no_letters(spark):
    rows = sample(5, 100) + [(1000, "\u0301\u0308", None), (1001, "\u0301 1 a", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (got[1000].lang_pred, got[1000].score) == ("und", 0.0) and got[1001].lang_pred != "und"


def test_equals_a_plain_softmax():
    """Averages, softmax and temperature, subword by subword in Python."""
    rows = sample(6, 80)
    model = langid.fit([t for _, t, _ in rows], [v for *_, v in rows])

    def bucket(word: str) -> int:
        h = len(word) * 0x85EBCA6B & 0xFFFFFFFF
        for c in word:
            m = ord(c) * 0x9E3779B1 & 0xFFFFFFFF
            h = (h * 0x01000193 + (m ^ m >> 15)) & 0xFFFFFFFF
        return (h ^ h >> 16) & langid.BUCKETS - 1

    texts = [t for _, t, _ in sample(7, 12)] + ["Mora  x1y, ÉÄÜ", "a"]
    p, _ = langid.probabilities(model, texts)
    for text, got in zip(texts, p, strict=True):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        found = [bucket(w[i : i + n]) for w in (f" {x} " for x in words) for n in langid.ORDERS for i in range(len(w) - n + 1)]
        z = [(math.fsum(float(model.table[h, k]) for h in found) / len(found) + float(model.bias[k])) / model.temperature for k in range(len(model.labels))]
        e = [math.exp(x - max(z)) for x in z]
        assert np.allclose(got, [x / sum(e) for x in e], atol=1e-5)


def test_whole_texts_are_learned_from(monkeypatch):
    text = "bela mora " * 50 + "xurk"
    whole = langid.bag(text)
    monkeypatch.setattr(langid, "SEGMENT", 13)
    parts = langid.bag(text)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])
    assert set(langid.bag("xurk")[0]) <= set(whole[0])


def test_junk_is_rejected():
    rows = sample(8, 600)
    model = langid.fit([t for _, t, _ in rows], [v for *_, v in rows])
    rng = random.Random(1)
    junk = ["".join(rng.choice("ጀክምላሙ漢字仮名дйжщ") for _ in range(60)) + " " for _ in range(50)]
    p, _ = langid.probabilities(model, junk)
    clean, _ = langid.probabilities(model, [t for _, t, _ in sample(9, 200)])
    assert (clean.max(axis=1) >= model.threshold).mean() > 0.98
    assert np.median(p.max(axis=1)) < np.median(clean.max(axis=1))


@pytest.mark.parametrize("text", ["é" * 10, "日本語", "a"])
def test_letters_of_any_script(text):
    assert langid._sums([text], np.zeros((langid.BUCKETS + 1, 2), np.float32))[2][0] == len(text)
