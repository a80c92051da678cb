from __future__ import annotations

import random

import numpy as np
import pytest

from foldwise.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    bits = ["the", " the", "'s", "'ll", "  ", "\n", "\n\n", " \n ", "é", "ß", "12", "...", "!!", " ", "日本", "🙂", "a" * 40, "\t", " x", "\x1c", "-"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 120))) for _ in range(n)]


@pytest.mark.parametrize(("size", "overlap"), [(1, 1), (7, 3), (16, 16), (50, 10), (64, 200)])
def test_chunked_encoding_equals_the_library(size, overlap):
    whole = bpe.encoder(PATH, PATTERN).encode_ordinary
    for text in ["", " ", "a" * 300, " " * 300 + "x", "\n" * 200 + "y", "x" * 60 + " " * 60 + "y", *texts(size, 150)]:
        assert bpe.encode_text(text, PATH, PATTERN, size, overlap).tolist() == whole(text), repr(text)


def test_encode_and_decode_on_spark(spark):
    rows = [(i, t) for i, t in enumerate(texts(1, 60))] + [(100, None), (101, ""), (None, "x" * 99), (3, "b c " * 50), (3, "b c " * 50), (4, "long " * 4000)]
    docs = spark.createDataFrame([(i, t, "clash", None) for i, t in rows], "doc_id long, text string, ids string, start string")
    coded = bpe.encode(docs, PATH, PATTERN, size=40, overlap=10)
    out = bpe.decode(coded, PATH).collect()
    whole = bpe.encoder(PATH, PATTERN).encode_ordinary
    key = lambda r: (str(r[0]), r[1])
    assert sorted([(r.doc_id, r.ids) for r in out], key=key) == sorted([(i, whole(t or "")) for i, t in rows], key=key)
    assert sorted([(str(r.doc_id), bytes(r.decoded)) for r in out]) == sorted([(str(i), (t or "").encode()) for i, t in rows])
    both = bpe.encode(docs, PATH, PATTERN, size=40, overlap=10, decoded=True)
    assert both.columns == ["doc_id", "ids", "decoded"] and sorted(map(tuple, both.collect()), key=key) == sorted([(r.doc_id, r.ids, r.decoded) for r in out], key=key)
    d = {(r.doc_id, r.n_tokens) for r in bpe.digests(coded, PATH).collect()}
    assert d == {(i, len(whole(t or ""))) for i, t in rows}


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).count() == 0


def test_boundaries_cover_the_text():
    for t in texts(5, 50):
        ends = bpe.boundaries(t, PATTERN)
        assert (np.diff(ends) > 0).all() and (not t or ends[-1] == len(t))


def test_ids_are_digested_where_they_are_made(spark, tmp_path):
    from foldwise.llm.queries import QUERIES

    docs = spark.createDataFrame([(1, "a b " * 50), (1, "a b " * 50), (2, None), (3, "x"), (None, "y " * 70)], "doc_id long, text string")
    apart = bpe.digests(bpe.encode(docs, PATH, PATTERN, size=40, overlap=10), PATH)
    same = bpe.encode(docs, PATH, PATTERN, size=40, overlap=10, digested=True)
    assert same.dtypes == apart.dtypes and sorted(map(str, same.collect())) == sorted(map(str, apart.collect()))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["op9_bpe"](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    # of short texts one, of long ones two before their chunks meet; none after
    assert plan.count("MapInArrow") == 3 and plan.count("FlatMapGroupsInArrow") == 1
