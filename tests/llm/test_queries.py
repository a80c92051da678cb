"""The registered queries over the smallest tables: SQL where there is some, else independent ways of working the columns out."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from foldwise.llm import queries, training_order

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, db, name):
    want = db.sql(queries.ORACLES[name])
    names = sorted(want.columns)
    got = queries.QUERIES[name](spark, str(SF))
    assert sorted(got.columns) == names
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(want.select(*[f'"{n}"' for n in names]).fetchall())


def documents(db):
    return db.sql("select doc_id, text, lang from documents order by doc_id").fetchall()


def test_op9_equals_the_library(spark, db):
    import tiktoken
    from foldwise.llm.bpe import _ranks

    path, pattern = queries.rank_file()
    enc = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in queries.op9_bpe(spark, str(SF)).collect()}
    docs = documents(db)
    assert len(got) == len(docs)
    for i, text, _ in docs:
        ids = enc.encode_ordinary(text or "")
        r = got[i]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_op3_holds_out_by_checksum_and_knows_the_languages(spark, db):
    got = {r.doc_id: r for r in queries.op3_langid(spark, str(SF)).collect()}
    docs = documents(db)
    assert len(got) == len(docs)
    right = Counter()
    for i, text, lang in docs:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        if r.held_out and lang is not None and r.lang_pred != "und":
            right[r.lang_pred == lang] += 1
    assert right[True] / sum(right.values()) > 0.9


def test_op2_gives_every_sequence_a_slot(spark, db):
    got = queries.op2_training_order(spark, str(SF)).collect()
    want = Counter()
    for i, text, _ in documents(db):
        data = (text or "").encode() + b"\xff"
        for k in range(0, len(data), training_order.LENGTH):
            part = data[k : k + training_order.LENGTH]
            want[i, k // training_order.LENGTH, len(part), hashlib.sha256(part).hexdigest()] += 1
    assert Counter((r.doc_id, r.seq_no, r.n_tokens, r.ids_sha256) for r in got) == want
    assert sorted(r.slot for r in got) == list(range(len(got)))
    stride = training_order.HEAD.itemsize + training_order.LENGTH + 1
    assert all(r.shard == r.slot // training_order.SHARD_ROWS and r.byte_offset == r.slot % training_order.SHARD_ROWS * stride for r in got)


def test_op4_equals_brute_force(spark, db):
    from tests.llm.test_near_dedup import brute

    rows = [(i, t) for i, t, _ in documents(db)]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_near_dedup(spark, str(SF)).collect()} == brute(rows, 2)


def test_op10_gives_two_records_a_page(spark, db):
    got = queries.op10_warc(spark, str(SF)).collect()
    pages = dict(db.sql("select page_id, html from pages").fetchall())
    assert Counter((r.page_id, r.warc_type) for r in got) == Counter((i, k) for i in pages for k in ("metadata", "conversion"))
    for r in got:
        payload = (pages[r.page_id] or "").encode()
        assert r.source_payload_digest.endswith(__import__("base64").b32encode(hashlib.sha1(payload).digest()).decode())
        assert r.content_length == len(r.content.encode())
    assert np.mean([bool(r.content) for r in got if r.warc_type == "conversion"]) > 0.9


def test_op1_spans_hold_their_base(spark, db):
    got = queries.op1_pii(spark, str(SF)).collect()
    assert len(got) == len(documents(db)) and sum(r.n_spans for r in got) >= 1
    assert all(r.n_spans >= r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_secret for r in got)
