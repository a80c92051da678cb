from __future__ import annotations

import hashlib
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from foldwise.llm import bpe, langid, mixing  # noqa: E402
from foldwise.llm.queries import rank_file  # noqa: E402
from tests.llm import test_line_dedup, test_mixing, test_near_dedup  # noqa: E402

WORDS = {"aa": "bela mora tina losa kano rila".split(), "bb": "xurk grut zwist prok ugsh brek".split()}


@pytest.fixture
def sf_dir(spark, tmp_path):
    import random

    r = random.Random(8)
    rows, plate = [], [f"shared boilerplate {k} for all" for k in range(3)]
    for i in range(260):
        lang = r.choice(list(WORDS))
        lines = [" ".join(r.choice(WORDS[lang]) + str(r.choice(["", "s", "en"])) for _ in range(r.randrange(8, 25))) for _ in range(r.randrange(1, 6))]
        if r.random() < 0.4 and len(lines) > 1:
            lines.insert(r.randrange(len(lines)), r.choice(plate))
        if rows and r.random() < 0.2:
            lines = r.choice(rows)[1].split("\n") + r.choice(([], ["tail"]))
        rows.append((i, "\n".join(lines), lang, f"s{r.randrange(14)}"))
    rows += [(900, None, "aa", "s1"), (901, "", None, "s2"), (902, "12 34", None, None)]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_every_stage_equals_brute_force(spark, sf_dir, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "mixing", "bpe"]
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(x.doc_id, x.text, x.lang, x.source, x.n_chars) for x in docs.collect()]
        out = stage(spark, docs, sf_dir)
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        kept[name] = Counter(x.doc_id for x in after)
        if name == "language_id":
            model = langid.fit_bags(*langid.training_sample(spark.read.parquet(f"{sf_dir}/documents.parquet"), langid.fold() != 2))
            p, letters = langid.probabilities(model, [b[1] or "" for b in before])
            assert set(kept[name]) == {b[0] for b, q, ok in zip(before, p.max(axis=1), letters, strict=True) if ok and q >= model.threshold} and len(kept[name]) >= 255
        if name == "line_dedup":
            want = test_line_dedup.brute([(b[0], b[1], b[3]) for b in before], 10)
            assert sorted([(x.doc_id, x.text) for x in after]) == sorted([w[:2] for w in want]) and all(x.n_chars == len(x.text) for x in after)
            assert any(w[3] for w in want)
        if name == "near_dedup":
            want = test_near_dedup.brute([(b[0], b[1]) for b in before], 5)
            assert set(kept[name]) == {i for i, (_, c) in want.items() if i == c} and len(kept[name]) < len(before)
        if name == "mixing":
            want = test_mixing.brute([(b[0], b[3], b[1]) for b in before], mixing.LIFT, mixing.MAX_REPEATS)
            assert kept[name] == Counter([i for (i, _), k in want.items() for _ in range(k)])
        if name == "bpe":
            run = bpe.encoder(*rank_file()).encode_ordinary
            texts = Counter((b[0], tuple(run(b[1]))) for b in before)
            assert Counter((x.doc_id, tuple(x.ids)) for x in after) == texts and all(x.n_tokens == len(x.ids) for x in after)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(x.doc_id for x in whole) == kept["bpe"]


def test_documents_of_mostly_boilerplate_lose_it_too(spark):
    plate = [f"shared boilerplate {k} for all of the sites" for k in range(3)]
    rows = [(i, "\n".join([f"own text {i} " + "word " * 40, *plate]), f"s{i % 12}") for i in range(24)]
    rows += [(100, "\n".join([*plate, "short own line"]), "s1"), (101, "\n".join(plate), "s2")]
    docs = spark.createDataFrame([(*x[:2], "aa", x[2], len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in corpus_pipeline.drop_boilerplate(spark, docs, "").collect()}
    assert len(out) == len(rows) and not any(p in r.text for r in out.values() for p in plate)
    assert out[100].text == "short own line" and out[100].n_chars == 14 and (out[101].text, out[101].n_chars) == ("", 0)


def test_last_stage_decodes_to_the_text(spark):
    texts = ["plain words, 12 of them", "é\t| 多语 🙂\n\nend", ""]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    out = corpus_pipeline.encode(spark, docs, "").collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in out) == Counter((i, hashlib.sha256(texts[i].encode()).hexdigest()) for i in (0, 0, 1, 2))
