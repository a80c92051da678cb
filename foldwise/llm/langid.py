"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.shared import bounded_batches, only, slices

#: Lengths of the subwords, and the number of hash buckets they share.
ORDERS, BUCKETS, DIM = (2, 3, 4), 1 << 15, 16
#: Bounds of the training sample: labelled rows of a language (whole texts), and languages.
ROWS_PER_LANG, MOST_LANGS = 1000, 1000
#: The share of right answers on the calibration texts that rejection may cost at most; 200 texts are enough to tell.
FALSE_REJECTION = 0.005
#: Code points that are worked on at once.
SEGMENT = 1 << 17
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """A fitted classifier; scores are softmax((mean of table rows + bias) / temperature)."""

    labels: tuple[str, ...]
    table: np.ndarray  # BUCKETS + 1 rows, the last one zero
    bias: np.ndarray
    temperature: float
    threshold: float


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Code point -> itself if it is a letter or a mark, else a space; and whether it is a letter."""
    first = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), np.uint8)
    letter = first == ord("L")
    points = np.arange(0x110000, dtype=np.uint32)
    points[~letter & (first != ord("M"))] = 32
    return points, letter


def subwords(points: np.ndarray) -> list[np.ndarray]:
    """Per order and start, the bucket of the subword; BUCKETS where there is none.

    Subwords lie within one word with the space on either side of it.
    """
    out = []
    gap = points == 32
    mixed = points * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    for n in ORDERS:
        m = max(len(points) - n + 1, 0)
        h = np.full(m, n * 0x85EBCA6B & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) + mixed[k : k + m]
        h ^= h >> np.uint32(16)
        h &= np.uint32(BUCKETS - 1)
        bad = gap[:m] & gap[n - 1 : n - 1 + m]
        for k in range(1, n - 1):
            bad |= gap[k : k + m]
        h[bad] = BUCKETS
        out.append(h)
    return out


def _points(text: str) -> np.ndarray:
    return _classes()[0][np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]


def _sums(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: the sum of its subwords' table rows, their number, and the number of letters.

    Works on segments, so memory follows SEGMENT and not the length of a text.
    """
    total, count, letters = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts)), np.zeros(len(texts), np.int64)

    def add(owners: list[int], parts: list[np.ndarray], own: list[int]) -> None:
        points = np.concatenate(parts)
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)
        inside = np.concatenate([np.arange(len(p)) < k for p, k in zip(parts, own, strict=True)])
        np.add.at(letters, owners, np.add.reduceat(_classes()[1][points] & inside, starts, dtype=np.int64))
        for h in subwords(points):
            h = np.concatenate([h, np.full(len(points) - len(h), BUCKETS, np.uint32)])
            h[~inside] = BUCKETS
            np.add.at(count, owners, np.add.reduceat(h != BUCKETS, starts, dtype=np.int64))
            np.add.at(total, owners, np.add.reduceat(table[h], starts, axis=0))

    owners: list[int] = []
    parts: list[np.ndarray] = []
    own: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        points = _points(text)
        for a in range(0, len(points), SEGMENT):
            part = points[a : a + SEGMENT + max(ORDERS) - 1]
            owners.append(i)
            parts.append(part)
            own.append(min(SEGMENT, len(points) - a))
            held += len(part)
            if held >= SEGMENT:
                add(owners, parts, own)
                owners, parts, own, held = [], [], [], 0
    if parts:
        add(owners, parts, own)
    return total, count, letters


def probabilities(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Calibrated probabilities of each text, and whether it has a letter."""
    total, count, letters = _sums(texts, model.table)
    z = (total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(axis=1, keepdims=True), letters > 0


Bag = tuple[np.ndarray, np.ndarray]


def bag(text: str) -> Bag:
    """The buckets of a whole text's subwords, and the share of each among them."""
    points, counts = _points(text), np.zeros(BUCKETS + 1, np.int64)
    for a in range(0, len(points), SEGMENT):
        for h in subwords(points[a : a + SEGMENT + max(ORDERS) - 1]):
            counts += np.bincount(h[:SEGMENT], minlength=BUCKETS + 1)
    ids = np.flatnonzero(counts[:BUCKETS])
    return ids.astype(np.uint16), (counts[ids] / max(counts[ids].sum(), 1)).astype(np.float32)


def fit(texts: list[str], labels: list[str], **how) -> Model:
    """fit_bags of texts."""
    return fit_bags([bag(t) for t in texts], labels, **how)


def fit_bags(bags: list[Bag], labels: list[str], seed: int = 7, epochs: int = 6, least_steps: int = 4000, rate: float = 0.5) -> Model:
    """Train on the bags of labelled texts by stochastic gradient descent; every fifth one is kept for calibration.

    The temperature is the one of least log loss on the calibration texts. The rejection threshold is
    the probability below which FALSE_REJECTION of their right answers fall, and 0.5 at most.
    """
    names = tuple(sorted(set(labels)))
    y = np.array([names.index(v) for v in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    held = np.zeros(len(bags), bool)
    held[order[::5]] = len(bags) >= 20
    train = np.flatnonzero(~held)
    emb = (rng.standard_normal((BUCKETS, DIM)) / DIM).astype(np.float32)
    out, bias = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    # a small sample is gone through more often
    epochs = max(epochs, -(-least_steps // max(len(train), 1)))
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            ids, w = bags[i]
            v = w @ emb[ids]
            z = v @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            step = rate * (1 - done / steps)
            back = out @ p
            out -= step * np.outer(v, p)
            bias -= 0.1 * step * p
            # the average spreads the gradient thin, so embeddings take longer steps
            emb[ids] -= 20 * step * w[:, None] * back
            done += 1
    table = np.vstack([emb @ out, np.zeros((1, len(names)), np.float32)]).astype(np.float32)
    check = np.flatnonzero(held) if held.any() else train
    logits = np.array([bags[i][1].astype(np.float64) @ table[bags[i][0]] for i in check]) + bias
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.05, 5, 60):
        z = logits / t
        z -= z.max(axis=1, keepdims=True)
        loss = (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), y[check]]).mean()
        if loss < best - 1e-9:
            best, temperature = loss, float(t)
    z = logits / temperature
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[check]])
    limit = float(right[int(FALSE_REJECTION * len(right))]) if len(right) else 0.0
    return Model(names, table, bias, temperature, min(0.5, limit))


def training_sample(docs: DataFrame, usable: Column, rows_per_lang: int = ROWS_PER_LANG, most_langs: int = MOST_LANGS) -> tuple[list[Bag], list[str]]:
    """A bounded sample of labelled rows for fit_bags: about `rows_per_lang` of each language, chosen by a hash of doc_id.

    Texts are read whole; each comes as its bag, of 6 bytes for each of BUCKETS buckets at most. More than `most_langs` languages are an error,
    as the model has a column for each.
    """
    rows = only(bounded_batches(docs), "doc_id", "text", "lang").where("text is not null and lang is not null").where(usable)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(most_langs + 1).collect()}
    if len(counts) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    if not counts:
        return [], []
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    share = F.pmod(draw, F.lit(1 << 20)) / (1 << 20)
    chosen = F.lit(False)
    for lang, n in counts.items():
        chosen = chosen | ((F.col("lang") == lang) & (share < min(1.0, rows_per_lang / n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            bags = [bag(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("k"), *[pa.array([x[i].tobytes() for x in bags], pa.binary()) for i in (0, 1)]], ["lang", "k", "ids", "w"])

    got = rows.where(chosen).select("lang", draw.alias("k"), "text").mapInArrow(run, "lang string, k long, ids binary, w binary").collect()
    got.sort(key=lambda r: (r["k"], r["ids"], r["w"]))
    taken: dict[str, int] = {}
    kept = [r for r in got if (taken.update({r["lang"]: taken.get(r["lang"], 0) + 1}) or taken[r["lang"]] <= rows_per_lang)]
    return [(np.frombuffer(r["ids"], np.uint16), np.frombuffer(r["w"], np.float32)) for r in kept], [r["lang"] for r in kept]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every whole text.

    A null text, or one without a letter, is `und` with score 0 and rejected; so is every text if there
    was nothing to learn from. A text is also rejected if its calibrated probability is below the
    model's threshold; lang_pred is the likeliest language all the same. Repeated rows each get an
    answer. Other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    small = None if model is None else (model.labels, model.table, model.bias, model.temperature, model.threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None if small is None else Model(*small)
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            if m is None or not texts:
                lang, score, gone = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            else:
                p, letters = probabilities(m, texts)
                top = p.max(axis=1)
                lang = [m.labels[k] if ok else UNKNOWN for k, ok in zip(p.argmax(axis=1), letters, strict=True)]
                score, gone = np.where(letters, top, 0.0), ~letters | (top < m.threshold)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gone, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return only(bounded_batches(docs), "doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def fold(name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.col(name).cast("string")), F.lit(4))


def identify(docs: DataFrame) -> DataFrame:
    """Fit on labelled documents outside fold 2 and answer for all."""
    bags, labels = training_sample(docs, fold() != 2)
    return predict(docs, fit_bags(bags, labels) if bags else None)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language isn't rejected, with all their columns. See identify and predict.

    The answer travels with the row in one narrow pass: nothing is joined or shuffled.
    """
    bags, labels = training_sample(docs, fold() != 2)
    small = fit_bags(bags, labels) if bags else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if small is None or not b.num_rows:
                continue
            p, letters = probabilities(small, [t or "" for t in b.column("text").to_pylist()])
            yield b.filter(pa.array(letters & (p.max(axis=1) >= small.threshold)))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
