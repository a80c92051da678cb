"""Byte-level BPE: overlapping chunks are pre-tokenised apart, stitched, and encoded piece by piece."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.shared import bounded_batches, only, slices

#: Code points of a chunk, and by how many it reaches into the next one.
CHUNK, OVERLAP = 16384, 512

#: So many code points decide whether a short alternative of the pattern ('ll) matches.
LOOK = 3

#: A chunk of a text: its start, its code points, the offsets in it at which pre-tokens end.
Chunk = tuple[int, str, np.ndarray]


@lru_cache(4)
def encoder(path: str, pattern: str):
    """The tiktoken encoder of a rank file; one a Python worker."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id; ids that the file leaves out have none."""
    ranks = _ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


@lru_cache(4)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, pattern: str) -> np.ndarray:
    """Offsets in `text` at which its pre-tokens end, in order."""
    return np.fromiter(accumulate(map(len, _splitter(pattern).findall(text))), np.int64)


def chunked(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """Overlapping chunks (start, code points) that cover the text; one for an empty text."""
    starts = range(0, max(len(text), 1), size)
    return [(s, text[s : s + size + overlap]) for s in starts]


def stitch(chunks: list[Chunk], pattern: str) -> list[int]:
    """Cuts at which the text may be parted so that the parts' ids are the ids of the whole.

    A chunk that starts inside a pre-token is wrong at first. From the first boundary that it shares
    with the chunk before it both go on alike, for the pattern never looks back; so that boundary is
    right. (The last boundary of a chunk, and those within LOOK of its end, may be due to its end and
    don't count.) It becomes a cut if no white space stands before it, as only white space looks ahead.
    Where two chunks share no such boundary, they are joined from the last cut on and pre-tokenised anew.
    """
    cuts = [0]
    if not chunks:
        return cuts
    start, text, ends = chunks[0]
    for s, t, e in chunks[1:]:
        sure = ends[:-1]
        shared = np.intersect1d(sure[sure <= len(text) - LOOK] + start, np.append(e[:-1], 0) + s)
        cut = next((int(p) for p in shared if p > cuts[-1] and not text[p - start - 1].isspace()), None)
        if cut is None:
            text, start = text[cuts[-1] - start :] + t[start + len(text) - s :], cuts[-1]
            ends = boundaries(text, pattern)
        else:
            cuts.append(cut)
            start, text, ends = s, t, e[e + s > cut]
    return cuts


def encode_chunks(chunks: list[Chunk], path: str, pattern: str) -> np.ndarray:
    """The ids of the text that the chunks cover."""
    text = "".join(t[: n[0] - s] for (s, t, _), n in zip(chunks, [*chunks[1:], (None,)], strict=True) if n[0] is not None) + chunks[-1][1]
    cuts = [*stitch(chunks, pattern), len(text)]
    encode = encoder(path, pattern).encode_ordinary
    return np.concatenate([np.asarray(encode(text[a:b]), np.int32) for a, b in zip(cuts, cuts[1:], strict=False)] or [np.empty(0, np.int32)])


def encode_text(text: str, path: str, pattern: str, size: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """The same for one text within one process."""
    return encode_chunks([(s, t, boundaries(t, pattern)) for s, t in chunked(text, size, overlap)], path, pattern)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32), pa.int32()))


def _decoded(ids: list[int], known: list[bytes]) -> bytes:
    return b"".join([known[i] for i in ids])


#: What digests give of the ids of a text.
DIGESTS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


@lru_cache(4)
def _spoken(path: str) -> list[bytes]:
    return [b"%d" % i for i in range(len(token_bytes(path)))]


def _digested(lists: Iterable[list[int]], path: str) -> list[pa.Array]:
    """The columns DIGESTS of lists of ids; one list is held at a time."""
    known, spoken = token_bytes(path), _spoken(path)
    n, of_ids, of_bytes = [], [], []
    for ids in lists:
        n.append(len(ids))
        of_ids.append(hashlib.sha256(b" ".join([spoken[i] for i in ids])).hexdigest())
        of_bytes.append(hashlib.sha256(_decoded(ids, known)).hexdigest())
    return [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]


def encode(docs: DataFrame, path: str, pattern: str, size: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False, digested: bool = False) -> DataFrame:
    """(doc_id, ids) of every text, as the tiktoken library gives them without special tokens; with `decoded`, the bytes that the
    ids decode to as well (see decode), by the same worker; with `digested`, what digests gives of the ids in their place, by the
    same worker, so that a task keeps one worker and not two, and ids aren't moved.

    A text of one chunk is encoded where it is read. A longer one is dealt out as chunks, each
    pre-tokenised by itself on any executor; its chunks then meet, are stitched and encoded. So one
    task holds a single text at most, and no more than the chunks of long texts are moved.

    Null texts count as empty and give no ids. Repeated rows are each encoded. A null doc_id is a
    doc_id like others. Other columns are ignored. An empty table gives no rows.
    """
    rows = only(bounded_batches(docs), "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(path, pattern).encode_ordinary
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            if digested:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_digested(map(run, texts), path)], names)
                continue
            ids = [run(t) for t in texts]
            back = [pa.array([_decoded(x, token_bytes(path)) for x in ids], pa.binary())] if decoded else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists([np.asarray(x, np.int32) for x in ids]), *back], names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for doc, of, text in zip(b.column("doc_id"), b.column("of").to_pylist(), b.column("text").to_pylist(), strict=True):
                parts = chunked(text, size, overlap)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc.as_py()] * len(parts), doc.type), pa.array([of] * len(parts)), pa.array([s for s, _ in parts], pa.int64()), pa.array([t for _, t in parts])],
                    ["doc_id", "of", "start", "text"],
                )

    def presplit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ends = [boundaries(t, pattern).astype(np.int32) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(ends)], [*b.schema.names, "ends"])

    def join(chunks: pa.Table) -> pa.Table:
        order = chunks.sort_by("start")
        starts = order.column("start").to_pylist()
        copies = starts.count(0)
        got = [(s, t, np.asarray(e, np.int64)) for s, t, e in zip(starts, order.column("text").to_pylist(), order.column("ends").to_pylist(), strict=True)]
        ids = encode_chunks(got[::copies], path, pattern)
        doc = pa.array([order.column("doc_id")[0].as_py()] * copies, order.schema.field("doc_id").type)
        if digested:
            return pa.table([doc, *[pa.array(c.to_pylist() * copies, c.type) for c in _digested([ids.tolist()], path)]], names)
        back = [pa.array([_decoded(ids.tolist(), token_bytes(path))] * copies, pa.binary())] if decoded else []
        return pa.table([doc, _lists([ids] * copies), *back], names)

    kind = dict(rows.dtypes)["doc_id"]
    columns = DIGESTS if digested else {"ids": "array<int>"} | ({"decoded": "binary"} if decoded else {})
    names = ["doc_id", *columns]
    schema = ", ".join(f"{c} {of}" for c, of in ({"doc_id": kind} | columns).items())
    short = rows.where(F.length("text") <= size).mapInArrow(whole, schema)
    long = (
        rows.where(F.length("text") > size)
        .withColumn("of", F.xxhash64("text"))
        .mapInArrow(deal, f"doc_id {kind}, of long, start long, text string")
        .repartition("doc_id", "start")
        .mapInArrow(presplit, f"doc_id {kind}, of long, start long, text string, ends array<int>")
        .groupBy("doc_id", "of")
        .applyInArrow(join, schema)
    )
    return short.unionByName(long)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows with a binary column `decoded`: the bytes of the ids, one after another.

    A null list of ids gives null, an empty one no bytes. An id without a token is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_bytes(path)
        for b in slices(batches):
            out = [None if ids is None else _decoded(ids, known) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{encoded._jdf.schema().toDDL()}, decoded binary")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids); the ids are decoded on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_digested((ids.values.to_pylist() for ids in b.column("ids")), path)], ["doc_id", *DIGESTS])

    return encoded.mapInArrow(run, ", ".join(f"{c} {of}" for c, of in ({"doc_id": dict(encoded.dtypes)["doc_id"]} | DIGESTS).items()))
