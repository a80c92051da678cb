"""Token sequences written in training order: a keyed permutation gives each its slot in fixed-stride shards."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.llm.shared import bounded_batches, cut, done_with, only, slices
from foldwise.llm.shingles import draws, mix

#: Tokens of a sequence, records of a shard (always, but for the last one), and tasks that write them at most; each writes shards that follow one another.
LENGTH, SHARD_ROWS, MOST_TASKS = 512, 16384, 100_000
ROUNDS, KEY = 6, 20240229
#: log2 of the hash buckets whose counts number the sequences: that many numbers come to the driver, whatever the input.
BUCKET_BITS = 12
#: Tables of at most so many 16-byte rows are broadcast (after they were counted); larger ones are joined by shuffle.
SMALL = 1_000_000
#: Byte tokens: a text's UTF-8 bytes are its ids. These two occur in no UTF-8 text.
END, PAD = 0xFF, 0xFE
HEAD = np.dtype([("doc_id", "<i8"), ("seq_no", "<u4"), ("n", "<u4")])


@dataclass(frozen=True)
class Layout:
    """What a reader must know of the shards."""

    n: int
    length: int
    width: int
    shard_rows: int
    key: int

    @property
    def stride(self) -> int:
        """Bytes of a record: head, ids, and the line feed of the writer."""
        return HEAD.itemsize + self.length * self.width + 1

    @property
    def shards(self) -> int:
        return -(-self.n // self.shard_rows)


def _halves(n: int) -> tuple[int, np.uint64]:
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    return half, np.uint64((1 << half) - 1)


def _walk(x: np.ndarray, n: int, step) -> np.ndarray:
    """Apply a permutation of a power of four until every value is below n (cycle-walking)."""
    x = step(np.asarray(x, np.uint64))
    while (out := x >= n).any():
        x[out] = step(x[out])
    return x.astype(np.int64)


def permute(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Images of x under a keyed permutation of 0 .. n-1: a Feistel network with cycle-walking."""
    half, mask = _halves(n)
    keys = draws(key, ROUNDS)

    def step(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return left << np.uint64(half) | right

    return _walk(x, n, step)


def unpermute(y: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The inverse of permute: which sequence has a slot."""
    half, mask = _halves(n)
    keys = draws(key, ROUNDS)[::-1]

    def step(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            left, right = right ^ (mix(left ^ k) & mask), left
        return left << np.uint64(half) | right

    return _walk(y, n, step)


def byte_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, ids): one byte an id, with END after each text; a null text is empty."""
    rows = only(docs, "doc_id", "text")
    return rows.select("doc_id", F.concat(F.encode(F.coalesce("text", F.lit("")), "utf-8"), F.lit(bytearray([END]))).alias("ids"))


def packed(encoded: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, ids) with an array of ids packed into little-endian numbers of `width` bytes, as `materialise` takes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if v is None else np.asarray(v).astype(f"<u{width}").tobytes() for v in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "ids"])

    return only(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, ids binary")


#: What tells the rows apart: doc_id, and for rows that share it a hash of the ids and the number of the copy.
KEY_COLUMNS = ("doc_id", "variant", "copy")


def told_apart(tokens: DataFrame) -> DataFrame:
    """(doc_id, variant, copy, ids): every row with a key of its own.

    Rows of a doc_id that no other row has pass through. The others are grouped by doc_id and ids, partly aggregated before
    they move, and come as so many copies as there are; written.
    """
    none = [F.lit(0).cast("long").alias(c) for c in ("variant", "copy")]
    twice = cut(tokens.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id"))
    if not twice.limit(1).count():
        return tokens.select("doc_id", *none, "ids")
    few = F.broadcast(twice) if twice.count() <= SMALL else twice
    groups = tokens.join(few, "doc_id", "left_semi").groupBy("doc_id", "ids").agg(F.count(F.lit(1)).alias("c"))
    copies = groups.select("doc_id", F.xxhash64("ids").alias("variant"), F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("copy"), "ids")
    return tokens.join(few, "doc_id", "left_anti").select("doc_id", *none, "ids").unionByName(cut(copies))


def number(tokens: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(doc_id, variant, copy, first): a row's first sequence among all, in the order of a hash of its key; and their number.

    Hash buckets are counted, the counts of the 2**BUCKET_BITS buckets are summed up on the driver, and
    rows are ordered within a bucket alone. So numbers depend on ids and lengths, and not on how the table is parted.
    """
    light = tokens.select(*KEY_COLUMNS, F.ceil(F.octet_length("ids") / size).alias("k")).where("k > 0")
    light = cut(light.withColumn("h", F.xxhash64(*KEY_COLUMNS)))
    bucket = F.shiftrightunsigned("h", 64 - BUCKET_BITS)
    counts = {r["b"]: r["k"] for r in light.groupBy(bucket.alias("b")).agg(F.sum("k").alias("k")).collect()}
    before, at = [], 0
    for b in sorted(counts):
        before.append((b, at))
        at += counts[b]
    offsets = light.sparkSession.createDataFrame(before, "b long, before long")
    above = F.coalesce(F.sum("k").over(Window.partitionBy("b").orderBy("h", *KEY_COLUMNS).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = light.withColumn("b", bucket.cast("long")).withColumn("above", above).join(F.broadcast(offsets), "b")
    starts = cut(rows.select(*KEY_COLUMNS, (F.col("before") + F.col("above")).alias("first")))
    done_with(light)
    return starts, at


def materialise(tokens: DataFrame, path: str, length: int = LENGTH, width: int = 1, pad: int = PAD, shard_rows: int = SHARD_ROWS, key: int = KEY) -> Layout:
    """Write every sequence of `length` ids to its slot; returns the layout, which is also written to path/layout.

    tokens: (doc_id, ids), ids being binary, numbers of `width` bytes. A document's ids are cut every
    `length` ids; the last sequence is filled with `pad`. A sequence never crosses documents.
    Sequences are numbered (see number), `permute` gives each its slot, and shard s holds the slots from s * shard_rows on, in
    order, as records of Layout.stride bytes: head, ids, line feed. Slot i so lies in shard
    i // shard_rows at (i % shard_rows) * stride, and a reader goes on from any slot.

    A shard is written from one task's sorted partition by Spark's own writer, so a lost executor costs a rerun and
    leaves no half file. Every row is written, rows that share a doc_id or repeat whole too (each has its own sequences, which
    count from 0). Null or empty ids make no sequence; rows with a null doc_id are no documents. An empty table makes a layout
    without shards.
    """
    spark, size = tokens.sparkSession, length * width
    tokens = bounded_batches(tokens).where("doc_id is not null and octet_length(ids) > 0").select(F.col("doc_id").cast("long"), "ids")
    tokens = told_apart(tokens)
    starts, n = number(tokens, size)
    layout = Layout(n, length, width, shard_rows, key)
    row_size, rows_each = layout.stride - 1, layout.shard_rows
    filler = np.frombuffer(int(pad).to_bytes(width, "little"), np.uint8)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records of some documents at a time, those of one shard together as one compressed row."""
        for b in slices(batches, 1024):
            docs, firsts = b.column("doc_id").to_numpy(), b.column("first").to_numpy()
            data = [np.frombuffer(ids.as_buffer(), np.uint8) for ids in b.column("ids")]
            sizes = np.array([len(d) for d in data], np.int64)
            k = -(-sizes // size)
            ends = np.cumsum(k)
            seq = np.arange(ends[-1]) - np.repeat(ends - k, k)
            body = np.tile(filler, int(ends[-1]) * length)
            for d, at in zip(data, (ends - k) * size, strict=True):
                body[at : at + len(d)] = d
            head = np.empty(len(seq), HEAD)
            head["doc_id"], head["seq_no"] = np.repeat(docs, k), seq
            head["n"] = np.minimum(length, (np.repeat(sizes, k) - seq * size) // width)
            out = np.concatenate([head.view(np.uint8).reshape(len(seq), -1), body.reshape(len(seq), size)], axis=1)
            slot = permute(np.repeat(firsts, k) + seq, n, key)
            order = np.argsort(slot)
            shard = slot[order] // rows_each
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            parts = [(int(shard[x]), order[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in parts], pa.int32()), pa.array([slot[i].tobytes() for _, i in parts], pa.binary()), pa.array([zlib.compress(out[i].tobytes(), 1) for _, i in parts], pa.binary())],
                ["shard", "slots", "records"],
            )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            for shard, slots, records in zip(b.column("shard").to_pylist(), b.column("slots").to_pylist(), b.column("records").to_pylist(), strict=True):
                at, raw = np.frombuffer(slots, np.int64), zlib.decompress(records)
                offsets = pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * row_size)
                record = pa.Array.from_buffers(pa.binary(), len(at), [None, offsets, pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array(at), record], ["shard", "slot", "record"])

    if n:
        met = tokens.join(F.broadcast(starts) if starts.count() <= SMALL else starts, list(KEY_COLUMNS))
        placed = met.select("doc_id", "first", "ids").mapInArrow(place, "shard int, slots binary, records binary")
        tasks = min(layout.shards, MOST_TASKS)
        placed = placed.repartitionById(tasks, F.floor(F.col("shard").cast("long") * F.lit(tasks) / F.lit(layout.shards)).cast("int")).mapInArrow(_gathered(unpack), "shard int, slot long, record binary")
        placed = placed.sortWithinPartitions("shard", "slot")
        placed.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(f"{path}/data")
    spark.createDataFrame([tuple(asdict(layout).values())], "n long, length int, width int, shard_rows long, key long").coalesce(1).write.json(f"{path}/layout")
    return layout


def _gathered(f):
    """f with its small batches put together, so that each costs less on its way to Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in f(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 4096:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def read_layout(spark: SparkSession, path: str) -> Layout:
    r = spark.read.schema("n long, length int, width int, shard_rows long, key long").json(f"{path}/layout").first()
    return Layout(*r)


def read(spark: SparkSession, path: str, first_slot: int = 0) -> DataFrame:
    """(slot, shard, doc_id, seq_no, n_tokens, ids) of all slots from first_slot on; shards before it aren't opened.

    A task holds one shard at a time, of shard_rows * stride bytes, which must be below 2 GB.
    """
    layout = read_layout(spark, path)
    schema = "slot long, shard int, doc_id long, seq_no long, n_tokens long, ids binary"
    if not layout.n:
        return spark.createDataFrame([], schema)
    stride, rows_each, first = layout.stride, layout.shard_rows, first_slot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content in zip(b.column("shard").to_pylist(), b.column("content"), strict=True):
                data = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, stride)
                for at in range(max(0, first - shard * rows_each), len(data), 4096):
                    part = data[at : at + 4096]
                    head = np.ascontiguousarray(part[:, : HEAD.itemsize]).view(HEAD).ravel()
                    m, width = len(part), stride - 1 - HEAD.itemsize
                    body = np.ascontiguousarray(part[:, HEAD.itemsize : -1])
                    ids = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.arange(m + 1, dtype=np.int32) * width), pa.py_buffer(body)])
                    slot = shard * rows_each + at + np.arange(m, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slot), pa.array(np.full(m, shard, np.int32)), pa.array(head["doc_id"].astype(np.int64)), pa.array(head["seq_no"].astype(np.int64)), pa.array(head["n"].astype(np.int64)), ids],
                        ["slot", "shard", "doc_id", "seq_no", "n_tokens", "ids"],
                    )

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary, shard int").load(f"{path}/data")
    return files.where(F.col("shard") >= first_slot // rows_each).select("shard", "content").mapInArrow(run, schema)
