"""Exact top-k inner products with vector-approximation files."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.shared import bounded_batches, cut, done_with, only

#: Rows of a block of queries and of a block of cells, bits of a cell, and queries whose bounds are worked out at once.
QUERY_BLOCK, BLOCK, BITS, AT_ONCE = 1024, 8192, 8, 128

#: The least and the greatest value of each dimension, by the number of dimensions.
Grid = dict[int, tuple[np.ndarray, np.ndarray]]


def widths(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (high - low) // (1 << BITS) + 1


def quantise(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The cells of whole-number vectors, by row and dimension: a byte each."""
    return ((v - low) // widths(low, high)).astype(np.uint8)


def bounds(q: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score that a vector of each row of cells can have with each query."""
    wide = widths(low, high)
    least = (low + cells * wide).astype(np.float64)
    greatest = least + (wide - 1)
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    lower, upper = up @ least.T + down @ greatest.T, up @ greatest.T + down @ least.T
    # sums that doubles don't hold exactly get room for their rounding
    most = np.abs(q).astype(np.float64) @ np.maximum(np.abs(low), np.abs(high)).astype(np.float64)
    room = np.where(most < 2.0**52, 0.0, most * 2.0**-48)[:, None]
    return lower - room, upper + room


def scan(q: np.ndarray, qid: np.ndarray, cells: np.ndarray, vid: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query, cell, lower, upper) of the rows that may be among the k best of the block for each query; cells are in the order of vid.

    A row counts if its upper bound is above the k-th greatest lower bound, or equal to it with an id that isn't beyond
    the k-th's: another row of that score would come later. Rows of the query's own id don't count.
    """
    for a in range(0, len(q), AT_ONCE):
        lower, upper = bounds(q[a : a + AT_ONCE], cells, low, high)
        own = vid[None, :] == qid[a : a + AT_ONCE, None]
        lower[own] = upper[own] = -np.inf
        keep = upper > -np.inf
        if len(vid) > k:
            kth = np.partition(lower, len(vid) - k, axis=1)[:, len(vid) - k, None]
            same = lower == kth
            # the place of the k-th row among those of its bound, which lie in the order of their ids
            nth = k - (lower > kth).sum(axis=1, keepdims=True)
            last = vid[(np.cumsum(same, axis=1) >= nth).argmax(axis=1)][:, None]
            keep &= (upper > kth) | ((upper == kth) & (vid[None, :] <= last))
        x, y = np.nonzero(keep)
        yield x + a, y, lower[x, y], upper[x, y]


def whole_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, of the vectors that take part."""
    rows = only(vectors, "vec_id", "embedding").where("vec_id is not null and embedding is not null")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.int64).reshape(len(column), dim)


def _grid(exact: DataFrame) -> Grid:
    """One pass over the exact vectors; a pair of numbers for each dimension of each length of vector comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            for dim in set(t.column("dim").to_pylist()):
                v = _matrix(t.filter(pa.compute.equal(t.column("dim"), dim)).column("v"), dim)
                yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(v.min(axis=0)), pa.array(v.max(axis=0))], ["dim", "d", "low", "high"])

    rows = exact.select("dim", "v").mapInArrow(run, "dim int, d int, low long, high long").groupBy("dim", "d").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    out: Grid = {0: (np.empty(0, np.int64), np.empty(0, np.int64))}
    for dim in {r["dim"] for r in rows}:
        some = sorted((r["d"], r["low"], r["high"]) for r in rows if r["dim"] == dim)
        out[dim] = (np.array([x[1] for x in some], np.int64), np.array([x[2] for x in some], np.int64))
    return out


def approximation(exact: DataFrame, grid: Grid) -> DataFrame:
    """The approximation file (row, vec_id, dim, cells): a byte a dimension; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            for dim in set(t.column("dim").to_pylist()):
                some = t.filter(pa.compute.equal(t.column("dim"), dim))
                cells = quantise(_matrix(some.column("v"), dim), *grid[dim])
                yield from some.select(["row", "vec_id", "dim"]).append_column("cells", pa.array([c.tobytes() for c in cells], pa.binary())).combine_chunks().to_batches()

    return cut(exact.mapInArrow(run, "row long, vec_id long, dim int, cells binary"))


def rivals(exact: DataFrame, k: int) -> DataFrame:
    """The rows that can be a result of any query: of equal vectors, those of the smallest ids.

    Of rows that share vector and id the first k count, of those that share a vector the first 2k: k of them have not the
    query's own id. Each task leaves out what is beyond that before rows move, so a very common vector is a few rows a task.
    """
    some = exact.withColumn("n", F.row_number().over(Window.partitionBy("v", "vec_id").orderBy("row"))).where(F.col("n") <= k)
    return some.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "row"))).where(F.col("n") <= 2 * k).drop("n")


def candidates(queries: DataFrame, cells: DataFrame, grid: Grid, k: int, query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """(of, row, vec_id, lower, upper): the rows that each query must be held against, by their cells alone; written.

    Queries (row, vec_id, dim, v) and cells are dealt into blocks by a hash of their row; a task scans one block of cells for
    one block of queries (see scan). The k-th greatest lower bound over all blocks then rules out most of what was local.
    """
    n_q, n_c = max(1, math.ceil(queries.count() / query_block)), max(1, math.ceil(cells.count() / block))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("row", "vec_id", "v", "dim", deal(n_q).alias("q")).select("*", each(n_c).alias("c"))
    right = cells.select("row", "vec_id", "cells", "dim", deal(n_c).alias("c")).select("*", each(n_q).alias("q"))

    def run(qs: pa.Table, cs: pa.Table) -> pa.Table:
        parts: list[tuple] = []
        if qs.num_rows and cs.num_rows:
            cs, dim = cs.sort_by("vec_id"), qs.column("dim")[0].as_py()
            data = np.frombuffer(b"".join(cs.column("cells").to_pylist()), np.uint8).reshape(cs.num_rows, dim)
            of, row, vid = qs.column("row").to_numpy(), cs.column("row").to_numpy(), cs.column("vec_id").to_numpy()
            parts = [(of[x], row[y], vid[y], lo, hi) for x, y, lo, hi in scan(_matrix(qs.column("v"), dim), qs.column("vec_id").to_numpy(), data, vid, *grid[dim], k)]
        kinds = (np.int64, np.int64, np.int64, np.float64, np.float64)
        cols = [np.concatenate([p[i] for p in parts] or [np.empty(0, kind)]) for i, kind in enumerate(kinds)]
        return pa.table(dict(zip(("of", "row", "vec_id", "lower", "upper"), map(pa.array, cols), strict=True)))

    key = ("q", "c", "dim")
    local = cut(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "of long, row long, vec_id long, lower double, upper double"))
    kth = _first(local, k, F.desc("lower"), "vec_id").where(F.col("rank") == k).select("of", F.col("lower").alias("bound"), F.col("vec_id").alias("last"))
    found = cut(_reaching(local, kth))
    done_with(local)
    return found


def _first(rows: DataFrame, k: int, *order) -> DataFrame:
    """The k first rows of each query, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("of").orderBy(*order))).where(F.col("rank") <= k)


def _reaching(rows: DataFrame, kth: DataFrame) -> DataFrame:
    """The rows that may still come before the k-th (of, bound, last); all rows of a query that has no k-th."""
    met = rows.join(kth, "of", "left")
    return met.where(F.expr("bound is null or upper > bound or (upper = bound and vec_id <= last)")).drop("bound", "last")


def read_exact(pairs: DataFrame, queries: DataFrame, exact: DataFrame) -> DataFrame:
    """(of, row, vec_id, score) of (of, row, vec_id): the exact vectors of these pairs are read, and no others go on; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, v = (b.column(c) for c in ("qv", "v"))
            product = np.concatenate([np.asarray(q.flatten(), np.int64) * np.asarray(v.flatten(), np.int64), np.zeros(1, np.int64)])
            ends = np.cumsum(np.concatenate([[0], np.asarray(pa.compute.list_value_length(q), np.int64)]))
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(product)])
            yield pa.RecordBatch.from_arrays([b.column("of"), b.column("row"), b.column("vec_id"), pa.array(sums[ends[1:]] - sums[ends[:-1]])], ["of", "row", "vec_id", "score"])

    met = pairs.select("of", "row", "vec_id").join(exact.select("row", "v"), "row").join(queries.select(F.col("row").alias("of"), F.col("v").alias("qv")), "of")
    return cut(met.select("of", "row", "vec_id", "qv", "v").mapInArrow(run, "of long, row long, vec_id long, score long"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows by integer inner product, ties to the smaller vec_id.

    The vectors are written once, and beside them the approximation file: a byte a dimension (see rivals for rows that it can spare). Its cells are scanned for bounds
    on every score (see candidates). Of the rows that the bounds leave, the k of the greatest upper bounds are read
    exactly first; then those whose upper bound still reaches the k-th score, until the k-th is certain. So exact vectors are moved for
    pairs that may be results, and blocks of cells for the scan. Memory follows the block sizes.

    Vectors that are null or hold a null or a non-finite component take no part, nor do rows with a null vec_id; empty ones do,
    with score 0 among themselves. Vectors of different lengths are not compared. A query isn't compared with any row of its own
    vec_id; repeated candidates each take a rank, and each query row has its own list. A query with fewer candidates gets all. Scores
    are exact as long as they fit 63 bits. Other columns are ignored. An empty table gives no rows.
    """
    rows = whole_vectors(bounded_batches(vectors), scale).withColumn("dim", F.size("v"))
    exact = cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "dim", "v"))
    grid = _grid(exact)
    cells = approximation(rivals(exact, k), grid)
    queries = exact.where(is_query)
    found = candidates(queries, cells, grid, k, query_block, block)
    done_with(cells)
    first = _first(found, k, F.desc("upper"), "vec_id", "row").drop("rank")
    scored = read_exact(first, queries, exact)
    kth = _first(scored, k, F.desc("score"), "vec_id", "row").where(F.col("rank") == k).select("of", F.col("score").cast("double").alias("bound"), F.col("vec_id").alias("last"))
    # above 2**53 the k-th score as a double may be rounded up, so the bound is kept below it
    kth = kth.withColumn("bound", F.when(F.abs("bound") < 2.0**52, F.col("bound")).otherwise(F.col("bound") - F.abs("bound") * 2.0**-50))
    rest = _reaching(found.join(scored.select("of", "row"), ["of", "row"], "left_anti"), kth)
    best = _first(scored.union(read_exact(rest, queries, exact)), k, F.desc("score"), "vec_id", "row")
    done_with(found)
    return best.join(queries.select(F.col("row").alias("of"), F.col("vec_id").alias("query_id")), "of").select("query_id", "rank", "vec_id", "score")
