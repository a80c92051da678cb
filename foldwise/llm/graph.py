"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.shared import cut_unsized, done_with

#: A guard against a bug only: label distances at least halve each round.
MOST_ROUNDS = 100
#: A graph of at most so many edges (16 bytes each; they are counted first) is labelled within one task; larger ones by joins.
SMALL = 200_000


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in edges (a, b), sorted, and the smallest id that each can reach."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    low = np.arange(len(ids))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        # the labels' own labels fall too, so that a long path shrinks by half each time
        for at in (x, y, low[x], low[y]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == low).all():
            return ids, ids[low]
        low = new


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b); component is the smallest id that can be reached. Written.

    The edges are counted. Up to SMALL of them are labelled by one task (see labelled). More are labelled in rounds of joins:
    every id takes the smallest label among its neighbours, then the label of that label, so rounds grow with the logarithm of
    the longest path; labels are written to the shared folder each round, and those of the round before are removed. There an
    id with very many edges is met by partial aggregation and by joins that adaptive execution can split. Nulls and self-loops
    are ignored; an empty table gives no rows.
    """
    some = cut_unsized(edges.where("a is not null and b is not null").select("a", "b").distinct())
    if some.count() <= SMALL:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
            ids, low = labelled(t.column("a").to_numpy(), t.column("b").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(low)], ["id", "component"])

        labels = cut_unsized(some.selectExpr("cast(a as long) a", "cast(b as long) b").coalesce(1).mapInArrow(run, "id long, component long"))
        done_with(some)
        return labels
    both = cut_unsized(some.unionByName(some.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    done_with(some)
    labels = cut_unsized(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    for _ in range(MOST_ROUNDS):
        near = (
            both.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("m"))
        )
        lower = labels.join(near, "id").select("id", F.least("component", "m").alias("l"), F.col("component").alias("was"))
        hop = labels.select(F.col("id").alias("l"), F.col("component").alias("c"))
        step = cut_unsized(lower.join(hop, "l", "left").select("id", F.least("l", "c").alias("component"), "was"))
        settled = not step.where("component <> was").limit(1).count()
        before, labels = labels, cut_unsized(step.select("id", "component"))
        done_with(before, step)
        if settled:
            done_with(both)
            return labels
    raise RuntimeError("labels did not settle")
