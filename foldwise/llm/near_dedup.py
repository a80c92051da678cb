"""Near duplicates: minhashes, tensored banding, confirmation on full shingle sets, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.graph import components
from foldwise.llm.shared import arrow_rows, bounded_batches, cut_unsized, done_with, only
from foldwise.llm.shingles import fingerprint, minhashes, mix, shingle_set, word_lists

#: Words of a shingle, and the least similarity in hundredths.
WORDS, PERCENT = 5, 80
#: Two collections of SIDE tuples of TUPLE minhashes each; every pair of tuples makes a table, SIDE**2 in all.
#: At similarity 0.8 a pair shares no table with probability 2 * (1 - 0.8**TUPLE)**SIDE = 7e-5.
SIDE, TUPLE = 10, 2
#: A candidate needs so many equal minhashes of 2 * SIDE * TUPLE to be confirmed; fewer have probability 1e-5 at 0.8.
LEAST_EQUAL = 20
#: Buckets of more rows make dense clusters. There a pair needs LONG_EQUAL of LONG minhashes (fewer have probability 5e-6
#: at 0.8), compared in blocks of about WIDE rows; documents with such a partner are compared in blocks of about BLOCK sets,
#: SLAB shingles at once.
LARGE, LONG, LONG_EQUAL, WIDE, BLOCK, SLAB = 64, 128, 80, 1024, 512, 1 << 13
#: Representatives whose keys meet before they are sent; rows of a few numbers that Python takes at once.
GATHER, SMALL_ROWS = 8192, 20_000
#: Tables of at most so many 16-byte rows are broadcast (after they were counted); larger ones are joined by shuffle.
SMALL = 200_000

def _semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """df's rows whose key is in ids, which has been written already; broadcast only if its counted size allows it."""
    return df.join(F.broadcast(ids) if ids.count() <= SMALL else ids, key, "left_semi")


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n, f1, f2, mh): size and 128-bit fingerprint of each document's shingle set, and 16 bits of each of its minhashes."""
    k = 2 * SIDE * TUPLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for lists in word_lists(b.column("text")):
                sets = [shingle_set(w, words) for w in lists]
                mh = mix(minhashes(sets, k)).astype(np.uint16)
                f = np.frombuffer(b"".join(fingerprint(s) for s in sets), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1]),
                        pa.array([row.tobytes() for row in mh], pa.binary()),
                    ],
                    ["doc_id", "n", "f1", "f2", "mh"],
                )
                at += len(sets)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, mh binary")


def _minhashes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), 2 * SIDE * TUPLE)


def _tuples(mh: np.ndarray) -> np.ndarray:
    """Row by collection by place: the tuples of minhashes as numbers."""
    out = np.zeros((len(mh), 2, SIDE), np.uint64)
    for part in np.moveaxis(mh.reshape(len(mh), 2, SIDE, TUPLE), -1, 0):
        out = (out << np.uint64(16)) | part
    return out


def table_keys(mh: np.ndarray) -> np.ndarray:
    """Row by table: the keys of all SIDE**2 tables, each of a tuple of either collection."""
    half = mix(_tuples(mh) + np.arange(1, 2 * SIDE + 1, dtype=np.uint64).reshape(2, SIDE) * np.uint64(0xD6E8FEB86659FD93))
    return mix(half[:, 0, :, None] + half[:, 1, None, :] * np.uint64(0x9E3779B97F4A7C15)).reshape(len(mh), -1).view(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches, put together to parts of about so many rows."""
    held, have = [], 0
    for b in batches:
        held.append(b)
        have += b.num_rows
        if have >= rows:
            yield pa.Table.from_batches(held)
            held, have = [], 0
    if have:
        yield pa.Table.from_batches(held)


def members(reps: DataFrame) -> DataFrame:
    """(key, id, first): the members of all buckets of two or more, each with a member it is set against; written.

    Every representative has a key in each table. Members that meet within a part of GATHER representatives are tied to the
    smallest id among them there; only that one is sent to the bucket's partition, where the heads of all parts are tied to
    the smallest of theirs. So a hot bucket costs one row a part there, and partitions are read through, not held.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _parts(batches, GATHER):
            keys = table_keys(_minhashes(t.column("mh").combine_chunks()))
            ids = np.repeat(t.column("id").to_numpy(), keys.shape[1])
            order = np.lexsort((ids, keys.ravel()))
            key, ids = keys.ravel()[order], ids[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            head = ids[new][np.cumsum(new) - 1]
            alone = new & np.concatenate([new[1:], [True]])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(head, mask=alone)], ["key", "id", "first"])

    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the head of the bucket that may go on in the next batch: its key, its id, and whether it was given out
        open_key, open_id, given = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        for b in batches:
            key, ids, first = b.column("key").to_numpy(), b.column("id").to_numpy(), b.column("first")
            own, first = first.is_valid().to_numpy(zero_copy_only=False), first.fill_null(0).to_numpy()
            within = own & (first != ids)
            k, i = np.concatenate([open_key, key[~within]]), np.concatenate([open_id, ids[~within]])
            needed, was = np.concatenate([given, own[~within]]), np.concatenate([given, np.zeros((~within).sum(), bool)])
            center = i
            if len(k):
                new = np.concatenate([[True], k[1:] != k[:-1]])
                needed |= ~(new & np.concatenate([new[1:], [True]]))
                center, start = i[new][np.cumsum(new) - 1], np.flatnonzero(new)[-1]
                open_key, open_id, given = k[start : start + 1], i[start : start + 1], needed[start : start + 1]
                out = needed & ~was
                k, i, center = k[out], i[out], center[out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([key[within], k])), pa.array(np.concatenate([ids[within], i])), pa.array(np.concatenate([first[within], center]))], ["key", "id", "first"]
            )

    schema = "key long, id long, first long"
    rows = reps.select("id", "mh").mapInArrow(keyed, schema)
    place = F.when(F.col("first").isNull() | (F.col("first") == F.col("id")), F.col("key")).otherwise(F.xxhash64("key", "id"))
    with arrow_rows(reps.sparkSession, SMALL_ROWS):
        return cut_unsized(rows.repartition(place).sortWithinPartitions("key", "id").mapInArrow(tied, schema))


def _sets(docs: DataFrame, ids: DataFrame, words: int, long: bool = False) -> DataFrame:
    """(id, s, m): the full shingle sets of the documents named in ids, as sorted 64-bit words, and LONG minhashes, if asked.

    A document of several rows has several sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for lists in word_lists(b.column("text")):
                sets = [shingle_set(w, words) for w in lists]
                m = mix(minhashes(sets, LONG, 17)).astype(np.uint16) if long else [None] * len(sets)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([None if r is None else r.tobytes() for r in m], pa.binary())], ["id", "s", "m"]
                )
                at += len(sets)

    rows = _semi(docs.select("doc_id", "text"), ids.select(F.col("id").alias("doc_id")), "doc_id")
    return rows.mapInArrow(run, "id long, s binary, m binary").where("octet_length(s) > 0")


def _worth(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs that sizes and minhashes don't rule out; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            equal = (_minhashes(b.column("ma")) == _minhashes(b.column("mb"))).sum(axis=1)
            yield b.select(["a", "b"]).filter(pa.array(equal >= LEAST_EQUAL))

    side = lambda c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("mh").alias(f"m{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    near = near.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return cut_unsized(near.select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long"))


def confirm(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union; written."""
    ids = cut_unsized(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    sets = _sets(docs, ids, words).drop("m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, big = (p, q) if len(p) < len(q) else (q, p)
                at = np.searchsorted(big, small)
                both = int((big[np.minimum(at, len(big) - 1)] == small).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    links = cut_unsized(met.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"))
    done_with(ids)
    return links


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, first, component, rows): the rows of buckets with more than one component; written."""
    named = members.join(labels, "id", "left").select("key", "id", "first", F.coalesce("component", "id").alias("component"))
    size = named.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    size = cut_unsized(size.where("lo <> hi").select("key", "rows"))
    mixed = cut_unsized(named.join(F.broadcast(size) if size.count() <= SMALL else size, "key"))
    done_with(size)
    return mixed


def _sparse(mixed: DataFrame, clusters: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of different components that share a small bucket, each once; written.

    Buckets lie together in sorted partitions and are compared within numpy. A pair counts in the
    first table that it shares. Pairs within a dense cluster are left to _dense.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            key = t.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            rest = t.slice(last)
            yield compare(t.slice(0, last))
        if rest is not None:
            yield compare(rest)

    def compare(t: pa.Table) -> pa.RecordBatch:
        found: list[np.ndarray] = [np.empty((0, 2), np.int64)]
        t = t.combine_chunks()
        key, ids, n, part, cluster = (t.column(c).to_numpy() for c in ("key", "id", "n", "component", "cluster"))
        mh = np.concatenate([_minhashes(c) for c in t.column("mh").chunks] or [np.empty((0, 2 * SIDE * TUPLE), np.uint16)])
        keys = tuples = None
        for gap in range(1, min(LARGE, len(key))):
            a = np.flatnonzero(key[gap:] == key[:-gap])
            if not len(a):
                break
            b = a + gap
            ok = (part[a] != part[b]) & ((cluster[a] != cluster[b]) | (cluster[a] < 0)) & (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent)
            a, b = a[ok], b[ok]
            for at in range(0, len(a), 1 << 16):
                x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                near = (mh[x] == mh[y]).sum(axis=1) >= LEAST_EQUAL
                x, y = x[near], y[near]
                same = _tuples(mh[x]) == _tuples(mh[y])
                table = same[:, 0].argmax(axis=1) * SIDE + same[:, 1].argmax(axis=1)
                first = table_keys(mh[x])[np.arange(len(x)), table] == key[x] if len(x) else np.empty(0, bool)
                found.append(np.stack([np.minimum(ids[x], ids[y])[first], np.maximum(ids[x], ids[y])[first]], axis=1))
        pairs = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    rows = mixed.where(F.col("rows") <= LARGE).join(clusters, "id", "left").join(reps.select("id", "n", "mh"), "id")
    rows = rows.select("key", "id", "component", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "n", "mh")
    return cut_unsized(rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long"))


def _dealt(rows: DataFrame, block: int, own: bool = False) -> DataFrame:
    """Rows of (cluster, id, ...) in every pair of blocks (i, j) that their own block is part of; with itself alone, if so asked."""
    sizes = rows.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(sizes) if sizes.count() <= SMALL else sizes, "cluster")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.col("block") if own else F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")


def _forest(t: pa.Table, percent: int) -> pa.Table:
    """A spanning forest of the pairs of different components that many LONG minhashes agree on, between two blocks."""
    block, ids, part, n = (t.column(c).to_numpy() for c in ("block", "id", "component", "n"))
    m = np.frombuffer(b"".join(t.column("m").to_pylist()), np.uint16).reshape(len(ids), LONG)
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    tree, edges = np.arange(len(ids)), []
    for x in left:
        fits = right[(part[right] != part[x]) & (np.minimum(n[right], n[x]) * 100 >= np.maximum(n[right], n[x]) * percent)]
        fits = fits[(m[fits] == m[x]).sum(axis=1) >= LONG_EQUAL]
        other, first = np.unique(tree[fits], return_index=True)
        for k, y in zip(other, fits[first], strict=True):
            if k != tree[x]:
                edges.append((int(ids[x]), int(ids[y])))
                tree[tree == k] = tree[x]
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _links(t: pa.Table, percent: int) -> pa.Table:
    """A spanning forest of the links of different components between two blocks: all intersections at once, as products of 0/1 matrices."""
    block, ids, part = (t.column(c).to_numpy() for c in ("block", "id", "component"))
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("s")]
    sizes = np.array([len(s) for s in sets], np.int64)
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner, code = owner[shared], (np.cumsum(count > 1) - 1)[code[shared]]
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int((count > 1).sum()), SLAB):
        some = (code >= at) & (code < at + SLAB)
        m = np.zeros((len(sets), SLAB), np.float32)
        m[owner[some], code[some] - at] = 1
        both += m[left] @ m[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    linked = 100.0 * both >= percent * union
    # rows of one component are one tree from the start, so an edge is given only where it joins two components
    tree, edges = np.unique(part, return_inverse=True)[1], []
    for x, row in zip(left, linked, strict=True):
        fits = right[row & (tree[right] != tree[x])]
        other, first = np.unique(tree[fits], return_index=True)
        for k, y in zip(other, fits[first], strict=True):
            edges.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
            tree[tree == k] = tree[x]
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _dense(docs: DataFrame, clusters: DataFrame, labels: DataFrame, links: DataFrame, words: int, percent: int) -> DataFrame:
    """More links (a, b), between different components of a dense cluster, confirmed on full sets; written.

    A common passage ties many documents into one cluster that are far from similar. So LONG
    minhashes, small beside the sets, are compared first, block by block; each task gives a spanning
    forest of what may be similar, which names every document that has a possible partner. Only the
    sets of those are then dealt into blocks: first each block is compared with itself, then, with the
    components that this makes, each with the others. A task gives a spanning forest over components, so
    the own blocks give a link a document at most, and two blocks one for each component that is left in them.
    """
    named = clusters.join(labels, "id", "left").select("cluster", "id", F.coalesce("component", "id").alias("component"))
    sets = cut_unsized(_sets(docs, clusters.select("id"), words, long=True))
    rows = cut_unsized(named.join(sets.select("id", "m", (F.octet_length("s") / 8).cast("long").alias("n")), "id"))
    forest = cut_unsized(_dealt(rows, WIDE).groupBy("cluster", "i", "j").applyInArrow(lambda t: _forest(t, percent), "a long, b long"))
    done_with(rows)
    met = forest.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    rows = cut_unsized(clusters.join(met, "id", "left_semi").join(sets.select("id", "s"), "id"))
    done_with(forest, sets)
    compare = lambda dealt: cut_unsized(dealt.groupBy("cluster", "i", "j").applyInArrow(lambda t: _links(t, percent), "a long, b long"))
    labelled = lambda by: rows.join(by, "id", "left").withColumn("component", F.coalesce("component", "id"))
    own = compare(_dealt(labelled(labels), BLOCK, own=True))
    far = _dealt(rows, BLOCK).where("i < j").limit(1).count()
    if far:
        known = components(links.union(own))
        far = compare(_dealt(labelled(known), BLOCK).where("i < j"))
        done_with(known)
        own = own.union(far)
    done_with(rows)
    return own


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    A-Z count as a-z, words are runs without ASCII white space, a document's set holds its distinct
    shingles of `words` words, or the whole sequence if it has fewer. Documents are linked if
    100 * intersection >= percent * union; component_id is the smallest doc_id that links lead to, and
    the document with that doc_id is kept.

    Equal sets are one representative. Its minhashes are put into SIDE**2 tables, each keyed by a tuple
    of the one collection and one of the other. Every member of a bucket is set against a head of the
    bucket (see members), and the links that full sets confirm form components. Then members of one bucket that are
    still in different components are set against each other: those of small buckets pair by pair (see
    _sparse), those of large ones in blocks (see _dense). Links within a component change nothing and
    aren't looked for, so a large group of near copies costs a link each and not a pair each.

    A null or empty text, or one of white space, has no shingles, is linked with nothing and kept. Rows that share a
    doc_id are one document: it has the links of all its texts, and n_shingles is the size of the largest of their sets. A row
    with a null doc_id is given with a null component, linked with nothing and kept. Other columns are ignored. An empty table
    gives no rows. Memory follows one text or one batch.
    """
    docs = only(bounded_batches(docs), "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = cut_unsized(signatures(docs, words))
    docs = docs.where("doc_id is not null")
    full = signed.where("n > 0 and doc_id is not null")
    reps = cut_unsized(full.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), F.min("mh").alias("mh")))
    tied = members(reps)
    pairs = tied.where("id <> first").select(F.least("first", "id").alias("a"), F.greatest("first", "id").alias("b")).distinct()
    worth = _worth(pairs, reps, percent)
    links = confirm(docs, worth, words, percent)
    done_with(worth)
    twice = cut_unsized(full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id"))
    if twice.limit(1).count():
        links = links.union(full.join(twice, "doc_id", "left_semi").join(reps.select("f1", "f2", "id"), ["f1", "f2"]).where("doc_id <> id").selectExpr("id as a", "doc_id as b"))
    labels = components(links)
    mixed = _mixed(tied, labels)
    done_with(tied)
    clusters = components(mixed.where(F.col("rows") > LARGE).select(F.col("first").alias("a"), F.col("id").alias("b")).where("a <> b"))
    clusters = clusters.withColumnRenamed("component", "cluster")
    worth = _sparse(mixed, clusters, reps, percent)
    done_with(mixed)
    more = confirm(docs, worth, words, percent)
    done_with(worth)
    if clusters.limit(1).count():
        more = more.union(_dense(docs, clusters, labels, links.union(more), words, percent))
    if more.limit(1).count():
        labels = components(links.union(more))
    of = reps.join(labels, "id", "left").select("f1", "f2", F.coalesce("component", "id").alias("component_id"))
    found = signed.where("doc_id is not null").join(of, ["f1", "f2"], "left")
    found = found.groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min(F.when(F.col("n") > 0, F.col("component_id"))).alias("component_id"))
    found = found.withColumn("component_id", F.coalesce("component_id", "doc_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = signed.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return found.unionByName(nameless)


def drop_near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents with all their columns, one of each group of near duplicates; rows that share a doc_id stay or go together."""
    gone = cut_unsized(near_groups(docs, words, percent).where("not kept").select("doc_id"))
    return docs.join(F.broadcast(gone) if gone.count() <= SMALL else gone, "doc_id", "left_anti").select(*docs.columns)
