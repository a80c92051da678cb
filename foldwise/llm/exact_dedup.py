"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.shared import cut, done_with, only

#: Code points whose hash forms the second key.
PREFIX = 256
#: Tables of at most so many rows of 16 to 56 bytes are broadcast (after they were counted); larger ones are joined by shuffle.
SMALL = 200_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _length() -> Column:
    return F.octet_length(_text())


def _head(prefix: int) -> Column:
    return F.xxhash64(F.substring(_text(), 1, prefix))


def _full() -> Column:
    return F.unhex(F.sha2(_text(), 256))


def _alive(docs: DataFrame, prefix: int) -> DataFrame:
    """(n, h, alive) of the lengths and prefix hashes that two rows or more have; written.

    Lengths and prefixes are counted in one pass, by partial sums; a prefix that occurs once, and so each length that occurs
    once, is ruled out.
    """
    seen = docs.select(_length().alias("n"), _head(prefix).alias("h")).groupBy("n", "h").agg(F.count(F.lit(1)).alias("c"))
    return cut(seen.where("c > 1").select("n", "h", F.lit(True).alias("alive")))


def _decided(rows: DataFrame) -> DataFrame:
    """(n, s, keep, group_size) of the groups of two or more among rows (n, s, doc_id, row); written.

    Rows are partly aggregated before they are moved, so a hot group costs a row a task.
    """
    groups = rows.groupBy("n", "s").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return cut(groups.where("group_size > 1"))


def exact_dedup(docs: DataFrame, prefix: int = PREFIX, digests: bool = False) -> DataFrame:
    """Every row with its decision: (doc_id, keep_id, group_size, kept, text_sha256).

    Rows are grouped by byte length and the hash of a prefix; only rows that share both with another row are hashed in full
    and grouped by that. Of equal texts the row with the largest doc_id stays, exactly one even where rows repeat whole;
    keep_id is its doc_id. text_sha256 is null for rows that were ruled out before, unless `digests` asks for all of them.

    Nulls count as empty texts. A null doc_id is below all others, and such rows are rows like others. Other columns are
    ignored. An empty table gives no rows. The table is read twice. Without `digests` and with more than SMALL prefixes
    alive, texts are moved once to meet them; else no text is moved.
    """
    docs = only(docs, "doc_id", "text")
    alive = _alive(docs, prefix)
    light = docs.select("doc_id", _length().alias("n"), _head(prefix).alias("h"), (_full() if digests else F.col("text")).alias("text"))
    met = light.join(_few(alive), ["n", "h"], "left")
    s = F.col("text") if digests else F.when(F.col("alive"), _full())
    rows = cut(met.select("doc_id", "n", s.alias("s"), F.coalesce("alive", F.lit(False)).alias("alive"), F.monotonically_increasing_id().alias("row")))
    done_with(alive)
    groups = _decided(rows.where("alive"))
    met = rows.join(_few(groups), ["n", "s"], "left")
    return met.select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("s")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """The rows that stay, with all their columns. See exact_dedup.

    A row is decided where it is read, by the table of groups. Only where the doc_id that stays stands on several
    rows of its group, one of them (which one isn't defined) is taken by aggregation.
    """
    n, s, keep, ties = (f"_foldwise_{c}" for c in ("n", "s", "keep", "ties"))
    plain = only(docs, "doc_id", "text")
    alive = _alive(plain, prefix)
    light = plain.select("doc_id", _length().alias("n"), _head(prefix).alias("h"), "text").join(_few(alive), ["n", "h"])
    counted = light.groupBy("n", _full().alias("s"), "doc_id").agg(F.count(F.lit(1)).alias("c"))
    groups = counted.groupBy("n", "s").agg(F.max(F.struct("doc_id", "c")).alias("last"), F.sum("c").alias("all")).where("all > 1")
    groups = cut(groups.select(F.col("n").alias(n), F.col("s").alias(s), F.col("last.doc_id").alias(keep), F.col("last.c").alias(ties)))
    done_with(alive)
    # a length that no group has spares the full hash
    lengths = cut(groups.select(n).distinct().withColumn("_foldwise_known", F.lit(True)))
    met = docs.withColumn(n, _length()).join(_few(lengths), n, "left").withColumn(s, F.when(F.col("_foldwise_known"), _full()))
    met = met.join(_few(groups), [n, s], "left").where(F.col(ties).isNull() | F.col("doc_id").eqNullSafe(F.col(keep)))
    names = [F.col(f"`{c}`") for c in docs.columns]
    one = met.where(F.coalesce(F.col(ties), F.lit(1)) == 1).select(*names)
    several = met.where(F.col(ties) > 1).groupBy(n, s).agg(F.first(F.struct(*names)).alias("r")).select("r.*")
    return one.unionByName(several) if len(set(docs.columns)) == len(docs.columns) else one.union(several)
