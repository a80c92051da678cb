"""Boilerplate lines by the number of distinct sites that carry them; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.shared import cut, only

#: Sites from which on a line is boilerplate.
MIN_SITES = 10
#: log2 of a sketch's registers, and the standard errors that count as near the threshold.
LG_K, ERRORS = 12, 3.0
#: Tables of at most so many rows of two numbers are broadcast (after they were counted); larger ones are joined by shuffle.
SMALL = 1_000_000

KEY = ("h", "g")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> list[Column]:
    """96 bits of a line."""
    return [F.xxhash64(line).alias("h"), F.hash(line).alias("g")]


def _among(df: DataFrame, keys: DataFrame) -> DataFrame:
    """df's rows whose line is in keys, which has been written already."""
    return df.join(F.broadcast(keys) if keys.count() <= SMALL else keys, list(KEY), "left_semi")


def line_sites(docs: DataFrame, site: str = "source") -> DataFrame:
    """(doc_id, whole, site, pos, h, g): every line that isn't blank, with its place and a hash of its text."""
    texts = only(docs, "doc_id", "text", site).select("doc_id", F.xxhash64("text").alias("whole"), F.col(f"`{site}`").alias("site"), _lines(F.col("text")).alias("lines"))
    rows = texts.select("doc_id", "whole", "site", F.posexplode("lines").alias("pos", "line"))
    return rows.where(F.trim("line") != "").select("doc_id", "whole", "site", "pos", *_key(F.col("line")))


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(h, g) of the lines on at least `min_sites` distinct sites; written.

    A line must occur that often and on two sites at least to be looked at. A HyperLogLog sketch of
    the sites of each such line is built in every task and merged by aggregation. Lines whose estimate is clear of the
    threshold are decided by it; those near it get an exact distinct count. So a hot line is one row a
    task in both shuffles.
    """
    lines = line_sites(docs, site).select("site", *KEY)
    common = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("c"), F.min("site").alias("a"), F.max("site").alias("b"))
    common = cut(common.where((F.col("c") >= min_sites) & ((F.col("a") != F.col("b")) | F.lit(min_sites <= 1))).select(*KEY))
    sketched = _among(lines, common).groupBy(*KEY).agg(F.hll_sketch_agg(F.col("site").cast("string"), LG_K).alias("s"))
    spread = cut(sketched.select(*KEY, F.hll_sketch_estimate("s").alias("sites")))
    slack = ERRORS * 1.04 / 2 ** (LG_K / 2) * min_sites + 1
    near = cut(spread.where(F.abs(F.col("sites") - min_sites) <= slack).select(*KEY))
    exact = _among(lines, near).groupBy(*KEY).agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites).select(*KEY)
    return cut(spread.where(F.col("sites") > min_sites + slack).select(*KEY).unionByName(exact))


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The documents with all their columns, boilerplate lines taken out of `text`, and n_lines and n_removed.

    Lines are parted by newlines and equal if they are the same code points. Blank lines stay. Every document loses its
    boilerplate, however much of it that is; one without other lines is left an empty text. Null sites count as no site. Null
    texts stay null, with no lines. A null doc_id is a doc_id like others, and rows that share one are told apart by their
    texts. Repeated rows are treated alike. An empty table gives no rows. Columns n_lines and n_removed of the input
    are replaced. The text is moved once, to meet the places of the lines that its document loses; that takes time
    linear in its lines.
    """
    plate = boilerplate(docs, site, min_sites)
    lost = _among(line_sites(docs, site), plate).groupBy(F.col("doc_id").alias("_foldwise_doc"), F.col("whole").alias("_foldwise_of")).agg(F.collect_set("pos").alias("_foldwise_gone"))
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    met = docs.withColumn("_foldwise_whole", F.xxhash64("text")).join(lost, F.col("doc_id").eqNullSafe(F.col("_foldwise_doc")) & (F.col("_foldwise_whole") == F.col("_foldwise_of")), "left")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text"))))
    met = met.withColumn("_foldwise_lines", F.when(F.col("_foldwise_gone").isNotNull(), _lines(F.col("text"))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_foldwise_lines") - 1), F.col("_foldwise_gone"))
    rest = F.array_join(F.transform(kept, lambda i: F.get("_foldwise_lines", i)), "\n")
    return met.select(
        *[F.col(f"`{c}`") for c in names],
        F.when(F.col("_foldwise_gone").isNotNull(), rest).otherwise(F.col("text")).alias("text"),
        n.cast("long").alias("n_lines"),
        F.when(F.col("_foldwise_gone").isNotNull(), F.size("_foldwise_gone")).otherwise(0).cast("long").alias("n_removed"),
    )


#: The same in DuckDB, over documents.
ORACLE = f"""
with l as (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null),
plate as (select line from l where trim(line) <> '' group by line having count(distinct source) >= {MIN_SITES}),
k as (select l.doc_id, count(*) as n, count(plate.line) as gone,
        coalesce(string_agg(l.line, chr(10) order by pos) filter (where plate.line is null), '') as rest
      from l left join plate on l.line = plate.line group by l.doc_id)
select d.doc_id, k.rest as text, coalesce(k.n, 0)::bigint as n_lines, coalesce(k.gone, 0)::bigint as n_removed from documents d left join k using (doc_id)
"""
