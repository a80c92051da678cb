"""The queries opN_<name> over the driver's tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import bpe as _bpe
from foldwise.llm import exact_dedup as _exact
from foldwise.llm import langid as _langid
from foldwise.llm import line_dedup as _lines
from foldwise.llm import mixing as _mixing
from foldwise.llm import near_dedup as _near
from foldwise.llm import pii as _pii
from foldwise.llm import training_order as _order
from foldwise.llm import va_topk as _va
from foldwise.llm import warc as _warc
from foldwise.llm.shared import fresh_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(table(spark, sf_dir, "documents"), digests=True)


ORACLES["op7_exact_dedup"] = """
with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       row_number() over (partition by text_sha256 order by doc_id desc nulls last) = 1 as kept, text_sha256
from d window g as (partition by text_sha256)
"""


def rank_file() -> tuple[str, str]:
    """Place of the rank file and the pattern that goes with it; the package is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = rank_file()
    return _bpe.encode(table(spark, sf_dir, "documents"), path, pattern, digested=True)


@query
def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.coalesce(_langid.fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind, of="base": F.size(F.filter(of, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in _pii.BASE], F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"), count("secret", "spans"), F.size("spans").cast("long").alias("n_spans"))


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near.near_groups(table(spark, sf_dir, "documents"), words=2)


@query
def op8_va_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _va.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


ORACLES["op8_va_topk"] = """
with ok as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, c.r as cand, case when len(c.v) = 0 then 0 else list_inner_product(q.v, c.v) end::bigint as score
      from ok q join ok c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by r order by score desc, vec_id, cand)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warc.derive(_warc.responses(table(spark, sf_dir, "pages")))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines.remove_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


ORACLES["op5_line_dedup"] = _lines.ORACLE


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = _mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", _mixing.words(F.col("text")).alias("n_words"), "epoch", "order_key")


ORACLES["op6_mixing"] = _mixing.ORACLE


@query
def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "training-order")
    layout = _order.materialise(_order.byte_tokens(table(spark, sf_dir, "documents")), path)
    offset = (F.col("slot") % layout.shard_rows) * layout.stride
    ids = F.substring("ids", F.lit(1), (F.col("n_tokens") * layout.width).cast("int"))
    return _order.read(spark, path).select("slot", "shard", offset.alias("byte_offset"), "doc_id", "seq_no", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"))
