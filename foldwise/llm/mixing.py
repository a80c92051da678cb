"""Mixing sources to target weights by temperature; DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldwise.llm.shared import cut, only

#: Sources of at most this number are weighed on the driver (after they were counted), more by aggregation.
SMALL = 100_000
#: Bisection steps, and hex digits of a permutation key that form its bucket.
STEPS, DIGITS = 50, 3
#: How far the entropy is lifted from that of the shares to that of equal weights, and how often a source may repeat.
LIFT, MAX_REPEATS = 0.5, 4.0


def words(text: Column) -> Column:
    """The number of runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def bisect(high: Callable[[float], bool]) -> float:
    """The exponent in [0, 1] at which `high` (too even for it) turns from true to false."""
    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if high(mid) else (lo, mid)
    return (lo + hi) / 2


class Shares:
    """Sums over the sources' token shares p: on the driver for few sources, else one small job each."""

    def __init__(self, stats: DataFrame) -> None:
        """stats: written rows (source, tokens) with tokens > 0."""
        self.stats, self.n = stats, stats.count()
        self.total = stats.agg(F.sum("tokens")).first()[0] or 0
        self.p = sorted(r["tokens"] / self.total for r in stats.select("tokens").collect()) if self.n <= SMALL else None

    def entropy(self, a: float) -> float:
        """Of weights in proportion to p ** a: log z - a * sum(p ** a log p) / z."""
        if self.p is not None:
            z, s = math.fsum(x**a for x in self.p), math.fsum(x**a * math.log(x) for x in self.p)
        else:
            p = F.col("tokens") / F.lit(self.total)
            z, s = self.stats.agg(F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p))).first()
        return math.log(z) - a * s / z

    def repeats(self, a: float, budget: float) -> float:
        """How often the most repeated source is taken: budget * p ** a / (z * tokens), greatest for the smallest p if a <= 1."""
        if self.p is not None:
            z, least = math.fsum(x**a for x in self.p), self.p[0]
        else:
            p = F.col("tokens") / F.lit(self.total)
            z, least = self.stats.agg(F.sum(F.pow(p, F.lit(a))), F.min(p)).first()
        return budget * least ** (a - 1) / z / self.total

    def z(self, a: float) -> float:
        if self.p is not None:
            return math.fsum(x**a for x in self.p)
        return self.stats.agg(F.sum(F.pow(F.col("tokens") / F.lit(self.total), F.lit(a)))).first()[0]


def exponent(shares: Shares, budget: float, target_entropy: float | None = None, max_repeats: float | None = None) -> float:
    """The smallest exponent whose weights are no more even than asked for: entropy at most target_entropy,
    and no source taken more than max_repeats times. 1 (the shares themselves) if even that is too even."""
    a = 0.0
    if target_entropy is not None:
        a = bisect(lambda x: shares.entropy(x) > target_entropy)
    if max_repeats is not None and shares.repeats(a, budget) > max_repeats:
        a = max(a, bisect(lambda x: shares.repeats(x, budget) > max_repeats))
    return a


def _order(seed: str, epoch: Column) -> Column:
    """A document's place in the permutation of a block."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.col("doc_id").cast("string")))


def plan(docs: DataFrame, tokens: Column | None = None, budget: int | None = None, lift: float = LIFT, max_repeats: float = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """(source, tokens, quota, epochs, last_key) of every source that has tokens; written.

    Weights are the token shares to the power found by `exponent`; a quota is the weight's part of the
    budget (all tokens there are, if none is given). It buys `epochs` whole blocks, each a permutation
    of the source's documents, and of one more block the documents up to last_key (none if null) in its permutation.

    That key is found without ordering a source: token sums of DIGITS-digit buckets of the
    permutation give the bucket in which the quota ends, and only that bucket's rows are ordered. A
    hot source is many buckets, each one row a task.
    """
    light = only(docs, "doc_id", "source", "text").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), (words(F.col("text")) if tokens is None else tokens).alias("n"))
    light = cut(light)
    stats = cut(light.groupBy("source").agg(F.sum("n").alias("tokens")).where("tokens > 0"))
    shares = Shares(stats)
    if not shares.n:
        return cut(stats.select("source", "tokens", F.col("tokens").alias("quota"), F.col("tokens").alias("epochs"), F.lit(None).cast("string").alias("last_key")))
    budget = shares.total if budget is None else budget
    own = shares.entropy(1.0)
    a = exponent(shares, budget, own + lift * (math.log(shares.n) - own), max_repeats)
    weight = F.pow(F.col("tokens") / F.lit(shares.total), F.lit(a)) / F.lit(shares.z(a))
    quotas = stats.withColumn("quota", F.round(weight * budget).cast("long"))
    quotas = cut(quotas.withColumn("epochs", F.floor(F.col("quota") / F.col("tokens"))).withColumn("left", F.col("quota") - F.col("epochs") * F.col("tokens")))
    few = F.broadcast(quotas) if shares.n <= SMALL else quotas
    keyed = light.join(few.select("source", "epochs", "left"), "source").where("left > 0").withColumn("key", _order(seed, F.col("epochs")))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, DIGITS))
    sums = keyed.groupBy("source", "bucket", "left").agg(F.sum("n").alias("s"))
    upto = sums.withColumn("upto", F.sum("s").over(Window.partitionBy("source").orderBy("bucket")))
    whole = upto.where(F.col("upto") <= F.col("left")).groupBy("source").agg(F.max("upto").alias("before"), F.max("bucket").alias("full"))
    ends = upto.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min("bucket").alias("end"))
    edge = cut(quotas.select("source", "left").join(whole, "source", "left").join(ends, "source", "left"))
    few = F.broadcast(edge) if shares.n <= SMALL else edge
    ordered = keyed.drop("left").join(few, "source").where(F.col("bucket") == F.col("end"))
    ordered = ordered.withColumn("upto", F.coalesce("before", F.lit(0)) + F.sum("n").over(Window.partitionBy("source").orderBy("key")))
    within = ordered.where(F.col("upto") <= F.col("left")).groupBy("source").agg(F.max("key").alias("within"))
    # every key of a full bucket is below its digits followed by a letter beyond f
    last = edge.join(within, "source", "left").select("source", F.coalesce("within", F.concat("full", F.lit("g"))).alias("last_key"))
    return cut(quotas.join(last, "source", "left").select("source", "tokens", "quota", "epochs", "last_key"))


def mix(docs: DataFrame, tokens: Column | None = None, budget: int | None = None, lift: float = LIFT, max_repeats: float = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """The documents as often as the mixture takes them, with all their columns, and epoch and order_key.

    Sorted by (epoch, order_key) the rows are the blocks one after another, each a permutation over
    all sources. See plan. A null source is the source of empty name; sources without a word get no
    rows. Documents without words cost nothing and come with every block. Rows that share a doc_id
    share a place and come together. An empty table gives no rows. Columns epoch and order_key of the input are replaced.
    A row's copies are made where it is read; nothing but the plan is moved.
    """
    made = plan(docs, tokens, budget, lift, max_repeats, seed).select(F.col("source").alias("_foldwise_source"), F.col("epochs").alias("_foldwise_epochs"), F.col("last_key").alias("_foldwise_last"))
    few = F.broadcast(made) if made.count() <= SMALL else made
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("epoch", "order_key")]
    met = docs.select(*names, F.coalesce("source", F.lit("")).alias("_foldwise_key")).join(few, F.col("_foldwise_key") == F.col("_foldwise_source"))
    more = F.coalesce((_order(seed, F.col("_foldwise_epochs")) <= F.col("_foldwise_last")).cast("long"), F.lit(0))
    copies = F.col("_foldwise_epochs") + more
    met = met.where(copies > 0).select(*names, F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))).alias("epoch"))
    return met.withColumn("order_key", _order(seed, F.col("epoch")))


#: The same in DuckDB, over documents.
ORACLE = f"""
with recursive l as (select doc_id, coalesce(source, '') as src, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as n from documents),
s as (select src, sum(n)::bigint as tokens from l group by src having sum(n) > 0),
p as (select src, tokens, tokens::double / (select sum(tokens) from s)::double as p from s),
own as (select -sum(p * ln(p)) as h, ln(count(*)) as most, (select sum(tokens) from s)::double as total from p),
goal as (select h + {LIFT} * (most - h) as h, total from own),
e(i, lo, hi) as (select 0, 0.0::double, 1.0::double union all
  select i + 1, case when (select ln(sum(p ** ((lo + hi) / 2))) - (lo + hi) / 2 * sum(p ** ((lo + hi) / 2) * ln(p)) / sum(p ** ((lo + hi) / 2)) from p) > (select h from goal) then (lo + hi) / 2 else lo end,
         case when (select ln(sum(p ** ((lo + hi) / 2))) - (lo + hi) / 2 * sum(p ** ((lo + hi) / 2) * ln(p)) / sum(p ** ((lo + hi) / 2)) from p) > (select h from goal) then hi else (lo + hi) / 2 end
  from e where i < {STEPS}),
r(i, lo, hi) as (select 0, 0.0::double, 1.0::double union all
  select i + 1, case when (select min(p) ** ((lo + hi) / 2 - 1) / sum(p ** ((lo + hi) / 2)) from p) > {MAX_REPEATS} then (lo + hi) / 2 else lo end,
         case when (select min(p) ** ((lo + hi) / 2 - 1) / sum(p ** ((lo + hi) / 2)) from p) > {MAX_REPEATS} then hi else (lo + hi) / 2 end
  from r where i < {STEPS}),
a as (select case when (select min(p) ** ((e.lo + e.hi) / 2 - 1) / sum(p ** ((e.lo + e.hi) / 2)) from p) > {MAX_REPEATS} then greatest((e.lo + e.hi) / 2, (r.lo + r.hi) / 2) else (e.lo + e.hi) / 2 end as a
      from e, r where e.i = {STEPS} and r.i = {STEPS}),
q as (select src, tokens, round(p ** (select a from a) / (select sum(p ** (select a from a)) from p) * (select total from goal))::bigint as quota from p),
b as (select src, tokens, quota // tokens as epochs, quota - quota // tokens * tokens as rest from q),
k as (select l.doc_id, l.source, l.src, l.n, b.epochs, b.rest, md5('mix:' || b.epochs || ':' || l.doc_id) as key from l join b using (src)),
w as (select *, sum(n) over (partition by src order by key) as upto from k)
select doc_id, source, n as n_words, epoch::int as epoch, md5('mix:' || epoch || ':' || doc_id) as order_key from (
  select doc_id, source, n, unnest(range(0, epochs + case when rest > 0 and upto <= rest then 1 else 0 end)) as epoch from w)
"""
