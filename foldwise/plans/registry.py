"""What the query modules fill: names, queries and their SQL; and SQL of the shared frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PANEL = "s as (select user_id as series_id, event_id, event_type, ts, value as y, row_number() over (partition by user_id order by ts, event_id) - 1 as idx from events)"
FC = f"""{PANEL}, f0 as (select *, lag(y) over (partition by series_id order by idx) as p_last, lag(y, 7) over (partition by series_id order by idx) as p_week,
  avg(y) over (partition by series_id order by idx rows between 7 preceding and 1 preceding) as p_mean7, avg(y) over (partition by series_id order by idx rows between unbounded preceding and 1 preceding) as p_all from s), f as (select * from f0 where idx >= 7)"""
DAILY = "d0 as (select o_orderdate::date as day, sum(o_totalprice) as y from orders group by 1), s as (select day, y, row_number() over (order by day) - 1 as idx from d0)"


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    """Register a query, with SQL where SQL can say it."""
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})
