"""Every query with SQL against DuckDB over the smallest tables, and the others for rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from foldwise.plans import all_oracles, all_queries

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no tables")
#: Queries that have no rows on the smallest tables.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(f"{v:.7g}") if isinstance(v, float) else v


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    # numbers sort alike whether a column came as whole numbers or not
    key = lambda r: repr([float(v) if isinstance(v, int) else v for v in r])
    return sorted([tuple(map(plain, r)) for r in df.itertuples(index=False)], key=key)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_equals_sql(spark, db, name):
    got, want = all_queries()[name](spark, str(SF)).toPandas(), db.sql(all_oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or (isinstance(u, float | int) and isinstance(v, float | int) and math.isclose(u, v, rel_tol=1e-5, abs_tol=1e-3)), (x, y)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_gives_rows(spark, name):
    df = all_queries()[name](spark, str(SF))
    assert df.columns and (name in MAY_BE_EMPTY or df.limit(1).count() == 1)
