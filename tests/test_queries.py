"""Every registered query that has SQL gives the same rows in DuckDB."""

from pathlib import Path

import pandas as pd
import pytest

from varispark.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(x) -> str:
    if x is None or (isinstance(x, float) and pd.isna(x)) or x is pd.NA:
        return "~"
    if isinstance(x, (bool,)) or type(x).__name__ == "bool_":
        return str(bool(x))
    if isinstance(x, str):
        return x
    return f"{float(x):.6f}".replace("-0.000000", "0.000000")


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
