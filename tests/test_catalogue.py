"""Each query of the catalogue gives the rows of its SQL."""

import os

import duckdb
import pytest

from kgspark.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    base = duckdb.connect()
    for name in os.listdir(SF):
        base.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{SF}/{name}'")
    return base


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    expected = sorted(oracle.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall(), key=str)
    assert got == expected


def test_shared_scan(spark):
    """Branches over one table are one scan."""
    plan = QUERIES["multi_pom_expansion"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_columns_are_pruned(spark):
    plan = QUERIES["source_table"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<n_nationkey:int,n_name:string>" in plan
    assert "IsNotNull(n_name)" in plan
