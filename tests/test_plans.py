"""Each plan against its SQL on the smallest tables."""

import duckdb
import pytest

from lattice.plans import PLANS
from lattice.plans.fixed_oracle import FIXED_ORACLE
from lattice.plans.oracle import ORACLE

SF = "/root/testdata/sf0.001"
SQL = ORACLE | FIXED_ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_plan(spark, duck, name):
    df = PLANS[name](spark, SF)
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(dict(zip(rel.columns, r, strict=True))[c] for c in columns) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_plan_without_sql(spark, name):
    assert PLANS[name](spark, SF).count() > 0
