"""Every query of the reference's operators against its DuckDB SQL, values and columns."""

import os
from collections import Counter

import duckdb
import pytest

from tessera.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(map(str, r)) for r in df.select(cols).collect())
    sql = catalogue.ORACLE_SQL.get(name)
    if sql:
        rel = duck.sql(sql)
        assert sorted(rel.columns) == cols
        want = Counter(tuple(map(str, r)) for r in duck.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())
        assert sum(got.values()) == sum(want.values())
        assert got == want
