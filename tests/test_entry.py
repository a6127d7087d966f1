"""Every query with SQL agrees with it on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from orogen.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "supplier customer part orders events documents embeddings labels".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    cursor = duck.execute(SQL[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == names
    at = [found.index(n) for n in names]
    want = sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == want


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_projection_returns(spark):
    from pyspark.sql import functions as F

    df = QUERIES["crs_round_trip"](spark, SF)
    assert df.filter((F.abs(F.col("lat") - F.col("lat2")) > 1e-7) | (F.abs(F.col("lon") - F.col("lon2")) > 1e-7)).count() == 0
