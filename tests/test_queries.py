"""Every registered query against its SQL twin, on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import TABLES, normal

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    if name not in entry.oracle_sql():
        assert len(got.columns) > 0
        return
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry(spark):
    layers = {r["layer"] for r in entry.entry(spark).select("layer").distinct().collect()}
    assert {"keypoint", "ball", "player", "frame_number", "bounce", "map_ball", "map_player", "map_bounce", "court"} == layers
