"""Labels shared with the frame before: dealt once, and right at the borders of pieces."""

import re

import pytest
from pyspark.sql import functions as F

from framewise.catalog import QUERIES
from framewise.operators.select import labels_of_frame_before

SCHEMA = "video_id long, frame long, kp_idx int"


@pytest.mark.parametrize("size", [1, 2, 3, 65536])
def test_as_an_intersection(spark, size):
    rows = [(v, f, k) for v in (0, 1, None) for f in range(9) for k in (0, 1, None) if (f + (k or 5)) % (3 + (v or 0)) or f == 4]
    df = spark.createDataFrame([*rows, rows[0], rows[5]], SCHEMA)
    want = df.intersect(df.withColumn("frame", F.col("frame") + 1)).collect()
    assert len(want) > 15
    got = labels_of_frame_before(df, size=size).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_the_query_deals_its_labels_once(spark):
    import framewise.catalog as catalog

    catalog.load()
    df = QUERIES["o4_common_labels"](spark, "/root/testdata/sf0.001")
    assert len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString())) == 1
