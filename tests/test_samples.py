"""The ball table that all sample tables come from."""

import contextlib
import io

from pyspark.sql import functions as F

from framewise.sources.samples import Samples

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_the_ball_table_is_numbered_once(spark):
    text = plan(Samples(spark, SF).ball)
    assert "events.parquet" not in text and "Window" not in text


def test_frames_are_numbered_in_time_order_across_buckets(spark):
    got = Samples(spark, SF).ball.groupBy("video_id").agg(F.count("*").alias("n"), F.countDistinct("frame").alias("d"), F.max("frame").alias("m"))
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in got.collect())
