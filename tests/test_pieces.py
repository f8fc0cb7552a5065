"""Detections stored by piece: no shuffle after them, other frames are refused."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framewise.operators import chunks
from framewise.sources import pieces


@pytest.fixture
def ball(spark):
    rows = [(v, f, None if f % 7 == 3 else float(f * v), 1.0) for v in range(3) for f in range(100)]
    return spark.createDataFrame(rows, "video_id long, frame long, x double, y double")


def exchanges(df, plan="Exchange hashpartitioning"):
    return df._jdf.queryExecution().executedPlan().toString().count(plan)


def test_windows_of_stored_pieces_need_no_exchange(spark, ball, tmp_path):
    path = str(tmp_path / "ball")
    pieces.write_pieces(ball, path, size=16)
    stored = pieces.read_pieces(spark, path, ball)
    w = chunks.asc()
    stepped = stored.withColumn("step", F.col("x") - F.lag("x").over(w)).withColumn("n", F.count("x").over(chunks.so_far(w)))
    assert exchanges(stepped) == 0 and exchanges(ball.withColumn("_chunk", F.lit(0)).withColumn("n", F.count("x").over(w))) == 1
    by_piece = stored.groupBy("video_id", "_chunk").agg(F.sum("x").alias("total"))
    assert exchanges(stepped.join(by_piece.hint("merge"), ["video_id", "_chunk"])) == 0
    want = ball.withColumn("_chunk", F.floor(F.col("frame") / 16))
    want = want.withColumn("n", F.count("x").over(Window.partitionBy("video_id", "_chunk").orderBy("frame")))
    key = ("video_id", "frame", "x", "_chunk", "n")
    assert sorted(map(str, stepped.select(*key).collect())) == sorted(map(str, want.select(*key).collect()))


def test_a_store_of_other_frames_is_refused(spark, ball, tmp_path):
    path = str(tmp_path / "ball")
    made = []

    def compute():
        made.append(1)
        return ball

    load = lambda frames, **how: pieces.load_or_compute(spark, path, frames, compute, size=16, **how)
    frames = ball.select("video_id", "frame")
    load(frames)
    assert load(frames).count() == 300 and made == [1]
    assert load(frames.union(frames.limit(5)).orderBy(F.desc("frame"))).count() == 300
    longer = frames.union(spark.sql("SELECT 2L, 100L"))
    swapped = frames.filter("NOT (video_id = 1 AND frame = 4)").union(spark.sql("SELECT 1L, 100L"))
    for other in (longer, swapped, frames.filter("frame < 50"), frames.limit(0)):
        with pytest.raises(pieces.StaleStore, match="was made for 300 frames"):
            load(other)
    assert made == [1] and load(longer, read_stored=False).count() == 300 and made == [1, 1]
    assert load(longer).count() == 300
    with pytest.raises(pieces.StaleStore, match="no column z"):
        pieces.read_pieces(spark, path, longer, columns=["x", "z"])
    with pytest.raises(FileNotFoundError):
        pieces.read_pieces(spark, str(tmp_path / "nothing"))
    assert pieces.load_or_compute(spark, None, frames, compute).count() == 300


def test_frames_without_a_detection_are_covered_and_empty_tables_too(spark, ball, tmp_path):
    frames = ball.select("video_id", "frame")
    some = pieces.write_pieces(ball.filter("x IS NOT NULL AND frame > 20"), str(tmp_path / "some"), frames, size=16)
    assert some.count() == pieces.read_pieces(spark, str(tmp_path / "some"), frames).count() > 0
    pieces.write_pieces(ball.limit(0), str(tmp_path / "none"), frames.limit(0))
    assert pieces.read_pieces(spark, str(tmp_path / "none"), frames.limit(0)).columns == [*ball.columns, "_chunk"]


def test_a_write_that_ends_halfway_leaves_what_was_there(spark, ball, tmp_path):
    path = str(tmp_path / "ball")
    pieces.write_pieces(ball, path, size=16)
    broken = ball.withColumn("x", F.when(F.col("frame") == 50, F.raise_error(F.lit("lost"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        pieces.write_pieces(broken, path, size=16)
    assert pieces.read_pieces(spark, path, ball).count() == 300
