"""Rows of the same frame on streams."""

from framewise import schema
from framewise.streaming import tracks
from tests.test_streaming import feed, state_store  # noqa: F401

ROWS = [(0, 0, 0.0, 0.0), (0, 1, 500.0, 0.0), (0, 1, 10.0, 0.0), (0, 2, 60.0, 0.0)]


def test_all_rows_of_a_frame_are_taken_in_a_defined_order(spark, state_store):  # noqa: F811
    want = [(0, 0, 0.0, 0.0, 1), (0, 1, 10.0, 0.0, 1), (0, 1, 500.0, 0.0, 2), (0, 2, 60.0, 0.0, 3)]
    batches = [spark.createDataFrame([r], schema.BALL) for r in (ROWS[1], ROWS[3], ROWS[2], ROWS[0])]
    assert feed(spark, tracks.ball_segments, batches) == (want, 0)
