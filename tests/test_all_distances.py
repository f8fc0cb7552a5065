"""The sorted list of distances has all tracks, however many."""

from framewise.operators import select


def test_over_a_hundred_tracks(spark):
    boxes = [(0, 0, k, k, float(k), 0.0, k + 2.0, 10.0) for k in range(130)]
    players = spark.createDataFrame(boxes, "video_id long, frame long, det_idx int, track_id int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(0, 0, 0, 1.0, 1.0)], "video_id long, frame long, kp_idx int, x double, y double")
    ranks = sorted(r["rank"] for r in select.choose_players(players, points, k=None).collect())
    assert ranks == list(range(1, 131))
