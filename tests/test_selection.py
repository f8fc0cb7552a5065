import pytest
from framewise import schema
from framewise.operators import camera, geometry, insights, overlay, select
from framewise.sources import contracts, tables


def boxes(spark, rows):
    """Rows (video, frame, det_idx, track_id, cls, x1)."""
    return spark.createDataFrame([(*r[:5], float(r[5]), 0.0, r[5] + 10.0, 20.0) for r in rows], schema.PLAYERS)


def court(spark, rows):
    return spark.createDataFrame([(v, f, k, float(x), float(y)) for v, f, k, x, y in rows], schema.KEYPOINTS)


def test_boxes_after_an_unidentified_one_are_dropped(spark):
    df = boxes(spark, [(0, 0, 0, 1, "person", 0), (0, 0, 1, None, "racket", 1), (0, 0, 2, 3, "person", 2), (0, 1, 0, 5, "person", 3)])
    got = sorted((r["frame"], r["det_idx"]) for r in select.before_unidentified(df).collect())
    assert got == [(0, 0), (1, 0)]


def test_the_last_box_of_a_track_wins_at_the_place_of_the_first(spark):
    df = boxes(spark, [(0, 0, 0, 1, "person", 5), (0, 0, 1, 2, "person", 6), (0, 0, 2, 1, "person", 7)])
    got = sorted((r["track_id"], r["det_idx"], r["x1"]) for r in select.player_boxes(df).collect())
    assert got == [(1, 0, 7.0), (2, 1, 6.0)]


def test_fewer_players_than_wanted_give_fewer_rows(spark):
    df = boxes(spark, [(0, 0, 0, 4, "person", 0), (0, 5, 0, 9, "person", 0)])
    chosen = select.choose_players(df, court(spark, [(0, 0, 0, 1, 1)]))
    assert [r["track_id"] for r in chosen.collect()] == [4]
    kept = select.keep_tracks(df, chosen)
    assert [(r["frame"], r["track_id"]) for r in kept.collect()] == [(0, 4)]


def test_equal_distances_go_by_order_of_appearance(spark):
    df = boxes(spark, [(0, 0, 0, 9, "person", 0), (0, 0, 1, 3, "person", 0), (0, 0, 2, 1, "person", 0)])
    chosen = select.choose_players(df, court(spark, [(0, 0, 0, 1, 1)]))
    assert sorted(r["track_id"] for r in chosen.collect()) == [3, 9]


def test_a_missing_ball_counts_as_the_origin(spark, track):
    df = boxes(spark, [(0, 0, 0, 1, "person", 500), (0, 0, 1, 2, "person", 0)])
    near = select.nearest_player(df, track([(None, None)]), clamp=None).first()
    assert near["track_id"] == 2
    assert select.nearest_player(df, track([(None, None)])).first()["track_id"] == 1


def test_nearest_court_point_by_either_metric(spark, track):
    points = court(spark, [(0, 0, 0, 0, 0), (0, 0, 2, 100, 10), (0, 0, 5, 100, 11)])
    ball = track([(100, 4)])
    assert select.nearest_court_point(ball, points).first()["kp_idx"] == 0
    assert select.nearest_court_point(ball, points, metric="euclid").first()["kp_idx"] == 2
    with pytest.raises(ValueError):
        select.nearest_court_point(ball, points, metric="other")


def test_every_point_keeps_its_row(spark, track):
    """Equal points stay two rows; without an allowed court point the place is NULL."""
    ball = track([(100, 4), (1, 1)])
    twice = ball.filter("frame = 0").unionByName(ball)
    got = select.nearest_court_point(twice, court(spark, [(0, 0, 0, 0, 0), (0, 1, 5, 0, 0)]))
    assert sorted((r["frame"], r["kp_idx"]) for r in got.collect()) == [(0, 0), (0, 0), (1, None)]


def test_everyone_is_placed_on_the_mini_court(spark, track):
    df = boxes(spark, [(0, 0, 0, 1, "person", 0), (0, 0, 1, 7, "person", 300), (0, 1, 0, 7, "person", 0)])
    points = court(spark, [(0, 0, 0, 0, 0)])
    placed = geometry.players_on_mini_court(df, points, {1: 2.0}).collect()
    assert sorted((r["frame"], r["track_id"], r["dx_m"] is not None) for r in placed) == [(0, 1, True), (0, 7, False), (1, 7, False)]
    ball = track([(310, 0), (5, 5), (None, None)])
    for clamp, known in ((None, []), (1, [0])):
        on_map = geometry.ball_on_mini_court(df, ball, points, {1: 2.0}, clamp=clamp).collect()
        assert sorted(r["frame"] for r in on_map) == [0, 1, 2]
        assert [r["frame"] for r in on_map if r["map_x"] is not None] == known


def test_every_flagged_frame_with_four_points_has_a_matrix(spark):
    """Corners may be missing; the other points decide."""
    where = geometry.court_map_points()
    rows = [(0, f, k, 0.5 * where[k][0] + 30 * f, 0.25 * where[k][1]) for f in range(4) for k in (range(14) if f % 2 else (0, 1, 2, 3, 12))]
    frames = spark.createDataFrame([(0, f) for f in range(6)], "video_id long, frame long")
    held = camera.refreshed_homography(court(spark, rows), frames, size=2).orderBy("frame").collect()
    assert [r["fitted_at"] for r in held] == [0, 1, 2, 3, 3, 3]
    assert [r["h"][2] for r in held] == pytest.approx([-60.0 * r["fitted_at"] for r in held], abs=1e-6)
    sampled = camera.sampled_homography(court(spark, rows), frames, 2, 1).orderBy("frame").collect()
    assert [r["fitted_at"] for r in sampled] == [None, 1, 1, 3, 3, 3]


def test_frames_keep_their_numbers_and_pass_without_a_mask(track):
    ball = track([(1, 1)] * 5)
    assert select.game_time(ball).count() == 5
    kept = select.game_time(ball, ball.filter("frame > 2"))
    assert sorted(r["frame"] for r in kept.collect()) == [3, 4]
    assert sorted(r["frame"] for r in select.keyframes(ball, 3).collect()) == [1, 4]


def test_coverage_names_each_problem(track):
    frames = track([(1, 1)] * 4).select("video_id", "frame")
    rows = track([(1, 1)] * 6).filter("frame <> 1 AND frame <> 4")
    rows = rows.unionByName(rows.filter("frame = 3"))
    got = sorted((r["frame"], r["n_rows"], r["problem"]) for r in contracts.coverage(frames, rows).collect())
    assert got == [(1, 0, "missing"), (3, 2, "duplicate"), (5, 1, "unknown_frame")]


def test_point_lists_survive_the_way_back(spark):
    rows = [(1, 2), (None, None), (3, 4)]
    ball = tables.points_table(spark, rows)
    pieces = sorted((r["piece"], r["points"]) for r in tables.point_arrays(ball, size=2).collect())
    assert pieces == [(0, [[1.0, 2.0], [None, None]]), (1, [[3.0, 4.0]])]


def test_track_map_has_one_entry_per_track(spark):
    df = select.player_boxes(boxes(spark, [(0, 0, 0, 1, "person", 5), (0, 0, 1, 2, "person", 6)]))
    assert sorted(tables.as_track_map(df).first()["boxes"]) == [1, 2]


def test_stored_detections_are_read_and_not_computed_again(spark, track):
    path = tables.work_folder(spark, "test")
    ball = track([(1, 1), (None, None)])
    tables.load_or_compute(spark, path, lambda: ball)
    again = tables.load_or_compute(spark, path, lambda: pytest.fail("computed again"))
    assert again.count() == 2
    fresh = tables.load_or_compute(spark, path, lambda: track([(1, 1)]), read_stored=False)
    assert fresh.count() == 1


def test_a_filter_on_the_frame_reaches_the_files(spark, track):
    path = tables.work_folder(spark, "pushed")
    tables.write_detections(track([(1, 1)] * 50), path)
    plan = tables.read_detections(spark, path, schema.BALL).filter("frame = 3").select("x")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(frame,3)" in text and "y:double" not in text


POINTS = [(0, 0), (100, 0), (0, 100), (100, 100), (50, 50)]


def test_camera_moves_on_first_frame_large_shift_and_few_common_points(spark):
    rows = [(0, 0, k, x, y) for k, (x, y) in enumerate(POINTS)]
    rows += [(0, 1, k, x + 1, y) for k, (x, y) in enumerate(POINTS)]  # small shift
    rows += [(0, 2, k, x + 1, y) for k, (x, y) in enumerate(POINTS[:2])]  # too few points: skipped
    rows += [(0, 3, k, x + 9, y) for k, (x, y) in enumerate(POINTS)]  # large shift against frame 1
    rows += [(0, 4, k + 3, x + 9, y) for k, (x, y) in enumerate(POINTS)]  # other labels
    got = sorted(tuple(r)[1:] for r in camera.camera_moved(court(spark, rows), size=2).collect())
    assert got == [(0, None, True), (1, 0.5, False), (3, 32.0, True), (4, None, True)]


@pytest.mark.parametrize("size", [2, 100])
def test_latest_value_takes_updates_at_or_before(spark, size):
    rows = spark.createDataFrame([(0, f) for f in range(8)] + [(1, 0)], "video_id long, frame long")
    news = spark.createDataFrame([(0, 2, 5.0), (0, 5, None), (0, 6, 7.0)], "video_id long, frame long, v double")
    got = sorted((r["video_id"], r["frame"], r["v"]) for r in camera.latest_value(rows, news, "v", size=size).collect())
    assert [g[2] for g in got] == [None, None, 5.0, 5.0, 5.0, 5.0, 7.0, 7.0, None]


def test_least_squares_recovers_an_exact_matrix(spark):
    quad = [(745, 350), (1720, 350), (470, 1070), (2010, 1060)]
    known = geometry.frame_homography(court(spark, [(0, 0, k, x, y) for k, (x, y) in zip((4, 6, 5, 7), quad)]))
    more = court(spark, [(0, 0, k, x, y) for k, (x, y) in enumerate([*quad, (900, 700), (1300, 500), (1100, 950)])])
    pairs = geometry.project_points(more, known.drop("frame"))
    fitted = geometry.fit_homography(pairs).first()
    assert fitted["n_points"] == 7
    assert fitted["h"] == pytest.approx(known.first()["h"], rel=1e-6, abs=1e-9)


def test_fewer_than_four_pairs_give_no_matrix(spark):
    pairs = geometry.with_map_positions(court(spark, [(0, 0, k, k, k) for k in range(3)]))
    assert geometry.fit_homography(pairs).count() == 0


def test_a_ball_at_zero_is_not_drawn(track):
    ball = track([(0, 5), (None, None), (3, 4)])
    assert [(r["x"], r["layer"]) for r in overlay.ball_layer(ball).collect()] == [(3.0, "ball")]


def test_vanished_ball(track):
    ball = track([(None, None), (1, 1), (None, None), (None, None), (2, 2), (3, 3), (None, None)])
    got = [tuple(r) for r in insights.vanished(ball, size=2).collect()]
    assert got == [(0, 1, 4, 2)]


def test_distance_run_over_gaps_in_a_track(spark):
    df = boxes(spark, [(0, 0, 0, 1, "person", 0), (0, 9, 0, 1, "person", 3), (0, 10, 0, 1, "person", 3), (0, 3, 0, 2, "person", 0)])
    got = sorted((r["track_id"], r["path_px"], r["n_frames"]) for r in insights.distance_run(df, size=4).collect())
    assert got == [(1, 3.0, 3), (2, 0.0, 1)]
