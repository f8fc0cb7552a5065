"""Steps that several queries share: how often tables are dealt, and that their results stay."""

import contextlib
import io

from framewise import catalog
from framewise.operators import camera, chunks, geometry, select
from framewise.sources.samples import Samples

catalog.load()
SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_points_of_a_frame_are_collected_after_they_are_dealt(spark):
    lines = plan(camera.camera_moved(Samples(spark, SF).kps_seen, size=8)).splitlines()
    for at, line in enumerate(lines):
        if "partial_collect_list" in line:
            assert "REPARTITION_BY_COL" in lines[at + 1]
            break
    else:
        raise AssertionError("no list is collected")


def test_previous_row_across_pieces_and_keys(spark):
    rows = [(0, f, f * 10) for f in (0, 3, 4, 17, 18, 40)] + [(1, 5, 1), (1, 90, 2)]
    df = spark.createDataFrame(rows, "video_id long, frame long, v long")
    got = {(r["video_id"], r["frame"]): r["prev_v"] for r in chunks.previous_row(df, ["v"], size=4).collect()}
    assert got == {(0, 0): None, (0, 3): 0, (0, 4): 30, (0, 17): 40, (0, 18): 170, (0, 40): 180, (1, 5): None, (1, 90): 1}


def test_displacement_skips_points_without_a_coordinate(spark):
    rows = [(0, f, k, None if (f, k) == (1, 2) else float(f + k), 0.0) for f in (0, 1) for k in range(4)]
    court = spark.createDataFrame(rows, "video_id long, frame long, kp_idx int, x double, y double")
    got = camera.displacement(court).collect()
    assert [(r["frame"], r["mse"], r["n_common"]) for r in got] == [(1, 0.5, 4)]


def test_latest_value_over_pieces_without_updates(spark):
    frames = spark.createDataFrame([(v, f) for v in (0, 1) for f in range(0, 40, 3)], "video_id long, frame long")
    news = spark.createDataFrame([(0, 4, 1.0), (0, 5, 2.0), (0, 6, None), (0, 30, 3.0)], "video_id long, frame long, m double")
    got = {(r["video_id"], r["frame"]): r["m"] for r in camera.latest_value(frames, news, "m", size=4).collect()}
    assert got == {(v, f): None if v or f < 4 else 3.0 if f >= 30 else 2.0 for v in (0, 1) for f in range(0, 40, 3)}


def test_spots_of_a_frame_are_collected_after_they_are_dealt(spark):
    t = Samples(spark, SF)
    lines = plan(select.nearest_court_point(t.track, t.kps_seen)).splitlines()
    at = next(i for i, line in enumerate(lines) if "partial_collect_list" in line)
    assert "REPARTITION_BY_COL" in lines[at + 1]


def test_points_of_moved_frames_are_found_once(spark):
    t = Samples(spark, SF)
    assert "collect_list" not in plan(camera.refreshed_homography(t.flat, t.frames, size=64))


def test_fits_of_all_points_are_made_once(spark):
    both = plan(catalog.QUERIES["g4_matrix_of_all_points"](spark, SF))
    assert "kp_idx" not in both and "smallest_eigenvector" not in both


def test_normal_matrix_from_its_different_sums(spark):
    import numpy as np

    r = np.random.default_rng(2)
    at = np.c_[r.uniform(0, 1280, (9, 2)), np.ones(9)]
    h = np.array([[0.9, 0.2, 30], [-0.1, 1.1, -20], [1e-4, 2e-4, 1]])
    to = at @ h.T
    to = to[:, :2] / to[:, 2:] + r.normal(0, 0.5, (9, 2))
    pairs = spark.createDataFrame([(0, 0, *map(float, (*a[:2], *b))) for a, b in zip(at, to)], "video_id long, frame long, x double, y double, map_x double, map_y double")

    def unit(p):
        scale = np.sqrt(p.var(axis=0).sum())
        return np.array([[1 / scale, 0, -p[:, 0].mean() / scale], [0, 1 / scale, -p[:, 1].mean() / scale], [0, 0, 1]])

    ts, td = unit(at[:, :2]), unit(to)
    a, b = at @ ts.T, np.c_[to, np.ones(9)] @ td.T
    rows = [[*p, 0, 0, 0, *(-q[0] * p)] for p, q in zip(a, b)] + [[0, 0, 0, *p, *(-q[1] * p)] for p, q in zip(a, b)]
    want = np.linalg.inv(td) @ np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3) @ ts
    got = geometry.fit_homography(pairs).first()
    assert got["n_points"] == 9 and np.allclose(np.array(got["h"]).reshape(3, 3), want / want[2, 2], rtol=1e-6, atol=1e-9)
