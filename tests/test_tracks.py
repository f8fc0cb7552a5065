"""Track operators against small cases and against plain loops, with long and with short pieces."""

import functools
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.operators import bounce, chunks, fill, folds, hits, quantiles, turning, windows

NONE = (None, None)


def random_points(seed, n, span=300, missing=0.25, zero=0.0, step=None):
    rnd = random.Random(seed)
    x, y, out = span / 2, span / 2, []
    for _ in range(n):
        if step:
            x, y = x + rnd.randint(-step, step), y + rnd.randint(-step, step)
        else:
            x, y = rnd.randint(1, span), rnd.randint(1, span)
        u = rnd.random()
        out.append(NONE if u < missing else (0.0, float(y)) if u < missing + zero else (float(x), float(y)))
    return out


def xs(values):
    return [(v, v) for v in values]


# --- filling -----------------------------------------------------------------------------


@pytest.mark.parametrize("size", [2, 3, chunks.CHUNK])
def test_interpolation_keeps_a_leading_gap_and_repeats_the_last_value(track, points, size):
    ball = track(xs([None, 1, None, None, 10, None]), xs([None, None]))
    assert points(fill.interpolate(ball, size=size)) == [xs([None, 1, 4, 7, 10, 10]), xs([None, None])]
    assert points(fill.interpolate(ball, backward=True, size=size)) == [xs([1, 1, 4, 7, 10, 10]), xs([None, None])]
    assert points(fill.back_fill(ball, size=size))[0] == xs([1, 1, 10, 10, 10, None])
    assert points(fill.forward_fill(ball, size=size))[0] == xs([None, 1, 1, 1, 10, 10])


def test_columns_are_filled_on_their_own(track, points):
    ball = track([(None, 1), (2, None), (None, None), (4, 7)])
    assert points(fill.interpolate(ball, size=1)) == [[(None, 1), (2, 3), (3, 5), (4, 7)]]


def test_moving_average_skips_missing_values(track, points):
    got = windows.moving_average(track(xs([None, None, 4, None])), ["x"], window=2, size=2)
    assert points(got, "x_ma") == [[(None,), (None,), (4.0,), (4.0,)]]


def spread(kind, n):
    """Distinct values that lie in one 1/4096 of an octave, evenly or at one end of it."""
    k = F.col("id")
    if kind == "even":
        return 1 + k * (2.0**-13 / n)
    return F.when(k == 0, 1 + 2.0**-13).otherwise(1 + k * (2.0**-26 / n))


@pytest.mark.parametrize("kind", ["even", "at one end"])
def test_quantile_of_values_in_one_range(spark, kind):
    """A million values in the range of the first level: what is left to sort is small, after a level more also where they crowd."""
    n = 1_000_000
    df = spark.range(n).select(F.floor(F.col("id") % 10 / 9).alias("video_id"), spread(kind, n).alias("x"))
    left = quantiles.narrowed(df, "x", 0.95, levels=2 if kind == "even" else 3)
    assert (left.groupBy("video_id").count().agg({"count": "max"}).first()[0] or 0) <= n // 500
    got = dict(quantiles.quantile(df, "x", 0.95).collect())
    values = df.toPandas()
    for video, own in values.groupby("video_id")["x"]:
        assert got[video] == np.quantile(own, 0.95)


def test_quantile_of_few_values(spark):
    rows = [(1, 5.0), (2, None), (3, -1.0), (3, -1.0), (3, 2.0), (4, 0.0), (4, -0.0), (5, -3.0), (5, -8.0), (5, 1e300), (5, 5e-324)]
    df = spark.createDataFrame(rows, "video_id long, x double")
    for q in (0.0, 0.3, 0.5, 0.95, 1.0):
        got = dict(quantiles.quantile(df, "x", q).collect())
        assert got == {v: np.quantile([x for w, x in rows if w == v], q) for v in (1, 3, 4, 5)}


def test_quantile_is_linear_between_ranks(track):
    df = track(xs([1, 2, 3, 4]), xs([5]), xs([0, 0, 0, -8, None]))
    got = {r["video_id"]: r["quantile"] for r in quantiles.quantile(df, "x", 0.95).collect()}
    assert got == {0: pytest.approx(3.85), 1: 5.0, 2: 0.0}


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e9])
@pytest.mark.parametrize("q", [0.0, 0.3, 0.95, 1.0])
def test_quantile_equals_the_sorted_list(track, scale, q):
    rnd = random.Random(q)
    values = [rnd.gauss(0, scale) for _ in range(200)] + [scale] * 50
    got = quantiles.quantile(track(xs(values)), "x", q).first()["quantile"]
    rank = q * (len(values) - 1)
    low, high = sorted(values)[math.floor(rank)], sorted(values)[math.ceil(rank)]
    assert got == pytest.approx(low + (high - low) * (rank - math.floor(rank)), rel=1e-12)


def test_a_row_at_the_threshold_is_masked(track, points):
    df = track(xs([1, 2, 3, 4])).withColumn("distance", F.lit(7.0))
    assert points(fill.mask_outliers(df)) == [xs([None] * 4)]


def filled_by_loop(points, mode, window=5, q=0.95):
    """The fill rule in plain Python."""
    n = len(points)

    def means(i):
        return [
            (lambda v: sum(v) / len(v) if v else None)([p[c] for p in points[max(0, i - window + 1) : i + 1] if p[c] is not None])
            for c in (0, 1)
        ]

    ma = [means(i) for i in range(n)]
    zero = lambda v: 0.0 if v is None else v
    dist = []
    for i in range(n):
        shifted_x = ma[i - 1][0] if i else None
        shifted_y = ma[i + 1][1] if i + 1 < n else None
        dist.append((zero(ma[i][0]) - zero(shifted_x)) ** 2 + (zero(ma[i][1]) - zero(shifted_y)) ** 2)
    ordered, rank = sorted(dist[1:]), q * (n - 2)
    low, high = ordered[math.floor(rank)], ordered[math.ceil(rank)]
    t = rank - math.floor(rank)
    limit = low + (high - low) * t if t < 0.5 else high - (high - low) * (1 - t)
    raw = [tuple(zero(v) for v in p) if mode == "compat" else p for p in points]
    masked = [p if d < limit else NONE for p, d in zip(raw, dist)]
    out = []
    for c in (0, 1):
        known = [(i, p[c]) for i, p in enumerate(masked) if p[c] is not None]
        col = []
        for i in range(n):
            before = [k for k in known if k[0] <= i]
            after = [k for k in known if k[0] >= i]
            if before and after and after[0][0] != before[-1][0]:
                (pi, pv), (ni, nv) = before[-1], after[0]
                col.append(round((nv - pv) / (ni - pi) * (i - pi) + pv))
            else:
                col.append(round((before[-1:] or after[:1])[0][1]))
        out.append(col)
    return list(zip(*out))


@pytest.mark.parametrize("mode", ["compat", "strict"])
@pytest.mark.parametrize("size", [7, chunks.CHUNK])
def test_fill_ball_equals_the_loop(track, points, mode, size):
    videos = [random_points(s, 60, span=900) for s in range(3)]
    got = points(fill.fill_ball(track(*videos), mode=mode, size=size))
    assert got == [filled_by_loop(v, mode) for v in videos]


def test_compat_mode_leaves_unmasked_missing_points_at_zero(track, points):
    ball = [(10.0, 10.0)] * 20 + [NONE] + [(10.0, 10.0)] * 20 + [(900.0, 900.0)] + [(10.0, 10.0)] * 20
    compat, strict = (points(fill.fill_ball(track(ball), mode=m))[0] for m in ("compat", "strict"))
    assert compat[20] == (0, 0) and strict[20] == (10, 10)


# --- turning points ----------------------------------------------------------------------


def turns_by_loop(ys, min_changes=25):
    n, ahead = len(ys), int(min_changes * 1.2)
    known = [(i, y) for i, y in enumerate(ys) if y is not None]
    if not known:
        return []
    full = []
    for i in range(n):
        before, after = [k for k in known if k[0] <= i], [k for k in known if k[0] >= i]
        if not before or not after:
            full.append((before[-1:] or after[:1])[0][1])
        elif before[-1][0] == i:
            full.append(ys[i])
        else:
            (pi, pv), (ni, nv) = before[-1], after[0]
            full.append((nv - pv) / (ni - pi) * (i - pi) + pv)
    ma = [sum(full[max(0, i - 4) : i + 1]) / len(full[max(0, i - 4) : i + 1]) for i in range(n)]
    delta = [None] + [b - a for a, b in zip(ma, ma[1:])]
    out = []
    for i in range(1, n - ahead):
        sign = (delta[i] > 0) - (delta[i] < 0)
        nxt = delta[i + 1]
        if sign * nxt < 0 and sum(1 for d in delta[i + 1 : i + ahead + 1] if sign * d < 0) >= min_changes:
            out.append(i)
    return out


def wave(seed, n):
    rnd = random.Random(seed)
    period = rnd.choice([64, 100, 128])
    ys = [float(8 * abs(i % period - period // 2)) for i in range(n)]
    return [NONE if rnd.random() < 0.1 else (y, y) for y in ys]


@pytest.mark.parametrize("size", [40, chunks.CHUNK])
def test_turning_points_equal_the_loop(track, size):
    videos = [wave(s, 300) for s in range(4)] + [wave(9, 30), [NONE] * 40, [(1.0, 1.0)] * 100]
    got = {(r["video_id"], r["frame"]) for r in turning.turning_points(track(*videos), size=size).collect()}
    want = {(v, f) for v, p in enumerate(videos) for f in turns_by_loop([y for _, y in p])}
    assert got == want and want


# --- bounces -----------------------------------------------------------------------------


def last_risers(scores, threshold):
    """The rule in words: in each run of rows over the threshold, the last one that is larger than the row before
    it, the run's first row counting as larger."""
    runs = [list(group) for over, group in itertools.groupby(enumerate(scores), key=lambda p: (p[1] or 0) > threshold) if over]
    larger = [[run[0], *(b for a, b in itertools.pairwise(run) if b[1] > a[1])] for run in runs]
    return [risers[-1][0] for risers in larger]


@pytest.mark.parametrize("size", [3, chunks.CHUNK])
def test_run_suppression_keeps_the_last_riser(spark, size):
    rnd = random.Random(1)
    videos = [[0.9, 0.5, 0.6], [0.9], [0.1], [0.5, None, 0.6, 0.9], [None]]
    videos += [[rnd.choice([None, 0.1, 0.5, 0.6, 0.7]) for _ in range(60)] for _ in range(8)]
    frames = [sorted(rnd.sample(range(200), len(v))) for v in videos]  # neighbours are rows, not frame numbers
    rows = [(v, f, s) for v, scores in enumerate(videos) for f, s in zip(frames[v], scores)]
    df = spark.createDataFrame(rows, "video_id long, frame long, score double")
    got = sorted((r["video_id"], r["frame"]) for r in bounce.suppress_runs(df, size=size).collect())
    want = sorted((v, frames[v][i]) for v, scores in enumerate(videos) for i in last_risers(scores, 0.45))
    assert got == want


def test_features_leave_out_rows_with_a_missing_neighbour(track):
    ball = xs([1, 2, 4, 8, None, 3, 4, 5, 6, 9])
    got = bounce.bounce_features(track(ball), size=4).collect()
    assert [r["frame"] for r in got] == [7]
    assert (got[0]["x_diff_1"], got[0]["y_diff_1"], got[0]["y_diff_inv_2"]) == (1.0, -1.0, 4.0)


# --- folds -------------------------------------------------------------------------------


class Extrapolated:
    """The rule in words, from the end of a track: what a row is after filling, by what the rows before it are.

    A row that is missing or 0 is filled if it isn't the last, the five rows before it are there and at most two rows
    before it were filled in a row. It goes one step on from the two before. A row that follows a filled one is lost
    if it lies more than 80 from that; a lost row counts as missing.
    """

    def __init__(self, points):
        self.points = points
        self.row = functools.cache(self._row)

    def _row(self, i):
        """(point, how many rows up to this one were filled in a row)."""
        point = self.points[i]
        if i and point[0]:
            before, filled = self.row(i - 1)
            if filled and math.dist(before, point) > 80:
                point = NONE
        if i < 5 or i == len(self.points) - 1 or point[0]:
            return point, 0
        earlier = [self.row(k) for k in range(i - 5, i)]
        streak = earlier[-1][1]
        if streak == 3 or any(p[0] is None for p, _ in earlier):
            return point, 0
        (ax, ay), (bx, by) = earlier[-2][0], earlier[-1][0]
        return (bx + (bx - ax), by + (by - ay)), streak + 1

    def all(self):
        return [self.row(i)[0] for i in range(len(self.points))]


def test_a_short_gap_is_extrapolated(track, points):
    assert points(folds.smooth_gaps(track(xs([10, 12, 14, 16, 18, None, 22])))) == [xs([10, 12, 14, 16, 18, 20, 22])]


@pytest.mark.parametrize("size", [12, 16, 50, chunks.CHUNK])
def test_extrapolation_follows_the_rule(track, points, size):
    videos = [random_points(s, 200, 600, missing=m, zero=z, step=d) for s, (m, z, d) in enumerate(
        [(0.05, 0.0, 20), (0.1, 0.05, 40), (0.3, 0.0, 60), (0.02, 0.02, 150), (0.15, 0.0, 90), (0.0, 0.0, 5), (1.0, 0.0, 5)])]
    got = points(folds.smooth_gaps(track(*videos), size=size))
    assert got == [Extrapolated(v).all() for v in videos]


@pytest.mark.parametrize("step", [9, 150])
def test_a_periodic_gap_is_cut_into_many_parts(track, points, step):
    """Each sixth point missing: no long run, yet the fold may start after most gaps of a steady track."""
    steady = [p if i % 6 else NONE for i, p in enumerate(random_points(4, 300, 600, missing=0, step=step))]
    ball = track(steady)
    assert points(folds.smooth_gaps(ball, size=32)) == [Extrapolated(steady).all()]
    safe = folds.safe_starts(ball, size=32).filter("safe").count()
    assert safe > 40 if step == 9 else safe < 40


def test_half_a_point_is_a_missing_point(track, points):
    ball = xs([10, 12, 14, 16, 18]) + [(19.0, None)] + xs([22]) + [(None, 3.0)]
    assert points(folds.smooth_gaps(track(ball))) == [xs([10, 12, 14, 16, 18, 20, 22, None])]


def gated_by_loop(points, radius, inclusive, start):
    last, out = start, []
    for p in points:
        near = p != NONE and (last is None or (math.dist(p, last) <= radius if inclusive else math.dist(p, last) < radius))
        if near:
            last = p
        out.append(p if near else NONE)
    return out


GATED = [random_points(s, 120, span, missing=0.2, step=d) for s, (span, d) in enumerate([(300, None), (900, None), (400, 30), (4000, None)])]
GATED += [[NONE] * 30, [NONE] * 20 + [(5.0, 5.0)] * 20]


@pytest.mark.parametrize("size", [4, 32, chunks.CHUNK])
def test_gated_track_equals_the_loop(track, points, size):
    got = points(folds.follow_first_point(track(*GATED), size=size))
    assert got == [gated_by_loop(v, 100, True, None) for v in GATED]


@pytest.mark.parametrize("size", [4, 32, chunks.CHUNK])
def test_main_ball_starts_at_the_mean_and_drops_the_first_frame(track, points, size):
    def want(v):
        seen = [p for p in v if p != NONE]
        mean = tuple(sum(c) / len(seen) for c in zip(*seen)) if seen else None
        return gated_by_loop([NONE, *v[1:]], 80, False, mean)

    got = points(folds.choose_main_ball(track(*GATED), size=size))
    assert got == [want(v) for v in GATED]


def hits_by_loop(dists, radius):
    nearest, out = radius, []
    for f, d in dists:
        if d < radius:
            if d < nearest:
                nearest = d
                out.append(f)
        else:
            nearest = radius
    return out


@pytest.mark.parametrize("size", [3, chunks.CHUNK])
def test_approach_hits_equal_the_loop(spark, track, size):
    rnd = random.Random(3)
    videos = [[NONE if rnd.random() < 0.1 else (float(rnd.randint(0, 90)), 0.0) for _ in range(80)] for _ in range(3)]
    # Nose and body 100 apart: the radius is 65 on side 0. One long stay that never leaves the circle.
    videos.append([(60.0 - 0.5 * (i % 70), 0.0) for i in range(80)])
    hands = [(v, f, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 100.0) for v, p in enumerate(videos) for f in range(len(p))]
    hands = spark.createDataFrame(
        hands, "video_id long, frame long, side int, hx double, hy double, nose_x double, nose_y double, body_x double, body_y double")
    got = sorted((r["video_id"], r["frame"]) for r in hits.approach_hits(track(*videos), hands, size=size).collect())
    want = [(v, f) for v, p in enumerate(videos) for f in hits_by_loop([(f, q[0]) for f, q in enumerate(p) if q != NONE], 65)]
    assert got == sorted(want)


def thinned_by_loop(hits, n_frames):
    stack, pending = [], list(hits)
    for f in range(n_frames):
        while pending and pending[0][0] == f:
            stack.append(pending.pop(0))
        if len(stack) >= 2 and math.dist(stack[-1][2:], stack[-2][2:]) < 200:
            del stack[-2]
    return stack


@pytest.mark.parametrize("size", [10, 64, chunks.CHUNK])
def test_thinning_equals_the_loop(spark, size):
    rnd = random.Random(5)
    videos = [
        sorted((f, side, float(rnd.randint(0, span)), float(rnd.randint(0, span)))
               for f in rnd.sample(range(300), k) for side in rnd.choice([(0,), (1,), (0, 1)]))
        for k, span in ((20, 300), (60, 300), (100, 500), (150, 250), (1, 10))
    ]
    rows = [(v, *h) for v, hs in enumerate(videos) for h in hs]
    df = spark.createDataFrame(rows, "video_id long, frame long, side int, x double, y double")
    frames = spark.createDataFrame([(v, f) for v in range(len(videos)) for f in (0, 299)], "video_id long, frame long")
    got = sorted(tuple(r) for r in folds.thin_hits(df, frames, size=size).select("video_id", "frame", "side", "x", "y").collect())
    assert got == sorted((v, *h) for v, hs in enumerate(videos) for h in thinned_by_loop(hs, 300))


def points_of(rnd, n, span, fraction=True):
    at = (lambda: rnd.uniform(0, span)) if fraction else (lambda: float(rnd.randint(0, span)))
    return [NONE if rnd.random() < 0.2 else (at(), at()) for _ in range(n)]


def test_exits_say_where_any_state_ends():
    rnd = random.Random(7)
    for span, n in ((100, 200), (600, 200), (30000, 300)):
        pts = points_of(rnd, n, span)
        states = [(rnd.uniform(-50, span + 50), rnd.uniform(-50, span + 50)) for _ in range(100)]
        rows = [(None, k, *s) for k, s in enumerate(states)] + [(f, None, *p) for f, p in enumerate(pts)]
        found = {r[0]: r[3:] for r in folds.exits(80.0, False)(iter(rows))}
        ends = set(folds.live_ends(80.0, False)(iter(pts)))
        for k, state in enumerate(states):
            kept = [p for p in gated_by_loop(pts, 80, False, state) if p != NONE]
            assert found.get(k) == (kept[-1] if kept else None)
            assert not kept or kept[-1] in ends


@pytest.mark.parametrize("x", [300.0, 20000.0])
def test_few_ends_however_many_rows_and_wherever(x):
    """A resting ball with noise of a third of a pixel, and a moving one far out."""
    rnd = random.Random(8)
    resting = [(x + rnd.gauss(0, 0.3), 200 + rnd.gauss(0, 0.3)) for _ in range(32_000)]
    assert len(list(folds.live_ends(80.0, False)(iter(resting)))) == 1
    moving = [(x + 5 * abs(f % 200 - 100) + rnd.random(), 200 + 8 * abs(f % 120 - 60) + rnd.random()) for f in range(8_000)]
    assert len(list(folds.live_ends(80.0, False)(iter(moving)))) < 40


@pytest.mark.parametrize("size", [4, 16])
def test_gated_track_over_fractions_and_far_places(track, points, size):
    rnd = random.Random(9)
    videos = [[(p[0] + 12_000, p[1]) if p != NONE else p for p in points_of(rnd, 90, span)] for span in (150, 500, 3000)]
    videos += [[(5.5, 5.5), *[NONE] * 40, (900.25, 1.0), (6.0, 6.0)]]
    got = points(folds.follow_first_point(track(*videos), size=size))
    assert got == [gated_by_loop(v, 100, True, None) for v in videos]


# --- pieces ------------------------------------------------------------------------------


def test_segments_do_not_depend_on_the_piece_size(track):
    ball = track(*[random_points(s, 400, 300, missing=0.3) for s in range(3)])
    read = lambda size: sorted(tuple(r) for r in windows.ball_segments(ball, max_gap=3, size=size).collect())
    assert read(16) == read(chunks.CHUNK)


def test_no_detected_point_is_left_out_of_the_segments(track):
    still = [(100.0 + 0.25 * (k % 3), 50.0) for k in range(500)]
    assert windows.ball_segments(track(still), size=64).filter("segment = 1").count() == 500


def test_a_row_without_a_frame_is_refused(spark, track):
    ball = track(xs([1, 2])).selectExpr("video_id", "if(frame = 1, null, frame) AS frame", "x", "y")
    for run in (lambda: windows.moving_average(ball, ["x"]), lambda: fill.interpolate(ball), lambda: folds.smooth_gaps(ball)):
        with pytest.raises(Exception, match="a row without frame"):
            run().collect()


def test_frames_below_zero_have_their_neighbours(track):
    ball = track(xs([1, 2, 3, 4, 5, 6])).withColumn("frame", F.col("frame") - 3)
    got = windows.difference(ball, ["x"], size=2).collect()
    assert sorted((r["frame"], r["delta_x"]) for r in got) == [(-3, None), *((f, 1) for f in range(-2, 3))]


def test_a_halo_wider_than_a_piece_is_refused(track):
    with pytest.raises(ValueError):
        windows.moving_average(track(xs([1, 2])), ["x"], window=5, size=2)


def test_running_total_and_previous_row(track):
    ball = track(xs([1, 2, 3, 4, 5])).filter("frame <> 2")
    total = chunks.running_total(ball, "x", "total", size=2).collect()
    assert sorted((r["frame"], r["total"]) for r in total) == [(0, 1), (1, 3), (3, 7), (4, 12)]
    before = chunks.previous_row(ball, ["x"], size=2).collect()
    assert sorted((r["frame"], r["prev_x"]) for r in before) == [(0, None), (1, 1), (3, 2), (4, 4)]


def test_positions_over_unequal_buckets(spark):
    df = spark.createDataFrame([(0, t) for t in (5, 1, 1, 9, 30, 31, 2)], "video_id long, t long")
    got = chunks.positions(df, ["t"], F.floor(F.col("t") / 3)).collect()
    assert sorted((r["pos"], r["t"]) for r in got) == list(enumerate([1, 1, 2, 5, 9, 30, 31]))


def test_plans_never_window_over_a_whole_track(spark, track):
    """Row windows run per piece; only summaries, one row per piece, are windowed per track."""
    plan = turning.turning_points(track(xs([1, 2, 3])))._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "Window [" in line and "windowspecdefinition(video_id" in line]
    assert lines
    for line in lines:
        per_track = "windowspecdefinition(video_id" in line and ", _chunk#" not in line.split("windowspecdefinition(video_id")[1].split("ASC")[0]
        assert not per_track or "_y_" in line


@pytest.mark.parametrize("size", [40, 65536])
def test_turning_points_of_a_filled_track(spark, track, size):
    """Without the look beyond a piece, a filled track turns at the same frames; an empty track has none."""
    tracks = [[(100.0 + k, 300.0 + 8 * abs(k % 120 - 60)) for k in range(500)], [NONE] * 60, random_points(3, 400)]
    filled = fill.fill_ball(track(*tracks), mode="strict", size=size)
    want = turning.turning_flags(filled, size=size).select("video_id", "frame", "turn")
    got = turning.turning_flags(filled, size=size, keep=["x"], complete=True)
    assert sorted(got.select("video_id", "frame", "turn").collect()) == sorted(want.collect())
    assert got.filter("turn").count() > 0 and got.join(filled, ["video_id", "frame", "x"]).count() == 900
