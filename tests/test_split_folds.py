"""Sequential rules on tracks whose state is nowhere known from the raw rows, and on hits that reach back over many pieces."""

import random

import pytest
from pyspark.sql import functions as F

from framewise.operators import folds
from tests.test_tracks import NONE, Extrapolated, random_points, thinned_by_loop


@pytest.fixture
def calls(monkeypatch):
    """What is folded, in order."""
    seen, fold_groups = [], folds.fold_groups

    def note(df, group, order, inputs, fold, outputs):
        seen.append((fold, df, group))
        return fold_groups(df, group, order, inputs, fold, outputs)

    monkeypatch.setattr(folds, "fold_groups", note)
    return seen


def largest(df, group):
    return df.groupBy(*group).count().agg(F.max("count")).first()[0]


def sixth_missing(n, far):
    """Every sixth point missing, and a jump after it where `far` says so."""
    rnd, x, out = random.Random(n), 500.0, []
    for i in range(n):
        x += 300.0 if i % 6 == 1 and far(rnd) else rnd.uniform(-20, 20)
        x = 500.0 if x > 10_000 else x
        out.append(NONE if i % 6 == 0 else (x, rnd.uniform(100, 120)))
    return out


@pytest.mark.parametrize("size", [16, 32, 100])
def test_a_track_without_safe_starts_is_split(track, points, calls, size):
    videos = [
        sixth_missing(600, lambda rnd: True),
        sixth_missing(601, lambda rnd: rnd.random() < 0.5),
        sixth_missing(602, lambda rnd: rnd.random() < 0.9),
        random_points(11, 500, 900, missing=0.15, zero=0.03, step=120),
        random_points(12, 500, 900, missing=0.3, zero=0.0, step=120),
        [NONE if i % 2 else (500.0 + i % 7, 3.0) for i in range(400)],
    ]
    assert points(folds.smooth_gaps(track(*videos), size=size)) == [Extrapolated(v).all() for v in videos]
    assert [fold for fold, *_ in calls] == [folds.known_at_end, folds.extrapolate_gaps]
    first = calls[1][1].filter("video_id = 0")
    assert largest(first, calls[1][2]) <= 2 * size + 12


def test_a_million_frames_are_many_tasks(track, spark, calls):
    n = 1_000_000
    at = F.col("frame")
    x = F.when(at % 6 != 0, 400.0 + F.when(at % 12 > 6, 300.0).otherwise(0.0) + at % 5 * 3.0 + F.pmod(F.hash(at), F.lit(9)))
    ball = spark.range(n).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("frame"))
    ball = ball.withColumn("x", x).withColumn("y", F.when(at % 6 != 0, F.lit(5.0)))
    got = [tuple(r) for r in folds.smooth_gaps(ball).orderBy("frame").select("frame", "x", "y").collect()]
    rows = [(*r, True) for r in ball.orderBy("frame").select("frame", "x", "y").collect()]
    assert got == list(folds.extrapolate_gaps(iter(rows)))
    assert folds.safe_starts(ball).filter("safe").isEmpty()
    last = calls[-1]
    assert largest(last[1], last[2]) < 70_000


def thin(spark, rows, n_frames, size, **bound):
    df = spark.createDataFrame(rows, "video_id long, frame long, side int, x double, y double")
    frames = df.select("video_id").distinct().select("video_id", F.explode(F.array(F.lit(0), F.lit(n_frames - 1))).alias("frame"))
    return sorted(tuple(r) for r in folds.thin_hits(df, frames, size=size, **bound).select("video_id", "frame", "side", "x", "y").collect())


def test_a_hit_that_drops_a_thousand_pieces_takes_few_rounds(spark, calls):
    """Hits take turns at two far places; the last lies between them and drops all others, or all up to one far away."""
    hits = [(4 * i, 0, 300.0 * (i % 2), 0.0) for i in range(1000)] + [(4000, 0, 150.0, 0.0)]
    stopped = [(f, s, 5000.0 if f == 1204 else x, y) for f, s, x, y in hits]
    rows = [(0, *h) for h in hits] + [(1, *h) for h in stopped]
    want = sorted((v, *h) for v, hs in enumerate((hits, stopped)) for h in thinned_by_loop(hs, 6000))
    assert len(want) == 1 + 303
    assert thin(spark, rows, 6000, size=4) == want
    assert sum(fold is folds.thin_block for fold, *_ in calls) <= 12


def test_a_round_takes_a_bounded_number_of_hits(spark, calls):
    hits = [(4 * i, 0, 300.0 * (i % 2), 0.0) for i in range(64)] + [(256, 0, 150.0, 0.0)]
    want = [(0, *h) for h in thinned_by_loop(hits, 600)]
    assert thin(spark, [(0, *h) for h in hits], 600, size=4, bound=16) == want
    folded = [df for fold, df, _ in calls if fold is folds.thin_block]
    assert len(folded) > 3 and all(df.filter("_i IS NOT NULL").groupBy("_block").count().filter("count > 16").isEmpty() for df in folded)


@pytest.mark.parametrize(("size", "bound"), [(3, 5), (10, 65536), (33, 8)])
def test_many_open_checks_equal_the_loop(spark, size, bound):
    """Hits that crowd at a few places, with repeated places and both hands in a frame."""
    rnd = random.Random(size)
    videos = [
        sorted((f, side, float(rnd.choice(places)), 0.0) for f in rnd.sample(range(200), k) for side in rnd.choice([(0,), (1,), (0, 1)]))
        for k, places in ((40, (0, 150, 300)), (90, (0, 150, 300, 450)), (120, (0, 199, 398)), (30, (7,)), (2, (0, 1000)))
    ]
    rows = [(v, *h) for v, hs in enumerate(videos) for h in hs]
    assert thin(spark, rows, 200, size, bound=bound) == sorted((v, *h) for v, hs in enumerate(videos) for h in thinned_by_loop(hs, 200))
