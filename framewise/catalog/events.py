"""Queries on bounces and hits: features, scores, models, insights, streams."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewise.catalog import register, rounded
from framewise.catalog.sql import query
from framewise.catalog.sql import rounded as r
from framewise.catalog.tracks import SMALL, SMOOTHED
from framewise.operators import bounce, chunks, fill, insights, models, select, turning
from framewise.operators.geometry import (
    BOTTOM, COURT_CM, COURT_H, LEFT, RIGHT, TOP, project_points, video_homography,
)
from framewise.sources.tables import work_folder

_FEATURES = query(
    f"SELECT video_id, frame, {', '.join(f'{r(c)} AS {c}' if '_div_' in c else c for c in bounce.FEATURES)} FROM features", "features")


def _features(t, **kw):
    return rounded(bounce.bounce_features(t.track, **kw), *[c for c in bounce.FEATURES if "_div_" in c])


@register("q9_bounce_features", _FEATURES)
def _(t):
    return _features(t)


@register("q9_bounce_features_small_pieces", _FEATURES)
def _(t):
    return _features(t, size=SMALL)


@register("f6_drop_incomplete", query("SELECT video_id, count(*) AS n_rows FROM features GROUP BY video_id", "features"))
def _(t):
    return bounce.bounce_features(t.track).groupBy("video_id").agg(F.count(F.lit(1)).alias("n_rows"))


_SCORED = f"SELECT video_id, frame, {r('score')} AS score FROM scored WHERE score > 0.45"


@register("f8_over_score", query(_SCORED, "scored"))
def _(t):
    scored = models.score_features(bounce.bounce_features(t.track), bounce.turn_score())
    return rounded(select.over_score(scored).select("video_id", "frame", "score"), "score")


_BOUNCES = query(f"SELECT video_id, frame, {r('score')} AS score FROM bounces", "bounces")


@register("q10_suppress_runs", _BOUNCES)
def _(t):
    scored = models.score_features(bounce.bounce_features(t.track), bounce.turn_score())
    return rounded(bounce.suppress_runs(scored), "score")


@register("m1_bounces_by_formula", _BOUNCES)
def _(t):
    return rounded(models.predict_bounces(t.track, bounce.turn_score(), smooth=False, size=SMALL), "score")


@register("m1_bounces_one_video", query(
    f"SELECT video_id, frame, {r('score')} AS score FROM bounces", "bounces", one_video=True), one_video=True)
def _(t):
    return rounded(models.predict_bounces(t.track, bounce.turn_score(), smooth=False, size=SMALL), "score")


@register("m1_bounces_by_model", query(
    """SELECT video_id, frame, TRUE AS scored, TRUE AS kept_over_threshold, TRUE AS one_per_run FROM features""", "features"))
def _(t):
    """Every feature row has a score; a kept frame is over the threshold, and no kept frame has another in its run."""
    features = bounce.bounce_features(t.track)
    model = models.fit_bounce_model(features, t.bounce_labels)
    scores = models.score_frames(t.track, model, smooth=False)
    kept = bounce.suppress_runs(scores).select("video_id", "frame", F.lit(1).alias("kept"))
    rows = scores.join(kept, ["video_id", "frame"], "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    along = Window.partitionBy("video_id").orderBy("frame")
    low = F.sum(F.when(F.col("score") > 0.45, 0).otherwise(1)).over(along)
    rows = rows.withColumn("run", low).withColumn("n", F.sum("kept").over(Window.partitionBy("video_id", "run")))
    return rows.select("video_id", "frame", F.col("score").isNotNull().alias("scored"),
                       ((F.col("kept") == 0) | (F.col("score") > 0.45)).alias("kept_over_threshold"), (F.col("n") <= 1).alias("one_per_run"))


@register("m2_hits_by_model", query("SELECT video_id, frame, TRUE AS in_range, TRUE AS by_threshold FROM ball", "ball"))
def _(t):
    """Every frame has a probability from 0 to 1, and a hit where that is over 0.8."""
    model = models.fit_hit_model(t.track, t.bounce_labels)
    both = models.predict_hits(t.track, model, probability="p")
    return both.select("video_id", "frame", F.col("p").between(0.0, 1.0).alias("in_range"),
                       (F.col("hit") == F.when(F.col("p") > 0.8, 1).otherwise(0)).alias("by_threshold"))


def _over_smoothed() -> dict[str, str]:
    from framewise.catalog.sql import CTES

    return SMOOTHED | {
        "sf": CTES["features"][0].replace("FROM ball ", "FROM fold "),
        "ss": CTES["scored"][0].replace("FROM features", "FROM sf"),
        "sb": CTES["bounces"][0].replace("FROM scored", "FROM ss"),
    }


_SMOOTHED = query(f"SELECT video_id, frame, {r('score')} AS score FROM sb", "ball", extra=_over_smoothed())


@register("m3_bounces_of_smoothed_track", _SMOOTHED)
def _(t):
    return rounded(models.predict_bounces(t.track, bounce.turn_score()), "score")


@register("m3_bounces_of_smoothed_track_small_pieces", _SMOOTHED)
def _(t):
    return rounded(models.predict_bounces(t.track, bounce.turn_score(), size=SMALL), "score")


@register("m3_bounces_of_smoothed_track_one_video", query(
    f"SELECT video_id, frame, {r('score')} AS score FROM sb", "ball", extra=_over_smoothed(), one_video=True), one_video=True)
def _(t):
    return rounded(models.predict_bounces(t.track, bounce.turn_score(), size=SMALL), "score")


@register("m4_confusion", query(
    """SELECT a.turn::INT AS label, CASE WHEN b.frame IS NULL THEN 0 ELSE 1 END AS prediction, count(*) AS n
    FROM turning_all a LEFT JOIN bounces b ON a.video_id = b.video_id AND a.frame = b.frame GROUP BY ALL""", "turning_all", "bounces"))
def _(t):
    found = models.predict_bounces(t.track, bounce.turn_score(), smooth=False).withColumn("hit", F.lit(1))
    return models.confusion(found, t.bounce_labels, "hit")


@register("m4_area_under_roc", query(
    f"""SELECT {r('(sum(CASE WHEN label = 1 THEN place END) - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0)')} AS area FROM (
      SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS place,
        sum(label) OVER () AS n1, sum(1 - label) OVER () AS n0
      FROM (SELECT s.score, t.turn::INT AS label FROM scored s JOIN turning_all t ON s.video_id = t.video_id AND s.frame = t.frame))
    GROUP BY n1, n0""", "scored", "turning_all"))
def _(t):
    scored = models.score_features(bounce.bounce_features(t.track), bounce.turn_score()).join(t.bounce_labels, ["video_id", "frame"])
    area = models.area_under_roc(scored)
    return rounded(scored.agg(F.lit(area).alias("area")), "area")


def _mapped(t):
    return project_points(fill.interpolate(t.track, backward=True), video_homography(t.kps))


_AT_TURNS = "FROM ball_map m JOIN turning t ON m.video_id = t.video_id AND m.frame = t.frame"


@register("i1_in_or_out", query(
    f"""SELECT m.video_id, m.frame, {r('map_x', 4)} AS map_x, {r('map_y', 4)} AS map_y,
      map_x BETWEEN {LEFT} AND {RIGHT} AND map_y BETWEEN {TOP} AND {BOTTOM} AS is_in {_AT_TURNS}""", "ball_map", "turning"))
def _(t):
    return rounded(insights.in_or_out(_mapped(t), turning.turning_points(t.track)), "map_x", "map_y", digits=4)


@register("i2_ball_speed", query(
    f"""SELECT s.video_id, s.frame, {r(f'mean * {COURT_CM[1] / 100}::DOUBLE / {COURT_H} * 24', 4)} AS speed
    FROM (SELECT video_id, frame, avg(step) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS mean
      FROM (SELECT video_id, frame, sqrt((map_x - lag(map_x) OVER w) ** 2 + (map_y - lag(map_y) OVER w) ** 2) AS step
        FROM ball_map WINDOW w AS (PARTITION BY video_id ORDER BY frame))) s
    JOIN turning t ON s.video_id = t.video_id AND s.frame = t.frame""", "ball_map", "turning"))
def _(t):
    return rounded(insights.ball_speed(_mapped(t), turning.turning_points(t.track), size=SMALL), "speed", digits=4)


@register("i3_hit_map", query(
    f"""SELECT m.video_id, floor(map_x / 50)::BIGINT AS cell_x, floor(map_y / 50)::BIGINT AS cell_y, count(*) AS n_hits
    {_AT_TURNS} GROUP BY ALL""", "ball_map", "turning"))
def _(t):
    return insights.hit_map(_mapped(t), turning.turning_points(t.track))


@register("i4_distance_run", query(
    f"""SELECT video_id, track_id, {r('COALESCE(sum(step), 0)', 4)} AS path_px, count(*) AS n_frames
    FROM (SELECT video_id, track_id, sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2) AS step
      FROM (SELECT *, trunc((x1 + x2) / 2) AS cx, trunc((y1 + y2) / 2) AS cy FROM player_boxes)
      WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)) GROUP BY video_id, track_id""", "player_boxes"))
def _(t):
    return rounded(insights.distance_run(select.player_boxes(t.players), size=SMALL), "path_px", digits=4)


@register("i5_vanished", query(
    """SELECT video_id, last_seen, frame AS back_at, frame - last_seen - 1 AS n_missing
    FROM (SELECT video_id, frame, lag(frame) OVER (PARTITION BY video_id ORDER BY frame) AS last_seen FROM ball WHERE x IS NOT NULL)
    WHERE frame - last_seen > 1""", "ball"))
def _(t):
    return insights.vanished(t.track, size=SMALL)


def _streamed(t, operator):
    """Run a streaming operator over the ball table, in batches whose rows overlap in time, and read its result.

    A row from far ahead comes last, so that the watermark passes all others.
    """
    from framewise.streaming import tracks

    spark, folder = t.spark, work_folder(t.spark, "stream")
    part = F.floor((F.col("frame") + F.col("frame") % 7 * 20) / 500) % 2
    end = spark.createDataFrame([(-1, 10**7, None, None)], t.track.schema)
    for rows in (t.track.filter(part == 0), t.track.filter(part == 1), end):
        rows.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(t.track.schema).parquet(f"{folder}/in")
        tracks.run_to_table(operator(stream), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").filter("video_id >= 0")


def _with_state_store(t, operator):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(provider)
    t.spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _streamed(t, operator)
    finally:
        t.spark.conf.set(provider, before)


def _register_streams():
    from framewise.catalog.tracks import _FOLLOW, _SEGMENTS

    @register("t1_streaming_gated_track", _FOLLOW)
    def _(t):
        from framewise.streaming import tracks

        return _with_state_store(t, lambda stream: tracks.gated_track(stream, delay=100_000))

    @register("t2_streaming_ball_segments", query(
        "SELECT video_id, frame, x, y, segment FROM seg", "ball", extra={"seg": _SEGMENTS["seg"].format(gap=30)}))
    def _(t):
        from framewise.streaming import tracks

        return _with_state_store(t, lambda stream: tracks.ball_segments(stream, delay=100_000))


_register_streams()
