"""Queries on ball tracks: windows, filling, turning points, folds."""

from pyspark.sql import functions as F

from framewise.catalog import register, rounded
from framewise.catalog.sql import fill, masked, project, quantile, query
from framewise.catalog.sql import rounded as r
from framewise.operators import fill as fills
from framewise.operators import folds, geometry, hits, quantiles, turning, windows

SMALL = 128  # a piece size far below the length of the sample tracks

_W = "WINDOW w AS (PARTITION BY video_id ORDER BY frame)"
_MA = "WINDOW w AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"

# --- windows -----------------------------------------------------------------------------

_SHIFT = query(
    f"""SELECT video_id, frame, x, lag(x, 1) OVER w AS x_lag_1, lag(x, 2) OVER w AS x_lag_2, lead(x, 1) OVER w AS x_lead_1,
    lead(x, 2) OVER w AS x_lead_2 FROM ball {_W}""", "ball")


@register("w1_shift", _SHIFT)
def _(t):
    return windows.shift(t.track.drop("y"), ["x"])


@register("w1_shift_small_pieces", _SHIFT)
def _(t):
    return windows.shift(t.track.drop("y"), ["x"], size=SMALL)


@register("w2_difference", query(
    f"SELECT video_id, frame, x, y, x - lag(x) OVER w AS delta_x, y - lag(y) OVER w AS delta_y FROM ball {_W}", "ball"))
def _(t):
    return windows.difference(t.track, ["x", "y"])


_MA_SQL = query(f"SELECT video_id, frame, x, y, {r('avg(x) OVER w')} AS x_ma, {r('avg(y) OVER w')} AS y_ma FROM ball {_MA}", "ball")


@register("w3_moving_average", _MA_SQL)
def _(t):
    return rounded(windows.moving_average(t.track, ["x", "y"]), "x_ma", "y_ma")


@register("w3_moving_average_small_pieces", _MA_SQL)
def _(t):
    return rounded(windows.moving_average(t.track, ["x", "y"], size=SMALL), "x_ma", "y_ma")


@register("w4_look_ahead_counts", query(
    """SELECT video_id, frame, d, COALESCE(sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) OVER a, 0)::BIGINT AS n_neg_ahead,
      COALESCE(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) OVER a, 0)::BIGINT AS n_pos_ahead
    FROM (SELECT video_id, frame, y - 440 AS d FROM ball)
    WINDOW a AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)""", "ball"))
def _(t):
    return windows.look_ahead_counts(t.track.select("video_id", "frame", (F.col("y") - 440).alias("d")), "d", size=SMALL)


@register("w5_max_height", query(
    """SELECT video_id, frame, track_id, max(y2 - y1) OVER (PARTITION BY video_id, track_id ORDER BY frame
      RANGE BETWEEN 20 PRECEDING AND 49 FOLLOWING) AS max_height FROM player_boxes""", "player_boxes"))
def _(t):
    from framewise.operators.select import player_boxes

    return windows.max_height(player_boxes(t.players), size=SMALL).select("video_id", "frame", "track_id", "max_height")


@register("w6_min_max_scale", query(
    f"""SELECT video_id, frame, {r('(x - min(x) OVER p) / (max(x) OVER p - min(x) OVER p)')} AS x_norm,
      {r('(y - min(y) OVER p) / (max(y) OVER p - min(y) OVER p)')} AS y_norm FROM ball WINDOW p AS (PARTITION BY video_id)""", "ball"))
def _(t):
    scaled = windows.min_max_scale(t.track, ["x", "y"]).drop("x", "y")
    return rounded(scaled, "x_norm", "y_norm")


_SEGMENTS = {
    "seg": """SELECT video_id, frame, x, y, sum(CASE WHEN step < 100 AND gap <= {gap} THEN 0 ELSE 1 END) OVER
          (PARTITION BY video_id ORDER BY frame ROWS UNBOUNDED PRECEDING)::BIGINT AS segment
        FROM (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step,
            frame - lag(frame) OVER w - 1 AS gap FROM ball WHERE x IS NOT NULL WINDOW w AS (PARTITION BY video_id ORDER BY frame))""",
}


_W7 = query("SELECT video_id, frame, x, y, segment FROM seg", "ball", extra={"seg": _SEGMENTS["seg"].format(gap=30)})


@register("w7_ball_segments", _W7)
def _(t):
    return windows.ball_segments(t.track)


@register("w7_ball_segments_small_pieces", _W7)
def _(t):
    return windows.ball_segments(t.track, size=256)


@register("w7_segment_history_on_map", query(
    f"""SELECT s.video_id, s.frame, segment, trunc({project('x', 'y', 0)})::INT AS map_x, trunc({project('x', 'y', 1)})::INT AS map_y
    FROM seg s JOIN video_h v ON s.video_id = v.video_id""", "ball", "video_h", extra={"seg": _SEGMENTS["seg"].format(gap=30)}))
def _(t):
    segments = windows.ball_segments(t.track)
    return geometry.project_points(segments, geometry.video_homography(t.kps), as_int=True).drop("x", "y")


@register("w8_segments_after_gaps", query(
    "SELECT video_id, frame, x, y, segment FROM seg", "ball", extra={"seg": _SEGMENTS["seg"].format(gap=2)}))
def _(t):
    return windows.ball_segments(t.track, max_gap=2)


# --- filling -----------------------------------------------------------------------------

_Q1 = query(f"SELECT video_id, frame, {r('x')} AS x, {r('y')} AS y FROM f", "ball", extra={"f": fill("ball", backward=False)})


@register("q1_interpolate", _Q1)
def _(t):
    return rounded(fills.interpolate(t.track), "x", "y")


@register("q1_interpolate_small_pieces", _Q1)
def _(t):
    return rounded(fills.interpolate(t.track, size=SMALL), "x", "y")


@register("q2_back_fill", query("SELECT * FROM f", "ball", extra={"f": fill("ball", linear=False)}))
def _(t):
    return fills.back_fill(t.track, size=SMALL)


@register("q3_forward_fill", query(
    """SELECT video_id, frame, last_value(x IGNORE NULLS) OVER w AS x, last_value(y IGNORE NULLS) OVER w AS y FROM ball
    WINDOW w AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "ball"))
def _(t):
    return fills.forward_fill(t.track, size=SMALL)


@register("q4_interpolate_positions", query(
    "SELECT video_id, frame, round_even(x, 0)::INT AS x, round_even(y, 0)::INT AS y FROM filled", "filled"))
def _(t):
    return fills.interpolate_positions(t.track)


@register("a3_quantile", query(f"SELECT video_id, {r('threshold')} AS threshold FROM step_limit", "step_limit"))
def _(t):
    steps = fills.step_distance(t.track).filter("frame > 0")
    return rounded(quantiles.quantile(steps, "distance", 0.95, out="threshold"), "threshold")


@register("a3_approximate_quantile", query("SELECT video_id, count(distance) AS n, TRUE AS close FROM steps WHERE frame > 0 GROUP BY video_id", "steps"))
def _(t):
    """Whether the rank of the value is off by at most 1/accuracy of the rows, and one row."""
    steps = fills.step_distance(t.track).filter("frame > 0")
    found = quantiles.approximate_quantile(steps, "distance", 0.95, accuracy=100, out="threshold")
    ranked = steps.join(found, "video_id").groupBy("video_id").agg(
        F.count("distance").alias("n"), F.count_if(F.col("distance") < F.col("threshold")).alias("under"),
        F.count_if(F.col("distance") <= F.col("threshold")).alias("upto"))
    off = F.col("n") / 100 + 1
    return ranked.select("video_id", "n", ((F.col("under") - off <= 0.95 * F.col("n")) & (F.col("upto") + off >= 0.95 * F.col("n"))).alias("close"))


@register("q5_mask_outliers", query("SELECT video_id, frame, x, y FROM step_masked", "step_masked"))
def _(t):
    steps = fills.step_distance(t.track).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("x", "y")})
    return fills.mask_outliers(steps).select("video_id", "frame", "x", "y")


_RAW = {
    "zero": "SELECT video_id, frame, COALESCE(x, 0) AS x, COALESCE(y, 0) AS y FROM ball",
    "raw_steps": f"""SELECT *, (COALESCE(lag(x) OVER w, 0) - x) * (COALESCE(lag(x) OVER w, 0) - x)
      + (COALESCE(lag(y) OVER w, 0) - y) * (COALESCE(lag(y) OVER w, 0) - y) AS distance FROM zero {_W}""",
    "raw_limit": quantile("raw_steps", 0.90),
    "raw_masked": masked("raw_steps", "raw_limit"),
}


@register("q6_mask_and_fill", query(
    f"SELECT video_id, frame, {r('x')} AS x, {r('y')} AS y FROM f", "ball", extra=_RAW | {"f": fill("raw_masked")}))
def _(t):
    return rounded(fills.mask_and_fill(t.track), "x", "y")


_Q7 = "SELECT video_id, frame, x, y FROM fill_compat"


@register("q7_fill_ball", query(_Q7, "fill_compat"))
def _(t):
    return fills.fill_ball(t.track)


@register("q7_fill_ball_small_pieces", query(_Q7, "fill_compat"))
def _(t):
    return fills.fill_ball(t.track, size=SMALL)


@register("q7_fill_ball_one_video", query(_Q7, "fill_compat", one_video=True), one_video=True)
def _(t):
    return fills.fill_ball(t.track, size=SMALL)


@register("q7_fill_ball_strict", query(
    "SELECT video_id, frame, round_even(x, 0)::INT AS x, round_even(y, 0)::INT AS y FROM f", "strict_masked",
    extra={"f": fill("strict_masked")}))
def _(t):
    return fills.fill_ball(t.track, mode="strict")


# --- turning points ----------------------------------------------------------------------

_Q8 = "SELECT video_id, frame FROM turning"


@register("q8_turning_points", query(_Q8, "turning"))
def _(t):
    return turning.turning_points(t.track)


@register("q8_turning_points_small_pieces", query(_Q8, "turning"))
def _(t):
    return turning.turning_points(t.track, size=SMALL)


@register("q8_turning_points_one_video", query(_Q8, "turning", one_video=True), one_video=True)
def _(t):
    return turning.turning_points(t.track, size=SMALL)


# --- folds -------------------------------------------------------------------------------

SMOOTHED = {
    "raw": f"SELECT video_id, frame, x, y, lead(frame) OVER w IS NOT NULL AS more, lead(x) OVER w AS ax, lead(y) OVER w AS ay FROM ball {_W}",
    "fold": """SELECT video_id, frame, x, y, 0 AS fills, [x] AS hx, [y] AS hy, FALSE AS drop_next FROM raw WHERE frame = 0
    UNION ALL
    SELECT video_id, frame, CASE WHEN can THEN ex ELSE x END, CASE WHEN can THEN ey ELSE y END,
      CASE WHEN can THEN fills + 1 ELSE 0 END,
      list_append(hx, CASE WHEN can THEN ex ELSE x END)[-5:], list_append(hy, CASE WHEN can THEN ey ELSE y END)[-5:],
      can AND ax IS NOT NULL AND ax <> 0 AND sqrt((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)) > 80
    FROM (SELECT *, (x IS NULL OR x = 0) AND more AND len(hx) = 5 AND list_count(hx) = 5 AND fills < 3 AS can,
        2 * hx[-1] - hx[-2] AS ex, 2 * hy[-1] - hy[-2] AS ey
      FROM (SELECT r.video_id, r.frame, CASE WHEN NOT f.drop_next THEN r.x END AS x, CASE WHEN NOT f.drop_next THEN r.y END AS y,
          f.fills, f.hx, f.hy, r.more, r.ax, r.ay FROM fold f JOIN raw r ON r.video_id = f.video_id AND r.frame = f.frame + 1))""",
}
_Q11 = "SELECT video_id, frame, x, y FROM fold"


@register("q11_smooth_gaps", query(_Q11, "ball", extra=SMOOTHED))
def _(t):
    return folds.smooth_gaps(t.track)


@register("u2_smooth_gaps_small_pieces", query(_Q11, "ball", extra=SMOOTHED))
def _(t):
    return folds.smooth_gaps(t.track, size=SMALL)


@register("q11_smooth_gaps_one_video", query(_Q11, "ball", extra=SMOOTHED, one_video=True), one_video=True)
def _(t):
    return folds.smooth_gaps(t.track, size=SMALL)


def _gated(start: str, first: str, test: str, source: str = "ball") -> dict[str, str]:
    near = f"sqrt((r.x - f.lx) * (r.x - f.lx) + (r.y - f.ly) * (r.y - f.ly)) {test}"
    keep = f"r.x IS NOT NULL AND (f.lx IS NULL OR {near})"
    return {
        "start": start,
        "fold": f"""SELECT b.video_id, b.frame, {first} FROM {source} b JOIN start s ON b.video_id = s.video_id WHERE b.frame = 0
        UNION ALL
        SELECT r.video_id, r.frame, CASE WHEN {keep} THEN r.x END, CASE WHEN {keep} THEN r.y END,
          CASE WHEN {keep} THEN r.x ELSE f.lx END, CASE WHEN {keep} THEN r.y ELSE f.ly END
        FROM fold f JOIN {source} r ON r.video_id = f.video_id AND r.frame = f.frame + 1""",
    }


_MAIN = query(
    "SELECT video_id, frame, x, y FROM fold", "ball",
    extra=_gated(
        "SELECT video_id, avg(x) AS mx, avg(y) AS my FROM ball GROUP BY video_id",
        "NULL::DOUBLE AS x, NULL::DOUBLE AS y, s.mx AS lx, s.my AS ly", "< 80"))
_FOLLOW = query(
    "SELECT video_id, frame, x, y FROM fold", "ball",
    extra=_gated("SELECT DISTINCT video_id FROM ball", "b.x AS x, b.y AS y, b.x AS lx, b.y AS ly", "<= 100"))


@register("q12_choose_main_ball", _MAIN)
def _(t):
    return folds.choose_main_ball(t.track)


@register("q12_choose_main_ball_small_pieces", _MAIN)
def _(t):
    return folds.choose_main_ball(t.track, size=SMALL)


@register("q13_follow_first_point", _FOLLOW)
def _(t):
    return folds.follow_first_point(t.track)


@register("q13_follow_first_point_small_pieces", _FOLLOW)
def _(t):
    return folds.follow_first_point(t.track, size=SMALL)


_HITS = query(f"SELECT video_id, side, frame, x, y, {r('dist')} AS dist, radius FROM hits", "hits")


@register("q14_approach_hits", _HITS)
def _(t):
    return rounded(hits.approach_hits(t.track, t.hands), "dist")


@register("q14_approach_hits_small_pieces", _HITS)
def _(t):
    return rounded(hits.approach_hits(t.track, t.hands, size=8), "dist")


_THIN = {
    "numbered": """SELECT h.video_id, h.frame, h.side, h.x, h.y, row_number() OVER w AS i,
        COALESCE(lead(h.frame) OVER w, e.n) - h.frame AS checks
      FROM hits h JOIN (SELECT video_id, max(frame) + 1 AS n FROM ball GROUP BY video_id) e ON h.video_id = e.video_id
      WINDOW w AS (PARTITION BY h.video_id ORDER BY h.frame, h.side)""",
    "thin": """SELECT video_id, i, [{'frame': frame, 'side': side, 'x': x, 'y': y}] AS stack FROM numbered WHERE i = 1
      UNION ALL
      SELECT video_id, i, list_append(stack[:len(stack) - least(checks, len(stack) - blocked)], top)
      FROM (SELECT n.video_id, n.i, f.stack, n.checks, {'frame': n.frame, 'side': n.side, 'x': n.x, 'y': n.y} AS top,
          COALESCE(list_max([CASE WHEN sqrt((s.x - n.x) * (s.x - n.x) + (s.y - n.y) * (s.y - n.y)) >= 200 THEN j ELSE 0 END
            FOR s, j IN f.stack]), 0) AS blocked
        FROM thin f JOIN numbered n ON n.video_id = f.video_id AND n.i = f.i + 1)""",
    "final": """SELECT video_id, unnest(stack) AS s FROM thin t WHERE i = (SELECT max(i) FROM numbered n WHERE n.video_id = t.video_id)""",
}
_Q15 = query("SELECT video_id, s.frame AS frame, s.side AS side, s.x AS x, s.y AS y FROM final", "hits", extra=_THIN)


@register("q14_approach_hits_one_video", query(
    f"SELECT video_id, side, frame, x, y, {r('dist')} AS dist, radius FROM hits", "hits", one_video=True), one_video=True)
def _(t):
    return rounded(hits.approach_hits(t.track, t.hands, size=SMALL), "dist")


@register("q13_follow_first_point_one_video", query(
    "SELECT video_id, frame, x, y FROM fold", "ball", one_video=True,
    extra=_gated("SELECT DISTINCT video_id FROM ball", "b.x AS x, b.y AS y, b.x AS lx, b.y AS ly", "<= 100")), one_video=True)
def _(t):
    return folds.follow_first_point(t.track, size=SMALL)


@register("q14_hits_on_map", query(
    f"""SELECT h.video_id, h.side, h.frame, trunc({project('h.x', 'h.y', 0)})::INT AS map_x, trunc({project('h.x', 'h.y', 1)})::INT AS map_y,
      trunc({project('b.body_x', 'b.body_y', 0)})::INT AS body_map_x, trunc({project('b.body_x', 'b.body_y', 1)})::INT AS body_map_y
    FROM hits h JOIN hands b ON h.video_id = b.video_id AND h.frame = b.frame AND h.side = b.side
    JOIN video_h v ON h.video_id = v.video_id""", "hits", "hands", "video_h"))
def _(t):
    found = hits.approach_hits(t.track, t.hands, matrices=geometry.video_homography(t.kps))
    return found.select("video_id", "side", "frame", "map_x", "map_y", "body_map_x", "body_map_y")


@register("q15_thin_hits", _Q15)
def _(t):
    return folds.thin_hits(hits.approach_hits(t.track, t.hands), t.frames)


@register("q15_thin_hits_small_pieces", _Q15)
def _(t):
    return folds.thin_hits(hits.approach_hits(t.track, t.hands), t.frames, size=SMALL)


@register("q17_lag_features", query(
    "SELECT video_id, frame, x, y, " + ", ".join(
        f"{f}({c}, {n}) OVER w AS {c}_{f}_{n}" for c in "xy" for f in ("lag", "lead") for n in (1, 2, 3)) + f" FROM ball {_W}", "ball"))
def _(t):
    return hits.lag_features(t.track)
