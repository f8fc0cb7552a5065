"""Queries on scalar functions of boxes, points and lines."""

from pyspark.sql import functions as F

from framewise.catalog import register, rounded
from framewise.catalog.sql import query
from framewise.catalog.sql import rounded as r
from framewise.functions import points as P
from framewise.operators.chunks import join_track
from framewise.operators.windows import windowed
from framewise.sources.samples import FRAME_H

KEY = "video_id, frame, det_idx"
_c = F.col


@register("p1_box_centre", query(
    f"SELECT {KEY}, trunc((x1 - 700 + x2 - 700) / 2)::INT AS cx, trunc((y1 + y2) / 2)::INT AS cy FROM players", "players"))
def _(t):
    return t.players.select("video_id", "frame", "det_idx", P.centre_x(_c("x1") - 700, _c("x2") - 700).alias("cx"),
                            P.centre_y(_c("y1"), _c("y2")).alias("cy"))


@register("p2_safe_centre", query(
    """SELECT b.video_id, b.frame, det_idx, trunc((p.x1 + p.x2) / 2) AS cx, trunc((p.y1 + p.y2) / 2) AS cy
    FROM ball b LEFT JOIN players p ON b.video_id = p.video_id AND b.frame = p.frame""", "players"))
def _(t):
    from framewise.sources.tables import complete_frames

    boxes = complete_frames(t.frames, t.players)
    centre = {"cx": P.centre_x(_c("x1"), _c("x2")), "cy": P.centre_y(_c("y1"), _c("y2"))}
    return boxes.select("video_id", "frame", "det_idx", *[c.cast("double").alias(n) for n, c in centre.items()])


_DIST = "sqrt((x - 640) * (x - 640) + (y - 360) * (y - 360))"


@register("p3_distance", query(f"SELECT video_id, frame, {r(_DIST)} AS dist FROM ball", "ball"))
def _(t):
    d = P.distance(_c("x"), _c("y"), F.lit(640), F.lit(360))
    return rounded(t.ball.select("video_id", "frame", d.alias("dist")), "dist")


@register("p4_safe_distance", query(f"SELECT video_id, frame, COALESCE({r(_DIST)}, 999) AS dist FROM ball", "ball"))
def _(t):
    d = P.distance_or_far(_c("x"), _c("y"), F.lit(640), F.lit(360))
    return rounded(t.ball.select("video_id", "frame", d.alias("dist")), "dist")


@register("p5_squared_distance", query(
    "SELECT video_id, frame, (x - 640) * (x - 640) + (y - 360) * (y - 360) AS dist2 FROM ball", "ball"))
def _(t):
    return t.ball.select("video_id", "frame", P.squared_distance(_c("x"), _c("y"), F.lit(640), F.lit(360)).alias("dist2"))


@register("p6_foot_point", query(f"SELECT {KEY}, trunc((x1 + x2) / 2)::INT AS x, y2 AS y FROM players", "players"))
def _(t):
    return t.players.select("video_id", "frame", "det_idx", P.foot_point(_c("x1"), _c("x2"), _c("y2")).alias("f")).select(
        "video_id", "frame", "det_idx", "f.*")


@register("p7_box_height", query(f"SELECT {KEY}, y2 - y1 AS height FROM players", "players"))
def _(t):
    return t.players.select("video_id", "frame", "det_idx", P.box_height(_c("y1"), _c("y2")).alias("height"))


@register("p8_axis_distances", query("SELECT video_id, frame, abs(x - 640) AS dx, abs(y - 360) AS dy FROM ball", "ball"))
def _(t):
    return t.ball.select("video_id", "frame", P.axis_distances(_c("x"), _c("y"), F.lit(640), F.lit(360)).alias("d")).select(
        "video_id", "frame", "d.*")


@register("p9_pixels_to_metres", query(
    f"SELECT {KEY}, {r('(x2 - x1) * 1.88::DOUBLE / (y2 - y1)')} AS metres FROM players", "players"))
def _(t):
    m = P.pixels_to_metres(_c("x2") - _c("x1"), F.lit(1.88), _c("y2") - _c("y1"))
    return rounded(t.players.select("video_id", "frame", "det_idx", m.alias("metres")), "metres")


@register("p10_metres_to_pixels", query(
    f"SELECT {KEY}, {r('2.5::DOUBLE * (y2 - y1) / 1.88::DOUBLE')} AS px FROM players", "players"))
def _(t):
    px = P.metres_to_pixels(F.lit(2.5), F.lit(1.88), _c("y2") - _c("y1"))
    return rounded(t.players.select("video_id", "frame", "det_idx", px.alias("px")), "px")


@register("p11_within_circle", query("SELECT video_id, frame, side, radius > dist AS is_within FROM hand_dist", "hand_dist"))
def _(t):
    from framewise.operators.hits import hand_distances

    d = hand_distances(t.track, t.hands)
    return d.select("video_id", "frame", "side", P.within_circle(_c("radius"), _c("dist")).alias("is_within"))


@register("p12_came_no_closer", query(
    """SELECT video_id, frame, side FROM (
      SELECT video_id, frame, side, CASE WHEN lag(dist) OVER w <= dist THEN TRUE END AS no_closer FROM (
      SELECT h.video_id, h.frame, h.side, sqrt((b.x - hx) * (b.x - hx) + (b.y - hy) * (b.y - hy)) AS dist
      FROM ball b JOIN hands h ON b.video_id = h.video_id AND b.frame = h.frame)
    WINDOW w AS (PARTITION BY video_id, side ORDER BY frame)) WHERE no_closer""", "ball", "hands"))
def _(t):
    d = t.hands.join(t.track, ["video_id", "frame"]).withColumn("dist", P.distance(_c("x"), _c("y"), _c("hx"), _c("hy")))
    out = windowed(d, lambda w: {"no_closer": P.came_no_closer(F.lag("dist").over(w), _c("dist"))}, 1, keys=["video_id", "side"])
    return out.filter("no_closer").select("video_id", "frame", "side")


def _seg(i, j, k, m, n):
    return f"SELECT video_id, frame, {n} AS id, " + ", ".join(
        f"max(CASE WHEN kp_idx = {p} THEN {c} END) AS {c}{q}" for q, p in enumerate((i, j, k, m), 1) for c in "xy"
    ) + " FROM kps GROUP BY ALL"


_PAIRS = " UNION ALL ".join(_seg(*p, n) for n, p in enumerate(((0, 2, 1, 3), (0, 3, 1, 2), (0, 1, 2, 3), (0, 1, 4, 6)), 1))
_DET = "((x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4))"
_MEET = "CASE WHEN {d} <> 0 THEN round(((x1 * y2 - y1 * x2) * ({c}3 - {c}4) - ({c}1 - {c}2) * (x3 * y4 - y3 * x4)) / {d}, 6) + 0.0 END"


@register("p13_line_intersection", query(
    f"SELECT video_id, frame, id, {_MEET.format(d=_DET, c='x')} AS x, {_MEET.format(d=_DET, c='y')} AS y FROM seg",
    "kps", extra={"seg": _PAIRS}))
def _(t):
    meet = P.line_intersection(*[_c(f"{c}{i}") for i in range(1, 5) for c in "xy"])
    out = t.segments.select("video_id", "frame", "id", meet.alias("p")).select("video_id", "frame", "id", "p.x", "p.y")
    return rounded(out, "x", "y")


@register("p14_fill_missing", query("SELECT video_id, frame, COALESCE(x, 0) AS x, COALESCE(y, 0) AS y FROM ball", "ball"))
def _(t):
    return t.ball.select("video_id", "frame", P.fill_missing(_c("x"), 0.0).alias("x"), P.fill_missing(_c("y"), 0.0).alias("y"))


@register("p15_keep_if", query("SELECT video_id, frame, CASE WHEN x < 900 THEN x END AS x FROM ball", "ball"))
def _(t):
    return t.ball.select("video_id", "frame", P.keep_if(_c("x") < 900, _c("x")).alias("x"))


@register("p16_round_to_int", query("SELECT video_id, frame, round_even(x / 2, 0) AS half_x FROM ball", "ball"))
def _(t):
    return t.ball.select("video_id", "frame", P.round_to_int(_c("x") / 2).cast("double").alias("half_x"))


@register("p17_over_threshold", query(
    "SELECT video_id, frame, CASE WHEN k / 100.0::DOUBLE > 0.8::DOUBLE THEN 1 ELSE 0 END AS hit, k / 100.0::DOUBLE AS p FROM ball", "ball"))
def _(t):
    p = _c("k") / F.lit(100.0)
    return t.ball.select("video_id", "frame", P.over_threshold(p).alias("hit"), P.over_threshold(p, None).alias("p"))


@register("p18_keypoints_from_vector", query(
    f"SELECT video_id, frame, kp_idx, {r('px * (1280 / 224.0::DOUBLE)')} AS x, {r('py * (720 / 224.0::DOUBLE)')} AS y FROM court_raw", "court_raw"))
def _(t):
    sized = join_track(t.court_raw, t.frame_size)
    points = sized.select("video_id", "frame", F.posexplode(P.keypoints_from_vector(_c("pred"), _c("w"), _c("h"))).alias("kp_idx", "p"))
    return rounded(points.select("video_id", "frame", "kp_idx", "p.x", "p.y"), "x", "y")


@register("p19_perspective_velocity", query(
    f"""SELECT video_id, frame, x - lag(x) OVER w AS vx,
      {r(f'(y - lag(y) OVER w) * (1 + ({FRAME_H} - y) * 0.4::DOUBLE / {FRAME_H})', 9)} AS vy
    FROM ball WINDOW w AS (PARTITION BY video_id ORDER BY frame)""", "ball"))
def _(t):
    cols = lambda w: {
        "vx": _c("x") - F.lag("x").over(w),
        "vy": P.perspective_velocity(_c("y"), _c("y") - F.lag("y").over(w), FRAME_H),
    }
    return rounded(windowed(t.track, cols, 1).drop("x", "y"), "vy", digits=9)
