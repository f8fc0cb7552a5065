"""Queries on the court mapping, the moving camera and the overlay."""

from pyspark.sql import functions as F

from framewise.catalog import register, rounded
from framewise.catalog.sql import MAP_LINES, MAP_POINTS, homography, moved, project, query
from framewise.catalog.sql import rounded as r
from framewise.catalog.tracks import SMALL
from framewise.functions.points import foot_of_centre_box
from framewise.operators import bounce, camera, fill, geometry, hits, models, overlay
from framewise.operators import select as S
from framewise.plans.match import Match
from framewise.sources.samples import FRAME_H, HEIGHTS
from framewise.sources.tables import stored

H = geometry.H_NAMES
# The court's edges on the map.
LEFT, TOP, RIGHT, BOTTOM = 264, 317, 702, 1268
_H9 = ", ".join(f"{r(h, 9)} AS {h}" for h in H)


def _h9(df):
    return rounded(geometry.matrix_columns(df), *H, digits=9)


@register("g1_court_map_points", query(
    f"""SELECT k.video_id, k.frame, k.kp_idx, p.px::DOUBLE AS map_x, p.py::DOUBLE AS map_y
    FROM kps k JOIN (VALUES {MAP_POINTS}) AS p(i, px, py) ON k.kp_idx = p.i""", "kps"))
def _(t):
    return geometry.with_map_positions(t.kps).drop("x", "y")


@register("g2_corners_land_on_corners", query(
    f"""SELECT k.video_id, k.frame, k.kp_idx, p.px::DOUBLE AS map_x, p.py::DOUBLE AS map_y FROM kps k JOIN (VALUES
      (4, {LEFT}, {TOP}), (6, {RIGHT}, {TOP}), (5, {LEFT}, {BOTTOM}), (7, {RIGHT}, {BOTTOM})) AS p(i, px, py) ON k.kp_idx = p.i""", "kps"))
def _(t):
    """The four points that fix a frame's matrix go to the corners of the court."""
    corners = t.kps.filter(F.col("kp_idx").isin(*geometry.CORNERS))
    return rounded(geometry.project_points(corners, geometry.frame_homography(t.kps)).drop("x", "y"), "map_x", "map_y")


@register("g2_video_homography", query(f"SELECT video_id, {_H9} FROM video_h", "video_h"))
def _(t):
    return _h9(geometry.video_homography(t.kps))


_BALL_MAP = f"""SELECT b.video_id, b.frame, x, y, {r(project('x', 'y', 0), 4)} AS map_x, {r(project('x', 'y', 1), 4)} AS map_y
    FROM ball b JOIN video_h v ON b.video_id = v.video_id"""


@register("g3_project_points", query(_BALL_MAP, "ball", "video_h"))
def _(t):
    return rounded(geometry.project_points(t.track, geometry.video_homography(t.kps)), "map_x", "map_y", digits=4)


@register("j6_matrix_of_video", query(
    f"SELECT b.video_id, b.frame, {_H9} FROM ball b JOIN video_h v ON b.video_id = v.video_id", "ball", "video_h"))
def _(t):
    from framewise.operators.chunks import join_track

    return _h9(join_track(t.frames, geometry.video_homography(t.kps)))


# Four pairs fix the matrix, so the least-squares form must equal the closed one.
@register("g4_fit_four_points", query(
    "SELECT video_id, frame, " + ", ".join(f"{r(h, 6 if h[1] == '2' else 3)} AS {h}" for h in H) + " FROM h", "kps",
    extra={"h": homography("kps")}))
def _(t):
    corners = {i: p for i, p in zip(geometry.CORNERS, [
        (geometry.LEFT, geometry.TOP), (geometry.RIGHT, geometry.TOP), (geometry.LEFT, geometry.BOTTOM), (geometry.RIGHT, geometry.BOTTOM)])}
    pairs = geometry.with_map_positions(t.kps.filter("kp_idx IN (4, 5, 6, 7)"), corners)
    fitted = geometry.matrix_columns(geometry.fit_homography(pairs).drop("n_points"))
    near = rounded(fitted, *[h for h in H if h[1] != "2"], digits=3)
    return rounded(near, *[h for h in H if h[1] == "2"])


@register("g4_fit_all_points", query(
    "SELECT video_id, frame, count(*) AS n_points, TRUE AS exact FROM kps GROUP BY ALL", "kps"))
def _(t):
    """Whether a fit to exact pairs puts every point back, to a millionth of a pixel."""
    pairs = geometry.project_points(t.kps, geometry.frame_homography(t.kps))
    fitted = geometry.fit_homography(pairs)
    back = geometry.project_points(pairs, fitted.drop("n_points"), out=("back_x", "back_y"))
    off = F.max(F.greatest(F.abs(F.col("back_x") - F.col("map_x")), F.abs(F.col("back_y") - F.col("map_y"))))
    return back.groupBy("video_id", "frame").agg(F.count(F.lit(1)).alias("n_points"), (off < 1e-6).alias("exact"))


@register("g4_matrix_of_all_points", query(
    "SELECT k.video_id, k.frame, k.n_points, " + ", ".join(f"{r(h, 6 if h[1] == '2' else 3)} AS {h}" for h in H)
    + ", 0.0::DOUBLE AS largest_residual FROM h JOIN (SELECT video_id, frame, count(*) AS n_points FROM kps GROUP BY ALL) k"
    " ON k.video_id = h.video_id AND k.frame = h.frame", "kps", extra={"h": homography("kps")}))
def _(t):
    """A fit to all court points, put on the map by the closed form, gives its matrix back.

    Pairs and fits are stored, as the steps after them read them more than once."""
    pairs = stored(geometry.project_points(t.kps, geometry.frame_homography(t.kps)), "pairs")
    fitted = stored(geometry.fit_homography(pairs), "fitted")
    largest = geometry.fit_residuals(pairs, fitted).groupBy("video_id", "frame").agg(F.max("residual").alias("largest_residual"))
    both = geometry.matrix_columns(fitted.join(largest, ["video_id", "frame"]))
    near = rounded(both, *[h for h in H if h[1] != "2"], "largest_residual", digits=3)
    return rounded(near, *[h for h in H if h[1] == "2"])


@register("g7_court_lines", query(
    f"SELECT v.video_id, l.* FROM (SELECT DISTINCT video_id FROM ball) v CROSS JOIN (VALUES {MAP_LINES}) AS l(item, x, y, x2, y2)", "ball"))
def _(t):
    return geometry.court_line_layer(t.frames)


_PX_PER_M = f"{geometry.COURT_W / (geometry.COURT_CM[0] / 100)!r}::DOUBLE"

def _mini_sql(points: str, extra_columns: str = "") -> str:
    dx, dy = "(x - m.kx) * hm / max_height", "(y - m.ky) * hm / max_height"
    return query(
        f"""SELECT video_id, frame, track_id, m.kp_idx AS kp_idx, {extra_columns} {r(dx)} AS dx_m, {r(dy)} AS dy_m,
          {r(f'p.px + {dx} * {_PX_PER_M}')} AS map_x, {r(f'p.py + {dy} * {_PX_PER_M}')} AS map_y
        FROM (SELECT f.*, (SELECT min({{'d': abs(f.y - k.y), 'kp_idx': k.kp_idx, 'kx': k.x, 'ky': k.y}})
            FROM kps_seen k WHERE k.video_id = f.video_id AND k.frame = f.frame AND k.kp_idx IN (0, 2, 12, 13)) AS m
          FROM ({points}) f)
        LEFT JOIN (VALUES {MAP_POINTS}) AS p(i, px, py) ON p.i = m.kp_idx""",
        "player_boxes", "kps_seen")


_TALL = """SELECT video_id, frame, track_id, trunc((x1 + x2) / 2) AS x, y2 AS y, CASE track_id WHEN 1 THEN 1.88 WHEN 2 THEN 1.91 END::DOUBLE AS hm,
  x1, y1, x2, y2, det_idx, max(y2 - y1) OVER (PARTITION BY video_id, track_id ORDER BY frame RANGE BETWEEN 20 PRECEDING AND 49 FOLLOWING) AS max_height
  FROM player_boxes"""


@register("g8_players_on_mini_court", _mini_sql(f"SELECT * FROM ({_TALL})", "max_height,"))
def _(t):
    placed = geometry.players_on_mini_court(S.player_boxes(t.players), t.kps_seen, HEIGHTS, size=SMALL)
    return rounded(placed, "dx_m", "dy_m", "map_x", "map_y")


@register("g8_ball_on_mini_court", _mini_sql(
    f"""SELECT b.video_id, b.frame, t.track_id, 1.88::DOUBLE + 0 * t.track_id AS hm, max_height, COALESCE(b.x, 0) AS x, COALESCE(b.y, 0) AS y FROM ball b
      LEFT JOIN (SELECT t.*, row_number() OVER (PARTITION BY t.video_id, t.frame
        ORDER BY sqrt((bx - t.x) * (bx - t.x) + (by_ - trunc((y1 + y2) / 2)) * (by_ - trunc((y1 + y2) / 2))), det_idx) AS rn
      FROM ({_TALL}) t JOIN (SELECT video_id, frame, COALESCE(x, 0) AS bx, COALESCE(y, 0) AS by_ FROM ball) b
        ON t.video_id = b.video_id AND t.frame = b.frame) t ON b.video_id = t.video_id AND b.frame = t.frame AND rn = 1"""))
def _(t):
    """Ids above 1 count as 1, so every frame with a player has a height."""
    placed = geometry.ball_on_mini_court(S.player_boxes(t.players), t.track, t.kps_seen, HEIGHTS, clamp=1)
    return rounded(placed, "dx_m", "dy_m", "map_x", "map_y")


@register("g9_foot_of_centre_box", query(
    "SELECT video_id, frame, det_idx, (x1 + x2) / 2 AS x, (y1 + y2) / 2 + (y2 - y1) / 2 AS y FROM players", "players"))
def _(t):
    middle = (F.col("y1") + F.col("y2")) / 2
    return t.players.select("video_id", "frame", "det_idx", ((F.col("x1") + F.col("x2")) / 2).alias("x"),
                            foot_of_centre_box(middle, F.col("y2") - F.col("y1")).alias("y"))


# --- moving camera -----------------------------------------------------------------------


@register("j7_common_points", query("SELECT * FROM common", "common"))
def _(t):
    return camera.common_points(t.kps_seen, size=SMALL)


@register("a8_displacement", query(
    f"""SELECT video_id, frame, {r('avg(((x - prev_x) * (x - prev_x) + (y - prev_y) * (y - prev_y)) / 2)')} AS mse, count(*) AS n_common
    FROM common GROUP BY video_id, frame HAVING count(*) > 3""", "common"))
def _(t):
    return rounded(camera.displacement(t.kps_seen), "mse")


@register("w9_camera_moved", query(f"SELECT video_id, frame, {r('mse')} AS mse, moved FROM moved", "moved"))
def _(t):
    return rounded(camera.camera_moved(t.kps_seen, size=SMALL), "mse")


@register("j8_latest_value", query(
    """SELECT b.video_id, b.frame, (SELECT arg_max(m.mse, m.frame) FROM moved m
      WHERE m.video_id = b.video_id AND m.frame <= b.frame AND m.moved AND m.mse IS NOT NULL) AS mse FROM ball b""", "ball", "moved"))
def _(t):
    updates = camera.camera_moved(t.kps_seen).filter("moved AND mse IS NOT NULL")
    return camera.latest_value(t.frames, updates, "mse", size=SMALL)


# The flat camera's matrix follows from how far it had moved in the frame it was fitted in.
_HELD = f"""SELECT b.video_id, b.frame, u.frame AS fitted_at, {moved("u.")} AS shift FROM ball b LEFT JOIN
  (SELECT *, lead(frame, 1, 9223372036854775807) OVER (PARTITION BY video_id ORDER BY frame) AS until FROM upd)
  u ON b.video_id = u.video_id AND b.frame >= u.frame AND b.frame < u.until"""
_FLAT_H = f"""SELECT video_id, frame, fitted_at, {r('1 / 0.875::DOUBLE + 0 * shift', 5)} AS h00, 0.0 * shift::DOUBLE AS h01, {r('-shift / 0.875::DOUBLE', 3)} AS h02,
    0.0 * shift::DOUBLE AS h10, {r('1 / 0.375::DOUBLE + 0 * shift', 5)} AS h11, {r('-20 / 0.375::DOUBLE + 0 * shift', 3)} AS h12,
    0.0 * shift::DOUBLE AS h20, 0.0 * shift::DOUBLE AS h21, 1.0 + 0 * shift::DOUBLE AS h22 FROM held"""
_MOVED = {"upd": "SELECT video_id, frame FROM flat_moved WHERE moved", "held": _HELD}
_SAMPLED = {
    "upd": "SELECT video_id, frame FROM flat WHERE frame >= 10 AND (frame - 1) % 40 = 0 GROUP BY ALL HAVING count(*) > 3", "held": _HELD}


def _flat_h(df):
    h = rounded(geometry.matrix_columns(df), *H, digits=5)
    return rounded(h, "h02", "h12", digits=3)


@register("g5_refreshed_homography", query(_FLAT_H, "flat_moved", extra=_MOVED))
def _(t):
    return _flat_h(camera.refreshed_homography(t.flat, t.frames))


@register("g5_refreshed_homography_small_pieces", query(_FLAT_H, "flat_moved", extra=_MOVED))
def _(t):
    return _flat_h(camera.refreshed_homography(t.flat, t.frames, size=SMALL))


@register("g5_refreshed_homography_one_video", query(_FLAT_H, "flat_moved", extra=_MOVED, one_video=True), one_video=True)
def _(t):
    return _flat_h(camera.refreshed_homography(t.flat, t.frames, size=SMALL))


@register("g6_sampled_homography", query(_FLAT_H, "flat", extra=_SAMPLED))
def _(t):
    return _flat_h(camera.sampled_homography(t.flat, t.frames, 40, 10))


_BY_FRAME = f"""SELECT b.video_id, b.frame, x, y, {r('(x - shift) / 0.875::DOUBLE', 3)} AS map_x, {r('(y - 20) / 0.375::DOUBLE + 0 * shift', 3)} AS map_y
    FROM ball b JOIN held h ON b.video_id = h.video_id AND b.frame = h.frame"""


@register("g3_project_by_frame", query(_BY_FRAME, "flat_moved", extra=_MOVED))
def _(t):
    """Each point by the matrix that holds in its frame."""
    return rounded(geometry.project_points(t.track, camera.refreshed_homography(t.flat, t.frames)), "map_x", "map_y", digits=3)


# --- hits on the map ---------------------------------------------------------------------


@register("q16_velocity_samples", query(
    f"""SELECT b.video_id, b.frame, b.x, b.y, vx, {r('vy', 9)} AS vy, COALESCE(n.near_hand, FALSE) AS near_hand,
      trunc({project('b.x', 'b.y', 0)})::INT AS map_x, trunc({project('b.x', 'b.y', 1)})::INT AS map_y
    FROM (SELECT *, x - lag(x) OVER w AS vx, (y - lag(y) OVER w) * (1 + ({FRAME_H} - y) * 0.4::DOUBLE / {FRAME_H}) AS vy FROM ball
      WINDOW w AS (PARTITION BY video_id ORDER BY frame)) b
    LEFT JOIN (SELECT video_id, frame, bool_or(dist < radius) AS near_hand FROM hand_dist GROUP BY ALL) n
      ON b.video_id = n.video_id AND b.frame = n.frame
    JOIN video_h v ON b.video_id = v.video_id WHERE vx IS NOT NULL""", "hand_dist", "video_h"))
def _(t):
    return rounded(hits.velocity_samples(t.track, t.hands, geometry.video_homography(t.kps), FRAME_H), "vy", digits=9)


# --- overlay -----------------------------------------------------------------------------

_MINI_MAP = f"""SELECT p.video_id, p.frame, layer, item, trunc({project('x', 'y', 0)})::INT AS map_x, trunc({project('x', 'y', 1)})::INT AS map_y,
    layer = 'ball' AND t.frame IS NOT NULL AS bounce
  FROM (SELECT video_id, frame, 'player' AS layer, track_id::VARCHAR AS item, trunc((x1 + x2) / 2) AS x, trunc((y1 + y2) / 2) AS y FROM kept
    UNION ALL SELECT video_id, frame, 'ball', 'ball', x::DOUBLE, y::DOUBLE FROM fill_compat) p
  JOIN video_h v ON p.video_id = v.video_id
  LEFT JOIN turning_filled t ON p.video_id = t.video_id AND p.frame = t.frame"""


def _drawn_tables() -> dict[str, str]:
    """Chosen players, and turning points of the filled track."""
    from framewise.catalog.sql import CTES

    return {
        "kept": """SELECT p.* FROM player_boxes p WHERE EXISTS (SELECT 1 FROM chosen c
          WHERE c.video_id = p.video_id AND c.track_id = p.track_id)""",
        "turning_filled": "SELECT video_id, frame FROM (" + CTES["turning_all"][0].replace("FROM filled)", "FROM fill_compat)") + ") WHERE turn",
    }


_NEEDS = ("chosen", "player_boxes", "fill_compat", "video_h")


def match(t, **options) -> Match:
    """The main flow on the sample tables."""
    return Match(t.track, t.players, t.kps, **options)


@register("o2_mini_map", query(_MINI_MAP, *_NEEDS, extra=_drawn_tables()))
def _(t):
    return match(t).mini_map


@register("o2_mini_map_one_video", query(_MINI_MAP, *_NEEDS, extra=_drawn_tables(), one_video=True), one_video=True)
def _(t):
    return match(t, size=SMALL).mini_map


_MOVING_MAP = """SELECT p.video_id, p.frame, layer, item, (x - shift) / 0.875::DOUBLE AS mx, (y - 20) / 0.375::DOUBLE AS my,
    layer = 'ball' AND t.frame IS NOT NULL AS bounce
  FROM (SELECT video_id, frame, 'player' AS layer, track_id::VARCHAR AS item, trunc((x1 + x2) / 2) AS x, trunc((y1 + y2) / 2) AS y FROM kept
    UNION ALL SELECT video_id, frame, 'ball', 'ball', x::DOUBLE, y::DOUBLE FROM fill_compat) p
  JOIN held h ON p.video_id = h.video_id AND p.frame = h.frame
  LEFT JOIN turning_filled t ON p.video_id = t.video_id AND p.frame = t.frame"""


def _moving_tables() -> dict[str, str]:
    # The court points of this camera, in frame 0, decide which players are the main ones.
    from framewise.catalog.sql import CTES

    pairs = CTES["first_pairs"][0].replace("kps_first", "(SELECT * FROM flat WHERE frame = 0)")
    chosen = CTES["chosen"][0].replace("first_pairs", "flat_pairs")
    tables = _drawn_tables()
    return {"flat_pairs": pairs, "flat_chosen": chosen, **_MOVED, **tables, "kept": tables["kept"].replace("FROM chosen", "FROM flat_chosen")}


@register("o2_mini_map_of_moving_camera", query(
    f"SELECT video_id, frame, layer, item, bounce, {r('mx', 3)} AS map_x, {r('my', 3)} AS map_y FROM ({_MOVING_MAP})",
    "player_boxes", "fill_compat", "flat_moved", extra=_moving_tables()))
def _(t):
    """Places to three digits: whole pixels would differ where a fit puts a place just beside one."""
    m = Match(t.track, t.players, t.flat, moving=True)
    places = overlay.mini_map(m.players, m.filled, m.bounces, m.matrices, whole=False)
    return rounded(places, "map_x", "map_y", digits=3)


@register("o2_mini_map_with_scored_bounces", query(
    _MINI_MAP.replace("turning_filled", "bounces"), *_NEEDS, "bounces", extra=_drawn_tables()))
def _(t):
    """The bounce detector's frames, not the turning points; scored on the raw track, as no gap is extrapolated."""
    m = match(t, scorer=bounce.turn_score())
    m.bounces = models.predict_bounces(t.track, bounce.turn_score(), smooth=False)
    return m.mini_map


@register("o3_drawn_ball", query("SELECT video_id, frame, x, y FROM fill_compat WHERE x <> 0", "fill_compat"))
def _(t):
    return overlay.drawn_ball(fill.fill_ball(t.track))


_EMPTY = "NULL::DOUBLE AS x2, NULL::DOUBLE AS y2"
_OVERLAY = f"""
  SELECT video_id, frame, 'keypoint' AS layer, kp_idx::VARCHAR AS item, trunc(x) AS x, trunc(y) AS y, {_EMPTY}, kp_idx::VARCHAR AS label FROM kps
  UNION ALL SELECT video_id, frame, 'ball', 'ball', x::DOUBLE, y::DOUBLE, NULL, NULL, NULL FROM fill_compat WHERE x <> 0
  UNION ALL SELECT video_id, frame, 'player', track_id::VARCHAR, trunc(x1), trunc(y1), trunc(x2), trunc(y2), 'Player ID: ' || track_id FROM kept
  UNION ALL SELECT video_id, frame, 'frame_number', 'frame', 10, 30, NULL, NULL, 'Frame: ' || frame FROM ball
  UNION ALL SELECT b.video_id, b.frame, 'bounce', 'bounce', b.x::DOUBLE, b.y::DOUBLE, NULL, NULL, NULL
    FROM fill_compat b JOIN turning_filled t ON b.video_id = t.video_id AND b.frame = t.frame
  UNION ALL SELECT video_id, frame, 'map_' || layer, item, map_x, map_y, NULL, NULL, NULL FROM mini
  UNION ALL SELECT video_id, frame, 'map_bounce', item, map_x, map_y, NULL, NULL, NULL FROM mini WHERE bounce
  UNION ALL SELECT v.video_id, NULL, 'court', l.item, l.x, l.y, l.x2, l.y2, NULL FROM (SELECT DISTINCT video_id FROM ball) v
    CROSS JOIN (VALUES {MAP_LINES}) AS l(item, x, y, x2, y2)"""


@register("o1_overlay", query(
    f"SELECT * REPLACE (COALESCE(frame, -1) AS frame) FROM ({_OVERLAY})", *_NEEDS, "kps", extra=_drawn_tables() | {"mini": _MINI_MAP}))
def _(t):
    return match(t).overlay.withColumn("frame", F.coalesce("frame", F.lit(-1)))


@register("o6_layers_until_frame", query(
    f"SELECT layer, count(*) AS n FROM ({_OVERLAY}) WHERE frame IS NULL OR frame <= 400 GROUP BY layer",
    *_NEEDS, "kps", extra=_drawn_tables() | {"mini": _MINI_MAP}))
def _(t):
    return overlay.until(match(t).overlay, 400).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
