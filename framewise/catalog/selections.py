"""Queries on choosing boxes, tracks and frames."""

from pyspark.sql import functions as F

from framewise.catalog import register, rounded
from framewise.catalog.sql import query
from framewise.catalog.sql import rounded as r
from framewise.operators import select as S
from framewise.operators import turning, windows
from framewise.sources import tables

BOX = "x1, y1, x2, y2"


@register("f1_of_class", query("SELECT * EXCLUDE (track_id) FROM players WHERE cls = 'person'", "players"))
def _(t):
    return S.of_class(t.players).drop("track_id")


@register("f2_before_unidentified", query(
    """SELECT * EXCLUDE (cut) FROM (SELECT *, max(CASE WHEN track_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, frame
      ORDER BY det_idx ROWS UNBOUNDED PRECEDING) AS cut FROM players) WHERE cut = 0""", "players"))
def _(t):
    return S.before_unidentified(t.players)


def _repeated(t):
    """Boxes where the tracker gives two boxes of a frame the same id."""
    return t.players.withColumn("track_id", F.when(F.col("det_idx") == 3, 1).otherwise(F.col("track_id"))).filter("track_id IS NOT NULL")


@register("f3_last_per_track", query(
    f"""SELECT video_id, frame, track_id, min(det_idx) AS det_idx, {', '.join(f'arg_max({c}, det_idx) AS {c}' for c in ('x1', 'y1', 'x2', 'y2'))}
    FROM (SELECT * EXCLUDE (track_id), CASE WHEN det_idx = 3 THEN 1 ELSE track_id END AS track_id FROM players)
    WHERE track_id IS NOT NULL GROUP BY video_id, frame, track_id""", "players"))
def _(t):
    return S.last_per_track(_repeated(t))


@register("f4_first_box", query(f"SELECT video_id, frame, {BOX} FROM players WHERE det_idx = 0", "players"))
def _(t):
    return tables.first_box(t.players)


@register("f5_game_time", query("SELECT video_id, frame, x, y FROM ball WHERE (frame // 50) % 3 <> 2", "ball"))
def _(t):
    mask = t.frames.filter(F.floor(F.col("frame") / 50) % 3 != 2)
    return S.game_time(t.track, mask)


@register("f7_mask_and_count", query("SELECT video_id, count(*) AS n_far FROM steps WHERE distance > 100 GROUP BY video_id", "steps"))
def _(t):
    from framewise.operators.fill import step_distance

    return step_distance(t.track).filter("distance > 100").groupBy("video_id").agg(F.count(F.lit(1)).alias("n_far"))


@register("f9_keyframes", query("SELECT video_id, frame, x, y FROM ball WHERE frame >= 1 AND (frame - 1) % 25 = 0", "ball"))
def _(t):
    return S.keyframes(t.track, 25)


@register("j1_align", query(
    f"SELECT b.video_id, b.frame, x, y, det_idx, {BOX} FROM ball b JOIN players p ON b.video_id = p.video_id AND b.frame = p.frame", "players"))
def _(t):
    return S.align(t.track, t.players.select("video_id", "frame", "det_idx", "x1", "y1", "x2", "y2"))


@register("j2_complete_frames", query(
    """SELECT b.video_id, b.frame, kp_idx, k.x, k.y FROM ball b
    LEFT JOIN kps_seen k ON b.video_id = k.video_id AND b.frame = k.frame""", "kps_seen"))
def _(t):
    """All court points that are seen."""
    return tables.complete_frames(t.frames, t.kps_seen)


@register("j2_complete_frames_of_ball", query("SELECT video_id, frame, x, y FROM ball", "ball"))
def _(t):
    """The detector has no row where it sees no ball; these frames come back as missing points."""
    return tables.complete_frames(t.frames, t.track.dropna(subset=["x", "y"]))


@register("j3_first_frame_distances", query(
    f"SELECT video_id, track_id, det_idx, kp_idx, {r('dist')} AS dist FROM first_pairs", "first_pairs"))
def _(t):
    return rounded(S.first_frame_distances(S.player_boxes(t.players), t.kps), "dist")


@register("j4_keep_tracks", query(
    f"""SELECT p.video_id, p.frame, p.track_id, det_idx, {BOX} FROM player_boxes p
    WHERE EXISTS (SELECT 1 FROM chosen c WHERE c.video_id = p.video_id AND c.track_id = p.track_id)""", "chosen", "player_boxes"))
def _(t):
    boxes = S.player_boxes(t.players)
    return S.keep_tracks(boxes, S.choose_players(boxes, t.kps))


@register("j4_keep_in_map", query(
    f"""SELECT p.video_id, p.frame, p.track_id, {BOX} FROM player_boxes p
    WHERE EXISTS (SELECT 1 FROM chosen c WHERE c.video_id = p.video_id AND c.track_id = p.track_id)""", "chosen", "player_boxes"))
def _(t):
    boxes = S.player_boxes(t.players)
    nested = S.keep_in_map(tables.as_track_map(boxes), S.choose_players(boxes, t.kps))
    return nested.select("video_id", "frame", F.explode("boxes").alias("track_id", "b")).select("video_id", "frame", "track_id", "b.*")


@register("j5_flag_frames", query(
    """SELECT b.video_id, b.frame, x, y, t.frame IS NOT NULL AS turn FROM ball b
    LEFT JOIN turning t ON b.video_id = t.video_id AND b.frame = t.frame""", "turning"))
def _(t):
    return S.flag_frames(t.track, turning.turning_points(t.track), "turn")


_CLASS_OF = {0: "far player", 1: "near player", 4: "racket"}


@register("j9_look_up", query(
    """SELECT video_id, frame, det_idx, CASE det_idx WHEN 0 THEN 'far player' WHEN 1 THEN 'near player' WHEN 4 THEN 'racket' END AS name
    FROM players""", "players"))
def _(t):
    return S.look_up(t.players.select("video_id", "frame", "det_idx"), "det_idx", _CLASS_OF, "name")


@register("a1_nearest_point_distance", query(
    f"SELECT video_id, track_id, {r('min(dist)')} AS min_dist, min(det_idx) AS det_idx FROM first_pairs GROUP BY ALL", "first_pairs"))
def _(t):
    return rounded(S.nearest_point_distance(S.player_boxes(t.players), t.kps), "min_dist")


@register("a2_choose_players", query(f"SELECT video_id, track_id, {r('min_dist')} AS min_dist, det_idx, rank FROM chosen", "chosen"))
def _(t):
    return rounded(S.choose_players(S.player_boxes(t.players), t.kps), "min_dist")


@register("a4_mean_position", query(
    f"SELECT video_id, {r('avg(x)')} AS mean_x, {r('avg(y)')} AS mean_y FROM ball GROUP BY video_id", "ball"))
def _(t):
    return rounded(S.mean_position(t.track), "mean_x", "mean_y")


@register("a5_extremes", query(
    "SELECT video_id, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM ball GROUP BY video_id", "ball"))
def _(t):
    return windows.extremes(t.track, ["x", "y"])


@register("a6_nearest_player", query(
    f"""SELECT video_id, frame, least(m.track_id, 1) AS track_id, {r('m.dist')} AS dist
    FROM (SELECT p.video_id, p.frame, min({{'dist': sqrt((bx - cx) * (bx - cx) + (by_ - cy) * (by_ - cy)), 'det_idx': det_idx, 'track_id': track_id}}) AS m
      FROM (SELECT *, trunc((x1 + x2) / 2) AS cx, trunc((y1 + y2) / 2) AS cy FROM player_boxes) p
      JOIN (SELECT video_id, frame, COALESCE(x, 0) AS bx, COALESCE(y, 0) AS by_ FROM ball) b
        ON p.video_id = b.video_id AND p.frame = b.frame GROUP BY ALL)""", "player_boxes"))
def _(t):
    return rounded(S.nearest_player(S.player_boxes(t.players), t.track), "dist")


def _nearest_point_sql(metric: str) -> str:
    return query(
        f"""SELECT video_id, frame, track_id, x, y, {r('kp_dist')} AS kp_dist, kp_idx, kx, ky
        FROM (SELECT f.video_id, f.frame, f.track_id, f.x, f.y, {metric} AS kp_dist, k.kp_idx, k.x AS kx, k.y AS ky,
            row_number() OVER (PARTITION BY f.video_id, f.frame, f.track_id ORDER BY {metric}, k.kp_idx) AS place
          FROM (SELECT video_id, frame, track_id, trunc((x1 + x2) / 2)::INT AS x, y2 AS y FROM player_boxes) f
          LEFT JOIN (SELECT * FROM kps_seen WHERE kp_idx IN (0, 2, 12, 13)) k ON f.video_id = k.video_id AND f.frame = k.frame)
        WHERE place = 1""",
        "player_boxes", "kps_seen")


def _nearest_point(t, metric):
    from framewise.functions.points import foot_point

    feet = S.player_boxes(t.players).select(
        "video_id", "frame", "track_id", foot_point(F.col("x1"), F.col("x2"), F.col("y2")).alias("f")
    ).select("video_id", "frame", "track_id", "f.*")
    return rounded(S.nearest_court_point(feet, t.kps_seen, metric=metric), "kp_dist")


@register("a7_nearest_court_point_by_height", _nearest_point_sql("abs(f.y - k.y)"))
def _(t):
    return _nearest_point(t, "dy")


@register("a7_nearest_court_point", _nearest_point_sql("sqrt((f.x - k.x) * (f.x - k.x) + (f.y - k.y) * (f.y - k.y))"))
def _(t):
    return _nearest_point(t, "euclid")


@register("a9_point_counts", query(
    "SELECT video_id, frame, count(*) AS n_points FROM kps_seen GROUP BY ALL HAVING count(*) > 3", "kps_seen"))
def _(t):
    from framewise.operators.camera import point_counts

    return point_counts(t.kps_seen)


@register("o4_common_labels", query(
    """SELECT video_id, frame, kp_idx FROM (SELECT video_id, frame, kp_idx, 0 AS later FROM kps_seen
    UNION ALL SELECT video_id, frame + 1, kp_idx, 1 FROM kps_seen) GROUP BY video_id, frame, kp_idx
    HAVING min(later) < max(later)""", "kps_seen"))
def _(t):
    """Labels that a frame shares with the one before."""
    return S.labels_of_frame_before(t.kps_seen)


@register("o5_sorted_distances", query(
    f"""SELECT video_id, track_id, {r('min_dist')} AS min_dist, row_number() OVER (PARTITION BY video_id ORDER BY min_dist, det_idx)::INT AS rank
    FROM (SELECT video_id, track_id, min(dist) AS min_dist, min(det_idx) AS det_idx FROM first_pairs GROUP BY ALL)""", "first_pairs"))
def _(t):
    return rounded(S.choose_players(S.player_boxes(t.players), t.kps, k=None).drop("det_idx"), "min_dist")
