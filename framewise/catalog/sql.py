"""The sample tables and common steps as SQL, for checks in another engine."""

from framewise.operators import geometry
from framewise.sources.samples import BOXES, COURT_POINTS, FRAME_H, FRAME_W

VIDEO = "CAST(floor(user_id/15) AS BIGINT)"
# Places of the court points on the map (index, x, y), and the lines drawn on it (name, x1, y1, x2, y2).
MAP_POINTS = """(0, 264.0, 317.0), (1, 702.0, 317.0), (2, 264.0, 1268.0), (3, 702.0, 1268.0), (4, 318.0, 317.0), (5, 318.0,
    1268.0), (6, 648.0, 317.0), (7, 648.0, 1268.0), (8, 318.0, 536.0), (9, 648.0, 536.0), (10, 318.0, 1049.0),
    (11, 648.0, 1049.0), (12, 483.0, 536.0), (13, 483.0, 1049.0)"""
MAP_LINES = """('canvas', 0, 0, 967, 1585), ('court', 264, 317, 702, 1268), ('net', 264, 792, 702, 792), ('singles', 318,
    317, 648, 1268), ('service', 318, 536, 648, 1049), ('centre', 483, 536, 483, 1049)"""


def rounded(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def _values(rows) -> str:
    return ",".join(str(r).replace("None", "NULL") for r in rows)


def moved(prefix: str = "b.") -> str:
    return f"({prefix}video_id % 5 + 6 * (floor({prefix}frame / 100) % 3))"


def fill(source: str, cols=("x", "y"), linear=True, backward=True, keep: str = "") -> str:
    """Interpolated and back-filled columns of a (video_id, frame, ...) source."""
    parts, outs = [], []
    for c in cols:
        at = f"CASE WHEN {c} IS NOT NULL THEN frame END"
        parts += [
            f"last_value({at} IGNORE NULLS) OVER back AS {c}_pf, last_value({c} IGNORE NULLS) OVER back AS {c}_pv",
            f"first_value({at} IGNORE NULLS) OVER ahead AS {c}_nf, first_value({c} IGNORE NULLS) OVER ahead AS {c}_nv",
        ]
        e = c
        if linear:
            e = f"COALESCE({c}, ({c}_nv - {c}_pv) / ({c}_nf - {c}_pf) * (frame - {c}_pf) + {c}_pv, {c}_pv)"
        outs.append(f"COALESCE({e}, {c}_nv) AS {c}" if backward else f"{e} AS {c}")
    return f"""SELECT video_id, frame, {keep}{', '.join(outs)} FROM (
        SELECT *, {', '.join(parts)} FROM {source}
        WINDOW back AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               ahead AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def quantile(source: str, q: float) -> str:
    """The q quantile of `distance` per video over frames > 0, linear between ranks."""
    return f"""SELECT video_id, CASE WHEN t < 0.5 THEN lo + (hi - lo) * t ELSE hi - (hi - lo) * (1 - t) END AS threshold
      FROM (SELECT video_id, any_value(r - floor(r)) AS t,
              max(CASE WHEN i = floor(r) THEN distance END) AS lo, max(CASE WHEN i = ceil(r) THEN distance END) AS hi
            FROM (SELECT video_id, distance, (count(*) OVER (PARTITION BY video_id) - 1) * {q}::DOUBLE AS r,
                    row_number() OVER (PARTITION BY video_id ORDER BY distance) - 1 AS i
                  FROM {source} WHERE frame > 0 AND distance IS NOT NULL) GROUP BY video_id)"""


def masked(source: str, limit: str) -> str:
    return f"""SELECT s.video_id, s.frame, CASE WHEN s.distance < l.threshold THEN s.x END AS x,
      CASE WHEN s.distance < l.threshold THEN s.y END AS y
      FROM {source} s LEFT JOIN {limit} l ON s.video_id = l.video_id"""


def homography(source: str) -> str:
    """Closed form of the matrix taking points 4, 6, 5, 7 of a frame onto the court rectangle."""
    g = geometry
    return f"""
  SELECT video_id, frame,
    (w * u0 + l * w0) / w2 AS h00, (w * u1 + l * w1) / w2 AS h01, (w * u2 + l * w2) / w2 AS h02,
    (h * v0 + t * w0) / w2 AS h10, (h * v1 + t * w1) / w2 AS h11, (h * v2 + t * w2) / w2 AS h12,
    w0 / w2 AS h20, w1 / w2 AS h21, w2 / w2 AS h22
  FROM (SELECT *, e - f * hh AS u0, c * hh - b AS u1, b * f - c * e AS u2,
      f * gg - d AS v0, a - c * gg AS v1, c * d - a * f AS v2,
      d * hh - e * gg AS w0, b * gg - a * hh AS w1, a * e - b * d AS w2,
      {g.COURT_W}.0 AS w, {g.COURT_H}.0 AS h, {g.LEFT}.0 AS l, {g.TOP}.0 AS t
    FROM (SELECT *, x1 - x0 + gg * x1 AS a, x3 - x0 + hh * x3 AS b, x0 AS c,
        y1 - y0 + gg * y1 AS d, y3 - y0 + hh * y3 AS e, y0 AS f
      FROM (SELECT *, (sx * vy - vx * sy) / (ux * vy - vx * uy) AS gg, (ux * sy - sx * uy) / (ux * vy - vx * uy) AS hh
        FROM (SELECT *, x1 - x2 AS ux, y1 - y2 AS uy, x3 - x2 AS vx, y3 - y2 AS vy,
            x0 - x1 + x2 - x3 AS sx, y0 - y1 + y2 - y3 AS sy
          FROM (SELECT video_id, frame,
              max(CASE WHEN kp_idx = 4 THEN x END)::DOUBLE AS x0, max(CASE WHEN kp_idx = 4 THEN y END)::DOUBLE AS y0,
              max(CASE WHEN kp_idx = 6 THEN x END)::DOUBLE AS x1, max(CASE WHEN kp_idx = 6 THEN y END)::DOUBLE AS y1,
              max(CASE WHEN kp_idx = 7 THEN x END)::DOUBLE AS x2, max(CASE WHEN kp_idx = 7 THEN y END)::DOUBLE AS y2,
              max(CASE WHEN kp_idx = 5 THEN x END)::DOUBLE AS x3, max(CASE WHEN kp_idx = 5 THEN y END)::DOUBLE AS y3
            FROM {source} GROUP BY video_id, frame)))))"""


def project(x: str, y: str, axis: int) -> str:
    scale = f"(h20 * {x} + h21 * {y} + h22)"
    i = axis
    return f"CASE WHEN {scale} = 0 THEN 0 ELSE (h{i}0 * {x} + h{i}1 * {y} + h{i}2) / {scale} END"


FEATURE_COLS = []
for _c in "xy":
    for _i in (1, 2):
        _f = "abs" if _c == "x" else ""
        FEATURE_COLS.append(f"{_f}({_c}b{_i} - {_c}) AS {_c}_diff_{_i}, {_f}({_c}a{_i} - {_c}) AS {_c}_diff_inv_{_i}")

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "ball": (
        f"""SELECT video_id, frame,
      CASE WHEN event_type = 'error' THEN NULL ELSE CAST(300 + 5*abs(frame%200 - 100) + k%5
        + CASE WHEN event_type = 'signup' AND k < 25 THEN 600 ELSE 0 END AS DOUBLE) + (k%4) / 4.0::DOUBLE END AS x,
      CASE WHEN event_type = 'error' THEN NULL ELSE CAST(200 + 8*abs(frame%120 - 60) + k%3 AS DOUBLE) + (k%8) / 8.0::DOUBLE END AS y, k
    FROM (SELECT {VIDEO} AS video_id,
        CAST(row_number() OVER (PARTITION BY {VIDEO} ORDER BY ts, event_id) - 1 AS BIGINT) AS frame,
        event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)""",
        (),
    ),
    "ball_one": (
        """SELECT video_id, frame,
      CASE WHEN event_type = 'error' THEN NULL ELSE CAST(300 + 5*abs(frame%200 - 100) + k%5
        + CASE WHEN event_type = 'signup' AND k < 25 THEN 600 ELSE 0 END AS DOUBLE) + (k%4) / 4.0::DOUBLE END AS x,
      CASE WHEN event_type = 'error' THEN NULL ELSE CAST(200 + 8*abs(frame%120 - 60) + k%3 AS DOUBLE) + (k%8) / 8.0::DOUBLE END AS y, k
    FROM (SELECT 0::BIGINT AS video_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS frame,
        event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)""",
        (),
    ),
    "players": (
        f"""SELECT b.video_id, b.frame, p.det_idx,
      CASE WHEN b.frame%97 = 96 AND p.det_idx = 1 THEN NULL ELSE p.track END AS track_id, p.cls,
      CAST(p.x1 + b.k%7 + abs(b.frame%80 - 40)*2 AS DOUBLE) AS x1, CAST(p.y1 + b.k%3 AS DOUBLE) AS y1,
      CAST(p.x2 + b.k%7 + abs(b.frame%80 - 40)*2 AS DOUBLE) AS x2, CAST(p.y2 + b.k%5 AS DOUBLE) AS y2
    FROM ball b CROSS JOIN (VALUES {_values(BOXES)}) AS p(det_idx, track, cls, x1, y1, x2, y2)
    WHERE NOT (b.k%13 = 0 AND p.det_idx = 2)""",
        ("ball",),
    ),
    "kps": (
        f"""SELECT b.video_id, b.frame, p.kp_idx, CAST(p.kx + {moved()} AS DOUBLE) AS x, CAST(p.ky AS DOUBLE) AS y
    FROM ball b CROSS JOIN (VALUES {_values(COURT_POINTS)}) AS p(kp_idx, kx, ky)""",
        ("ball",),
    ),
    "court_raw": (
        f"""SELECT b.video_id, b.frame, p.kp_idx, (p.kx + {moved()}) * 224.0::DOUBLE / {FRAME_W} AS px,
      p.ky::DOUBLE * 224.0::DOUBLE / {FRAME_H} AS py
    FROM ball b CROSS JOIN (VALUES {_values(COURT_POINTS)}) AS p(kp_idx, kx, ky)""",
        ("ball",),
    ),
    "hands": (
        f"""SELECT b.video_id, b.frame, p.det_idx AS side,
      CAST((p.x1 + p.x2) / 2 + b.k%7 + abs(b.frame%80 - 40)*2 + 30 AS DOUBLE) AS hx,
      CAST((p.y1 + b.k%3 + p.y2 + b.k%5) / 2 AS DOUBLE) AS hy,
      CAST((p.x1 + p.x2) / 2 + b.k%7 + abs(b.frame%80 - 40)*2 AS DOUBLE) AS nose_x, CAST(p.y1 + b.k%3 AS DOUBLE) AS nose_y,
      CAST((p.x1 + p.x2) / 2 + b.k%7 + abs(b.frame%80 - 40)*2 AS DOUBLE) AS body_x, CAST(p.y2 + b.k%5 AS DOUBLE) AS body_y
    FROM ball b CROSS JOIN (VALUES {_values(BOXES[:2])}) AS p(det_idx, track, cls, x1, y1, x2, y2)""",
        ("ball",),
    ),
    "player_boxes": (
        """SELECT video_id, frame, track_id, min(det_idx) AS det_idx, arg_max(x1, det_idx) AS x1, arg_max(y1, det_idx) AS y1,
      arg_max(x2, det_idx) AS x2, arg_max(y2, det_idx) AS y2
    FROM (SELECT *, max(CASE WHEN track_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, frame ORDER BY det_idx
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cut FROM players)
    WHERE cut = 0 AND cls = 'person' GROUP BY video_id, frame, track_id""",
        ("players",),
    ),
    "filled": (fill("ball"), ("ball",)),
    "turning_all": (
        f"""SELECT video_id, frame, delta, COALESCE(n = 30 AND frame >= 1
        AND ((delta > 0 AND nxt < 0 AND neg >= 25) OR (delta < 0 AND nxt > 0 AND pos >= 25)), FALSE) AS turn
    FROM (SELECT *, lead(delta) OVER w AS nxt, sum(CASE WHEN delta < 0 THEN 1 ELSE 0 END) OVER nx AS neg,
        sum(CASE WHEN delta > 0 THEN 1 ELSE 0 END) OVER nx AS pos, count(*) OVER nx AS n
      FROM (SELECT video_id, frame, ma - lag(ma) OVER (PARTITION BY video_id ORDER BY frame) AS delta
        FROM (SELECT video_id, frame, avg(y) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ma
          FROM filled))
      WINDOW w AS (PARTITION BY video_id ORDER BY frame),
             nx AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING))""",
        ("filled",),
    ),
    "turning": ("SELECT video_id, frame FROM turning_all WHERE turn", ("turning_all",)),
    "steps": (
        """SELECT video_id, frame, x AS x_raw, y AS y_raw, COALESCE(x, 0) AS x, COALESCE(y, 0) AS y,
      (COALESCE(xm, 0) - COALESCE(xs, 0)) * (COALESCE(xm, 0) - COALESCE(xs, 0))
      + (COALESCE(ym, 0) - COALESCE(ys, 0)) * (COALESCE(ym, 0) - COALESCE(ys, 0)) AS distance
    FROM (SELECT *, lag(xm) OVER w AS xs, lead(ym) OVER w AS ys
      FROM (SELECT video_id, frame, x, y, avg(x) OVER m AS xm, avg(y) OVER m AS ym FROM ball
        WINDOW m AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
      WINDOW w AS (PARTITION BY video_id ORDER BY frame))""",
        ("ball",),
    ),
    "step_limit": (quantile("steps", 0.95), ("steps",)),
    "step_masked": (masked("steps", "step_limit"), ("steps", "step_limit")),
    "fill_compat_raw": (fill("step_masked"), ("step_masked",)),
    "fill_compat": (
        "SELECT video_id, frame, round_even(x, 0)::INT AS x, round_even(y, 0)::INT AS y FROM fill_compat_raw",
        ("fill_compat_raw",),
    ),
    "step_strict": (
        "SELECT video_id, frame, x_raw AS x, y_raw AS y, distance FROM steps",
        ("steps",),
    ),
    "strict_masked": (masked("step_strict", "step_limit"), ("step_strict", "step_limit")),
    "features": (
        """SELECT *, abs(x_diff_1 / (x_diff_inv_1 + 1e-15::DOUBLE)) AS x_div_1, abs(x_diff_2 / (x_diff_inv_2 + 1e-15::DOUBLE)) AS x_div_2,
      y_diff_1 / (y_diff_inv_1 + 1e-15::DOUBLE) AS y_div_1, y_diff_2 / (y_diff_inv_2 + 1e-15::DOUBLE) AS y_div_2
    FROM (SELECT video_id, frame, """
        + ", ".join(FEATURE_COLS)
        + """ FROM (SELECT video_id, frame, x, y, lag(x, 1) OVER w AS xb1, lag(x, 2) OVER w AS xb2, lead(x, 1) OVER w AS xa1,
          lead(x, 2) OVER w AS xa2, lag(y, 1) OVER w AS yb1, lag(y, 2) OVER w AS yb2, lead(y, 1) OVER w AS ya1, lead(y, 2) OVER w AS ya2
        FROM ball WINDOW w AS (PARTITION BY video_id ORDER BY frame))
      WHERE x IS NOT NULL AND xb1 IS NOT NULL AND xb2 IS NOT NULL AND xa1 IS NOT NULL AND xa2 IS NOT NULL)""",
        ("ball",),
    ),
    "scored": (
        """SELECT video_id, frame, CASE WHEN y_diff_1 < 0 AND y_diff_inv_1 < 0 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END
      + least(x_div_1, 1.0::DOUBLE) * 0.3::DOUBLE
      + CASE WHEN y_diff_2 * y_diff_inv_2 > 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS score FROM features""",
        ("features",),
    ),
    "bounces": (
        """SELECT video_id, frame, score FROM (
      SELECT *, max(CASE WHEN rising THEN pos END) OVER (PARTITION BY video_id, run) AS best
      FROM (SELECT *, lag(score) OVER w IS NULL OR score > lag(score) OVER w AS rising
        FROM (SELECT *, pos - row_number() OVER (PARTITION BY video_id ORDER BY pos) AS run
          FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS pos FROM scored) WHERE score > 0.45)
        WINDOW w AS (PARTITION BY video_id, run ORDER BY pos))) WHERE pos = best""",
        ("scored",),
    ),
    "hand_dist": (
        """SELECT b.video_id, b.frame, h.side, b.x, b.y, sqrt((b.x - hx) * (b.x - hx) + (b.y - hy) * (b.y - hy)) AS dist,
      trunc(CASE h.side WHEN 0 THEN 0.65::DOUBLE ELSE 0.6::DOUBLE END
        * sqrt((nose_x - body_x) * (nose_x - body_x) + (nose_y - body_y) * (nose_y - body_y)))::INT AS radius
    FROM ball b JOIN hands h ON b.video_id = h.video_id AND b.frame = h.frame WHERE b.x IS NOT NULL AND b.y IS NOT NULL""",
        ("ball", "hands"),
    ),
    "hits": (
        """SELECT video_id, side, frame, x, y, dist, radius FROM (
      SELECT *, min(CASE WHEN dist < radius THEN dist END) OVER (PARTITION BY video_id, side, stay ORDER BY frame
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nearest
      FROM (SELECT *, sum(CASE WHEN dist < radius THEN 0 ELSE 1 END) OVER (PARTITION BY video_id, side ORDER BY frame
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stay FROM hand_dist))
    WHERE dist < radius AND dist < COALESCE(nearest, radius)""",
        ("hand_dist",),
    ),
    # Exact images of the map places, without perspective, and how they move.
    "flat": (
        f"""SELECT k.video_id, k.frame, k.kp_idx, p.px * 0.875::DOUBLE + {moved("k.")} AS x, p.py * 0.375::DOUBLE + 20 AS y
    FROM kps_seen k JOIN (VALUES {MAP_POINTS}) AS p(i, px, py) ON k.kp_idx = p.i""",
        ("kps_seen",),
    ),
    "kps_first": ("SELECT * FROM kps WHERE frame = 0", ("kps",)),
    "video_h": (homography("kps_first"), ("kps_first",)),
    "chosen": (
        """SELECT video_id, track_id, min_dist, det_idx, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY min_dist, det_idx)::INT AS rank
      FROM (SELECT video_id, track_id, min(dist) AS min_dist, min(det_idx) AS det_idx FROM first_pairs GROUP BY ALL)) WHERE rank <= 2""",
        ("first_pairs",),
    ),
    "first_pairs": (
        """SELECT p.video_id, p.track_id, p.det_idx, k.kp_idx,
      sqrt((cx - k.x) * (cx - k.x) + (cy - k.y) * (cy - k.y)) AS dist
    FROM (SELECT *, trunc((x1 + x2) / 2) AS cx, trunc((y1 + y2) / 2) AS cy FROM player_boxes WHERE frame = 0) p
    JOIN kps_first k ON p.video_id = k.video_id""",
        ("player_boxes", "kps_first"),
    ),
    "ball_map": (
        f"""SELECT b.video_id, b.frame, x, y, {project('x', 'y', 0)} AS map_x, {project('x', 'y', 1)} AS map_y
    FROM filled b JOIN video_h v ON b.video_id = v.video_id""",
        ("filled", "video_h"),
    ),
    "common": (
        """SELECT c.video_id, c.frame, p.frame AS prev_frame, c.kp_idx, c.x, c.y, p.x AS prev_x, p.y AS prev_y
    FROM kps_seen c JOIN (SELECT video_id, frame, lag(frame) OVER (PARTITION BY video_id ORDER BY frame) AS prev_frame
      FROM (SELECT video_id, frame FROM kps_seen GROUP BY ALL HAVING count(*) > 3)) f
      ON c.video_id = f.video_id AND c.frame = f.frame
    JOIN kps_seen p ON p.video_id = f.video_id AND p.frame = f.prev_frame AND p.kp_idx = c.kp_idx""",
        ("kps_seen",),
    ),
    # Court points as a detector finds them: some are lost in some frames.
    "kps_seen": (
        "SELECT k.* FROM kps k WHERE NOT (k.frame % 10 = 3 AND k.kp_idx > 2) AND NOT (k.frame % 7 = 5 AND k.kp_idx % 2 = 0)",
        ("kps",),
    ),
    "moved": (
        """SELECT f.video_id, f.frame, CASE WHEN m.n >= 4 THEN m.mse END AS mse,
      f.first OR COALESCE(m.n, 0) < 4 OR m.mse > 10 AS moved
    FROM (SELECT video_id, frame, row_number() OVER (PARTITION BY video_id ORDER BY frame) = 1 AS first
      FROM (SELECT video_id, frame FROM kps_seen GROUP BY ALL HAVING count(*) > 3)) f
    LEFT JOIN (SELECT video_id, frame, avg(((x - prev_x) * (x - prev_x) + (y - prev_y) * (y - prev_y)) / 2) AS mse, count(*) AS n
      FROM common GROUP BY ALL) m ON f.video_id = m.video_id AND f.frame = m.frame""",
        ("common", "kps_seen"),
    ),
}

CTES["flat_common"] = (CTES["common"][0].replace("kps_seen", "flat"), ("flat",))
CTES["flat_moved"] = (CTES["moved"][0].replace("kps_seen", "flat").replace("common", "flat_common"), ("flat_common", "flat"))


def query(select: str, *needs: str, extra: dict[str, str] | None = None, one_video: bool = False) -> str:
    """A SELECT with the common tables it needs, and its own tables in order."""
    names: list[str] = []

    def add(name: str) -> None:
        if name in names:
            return
        for d in CTES[name][1]:
            add(d)
        names.append(name)

    for n in needs:
        add(n)
    parts = [f"{n} AS ({CTES['ball_one' if one_video and n == 'ball' else n][0]})" for n in names]
    parts += [f"{n} AS ({body})" for n, body in (extra or {}).items()]
    return f"WITH RECURSIVE {', '.join(parts)} {select}" if parts else select
