"""Perspective mapping from camera pixels to a top-down court map."""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.points import foot_point, metres_to_pixels, pixels_to_metres
from framewise.operators.chunks import CHUNK, KEYS, ORDER, join_frames, join_track
from framewise.operators.select import look_up, nearest_court_point, nearest_player
from framewise.operators.windows import max_height

# Fixed values of the court map: canvas size, court proportions in cm, line positions as
# shares of the court, and which court points span it (top left, top right, bottom left, bottom right).
MAP_W, MAP_H = 967, 1585
COURT_CM = (1097, 2377)
COURT_SHARE = 0.6
SINGLES, SERVICE, MIDDLE = 0.124886, 0.23054, 0.5
CORNERS = (4, 6, 5, 7)

COURT_H = int(MAP_H * COURT_SHARE)
COURT_W = int(COURT_H * (COURT_CM[0] / COURT_CM[1]))
OFFSET_X, OFFSET_Y = int((MAP_W - COURT_W) / 2), int((MAP_H - COURT_H) / 2)
LEFT, TOP, RIGHT, BOTTOM = OFFSET_X, OFFSET_Y, OFFSET_X + COURT_W, OFFSET_Y + COURT_H

H_NAMES = tuple(f"h{i}{j}" for i in range(3) for j in range(3))


def court_lines() -> list[tuple[str, int, int, int, int]]:
    """The lines of the court map as rectangles (name, x1, y1, x2, y2)."""
    inset, service, half_w = int(COURT_W * SINGLES), int(COURT_H * SERVICE), int(COURT_W * MIDDLE)
    net = TOP + int(COURT_H * MIDDLE)
    return [
        ("canvas", 0, 0, MAP_W, MAP_H),
        ("court", LEFT, TOP, RIGHT, BOTTOM),
        ("net", LEFT, net, RIGHT, net),
        ("singles", LEFT + inset, TOP, RIGHT - inset, BOTTOM),
        ("service", LEFT + inset, TOP + service, RIGHT - inset, BOTTOM - service),
        ("centre", LEFT + half_w, TOP + service, RIGHT - half_w, BOTTOM - service),
    ]


def court_map_points() -> dict[int, tuple[float, float]]:
    """Map position of each court point by its index."""
    inset, service = int(COURT_W * SINGLES), int(COURT_H * SERVICE)
    near, far, mid = BOTTOM - service, TOP + service, (LEFT + RIGHT) / 2
    left, right = LEFT + inset, RIGHT - inset
    corners = [(LEFT, TOP), (RIGHT, TOP), (LEFT, BOTTOM), (RIGHT, BOTTOM)]
    singles = [(left, TOP), (left, BOTTOM), (right, TOP), (right, BOTTOM)]
    services = [(left, far), (right, far), (left, near), (right, near), (mid, far), (mid, near)]
    return {i: (float(x), float(y)) for i, (x, y) in enumerate(corners + singles + services)}


def quad_to_rectangle(
    tl: Column, tr: Column, bl: Column, br: Column,
    left: float = LEFT, top: float = TOP, width: float = COURT_W, height: float = COURT_H,
) -> Column:
    """The homography taking four corner points onto an upright rectangle, as nine doubles.

    The target is axis-parallel, so the matrix has a closed form: map the unit square to
    the quad, invert, then scale and shift. NULL for a degenerate quad.
    """
    x0, y0, x1, y1 = tl["x"], tl["y"], tr["x"], tr["y"]
    x2, y2, x3, y3 = br["x"], br["y"], bl["x"], bl["y"]
    ux, uy, vx, vy = x1 - x2, y1 - y2, x3 - x2, y3 - y2
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    det = ux * vy - vx * uy
    g, h = F.try_divide(sx * vy - vx * sy, det), F.try_divide(ux * sy - sx * uy, det)
    a, b, c = x1 - x0 + g * x1, x3 - x0 + h * x3, x0
    d, e, f = y1 - y0 + g * y1, y3 - y0 + h * y3, y0
    to_u = (e - f * h, c * h - b, b * f - c * e)
    to_v = (f * g - d, a - c * g, c * d - a * f)
    to_w = (d * h - e * g, b * g - a * h, a * e - b * d)
    rows = [
        *[width * u + left * w for u, w in zip(to_u, to_w)],
        *[height * v + top * w for v, w in zip(to_v, to_w)],
        *to_w,
    ]
    return F.array(*[F.try_divide(r, to_w[2]) for r in rows])


def corner_points(court: DataFrame, corners: Sequence[int] = CORNERS, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """One row per frame with the four corner points as structs tl, tr, bl, br."""
    names = ("tl", "tr", "bl", "br")
    picks = [
        F.max(F.when(F.col("kp_idx") == i, F.col(c))).alias(f"{n}_{c}") for i, n in zip(corners, names) for c in ("x", "y")
    ]
    wide = court.filter(F.col("kp_idx").isin(*corners)).groupBy(*keys, order).agg(*picks)
    quads = [F.struct(F.col(f"{n}_x").alias("x"), F.col(f"{n}_y").alias("y")).alias(n) for n in names]
    return wide.select(*keys, order, *quads)


def frame_homography(
    court: DataFrame, corners: Sequence[int] = CORNERS, keys: Sequence[str] = KEYS, order: str = ORDER
) -> DataFrame:
    """The matrix `h` of each frame in `court`, from its four corner points; NULL when one is missing."""
    quads = corner_points(court, corners, keys, order)
    h = quad_to_rectangle(*[F.col(n) for n in ("tl", "tr", "bl", "br")])
    return quads.select(*keys, order, F.when(h[8].isNotNull(), h).alias("h"))


def video_homography(
    court: DataFrame, corners: Sequence[int] = CORNERS, keys: Sequence[str] = KEYS, order: str = ORDER
) -> DataFrame:
    """One matrix per video, from frame 0."""
    return frame_homography(court.filter(F.col(order) == 0), corners, keys, order).drop(order)


def matrix_columns(df: DataFrame, h: str = "h") -> DataFrame:
    """The matrix as nine columns h00..h22."""
    return df.select(*[c for c in df.columns if c != h], *[F.col(h)[i].alias(n) for i, n in enumerate(H_NAMES)])


def project_x(x: Column, y: Column, h: Column) -> Column:
    return _projected(x, y, h, 0)


def project_y(x: Column, y: Column, h: Column) -> Column:
    return _projected(x, y, h, 3)


def _projected(x: Column, y: Column, h: Column, row: int) -> Column:
    scale = h[6] * x + h[7] * y + h[8]
    return F.when(scale == 0, 0.0).otherwise(F.try_divide(h[row] * x + h[row + 1] * y + h[row + 2], scale))


def project_points(
    points: DataFrame,
    matrices: DataFrame,
    x: str = "x",
    y: str = "y",
    as_int: bool = False,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    out: tuple[str, str] = ("map_x", "map_y"),
) -> DataFrame:
    """Add the map position of each point, by the matrix of its frame, or of its video if `matrices` has no frames.

    A point without a matrix keeps its row, with a NULL position.
    """
    at = [*keys, order] if order in matrices.columns else list(keys)
    joined = join_track(points, matrices.select(*at, "h"), at, "left")
    to = lambda c: c.try_cast("int") if as_int else c
    mapped = [to(f(F.col(x), F.col(y), F.col("h"))) for f in (project_x, project_y)]
    return joined.withColumns(dict(zip(out, mapped))).drop("h")


# The normal matrix of a fit has 45 terms, but 24 different sums: of x*x, x*y, x, y*y, y and 1, each times 1, u, v and u*u + v*v.
_SIDES = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]


def _to_unit(mx: np.ndarray, my: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Matrices that move the mean of points to zero and their spread to one."""
    t = np.zeros((len(mx), 3, 3))
    t[:, 0, 0] = t[:, 1, 1] = 1 / spread
    t[:, 0, 2], t[:, 1, 2], t[:, 2, 2] = -mx / spread, -my / spread, 1
    return t


def fit_homography(
    pairs: DataFrame,
    group: Sequence[str] = ("video_id", "frame"),
    src: tuple[str, str] = ("x", "y"),
    dst: tuple[str, str] = ("map_x", "map_y"),
) -> DataFrame:
    """Least-squares homography of each group from four or more point pairs. Pairs without a coordinate don't count.

    Points are first moved by the mean and scaled by the spread of their group, whatever the size of the picture. Means,
    spreads and the 24 sums of outer products are ordinary aggregates, added up before the shuffle. Only the eigenvector of
    the smallest eigenvalue is taken in Python, for a whole batch of groups at once. See `fit_residuals`.
    """
    ends = {"_x": src[0], "_y": src[1], "_u": dst[0], "_v": dst[1]}
    full = pairs.select(*group, *[F.col(c).cast("double").alias(n) for n, c in ends.items()]).dropna(subset=list(ends))

    def spread(a, b):
        both = F.sqrt(F.var_pop(a) + F.var_pop(b))
        return F.when(both > 0, both).otherwise(1.0)

    stats = full.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_points"), *[F.avg(c).alias(f"_m{c}") for c in ends], spread("_x", "_y").alias("_s_src"), spread("_u", "_v").alias("_s_dst"))
    unit = full.join(stats.filter("n_points >= 4"), list(group))
    x, y, u, v = ((F.col(c) - F.col(f"_m{c}")) / F.col(s) for c, s in zip(ends, ("_s_src", "_s_src", "_s_dst", "_s_dst")))
    side, weights = (x, y, F.lit(1.0)), (F.lit(1.0), u, v, u * u + v * v)
    products = {f"s{n}": w * side[i] * side[j] for n, (w, (i, j)) in enumerate((w, s) for w in weights for s in _SIDES)}
    frame = ("n_points", *[f"_m{c}" for c in ends], "_s_src", "_s_dst")
    n_sums = len(products)

    @F.pandas_udf("array<double>")
    def smallest_eigenvector(s: pd.Series) -> pd.Series:
        values = np.stack(s.to_numpy())
        terms, (mx, my, mu, mv, s_src, s_dst) = values[:, :n_sums].reshape(-1, 4, len(_SIDES)), values[:, n_sums:].T
        block = np.zeros((len(terms), 4, 3, 3))
        for n, (i, j) in enumerate(_SIDES):
            block[:, :, i, j] = block[:, :, j, i] = terms[:, :, n]
        one, by_u, by_v, by_both = block.transpose(1, 0, 2, 3)
        zero = np.zeros_like(one)
        normal = np.block([[one, zero, -by_u], [zero, one, -by_v], [-by_u, -by_v, by_both]])
        unit_h = np.linalg.eigh(normal)[1][:, :, 0].reshape(-1, 3, 3)
        h = (np.linalg.inv(_to_unit(mu, mv, s_dst)) @ unit_h @ _to_unit(mx, my, s_src)).reshape(-1, 9)
        return pd.Series(list(h / h[:, 8:9]))

    fitted = unit.select(*group, *frame, *[p.alias(n) for n, p in products.items()])
    fitted = fitted.groupBy(*group, *frame).agg(*[F.sum(n).alias(n) for n in products])
    values = F.array(*products, *frame[1:])
    return fitted.select(*group, "n_points", smallest_eigenvector(values).alias("h"))


def fit_residuals(
    pairs: DataFrame,
    fitted: DataFrame,
    group: Sequence[str] = ("video_id", "frame"),
    dst: tuple[str, str] = ("map_x", "map_y"),
) -> DataFrame:
    """pairs (..., x, y) with `residual`: how far the fitted matrix of the group puts the point from its place; NULL without a matrix."""
    at = fitted.select(*group, F.col("h").alias("_h"))
    off = [f(F.col("x"), F.col("y"), F.col("_h")) - F.col(c) for f, c in zip((project_x, project_y), dst)]
    return pairs.join(at, list(group), "left").withColumn("residual", F.hypot(*off)).drop("_h")


def with_map_positions(court: DataFrame, points: dict[int, tuple[float, float]] | None = None) -> DataFrame:
    """Add the map position of each court point, from a small fixed table."""
    table = points or court_map_points()
    entries = F.create_map(
        *[c for i, (px, py) in table.items() for c in (F.lit(i), F.struct(F.lit(px).alias("x"), F.lit(py).alias("y")))]
    )
    at = F.try_element_at(entries, F.col("kp_idx"))
    return court.withColumns({"map_x": at["x"], "map_y": at["y"]})


def court_line_layer(videos: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The court lines as rows of each video."""
    names = ("item", "x", "y", "x2", "y2")
    lines = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, line)]) for line in court_lines()])
    return videos.select(*keys).distinct().select(*keys, F.explode(lines).alias("l")).select(*keys, "l.*")


def _from_court_point(points: DataFrame, ref_px: str, ref_m: str, px_per_m: float) -> DataFrame:
    """Offset of a point from its nearest court point, in metres, and its place on the map."""
    dx_m = pixels_to_metres(F.col("x") - F.col("kx"), F.col(ref_m), F.col(ref_px))
    dy_m = pixels_to_metres(F.col("y") - F.col("ky"), F.col(ref_m), F.col(ref_px))
    placed = with_map_positions(points.withColumns({"dx_m": dx_m, "dy_m": dy_m}))
    one_metre, court_m = F.lit(1.0), F.lit(px_per_m)
    return placed.withColumns(
        {
            "map_x": F.col("map_x") + metres_to_pixels(F.col("dx_m"), one_metre, court_m),
            "map_y": F.col("map_y") + metres_to_pixels(F.col("dy_m"), one_metre, court_m),
        }
    )


def _with_height(rows: DataFrame, heights: dict[int, float], clamp: int | None) -> DataFrame:
    """Add `height_m` by track id."""
    track = F.col("track_id") if clamp is None else F.least("track_id", F.lit(clamp))
    return look_up(rows.withColumn("_track", track), "_track", heights, "height_m").drop("_track")


def players_on_mini_court(
    players: DataFrame,
    court: DataFrame,
    heights: dict[int, float],
    metric: str = "dy",
    clamp: int | None = None,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """Players placed by the scale of their own height, relative to the nearest court point.

    `heights` gives metres by track id, ids above `clamp` counting as that one. Every row stays: without a
    height or a court point its place is NULL.
    """
    feet = players.withColumn("foot", foot_point(F.col("x1"), F.col("x2"), F.col("y2")))
    tall = max_height(feet, keys=keys, order=order, size=size).select(
        *keys, order, "track_id", F.col("foot.x").cast("double").alias("x"), F.col("foot.y").alias("y"), "max_height"
    )
    tall = _with_height(tall, heights, clamp)
    placed = nearest_court_point(tall, court, metric=metric, keys=keys, order=order)
    return _from_court_point(placed, "max_height", "height_m", COURT_W / (COURT_CM[0] / 100)).select(
        *keys, order, "track_id", "kp_idx", "max_height", "dx_m", "dy_m", "map_x", "map_y"
    )


def ball_on_mini_court(
    players: DataFrame,
    ball: DataFrame,
    court: DataFrame,
    heights: dict[int, float],
    metric: str = "dy",
    clamp: int | None = None,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """The ball placed by the scale of the player nearest to it; a missing ball counts as (0, 0).

    One row per row of `ball`; without a player, a height or a court point its place is NULL.
    """
    nearest = nearest_player(players, ball, clamp=None, keys=keys, order=order)
    tall = max_height(players, keys=keys, order=order, size=size).select(*keys, order, "track_id", "max_height")
    points = ball.select(*keys, order, F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    scaled = join_frames(points, nearest.select(*keys, order, "track_id"), [*keys, order], "left")
    scaled = _with_height(join_frames(scaled, tall, [*keys, order, "track_id"], "left"), heights, clamp)
    placed = nearest_court_point(scaled, court, metric=metric, keys=keys, order=order)
    return _from_court_point(placed, "max_height", "height_m", COURT_W / (COURT_CM[0] / 100)).select(
        *keys, order, "track_id", "kp_idx", "dx_m", "dy_m", "map_x", "map_y"
    )
