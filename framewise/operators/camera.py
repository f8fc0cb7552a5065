"""Following a moving camera: common court points, displacement, refreshed matrices."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.operators import chunks
from framewise.operators.chunks import CHUNK, KEYS, ORDER, asc
from framewise.operators.geometry import fit_homography, with_map_positions
from framewise.operators.select import keyframes
from framewise.sources.tables import stored

MIN_POINTS = 4
MOVED_MSE = 10.0


def point_counts(court: DataFrame, min_points: int = MIN_POINTS, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Number of court points of each frame, for frames with at least `min_points`."""
    counts = court.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("n_points"))
    return counts.filter(F.col("n_points") >= min_points)


def _with_previous(court, min_points, keys, order, size) -> DataFrame:
    """One row per frame with enough points: its points, and those of the last such frame.

    Rows are dealt by piece once, before they are collected: lists gathered ahead of a shuffle would sort all
    rows of a task, however many points a small input unfolds to.
    """
    points = F.map_from_entries(F.collect_list(F.struct("kp_idx", F.struct("x", "y"))))
    # Rows without a key or piece are not joined in the end; left out here, both sides of that join read one shuffle.
    dealt = chunks.with_chunk(court.select(*keys, order, "kp_idx", "x", "y"), order, size)
    for c in (*keys, "_chunk"):
        dealt = dealt.filter(F.col(c).isNotNull())
    frames = (
        dealt.repartition(*keys, "_chunk").groupBy(*keys, "_chunk", order).agg(points.alias("points"))
        .filter(F.size("points") >= min_points)
        .withColumn("at", F.col(order))
    )
    return chunks.previous_row(frames, ["at", "points"], keys, order, size).drop("_chunk")


def common_points(
    court: DataFrame,
    min_points: int = MIN_POINTS,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """Court points found in a frame and in the last frame before it with enough points."""
    rows = _with_previous(court, min_points, keys, order, size).filter(F.col("prev_at").isNotNull())
    pairs = F.transform(
        F.array_intersect(F.map_keys("points"), F.map_keys("prev_points")),
        lambda i: F.struct(
            i.alias("kp_idx"), F.element_at("points", i).alias("now"), F.element_at("prev_points", i).alias("then")
        ),
    )
    return rows.select(*keys, order, F.col("prev_at").alias("prev_frame"), F.explode(pairs).alias("p")).select(
        *keys, order, "prev_frame", "p.kp_idx",
        F.col("p.now.x").alias("x"), F.col("p.now.y").alias("y"),
        F.col("p.then.x").alias("prev_x"), F.col("p.then.y").alias("prev_y"),
    )


def displacement(
    court: DataFrame,
    min_points: int = MIN_POINTS,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """Mean squared displacement of the common points, over both coordinates; only with enough of them."""
    rows = _with_previous(court, min_points, keys, order, size).filter(F.col("prev_at").isNotNull())
    common = F.array_intersect(F.map_keys("points"), F.map_keys("prev_points"))
    rows = rows.withColumn("_common", common).filter(F.size("_common") >= min_points)
    known = F.filter(F.transform("_common", _squared), lambda d: d.isNotNull())
    mse = F.try_divide(_total(known), F.size(known))
    return rows.select(*keys, order, mse.alias("mse"), F.size("_common").cast("long").alias("n_common"))


def _squared(i):
    """Half the squared distance of a point of both frames."""
    now, then = F.element_at("points", i), F.element_at("prev_points", i)
    dx, dy = now["x"] - then["x"], now["y"] - then["y"]
    return (dx * dx + dy * dy) / 2


def _total(values):
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def camera_moved(
    court: DataFrame,
    tolerance: float = MOVED_MSE,
    min_points: int = MIN_POINTS,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """`moved` for each frame with enough points: first such frame, too few common points, or a large displacement."""
    rows = _moves(court, tolerance, min_points, keys, order, size)
    return rows.select(*keys, order, "mse", "moved")


def _moves(court, tolerance, min_points, keys, order, size) -> DataFrame:
    """Frames with enough points, with their points: `mse` and `moved`."""
    rows = _with_previous(court, min_points, keys, order, size)
    common = F.array_intersect(F.map_keys("points"), F.map_keys("prev_points"))

    rows = rows.withColumn("_common", common).withColumn("n_common", F.coalesce(F.size("_common"), F.lit(0)))
    mse = F.when(F.col("n_common") >= min_points, _total(F.transform("_common", _squared)) / F.col("n_common"))
    rows = rows.withColumn("mse", mse)
    moved = F.col("prev_at").isNull() | (F.col("n_common") < min_points) | (F.col("mse") > tolerance)
    mse = F.when(F.col("prev_at").isNotNull(), F.col("mse"))
    return rows.select(*keys, order, "points", mse.alias("mse"), moved.alias("moved"))


def latest_value(
    rows: DataFrame,
    updates: DataFrame,
    col: str,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """As-of join: each row gets the value of the newest update at or before its frame.

    What earlier pieces hand on is picked from the updates alone; of the rows only the pieces are listed.
    """
    spine = rows.withColumns({"_row": F.lit(True), col: F.lit(None).cast(updates.schema[col].dataType)})
    news = updates.select(*keys, order, col)
    both = spine.unionByName(news, allowMissingColumns=True)
    both = chunks.with_chunk(both, order, size)
    newest = F.last(col, True).over(asc(keys, order).rangeBetween(chunks.UNBOUNDED, 0))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(chunks.UNBOUNDED, -1)
    lasts = chunks.with_chunk(news.filter(F.col(col).isNotNull()), order, size)
    lasts = lasts.groupBy(*keys, "_chunk").agg(F.max_by(col, order).alias("_last"))
    pieces = both.select(*keys, "_chunk").distinct().join(lasts, [*keys, "_chunk"], "left")
    carried = pieces.select(*keys, "_chunk", F.last("_last", True).over(earlier).alias("_old"))
    return (
        both.withColumn("_new", newest)
        .filter("_row")
        .join(carried, [*keys, "_chunk"])
        .withColumn(col, F.coalesce("_new", "_old"))
        .drop("_new", "_old", "_row", "_chunk")
    )


def _held(frames: DataFrame, fitted: DataFrame, keys, order, size) -> DataFrame:
    """For every frame the newest matrix `h`, and the frame `fitted_at` that it comes from. The fits are stored, as the as-of join reads them thrice."""
    fitted = stored(fitted.select(*keys, order, "h"), "fitted")
    news = fitted.select(*keys, order, F.struct(F.col(order).alias("fitted_at"), "h").alias("_m"))
    held = latest_value(frames.select(*keys, order), news, "_m", keys, order, size)
    return held.select(*keys, order, F.col("_m.fitted_at").alias("fitted_at"), F.col("_m.h").alias("h"))


def refreshed_homography(
    court: DataFrame,
    frames: DataFrame,
    positions: dict[int, tuple[float, float]] | None = None,
    tolerance: float = MOVED_MSE,
    min_points: int = MIN_POINTS,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """A matrix for every frame, fitted anew on each frame where the camera moved.

    All points found in that frame are used, by least squares. `positions` has their places on the map. The points of
    these frames are stored: the fit reads them more than once, and finding them takes a pass over all frames.
    """
    moves = _moves(court, tolerance, min_points, keys, order, size).filter("moved")
    found = moves.select(*keys, order, F.explode("points").alias("kp_idx", "_p"))
    found = stored(found.select(*keys, order, "kp_idx", "_p.x", "_p.y"), "moved")
    return _held(frames, _fit(found, positions, min_points, keys, order), keys, order, size)


def sampled_homography(
    court: DataFrame,
    frames: DataFrame,
    every: int,
    skip: int = 1,
    positions: dict[int, tuple[float, float]] | None = None,
    min_points: int = MIN_POINTS,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """A matrix from every `every`-th frame with enough points, held until the next; none before frame `skip`."""
    sampled = keyframes(court, every, order).filter(F.col(order) >= skip)
    return _held(frames, _fit(sampled, positions, min_points, keys, order), keys, order, size)


def _fit(found: DataFrame, positions, min_points, keys, order) -> DataFrame:
    pairs = with_map_positions(found, positions).filter(F.col("map_x").isNotNull())
    return fit_homography(pairs, [*keys, order]).filter(F.col("n_points") >= min_points)
