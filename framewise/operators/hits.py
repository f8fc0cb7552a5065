"""Ball and player contact: approach hits, velocity samples, lag features."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.points import distance, perspective_velocity, within_circle
from framewise.operators import chunks
from framewise.operators.chunks import CHUNK, KEYS, ORDER, asc, so_far
from framewise.operators.geometry import project_points
from framewise.operators.windows import shift, windowed

# Hand circle radius as a share of the nose-to-body distance, per side.
RADIUS_SHARES = {0: 0.65, 1: 0.6}


def hand_distances(
    ball: DataFrame, hands: DataFrame, shares: dict[int, float] | None = None, keys: Sequence[str] = KEYS, order: str = ORDER
) -> DataFrame:
    """Distance of the ball to each hand, with the radius of the hand circle. Frames without ball are left out."""
    by_side = F.create_map(*[F.lit(v) for kv in (shares or RADIUS_SHARES).items() for v in kv])
    body = distance(F.col("nose_x"), F.col("nose_y"), F.col("body_x"), F.col("body_y"))
    seen = ball.select(*keys, order, "x", "y").filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    return seen.join(hands, [*keys, order]).select(
        *keys, order, "side", "x", "y",
        distance(F.col("x"), F.col("y"), F.col("hx"), F.col("hy")).alias("dist"),
        (F.try_element_at(by_side, F.col("side")) * body).cast("int").alias("radius"), "body_x", "body_y",
    )


def approach_hits(
    ball: DataFrame,
    hands: DataFrame,
    shares: dict[int, float] | None = None,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
    matrices: DataFrame | None = None,
) -> DataFrame:
    """Frames where the ball, inside a hand circle, is nearer than at any frame since it came in.

    With `matrices` also the place of ball and body on the map.

    A stay in the circle may be of any length, so the running minimum is taken per piece
    and the minimum of the open stay is handed on from piece to piece.
    """
    track = [*keys, "side"]
    rows = chunks.with_chunk(hand_distances(ball, hands, shares, keys, order), order, size)
    w = asc(track, order)
    inside = within_circle(F.col("radius"), F.col("dist"))
    rows = rows.withColumn("_in", inside)
    rows = rows.withColumn("_stay", F.sum(F.when(F.col("_in"), 0).otherwise(1)).over(so_far(w)))
    near = F.when(F.col("_in"), F.col("dist"))

    stays = rows.groupBy(*track, "_chunk", "_stay").agg(F.min(near).alias("_near"))
    open_stay = stays.groupBy(*track, "_chunk").agg(
        F.max_by("_near", "_stay").alias("_near"), F.max("_stay").alias("_breaks")
    )
    along = Window.partitionBy(*track).orderBy("_chunk")
    open_stay = open_stay.withColumn("_run", F.sum(F.when(F.col("_breaks") > 0, 1).otherwise(0)).over(so_far(along)))
    per_run = Window.partitionBy(*track, "_run").orderBy("_chunk")
    open_stay = open_stay.withColumn("_near", F.min("_near").over(so_far(per_run)))
    carried = open_stay.select(*track, "_chunk", F.lag("_near").over(along).alias("_carried"))

    before = F.min(near).over(
        Window.partitionBy(*track, "_chunk", "_stay").orderBy(order).rowsBetween(chunks.UNBOUNDED, -1)
    )
    rows = rows.withColumn("_min", before).join(carried, [*track, "_chunk"])
    least = F.least("_min", F.when(F.col("_stay") == 0, F.col("_carried")))
    limit = F.coalesce(least, F.col("radius").cast("double"))
    hits = rows.filter(F.col("_in") & (F.col("dist") < limit)).select(*track, order, "x", "y", "dist", "radius", "body_x", "body_y")
    if matrices is None:
        return hits.drop("body_x", "body_y")
    hits = project_points(hits, matrices, as_int=True, keys=keys, order=order, out=("map_x", "map_y"))
    return project_points(hits, matrices, "body_x", "body_y", True, keys, order, ("body_map_x", "body_map_y"))


def velocity_samples(
    ball: DataFrame,
    hands: DataFrame,
    matrices: DataFrame,
    frame_height: int,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """Velocity against the frame before, map position, and whether the ball is near a hand."""
    moving = windowed(
        ball.select(*keys, order, "x", "y"),
        lambda w: {"vx": F.col("x") - F.lag("x").over(w), "_dy": F.col("y") - F.lag("y").over(w)},
        before=1, keys=keys, order=order, size=size,
    ).filter(F.col("vx").isNotNull())
    moving = moving.withColumn("vy", perspective_velocity(F.col("y"), F.col("_dy"), frame_height)).drop("_dy")
    near = (
        hand_distances(ball, hands, keys=keys, order=order)
        .groupBy(*keys, order)
        .agg(F.bool_or(within_circle(F.col("radius"), F.col("dist"))).alias("near_hand"))
    )
    sampled = moving.join(near, [*keys, order], "left").withColumn("near_hand", F.coalesce("near_hand", F.lit(False)))
    return project_points(sampled, matrices, as_int=True, keys=keys, order=order)


def lag_features(
    ball: DataFrame, cols: Sequence[str] = ("x", "y"), reach: int = 3, keys: Sequence[str] = KEYS, order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """Each coordinate at the frames -reach..reach around a frame."""
    return shift(ball.select(*keys, order, *cols), cols, range(1, reach + 1), keys=keys, order=order, size=size)
