"""Answers built on the other operators: in or out, speed, hit map, distance run, lost balls."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.points import centre_x, centre_y, distance, pixels_to_metres
from framewise.operators import chunks
from framewise.operators.chunks import CHUNK, KEYS, ORDER
from framewise.operators.geometry import BOTTOM, COURT_CM, COURT_H, LEFT, RIGHT, TOP

FPS = 24.0


def in_or_out(mapped: DataFrame, bounces: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Whether the ball's map position is inside the court, at each bounce."""
    hits = mapped.join(bounces.select(*keys, order).distinct(), [*keys, order], "left_semi")
    inside = F.col("map_x").between(LEFT, RIGHT) & F.col("map_y").between(TOP, BOTTOM)
    return hits.select(*keys, order, "map_x", "map_y", inside.alias("is_in"))


def ball_speed(
    mapped: DataFrame,
    events: DataFrame,
    around: int = 3,
    fps: float = FPS,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """Metres per second near each event: mean step on the map over the frames around it."""
    xy = ("map_x", "map_y")
    rows = chunks.chunked(mapped.select(*keys, order, *xy), keys, order, around + 1, around, size=size)
    w = chunks.asc(keys, order)
    step = distance(*[F.col(c) for c in xy], *[F.lag(c).over(w) for c in xy])
    rows = rows.withColumn("_step", step).withColumn("_mean", F.avg("_step").over(w.rowsBetween(-around, around)))
    metres = pixels_to_metres(F.col("_mean"), F.lit(COURT_CM[1] / 100), F.lit(float(COURT_H)))
    speeds = chunks.core(rows).select(*keys, order, (metres * fps).alias("speed"))
    return speeds.join(events.select(*keys, order).distinct(), [*keys, order], "left_semi")


def hit_map(mapped: DataFrame, events: DataFrame, cell: float = 50.0, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Number of events per cell of the court map."""
    hits = mapped.join(events.select(*keys, order).distinct(), [*keys, order], "left_semi")
    cells = [F.floor(F.col(c) / cell).cast("long").alias(n) for c, n in (("map_x", "cell_x"), ("map_y", "cell_y"))]
    return hits.groupBy(*keys, *cells).agg(F.count(F.lit(1)).alias("n_hits"))


def distance_run(players: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER, size: int = CHUNK) -> DataFrame:
    """Path length of each player's box centre, over all frames where it is seen."""
    track = [*keys, "track_id"]
    centres = players.select(
        *track, order, centre_x(F.col("x1"), F.col("x2")).cast("double").alias("cx"),
        centre_y(F.col("y1"), F.col("y2")).cast("double").alias("cy"),
    )
    rows = chunks.previous_row(centres, ["cx", "cy"], track, order, size)
    step = distance(F.col("cx"), F.col("cy"), F.col("prev_cx"), F.col("prev_cy"))
    return rows.groupBy(*track).agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("path_px"), F.count(F.lit(1)).alias("n_frames"))


def vanished(ball: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER, size: int = CHUNK) -> DataFrame:
    """Stretches without a ball between two frames with one."""
    seen = ball.filter(F.col("x").isNotNull()).select(*keys, order, F.col(order).alias("at"))
    rows = chunks.previous_row(seen, ["at"], keys, order, size)
    gap = F.col("at") - F.col("prev_at") - 1
    return rows.filter(gap > 0).select(
        *keys, F.col("prev_at").alias("last_seen"), F.col("at").alias("back_at"), gap.alias("n_missing")
    )
