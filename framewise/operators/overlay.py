"""The overlay table: one row per item that would be drawn on a frame or on the map."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.points import centre_x, centre_y
from framewise.operators.chunks import KEYS, ORDER
from framewise.operators.geometry import court_line_layer, project_points
from framewise.operators.select import flag_frames

COLUMNS = {"layer": "string", "item": "string", "x": "double", "y": "double", "x2": "double", "y2": "double", "label": "string"}


def _layer(df: DataFrame, keys, order, layer: str, **cols: Column) -> DataFrame:
    values = {"layer": F.lit(layer)} | cols
    order_col = F.col(order) if order in df.columns else F.lit(None).cast("long").alias(order)
    return df.select(
        *keys, order_col, *[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in COLUMNS.items()]
    )


def _pixel(c: str) -> Column:
    return F.col(c).cast("int")


def drawn_ball(ball: DataFrame) -> DataFrame:
    """Balls that are drawn: a missing x and an x of 0 are not."""
    return ball.filter(F.col("x").isNotNull() & (F.col("x") != 0))


def point_layer(court: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    label = F.col("kp_idx").cast("string")
    return _layer(court, keys, order, "keypoint", item=label, x=_pixel("x"), y=_pixel("y"), label=label)


def ball_layer(ball: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    return _layer(drawn_ball(ball), keys, order, "ball", item=F.lit("ball"), x=_pixel("x"), y=_pixel("y"))


def player_layer(players: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    track = F.col("track_id").cast("string")
    box = {c: _pixel(s) for c, s in (("x", "x1"), ("y", "y1"), ("x2", "x2"), ("y2", "y2"))}
    return _layer(players, keys, order, "player", item=track, label=F.concat(F.lit("Player ID: "), track), **box)


def frame_number_layer(frames: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    label = F.concat(F.lit("Frame: "), F.col(order).cast("string"))
    return _layer(frames, keys, order, "frame_number", item=F.lit("frame"), x=F.lit(10), y=F.lit(30), label=label)


def bounce_layer(bounces: DataFrame, ball: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    marked = ball.join(bounces.select(*keys, order).distinct(), [*keys, order], "left_semi")
    return _layer(marked, keys, order, "bounce", item=F.lit("bounce"), x=_pixel("x"), y=_pixel("y"))


def mini_map(
    players: DataFrame,
    ball: DataFrame,
    bounces: DataFrame,
    matrices: DataFrame,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    whole: bool = True,
) -> DataFrame:
    """Player centres and ball on the court map, in whole pixels if `whole`; `bounce` marks ball rows of bounce frames."""
    return mini_map_of_track(players, flag_frames(ball, bounces, "bounce", keys, order), matrices, keys, order, whole)


def mini_map_of_track(
    players: DataFrame,
    track: DataFrame,
    matrices: DataFrame,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    whole: bool = True,
) -> DataFrame:
    """`mini_map` of a track that has the flag `bounce` already."""
    centres = players.select(
        *keys, order, F.lit("player").alias("layer"), F.col("track_id").cast("string").alias("item"),
        centre_x(F.col("x1"), F.col("x2")).cast("double").alias("x"),
        centre_y(F.col("y1"), F.col("y2")).cast("double").alias("y"), F.lit(False).alias("bounce"),
    )
    balls = track.select(
        *keys, order, F.lit("ball").alias("layer"), F.lit("ball").alias("item"),
        F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "bounce",
    )
    points = centres.unionByName(balls).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    mapped = project_points(points, matrices, as_int=whole, keys=keys, order=order)
    return mapped.select(*keys, order, "layer", "item", "map_x", "map_y", "bounce")


def map_layer(mapped: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    """Mini-map points as overlay rows; a bounce is one row more."""
    kinds = F.array_compact(F.array(F.concat(F.lit("map_"), F.col("layer")), F.when(F.col("bounce"), F.lit("map_bounce"))))
    rows = mapped.withColumn("kind", F.explode(kinds))
    return rows.select(
        *keys, order, F.col("kind").alias("layer"), "item",
        F.col("map_x").cast("double").alias("x"), F.col("map_y").cast("double").alias("y"),
        *[F.lit(None).cast(COLUMNS[c]).alias(c) for c in ("x2", "y2", "label")],
    )


def _items(df: DataFrame, keys, order, items: Sequence[tuple[Column, str, dict[str, Column]]]) -> DataFrame:
    """Several layers from each row: (whether it is drawn, layer, values)."""

    def item(layer, values):
        values = {"layer": F.lit(layer)} | values
        return F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in COLUMNS.items()])

    drawn = F.array_compact(F.array(*[F.when(cond, item(layer, values)) for cond, layer, values in items]))
    return df.select(*keys, order, F.explode(drawn).alias("_i")).select(*keys, order, "_i.*")


def track_layers(track: DataFrame, matrices: DataFrame, bounce: str = "bounce", keys=KEYS, order=ORDER) -> DataFrame:
    """All that is drawn of a track with bounce flags: frame number, ball, bounce, and the last two on the map."""
    x, y = F.col("x"), F.col("y")
    rows = track.withColumns({"x": x.cast("double"), "y": y.cast("double")})
    rows = project_points(rows, matrices, as_int=True, keys=keys, order=order)
    seen, marked = x.isNotNull() & y.isNotNull(), F.col(bounce)
    at, on_map = {"x": _pixel("x"), "y": _pixel("y")}, {"item": F.lit("ball"), "x": F.col("map_x"), "y": F.col("map_y")}
    label = F.concat(F.lit("Frame: "), F.col(order).cast("string"))
    return _items(rows, keys, order, [
        (F.lit(True), "frame_number", {"item": F.lit("frame"), "x": F.lit(10), "y": F.lit(30), "label": label}),
        (x.isNotNull() & (x != 0), "ball", {"item": F.lit("ball"), **at}),
        (marked, "bounce", {"item": F.lit("bounce"), **at}),
        (seen, "map_ball", on_map),
        (seen & marked, "map_bounce", on_map),
    ])


def player_layers(players: DataFrame, matrices: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    """Each box, and its centre on the map."""
    track = F.col("track_id").cast("string")
    box = {c: _pixel(s) for c, s in (("x", "x1"), ("y", "y1"), ("x2", "x2"), ("y2", "y2"))}
    centre = {"x": centre_x(F.col("x1"), F.col("x2")).cast("double"), "y": centre_y(F.col("y1"), F.col("y2")).cast("double")}
    rows = project_points(players.withColumns(centre), matrices, as_int=True, keys=keys, order=order)
    return _items(rows, keys, order, [
        (F.lit(True), "player", {"item": track, "label": F.concat(F.lit("Player ID: "), track), **box}),
        (F.col("x").isNotNull() & F.col("y").isNotNull(), "map_player", {"item": track, "x": F.col("map_x"), "y": F.col("map_y")}),
    ])


def court_layer(videos: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    """The lines of the court map; they belong to no single frame."""
    lines = court_line_layer(videos, keys)
    return _layer(lines, keys, order, "court", item=F.col("item"), x=F.col("x"), y=F.col("y"), x2=F.col("x2"), y2=F.col("y2"))


def overlay(layers: Sequence[DataFrame]) -> DataFrame:
    """All layers in one table."""
    return reduce(DataFrame.unionByName, layers)


def until(df: DataFrame, frame: int, order: str = ORDER) -> DataFrame:
    """Everything drawn up to a frame: the map canvas is never cleared."""
    return df.filter(F.col(order).isNull() | (F.col(order) <= frame))
