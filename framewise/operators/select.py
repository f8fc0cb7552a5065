"""Choosing rows: detector boxes, tracks, frames."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.points import centre_x, centre_y, distance
from framewise.operators import chunks
from framewise.operators.chunks import CHUNK, KEYS, ORDER, asc, core

BOX = ("x1", "y1", "x2", "y2")


def of_class(boxes: DataFrame, cls: str = "person") -> DataFrame:
    return boxes.filter(F.col("cls") == cls)


def before_unidentified(boxes: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Boxes of a frame in detector order, up to the first one without a track id (of any class)."""
    frame = Window.partitionBy(*keys, order)
    cut = F.min(F.when(F.col("track_id").isNull(), F.col("det_idx"))).over(frame)
    return boxes.withColumn("_cut", cut).filter(F.col("_cut").isNull() | (F.col("det_idx") < F.col("_cut"))).drop("_cut")


def last_per_track(boxes: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """One box per track and frame: the last box, at the place of the first."""
    last = [F.max_by(c, "det_idx").alias(c) for c in BOX]
    return boxes.groupBy(*keys, order, "track_id").agg(F.min("det_idx").alias("det_idx"), *last)


def player_boxes(boxes: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """What a tracker pass keeps: identified persons before the first unidentified box."""
    return last_per_track(of_class(before_unidentified(boxes, keys, order)), keys, order)


def game_time(df: DataFrame, mask: DataFrame | None = None, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Rows of frames with play. Without a mask all rows; frame numbers never change."""
    return df if mask is None else df.join(mask.select(*keys, order), [*keys, order], "left_semi")


def keyframes(df: DataFrame, n: int, order: str = ORDER) -> DataFrame:
    """Every n-th frame, from frame 1."""
    return df.filter((F.col(order) >= 1) & ((F.col(order) - 1) % n == 0))


def align(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Rows of two layers with the same frame."""
    return a.join(b, [*keys, order])


def flag_frames(
    df: DataFrame, marked: DataFrame, out: str, keys: Sequence[str] = KEYS, order: str = ORDER
) -> DataFrame:
    """Whether the frame of a row is in `marked`."""
    flags = marked.select(*keys, order).distinct().withColumn(out, F.lit(True))
    return df.join(flags, [*keys, order], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def look_up(df: DataFrame, label: str, mapping: dict, out: str) -> DataFrame:
    """Value of a label in a small fixed mapping; NULL for unknown labels."""
    table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return df.withColumn(out, F.try_element_at(table, F.col(label)))


def first_frame_distances(
    players: DataFrame, points: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER
) -> DataFrame:
    """Distance of each player centre to each court point in frame 0."""
    p0 = players.filter(F.col(order) == 0).select(
        *keys, "track_id", "det_idx", centre_x(F.col("x1"), F.col("x2")).alias("cx"), centre_y(F.col("y1"), F.col("y2")).alias("cy")
    )
    k0 = points.filter(F.col(order) == 0).select(*keys, "kp_idx", F.col("x").alias("kx"), F.col("y").alias("ky"))
    dist = distance(F.col("cx"), F.col("cy"), F.col("kx"), F.col("ky"))
    return p0.join(k0, list(keys)).select(*keys, "track_id", "det_idx", "kp_idx", dist.alias("dist"))


def nearest_point_distance(
    players: DataFrame, points: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER
) -> DataFrame:
    """Smallest frame-0 distance of each player to any court point."""
    pairs = first_frame_distances(players, points, keys, order)
    return pairs.groupBy(*keys, "track_id").agg(F.min("dist").alias("min_dist"), F.min("det_idx").alias("det_idx"))


def choose_players(
    players: DataFrame, points: DataFrame, k: int | None = 2, keys: Sequence[str] = KEYS, order: str = ORDER
) -> DataFrame:
    """The k players nearest to a court point in frame 0, all where k is None; ties by order of appearance."""
    nearest = nearest_point_distance(players, points, keys, order)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("min_dist", "det_idx"))
    ranked = nearest.withColumn("rank", rank)
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def keep_tracks(players: DataFrame, chosen: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of the chosen tracks in all frames."""
    return players.join(chosen.select(*keys, "track_id"), [*keys, "track_id"], "left_semi")


def keep_in_map(
    frames: DataFrame,
    chosen: DataFrame,
    boxes: str = "boxes",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The same on the nested form, a map from track id to box; frames may become empty but stay."""
    wanted = chosen.groupBy(*keys).agg(F.collect_set("track_id").alias("_wanted"))
    joined = chunks.join_track(frames, wanted, keys, "left")
    chosen_only = F.map_filter(boxes, lambda track, _: F.coalesce(F.array_contains("_wanted", track), F.lit(False)))
    return joined.withColumn(boxes, chosen_only).drop("_wanted")


def nearest_player(
    players: DataFrame,
    ball: DataFrame,
    clamp: int | None = 1,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
) -> DataFrame:
    """The player nearest to the ball in each frame, the first one on a tie.

    A missing ball counts as (0, 0). Ids above `clamp` become `clamp`.
    """
    b = ball.select(*keys, order, F.coalesce("x", F.lit(0.0)).alias("bx"), F.coalesce("y", F.lit(0.0)).alias("by"))
    dist = distance(F.col("bx"), F.col("by"), centre_x(F.col("x1"), F.col("x2")), centre_y(F.col("y1"), F.col("y2")))
    best = F.min(F.struct(dist.alias("dist"), "det_idx", "track_id"))
    nearest = chunks.join_frames(players, b, [*keys, order]).groupBy(*keys, order).agg(best.alias("m"))
    track = F.col("m.track_id")
    return nearest.select(
        *keys, order, (F.least(track, F.lit(clamp)) if clamp is not None else track).alias("track_id"), F.col("m.dist").alias("dist")
    )


def nearest_court_point(
    points: DataFrame,
    court: DataFrame,
    allowed: Sequence[int] = (0, 2, 12, 13),
    metric: str = "dy",
    id_cols: Sequence[str] = (),
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
) -> DataFrame:
    """The allowed court point nearest to each point (x, y), by vertical or plain distance.

    One row per row of `points`; without an allowed court point in its frame the new columns are NULL. The
    few allowed points of a frame are gathered to one list after they are dealt by frame, so equal points stay apart.
    """
    if metric not in ("dy", "euclid"):
        raise ValueError(f"unknown metric {metric!r}")
    spots = F.collect_list(F.struct("kp_idx", F.col("x").alias("kx"), F.col("y").alias("ky"))).alias("_spots")
    dealt = court.filter(F.col("kp_idx").isin(*allowed)).select(*keys, order, "kp_idx", "x", "y").repartition(*keys, order)
    spots = dealt.groupBy(*keys, order).agg(spots)
    x, y = F.col("x"), F.col("y")

    def candidate(p):
        d = F.abs(y - p["ky"]) if metric == "dy" else distance(x, y, p["kx"], p["ky"])
        return F.struct(d.alias("kp_dist"), p["kp_idx"].alias("kp_idx"), p["kx"].alias("kx"), p["ky"].alias("ky"))

    best = F.array_min(F.transform("_spots", candidate)).alias("_best")
    return chunks.join_frames(points, spots, [*keys, order], "left").select(*points.columns, best).select(*points.columns, "_best.*")


def labels_of_frame_before(
    labels: DataFrame, label: str = "kp_idx", keys: Sequence[str] = KEYS, order: str = ORDER, size: int = CHUNK
) -> DataFrame:
    """The labels that a frame shares with the frame before, once each; a missing label is one like any other.

    Rows are dealt by piece, once; the last frame of a piece is copied to the next one.
    """
    rows = chunks.with_halo(labels.select(*keys, order, label), order, 1, 0, size).repartition(*keys, "_chunk")
    rows = rows.distinct()
    before = F.lag(order).over(asc([*keys, label], order))
    return core(rows.withColumn("_before", before).filter(F.col("_before") == F.col(order) - 1)).select(*keys, order, label)


def over_score(df: DataFrame, score: Column | str = "score", threshold: float = 0.45) -> DataFrame:
    """Rows with a score strictly above the threshold."""
    return df.filter((F.col(score) if isinstance(score, str) else score) > threshold)


def mean_position(ball: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of all present positions of a track."""
    return ball.groupBy(*keys).agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
