"""Queries on sources, sinks and contracts."""

from pyspark.sql import functions as F

from framewise import schema
from framewise.catalog import register
from framewise.catalog.sql import query
from framewise.operators import chunks, overlay
from framewise.sources import contracts, pieces, tables

_BALL = query("SELECT video_id, frame, x, y FROM ball", "ball")


@register("s1_load_or_compute", _BALL)
def _(t):
    path = tables.work_folder(t.spark, "ball")
    tables.load_or_compute(t.spark, path, lambda: t.track)

    def not_again():
        raise AssertionError("stored detections were not used")

    return tables.load_or_compute(t.spark, path, not_again)


@register("s1_load_covered", _BALL)
def _(t):
    """Stored for the frames of the videos, read back for the same ones."""
    path = tables.work_folder(t.spark, "ball")
    pieces.load_or_compute(t.spark, path, t.frames, lambda: t.track, size=512)

    def not_again():
        raise AssertionError("stored detections were not used")

    return pieces.load_or_compute(t.spark, path, t.frames, not_again).drop("_chunk")


@register("s2_windows_of_stored_pieces", query(
    """SELECT video_id, frame, (sum(CASE WHEN x IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY frame))::BIGINT AS n_seen,
      x - lag(x) OVER (PARTITION BY video_id, frame // 512 ORDER BY frame) AS step FROM ball""", "ball"))
def _(t):
    """Running numbers of seen points and steps inside a piece, of rows that stay dealt as they were stored."""
    path = tables.work_folder(t.spark, "ball")
    rows = pieces.write_pieces(t.track, path, t.frames, size=512)
    rows = rows.withColumn("seen", F.col("x").isNotNull().cast("long"))
    rows = rows.withColumn("step", F.col("x") - F.lag("x").over(chunks.asc()))
    return chunks.running_total(rows, "seen", "n_seen").select("video_id", "frame", "n_seen", "step")


def _written(t):
    path = tables.work_folder(t.spark, "players")
    tables.write_detections(t.players, path)
    return tables.read_detections(t.spark, path, schema.PLAYERS)


@register("s2_write_detections", query("SELECT * FROM players", "players"))
def _(t):
    return _written(t)


@register("s2_read_some_frames", query(
    "SELECT * FROM players WHERE frame BETWEEN 100 AND 199 AND track_id IS NOT NULL", "players"))
def _(t):
    """A filter that reaches the files."""
    return _written(t).filter(F.col("frame").between(100, 199) & F.col("track_id").isNotNull())


@register("s3_frame_spine", query("SELECT video_id, frame FROM ball", "ball"))
def _(t):
    lengths = t.frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    return tables.frame_spine(lengths, size=256)


@register("s4_name_columns", query("SELECT video_id, frame, x AS ball_x, y AS ball_y FROM ball", "ball"))
def _(t):
    return tables.name_columns(t.track, ["video_id", "frame", "ball_x", "ball_y"])


@register("s5_point_arrays", query(
    "SELECT video_id, frame // 300 AS piece, (frame % 300)::INT AS i, x, y FROM ball", "ball"))
def _(t):
    arrays = tables.point_arrays(t.track, size=300)
    return arrays.select("video_id", "piece", F.posexplode("points").alias("i", "p")).select(
        "video_id", "piece", "i", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@register("s6_write_overlay", query(
    "SELECT video_id, frame, trunc(x) AS x, trunc(y) AS y, kp_idx::VARCHAR AS label FROM kps", "kps"))
def _(t):
    path = tables.work_folder(t.spark, "overlay")
    tables.write_detections(overlay.point_layer(t.kps), path, partition_by=["layer"])
    return tables.read_detections(t.spark, path).filter("layer = 'keypoint'").select("video_id", "frame", "x", "y", "label")


def _faulty(t):
    """Predictions with frames lost, doubled and made up."""
    copies = F.when(F.col("k") % 17 == 0, 0).when(F.col("k") % 19 == 0, 2).otherwise(1)
    shifted = F.when(F.col("k") % 23 == 0, F.col("frame") + 1_000_000).otherwise(F.col("frame"))
    rows = t.ball.select("video_id", shifted.alias("frame"), F.explode(F.array_repeat("x", copies)).alias("x"))
    return rows


@register("d1_coverage", query(
    """SELECT COALESCE(f.video_id, p.video_id) AS video_id, COALESCE(f.frame, p.frame) AS frame, COALESCE(p.n, 0)::BIGINT AS n_rows,
      CASE WHEN f.frame IS NULL THEN 'unknown_frame' WHEN p.n IS NULL THEN 'missing' ELSE 'duplicate' END AS problem
    FROM ball f FULL JOIN (SELECT video_id, CASE WHEN k % 23 = 0 THEN frame + 1000000 ELSE frame END AS frame,
        CASE WHEN k % 19 = 0 AND k % 17 <> 0 THEN 2 ELSE 1 END AS n FROM ball WHERE k % 17 <> 0) p
      ON f.video_id = p.video_id AND f.frame = p.frame
    WHERE f.frame IS NULL OR p.n IS NULL OR p.n > 1""", "ball"))
def _(t):
    return contracts.coverage(t.frames, _faulty(t))


@register("d2_null_profile", query(
    "SELECT video_id, count(*) - count(x) AS x_nulls, count(*) - count(y) AS y_nulls FROM ball GROUP BY video_id", "ball"))
def _(t):
    return contracts.null_profile(t.ball, ["x", "y"], keys=["video_id"])


@register("d3_first_rows", query("SELECT video_id, frame, x, y FROM ball ORDER BY video_id, frame LIMIT 20", "ball"))
def _(t):
    return tables.first_rows(t.track, 20)


@register("d3_last_rows", query("SELECT video_id, frame, x, y FROM ball ORDER BY video_id DESC, frame DESC LIMIT 20", "ball"))
def _(t):
    return tables.last_rows(t.track, 20)


@register("d3_random_rows", "SELECT 5 AS n, 5 AS n_different, 5 AS n_in_table")
def _(t):
    """Five different rows of the table."""
    some = tables.random_rows(t.track, 5, seed=1)
    inside = some.join(t.track.select("video_id", "frame", F.lit(True).alias("known")), ["video_id", "frame"], "left")
    count = lambda c: c.cast("int")
    return inside.agg(
        count(F.count(F.lit(1))).alias("n"), count(F.count_distinct("video_id", "frame")).alias("n_different"), count(F.count("known")).alias("n_in_table"))


@register("d3_random_rows_by_key", query(
    "SELECT video_id, frame, x, y FROM ball ORDER BY md5('7|' || video_id || '|' || frame), video_id, frame LIMIT 20", "ball"))
def _(t):
    return tables.random_rows(t.track, 20, seed=7)
