"""Reading, caching and writing detection tables."""

import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise import schema
from framewise.operators.chunks import KEYS, ORDER, chunk_of


def is_stored(spark: SparkSession, path: str) -> bool:
    """True when a write to `path` has committed, on any file system Spark can reach."""
    jvm = spark._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def read_detections(spark: SparkSession, path: str, table_schema: T.StructType | None = None) -> DataFrame:
    """Stored detections. Filters on video and frame reach the file statistics."""
    reader = spark.read.schema(table_schema) if table_schema is not None else spark.read
    return schema.clean_nan(reader.parquet(path))


def write_detections(
    df: DataFrame,
    path: str,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> None:
    """Store a table sorted by track and frame.

    Range partitioning splits a very long video over many files and keeps short ones
    together; file and row-group statistics then prune by video and frame. Directories
    per value (`partition_by`) are for columns with few values.
    """
    placed = df.repartitionByRange(*keys, order).sortWithinPartitions(*partition_by, *keys, order)
    writer = placed.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def load_or_compute(
    spark: SparkSession,
    path: str | None,
    compute: Callable[[], DataFrame],
    read_stored: bool = True,
) -> DataFrame:
    """Stored detections if wanted and present; else compute, and store if a path is given."""
    if path is None:
        return compute()
    if not (read_stored and is_stored(spark, path)):
        write_detections(compute(), path)
    return read_detections(spark, path)


def frame_spine(videos: DataFrame, n: str = "n", size: int = 65536) -> DataFrame:
    """All frame numbers 0..n-1 of each video, from one row per video.

    The range is expanded in two steps with a shuffle between, so that the frames of a
    long video are made by many tasks.
    """
    starts = videos.filter(F.col(n) > 0).select(
        "video_id", n, F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / size).cast("long"))).alias("_chunk")
    )
    last = (F.least(F.col(n), (F.col("_chunk") + 1) * size) - 1).cast("long")
    return starts.repartition("video_id", "_chunk").select(
        "video_id", F.explode(F.sequence((F.col("_chunk") * size).cast("long"), last)).alias("frame")
    )


def complete_frames(frames: DataFrame, detections: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """One row at least for each frame; frames without a detection get NULLs."""
    return frames.select(*keys, order).join(detections, [*keys, order], "left")


def points_table(spark: SparkSession, rows: Iterable[tuple], video_id: int = 0) -> DataFrame:
    """A `ball` table from an ordered list of (x, y) pairs; a missing point is (None, None)."""
    data = [
        (video_id, i, None if x is None else float(x), None if y is None else float(y)) for i, (x, y) in enumerate(rows)
    ]
    return schema.clean_nan(spark.createDataFrame(data, schema.BALL))


def name_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Give the columns of a table new names, by position."""
    return df.toDF(*names)


def point_arrays(ball: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER, size: int = 65536) -> DataFrame:
    """Points as [x, y] lists in frame order: one list of at most `size` points per piece of a track."""
    points = F.sort_array(F.collect_list(F.struct(order, F.array("x", "y").alias("p"))))
    return (
        ball.groupBy(*keys, chunk_of(order, size).alias("piece"))
        .agg(points.alias("points"))
        .withColumn("points", F.transform("points", lambda s: s["p"]))
    )


def first_box(boxes: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """The first box of each frame in detector order. No confidence filter."""
    first = [F.min_by(c, "det_idx").alias(c) for c in ("x1", "y1", "x2", "y2")]
    return boxes.groupBy(*keys, order).agg(*first)


def as_track_map(players: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Boxes of a frame as one map from track id to box."""
    entry = F.struct("track_id", F.struct("x1", "y1", "x2", "y2"))
    return players.groupBy(*keys, order).agg(F.map_from_entries(F.collect_list(entry)).alias("boxes"))


def first_rows(df: DataFrame, n: int, order: str = ORDER, keys: Sequence[str] = KEYS) -> DataFrame:
    """The first n rows in track and frame order."""
    return df.orderBy(*keys, order).limit(n)


def last_rows(df: DataFrame, n: int, order: str = ORDER, keys: Sequence[str] = KEYS) -> DataFrame:
    """The last n rows in track and frame order."""
    return df.orderBy(*[F.desc(k) for k in keys], F.desc(order)).limit(n)


def random_rows(df: DataFrame, n: int, seed: int = 0, by: Sequence[str] = (*KEYS, ORDER)) -> DataFrame:
    """n rows at random: those with the smallest digests of the seed and the row's key, the columns in `by`.

    The choice depends on seed and keys alone, not on how rows are dealt; each task hands on n rows at most. A null in a key
    counts as an empty text. Rows of equal key have equal chances as a group: which of them comes first isn't defined.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), *by).limit(n)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, in the shared folder of the session.

    That is the one in `spark.checkpoint.dir`; where it is unset, one in the warehouse, which executors share too.
    """
    default = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{spark.conf.get('spark.checkpoint.dir', default).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written once to the shared folder: cuts the lineage where several steps read a result."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
