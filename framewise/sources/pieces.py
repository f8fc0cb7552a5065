"""Detection tables stored by piece: one file per bucket of (keys, `_chunk`), with a manifest.

Windows over the pieces of a stored table, and joins and sums by piece, need no shuffle: Spark reads the buckets as they are
dealt. The manifest tells which frames the detections were made for, so a table of another cut of the video is refused.

The data goes to a new folder below the path, then the manifest is written. Until then the manifest before it holds, so a
write that ends halfway leaves what was there. The folder that an older manifest named is removed after that.
"""

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise import schema
from framewise.operators.chunks import CHUNK, KEYS, ORDER, with_chunk


class StaleStore(ValueError):
    """Stored detections that were made for other frames, or with other columns."""


def _file(spark: SparkSession, path: str):
    """A path and its file system, any that Spark can reach."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What the store says about itself; None where there is none."""
    at, files = _file(spark, f"{path}/manifest.json")
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def frames_covered(frames: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> dict:
    """Number and digest of the different frames, whatever their order; sums that tasks combine."""
    at = frames.select(*keys, order).distinct()
    total = F.sum(F.xxhash64(*keys, order).cast("decimal(38,0)")).cast("string")
    row = at.agg(F.count(F.lit(1)).alias("n"), F.coalesce(total, F.lit("0")).alias("digest")).first()
    return {"n_frames": row["n"], "frames_digest": row["digest"]}


def write_pieces(
    df: DataFrame,
    path: str,
    frames: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
    buckets: int | None = None,
) -> DataFrame:
    """Store a table by piece, and read it back. `frames` are those it was made for, by default the ones it has rows for.

    `buckets` is by default the session's number of shuffle partitions; a long video is dealt over them by piece.
    """
    spark = df.sparkSession
    before = manifest(spark, path)
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    deal, name, folder = [*keys, "_chunk"], f"framewise_{uuid.uuid4().hex}", f"data-{uuid.uuid4().hex}"
    rows = with_chunk(schema.clean_nan(df.drop("_chunk")), order, size)
    writer = rows.repartition(count, *deal).write.format("parquet").bucketBy(count, *deal).sortBy(*deal, order)
    writer.option("path", f"{path}/{folder}").saveAsTable(name)
    told = {
        "folder": folder, "schema": rows.schema.jsonValue(), "keys": list(keys), "order": order, "size": size, "buckets": count,
        **frames_covered(rows if frames is None else frames, keys, order),
    }
    at, files = _file(spark, f"{path}/manifest.json")
    stream = files.create(at, True)
    try:
        stream.write(bytearray(json.dumps(told).encode()))
    finally:
        stream.close()
    if before is not None:
        files.delete(_file(spark, f"{path}/{before['folder']}")[0], True)
    return spark.table(name)


def read_pieces(spark: SparkSession, path: str, frames: DataFrame | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A stored table, dealt by piece. Refused where it wasn't made for exactly these frames, or lacks one of the columns."""
    told = manifest(spark, path)
    if told is None:
        raise FileNotFoundError(f"no stored detections in {path}")
    table = T.StructType.fromJson(told["schema"])
    if lacking := [c for c in columns or () if c not in table.names]:
        raise StaleStore(f"{path} has no column {', '.join(lacking)}")
    if frames is not None:
        wanted = frames_covered(frames, told["keys"], told["order"])
        if any(told[k] != v for k, v in wanted.items()):
            raise StaleStore(f"{path} was made for {told['n_frames']} frames, not for these {wanted['n_frames']}")
    name, deal = f"framewise_{uuid.uuid4().hex}", [*told["keys"], "_chunk"]
    quoted = lambda names: ", ".join(f"`{n}`" for n in names)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table)
    place = f"{path}/{told['folder']}".replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY ({quoted(deal)}) "
        f"SORTED BY ({quoted([*deal, told['order']])}) INTO {told['buckets']} BUCKETS LOCATION '{place}'"
    )
    return spark.table(name)


def load_or_compute(
    spark: SparkSession, path: str | None, frames: DataFrame, compute: Callable[[], DataFrame], read_stored: bool = True, **how
) -> DataFrame:
    """Stored detections of these frames if wanted and there; else compute, and store if a path is given.

    A store that was made for other frames is refused, not used and not written over; `read_stored=False` makes it anew.
    """
    if path is None:
        return compute()
    if read_stored and manifest(spark, path) is not None:
        return read_pieces(spark, path, frames)
    return write_pieces(compute(), path, frames, **how)
