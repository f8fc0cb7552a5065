"""Windows over long tracks, without one task per track.

A window partitioned by `video_id` runs each video in one task, and one video may hold
a third of all rows. So every ordered operator here works on pieces of a track: the key
is (keys, `_chunk`) with `_chunk = floor(order / size)`, at most `size` frames each.

Three devices make the pieces give the same result as the whole track:

* halo: the rows next to a border are copied into the neighbouring piece, so a window
  that reaches a bounded number of frames finds all its rows (`with_halo`);
* carry: a small table, one row per piece, hands the nearest valid value beyond a border
  to the piece (`carry_table`), as columns to join or as extra rows (`chunked`);
* a table with one row per track is joined plainly on the keys (`join_track`): one side has a
  single row per key, so Spark may split a hot track, or broadcast the side it has measured.

The summary tables shrink the data by the piece size. Positions are row positions only
where each frame has one row (see `sources.contracts.coverage`); frames may be missing
for `carry_table`, `running_total` and for range frames.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = 65536
KEYS = ("video_id",)
ORDER = "frame"

UNBOUNDED = Window.unboundedPreceding


def chunk_of(order: str, size: int) -> Column:
    """The home piece of a row. A row without a frame number has none, and is refused."""
    home = F.floor(F.col(order) / F.lit(size)).cast("long")
    return F.coalesce(home, F.raise_error(F.lit(f"a row without {order}: see sources.contracts.coverage")).cast("long"))


def with_chunk(df: DataFrame, order: str = ORDER, size: int = CHUNK) -> DataFrame:
    """Add the home piece of each row; a table that has one keeps it."""
    return df if "_chunk" in df.columns else df.withColumn("_chunk", chunk_of(order, size))


def asc(keys: Sequence[str] = KEYS, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys, "_chunk").orderBy(order)


def desc(keys: Sequence[str] = KEYS, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys, "_chunk").orderBy(F.desc(order))


def so_far(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(UNBOUNDED, 0)


def with_halo(df: DataFrame, order: str, before: int, after: int, size: int) -> DataFrame:
    """Copy border rows into the neighbouring piece; `_core` marks the originals."""
    if max(before, after) > size:
        raise ValueError(f"chunk size {size} is smaller than the window reach {max(before, after)}")
    home = chunk_of(order, size)
    offset = F.col(order) - home * size
    places = [home]
    if before:
        places.append(F.when(offset >= size - before, home + 1))
    if after:
        places.append(F.when(offset < after, home - 1))
    if len(places) == 1:
        return df.withColumn("_chunk", home).withColumn("_core", F.lit(True))
    copies = df.withColumn("_chunk", F.explode(F.array_compact(F.array(*places))))
    return copies.withColumn("_core", F.col("_chunk") == home)


def carry_table(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
    before: int = 0,
    after: int = 0,
    sides: str = "pn",
) -> DataFrame:
    """One row per piece: for each column c the nearest valid value outside of the piece.

    `c_pf`, `c_pv` are order and value of the last valid row before the piece and its
    halo, `c_nf`, `c_nv` those of the first valid row after. `df` has its home `_chunk`.
    """
    offset = F.col(order) - F.col("_chunk") * size
    # Per side: how to pick, the window over the pieces, the next piece, the rows outside of a halo.
    plan = {
        "p": (F.max, F.max_by, Window.partitionBy(*keys).orderBy("_chunk"), 1, before, offset < size - before),
        "n": (F.min, F.min_by, Window.partitionBy(*keys).orderBy(F.desc("_chunk")), -1, after, offset >= after),
    }
    aggs, out = [], [F.col(k) for k in keys] + [F.col("_chunk")]
    for c in cols:
        value, valid = F.col(c), F.col(c).isNotNull()
        for side in sides:
            pick, pick_by, window, step, reach, outside = plan[side]
            name = f"_{c}_{side}"
            at = F.when(valid, F.col(order))
            aggs += [pick(at).alias(f"{name}f"), pick_by(value, at).alias(f"{name}v")]
            earlier = window.rowsBetween(UNBOUNDED, -1)
            if not reach:
                out += [F.last(f"{name}{kind}", True).over(earlier).alias(f"{c}_{side}{kind}") for kind in "fv"]
                continue
            # The neighbour's halo rows are in the piece already: take its valid row outside of them.
            at = F.when(valid & outside, F.col(order))
            aggs += [pick(at).alias(f"{name}_partf"), pick_by(value, at).alias(f"{name}_partv")]
            beside = F.lag("_chunk").over(window) == F.col("_chunk") - step
            for kind in "fv":
                farther = F.last(f"{name}{kind}", True).over(window.rowsBetween(UNBOUNDED, -2))
                nearest = F.last(f"{name}{kind}", True).over(earlier)
                part = F.lag(f"{name}_part{kind}").over(window)
                out.append(F.when(beside, F.coalesce(part, farther)).otherwise(nearest).alias(f"{c}_{side}{kind}"))
    return df.groupBy(*keys, "_chunk").agg(*aggs).select(*out)


def chunked(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    before: int = 0,
    after: int = 0,
    carry: Sequence[str] = (),
    size: int = CHUNK,
) -> DataFrame:
    """Pieces with all the context they need; results hold where `_core` is true.

    Every piece gets `before` and `after` frames of its neighbours and, for each column
    in `carry`, one extra row with the nearest valid value beyond them on either side.
    One shuffle on (keys, `_chunk`) then serves any number of windows.
    """
    df = df.drop("_chunk")
    rows = with_halo(df, order, before, after, size)
    if not carry:
        return rows
    table = carry_table(with_chunk(df, order, size), carry, keys, order, size, before, after)
    types = dict(df.dtypes)
    extra = [
        F.struct(
            F.col(f"{c}_{side}f").alias(order),
            *[(F.col(f"{c}_{side}v") if o == c else F.lit(None).cast(types[o])).alias(o) for o in carry],
        )
        for c in carry
        for side in "pn"
    ]
    context = (
        table.select(*keys, "_chunk", F.explode(F.array(*extra)).alias("e"))
        .select(*keys, "_chunk", "e.*", F.lit(False).alias("_core"))
        .filter(F.col(order).isNotNull())
    )
    return rows.unionByName(context, allowMissingColumns=True)


def core(df: DataFrame, keep_chunk: bool = False) -> DataFrame:
    """Drop the copied rows again."""
    return df.filter("_core").drop("_core", *([] if keep_chunk else ["_chunk"]))


def join_track(rows: DataFrame, dim: DataFrame, keys: Sequence[str] = KEYS, how: str = "inner") -> DataFrame:
    """Join a table with one row per track to the rows."""
    return rows.join(dim, list(keys), how)


def join_frames(rows: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two tables that both grow with the frames: dealt and sorted, never broadcast.

    Spark takes the size of a stored table from its compressed files. A few MB of them hold millions of rows, which a
    broadcast would gather in the driver.
    """
    return rows.join(dim.hint("merge"), list(keys), how)


def join_pieces(rows: DataFrame, dim: DataFrame, keys: Sequence[str] = KEYS, how: str = "inner") -> DataFrame:
    """The same for rows that are dealt by (keys, `_chunk`) before and after: they aren't shuffled for it."""
    pieces = rows.select(*keys, "_chunk").distinct().join(dim, list(keys))
    return rows.join(pieces, [*keys, "_chunk"], how)


def running_total(
    df: DataFrame,
    col: str,
    out: str,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """Running sum along a track: within the piece, plus the total of earlier pieces."""
    had = "_chunk" in df.columns
    d = with_chunk(df, order, size)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(UNBOUNDED, -1)
    base = (
        d.groupBy(*keys, "_chunk")
        .agg(F.sum(col).alias("_sum"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    )
    local = d.withColumn(out, F.sum(col).over(so_far(asc(keys, order))))
    joined = local.join(base, [*keys, "_chunk"]).withColumn(out, F.col(out) + F.col("_base")).drop("_base")
    return joined if had else joined.drop("_chunk")


def previous_row(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
    prefix: str = "prev_",
) -> DataFrame:
    """Values of the row before, however many frames lie between. `cols` must not be NULL.

    The last row of each piece is found by the window that finds the rows before, so wide values are not sorted again.
    """
    had = "_chunk" in df.columns
    d = with_chunk(df, order, size)
    along = Window.partitionBy(*keys).orderBy("_chunk")
    ends = d.withColumn("_after", F.lead(order).over(asc(keys, order))).filter(F.col("_after").isNull())
    table = ends.select(*keys, "_chunk", *[F.lag(c).over(along).alias(f"{c}_pv") for c in cols])
    joined = d
    for c in cols:
        joined = joined.withColumn(prefix + c, F.lag(c).over(asc(keys, order)))
    joined = joined.join(table, [*keys, "_chunk"])
    for c in cols:
        joined = joined.withColumn(prefix + c, F.coalesce(prefix + c, f"{c}_pv")).drop(f"{c}_pv")
    return joined if had else joined.drop("_chunk")


def positions(
    df: DataFrame,
    order: Sequence[str],
    bucket: Column,
    keys: Sequence[str] = KEYS,
    name: str = "pos",
) -> DataFrame:
    """Number the rows of each track from 0, in the order of some columns.

    `bucket` is any expression that grows with the first order column: rows are counted
    per bucket, the counts are summed up along the track, and only the inside of a
    bucket is sorted in one task.
    """
    d = df.withColumn("_bucket", bucket)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(UNBOUNDED, -1)
    base = (
        d.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return (
        d.withColumn("_i", inside)
        .join(base, [*keys, "_bucket"])
        .withColumn(name, (F.col("_base") + F.col("_i") - 1).cast("long"))
        .drop("_base", "_i", "_bucket")
    )
