"""Window operators along a track. See `chunks` for how long tracks are cut."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from framewise.operators import chunks
from framewise.operators.chunks import CHUNK, KEYS, ORDER, UNBOUNDED, asc, core, join_track, so_far

MA_WINDOW = 5
LOOK_AHEAD = 30


def windowed(
    df: DataFrame,
    columns: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """Add window columns that reach at most `before` and `after` frames.

    All columns share one shuffle and one sort.
    """
    rows = chunks.chunked(df, keys, order, before, after, size=size)
    return core(rows.withColumns(columns(asc(keys, order))))


def shift(df: DataFrame, cols: Sequence[str], steps: Sequence[int] = (1, 2), **kw) -> DataFrame:
    """Columns `c_lag_n` (n frames back) and `c_lead_n` (n frames ahead)."""

    def columns(w):
        lags = {f"{c}_lag_{n}": F.lag(c, n).over(w) for c in cols for n in steps}
        return lags | {f"{c}_lead_{n}": F.lead(c, n).over(w) for c in cols for n in steps}

    return windowed(df, columns, max(steps), max(steps), **kw)


def difference(df: DataFrame, cols: Sequence[str], **kw) -> DataFrame:
    """`delta_c`: value minus the value of the frame before; NULL on the first frame."""
    return windowed(df, lambda w: {f"delta_{c}": F.col(c) - F.lag(c).over(w) for c in cols}, before=1, **kw)


def moving_average(df: DataFrame, cols: Sequence[str], window: int = MA_WINDOW, **kw) -> DataFrame:
    """`c_ma`: mean of the present values among the last `window` frames."""
    reach = window - 1
    return windowed(df, lambda w: {f"{c}_ma": F.avg(c).over(w.rowsBetween(-reach, 0)) for c in cols}, reach, **kw)


def counts_ahead(conditions: dict[str, Column], w: WindowSpec, ahead: int = LOOK_AHEAD) -> dict[str, Column]:
    """How many of the next rows meet each condition, as a difference of two running counts.

    A frame of 30 following rows would be summed up again for every row.
    """
    out = {}
    for name, cond in conditions.items():
        running = F.count_if(cond).over(so_far(w))
        total = F.count_if(cond).over(w.rowsBetween(UNBOUNDED, Window.unboundedFollowing))
        out[name] = F.coalesce(F.lead(running, ahead).over(w), total) - running
    return out


def look_ahead_counts(df: DataFrame, col: str, ahead: int = LOOK_AHEAD, **kw) -> DataFrame:
    """How many of the next rows are negative, and how many positive."""
    signs = {"n_neg_ahead": F.col(col) < 0, "n_pos_ahead": F.col(col) > 0}
    return windowed(df, lambda w: counts_ahead(signs, w, ahead), after=ahead, **kw)


def max_height(
    players: DataFrame, before: int = 20, after: int = 49, keys: Sequence[str] = KEYS, order: str = ORDER, size: int = CHUNK
) -> DataFrame:
    """Largest box height of a player from 20 frames back to 49 ahead, by frame number."""
    columns = lambda w: {"max_height": F.max(F.col("y2") - F.col("y1")).over(w.rangeBetween(-before, after))}
    return windowed(players, columns, before, after, keys=[*keys, "track_id"], order=order, size=size)


def extremes(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Smallest and largest value of each track."""
    return df.groupBy(*keys).agg(*[f(c).alias(f"{c}_{f.__name__}") for c in cols for f in (F.min, F.max)])


def min_max_scale(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """`c_norm` in [0, 1] over the track; NULL when all values are equal."""
    joined = join_track(df, extremes(df, cols, keys), keys)
    for c in cols:
        low, high = F.col(f"{c}_min"), F.col(f"{c}_max")
        joined = joined.withColumn(f"{c}_norm", F.try_divide(F.col(c) - low, high - low)).drop(f"{c}_min", f"{c}_max")
    return joined


def ball_segments(
    ball: DataFrame,
    max_step: float = 100,
    max_gap: int = 30,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """Number the segments of the detected points, from 1. Every detected point is in one.

    A segment ends where the next detected point is not within `max_step`, or after more
    than `max_gap` frames without a point.
    """
    seen = ball.filter(F.col("x").isNotNull() & F.col("y").isNotNull())

    def starts(w):
        step2 = (F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2
        gap = F.col(order) - F.lag(order).over(w) - 1
        return {"_new": F.when((F.sqrt(step2) < max_step) & (gap <= max_gap), 0).otherwise(1)}

    rows = windowed(seen, starts, before=max_gap + 1, keys=keys, order=order, size=size)
    return chunks.running_total(rows, "_new", "segment", keys, order, size).drop("_new")
