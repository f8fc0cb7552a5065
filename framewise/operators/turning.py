"""Frames where a track changes direction for good."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.operators import chunks
from framewise.operators.chunks import CHUNK, KEYS, ORDER, asc, core
from framewise.operators.fill import fill_columns
from framewise.operators.windows import MA_WINDOW, counts_ahead

MIN_CHANGES = 25


def turning_flags(
    ball: DataFrame,
    col: str = "y",
    window: int = MA_WINDOW,
    min_changes: int = MIN_CHANGES,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
    keep: Sequence[str] = (),
    complete: bool = False,
) -> DataFrame:
    """Add `turn`: the smoothed step changes sign here and mostly keeps the new sign. Columns in `keep` are handed on.

    Gaps are filled first. With `complete` a track has no gaps (or no values at all), and what lies beyond a piece
    and its neighbours' rows isn't looked up.

    Of the next 30 (1.2 times `min_changes`) steps at least `min_changes` must have the new
    sign; zero steps count for neither, and the last 30 frames have no event.
    """
    ahead = int(min_changes * 1.2)
    carry = [] if complete else [col]
    rows = chunks.chunked(ball.select(*keys, order, col, *keep), keys, order, before=window, after=ahead + 1, carry=carry, size=size)
    if not complete:
        rows = fill_columns(rows, [col], keys, order)
    w = asc(keys, order)
    rows = rows.withColumn("_ma", F.avg(col).over(w.rowsBetween(1 - window, 0)))
    rows = rows.withColumn("delta", F.col("_ma") - F.lag("_ma").over(w))
    d, nxt = F.col("delta"), F.col("_next")
    rows = rows.withColumns(
        counts_ahead({"_neg": d < 0, "_pos": d > 0}, w, ahead)
        | {"_next": F.lead("delta").over(w), "_last": F.lead(order, ahead).over(w)}
    )
    turn = ((d > 0) & (nxt < 0) & (F.col("_neg") >= min_changes)) | (
        (d < 0) & (nxt > 0) & (F.col("_pos") >= min_changes)
    )
    flag = F.coalesce(turn, F.lit(False)) & F.col("_last").isNotNull() & (F.col(order) >= 1)
    return core(rows.withColumn("turn", flag)).drop("_ma", "_next", "_last", "_neg", "_pos")


def turning_points(ball: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER, **kw) -> DataFrame:
    """The frames where `turning_flags` holds."""
    return turning_flags(ball, keys=keys, order=order, **kw).filter("turn").select(*keys, order)
