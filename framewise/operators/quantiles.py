"""Exact quantiles per track."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.operators import chunks
from framewise.operators.chunks import KEYS

PER_OCTAVE = 4096
PARTS = 65_536
LEVELS = 2
_ABOVE_ALL_EXPONENTS = 1100


def _range_of(value: Column) -> Column:
    """Number of a value range; grows with the value. Ranges are 1/4096 of an octave wide, at any scale."""
    size = F.floor((F.log2(F.abs(value)) + _ABOVE_ALL_EXPONENTS) * PER_OCTAVE).cast("long")
    return F.when(value > 0, size).when(value < 0, -size).otherwise(0)


def _part_of(value: Column, low: Column, high: Column) -> Column:
    """Number of one of 65,536 equal parts between the smallest and the largest value of a range."""
    return F.least(F.coalesce(F.floor(F.try_divide(value - low, high - low) * PARTS), F.lit(0)), F.lit(PARTS - 1)).cast("long")


def _ranks(rank: Column) -> tuple[Column, Column]:
    return F.floor(rank), F.ceil(rank)


def _wanted(ranges: DataFrame, keys: Sequence[str], rank: Column, base: Column) -> DataFrame:
    """One row per track: the rank, the values from the first to the last one of the ranges that hold it, how many come before.

    `ranges` (keys, _range, _n, _min, _max) are in order.
    """
    ordered = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranges.select(*keys, "_n", "_min", "_max", rank.alias("_rank"), (base + F.sum("_n").over(ordered)).alias("_to"))
    low, high = _ranks(F.col("_rank"))
    held = rows.filter((F.col("_to") > low) & (F.col("_to") - F.col("_n") <= high))
    first = F.min(F.col("_to") - F.col("_n"))
    return held.groupBy(*keys).agg(F.max("_rank").alias("_rank"), first.alias("_base"), F.min("_min").alias("_from"), F.max("_max").alias("_until"))


def narrowed(df: DataFrame, col: str, q: float, keys: Sequence[str] = KEYS, levels: int = LEVELS) -> DataFrame:
    """(keys, _v, _n, _rank, _base): the values around the wanted rank, with their counts and how many values come before.

    The first level counts values per range of a fixed width, so that only counts travel. The values of the range that
    holds the wanted ranks are then counted, and each further level counts them in 65,536 equal parts of what is left.
    """
    piece = ["_chunk"] if "_chunk" in df.columns else []
    rows = df.filter(F.col(col).isNotNull()).select(*keys, *piece, F.col(col).cast("double").alias("_v"))
    value, known = F.col("_v"), ("_rank", "_base", "_from", "_until")
    between = value.between(F.col("_from"), F.col("_until"))
    ends = [F.min("_v").alias("_min"), F.max("_v").alias("_max")]
    track = Window.partitionBy(*keys)
    ranges = rows.groupBy(*keys, _range_of(value).alias("_range")).agg(F.count(F.lit(1)).alias("_n"), *ends)
    wanted = _wanted(ranges, keys, (F.sum("_n").over(track) - 1) * F.lit(q), F.lit(0))
    join = chunks.join_pieces if piece else chunks.join_track
    left = join(rows, wanted, keys).filter(between).groupBy(*keys, "_v", *known).agg(F.count(F.lit(1)).alias("_n"))
    for _ in range(levels - 1):
        part = _part_of(value, F.col("_from"), F.col("_until")).alias("_range")
        ranges = left.groupBy(*keys, "_rank", "_base", part).agg(F.sum("_n").alias("_n"), *ends)
        wanted = _wanted(ranges, keys, F.col("_rank"), F.col("_base"))
        left = chunks.join_track(left.drop(*known), wanted, keys).filter(between)
    return left


def quantile(df: DataFrame, col: str, q: float, keys: Sequence[str] = KEYS, out: str = "quantile") -> DataFrame:
    """The `q` quantile of each track, linear between ranks, NULLs left out.

    The range of values that holds the wanted ranks is narrowed by counts (`narrowed`); only what is left of it is sorted. No
    task sees all values of a track, and each step gives the same result when it is run again. Rows that are dealt by
    piece stay so.
    """
    ordered = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = narrowed(df, col, q, keys).withColumn("_to", F.col("_base") + F.sum("_n").over(ordered))
    low, high = (F.min(F.when(F.col("_to") > r, F.col("_v"))) for r in _ranks(F.col("_rank")))
    found = last.groupBy(*keys).agg(F.max("_rank").alias("_rank"), low.alias("_low"), high.alias("_high"))
    low, high = F.col("_low"), F.col("_high")
    t = F.col("_rank") - F.floor("_rank")
    between = F.when(t < 0.5, low + (high - low) * t).otherwise(high - (high - low) * (1 - t))
    return found.select(*keys, between.alias(out))


def approximate_quantile(
    df: DataFrame, col: str, q: float, keys: Sequence[str] = KEYS, accuracy: int = 10000, out: str = "quantile"
) -> DataFrame:
    """A value whose rank is off by at most 1/accuracy of the rows; one pass, small state."""
    return df.groupBy(*keys).agg(F.approx_percentile(col, q, accuracy).alias(out))
