"""Checks on detection tables."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.operators.chunks import KEYS, ORDER


def coverage(frames: DataFrame, predictions: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Frames that do not have exactly one prediction row, and predictions of no frame.

    `problem` is 'missing', 'duplicate' or 'unknown_frame'; no rows means the contract holds.
    """
    key = [*keys, order]
    counts = predictions.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))
    both = frames.select(*key, F.lit(True).alias("_known")).join(counts, key, "full")
    n = F.coalesce("n_rows", F.lit(0)).cast("long")
    problem = (
        F.when(F.col("_known").isNull(), "unknown_frame").when(n == 0, "missing").when(n > 1, "duplicate")
    )
    return both.select(*key, n.alias("n_rows"), problem.alias("problem")).filter(F.col("problem").isNotNull())


def null_profile(df: DataFrame, cols: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Number of missing values per column, over the table or per key."""
    names = [c for c in (cols or df.columns) if c not in keys]
    counts = [F.coalesce(F.count_if(F.col(c).isNull()), F.lit(0)).cast("long").alias(f"{c}_nulls") for c in names]
    return df.groupBy(*keys).agg(*counts) if keys else df.agg(*counts)
