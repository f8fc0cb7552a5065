"""Bounce features, scores and run suppression."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from framewise.operators import chunks
from framewise.operators.chunks import CHUNK, KEYS, ORDER, asc, core, desc

EPS = 1e-15
STEPS = (1, 2)
SCORE_THRESHOLD = 0.45
FEATURES = tuple(f"{c}_{kind}_{i}" for c in "xy" for kind in ("diff", "diff_inv", "div") for i in STEPS)


def _features(w: WindowSpec) -> dict[str, Column]:
    out = {}
    for i in STEPS:
        for c in "xy":
            back, ahead = F.lag(c, i).over(w) - F.col(c), F.lead(c, i).over(w) - F.col(c)
            if c == "x":
                back, ahead = F.abs(back), F.abs(ahead)
            ratio = F.try_divide(back, ahead + EPS)
            out |= {
                f"{c}_diff_{i}": back,
                f"{c}_diff_inv_{i}": ahead,
                f"{c}_div_{i}": F.abs(ratio) if c == "x" else ratio,
            }
    return out


def bounce_features(
    ball: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER, size: int = CHUNK, keep_chunk: bool = False
) -> DataFrame:
    """Differences to the two frames before and after; rows where x of any of the five is missing are left out."""
    rows = chunks.chunked(ball.select(*keys, order, "x", "y"), keys, order, max(STEPS), max(STEPS), size=size)
    rows = core(rows.withColumns(_features(asc(keys, order))), keep_chunk)
    x_differences = [f"x_{kind}_{i}" for kind in ("diff", "diff_inv") for i in STEPS]
    rest = ["_chunk"] if keep_chunk else []
    return rows.dropna(subset=["x", *x_differences]).select(*keys, order, *rest, *FEATURES)


def suppress_runs(
    scored: DataFrame,
    threshold: float = SCORE_THRESHOLD,
    score: str = "score",
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """One row per run of neighbouring candidate rows: the last one whose score rises.

    Candidates are rows with a score above the threshold; neighbours are neighbouring rows
    of the table, whatever their frame numbers. A row without a score ends a run. A rising row
    stays if the next rising row comes after the end of its run.
    """
    rows = chunks.with_chunk(scored.select(*keys, order, score, *[c for c in scored.columns if c == "_chunk"]), order, size)
    rows = rows.withColumn("_s", F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))))
    rows = chunks.previous_row(rows, ["_s"], keys, order, size, prefix="_prev")
    before = F.coalesce("_prev_s", F.lit(threshold))
    candidate = F.col("_s") > threshold
    rising = candidate & ((before <= threshold) | (F.col("_s") > before))
    rows = rows.withColumn("_event", F.when(~candidate, 0).when(rising, 1)).drop("_prev_s", "_s")
    table = chunks.carry_table(rows, ["_event"], keys, order, size, sides="n")
    after = desc(keys, order).rowsBetween(chunks.UNBOUNDED, -1)
    rows = rows.withColumn("_next", F.last("_event", True).over(after)).join(table, [*keys, "_chunk"])
    run_ends = F.coalesce("_next", "_event_nv", F.lit(0)) == 0
    return rows.filter((F.col("_event") == 1) & run_ends).select(*keys, order, score)


def turn_score() -> Column:
    """A fixed score: high where the vertical motion turns and x goes on evenly."""
    turn = F.when((F.col("y_diff_1") < 0) & (F.col("y_diff_inv_1") < 0), 0.6).otherwise(0.0)
    even = F.least(F.col("x_div_1"), F.lit(1.0)) * 0.3
    return turn + even + F.when(F.col("y_diff_2") * F.col("y_diff_inv_2") > 0, 0.25).otherwise(0.0)
