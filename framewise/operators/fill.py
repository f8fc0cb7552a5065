"""Filling and cleaning a ball track."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from framewise.functions.points import round_to_int, squared_distance
from framewise.operators import chunks
from framewise.operators.chunks import CHUNK, KEYS, ORDER, asc, core, desc, so_far
from framewise.operators.quantiles import quantile
from framewise.operators.windows import MA_WINDOW

XY = ("x", "y")


def _neighbours(cols: Sequence[str], order: str, back: WindowSpec, ahead: WindowSpec) -> dict[str, Column]:
    """Order and value of the nearest valid row on either side, the row itself included.

    Both sides use an (unbounded, current) frame, the later side in descending order: a
    (current, unbounded) frame costs quadratic time.
    """
    out = {}
    for c in cols:
        at = F.when(F.col(c).isNotNull(), F.col(order))
        for side, window in (("p", back), ("n", ahead)):
            out[f"_{c}_{side}f"] = F.last(at, True).over(so_far(window))
            out[f"_{c}_{side}v"] = F.last(c, True).over(so_far(window))
    return out


def _filled(c: str, order: str, linear: bool, backward: bool) -> Column:
    pf, pv, nf, nv = (F.col(f"_{c}_{s}") for s in ("pf", "pv", "nf", "nv"))
    value = F.col(c)
    if linear:
        # Slope first: the same order of operations as the usual 1-d interpolation.
        inner = (nv - pv) / (nf - pf) * (F.col(order) - pf) + pv
        value = F.coalesce(value, F.when(nf.isNotNull() & pf.isNotNull(), inner), pv)
    return F.coalesce(value, nv) if backward else value


def fill_columns(
    rows: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    order: str,
    linear: bool = True,
    backward: bool = True,
) -> DataFrame:
    """Fill in place on rows that carry their context (see `chunks.chunked`)."""
    rows = rows.withColumns(_neighbours(cols, order, asc(keys, order), desc(keys, order)))
    filled = {c: _filled(c, order, linear, backward) for c in cols}
    return rows.withColumns(filled).drop(*[f"_{c}_{s}" for c in cols for s in ("pf", "pv", "nf", "nv")])


def _fill(df, cols, keys, order, size, linear=True, backward=True) -> DataFrame:
    """Fill along the track. Rows that are in pieces already are not shuffled again."""
    had = "_chunk" in df.columns
    rows = chunks.with_chunk(df, order, size)
    table = chunks.carry_table(rows, cols, keys, order, size)
    rows = rows.withColumns(_neighbours(cols, order, asc(keys, order), desc(keys, order)))
    rows = rows.join(table, [*keys, "_chunk"])
    sides = [(c, s) for c in cols for s in ("pf", "pv", "nf", "nv")]
    rows = rows.withColumns({f"_{c}_{s}": F.coalesce(f"_{c}_{s}", f"{c}_{s}") for c, s in sides})
    filled = rows.withColumns({c: _filled(c, order, linear, backward) for c in cols})
    filled = filled.drop(*[f"{c}_{s}" for c, s in sides], *[f"_{c}_{s}" for c, s in sides])
    return filled if had else filled.drop("_chunk")


def interpolate(
    df: DataFrame,
    cols: Sequence[str] = XY,
    backward: bool = False,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """Linear between valid values; after the last one its value; before the first NULL.

    With `backward` the start takes the first valid value.
    """
    return _fill(df, cols, keys, order, size, backward=backward)


def back_fill(
    df: DataFrame, cols: Sequence[str] = XY, keys: Sequence[str] = KEYS, order: str = ORDER, size: int = CHUNK
) -> DataFrame:
    """Missing values take the next valid one."""
    return _fill(df, cols, keys, order, size, linear=False)


def forward_fill(
    df: DataFrame, cols: Sequence[str] = XY, keys: Sequence[str] = KEYS, order: str = ORDER, size: int = CHUNK
) -> DataFrame:
    """Missing values take the last valid one."""
    had = "_chunk" in df.columns
    rows = chunks.with_chunk(df, order, size)
    table = chunks.carry_table(rows, cols, keys, order, size, sides="p")
    local = rows.withColumns({f"_{c}": F.last(c, True).over(so_far(asc(keys, order))) for c in cols})
    joined = local.join(table.select(*keys, "_chunk", *[f"{c}_pv" for c in cols]), [*keys, "_chunk"])
    out = joined.withColumns({c: F.coalesce(f"_{c}", f"{c}_pv") for c in cols})
    out = out.drop(*[f"_{c}" for c in cols], *[f"{c}_pv" for c in cols])
    return out if had else out.drop("_chunk")


def interpolate_positions(
    df: DataFrame, cols: Sequence[str] = XY, keys: Sequence[str] = KEYS, order: str = ORDER, size: int = CHUNK
) -> DataFrame:
    """Interpolate, back-fill the start, round half to even, as int."""
    filled = _fill(df, cols, keys, order, size)
    return filled.withColumns({c: round_to_int(F.col(c)) for c in cols})


def mask_outliers(
    df: DataFrame,
    q: float = 0.95,
    cols: Sequence[str] = XY,
    dist: str = "distance",
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """NULL where `dist` is not under the quantile `q` of the track (first frame left out)."""
    had = "_chunk" in df.columns
    rows = chunks.with_chunk(df, order, size)
    limit = quantile(rows.filter(F.col(order) > 0), dist, q, keys, out="threshold")
    joined = chunks.join_pieces(rows, limit, keys, "left")
    masked = joined.withColumns({c: F.when(F.col(dist) < F.col("threshold"), F.col(c)) for c in cols})
    return masked if had else masked.drop("_chunk")


def step_distance(
    ball: DataFrame,
    window: int = MA_WINDOW,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """Squared distance of the smoothed point to a shifted one: y one frame ahead, x one back.

    The two shifts differ, and missing means count as 0. Rows keep their piece.
    """
    rows = chunks.chunked(ball, keys, order, before=window, after=1, size=size)
    w = asc(keys, order)
    rows = rows.withColumns({f"_{c}m": F.avg(c).over(w.rowsBetween(1 - window, 0)) for c in XY})
    rows = rows.withColumns({"_xs": F.lag("_xm").over(w), "_ys": F.lead("_ym").over(w)})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    dist = squared_distance(zero("_xm"), zero("_ym"), zero("_xs"), zero("_ys"))
    return core(rows.withColumn("distance", dist), keep_chunk=True).drop("_xm", "_ym", "_xs", "_ys")


def fill_ball(
    ball: DataFrame,
    window: int = MA_WINDOW,
    q: float = 0.95,
    mode: str = "compat",
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """Mask jumps by the quantile rule, then interpolate to int pixels.

    In 'compat' mode missing points become (0, 0) before masking and are only filled when
    their distance reaches the threshold. In 'strict' mode they stay missing and are filled.
    """
    if mode not in ("compat", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = step_distance(ball.select(*keys, order, *XY), window, keys, order, size)
    if mode == "compat":
        rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in XY})
    masked = mask_outliers(rows, q, keys=keys, order=order, size=size).drop("threshold", "distance")
    return interpolate_positions(masked, keys=keys, order=order, size=size).drop("_chunk")


def mask_and_fill(
    ball: DataFrame,
    q: float = 0.90,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """The raw-step form: squared step between raw points, missing ones and the start as 0."""
    rows = chunks.chunked(ball.select(*keys, order, *XY), keys, order, before=1, size=size)
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in XY})
    w = asc(keys, order)
    shifted = [F.lag(c, 1, 0.0).over(w) for c in XY]
    rows = core(rows.withColumns({"_xs": shifted[0], "_ys": shifted[1]}), keep_chunk=True)
    rows = rows.withColumn("distance", squared_distance(F.col("_xs"), F.col("_ys"), F.col("x"), F.col("y")))
    masked = mask_outliers(rows.drop("_xs", "_ys"), q, keys=keys, order=order, size=size).drop("threshold", "distance")
    return _fill(masked, XY, keys, order, size).drop("_chunk")
