"""Sequential rules along a track, run piece by piece.

Each rule keeps a small state from row to row. A long track is cut into pieces that can
be folded at the same time:

* gap extrapolation is cut where its state is known from the raw rows, or known but for one bit (`safe_starts`). A first
  pass finds what each piece makes of either value of that bit, a window over pieces tells which one it is;
* the gated track has no such places. A first pass finds the few points that each piece may
  end with, further passes what becomes of these in the pieces after, a walk along that small
  table gives the state at each border, and a last pass folds the pieces;
* hit thinning folds each piece on its own; what may still drop hits of earlier pieces is then tried on the piece
  before, and after that on blocks of 1, 2, 4 ... pieces.

Rows reach the Python worker in order and in batches; a fold never holds a whole piece.
"""

import collections
import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from framewise.operators import chunks
from framewise.operators.chunks import CHUNK, KEYS, ORDER, UNBOUNDED, asc, core
from framewise.operators.select import mean_position
from framewise.sources.tables import stored

BATCH = 10_000


def fold_groups(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    inputs: Sequence[str],
    fold: Callable[[Iterator[tuple]], Iterator[tuple]],
    outputs: dict[str, str],
) -> DataFrame:
    """Run `fold` over the rows of each group in order.

    `fold` takes an iterator of tuples (the `inputs` columns, missing values as None) and
    yields tuples (the `outputs` columns). Both sides are streamed: the rows of a partition
    come sorted by group, and a new fold begins where the group changes.
    """
    types = dict(df.dtypes)
    schema = ", ".join([f"`{g}` {types[g]}" for g in group] + [f"`{n}` {t}" for n, t in outputs.items()])
    arrow, wide = to_arrow_schema(StructType.fromDDL(schema)), len(group)
    columns = [*group, *inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b[c].to_pylist() for c in columns)))
        results = (
            key + out
            for key, own in itertools.groupby(rows, key=lambda row: row[:wide])
            for out in fold(row[wide:] for row in own)
        )
        while data := list(itertools.islice(results, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*data), arrow)], schema=arrow)

    placed = df.select(*dict.fromkeys([*group, *order, *inputs])).repartition(*group)
    return placed.sortWithinPartitions(*group, *order).mapInArrow(run, schema)


# --- short-gap extrapolation -------------------------------------------------------------

CONTEXT = 5
CHAINED = 3
MAX_JUMP = 80.0
# At most three points in a row are filled, and only a point after a filled one can be dropped: from the
# fourth row of a run of present rows on, none is. After 8 present rows, or 4 missing ones, nothing
# filled before can matter.
PRESENT_RUN, MISSING_RUN = CONTEXT + CHAINED, CHAINED + 1
# A run after a single missing row: the five rows before that, then the run.
GAP_REACH = 2 * CONTEXT + 1


def _extrapolated(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Each (frame, x, y, is_output) with a missing point filled, and whether the five before it are known."""
    known = []  # the last five rows, as filled so far
    fills, row = 0, next(rows, None)
    while row is not None:
        frame, x, y, is_output = row
        after = next(rows, None)
        can_fill = len(known) == CONTEXT and all(p[0] is not None for p in known)
        if not x and after is not None and can_fill and fills < CHAINED:
            x, y = (2 * known[-1][i] - known[-2][i] for i in (0, 1))
            if after[1] and math.dist((x, y), after[1:3]) > MAX_JUMP:
                after = (after[0], None, None, after[3])
            fills += 1
        else:
            fills = 0
        known = [*known[1 - CONTEXT :], (x, y)]
        yield frame, x, y, is_output, can_fill
        row = after


def extrapolate_gaps(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Fold over (frame, x, y, is_output): fill a missing point from the five before it.

    The value one step past five points on a natural cubic spline is 2 * last - one before.
    A point that follows a filled one and lies too far from it is dropped. At most three
    points in a row are filled. x = 0 is filled like a missing x, but counts as present
    among the five. The last row is never filled.
    """
    return ((frame, x, y) for frame, x, y, is_output, _ in _extrapolated(rows) if is_output)


def known_at_end(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Fold over (frame, x, y, is_output): whether the five points before the last row are known."""
    *_, can_fill = collections.deque(_extrapolated(rows), maxlen=1).pop()
    yield (can_fill,)


def safe_starts(ball: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER, size: int = CHUNK) -> DataFrame:
    """Add `safe`: the fold may start at this row with the five raw rows before it.

    True after a long run of present or of missing rows; and after five present rows that follow a single missing
    row, if the run before that ended in five present rows and the first row of the new run lies within reach of
    the point they lead to: then it stays whether the gap was filled or not, and so do the rows after it.

    `half`: a missing row after five present ones. It is filled from the last two of these, which nothing filled before
    can have changed, or it isn't, since one of the other three was dropped. If it is, all five are known; if it isn't,
    it is itself missing among the next five. So only that one bit is unknown here.
    """

    def columns(w):
        present = F.col("x").isNotNull() & (F.col("x") != 0)
        seen, missing = F.when(present, 1).otherwise(0), F.when(F.col("x").isNull(), 1).otherwise(0)
        run = lambda far, near: F.sum(seen).over(w.rowsBetween(-far, -near)) == far - near + 1
        long_present = run(PRESENT_RUN, 1)
        long_missing = F.sum(missing).over(w.rowsBetween(-MISSING_RUN, -1)) == MISSING_RUN
        at = lambda c, back: F.lag(c, back).over(w)
        first, gap = CONTEXT, CONTEXT + 1
        jump2 = sum((2 * at(c, gap + 1) - at(c, gap + 2) - at(c, first)) ** 2 for c in ("x", "y"))
        after_gap = run(CONTEXT, 1) & (at(missing, gap) == 1) & run(GAP_REACH, gap + 1) & (F.sqrt(jump2) <= MAX_JUMP)
        far_enough = F.col(order) >= CONTEXT
        sure = lambda c: F.coalesce(c & far_enough, F.lit(False))
        return {"safe": sure(long_present | long_missing | after_gap), "half": sure(run(CONTEXT, 1) & F.col("x").isNull())}

    rows = chunks.chunked(ball, keys, order, before=GAP_REACH, size=size)
    return core(rows.withColumns(columns(asc(keys, order))), keep_chunk=True)


def _parts(rows: DataFrame, starts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The rows of each part `_part`, with the five before it and the one after it; `_out` marks its own.

    `_oldest` marks the first of the five, `_known` (from `starts`) tells for a half start whether its five points are known.
    """
    rows = rows.join(starts, [*keys, "_chunk"])
    at, start, next_start = F.col(order), F.col("_start"), F.col("_next_start")
    before = F.coalesce("_before", F.lit(-1).cast("long"))
    home = F.when(at >= start, F.col("_chunk")).otherwise(before)
    copy = lambda part, oldest, known: F.struct(part.alias("part"), oldest.alias("oldest"), known.alias("known"))
    own = lambda part: copy(part, F.lit(False), F.lit(True))
    places = F.array_compact(
        F.array(
            own(home),
            F.when((at >= start - CONTEXT) & (at < start), copy(F.col("_chunk"), at == start - CONTEXT, F.col("_known"))),
            F.when(
                (at >= next_start - CONTEXT) & (at < next_start), copy(F.col("_next"), at == next_start - CONTEXT, F.col("_next_known"))
            ),
            F.when(at == start, own(before)),
        )
    )
    rows = rows.withColumn("_home", home).withColumn("_place", F.explode(places))
    return rows.select(
        *keys, order, "x", "y", F.col("_place.part").alias("_part"), (F.col("_home") == F.col("_place.part")).alias("_out"),
        F.col("_place.oldest").alias("_oldest"), F.coalesce("_place.known", F.lit(True)).alias("_known"),
    )


def _blanked(rows: DataFrame, known: Column) -> DataFrame:
    """Where a half start's points aren't known, the oldest of the five is missing: that is all that the fold needs to see."""
    return rows.withColumns({c: F.when(known | ~F.col("_oldest"), F.col(c)) for c in ("x", "y")})


def _known_starts(rows: DataFrame, starts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, `_chunk`, `_known`): whether the five points before each half start are known.

    The part before it is folded, for both cases where it begins with a half start itself. A part then gives always the same,
    hands its bit on, or turns it; so a bit is what the last constant part gave, turned as often as parts since then turn it.
    """
    part = [*keys, "_part"]
    begun = starts.filter("_half").select(*keys, "_chunk", F.coalesce("_before", F.lit(-1).cast("long")).alias("_part"))
    halves = starts.filter("_half").select(*keys, F.col("_chunk").alias("_part"), F.lit(True).alias("_twice"))
    asked = begun.select(*part).join(halves, part, "left")
    cases = F.when(F.col("_twice"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))
    asked = asked.select(*part, F.explode(cases).alias("_case"))
    both = _blanked(_parts(rows, starts, keys, order).join(asked, part), F.col("_case"))
    ends = fold_groups(both, [*part, "_case"], [order], [order, "x", "y", "_out"], known_at_end, {"end": "boolean"})
    ends = ends.groupBy(*part).agg(*[F.max(F.when(F.col("_case") == F.lit(c), F.col("end"))).alias(n) for c, n in ((True, "on"), (False, "off"))])
    along = Window.partitionBy(*keys).orderBy("_part").rowsBetween(UNBOUNDED, 0)
    constant = F.col("off").isNull() | (F.col("on") == F.col("off"))
    ends = ends.withColumn("_turns", F.sum(F.when(~constant & F.col("off"), 1).otherwise(0)).over(along))
    last = F.last(F.when(constant, F.struct("on", "_turns")), True).over(along)
    ends = ends.withColumn("_last", last)
    turned = (F.col("_turns") - F.col("_last._turns")) % 2 == 1
    return begun.join(ends.select(*part, (F.col("_last.on") != turned).alias("_known")), part).select(*keys, "_chunk", "_known")


def smooth_gaps(ball: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER, size: int = CHUNK) -> DataFrame:
    """Extrapolate short gaps of a track.

    Each piece is folded from its first safe row, or, without one, from its first half-safe row, to that of the next piece that
    has one. Only where neither occurs in a whole piece (never five present rows before a gap, nor four missing ones) is it
    folded with the piece before. A point without one of its coordinates is a missing point.
    """
    whole = F.col("x").isNotNull() & F.col("y").isNotNull()
    points = ball.select(*keys, order, *[F.when(whole, F.col(c)).alias(c) for c in ("x", "y")])
    rows = safe_starts(points, keys, order, size)
    along = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = along.rowsBetween(UNBOUNDED, -1)
    first = [F.min(F.when(F.col(c), F.col(order))).alias(f"_{c}") for c in ("safe", "half")]
    starts = rows.groupBy(*keys, "_chunk").agg(*first).withColumn("_start", F.coalesce("_safe", "_half"))
    starts = starts.select(
        *keys, "_chunk", "_start", (F.col("_safe").isNull() & F.col("_half").isNotNull()).alias("_half"),
        F.last(F.when(F.col("_start").isNotNull(), F.col("_chunk")), True).over(earlier).alias("_before"),
        F.lead("_start").over(along).alias("_next_start"),
        F.lead("_chunk").over(along).alias("_next"),
    )
    starts = stored(starts, "starts")
    unknown = {c: F.lit(None).cast("boolean") for c in ("_known", "_next_known")}
    if starts.filter("_half").isEmpty():
        starts = starts.withColumns(unknown)
    else:
        known = _known_starts(rows, starts.withColumns(unknown), keys, order)
        starts = starts.join(known, [*keys, "_chunk"], "left").withColumn("_next_known", F.lead("_known").over(along))
    filled = fold_groups(
        _blanked(_parts(rows, starts, keys, order), F.col("_known")), [*keys, "_part"], [order], [order, "x", "y", "_out"],
        extrapolate_gaps, {order: "long", "x": "double", "y": "double"},
    )
    return filled.drop("_part")


# --- gated track -------------------------------------------------------------------------


def near(p: tuple, q: tuple, radius: float, inclusive: bool) -> bool:
    d = math.dist(p, q)
    return d <= radius if inclusive else d < radius


def gate(radius: float, inclusive: bool) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    """Fold over (frame, x, y): keep a point near the last kept one, else NULL.

    A first row without a frame brings the state to start with; without one the first point is kept.
    """

    def fold(rows):
        last = None
        for frame, x, y in rows:
            if frame is None:
                last = _point(x, y)
                continue
            p = _point(x, y)
            kept = p is not None and (last is None or near(p, last, radius, inclusive))
            if kept:
                last = p
            yield (frame, x, y) if kept else (frame, None, None)

    return fold


def _point(x: float | None, y: float | None) -> tuple | None:
    return None if x is None or y is None else (x, y)


def _catch(states: np.ndarray, x: float, y: float, radius: float, inclusive: bool) -> np.ndarray:
    """Which states (rows x, y) a point catches; a state without a place is caught by any point."""
    d = np.array([math.dist(s, (x, y)) for s in states.tolist()])
    return np.isnan(d) | (d <= radius if inclusive else d < radius)


def live_ends(radius: float, inclusive: bool) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    """Fold over (x, y): all points that the piece may end with, whatever it is entered with.

    Any point may be the first to catch a state. Paths that catch the same point become one, so
    the ends are at least a radius apart: their number is bounded by the place that the points
    take, not by how many they are.
    """

    def fold(rows):
        ends = np.zeros((0, 2))
        for x, y in rows:
            if x is None or y is None:
                continue
            if len(ends):
                ends = ends[~_catch(ends, x, y, radius, inclusive)]
            ends = np.concatenate([ends, [[x, y]]])
        yield from map(tuple, ends.tolist())

    return fold


def exits(radius: float, inclusive: bool) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    """Fold over (frame, born, x, y): where the piece takes each state that it is entered with.

    States come first, without a frame. Yields (born, x, y, exit_x, exit_y) for those that a point catches.
    """

    def fold(rows):
        entered, at = [], None
        caught = None
        for frame, born, x, y in rows:
            if frame is None:
                entered.append((born, x, y))
                continue
            if not entered:
                return
            if at is None:
                at = np.array([[math.nan if v is None else v for v in e[1:]] for e in entered])
                caught = np.zeros(len(entered), dtype=bool)
            if x is None or y is None:
                continue
            now = _catch(at, x, y, radius, inclusive)
            at[now] = x, y
            caught |= now
        for k, state in enumerate(entered):
            if caught is not None and caught[k]:
                yield *state, *at[k].tolist()

    return fold


def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Fold over (born, x, y, caught_in, exit_x, exit_y, last), by piece: the state each piece is entered with.

    The walk begins with the start, which is born before the first piece, and goes on from exit to exit.
    """
    here = None
    for born, x, y, caught_in, exit_x, exit_y, last in rows:
        if born == -1 or here == (born, x, y):
            for piece in range(born + 1, (last if caught_in is None else caught_in) + 1):
                yield piece, x, y
            here = None if caught_in is None else (caught_in, exit_x, exit_y)


def border_states(rows: DataFrame, start: DataFrame | None, radius: float, inclusive: bool, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, `_chunk`, x, y): the state each piece is entered with, from its rows (keys, order, `_chunk`, x, y).

    Only the start and the ends of earlier pieces can be such a state. Each is sent to the next piece, then, if that
    leaves it as it is, to the next two, four and so on, until one catches it. Tracks of one piece need none of this.
    """
    piece, place = [*keys, "_chunk"], {"x": "double", "y": "double"}
    pieces = rows.groupBy(*keys).agg(F.max("_chunk").alias("last"))
    if start is None:
        begun = pieces.select(*keys, *[F.lit(None).cast("double").alias(c) for c in "xy"])
    else:
        begun = start.select(*keys, F.col("start_x").alias("x"), F.col("start_y").alias("y"))
    long = pieces.filter("last > 0")
    if long.isEmpty():
        return begun.select(*keys, F.lit(0).cast("long").alias("_chunk"), "x", "y")
    long = stored(long, "pieces")
    cut = rows.join(long.select(*keys), list(keys), "left_semi")
    ends = fold_groups(cut, piece, [order], ["x", "y"], live_ends(radius, inclusive), place)
    born = begun.select(*keys, F.lit(-1).cast("long").alias("born"), "x", "y").unionByName(ends.withColumnRenamed("_chunk", "born"))
    open_ = stored(born.join(long, list(keys)), "open")
    short = begun.join(long, list(keys), "left_anti").select(*keys, F.lit(0).cast("long").alias("_chunk"), "x", "y")
    state = [*keys, "born", "x", "y"]
    done, reach, seen = None, 1, 0
    while not (waiting := open_.filter(F.col("born") + 1 + seen <= F.col("last"))).isEmpty():
        sent = F.sequence(F.col("born") + 1 + seen, F.least(F.col("born") + seen + reach, F.col("last")))
        sent = waiting.select(*state, F.explode(sent).alias("_chunk"))
        asked = cut.join(sent.select(*piece).distinct(), piece, "left_semi")
        found = fold_groups(
            asked.unionByName(sent, allowMissingColumns=True), piece, [order, "born", "x", "y"], [order, "born", "x", "y"],
            exits(radius, inclusive), {"born": "long"} | place | {"exit_x": "double", "exit_y": "double"},
        )
        first = F.min(F.struct("_chunk", "exit_x", "exit_y")).alias("m")
        caught = stored(found.groupBy(*state).agg(first), "caught")
        same = [open_[k].eqNullSafe(caught[k]) for k in state]
        open_ = stored(open_.join(caught, same, "left_anti"), "open")
        done = caught if done is None else done.unionByName(caught)
        seen, reach = seen + reach, 2 * reach
    ended = done.join(long, list(keys)).select(*state, "last", F.col("m._chunk").alias("caught_in"), "m.exit_x", "m.exit_y")
    links = open_.unionByName(ended, allowMissingColumns=True)
    walked = fold_groups(
        links, list(keys), ["born", "x", "y"], ["born", "x", "y", "caught_in", "exit_x", "exit_y", "last"], walk, {"_chunk": "long"} | place
    )
    return walked.unionByName(short)


def gated_track(
    ball: DataFrame,
    radius: float,
    inclusive: bool = False,
    start: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """Keep points near the last kept point; all others become NULL.

    `start` gives the first state per track (`start_x`, `start_y`); without it, or where it is NULL, the first
    point of the track is kept. A state travels as a row without a frame, which comes first in its piece.
    """
    rows = chunks.with_chunk(ball.select(*keys, order, "x", "y"), order, size)
    states = border_states(rows, start, radius, inclusive, keys, order)
    gated = fold_groups(
        rows.unionByName(states, allowMissingColumns=True), [*keys, "_chunk"], [order], [order, "x", "y"],
        gate(radius, inclusive), {order: "long", "x": "double", "y": "double"},
    )
    return gated.drop("_chunk")


def choose_main_ball(
    ball: DataFrame, radius: float = 80.0, keys: Sequence[str] = KEYS, order: str = ORDER, size: int = CHUNK
) -> DataFrame:
    """Gated track that starts from the mean position; frame 0 is always NULL."""
    means = mean_position(ball, keys).select(*keys, F.col("mean_x").alias("start_x"), F.col("mean_y").alias("start_y"))
    later = {c: F.when(F.col(order) > 0, F.col(c)) for c in ("x", "y")}
    return gated_track(ball.withColumns(later), radius, False, means, keys, order, size)


def follow_first_point(
    ball: DataFrame, radius: float = 100.0, keys: Sequence[str] = KEYS, order: str = ORDER, size: int = CHUNK
) -> DataFrame:
    """Gated track that starts from the first point; missing points stay NULL and change nothing."""
    return gated_track(ball, radius, True, None, keys, order, size)


# --- hit thinning ------------------------------------------------------------------------

TOO_CLOSE = 200.0


def thin_piece(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Fold over (frame, side, x, y, checks) of one piece.

    After each hit the last two are compared once per frame, `checks` times; the earlier
    one is dropped when they are close. Yields the hits left over with their places among them, and the
    checks that a hit with none before it in the piece still has for earlier pieces.
    """
    stack = []
    for frame, side, x, y, checks in rows:
        stack.append((frame, side, x, y))
        while checks > 0 and len(stack) > 1 and math.dist((x, y), stack[-2][2:]) < TOO_CLOSE:
            del stack[-2]
            checks -= 1
        if checks > 0 and len(stack) == 1:
            yield None, frame, side, x, y, checks
    for i, hit in enumerate(stack):
        yield i, *hit, None


def thin_block(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Fold over (sender, piece, i, frame, side, x, y, checks): hits of a block's pieces, then the open checks of later pieces.

    Yields the checks that are left when all these hits are dropped, and how many hits each piece keeps.
    """
    stack, left = [], {}
    for sender, piece, i, frame, side, x, y, checks in rows:
        if sender is None:
            stack.append((piece, x, y))
            left[piece] = i + 1
            continue
        while checks > 0 and stack and math.dist((x, y), stack[-1][1:]) < TOO_CLOSE:
            left[stack.pop()[0]] -= 1
            checks -= 1
        if checks > 0 and not stack:
            yield sender, None, None, frame, side, x, y, checks
    for piece, n in left.items():
        yield None, piece, n, None, None, None, None, None


def thin_hits(
    hits: DataFrame, frames: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER, size: int = CHUNK, bound: int = CHUNK
) -> DataFrame:
    """Drop a hit when the one after it is near, comparing the last two hits once per frame.

    Hits are dropped from the end of a piece only, so what later pieces leave of it is a number. Open checks first try the
    piece before, which ends nearly all; then, in rounds over blocks of 1, 2, 4 ... pieces, the block before their own. A round
    takes the last `bound` hits of a block and the first `bound` checks, rounded up to whole pieces; another one follows at the
    same width where that is not all. Each round writes the checks still open, and a number per piece that it asked.
    """
    rows = chunks.with_chunk(hits.select(*keys, order, "side", "x", "y"), order, size)
    w = Window.partitionBy(*keys, "_chunk").orderBy(order, "side")
    firsts = rows.groupBy(*keys, "_chunk").agg(F.min(order).alias("_first"))
    along = Window.partitionBy(*keys).orderBy("_chunk")
    n_frames = frames.groupBy(*keys).agg((F.max(order) + 1).alias("_n"))
    number = (F.row_number().over(along) - 1).cast("long")
    ends = firsts.withColumns({"_after": F.lead("_first").over(along), "_piece": number}).join(n_frames, list(keys))
    ends = ends.select(*keys, "_chunk", "_piece", F.coalesce("_after", "_n").alias("_end"))
    rows = rows.withColumn("_next", F.lead(order).over(w)).join(ends, [*keys, "_chunk"])
    rows = rows.withColumn("_checks", F.coalesce("_next", "_end") - F.col(order))
    hit = {order: "long", "side": "int", "x": "double", "y": "double"}
    piece, sender = [*keys, "_piece"], [*keys, "_sender"]
    thinned = fold_groups(
        rows, piece, [order, "side"], [order, "side", "x", "y", "_checks"], thin_piece, {"_i": "long"} | hit | {"_checks": "long"}
    )
    thinned = stored(thinned, "thinned")
    left = thinned.filter("_i IS NOT NULL").drop("_checks")
    checks = thinned.filter("_i IS NULL").select(*keys, F.col("_piece").alias("_sender"), *hit, "_checks")
    counts = left.groupBy(*piece).agg((F.max("_i") + 1).alias("_n"))
    begun = False
    while (asking := _nearest(checks, counts, keys, 0 if not begun else None)) is not None:
        width, senders = asking
        block = [*keys, "_block"]
        in_order = Window.partitionBy(*block).orderBy("_sender").rowsBetween(UNBOUNDED, -1)
        senders = senders.withColumn("_block", F.shiftright("_sender", width) - 1)
        senders = senders.withColumn("_sent", F.coalesce(F.sum("_n_checks").over(in_order), F.lit(0))).filter(F.col("_sent") < bound)
        senders = stored(senders.select(*sender, "_block"), "senders")
        backwards = Window.partitionBy(*block).orderBy(F.desc("_piece")).rowsBetween(UNBOUNDED, -1)
        pieces = counts.filter("_n > 0").withColumn("_block", F.shiftright("_piece", width))
        pieces = pieces.join(senders.select(*block).distinct(), block, "left_semi")
        pieces = pieces.withColumn("_later", F.coalesce(F.sum("_n").over(backwards), F.lit(0))).filter(F.col("_later") < bound)
        asked = left.join(pieces.select(*piece, "_n", "_block"), piece).filter("_i < _n").drop("_n")
        both = asked.unionByName(checks.join(senders, sender), allowMissingColumns=True)
        folded = fold_groups(
            both, block, ["_sender", "_piece", "_i", order, "side"], ["_sender", "_piece", "_i", order, "side", "x", "y", "_checks"],
            thin_block, {"_sender": "long", "_piece": "long", "_n": "long"} | hit | {"_checks": "long"},
        )
        folded = stored(folded, "folded")
        still = folded.filter("_sender IS NOT NULL").select(*checks.columns)
        checks = stored(checks.join(senders, sender, "left_anti").unionByName(still), "checks")
        fewer = folded.filter("_piece IS NOT NULL").select(*piece, "_n")
        counts = counts.unionByName(fewer).groupBy(*piece).agg(F.min("_n").alias("_n"))
        begun = True
    return left.join(counts, piece).filter("_i < _n").select(*keys, *hit)


def _nearest(checks: DataFrame, counts: DataFrame, keys: Sequence[str], width: int | None) -> tuple[int, DataFrame] | None:
    """The pieces whose open checks may ask now, with the number of these, and the width (as power of two) of the blocks.

    A piece may ask when the nearest piece before it that has hits left lies in the block next to its own, for the least width for
    which there are such pieces; with a width given, all may. None when no check has a hit before it.
    """
    along = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(UNBOUNDED, -1)
    before = F.last(F.when(F.col("_n") > 0, F.col("_piece")), True).over(along)
    places = counts.select(*keys, F.col("_piece").alias("_sender"), before.alias("_target")).filter("_target IS NOT NULL")
    senders = checks.groupBy(*keys, "_sender").agg(F.count(F.lit(1)).alias("_n_checks")).join(places, [*keys, "_sender"])
    apart = F.floor(F.log2(F.col("_sender").bitwiseXOR(F.col("_target")).cast("double"))).cast("int")
    senders = senders.withColumn("_width", apart)
    least = senders.agg(F.min("_width")).first()[0]
    if least is None:
        return None
    if width is not None:
        return width, senders
    return least, senders.filter(F.col("_width") == least)
