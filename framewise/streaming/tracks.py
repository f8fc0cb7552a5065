"""Track rules on streams, in event time, with the state of each track kept between batches.

A frame's time follows from its number and the frame rate. Rows may arrive out of order: they wait until the
watermark, which is `delay` frames behind the newest row, has passed them, and are then taken in frame order. A row
that comes when the watermark has passed its frame is late; Spark leaves it out and counts it in the progress of the
query (see `late_rows`). Rows of the same frame are all taken, by x, then y, missing ones last. A track that gets no row for `idle` frames has ended,
and its state is removed; what comes after starts a new one.

What is held for a track is one point, a number, and the rows that wait: as many as `delay` frames have.
"""

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from framewise import schema

FPS = 24
DELAY, IDLE = 240, 24 * 3600
GATED = schema.BALL
SEGMENTED = T.StructType([*schema.BALL.fields, T.StructField("segment", T.LongType())])
_WAITING = T.StructType([T.StructField("frame", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_STATE = T.StructType([T.StructField("newest", T.LongType()), *_WAITING.fields, T.StructField("segment", T.LongType())])
_OUT = 10_000


def _millis(frame: int) -> int:
    """Frame 0 comes one frame after the epoch, as a watermark starts there and has passed it."""
    return math.ceil((frame + 1) * 1000 / FPS)


class _TrackProcessor(StatefulProcessor):
    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("track", _STATE)
        self.waiting = handle.getListState("waiting", _WAITING)

    def step(self, frame: int, point: tuple | None, last: tuple | None, segment: int) -> tuple:
        """Output row (or None), last point (frame, x, y) and segment after this row."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for batch in rows:
            points = zip(*(batch[c].tolist() for c in ("frame", "x", "y")))
            new += [(int(f), *(None if math.isnan(v) else v for v in p)) for f, *p in points]
        passed, first = timerValues.getCurrentWatermarkInMs(), _millis(min(f for f, *_ in new))
        timers = self._timers()
        if min(first, *timers) > passed if timers else first > passed:
            # Nothing is due, so what waits already need not be read and written again.
            self.waiting.appendList(new)
            if not timers or first < min(timers):
                self._wake(timers, first)
        else:
            yield from self._go_on(key, timerValues, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go_on(key, timerValues)

    def _timers(self) -> list[int]:
        """When the track is to wake up: for its first waiting row, or at its end."""
        return [timer if isinstance(timer, int) else timer[0] for timer in self.handle.listTimers()]

    def _wake(self, timers: list[int], at: int) -> None:
        for timer in timers:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def _go_on(self, key, timerValues, new: Sequence[tuple] = ()) -> Iterator[pd.DataFrame]:
        """Take the rows that the watermark has passed; wake up for the next one, or at the end of the track."""
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted([*map(tuple, self.waiting.get()), *new], key=lambda r: (r[0], *(math.inf if v is None else v for v in r[1:])))
        newest, *last, segment = self.state.get() if self.state.exists() else (-1, None, None, None, 0)
        last = None if last[0] is None else tuple(last)
        out, later, taken = [], [], newest
        for frame, x, y in waiting:
            if _millis(frame) > passed:
                later.append((frame, x, y))
                continue
            if frame <= taken:  # came late: Spark has left such rows out and counted them
                continue
            row, last, segment = self.step(frame, None if x is None or y is None else (frame, x, y), last, segment)
            newest = frame
            if row is not None:
                out.append((key[0], *row))
        timers = self._timers()
        end = _millis(newest + IDLE)
        if not later and newest >= 0 and passed >= end:
            self.state.clear()
            self.waiting.clear()
            for timer in timers:
                self.handle.deleteTimer(timer)
        else:
            self.waiting.put(later) if later else self.waiting.clear()
            if newest >= 0:
                self.state.update((newest, *(last or (None, None, None)), segment))
            self._wake(timers, _millis(later[0][0]) if later else end)
        for k in range(0, len(out), _OUT):
            yield pd.DataFrame(out[k : k + _OUT], columns=self.columns)

    def close(self) -> None:
        pass


class GatedTrack(_TrackProcessor):
    """Keeps points within `radius` of the last kept one, others become NULL; starts with the first point."""

    columns = ["video_id", "frame", "x", "y"]

    def __init__(self, radius: float):
        self.radius = radius

    def step(self, frame, point, last, segment):
        kept = point is not None and (last is None or math.dist(point[1:], last[1:]) <= self.radius)
        return (point, point, segment) if kept else ((frame, None, None), last, segment)


class BallSegments(_TrackProcessor):
    """Numbers the segments of the detected points, from 1; see `windows.ball_segments`."""

    columns = ["video_id", "frame", "x", "y", "segment"]

    def __init__(self, max_step: float, max_gap: int):
        self.max_step, self.max_gap = max_step, max_gap

    def step(self, frame, point, last, segment):
        if point is None:
            return None, last, segment
        same = last is not None and frame - last[0] - 1 <= self.max_gap and math.dist(point[1:], last[1:]) < self.max_step
        segment += not same
        return (*point, segment), point, segment


def frame_time(frame: str = "frame") -> Column:
    """The time of a frame in its video, counted from the epoch; see `_millis`."""
    return F.timestamp_millis(F.ceil((F.col(frame) + 1) * 1000 / FPS))


def _apply(stream: DataFrame, processor: _TrackProcessor, output: T.StructType, delay: int) -> DataFrame:
    timed = stream.select("video_id", "frame", "x", "y", frame_time().alias("at"))
    timed = timed.withWatermark("at", f"{math.ceil(delay * 1000 / FPS)} milliseconds")
    return timed.groupBy("video_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="EventTime"
    )


def gated_track(stream: DataFrame, radius: float = 100.0, delay: int = DELAY) -> DataFrame:
    """Streaming form of `folds.follow_first_point`, for a stream of `ball` rows."""
    return _apply(stream, GatedTrack(radius), GATED, delay)


def ball_segments(stream: DataFrame, max_step: float = 100.0, max_gap: int = 30, delay: int = DELAY) -> DataFrame:
    """Streaming form of `windows.ball_segments`."""
    return _apply(stream, BallSegments(max_step, max_gap), SEGMENTED, delay)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and append the result to a parquet table."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def late_rows(query: StreamingQuery) -> int:
    """How many rows came too late for the watermark, in the progress that a query still has."""
    return sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in p["stateOperators"])
