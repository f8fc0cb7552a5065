import random

import pytest

from framewise import schema
from framewise.operators import folds, windows
from framewise.sources.tables import work_folder
from framewise.streaming import tracks


@pytest.fixture()
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def feed(spark, operator, batches):
    """Run the batches one after the other, and at last a row from far ahead, which lets all others pass."""
    folder, late = work_folder(spark, "stream"), 0
    end = spark.createDataFrame([(-1, 10**7, None, None)], schema.BALL)
    for batch in [*batches, end]:
        batch.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema.BALL).parquet(f"{folder}/in")
        late += tracks.late_rows(tracks.run_to_table(operator(stream), f"{folder}/out", f"{folder}/checkpoint"))
    rows = spark.read.parquet(f"{folder}/out").filter("video_id >= 0").collect()
    return sorted(tuple(r) for r in rows), late


POINTS = [(0, 0), (10, 0), (None, None), (500, 0), (60, 0), (150, 0), (400, 0)]


def test_rows_out_of_order_within_the_watermark_change_nothing(spark, track, state_store):
    rnd = random.Random(2)
    ball = track(POINTS, [(rnd.randint(0, 200), rnd.random()) for _ in range(60)])
    rows = ball.collect()
    rnd.shuffle(rows)
    batches = [spark.createDataFrame(rows[k::3], schema.BALL) for k in range(3)]
    got, late = feed(spark, lambda s: tracks.gated_track(s, delay=100), batches)
    whole = folds.follow_first_point(ball).select("video_id", "frame", "x", "y").collect()
    assert (got, late) == (sorted(tuple(r) for r in whole), 0)


def test_late_rows_are_counted(spark, track, state_store):
    ball = track(POINTS)
    got, late = feed(spark, lambda s: tracks.ball_segments(s, delay=2), [ball.filter("frame <> 1"), ball.filter("frame = 1")])
    on_time = windows.ball_segments(ball.filter("frame <> 1")).select("video_id", "frame", "x", "y", "segment")
    assert (got, late) == (sorted(tuple(r) for r in on_time.collect()), 1)


def test_the_state_of_an_ended_track_is_removed(spark, track, state_store):
    first, again = track(POINTS[:2]), track([(5, 5), (6, 6)]).selectExpr("video_id", "frame + 20000000 AS frame", "x", "y")
    got, _ = feed(spark, tracks.ball_segments, [first, spark.createDataFrame([(-1, 10**7, None, None)], schema.BALL), again,
                                                spark.createDataFrame([(-1, 3 * 10**7, None, None)], schema.BALL)])
    assert [r[4] for r in got] == [1, 1, 1, 1]


class _Held:
    """One state of a processor, with the number of times it was read."""

    def __init__(self):
        self.value, self.reads = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        self.reads += 1
        return iter(self.value or []) if not isinstance(self.value, tuple) else self.value

    def appendList(self, rows):
        self.value = (self.value or []) + rows

    def put(self, rows):
        self.value = rows

    update = put

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, schema):
        return self.states.setdefault(name, _Held())

    getListState = getValueState

    def listTimers(self):
        return iter([(t,) for t in sorted(self.timers)])

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class _Clock:
    def __init__(self, passed):
        self.passed = passed

    def getCurrentWatermarkInMs(self):
        return self.passed


def test_rows_that_wait_are_not_read_until_one_is_due():
    import pandas as pd

    from framewise.streaming import tracks

    handle = _Handle()
    processor = tracks.BallSegments(100.0, 30)
    processor.init(handle)
    waiting = handle.states["waiting"]
    for frames in ([8, 9], [4, 6], [5]):
        batch = pd.DataFrame({"frame": frames, "x": 1.0, "y": 1.0})
        assert list(processor.handleInputRows((0,), iter([batch]), _Clock(0))) == []
    assert waiting.reads == 0 and handle.timers == {tracks._millis(4)}
    got = list(processor.handleExpiredTimer((0,), _Clock(tracks._millis(6)), None))
    assert [f for b in got for f in b["frame"]] == [4, 5, 6]
    assert handle.timers == {tracks._millis(8)}
    late = pd.DataFrame({"frame": [7], "x": 1.0, "y": 1.0})
    got = list(processor.handleInputRows((0,), iter([late]), _Clock(tracks._millis(9))))
    assert [f for b in got for f in b["frame"]] == [7, 8, 9]
    assert handle.timers == {tracks._millis(9 + tracks.IDLE)} and not waiting.exists()
