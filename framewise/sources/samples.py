"""Detection tables derived from the `events` table (recipes in FIXTURES.md).

Coordinates are whole numbers and eighths stored as doubles, so sums are exact. The frame
number counts the events of a video in time order. Events are counted per six hours first, so no
task sorts a whole video: what one camera sees in that time is bounded by its frame rate.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.operators.chunks import positions
from framewise.sources.tables import stored

# Boxes (det_idx, track, class, x1, y1, x2, y2) and court points (index, x, y).
BOXES = (
    (0, 1, "person", 560, 120, 620, 230),
    (1, 2, "person", 660, 520, 760, 700),
    (2, 3, "person", 20, 300, 70, 420),
    (3, 4, "person", 1200, 260, 1250, 380),
    (4, 5, "racket", 700, 540, 730, 600),
)
COURT_POINTS = (
    (0, 400, 200), (1, 880, 200), (2, 160, 660), (3, 1120, 660), (4, 460, 200), (5, 280, 660), (6, 820, 200),
    (7, 1000, 660), (8, 430, 290), (9, 850, 290), (10, 330, 480), (11, 950, 480), (12, 640, 290), (13, 640, 480),
)
FRAME_W, FRAME_H = 1280, 720
HEIGHTS = {1: 1.88, 2: 1.91}
BUCKET = 6 * 3600  # seconds


def _literal_rows(names: tuple[str, ...], rows: tuple) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])


def _double(c: Column, name: str) -> Column:
    return c.cast("double").alias(name)


class Samples:
    """The sample tables of one data folder. `one_video` puts all rows into a single track."""

    def __init__(self, spark: SparkSession, sf_dir: str, one_video: bool = False):
        self.spark, self.sf_dir, self.one_video = spark, sf_dir, one_video

    @cached_property
    def ball(self) -> DataFrame:
        """Numbered once and stored: a query reads it for each of its sample tables, and at times once a round."""
        events = self.spark.read.parquet(f"{self.sf_dir}/events.parquet")
        video = F.lit(0) if self.one_video else F.floor(F.col("user_id") / 15)
        e = events.select(
            video.cast("long").alias("video_id"),
            "ts",
            "event_id",
            "event_type",
            F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        )
        e = positions(e, ["ts", "event_id"], F.floor(F.unix_timestamp("ts") / BUCKET), name="frame")
        f, k = F.col("frame"), F.col("k")
        seen = F.col("event_type") != "error"
        spike = F.when((F.col("event_type") == "signup") & (k < 25), 600).otherwise(0)
        ball = e.select(
            "video_id",
            "frame",
            _double(F.when(seen, 300 + 5 * F.abs(f % 200 - 100) + k % 5 + spike + (k % 4) / 4), "x"),
            _double(F.when(seen, 200 + 8 * F.abs(f % 120 - 60) + k % 3 + (k % 8) / 8), "y"),
            "k",
        )
        return stored(ball, "ball")

    @cached_property
    def track(self) -> DataFrame:
        return self.ball.select("video_id", "frame", "x", "y")

    @cached_property
    def frames(self) -> DataFrame:
        return self.ball.select("video_id", "frame")

    @cached_property
    def players(self) -> DataFrame:
        names = ("det_idx", "track", "cls", "x1", "y1", "x2", "y2")
        b = self.ball.select("video_id", "frame", "k", F.explode(_literal_rows(names, BOXES)).alias("p"))
        shift = F.abs(F.col("frame") % 80 - 40) * 2
        lost = (F.col("frame") % 97 == 96) & (F.col("p.det_idx") == 1)
        k = F.col("k")
        return b.filter(~((k % 13 == 0) & (F.col("p.det_idx") == 2))).select(
            "video_id",
            "frame",
            F.col("p.det_idx").alias("det_idx"),
            F.when(~lost, F.col("p.track")).alias("track_id"),
            F.col("p.cls").alias("cls"),
            _double(F.col("p.x1") + k % 7 + shift, "x1"),
            _double(F.col("p.y1") + k % 3, "y1"),
            _double(F.col("p.x2") + k % 7 + shift, "x2"),
            _double(F.col("p.y2") + k % 5, "y2"),
        )

    @cached_property
    def kps(self) -> DataFrame:
        b = self.frames.select("video_id", "frame", F.explode(_literal_rows(("kp_idx", "kx", "ky"), COURT_POINTS)).alias("p"))
        moved = F.col("video_id") % 5 + 6 * (F.floor(F.col("frame") / 100) % 3)
        return b.select(
            "video_id",
            "frame",
            F.col("p.kp_idx").alias("kp_idx"),
            _double(F.col("p.kx") + moved, "x"),
            _double(F.col("p.ky"), "y"),
        )

    @cached_property
    def kps_seen(self) -> DataFrame:
        """Court points as a detector finds them: some are lost in some frames."""
        f, i = F.col("frame"), F.col("kp_idx")
        return self.kps.filter(~((f % 10 == 3) & (i > 2)) & ~((f % 7 == 5) & (i % 2 == 0)))

    @cached_property
    def flat(self) -> DataFrame:
        """Court points that are exact images of their map places: seen without perspective, some lost, camera moving."""
        from framewise.operators.geometry import with_map_positions

        at = with_map_positions(self.kps_seen)
        moved = F.col("video_id") % 5 + 6 * (F.floor(F.col("frame") / 100) % 3)
        return at.select("video_id", "frame", "kp_idx", (F.col("map_x") * 0.875 + moved).alias("x"), (F.col("map_y") * 0.375 + 20).alias("y"))

    @cached_property
    def court_raw(self) -> DataFrame:
        """The 28 numbers a keypoint model gives, in its 224 by 224 space."""
        moved = F.col("video_id") % 5 + 6 * (F.floor(F.col("frame") / 100) % 3)
        pred = [
            c
            for _, x, y in COURT_POINTS
            for c in ((F.lit(x) + moved) * 224.0 / FRAME_W, F.lit(float(y)) * 224.0 / FRAME_H)
        ]
        return self.frames.select("video_id", "frame", F.array(*pred).alias("pred"))

    @cached_property
    def frame_size(self) -> DataFrame:
        return self.frames.select("video_id").distinct().select(
            "video_id", F.lit(FRAME_W).alias("w"), F.lit(FRAME_H).alias("h")
        )

    @cached_property
    def hands(self) -> DataFrame:
        """Body points of the two main players: hand beside the centre, nose at the top, body at the foot."""
        boxes = _literal_rows(("det_idx", "track", "cls", "x1", "y1", "x2", "y2"), BOXES[:2])
        b = self.ball.select("video_id", "frame", "k", F.explode(boxes).alias("p"))
        k = F.col("k")
        centre_x = (F.col("p.x1") + F.col("p.x2")) / 2 + k % 7 + F.abs(F.col("frame") % 80 - 40) * 2
        top, foot = F.col("p.y1") + k % 3, F.col("p.y2") + k % 5
        return b.select(
            "video_id",
            "frame",
            F.col("p.det_idx").alias("side"),
            _double(centre_x + 30, "hx"),
            _double((top + foot) / 2, "hy"),
            _double(centre_x, "nose_x"),
            _double(top, "nose_y"),
            _double(centre_x, "body_x"),
            _double(foot, "body_y"),
        )

    @cached_property
    def segments(self) -> DataFrame:
        """Pairs of court lines per frame: crossing, parallel and coincident ones."""
        x, y = (lambda i: F.col(f"p{i}.x")), (lambda i: F.col(f"p{i}.y"))
        wide = self.court_points_wide
        pairs = {1: (0, 2, 1, 3), 2: (0, 3, 1, 2), 3: (0, 1, 2, 3), 4: (0, 1, 4, 6)}
        rows = F.array(
            *[
                F.struct(
                    F.lit(i).alias("id"),
                    *[c for n, p in enumerate(ps, 1) for c in (x(p).alias(f"x{n}"), y(p).alias(f"y{n}"))],
                )
                for i, ps in pairs.items()
            ]
        )
        return wide.select("video_id", "frame", F.explode(rows).alias("s")).select("video_id", "frame", "s.*")

    @cached_property
    def court_points_wide(self) -> DataFrame:
        """One row per frame with a struct column per court point."""
        moved = F.col("video_id") % 5 + 6 * (F.floor(F.col("frame") / 100) % 3)
        points = [
            F.struct(_double(F.lit(x) + moved, "x"), _double(F.lit(y), "y")).alias(f"p{i}") for i, x, y in COURT_POINTS
        ]
        return self.frames.select("video_id", "frame", *points)

    @cached_property
    def bounce_labels(self) -> DataFrame:
        """1 where the filled ball track turns, else 0. Stored, as a fit reads its labels several times."""
        from framewise.operators.turning import turning_flags

        labels = turning_flags(self.track).select("video_id", "frame", F.col("turn").cast("int").alias("label"))
        return stored(labels, "labels")
