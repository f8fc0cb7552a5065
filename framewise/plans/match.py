"""The main flow: from detection tables to bounces, map positions and the overlay."""

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.operators import camera, fill, geometry, models, overlay, select, turning
from framewise.operators.chunks import CHUNK
from framewise.sources.tables import stored


@dataclass
class Match:
    """Analysis of videos whose detections are given as tables.

    `ball` (video_id, frame, x, y) has one row per frame; `boxes` are tracked detections;
    `court` has one row per court point and frame. `scorer` is a fitted bounce model or a
    score expression; without it the bounces drawn are the turning points of the filled
    track. With `moving` the court mapping is fitted anew wherever the camera moves, else frame 0 decides.
    `positions` has the map places of the court points that the fit uses.

    Nothing runs before a result is read. With `keep` the results that several later steps read are
    written to the shared folder of the session when they are first asked for.
    """

    ball: DataFrame
    boxes: DataFrame
    court: DataFrame
    scorer: PipelineModel | Column | None = None
    window: int = 5
    mode: str = "compat"
    size: int = CHUNK
    moving: bool = False
    positions: dict[int, tuple[float, float]] | None = None
    keep: bool = False

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, name) if self.keep else df

    @cached_property
    def players(self) -> DataFrame:
        """The two main players, in all frames."""
        boxes = select.player_boxes(self.boxes)
        chosen = select.choose_players(boxes, self.court)
        return self._kept(select.keep_tracks(boxes, chosen), "players")

    @cached_property
    def filled(self) -> DataFrame:
        return self._kept(fill.fill_ball(self.ball, self.window, mode=self.mode, size=self.size), "filled")

    @cached_property
    def turns(self) -> DataFrame:
        return turning.turning_points(self.filled, size=self.size, complete=True)

    @cached_property
    def bounces(self) -> DataFrame:
        """Bounces by score on the raw track with short gaps extrapolated; else the turning points."""
        if self.scorer is None:
            return self._kept(self.turns, "bounces")
        return self._kept(models.predict_bounces(self.ball, self.scorer, size=self.size), "bounces")

    @cached_property
    def track(self) -> DataFrame:
        """The filled track with `bounce` for each frame: all that is drawn of the ball comes from it."""
        if self.scorer is None and "bounces" not in self.__dict__:
            flagged = turning.turning_flags(self.filled, size=self.size, keep=["x"], complete=True)
            return self._kept(flagged.select("video_id", "frame", "x", "y", F.col("turn").alias("bounce")), "track")
        return select.flag_frames(self.filled, self.bounces, "bounce")

    @cached_property
    def matrices(self) -> DataFrame:
        """One matrix per video, or per frame where the camera moves."""
        if not self.moving:
            return geometry.video_homography(self.court)
        frames = self.ball.select("video_id", "frame")
        return camera.refreshed_homography(self.court, frames, self.positions, size=self.size)

    @cached_property
    def mini_map(self) -> DataFrame:
        return overlay.mini_map_of_track(self.players, self.track, self.matrices)

    @cached_property
    def overlay(self) -> DataFrame:
        """Each source is read for all of its layers at once."""
        return overlay.overlay(
            [
                overlay.point_layer(self.court),
                overlay.track_layers(self.track, self.matrices),
                overlay.player_layers(self.players, self.matrices),
                overlay.court_layer(self.ball.select("video_id", "frame")),
            ]
        )
