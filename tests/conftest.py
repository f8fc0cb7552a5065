import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def track(spark):
    """Build a ball table from lists of points, one list per video."""
    from framewise import schema

    def build(*videos):
        rows = [
            (v, f, *(None if c is None else float(c) for c in point))
            for v, points in enumerate(videos)
            for f, point in enumerate(points)
        ]
        return spark.createDataFrame(rows, schema.BALL)

    return build


@pytest.fixture(scope="session")
def points():
    """Read a (video_id, frame, x, y) table back as lists of points."""

    def read(df, *cols):
        cols = cols or ("x", "y")
        videos = {}
        for r in sorted(df.collect(), key=lambda r: (r["video_id"], r["frame"])):
            videos.setdefault(r["video_id"], []).append(tuple(r[c] for c in cols))
        return [videos[v] for v in sorted(videos)]

    return read
