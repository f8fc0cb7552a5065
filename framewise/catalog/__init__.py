"""Registered queries: each reads the given tables and, where SQL can say it, has an SQL twin."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.sources.samples import Samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, one_video: bool = False):
    """Register a function of the sample tables under a name, with its SQL twin."""

    def wrap(build: Callable[[Samples], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Samples(spark, sf_dir, one_video))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Computed doubles to a fixed number of places; -0.0 becomes 0.0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


def load() -> None:
    """Import the modules that register queries."""
    from framewise.catalog import courts, events, points, selections, tables, tracks  # noqa: F401
