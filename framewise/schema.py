"""Table schemas and the null rule.

Missing measurements are SQL NULL everywhere. NaN is turned into NULL where data
enters (`clean_nan`), because Spark sorts NaN last and treats NaN = NaN as true.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEY = [T.StructField("video_id", T.LongType()), T.StructField("frame", T.LongType())]


def _doubles(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


FRAMES = T.StructType(_KEY)
BALL = T.StructType(_KEY + _doubles("x", "y"))
BOXES = T.StructType(_KEY + [T.StructField("det_idx", T.IntegerType())] + _doubles("x1", "y1", "x2", "y2"))
PLAYERS = T.StructType(
    _KEY
    + [
        T.StructField("det_idx", T.IntegerType()),
        T.StructField("track_id", T.IntegerType()),
        T.StructField("cls", T.StringType()),
    ]
    + _doubles("x1", "y1", "x2", "y2")
)
KEYPOINTS = T.StructType(_KEY + [T.StructField("kp_idx", T.IntegerType())] + _doubles("x", "y"))
COURT_RAW = T.StructType(_KEY + [T.StructField("pred", T.ArrayType(T.DoubleType()))])
FRAME_SIZE = T.StructType(
    [
        T.StructField("video_id", T.LongType()),
        T.StructField("w", T.IntegerType()),
        T.StructField("h", T.IntegerType()),
    ]
)
# Image pixels are addressed (height, weight) in the source data model.
PIXEL = T.StructType([T.StructField("height", T.IntegerType()), T.StructField("weight", T.IntegerType())])
POINT = T.StructType(_doubles("x", "y"))
RECTANGLE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("x1", "y1", "x2", "y2")])
TRACK_MAP = T.MapType(T.LongType(), T.StructType(_doubles("x1", "y1", "x2", "y2")))


def not_nan(c: Column) -> Column:
    """The value, or NULL where it is NaN."""
    return F.when(~F.isnan(c), c)


def clean_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every float column."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[not_nan(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])
