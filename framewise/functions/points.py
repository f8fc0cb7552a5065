"""Column expressions on boxes, points and lines. All stay inside generated code."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_DISTANCE = 999.0
MODEL_SIZE = 224
MODEL_POINTS = 14


def centre_x(x1: Column, x2: Column) -> Column:
    """Middle of an interval as int, cut toward zero. NULL in, NULL out."""
    return ((x1 + x2) / 2).try_cast("int")


centre_y = centre_x


def foot_point(x1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(centre_x(x1, x2).alias("x"), y2.alias("y"))


def foot_of_centre_box(yc: Column, h: Column) -> Column:
    """Lower edge of a box given by centre and size."""
    return yc + h / 2


def box_height(y1: Column, y2: Column) -> Column:
    return y2 - y1


def squared_distance(xa: Column, ya: Column, xb: Column, yb: Column) -> Column:
    return (xa - xb) * (xa - xb) + (ya - yb) * (ya - yb)


def distance(xa: Column, ya: Column, xb: Column, yb: Column) -> Column:
    return F.sqrt(squared_distance(xa, ya, xb, yb))


def distance_or_far(xa: Column, ya: Column, xb: Column, yb: Column, far: float = MISSING_DISTANCE) -> Column:
    """Distance; a missing point counts as `far` away."""
    return F.coalesce(distance(xa, ya, xb, yb), F.lit(far))


def axis_distances(xa: Column, ya: Column, xb: Column, yb: Column) -> Column:
    return F.struct(F.abs(xa - xb).alias("dx"), F.abs(ya - yb).alias("dy"))


def pixels_to_metres(px: Column, ref_m: Column, ref_px: Column) -> Column:
    return F.try_divide(px * ref_m, ref_px)


def metres_to_pixels(m: Column, ref_m: Column, ref_px: Column) -> Column:
    return F.try_divide(m * ref_px, ref_m)


def within_circle(radius: Column, dist: Column) -> Column:
    """Strictly inside."""
    return radius > dist


def came_no_closer(prev_dist: Column, curr_dist: Column) -> Column:
    """True if the previous distance is at most the current one, else NULL."""
    return F.when(prev_dist <= curr_dist, True)


def line_intersection(x1, y1, x2, y2, x3, y3, x4, y4) -> Column:
    """Where two infinite lines meet; NULL for parallel and for coincident lines."""
    det = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    a = x1 * y2 - y1 * x2
    b = x3 * y4 - y3 * x4
    x = F.try_divide(a * (x3 - x4) - (x1 - x2) * b, det)
    y = F.try_divide(a * (y3 - y4) - (y1 - y2) * b, det)
    return F.when(det != 0, F.struct(x.alias("x"), y.alias("y")))


def fill_missing(c: Column, value: float = 0) -> Column:
    return F.coalesce(c, F.lit(value))


def keep_if(cond: Column, value: Column) -> Column:
    """The value where the condition holds, else NULL."""
    return F.when(cond, value)


def round_to_int(c: Column) -> Column:
    """Round half to even."""
    return F.bround(c).try_cast("int")


def over_threshold(p: Column, threshold: float | None = 0.8) -> Column:
    """1 above the threshold, else 0; without a threshold the value itself."""
    return F.when(p > threshold, 1).otherwise(0) if threshold else p


def keypoints_from_vector(pred: Column, w: Column, h: Column, model_size: int = MODEL_SIZE) -> Column:
    """A flat vector x0, y0, x1, y1, ... in model space as an array of frame points."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(MODEL_POINTS - 1)),
        lambda i: F.struct(
            (F.element_at(pred, 2 * i + 1) * (w / F.lit(float(model_size)))).alias("x"),
            (F.element_at(pred, 2 * i + 2) * (h / F.lit(float(model_size)))).alias("y"),
        ),
    )


def perspective_velocity(y: Column, dy: Column, frame_height: int) -> Column:
    """Vertical speed, larger the higher up (farther away) the point is."""
    return dy * (1 + (frame_height - y) * 0.4 / frame_height)
