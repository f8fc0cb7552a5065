import math

import pytest
from pyspark.sql import functions as F

from framewise import schema
from framewise.functions import points as P
from framewise.operators import geometry


def one(spark, **cols):
    row = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    return row[0] if len(cols) == 1 else row


def test_centre_is_cut_toward_zero(spark):
    x = P.centre_x(F.lit(-3.0), F.lit(0.0))
    assert tuple(one(spark, x=x, y=P.centre_y(F.lit(0.0), F.lit(1.0)))) == (-1, 0)


def test_centre_of_a_missing_box_is_missing(spark):
    assert one(spark, x=P.centre_x(F.lit(None).cast("double"), F.lit(1.0))) is None


def test_a_huge_coordinate_does_not_fail_the_job(spark):
    assert one(spark, x=P.centre_x(F.lit(1e300), F.lit(1e300))) is None


def test_rounding_is_half_to_even(spark):
    got = one(spark, **{f"c{i}": P.round_to_int(F.lit(v)) for i, v in enumerate((0.5, 1.5, 2.5, -0.5, -1.5))})
    assert tuple(got) == (0, 2, 2, 0, -2)


def test_missing_distance_is_far(spark):
    none = F.lit(None).cast("double")
    assert one(spark, d=P.distance_or_far(none, none, F.lit(0.0), F.lit(0.0))) == 999.0


@pytest.mark.parametrize(
    "line, want",
    [
        ((0, 0, 2, 2, 0, 2, 2, 0), (1.0, 1.0)),
        ((0, 0, 1, 0, 0, 1, 1, 1), None),  # parallel
        ((0, 0, 1, 1, 2, 2, 3, 3), None),  # coincident
    ],
)
def test_line_intersection(spark, line, want):
    got = one(spark, p=P.line_intersection(*[F.lit(float(v)) for v in line]))
    assert (got and tuple(got)) == want


def test_threshold_is_strict_and_zero_passes_through(spark):
    p = F.lit(0.8)
    assert tuple(one(spark, a=P.over_threshold(p, 0.8), b=P.over_threshold(p, 0), c=P.over_threshold(p, 0.7))) == (0, 0.8, 1)


def test_division_by_a_zero_reference_is_missing(spark):
    assert one(spark, m=P.pixels_to_metres(F.lit(1.0), F.lit(2.0), F.lit(0.0))) is None


def test_closer_is_true_or_missing(spark):
    got = one(spark, a=P.came_no_closer(F.lit(1.0), F.lit(1.0)), b=P.came_no_closer(F.lit(2.0), F.lit(1.0)))
    assert tuple(got) == (True, None)


def test_nan_becomes_null_at_the_entrance(spark):
    df = spark.createDataFrame([(0, 0, math.nan, 1.0)], schema.BALL)
    assert tuple(schema.clean_nan(df).first()) == (0, 0, None, 1.0)


def corners(values):
    return [F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in values]


QUAD = ((745, 350), (1720, 350), (470, 1070), (2010, 1060))


def test_homography_takes_the_corners_to_the_court(spark):
    h = geometry.quad_to_rectangle(*corners(QUAD))
    targets = [(geometry.LEFT, geometry.TOP), (geometry.RIGHT, geometry.TOP), (geometry.LEFT, geometry.BOTTOM), (geometry.RIGHT, geometry.BOTTOM)]
    for (x, y), want in zip(QUAD, targets):
        p = F.lit(float(x)), F.lit(float(y))
        got = one(spark, x=geometry.project_x(*p, h), y=geometry.project_y(*p, h))
        assert tuple(got) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(
    "point, want", [((800, 1130), (360.46, 1318.51)), ((1400, 340), (558.07, 295.79)), ((1050, 900), (423.13, 1115.27))]
)
def test_known_map_positions(spark, point, want):
    h = geometry.quad_to_rectangle(*corners(QUAD))
    p = [F.lit(float(v)) for v in point]
    assert tuple(one(spark, x=geometry.project_x(*p, h), y=geometry.project_y(*p, h))) == pytest.approx(want, abs=0.005)


def test_a_degenerate_quad_has_no_matrix(spark):
    h = geometry.quad_to_rectangle(*corners(((0, 0), (1, 1), (2, 2), (3, 3))))
    assert one(spark, h=h)[8] is None


def test_a_point_on_the_horizon_maps_to_zero(spark):
    h = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, -5.0)])
    assert one(spark, x=geometry.project_x(F.lit(3.0), F.lit(5.0), h)) == 0.0


def test_court_constants():
    assert (geometry.LEFT, geometry.TOP, geometry.RIGHT, geometry.BOTTOM) == (264, 317, 702, 1268)
    assert geometry.court_lines()[0] == ("canvas", 0, 0, 967, 1585)
