"""Boxes over a layout along a curve."""

import random

import pytest
from pyspark.sql import functions as F

from tramline.operators import spatial
from tramline.streaming import realtime


@pytest.fixture(scope="module")
def points(spark):
    rows = spark.range(40_000).select("id", ((F.xxhash64("id") % 18_000) / 100).alias("longitude"), ((F.xxhash64("id", F.lit(1)) % 9_000) / 100).alias("latitude"))
    odd = spark.createDataFrame([(-1, None, 1.0), (-2, 1.0, None), (-3, float("nan"), 1.0), (-4, 180.0, 90.0), (-5, -180.0, -90.0), (-6, 0.0, 0.0), (-7, 0.0, 0.0), (-8, float("inf"), 0.0)], "id long, longitude double, latitude double")
    return rows.unionByName(odd).cache()


@pytest.fixture(scope="module")
def layout(points, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "points")
    spatial.write_clustered(points, path, files=16, group_bytes=8_192)
    return path


BOXES = [(-180.0, -90.0, 180.0, 90.0), (10.0, 40.0, 12.0, 41.0), (0.0, 0.0, 0.0, 0.0), (-3.3, -2.2, 4.4, 5.5), (179.0, 89.0, 180.0, 90.0), (5.0, 9.0, 5.0, 3.0), (-180.0, -90.0, -179.0, -80.0)]


@pytest.mark.parametrize("box", BOXES)
def test_boxes_are_those_of_a_filter(spark, points, layout, box):
    got = spatial.read_boxed(spark, layout, *box)
    assert got.columns == points.columns
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in realtime.boxed(points, *box).collect())


def test_a_box_across_the_meridian(spark, points, layout):
    got = sorted(r.id for r in spatial.read_boxed(spark, layout, 170.0, -90.0, -170.0, 90.0).collect())
    assert got == sorted(r.id for r in points.filter("(longitude >= 170 AND NOT isnan(longitude) AND longitude < 1000) OR longitude <= -170").filter("latitude IS NOT NULL").collect()) and -4 in got and -5 in got


def scanned(df):
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_fewer_rows_are_read_for_smaller_boxes(spark, layout):
    n = [scanned(spatial.read_boxed(spark, layout, 0.0, 0.0, side, side)) for side in (90.0, 20.0, 2.0)]
    assert n[0] > 2 * n[1] and n[1] >= n[2] and n[2] < 4_000


def test_ranges_hold_every_cell_of_a_box(spark):
    rng = random.Random(3)
    for _ in range(20):
        w, s = rng.uniform(-180, 170), rng.uniform(-90, 80)
        e, n = rng.uniform(w, 180), rng.uniform(s, 90)
        own = spatial.ranges(w, s, e, n, 16)
        assert len(own) <= 16
        inside = spark.createDataFrame([(rng.uniform(w, e), rng.uniform(s, n)) for _ in range(50)] + [(w, s), (e, n)], "longitude double, latitude double")
        cells = [r.c for r in inside.select(spatial.cell(F.col("longitude"), F.col("latitude")).alias("c")).collect()]
        assert all(any(a <= c <= b for a, b in own) for c in cells)
