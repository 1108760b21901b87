"""Fixed cases and metamorphic properties of the raster operators."""

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import geometry
from rasterloom.operators import align, objects, resample, threshold


def test_level_counts():
    assert [geometry.level_count(n) for n in (1024, 1025, 500, 5000)] == [1, 2, 1, 4]


def test_level_geometry(spark):
    rows = geometry.level_geometry(spark.createDataFrame([("a", 5000, 3000)], "image string, h long, w long")).orderBy("level").collect()
    assert [(r.height, r.width) for r in rows] == [(5000, 3000), (2500, 1500), (1250, 750), (625, 375)]
    assert [(r.tile_h, r.tile_w) for r in rows] == [(1008, 1008), (848, 752), (640, 752), (640, 384)]


def test_strict_match_of_equal_pyramids(spark):
    px = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "level int, px double")
    assert sorted(tuple(r) for r in geometry.match_levels_strict(px, px).collect()) == [(0, 0), (1, 0), (2, 1)]


def test_flips_are_their_own_inverse():
    m = geometry.flip(0, 4, 6)
    assert resample.inverse(m) == pytest.approx(m)


def test_warp_by_whole_pixels_moves(spark):
    image = spark.range(36).select((F.col("id") / 6).cast("int").alias("y"), (F.col("id") % 6).cast("int").alias("x"), F.col("id").cast("int").alias("v"))
    grid = image.select("y", "x")
    for warp in (resample.warp_nearest, resample.warp_bilinear):
        got = {(r.y, r.x): r.v for r in warp(image, grid, (1, 0, 2, 0, 1, 1)).collect()}
        assert got == {(y, x): (6 * (y + 1) + x + 2 if y < 5 and x < 4 else 0) for y in range(6) for x in range(6)}


def test_constant_image_has_a_threshold(spark):
    flat = spark.range(10).select(F.lit(0).alias("y"), F.col("id").cast("int").alias("x"), F.lit(7).alias("v"))
    assert threshold.otsu(flat).collect()[0].threshold == 7.0


def test_stray_and_missing_shifts_are_replaced(spark):
    rows = [(y, x, y, 1) for y in range(-2, 3) for x in range(4)]
    rows[5], rows[9] = (rows[5][0], rows[5][1], 40, -30), (rows[9][0], rows[9][1], None, None)
    out = {(r.by, r.bx): r for r in align.constrained(spark.createDataFrame(rows, "by int, bx int, dy int, dx int")).collect()}
    assert len(out) == 20
    for k in (5, 9):
        r = out[rows[k][:2]]
        assert not r.passed and (r.fitted_dy, r.fitted_dx) == pytest.approx((r.by, 1.0), abs=1e-6)


def _spiral(n):
    y, x, cells, dy, dx = 0, 0, {(0, 0)}, 0, 1
    while True:
        ahead, beyond = (y + dy, x + dx), (y + 2 * dy, x + 2 * dx)
        free = 0 <= ahead[0] < n and 0 <= ahead[1] < n and ahead not in cells and beyond not in cells
        if not free:
            dy, dx = dx, -dy
            ahead, beyond = (y + dy, x + dx), (y + 2 * dy, x + 2 * dx)
            if ahead in cells or beyond in cells or not (0 <= ahead[0] < n and 0 <= ahead[1] < n):
                return cells
        y, x = ahead
        cells.add(ahead)


def test_objects_of_a_winding_mask(spark):
    cells = sorted(_spiral(15)) + [(30, 30), (31, 31), (31, 29), (40, 3), (40, 3)]
    found = objects.boxes_of(objects.label_objects(spark.createDataFrame(cells, "y int, x int"))).orderBy("label").collect()
    assert [tuple(r)[1:] for r in found] == [(0, 15, 0, 15, len(cells) - 5), (30, 32, 29, 32, 3), (40, 41, 3, 4, 1)]


def test_objects_of_an_empty_mask(spark):
    empty = spark.createDataFrame([], "y int, x int")
    assert objects.boxes_of(objects.label_objects(empty)).count() == 0


def test_flat_image_normalises_to_zero(spark):
    flat = spark.createDataFrame([(0, 0, 7), (0, 1, 7)], "y int, x int, v int")
    assert {r.v for r in threshold.normalised(flat).collect()} == {0}
