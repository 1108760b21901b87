"""Tiles, registration and files against plain numpy and planted maps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import affine
from rasterloom.operators import align, halo, keypoints, masks, stencil, threshold, tiles
from rasterloom.plans import aligner, jobs, registration
from rasterloom.sinks import tiff as sink
from rasterloom.sources import tiff


def _pixels(spark, image, channel=0):
    return spark.createDataFrame([(channel, y, x, float(image[y, x])) for y in range(image.shape[0]) for x in range(image.shape[1])], "channel int, y int, x int, v double")


def _array(df, h, w, name="v"):
    out = np.zeros((h, w))
    for r in df.collect():
        out[r.y, r.x] = r[name]
    return out


def _blobs(h, w, seed=1):
    """A smooth image with structure at several sizes."""
    rng = np.random.default_rng(seed)
    out = np.zeros((h, w))
    for sigma in (1.0, 2.5, 6.0):
        part = tiles.gaussian(rng.normal(size=(h, w)), sigma)
        out += part / part.std()
    return np.round((out - out.min()) / (out.max() - out.min()) * 255)


def test_packing_round_trip(spark):
    image = np.random.default_rng(0).integers(0, 99, (37, 53))
    packed = tiles.pack(_pixels(spark, image), 16)
    assert packed.count() == 3 * 4
    assert (_array(tiles.unpack(packed, 16, 37, 53), 37, 53) == image).all()


def test_planted_shifts_with_fractions_masks_and_constant_blocks():
    image = _blobs(80, 80)
    one = image[8:72, 8:72]
    for dy, dx in ((0, 0), (3, -5), (-7, 2)):
        two = image[8 + dy : 72 + dy, 8 + dx : 72 + dx]
        found = tiles.phase_shift(one, two)
        assert found[:2] == (dy, dx) and found[2] < 1
    half = tiles.moved(image, 0.5, -0.3)[8:72, 8:72]
    got = tiles.phase_shift(half, one, 1.0, 10)
    assert abs(got[0] - 0.5) <= 0.15 and abs(got[1] + 0.3) <= 0.15
    assert tiles.phase_shift(np.ones((8, 8)), one[:8, :8]) is None
    surface = tiles.correlation_surface(one, one)
    assert np.unravel_index(surface.argmax(), surface.shape) == (32, 32) and surface.max() == pytest.approx(1)


def test_masked_blocks_have_no_shift_or_no_flow(spark):
    packed = tiles.pack(_pixels(spark, _blobs(32, 32)), 16)
    mask = spark.createDataFrame([(0, 0, True), (0, 1, False)], "by int, bx int, inside boolean")
    got = {(r.by, r.bx): tuple(r)[2:4] for r in tiles.block_shifts(packed, packed, 16, mask).collect()}
    assert got == {(0, 0): (0.0, 0.0), (0, 1): (None, None), (1, 0): (None, None), (1, 1): (None, None)}
    flow = {(r.by, r.bx): tuple(r)[2:] for r in tiles.block_shifts(packed, packed, 16, mask, flow=True).collect()}
    assert flow[0, 1] == (0.0, 0.0, 0.0) and flow[0, 0][:2] == (0.0, 0.0)


@pytest.mark.parametrize("border", ["clip", "edge", "symmetric", "reflect"])
def test_halos_join_tiles_seamlessly(spark, border):
    image = np.random.default_rng(4).integers(0, 50, (41, 30)).astype(float)
    mode = {"clip": "constant", "edge": "edge", "symmetric": "symmetric", "reflect": "reflect"}[border]
    padded = np.pad(image, 2, mode=mode)
    want = np.median(np.lib.stride_tricks.sliding_window_view(padded, (5, 5)).reshape(41, 30, 25), axis=-1)
    packed = tiles.pack(_pixels(spark, image), 16)
    got = _array(tiles.unpack(halo.stencil(packed, 16, 2, 41, 30, halo.median_kernel(2), border), 16, 41, 30), 41, 30)
    assert np.allclose(got, want)


def test_the_aligner_finds_planted_block_moves(spark):
    image = _blobs(96, 96)
    moved = tiles.moved(image, 4, 3)
    job = aligner.Aligner(tiles.pack(_pixels(spark, image), 32), tiles.pack(_pixels(spark, moved), 32), 32, 3, 3, coarse=(1, 0, -2, 0, 1, -2))
    shifts = {(r.by, r.bx): (r.dy, r.dx) for r in job.shifts().collect()}
    assert all(shifts[k] == (-2.0, -1.0) for k in [(1, 1)])
    back = _array(tiles.unpack(job.run(), 32, 96, 96), 96, 96)
    assert np.abs(back[32:64, 32:64] - image[32:64, 32:64]).max() < 1
    assert aligner.Aligner(None, None, 1, 1, 1, (1, 0, 10, 0, 1, 0), 4, 8).matrix == (0.5, 0.0, 40, 0.0, 0.5, 0)


def test_levels_and_objects_are_put_together(spark):
    image = _blobs(64, 64)
    packed = tiles.pack(_pixels(spark, image), 16)
    fine = aligner.Aligner(packed, packed, 16, 4, 4)
    got = aligner.align_levels({0: (1, fine)}).collect()
    assert len(got) == 16 and all((r.level, r.dy, r.dx) == (0, 0.0, 0.0) for r in got)
    boxes = spark.createDataFrame([(0, 9, 0, 2, 0, 2), (1, 4, 1, 3, 1, 3)], "obj_id int, area int, rs int, re int, cs int, ce int")
    out = {(r.by, r.bx): r.obj_id for r in aligner.align_objects(fine, boxes, {0: aligner.IDENTITY, 1: aligner.IDENTITY}).collect()}
    assert out[0, 0] == 0 and out[1, 1] == 0 and out[2, 2] == 1 and out[3, 3] is None and len(out) == 16


def test_constraint_is_strict_and_ignores_what_is_no_estimate(spark):
    rows = [(y, x, 1.0 + 0.01 * ((y + x) % 2), 2.0) for y in range(8) for x in range(8)]
    rows[5] = (0, 5, 40.0, -30.0)
    rows[9] = (1, 1, None, None)
    rows[17] = (2, 1, float("inf"), float("inf"))
    got = {(r.by, r.bx): r for r in align.constrained(spark.createDataFrame(rows, "by int, bx int, dy double, dx double")).collect()}
    for k in ((0, 5), (1, 1), (2, 1)):
        assert not got[k].passed and abs(got[k].fitted_dy - 1) < 0.1 and abs(got[k].fitted_dx - 2) < 0.1


def test_keypoints_register_planted_maps(spark):
    side = 128
    image = _blobs(side, side)
    left = _pixels(spark, image).drop("channel").withColumn("v", F.col("v").cast("int"))
    y, x = np.mgrid[:side, :side].astype(float)
    moved = np.round(tiles._sampled(image, y + 5, x - 7, False))
    right = _pixels(spark, 255 - np.flipud(moved)).drop("channel").withColumn("v", F.col("v").cast("int"))
    found = registration.feature_registration(left, right, side, side, test_flip=True, test_invert=True, n=600)
    assert found.hypothesis == (True, -1) and found.inliers > 50
    corner = np.array(found.matrix).reshape(2, 3) @ [20.0, 30.0, 1.0]  # right (20, 30): row 97 unflipped, at (13, 102) in the left
    assert np.allclose(corner, [20 - 7, 127 - 30 + 5], atol=0.7)


def test_the_search_over_configurations(spark):
    side = 96
    image = _blobs(side, side, seed=3)
    left = _pixels(spark, image).drop("channel").withColumn("v", F.col("v").cast("int"))
    right = _pixels(spark, 255 - np.flipud(image)).drop("channel").withColumn("v", F.col("v").cast("int"))
    config, inliers = registration.search_configuration(left, right, side, side, size=96, n=300, masked=False)
    assert config[1:] == (-1, True) and inliers > 30
    turn = registration.turned(left, side, side, True, 1)
    got = _array(turn, side, side)
    assert (got == np.rot90(np.flipud(image))).all()
    m = np.array(registration.turning(side, side, True, 1)).reshape(2, 3)
    assert np.allclose(m @ [10, 20, 1], [side - 1 - 20, side - 1 - 10])


def test_files_round_trip(spark, tmp_path):
    image = np.random.default_rng(2).integers(0, 60000, (150, 90))
    pixels = _pixels(spark, image).unionByName(_pixels(spark, image[::-1] // 2, channel=1))
    path = str(tmp_path / "a.ome.tif")
    sink.write_ome_tiff(pixels, path, 150, 90, ["CD3", "<x>"], 0.5, tile=32, most=64)
    with pytest.raises(FileExistsError):
        sink.write_ome_tiff(pixels, path, 150, 90, tile=32)
    with pytest.raises(ValueError):
        sink.checked_path("a.tif")
    read = tiff.read_tiff(spark, path, 5)
    base = read.filter("level = 0 and channel = 0").select("channel", "ty", "tx", "data")
    assert (_array(tiles.unpack(base, 32, 150, 90), 150, 90) == image).all()
    levels = [tuple(r)[1:] for r in tiff.tiff_levels(spark, [path]).orderBy("level").collect()]
    assert levels == [(0, 2, 150, 90, 32, 32, "u2"), (1, 2, 75, 45, 32, 32, "u2"), (2, 2, 38, 23, 32, 32, "u2")]
    half = _array(tiles.unpack(read.filter("level = 1 and channel = 1").select("channel", "ty", "tx", "data"), 32, 75, 45), 75, 45)
    assert (half == np.rint((image[::-1] // 2).reshape(75, 2, 45, 2).mean(axis=(1, 3)))).all()
    tags = tiff.tiff_tags(spark, [path]).first()
    assert tags.x_resolution == 20000 and tags.software == "rasterloom" and 'Name="&lt;x&gt;"' in tags.xml and 'PhysicalSizeX="0.5"' in tags.xml
    assert tiff.replace_in_description(path, "CD3", "CD45RO") == 1 and tiff.replace_in_description(path, "none", "x") == 0
    assert "CD45RO" in tiff.tiff_tags(spark, [path]).first().xml
    assert (_array(tiles.unpack(tiff.read_tiff(spark, path).filter("level = 0 and channel = 0").select("channel", "ty", "tx", "data"), 32, 150, 90), 150, 90) == image).all()


def test_jobs_are_checked():
    assert jobs.problems(jobs.EXAMPLE) == []
    bad = jobs.EXAMPLE | {"output full path": "a.png", "pyramid downscale factor": 40, "moving images": [{"filename": "a", "output mode": "dark"}]}
    assert len(jobs.problems(bad)) == 3
    with pytest.raises(ValueError):
        jobs.with_defaults(bad)
    assert jobs.with_defaults(jobs.EXAMPLE)["pyramid downscale factor"] == 4


def test_small_helpers(spark):
    image = spark.createDataFrame([(y, x, y * 4 + x) for y in range(4) for x in range(4)], "y int, x int, v int")
    mask = image.select("y", "x", (F.col("v") > 7).alias("inside"))
    assert masks.background_mean(image, mask).first()[0] == 3.5
    assert {r.v for r in threshold.stretched(image, 0, 15, 0, 30).collect()} == {2.0 * k for k in range(16)}
    assert _array(stencil.translated(image, 1, 0, 4, 4), 4, 4).tolist()[1] == [0, 1, 2, 3]
    swapped = affine.swapped(spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], ", ".join(f"{e} double" for e in affine.ENTRIES))).first()
    assert tuple(swapped) == (5.0, 4.0, 6.0, 2.0, 1.0, 3.0)
    assert keypoints.described(np.zeros((20, 20)), 10)[0].shape == (0, 2)
