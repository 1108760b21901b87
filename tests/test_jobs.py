"""Manifests, pyramids on disk, streams and robust fits."""

import numpy as np

from rasterloom.operators import matching
from rasterloom.sinks import pyramid
from rasterloom.sources import manifest
from rasterloom.streaming import tiles


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text('p1,n_keypoints,other,intensity_in_range\na.tif,50,x,"(0, 200)"\nb.tif,,y,\nc.tif,many,z,\n')
    kinds = {"p1": "string", "n_keypoints": "int", "auto_mask": "boolean", "intensity_in_range": "array<double>"}
    got = manifest.jobs(manifest.read_manifest(spark, str(tmp_path / "m.csv")), kinds, {"n_keypoints": 9, "auto_mask": True}).orderBy("p1").collect()
    assert [tuple(r) for r in got] == [("a.tif", 50, True, [0.0, 200.0]), ("b.tif", 9, True, None), ("c.tif", 9, True, None)]


def _pixels(spark, size=8):
    return spark.range(2 * size * size).selectExpr(f"cast(id div {size * size} as int) as channel", f"cast(id div {size} % {size} as int) as y", f"cast(id % {size} as int) as x", "cast(id * 7 % 256 as int) as v")


def test_pyramid_is_read_as_written(spark, tmp_path):
    pixels, path = _pixels(spark), str(tmp_path / "p")
    pyramid.write_pyramid(pixels, path, 3, tile=4)
    want = {tuple(r) for r in pyramid.pyramid_levels(pixels, 3).collect()}
    got = {(k, *r) for k in range(3) for r in pyramid.read_level(spark, path, k).collect()}
    assert got == want
    part = pyramid.read_level(spark, path, 0, channels=[1, 0], region=(2, 4, 3, 6)).collect()
    assert {(1 - r.channel, r.y, r.x, r.v) for r in part} == {w[1:] for w in want if w[0] == 0 and 2 <= w[2] < 4 and 3 <= w[3] < 6}
    masks = pyramid.pyramid_levels(pixels, 2, mask=True).filter("level = 1").collect()
    full = {(r.channel, r.y, r.x): r.v for r in pixels.collect()}
    assert {(r.channel, r.y, r.x): r.v for r in masks} == {(c, y // 2, x // 2): v for (c, y, x), v in full.items() if y % 2 == 0 and x % 2 == 0}


def test_stream_of_pixels(spark, tmp_path):
    pixels, folder = _pixels(spark), str(tmp_path / "in")
    pixels.filter("x < 5").write.parquet(folder)
    blocks = tiles.finished_blocks(tiles.arriving(spark, folder), 2)
    tiles.write_finished(blocks, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    pixels.filter("x >= 5").write.mode("append").parquet(folder)
    tiles.write_finished(blocks, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("channel", "y", "x", "v").collect())
    assert got == sorted(tuple(r) for r in pyramid.next_level(pixels).collect())


def test_robust_fit_on_few_or_flat_points():
    line = np.column_stack([np.arange(9.0), np.arange(9.0)])
    for src in (line[:0], line[:2], line):
        m, inlier = matching.fit_affine(src, src, 1.0, 500)
        assert m is None and not inlier.any()
