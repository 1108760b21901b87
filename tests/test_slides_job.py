"""A job from files to a file."""

import json

import numpy as np

from rasterloom import __main__ as command
from rasterloom.operators import tiles
from rasterloom.plans import jobs, slides
from rasterloom.sinks import tiff as sink
from rasterloom.sources import tiff


def _write(spark, path, planes):
    h, w = planes[0].shape
    rows = [(c, y, x, float(p[y, x])) for c, p in enumerate(planes) for y in range(h) for x in range(w)]
    sink.write_ome_tiff(spark.createDataFrame(rows, "channel int, y int, x int, v double"), str(path), h, w, tile=32, dtype="u1", most=64)


def test_a_job_brings_a_slide_into_the_reference(spark, tmp_path):
    rng = np.random.default_rng(5)
    image = sum(tiles.gaussian(rng.normal(size=(128, 128)), s) * s for s in (1.0, 2.5, 6.0))
    image = np.round((image - image.min()) / (image.max() - image.min()) * 255)
    moved = np.round(tiles.moved(image, 4, -6))
    _write(spark, tmp_path / "a.ome.tif", [image] * 3)
    _write(spark, tmp_path / "b.ome.tif", [moved] * 3)
    config = {
        "input dir": str(tmp_path), "output full path": str(tmp_path / "out" / "c.ome.tif"), "pyramid downscale factor": 2, "pixel size": 0.5,
        "reference image": {"filename": "a.ome.tif", "channel name": "one", "output mode": "grayscale"},
        "moving images": [{"filename": "b.ome.tif", "channel name": "two", "output mode": "grayscale"}],
    }
    path = slides.run_job(spark, config, block=64, size=128, keypoints=500)
    out = {}
    for channel in (0, 1):
        rows = tiff.read_tiff(spark, path).filter(f"level = 0 and channel = {channel}").select("channel", "ty", "tx", "data")
        out[channel] = np.zeros((128, 128))
        for r in tiles.unpack(rows, 64, 128, 128).collect():
            out[channel][r.y, r.x] = r.v
    inner = np.s_[16:112, 16:112]
    thumb = np.rint(image.reshape(64, 2, 64, 2).mean(axis=(1, 3)))  # the range that intensities are laid out over
    assert (out[0] == np.floor(np.round(np.clip((image - thumb.min()) / (thumb.max() - thumb.min()), 0, 1) * 255, 6))).all()
    assert np.median(np.abs(out[1] - out[0])[inner]) < 12
    assert 'Name="two"' in tiff.tiff_tags(spark, [path]).first().xml


def test_the_command_checks_jobs(tmp_path, capsys):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps(jobs.EXAMPLE))
    bad.write_text("{}")
    assert command.main(["check", str(good)]) == 0 and command.main(["check", str(bad)]) == 1
    assert "input dir is missing" in capsys.readouterr().out
    assert command.main(["example"]) == 0


def test_channels_flow_against_one_of_their_own(spark):
    rng = np.random.default_rng(6)
    image = tiles.gaussian(rng.normal(size=(70, 70)), 1.5)
    planes = [image, tiles.moved(image, 2, 0), image]
    rows = [(c, y, x, float(p[y, x])) for c, p in enumerate(planes) for y in range(70) for x in range(70)]
    got = slides.flow_of_channels(spark.createDataFrame(rows, "channel int, y int, x int, v double"), 70, 70, 0, [1, 2], 32).collect()
    assert len(got) == 8
    assert all((r.dy, r.dx) == (0, 0) for r in got if r.channel == 2)
    assert all(abs(r.dy - 2) <= 0.2 and abs(r.dx) <= 0.2 for r in got if r.channel == 1)
