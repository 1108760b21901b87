"""Raster queries over all of their input, on tables larger than the smallest ones."""

import numpy as np
import pytest

from rasterloom import catalogue
from rasterloom.operators import align

DATA = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """A table of 609 vectors of 64 components: 38 whole block rows and one that is cut."""
    values = np.random.default_rng(5).uniform(-1, 1, (609, 64)).astype("float32")
    folder = tmp_path_factory.mktemp("vectors")
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(values)], "vec_id long, embedding array<float>").write.parquet(str(folder / "embeddings.parquet"))
    return str(folder), values


@pytest.mark.parametrize("name", ["block_shift_int", "block_shift_fft", "constrain_shifts", "flow_lab"])
def test_every_whole_block_is_used(spark, vectors, name):
    rows = QUERIES[name](spark, vectors[0]).collect()
    assert sorted((r.by, r.bx) for r in rows) == [(y, x) for y in range(38) for x in range(4)]
    if name != "flow_lab":
        assert all((r.dy, r.dx) == (r.by % 3 - 1, r.bx % 3 - 1) for r in rows)


def _mutual(values):
    bits = np.floor((values.astype("float64") + 1) * 128) > 128
    d = (bits[0::2, None, :] != bits[None, 1::2, :]).sum(axis=2)
    return sorted((2 * i, 2 * int(j) + 1, int(d[i, j])) for i, j in enumerate(d.argmin(axis=1)) if d[:, j].argmin() == i)


@pytest.mark.parametrize("tile", [2048, 50])
def test_all_vectors_and_bits_are_matched(spark, vectors, monkeypatch, tile):
    monkeypatch.setattr(align, "TILE", tile)
    got = sorted(tuple(r) for r in QUERIES["mutual_nn_hamming"](spark, vectors[0]).collect())
    assert got == _mutual(vectors[1])


def test_one_side_without_descriptors(spark):
    none, some = (spark.createDataFrame(rows, "id int, code long") for rows in ([], [(1, -1)]))
    assert align.mutual_nearest(none, some).count() == align.mutual_nearest(some, none).count() == 0


def test_brightfield_cuts_the_9_by_9_entropy_by_otsu(spark):
    pixels = {(r.y, r.x): r.v for r in QUERIES["density_scan"](spark, DATA).collect()}
    image, entropy = np.zeros((64, 64), dtype=int), np.zeros((64, 64))
    for at, v in pixels.items():
        image[at] = v
    for y, x in pixels:
        n = np.unique(image[max(y - 4, 0) : y + 5, max(x - 4, 0) : x + 5], return_counts=True)[1]
        entropy[y, x] = np.round(-(n / n.sum() * np.log2(n / n.sum())).sum(), 6)
    n, edges = np.histogram(entropy, 256)
    centre = (edges[1:] + edges[:-1]) / 2
    between = [n[: k + 1].sum() * n[k + 1 :].sum() * (np.average(centre[: k + 1], weights=n[: k + 1]) - np.average(centre[k + 1 :], weights=n[k + 1 :])) ** 2 for k in range(255)]
    mask = entropy > centre[int(np.argmax(between))]
    inside, outside = np.median(image[mask]), np.median(image[~mask])
    assert [tuple(r) for r in QUERIES["brightfield_flag"](spark, DATA).collect()] == [(inside, outside, inside < outside)]


def test_marker_ink_goes_through_the_median(spark):
    rgb = {(r.channel, r.y, r.x): r.v for r in QUERIES["channel_merge"](spark, DATA).collect()}
    ink = np.zeros((64, 64))
    for y in range(64):
        for x in range(64):
            c, m, k2 = (1 - rgb[k, y, x] / 255 for k in range(3))
            k = min(c, m, k2)
            ink[y, x] = 0 if k >= 1 else (m - k) / (1 - k) + (k2 - k) / (1 - k)
    ink = np.pad(ink, 1, mode="edge")
    want = {(y, x): np.median(ink[y : y + 3, x : x + 3]) for y in range(64) for x in range(64)}
    got = {(r.y, r.x): r.v for r in QUERIES["cmyk_marker"](spark, DATA).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
