"""Robust affine fits of many matches: the same as in one task, in bounded memory."""

import tracemalloc

import numpy as np
import pytest

from rasterloom.operators import matching


def _matches(rng, config, n, share, noise=0.0):
    s = rng.uniform(0, 900, (n, 2)).round(2)
    t = s @ np.array([[0.9, 0.2], [-0.2, 1.1]]) + [3.0, -7.0] + rng.normal(0, 1, (n, 2)) * noise
    wrong = rng.uniform(size=n) >= share
    t[wrong] = rng.uniform(0, 900, (int(wrong.sum()), 2))
    return [(config, *map(float, r)) for r in np.column_stack([s, t])]


@pytest.fixture(scope="module")
def matches(spark):
    rng = np.random.default_rng(8)
    rows = [*_matches(rng, 1, 700, 0.7, 0.5), *_matches(rng, 2, 500, 0.12, 0.1), *_matches(rng, -3, 40, 0.8), *_matches(rng, 4, 400, 0.0)]
    rows += [(5, float(k), float(k), float(k), 2.0 * k) for k in range(200)]  # all on a line
    rows += [(6, *r[1:]) for r in rows[:30]] * 20  # each twenty times
    rows += [(7, 1.0, 2.0, 3.0, 4.0), (7, 5.0, 6.0, 7.0, 8.0), (1, None, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0), (2, float("nan"), 0.0, 0.0, 0.0)]
    rng.shuffle(rows)
    rows = [(None if r[0] is None else int(r[0]), *r[1:]) for r in rows]
    return spark.createDataFrame(rows, "config long, sx double, sy double, tx double, ty double").repartition(6)


@pytest.mark.parametrize("large", [50, 450])
def test_spread_fit_equals_fit_in_one_task(matches, monkeypatch, large):
    monkeypatch.setattr(matching, "LARGE", large)
    want = {r.config: tuple(r)[1:] for r in matching.robust_affine(matches, 3.0, 1500).collect()}
    got = {r.config: tuple(r)[1:] for r in matching.spread_robust_affine(matches, 3.0, 1500).collect()}
    assert got.keys() == want.keys() == {1, 2, -3, 4, 5, 6, 7}
    assert want[5] == want[7][:6] + (0, 200) and want[1][6] > 450 and want[2][6] > 20
    for config, row in want.items():
        assert got[config][6:] == row[6:]
        assert (row[0] is None and got[config] == row) or got[config][:6] == pytest.approx(row[:6], abs=1e-9)


def test_maps_are_tried_in_strips():
    """256 maps times 200,000 matches once were held together, some gigabytes."""
    s = np.random.default_rng(1).uniform(0, 900, (200_000, 2))
    t = s @ np.array([[0.9, 0.2], [-0.2, 1.1]]) + 3.0
    t[::4] += 500
    tracemalloc.start()
    m, inlier = matching.fit_affine(s, t, 5.0, 5000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert m == pytest.approx(np.array([[0.9, -0.2, 3.0], [0.2, 1.1, 3.0]]), abs=1e-9) and inlier.sum() == 150_000
    assert peak < 100e6
