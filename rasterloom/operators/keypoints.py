"""Keypoints of thumbnails, their binary descriptors and mutual matches: corners, oriented by where
their surroundings are brighter, described by 256 comparisons turned with them.

A thumbnail is one row and fits a task; images, hypotheses and variants are worked on side by side."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import fit_affine

#: Half the side of a described patch, and the radius over which brightness gives the direction.
PATCH, RADIUS = 18, 15
LEVELS = 3
_STRIP = 512
POINTS = "config long, variant string, side int, x double, y double, c0 long, c1 long, c2 long, c3 long"
MATCHES = "config long, variant string, sx double, sy double, tx double, ty double"


@lru_cache(maxsize=1)
def _pattern() -> np.ndarray:
    """256 pairs of places in a patch, dense in its middle, from a fixed seed."""
    return np.clip(np.random.default_rng(11).normal(0, PATCH / 2.5, (256, 2, 2)), -PATCH + 5, PATCH - 5)


def _box(image: np.ndarray, reach: int) -> np.ndarray:
    """Means over squares, the border mirrored."""
    p = np.pad(image, reach, mode="symmetric")
    total = np.zeros((p.shape[0] + 1, p.shape[1] + 1))
    total[1:, 1:] = p.cumsum(axis=0).cumsum(axis=1)
    n = 2 * reach + 1
    return (total[n:, n:] - total[:-n, n:] - total[n:, :-n] + total[:-n, :-n]) / (n * n)


def _corners(image: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x, strength) of the n strongest corners that no neighbour outdoes."""
    gy, gx = np.gradient(image)
    yy, xx, yx = (_box(g, 2) for g in (gy * gy, gx * gx, gy * gx))
    strength = yy * xx - yx * yx - 0.04 * (yy + xx) ** 2
    p = np.pad(strength, 1, constant_values=-np.inf)
    around = np.lib.stride_tricks.sliding_window_view(p, (3, 3)).max(axis=(2, 3))
    y, x = np.nonzero((strength >= around) & (strength > 1e-9 * max(1e-300, strength.max())))
    order = np.lexsort((x, y, -strength[y, x]))[:n]
    return y[order], x[order], strength[y[order], x[order]]


def described(image: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """((k, 2) places x, y; (k, 4) words of 64 bits) of about n keypoints over LEVELS halved levels."""
    low, high = float(image.min()), float(image.max())
    places, codes = [], []
    level = (image - low) * (255 / (high - low)) if high > low else np.zeros_like(image, dtype=float)
    for k in range(LEVELS):
        if min(level.shape) < 8 or high == low:
            break
        y, x, _ = _corners(level, max(1, int(n * 0.5 ** (k + (k < LEVELS - 1)))))
        pad = PATCH + 2
        smooth = np.pad(_box(level, 2), pad, mode="symmetric")
        flat = np.pad(level, pad, mode="symmetric")
        r = np.arange(-RADIUS, RADIUS + 1)
        disc = (r[:, None] ** 2 + r[None, :] ** 2) <= RADIUS**2
        dy, dx = (g[disc] for g in np.meshgrid(r, r, indexing="ij"))
        for at in range(0, len(y), _STRIP):
            cy, cx = y[at : at + _STRIP] + pad, x[at : at + _STRIP] + pad
            around = flat[cy[:, None] + dy, cx[:, None] + dx]
            angle = np.arctan2((around * dy).sum(axis=1), (around * dx).sum(axis=1))
            cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            py, px = _pattern()[None, :, :, 0], _pattern()[None, :, :, 1]
            oy, ox = (np.rint(v).astype(int) for v in (px * sin + py * cos, px * cos - py * sin))
            values = smooth[cy[:, None, None] + np.clip(oy, -pad + 1, pad - 1), cx[:, None, None] + np.clip(ox, -pad + 1, pad - 1)]
            codes.append(np.packbits(values[:, :, 0] < values[:, :, 1], axis=1).view(np.int64))
        places.append(np.stack([x, y], axis=1) * float(1 << k) + ((1 << k) - 1) / 2)
        h, w = level.shape[0] // 2 * 2, level.shape[1] // 2 * 2
        level = level[:h, :w].reshape(h // 2, 2, w // 2, 2).mean(axis=(1, 3))
    if not places:
        return np.zeros((0, 2)), np.zeros((0, 4), dtype=np.int64)
    return np.concatenate(places), np.concatenate(codes)


def pictures(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """(config, variant, side, data): whole images of pixels (config, variant, side, y, x, v)."""

    def one(rows: pa.Table) -> pa.Table:
        data = np.zeros((height, width))
        y, x, v = (rows.column(c).to_numpy() for c in ("y", "x", "v"))
        data[y, x] = v
        place = {"config": pa.int64(), "variant": pa.string(), "side": pa.int32()}
        return pa.table({c: pa.array([rows.column(c)[0].as_py()], t) for c, t in place.items()} | {"data": pa.array([data.tobytes()], pa.binary())})

    whole = pixels.select(F.col("config").cast("long").alias("config"), "variant", F.col("side").cast("int").alias("side"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    return whole.groupBy("config", "variant", "side").applyInArrow(one, "config long, variant string, side int, data binary")


def keypoints(images: DataFrame, height: int, width: int, n: int = 2000) -> DataFrame:
    """(config, variant, side, x, y, c0 .. c3) of images as of pictures()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for config, variant, side, data in zip(*(b.column(k).to_pylist() for k in range(4))):
                place, code = described(np.frombuffer(data).reshape(height, width), n)
                own = [pa.array([v] * len(place), t) for v, t in ((config, pa.int64()), (variant, pa.string()), (side, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(place[:, k]) for k in (0, 1)), *(pa.array(code[:, k]) for k in range(4))], names=["config", "variant", "side", "x", "y", "c0", "c1", "c2", "c3"])

    return images.select("config", "variant", "side", "data").mapInArrow(run, POINTS)


def _nearest(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For each code of one the place of its nearest in two, the first of equals."""
    out = np.zeros(len(one), dtype=np.int64)
    for k in range(0, len(one), _STRIP):
        d = np.bitwise_count((one[k : k + _STRIP, None, :] ^ two[None, :, :]).view(np.uint64)).sum(axis=2, dtype=np.int32)
        out[k : k + _STRIP] = d.argmin(axis=1)
    return out


def matched(points: DataFrame, reach: float = 30.0, tries: int = 5000) -> DataFrame:
    """(config, variant, sx, sy, tx, ty): mutual nearest keypoints of side 1 (s) and side 0 (t), of those
    only what one affine map brings within reach. A group is one pair of images."""

    def one(rows: pa.Table) -> pa.Table:
        side = rows.column("side").to_numpy()
        place = np.stack([rows.column(c).to_numpy() for c in ("x", "y")], axis=1)
        code = np.stack([rows.column(f"c{k}").to_numpy() for k in range(4)], axis=1)
        order = np.lexsort((place[:, 0], place[:, 1]))
        place, code, side = place[order], code[order], side[order]
        t, s = (np.flatnonzero(side == k) for k in (0, 1))
        found = np.zeros((0, 4))
        if len(t) and len(s):
            forth, back = _nearest(code[s], code[t]), _nearest(code[t], code[s])
            both = np.flatnonzero(back[forth] == np.arange(len(s)))
            found = np.concatenate([place[s[both]], place[t[forth[both]]]], axis=1)
            found = found[fit_affine(found[:, :2], found[:, 2:], reach, tries)[1]]
        own = [pa.array([rows.column(c)[0].as_py()] * len(found), k) for c, k in (("config", pa.int64()), ("variant", pa.string()))]
        return pa.Table.from_arrays([*own, *(pa.array(found[:, k]) for k in range(4))], names=["config", "variant", "sx", "sy", "tx", "ty"])

    return points.groupBy("config", "variant").applyInArrow(one, MATCHES)
