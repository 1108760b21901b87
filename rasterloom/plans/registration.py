"""The search for the affine map between two thumbnails: hypotheses, pooled matches, robust fits.

Images are pixels (y, x, v) of one size; maps go from the right (moving) to the left (reference) image."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.affine import ENTRIES
from ..functions.geometry import flip, rotation
from ..lineage import cut
from ..operators import keypoints, masks, matching, stencil

VARIANTS = ("otsu", "triangle", "matched", "whitened")


@dataclass
class Found:
    """A map (a00 .. a12), how many matches agree with it, and the hypothesis that it was found under."""

    matrix: tuple[float, ...]
    inliers: int
    hypothesis: tuple


def _array(matrix: tuple[float, ...]) -> np.ndarray:
    return np.vstack([np.array(matrix, dtype=float).reshape(2, 3), [0, 0, 1]])


def turned(image: DataFrame, height: int, width: int, flipped: bool, quarter: int) -> DataFrame:
    """The image with its rows turned round, then turned by quarters against the clock; square where quarters are odd."""
    y, x = (F.lit(height - 1) - F.col("y") if flipped else F.col("y")), F.col("x")
    h, w = height, width
    for _ in range(quarter % 4):
        y, x, h, w = F.lit(w - 1) - x, y, w, h
    return image.select(y.cast("int").alias("y"), x.cast("int").alias("x"), "v")


def turning(height: int, width: int, flipped: bool, quarter: int) -> tuple[float, ...]:
    """The matrix of turned()."""
    m = _array(rotation(quarter, height, width)) @ (_array(flip(0, height, width)) if flipped else np.eye(3))
    return tuple(m[:2].ravel())


def _matches(rows: DataFrame, height: int, width: int, n: int) -> DataFrame:
    return cut(keypoints.matched(keypoints.keypoints(keypoints.pictures(rows, height, width), height, width, n)))


def _row(image: DataFrame, config: int, variant: str, side: int) -> DataFrame:
    return image.select(F.lit(config).alias("config"), F.lit(variant).alias("variant"), F.lit(side).alias("side"), "y", "x", F.col("v").cast("double").alias("v"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _bright(image: DataFrame, height: int, width: int) -> bool:
    mask = masks.entropy_mask(image, height, width)
    ends = image.join(mask, ["y", "x"]).agg(F.percentile(F.when(F.col("inside"), F.col("v")), F.lit(0.5)).alias("a"), F.percentile(F.when(~F.col("inside"), F.col("v")), F.lit(0.5)).alias("b")).first()
    return ends.a is not None and ends.b is not None and ends.a < ends.b


def pooled(left: DataFrame, rights: dict[int, DataFrame], height: int, width: int, n: int = 1000, invert: bool = True, reach: float = 5.0) -> DataFrame:
    """(config, a00 .. a12, inliers, matches) of each right image: matches of four variants of the pair, fitted together."""
    bright = _bright(left, height, width)
    parts = []
    for config, right in sorted(rights.items()):
        pair = masks.image_pairs(left, right, height, width, (bright, _bright(right, height, width)), invert)
        parts.append(pair.withColumn("config", F.lit(config)))
    found = _matches(_union(parts), height, width, n)
    fitted = matching.robust_affine(found.select("config", "sx", "sy", "tx", "ty"), reach)
    every = left.sparkSession.createDataFrame([(int(k),) for k in sorted(rights)], "config long")
    return every.join(fitted, "config", "left").fillna(0, ["inliers", "matches"])


def _best(fits: DataFrame, fold: float) -> tuple[int, int, bool, tuple[float, ...] | None]:
    """Of a few hypotheses: the best one, its inliers, whether they are `fold` times the others', its matrix."""
    best = matching.best_configuration(fits.select("config", "inliers"), fold).first()
    row = fits.filter(F.col("config") == best.config).first()
    return best.config, best.inliers, best.accepted, None if row.a00 is None else tuple(row[e] for e in ENTRIES)


def search_configuration(left: DataFrame, right: DataFrame, height: int, width: int, size: int = 500, n: int = 2000, fold: float = 5.0, masked: bool = True) -> tuple[tuple[str, int, bool], int]:
    """((side adjusted, sign of intensities, rows turned round), inliers) of the best of eight hypotheses.

    They are tried on images of about `size`; where none stands out, on images twice as large, up to the full ones."""
    configs = [(which, scalar, flipped) for which in ("right", "left") for scalar in (1, -1) for flipped in (False, True)]
    while True:
        factor = max(1, -(-max(height, width) // size))
        h, w = -(-height // factor), -(-width // factor)
        small = [cut(stencil.downscaled_mean(i, factor, height, width).withColumn("v", F.rint("v").cast("int"))) if factor > 1 else i for i in (left, right)]
        inside = [masks.entropy_mask(i, h, w) if masked else i.select("y", "x", F.lit(True).alias("inside")) for i in small]
        rows = []
        for k, (which, scalar, flipped) in enumerate(configs):
            pair = masks.configured_pair(*small, *inside, which, scalar, flipped, h)
            rows += [_row(image, k, "matched", side) for side, image in enumerate(pair)]
        fits = matching.robust_affine(_matches(_union(rows), h, w, n).select("config", "sx", "sy", "tx", "ty"), 5.0)
        every = left.sparkSession.createDataFrame([(k,) for k in range(len(configs))], "config long")
        config, inliers, accepted, _ = _best(cut(every.join(fits, "config", "left").fillna(0, ["inliers", "matches"])), fold)
        if accepted or factor == 1:
            return configs[config], inliers
        size *= 2


def search_then_register(left: DataFrame, right: DataFrame, height: int, width: int, size: int = 2000, n: int = 5000, masked: bool = True, search: dict | None = None) -> Found:
    """The map of the whole images under the best hypothesis; the identity where nothing matches."""
    factor = max(1, -(-max(height, width) // size))
    h, w = -(-height // factor), -(-width // factor)
    small = [cut(stencil.downscaled_mean(i, factor, height, width).withColumn("v", F.rint("v").cast("int"))) if factor > 1 else i for i in (left, right)]
    config, _ = search_configuration(*small, h, w, **(search or {}), masked=masked)
    inside = [masks.entropy_mask(i, h, w) if masked else i.select("y", "x", F.lit(True).alias("inside")) for i in small]
    pair = [cut(i.withColumn("v", F.rint("v").cast("int"))) for i in masks.configured_pair(*small, *inside, *config, h)]
    _, inliers, _, matrix = _best(cut(pooled(pair[0], {0: pair[1]}, h, w, n, invert=False)), 1.0)
    whole = _array(matrix or (1, 0, 0, 0, 1, 0)) @ (_array(flip(0, h, w)) if config[2] else np.eye(3))
    scale = np.diag([factor, factor, 1.0])
    return Found(tuple((scale @ whole @ np.linalg.inv(scale))[:2].ravel()), inliers, config)


def feature_registration(left: DataFrame, right: DataFrame, height: int, width: int, test_flip: bool = False, test_invert: bool = False, n: int = 1000, size: int = 500, reach: float = 5.0) -> Found:
    """The map of two thumbnails, after a test of whether rows or intensities of the right one are turned round."""
    flipped, scalar = False, 1
    negative = lambda i, k: i.select("y", "x", (F.col("v") * k).alias("v"))
    if test_flip or test_invert:
        factor = max(1, max(height, width) // size)
        h, w = -(-height // factor), -(-width // factor)
        small = [cut(stencil.downscaled_mean(i, factor, height, width).withColumn("v", F.rint("v").cast("int"))) if factor > 1 else i for i in (left, right)]
        tried = [(f, k) for f in ((False, True) if test_flip else (False,)) for k in ((1, -1) if test_invert else (1,))]
        rights = {i: negative(turned(small[1], h, w, f, 0), k) for i, (f, k) in enumerate(tried)}
        best = _best(cut(pooled(small[0], rights, h, w, n, invert=False)), 1.0)[0]
        flipped, scalar = tried[best]
    moving = negative(turned(right, height, width, flipped, 0), scalar)
    _, inliers, _, matrix = _best(cut(pooled(left, {0: moving}, height, width, n, invert=not test_invert, reach=reach)), 1.0)
    whole = _array(matrix or (1, 0, 0, 0, 1, 0)) @ (_array(flip(0, height, width)) if flipped else np.eye(3))
    return Found(tuple(whole[:2].ravel()), inliers, (flipped, scalar))


def flip_and_quarter(left: DataFrame, right: DataFrame, side: int, n: int = 1000) -> Found:
    """Of eight ways to turn a square right image, the one with most matches, and its matrix."""
    ways = [(f, q) for f in (False, True) for q in range(4)]
    rights = {k: turned(right, side, side, f, q) for k, (f, q) in enumerate(ways)}
    best, inliers, _, _ = _best(cut(pooled(left, rights, side, side, n)), 1.0)
    return Found(turning(side, side, *ways[best]), inliers, ways[best])
