"""Robust affine maps from matched points, and the choice among orientations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.affine import ENTRIES
from ..lineage import cut

#: A match: the point sx, sy is mapped on tx, ty.
_PLACE = ("sx", "sy", "tx", "ty")
_KIND = "config long, a00 double, a01 double, a02 double, a10 double, a11 double, a12 double, inliers long, matches long"


def _least_squares(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    ones = np.column_stack([src, np.ones(len(src))])
    return np.linalg.lstsq(ones, dst, rcond=None)[0].T


#: Maps tried at once, and matches that they are tried on at once.
_TRIED, _STRIP = 256, 1024
#: Matches of one configuration from which on they are spread over tasks.
LARGE = 65536


def _within(src: np.ndarray, dst: np.ndarray, maps: np.ndarray, reach: float) -> np.ndarray:
    """(maps, matches): which matches each map (3 x 2) brings within reach. Sums are spelled out, so that strips do not change them."""
    x, y = (maps[:, 0, k, None] * src[:, 0] + maps[:, 1, k, None] * src[:, 1] + maps[:, 2, k, None] - dst[:, k] for k in (0, 1))
    return x * x + y * y <= reach * reach


def _counts(src: np.ndarray, dst: np.ndarray, maps: np.ndarray, reach: float) -> np.ndarray:
    """How many matches each map brings within reach, a strip of them at a time."""
    return sum((_within(src[k : k + _STRIP], dst[k : k + _STRIP], maps, reach).sum(axis=1) for k in range(0, len(src), _STRIP)), np.zeros(len(maps), dtype=np.int64))


class _Search:
    """Triples of n matches drawn with a fixed seed, in batches, and the best map so far."""

    def __init__(self, n: int, tries: int, seed: int = 0) -> None:
        self.n, self.tries, self.at, self.most, self.best = n, tries, 0, 2, None
        self.rng, self.open = np.random.default_rng(seed), n >= 3 and tries > 0

    def draw(self) -> np.ndarray:
        """The places of the next triples."""
        self.triple = self.rng.integers(0, self.n, (min(_TRIED, self.tries - self.at), 3))
        return self.triple

    def maps(self, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        """The maps (3 x 2) of the drawn triples that are no lines; src and dst are (triples, 3, 2)."""
        corner = np.concatenate([src, np.ones((*src.shape[:2], 1))], axis=2)
        usable = np.abs(np.linalg.det(corner)) > 1e-9
        self.tried = np.linalg.solve(corner[usable], dst[usable])
        return self.tried

    def counted(self, counts: np.ndarray) -> None:
        """Takes how many matches each map brings within reach."""
        seen, self.at = self.at + len(self.triple), self.at + _TRIED
        self.open = self.at < self.tries
        if len(counts):
            k = int(counts.argmax())
            if counts[k] > self.most:
                self.most, self.best = int(counts[k]), self.tried[k]
            self.open &= (1 - (self.most / self.n) ** 3) ** seen >= 1e-9


def fit_affine(src: np.ndarray, dst: np.ndarray, reach: float, tries: int, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """(2 x 3 matrix or None, inlier mask) of the map that brings most of src within reach of dst.

    Triples are drawn with a fixed seed and tried in batches; the best is fitted again to its inliers. Maps are tried on
    strips of the matches, so what is held besides the matches does not grow with them."""
    search = _Search(len(src), tries, seed)
    while search.open:
        triple = search.draw()
        search.counted(_counts(src, dst, search.maps(src[triple], dst[triple]), reach))
    if search.best is None:
        return None, np.zeros(len(src), dtype=bool)
    inlier = _within(src, dst, search.best[None], reach)[0]
    return _least_squares(src[inlier], dst[inlier]), inlier


def robust_affine(matches: DataFrame, reach: float = 30.0, tries: int = 5000) -> DataFrame:
    """(config, a00..a12, inliers, matches) of matches (config, sx, sy, tx, ty): s is mapped on t.

    Under three matches, or all on a line: null matrix and no inliers. A task holds the matches of one configuration:
    for those of thumbnails, bounded by the number of keypoints. spread_robust_affine has no such bound."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["sx", "sy", "tx", "ty"])
        m, inlier = fit_affine(rows[["sx", "sy"]].to_numpy(float), rows[["tx", "ty"]].to_numpy(float), reach, tries)
        entries = [None] * 6 if m is None else m.ravel().tolist()
        return pd.DataFrame([[key[0], *entries, int(inlier.sum()), len(rows)]], columns=["config", *ENTRIES, "inliers", "matches"])

    return _usable(matches).groupBy("config").applyInPandas(run, _KIND)


def _usable(matches: DataFrame) -> DataFrame:
    known = matches.dropna(subset=["config", *_PLACE])
    return known.select(F.col("config").cast("long").alias("config"), *[F.col(c).cast("double").alias(c) for c in _PLACE])


def _by_config(batches: Iterator[pa.RecordBatch], wanted: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(config, ids, src, dst) of batches (config, sx, sy, tx, ty, id), of the configurations wanted."""
    for b in batches:
        config, *place, ids = (b.column(k).to_numpy() for k in range(6))
        for c in np.unique(config).tolist():
            if c in wanted:
                own = config == c
                yield c, ids[own], *(np.stack([p[own] for p in pair], axis=1) for pair in (place[:2], place[2:]))


def _drawn(placed: DataFrame, wanted: dict[int, np.ndarray]) -> dict[int, dict[int, tuple]]:
    """(sx, sy, tx, ty) by configuration and id of those matches whose ids are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for config, ids, src, dst in _by_config(batches, wanted):
            hit = np.isin(ids, wanted[config])
            columns = [np.full(hit.sum(), config), ids[hit], *src[hit].T, *dst[hit].T]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["config", "id", *_PLACE])

    out: dict[int, dict[int, tuple]] = {c: {} for c in wanted}
    for r in placed.mapInArrow(run, "config long, id long, sx double, sy double, tx double, ty double").collect():
        out[r.config][r.id] = tuple(r)[2:]
    return out


def _counted(placed: DataFrame, maps: dict[int, np.ndarray], reach: float) -> dict[int, np.ndarray]:
    """How many matches each map of each configuration brings within reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for config, _, src, dst in _by_config(batches, maps):
            total[config] = total.get(config, 0) + _counts(src, dst, maps[config], reach)
        for config, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), config)), pa.array(np.arange(len(n))), pa.array(n)], names=["config", "k", "n"])

    out = {c: np.zeros(len(m), dtype=np.int64) for c, m in maps.items()}
    for r in placed.mapInArrow(run, "config long, k long, n long").groupBy("config", "k").agg(F.sum("n").alias("n")).collect():
        out[r.config][r.k] = r.n
    return out


def _fitted(placed: DataFrame, best: dict[int, np.ndarray], reach: float) -> dict[int, tuple[np.ndarray, int]]:
    """(2 x 3 matrix, inliers) by least squares over the inliers of each configuration's best map, from a triangle (QR) of each task's inliers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, int]] = {}
        for config, _, src, dst in _by_config(batches, best):
            inlier = _within(src, dst, best[config][None], reach)[0]
            above, n = held.get(config, (np.zeros((0, 5)), 0))
            rows = np.column_stack([src[inlier], np.ones(inlier.sum()), dst[inlier]])
            held[config] = np.linalg.qr(np.vstack([above, rows]), mode="r"), n + len(rows)
        for config, (triangle, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([config]), pa.array([n]), pa.array([np.ascontiguousarray(triangle).tobytes()])], names=["config", "n", "triangle"])

    parts: dict[int, list] = {c: [] for c in best}
    for r in placed.mapInArrow(run, "config long, n long, triangle binary").collect():
        parts[r.config].append((r.n, np.frombuffer(r.triangle).reshape(-1, 5)))
    out = {}
    for config, found in parts.items():
        n, rows = sum(k for k, _ in found), np.vstack([t for _, t in found])
        out[config] = np.linalg.lstsq(rows[:, :3], rows[:, 3:], rcond=np.finfo(float).eps * max(n, 3))[0].T, n
    return out


def spread_robust_affine(matches: DataFrame, reach: float = 30.0, tries: int = 5000) -> DataFrame:
    """robust_affine for any number of matches: those of a configuration with more than LARGE are spread over tasks.

    They are dealt out in order and kept once, the same triples are drawn by their places in that order, and each
    batch of maps is counted by all tasks. A task streams its part; the driver holds the drawn triples and a row a
    configuration and task. There is one large configuration in LARGE matches at most."""
    usable = _usable(matches)
    sizes = {r.config: r.n for r in usable.groupBy("config").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE).collect()}
    if not sizes:
        return robust_affine(usable, reach, tries)
    large = F.col("config").isin([*sizes])
    order = ["config", *_PLACE]
    placed = cut(usable.filter(large).repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("id", F.monotonically_increasing_id())
    parts: dict[int, list] = {c: [] for c in sizes}
    for first, config, n in sorted(tuple(r) for r in placed.groupBy("config", F.spark_partition_id().alias("part")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).select("first", "config", "n").collect()):
        parts[config].append((first, n))
    first, upto = ({c: f(np.array(p, dtype=np.int64)) for c, p in parts.items()} for f in (lambda p: p[:, 0], lambda p: np.cumsum(p[:, 1])))
    search = {c: _Search(n, tries) for c, n in sizes.items()}
    while going := {c: s for c, s in search.items() if s.open}:
        ids = {}
        for c, s in going.items():
            at = s.draw()
            part = np.searchsorted(upto[c], at, side="right")
            ids[c] = first[c][part] + at - np.where(part > 0, upto[c][part - 1], 0)
        got = _drawn(placed, {c: np.unique(i) for c, i in ids.items()})
        corner = {c: np.array([[got[c][k] for k in triple] for triple in i.tolist()]) for c, i in ids.items()}
        maps = {c: s.maps(corner[c][..., :2], corner[c][..., 2:]) for c, s in going.items()}
        counts = _counted(placed, maps, reach)
        for c, s in going.items():
            s.counted(counts[c])
    found = _fitted(placed, {c: s.best for c, s in search.items() if s.best is not None}, reach)
    rows = [(c, *(found[c][0].ravel().tolist() if c in found else [None] * 6), found[c][1] if c in found else 0, n) for c, n in sizes.items()]
    return robust_affine(usable.filter(~large), reach, tries).unionByName(matches.sparkSession.createDataFrame(rows, _KIND))


def best_configuration(counts: DataFrame, fold: float = 5.0) -> DataFrame:
    """(config, inliers, ratio, accepted) of counts (config, inliers): the first of the largest.

    ratio is the largest count over the mean of those strictly under it, null where none is."""
    every = Window.partitionBy()  # one row for each orientation tried: eight of them
    ranked = counts.select("config", "inliers", F.max("inliers").over(every).alias("most"))
    rest = F.avg(F.when(F.col("inliers") < F.col("most"), F.col("inliers")))
    best = ranked.agg(F.min_by("config", F.struct(-F.col("inliers"), F.col("config"))).alias("config"), F.max("most").alias("inliers"), rest.alias("rest"))
    ratio = F.try_divide(F.col("inliers").cast("double"), F.col("rest"))
    return best.select("config", "inliers", ratio.alias("ratio"), F.coalesce(ratio > fold, F.lit(False)).alias("accepted"))
