"""Whole blocks of a raster that comes as whole rows (y, v array): a strip of rows is worked on as one array,
so that what moves is each row once, and what is found in a block, and never a row a pixel and shift."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Blocks that a strip is high.
HIGH = 16

#: A kernel takes whole blocks, n of them with p = size * size pixels each: by, bx (n); iy, ix, w and which w are known (n, p).
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.Table]


def _edges(rows: DataFrame) -> DataFrame:
    """(s, x, above, below): for each strip and column, the pixels next to it in the strips around it that have the column.

    The window has a row for each strip and column, not for each pixel."""
    pixels = rows.select("s", "y", F.posexplode("v").alias("x", "v"))
    ends = pixels.groupBy("s", "x").agg(F.min_by("v", "y").alias("first"), F.max_by("v", "y").alias("last"))
    along = Window.partitionBy("x").orderBy("s")
    return ends.select("s", "x", F.lag("last").over(along).alias("above"), F.lead("first").over(along).alias("below"))


def _whitened(v: pa.ListArray, edges: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(w, there, known) of rows from top to bottom: the four neighbours less four times the pixel, a missing
    neighbour being the pixel itself. Above and below a pixel are the nearest rows that have its column."""
    length = v.value_lengths().to_numpy(zero_copy_only=False)
    n, width = len(length), int(length.max(initial=0))
    there = np.ones((n + 2, width), dtype=bool)
    there[1:-1] = np.arange(width) < length[:, None]
    flat, value, known = v.flatten(), np.zeros((n + 2, width), dtype=np.int64), np.zeros((n + 2, width), dtype=bool)
    body = there[1:-1]
    value[1:-1][body], known[1:-1][body] = flat.fill_null(0).to_numpy(), flat.is_valid().to_numpy(zero_copy_only=False)
    x = edges["x"].to_numpy()
    for k, side in ((0, "above"), (-1, "below")):
        got = edges[side].combine_chunks()
        value[k, x], known[k, x] = got.fill_null(0).to_numpy(), got.is_valid().to_numpy(zero_copy_only=False)
    own, column, row = value[1:-1], np.arange(width), np.arange(n + 2)[:, None]
    up = np.maximum.accumulate(np.where(there, row, 0), axis=0)[:-2]
    down = np.minimum.accumulate(np.where(there, row, n + 1)[::-1], axis=0)[::-1][2:]
    w = -4 * own
    for at in (up, down):
        w += np.where(known[at, column], value[at, column], own)
    sure = known[1:-1]
    for near, beside in ((np.s_[:, 1:], np.s_[:, :-1]), (np.s_[:, :-1], np.s_[:, 1:])):
        neighbour = own.copy()
        neighbour[near] = np.where(sure[beside], own[beside], own[near])
        w += neighbour
    return w, body, sure


def over_whitened_blocks(rows: DataFrame, size: int, kernel: Kernel, schema: str) -> DataFrame:
    """What a kernel finds in the whitened blocks that have all their size * size pixels; rows are (y, v array<int>).

    A task holds one strip of HIGH * size rows at a time. Blocks are cut at multiples of size, towards 0."""
    strip = F.expr(f"y div {HIGH * size}")
    rows = rows.filter("y is not null and v is not null").select(strip.alias("s"), "y", "v")

    def one(held: pa.Table, edges: pa.Table) -> pa.Table:
        held = held.sort_by("y")
        y = held["y"].to_numpy().astype(np.int64)
        w, there, known = _whitened(held["v"].combine_chunks(), edges)
        by, iy = np.trunc(y / size).astype(np.int64), np.fmod(y, size)
        found: list[list] = [[] for _ in range(6)]
        starts = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
        for low, high in zip(starts, np.r_[starts[1:], len(by)]):
            for bx in range(-(-w.shape[1] // size)):
                part = np.s_[low:high, bx * size : (bx + 1) * size]
                k, ix = np.nonzero(there[part])
                if len(k) == size * size:
                    for column, values in zip(found, (by[low], bx, iy[low:high][k], ix, w[part][k, ix], known[part][k, ix])):
                        column.append(values)
        return kernel(*(np.array(c).reshape(len(c), -1) if k > 1 else np.array(c, dtype=np.int64) for k, c in enumerate(found))) if found[0] else nothing

    nothing = _empty(rows.sparkSession, schema)
    return rows.groupBy("s").cogroup(_edges(rows).groupBy("s")).applyInArrow(one, schema)


def _empty(spark, schema: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema).empty_table()


def laid_out(iy: np.ndarray, ix: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """(n, size, size): the values (n, p) summed at their places; those at places outside are left out."""
    inside = (iy >= 0) & (ix >= 0)
    out = np.zeros((len(iy), size * size + 1), dtype=np.int64)
    np.add.at(out, (np.arange(len(iy))[:, None], np.where(inside, iy * size + ix, size * size)), value)
    return out[:, :-1].reshape(-1, size, size)
