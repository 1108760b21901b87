"""Neighbourhoods on tile rows: a tile gets strips of its neighbours, once, and works on a whole array.

A pixel is sent to the one to four tiles around it that need it, not to every pixel of its neighbourhood."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tiles import TILE

#: A kernel takes a tile with its halo, which of its pixels are in the image, and gives the tile's values.
Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _pieces(size: int, reach: int):
    """Each tile's parts for itself and for the neighbours that they touch: (channel, ty, tx, y, x, h, w, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for channel, ty, tx, data in zip(*(b.column(k).to_pylist() for k in range(4))):
                tile = np.frombuffer(data).reshape(size, size)
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        if ty + dy < 0 or tx + dx < 0:
                            continue
                        # the neighbour at (dy, dx) needs my rows next to it, at these places of its padded array
                        rows = slice(0, reach) if dy < 0 else slice(size - reach, size) if dy > 0 else slice(0, size)
                        columns = slice(0, reach) if dx < 0 else slice(size - reach, size) if dx > 0 else slice(0, size)
                        part = tile[rows, columns]
                        y = reach + size if dy < 0 else 0 if dy > 0 else reach
                        x = reach + size if dx < 0 else 0 if dx > 0 else reach
                        for column, value in zip(out, (channel, ty + dy, tx + dx, y, x, *part.shape, np.ascontiguousarray(part).tobytes())):
                            column.append(value)
            kinds = [pa.int32()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["channel", "ty", "tx", "y", "x", "h", "w", "data"])

    return run


def stencil(tiles: DataFrame, size: int, reach: int, height: int, width: int, kernel: Kernel, border: str = "clip") -> DataFrame:
    """Tile rows of a kernel over each tile and its surroundings of `reach` pixels.

    border says what lies outside the image: nothing ("clip", told by the second array), the border pixel
    repeated ("edge"), the image mirrored with its border pixel ("symmetric") or about it ("reflect")."""
    if not 0 < reach <= size:
        raise ValueError("reach must be from 1 to the size of a tile")

    def one(rows: pa.Table) -> pa.Table:
        channel, ty, tx = (rows.column(c)[0].as_py() for c in ("channel", "ty", "tx"))
        whole = np.zeros((size + 2 * reach, size + 2 * reach))
        for y, x, h, w, data in zip(*(rows.column(c).to_pylist() for c in ("y", "x", "h", "w", "data"))):
            whole[y : y + h, x : x + w] = np.frombuffer(data).reshape(h, w)
        at = [np.arange(-reach, size + reach) + t * size for t in (ty, tx)]
        inside = np.logical_and.outer(*((p >= 0) & (p < n) for p, n in zip(at, (height, width))))
        if border != "clip":
            for axis, (p, n, t) in enumerate(zip(at, (height, width), (ty, tx))):
                if border == "edge":
                    source = np.clip(p, 0, n - 1)
                elif border == "symmetric":
                    turn = p % (2 * n)
                    source = np.where(turn < n, turn, 2 * n - 1 - turn)
                else:
                    turn = p % max(1, 2 * n - 2)
                    source = np.where(turn < n, turn, 2 * n - 2 - turn) if n > 1 else np.zeros_like(p)
                place = np.clip(source - t * size + reach, 0, size + 2 * reach - 1)  # what a whole tile of rest needs lies in reach
                whole = np.take(whole, place, axis=axis)
        found = np.asarray(kernel(whole, inside), dtype=float)
        found = np.where(inside[reach : reach + size, reach : reach + size], found, 0.0)
        place = {c: pa.array([v], pa.int32()) for c, v in (("channel", channel), ("ty", ty), ("tx", tx))}
        return pa.table(place | {"data": pa.array([np.ascontiguousarray(found).tobytes()], pa.binary())})

    parts = tiles.mapInArrow(_pieces(size, reach), "channel int, ty int, tx int, y int, x int, h int, w int, data binary")
    there = parts.filter(f"ty * {size} < {height} and tx * {size} < {width}")
    return there.groupBy("channel", "ty", "tx").applyInArrow(one, TILE)


def _shifted(whole: np.ndarray, reach: int) -> np.ndarray:
    """(places, h, w): the values at every place of the neighbourhood."""
    n = 2 * reach + 1
    return np.lib.stride_tricks.sliding_window_view(whole, (n, n)).reshape(whole.shape[0] - 2 * reach, whole.shape[1] - 2 * reach, n * n)


def median_kernel(reach: int) -> Kernel:
    return lambda whole, inside: np.median(_shifted(whole, reach), axis=-1)


def entropy_kernel(reach: int) -> Kernel:
    """Shannon entropy in bits of the values around each pixel, those outside the image left out."""
    n = 2 * reach + 1

    def counted(which: np.ndarray) -> np.ndarray:
        total = np.zeros((which.shape[0] + 1, which.shape[1] + 1))
        total[1:, 1:] = which.cumsum(axis=0).cumsum(axis=1)
        return total[n:, n:] - total[:-n, n:] - total[n:, :-n] + total[:-n, :-n]

    def run(whole: np.ndarray, inside: np.ndarray) -> np.ndarray:
        total = counted(inside.astype(float))
        weighted = np.zeros_like(total)
        for value in np.unique(whole[inside]):
            c = counted(((whole == value) & inside).astype(float))
            weighted += c * np.log2(np.maximum(c, 1))
        return np.log2(np.maximum(total, 1)) - weighted / np.maximum(total, 1)

    return run


def gaussian_weights(sigma: float) -> np.ndarray:
    """A Gaussian of four sigma reach, summing to 1."""
    reach = (int(round(sigma * 8 + 1)) | 1) // 2
    weight = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    return weight / weight.sum()


def whiten_kernel(sigma: float) -> tuple[int, Kernel]:
    """(reach, kernel): a Gaussian, then the four neighbours less four times the pixel; for a symmetric border."""
    weight = gaussian_weights(sigma)
    reach = len(weight) // 2 + 1

    def run(whole: np.ndarray, inside: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            n = whole.shape[axis] - len(weight) + 1
            whole = sum(w * np.take(whole, np.arange(k, k + n), axis=axis) for k, w in enumerate(weight))
        return whole[:-2, 1:-1] + whole[2:, 1:-1] + whole[1:-1, :-2] + whole[1:-1, 2:] - 4 * whole[1:-1, 1:-1]

    return reach, run


#: The five weights of one step of a Gaussian pyramid (fixed values).
STEP = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)


def smooth_kernel(whole: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The 5 x 5 smoothing of a Gaussian pyramid, for a border reflected about its pixel; reach 2."""
    for axis in (0, 1):
        n = whole.shape[axis] - 4
        whole = sum(w * np.take(whole, np.arange(k, k + n), axis=axis) for k, w in enumerate(STEP))
    return whole
