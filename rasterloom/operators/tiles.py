"""Rasters as tile rows (channel, ty, tx, data): one row holds a square of pixels, so that what
needs neighbourhoods moves tiles and not pixels, and works on whole arrays.

data are float64, little-endian, row by row; pixels that are not there are 0."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.affine import ENTRIES

TILE = "channel int, ty int, tx int, data binary"


def pack(pixels: DataFrame, size: int) -> DataFrame:
    """Tile rows of pixels (channel, y, x, v)."""

    def one(rows: pa.Table) -> pa.Table:
        data = np.zeros((size, size))
        y, x, v = (rows.column(c).to_numpy() for c in ("y", "x", "v"))
        data[y % size, x % size] = v
        place = {c: pa.array([rows.column(c)[0].as_py()], pa.int32()) for c in ("channel", "ty", "tx")}
        return pa.table(place | {"data": pa.array([data.tobytes()], pa.binary())})

    placed = pixels.select(F.col("channel").cast("int").alias("channel"), F.expr(f"int(y div {size})").alias("ty"), F.expr(f"int(x div {size})").alias("tx"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    return placed.groupBy("channel", "ty", "tx").applyInArrow(one, TILE)


def unpack(tiles: DataFrame, size: int, height: int, width: int) -> DataFrame:
    """Pixels (channel, y, x, v) of tile rows, inside the image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for channel, ty, tx, data in zip(*(b.column(k).to_pylist() for k in range(4))):
                h, w = min(size, height - ty * size), min(size, width - tx * size)
                if h <= 0 or w <= 0:
                    continue
                v = np.frombuffer(data).reshape(size, size)[:h, :w].ravel()
                y, x = np.divmod(np.arange(h * w), w)
                columns = [np.full(h * w, channel, np.int32), (y + ty * size).astype(np.int32), (x + tx * size).astype(np.int32), v]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["channel", "y", "x", "v"])

    return tiles.select("channel", "ty", "tx", "data").mapInArrow(run, "channel int, y int, x int, v double")


def _inverse(matrices: DataFrame) -> DataFrame:
    """(by, bx, b00 .. b12): each block's matrix backwards; null where a block has none."""
    m = matrices.withColumn("det", F.expr("nullif(a00 * a11 - a01 * a10, 0e0)"))
    parts = ("a11", "-a01", "a01 * a12 - a02 * a11", "-a10", "a00", "a02 * a10 - a00 * a12")
    return m.select("by", "bx", *[F.expr(f"({e}) / det").alias("b" + n[1:]) for n, e in zip(ENTRIES, parts)])


def _sampled(region: np.ndarray, sy: np.ndarray, sx: np.ndarray, nearest: bool) -> np.ndarray:
    """Values at places of a region, 0 outside."""

    def at(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        inside = (y >= 0) & (x >= 0) & (y < region.shape[0]) & (x < region.shape[1])
        return np.where(inside, region[np.clip(y, 0, region.shape[0] - 1), np.clip(x, 0, region.shape[1] - 1)], 0.0)

    if nearest:
        return at(np.floor(sy + 0.5).astype(np.int64), np.floor(sx + 0.5).astype(np.int64))
    y, x = np.floor(sy).astype(np.int64), np.floor(sx).astype(np.int64)
    fy, fx = sy - y, sx - x
    return at(y, x) * (1 - fy) * (1 - fx) + at(y, x + 1) * (1 - fy) * fx + at(y + 1, x) * fy * (1 - fx) + at(y + 1, x + 1) * fy * fx


def warped(tiles: DataFrame, matrices: DataFrame, channels: list[int], tile: int, block: int, nearest: bool = False) -> DataFrame:
    """Tile rows of size `block` on the grid of matrices (by, bx, a00 .. a12), each block through its own matrix.

    Matrices map the moving image to the grid, (x, y) to (x, y). A block asks for the source tiles
    that its corners reach, with a margin of a pixel, and meets them in an equi-join; only tiles move.
    Values are bilinear, or the nearest pixel's as for masks; 0 outside the image and in blocks
    without a matrix. A group holds one block and the tiles under it: a few, unless a matrix shrinks a lot."""
    back = _inverse(matrices)
    names = ["b" + n[1:] for n in ENTRIES]
    corner = lambda e: [f"({e[0]} * {x} + {e[1]} * {y} + {e[2]})" for x in (f"bx * {block}", f"(bx + 1) * {block}") for y in (f"by * {block}", f"(by + 1) * {block}")]
    xs, ys = (", ".join(corner(e)) for e in (names[:3], names[3:]))
    span = lambda v: f"if(greatest({v}) + 1 < 0 or b00 is null, array(-1), sequence(int(greatest(floor(least({v})) - 1, 0) div {tile}), int(ceil(greatest({v}) + 1) div {tile})))"
    asked = back.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    asked = asked.withColumn("ty", F.explode(F.expr(span(ys)))).withColumn("tx", F.explode(F.expr(span(xs))))
    met = asked.join(tiles, ["channel", "ty", "tx"], "left")

    def one(rows: pa.Table) -> pa.Table:
        first = {c: rows.column(c)[0].as_py() for c in ("channel", "by", "bx", *names)}
        out = np.zeros((block, block))
        got = [r for r in zip(*(rows.column(c).to_pylist() for c in ("ty", "tx", "data"))) if r[2] is not None]
        if got and first["b00"] is not None:
            y0, x0 = min(r[0] for r in got), min(r[1] for r in got)
            region = np.zeros(((max(r[0] for r in got) - y0 + 1) * tile, (max(r[1] for r in got) - x0 + 1) * tile))
            for ty, tx, data in got:
                region[(ty - y0) * tile : (ty - y0 + 1) * tile, (tx - x0) * tile : (tx - x0 + 1) * tile] = np.frombuffer(data).reshape(tile, tile)
            y, x = np.mgrid[first["by"] * block : (first["by"] + 1) * block, first["bx"] * block : (first["bx"] + 1) * block].astype(float)
            a, b, c, d, e, f = (first[n] for n in names)
            out = _sampled(region, x * d + y * e + f - y0 * tile, x * a + y * b + c - x0 * tile, nearest)
        place = {k: pa.array([first[c]], pa.int32()) for k, c in (("channel", "channel"), ("ty", "by"), ("tx", "bx"))}
        return pa.table(place | {"data": pa.array([np.ascontiguousarray(out).tobytes()], pa.binary())})

    return met.groupBy("channel", "by", "bx").applyInArrow(one, TILE)


# -- shifts between tiles --


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian of 4 sigma reach, the border mirrored with its pixel."""
    reach = (int(round(sigma * 8 + 1)) | 1) // 2
    weight = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    weight /= weight.sum()
    for axis in (0, 1):
        n = image.shape[axis]
        at = np.arange(-reach, n + reach) % (2 * n)
        padded = np.take(image, np.where(at < n, at, 2 * n - 1 - at), axis=axis)
        image = sum(w * np.take(padded, np.arange(k, k + n), axis=axis) for k, w in enumerate(weight))
    return image


def whitened(image: np.ndarray, sigma: float = 0.0) -> np.ndarray:
    """The four neighbours less four times the pixel, after a Gaussian where sigma is not 0."""
    smooth = gaussian(image, sigma) if sigma else image
    p = np.pad(smooth, 1, mode="symmetric")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * smooth


def moved(image: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """The image moved by a shift, bilinear, 0 where nothing comes from."""
    y, x = np.mgrid[: image.shape[0], : image.shape[1]].astype(float)
    return _sampled(image, y - dy, x - dx, False)


def correlation_surface(one: np.ndarray, two: np.ndarray, sigma: float = 0.0) -> np.ndarray:
    """The circular correlation of two whitened images for every shift, no shift in the middle, 1 for equal ones."""
    a, b = whitened(one, sigma), whitened(two, sigma)
    surface = np.abs(np.fft.ifft2(np.fft.fft2(a) * np.conj(np.fft.fft2(b))))
    norm = np.linalg.norm(a) * np.linalg.norm(b)
    return np.fft.fftshift(surface / norm if norm else surface)


def _refined(product: np.ndarray, dy: float, dx: float, upsample: int) -> tuple[float, float]:
    """The peak near a whole shift on a grid `upsample` times finer, by a small matrix Fourier transform."""
    reach = int(np.ceil(upsample * 1.5)) // 2
    sides = []
    for n, d in zip(product.shape, (dy, dx)):
        places = d + np.arange(-reach, reach + 1) / upsample
        sides.append((places, np.exp(2j * np.pi * np.outer(places, np.fft.fftfreq(n)))))
    fine = np.abs(sides[0][1] @ product @ sides[1][1].T)
    at = np.unravel_index(int(np.argmax(np.round(fine / max(fine.max(), 1e-300), 9))), fine.shape)
    return sides[0][0][at[0]], sides[1][0][at[1]]


def phase_shift(one: np.ndarray, two: np.ndarray, sigma: float = 0.0, upsample: int = 1) -> tuple[float, float, float] | None:
    """(dy, dx, error): the shift that lays the second image on the first; None where one is constant.

    The peak of the circular correlation leaves open from which side the second image comes, so
    all four are laid on and the one with the largest sum of products counts."""
    if one.min() == one.max() or two.min() == two.max():
        return None
    a, b = whitened(one, sigma), whitened(two, sigma)
    product = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    surface = np.abs(np.fft.ifft2(product))
    shape = np.array(a.shape)
    shift = np.array(np.unravel_index(int(np.argmax(np.round(surface, 6))), a.shape), dtype=float)
    shift = np.where(shift > shape // 2, shift - shape, shift)
    if upsample > 1:
        shift = np.array(_refined(product, *shift, upsample))
    high = (shift + shape) % shape
    best = None
    for dy in (high[0], high[0] - shape[0]):
        for dx in (high[1], high[1] - shape[1]):
            fit = abs(float((a * moved(b, dy, dx)).sum()))
            if best is None or fit > best[0] + 1e-9:
                best = (fit, dy, dx)
    norm = float(np.linalg.norm(a) * np.linalg.norm(b))
    error = -np.log(best[0] / norm) if best[0] > 0 and norm > 0 else np.inf
    return float(best[1]), float(best[2]), float(error)


def block_shifts(reference: DataFrame, moving: DataFrame, block: int, mask: DataFrame | None = None, sigma: float = 0.0, upsample: int = 1, flow: bool = False) -> DataFrame:
    """(by, bx, dy, dx, error) between tile rows of size `block` of two images, joined by their place.

    mask has (by, bx, inside); where inside is not true nothing is estimated. Without an estimate all
    three are null. For a flow, masked blocks have 0, 0, 0 and shifts are turned round."""
    sides = [t.select(F.col("ty").alias("by"), F.col("tx").alias("bx"), F.col("data").alias(n)) for t, n in ((reference, "one"), (moving, "two"))]
    pairs = sides[0].join(sides[1], ["by", "bx"])
    inside = F.lit(True)
    if mask is not None:
        pairs = pairs.join(mask.select("by", "bx", "inside"), ["by", "bx"], "left")
        inside = F.coalesce("inside", F.lit(False))
    pairs = pairs.select("by", "bx", inside.alias("inside"), F.when(inside, F.col("one")).alias("one"), F.when(inside, F.col("two")).alias("two"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for wanted, one, two in zip(*(b.column(k) for k in (2, 3, 4))):
                found = None
                if wanted.as_py():
                    found = phase_shift(*(np.frombuffer(d.as_py()).reshape(block, block) for d in (one, two)), sigma, upsample)
                    if found and flow:
                        found = (-found[0], -found[1], found[2])
                elif flow:
                    found = (0.0, 0.0, 0.0)
                for column, value in zip(out, found or (None, None, None)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.float64()) for c in out)], names=["by", "bx", "dy", "dx", "error"])

    return pairs.mapInArrow(run, "by int, bx int, dy double, dx double, error double")
