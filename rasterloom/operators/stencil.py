"""Neighbourhood and downscaling operators. Windows run along single rows or columns of an image,
so their partitions are one image line long and their number grows with the image."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import halo, tiles
from .resample import warp_bilinear


def laplacian(pixels: DataFrame) -> DataFrame:
    """Sum of the four neighbours less four times the pixel; the border pixel is its own neighbour."""
    v, lines = F.col("v"), (Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y"))
    near = [F.coalesce(f("v").over(w), v) for w in lines for f in (F.lag, F.lead)]
    return pixels.select("y", "x", (near[0] + near[1] + near[2] + near[3] - 4 * v).cast("int").alias("w"))


def blocks_mean(pixels: DataFrame, factor: int, height: int | None = None, width: int | None = None) -> DataFrame:
    """Mean of each factor x factor block; with a size, rows and columns that fill no block go."""
    if height is not None and width is not None:
        pixels = pixels.filter((F.col("y") < height // factor * factor) & (F.col("x") < width // factor * factor))
    by, bx = F.floor(F.col("y") / factor).cast("int"), F.floor(F.col("x") / factor).cast("int")
    return pixels.groupBy(by.alias("y"), bx.alias("x")).agg(F.avg("v").alias("v"))


def coarsened(pixels: DataFrame, factor: int, height: int, width: int) -> DataFrame:
    """blocks_mean cut to whole blocks and truncated to integers."""
    return blocks_mean(pixels, factor, height, width).withColumn("v", F.col("v").cast("int"))


def strided(pixels: DataFrame, factor: int) -> DataFrame:
    """Every factor-th pixel of every factor-th row: nearest downscaling, as for masks."""
    kept = pixels.filter((F.col("y") % factor == 0) & (F.col("x") % factor == 0))
    return kept.select((F.col("y") / factor).cast("int").alias("y"), (F.col("x") / factor).cast("int").alias("x"), "v")


#: Side of the tiles that neighbourhoods are worked out on.
SIDE = 256


def _over_tiles(pixels: DataFrame, reach: int, height: int, width: int, kernel: halo.Kernel, border: str, side: int) -> DataFrame:
    packed = tiles.pack(pixels.select(F.lit(0).alias("channel"), "y", "x", "v"), side)
    return tiles.unpack(halo.stencil(packed, side, reach, height, width, kernel, border), side, height, width).select("y", "x", "v")


def median3(pixels: DataFrame, height: int, width: int, side: int = SIDE) -> DataFrame:
    """Median of the 3 x 3 neighbourhood, the border repeated outwards."""
    return _over_tiles(pixels, 1, height, width, halo.median_kernel(1), "edge", side)


def local_entropy(pixels: DataFrame, reach: int, height: int, width: int, side: int = SIDE) -> DataFrame:
    """Shannon entropy in bits of the values in the square of this reach, cut at the border."""
    return _over_tiles(pixels, reach, height, width, halo.entropy_kernel(reach), "clip", side).withColumnRenamed("v", "entropy")


def whitened(pixels: DataFrame, sigma: float, height: int, width: int, side: int = SIDE) -> DataFrame:
    """(y, x, v): a Gaussian, then the Laplacian, the image mirrored at its border."""
    reach, kernel = halo.whiten_kernel(sigma)
    return _over_tiles(pixels, reach, height, width, kernel, "symmetric", side)


def pyramid_step(pixels: DataFrame, height: int, width: int, side: int = SIDE) -> DataFrame:
    """(y, x, v) half as large: every second pixel of the image smoothed over 5 x 5."""
    return strided(_over_tiles(pixels, 2, height, width, halo.smooth_kernel, "reflect", side), 2)


def gaussian_pyramid(pixels: DataFrame, height: int, width: int, most: int = 1024, side: int = SIDE) -> DataFrame:
    """(level, y, x, v): steps until the halved longer side is at most `most`."""
    out, size = pixels.select(F.lit(0).alias("level"), "y", "x", F.col("v").cast("double").alias("v")), max(height, width)
    at, level = pixels.select("y", "x", "v"), 0
    while size > most:
        at, level = pyramid_step(at, height, width, side), level + 1
        height, width, size = -(-height // 2), -(-width // 2), size // 2
        out = out.unionByName(at.select(F.lit(level).alias("level"), "y", "x", "v"))
    return out


def downscaled_mean(pixels: DataFrame, factor: int, height: int, width: int) -> DataFrame:
    """Means of factor x factor blocks; blocks cut by the border are filled by the image mirrored about its border pixel."""

    def filled(df: DataFrame, c: str, n: int) -> DataFrame:
        missing = -n % factor
        if not missing:
            return df
        twin = F.when(F.col(c).between(n - 1 - missing, n - 2), F.array(F.col(c), 2 * n - 2 - F.col(c))).otherwise(F.array(c))
        return df.select(*[F.explode(twin).alias(c) if k == c else k for k in df.columns])

    whole = filled(filled(pixels.select("y", "x", "v"), "y", height), "x", width)
    return blocks_mean(whole, factor)


def translated(pixels: DataFrame, dy: float, dx: float, height: int, width: int) -> DataFrame:
    """The image moved by a shift, bilinear, 0 where nothing comes from."""
    grid = pixels.select("y", "x").filter((F.col("y") < height) & (F.col("x") < width))
    return warp_bilinear(pixels, grid, (1.0, 0.0, -dx, 0.0, 1.0, -dy))


def repeated(image: DataFrame, rows: int, columns: int) -> DataFrame:
    """Each pixel as a block of rows x columns equal pixels."""
    tall = image.select(F.explode(F.expr(f"transform(sequence(0, {rows - 1}), k -> y * {rows} + k)")).alias("y"), "x", "v")
    return tall.select("y", F.explode(F.expr(f"transform(sequence(0, {columns - 1}), k -> x * {columns} + k)")).alias("x"), "v")


def block_labels(image: DataFrame, block_h: int, block_w: int, width: int) -> DataFrame:
    """(y, x, label): the number of each pixel's block, from 1 on, row by row; cut blocks count."""
    across = -(-width // block_w)
    return image.select("y", "x", F.expr(f"int((y div {block_h}) * {across} + x div {block_w} + 1)").alias("label"))
