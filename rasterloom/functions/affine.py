"""Affine matrices as six columns a00 a01 a02 a10 a11 a12, (x, y) to (x, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import flip, rotation

ENTRIES = ("a00", "a01", "a02", "a10", "a11", "a12")
Matrix = tuple[float, ...]


def columns_of(matrix: Matrix) -> list[Column]:
    return [F.lit(float(v)).alias(c) for c, v in zip(ENTRIES, matrix)]


def block_matrices(shifts: DataFrame, matrix: Matrix) -> DataFrame:
    """(by, bx, a00..a12) of blocks (by, bx, dy, dx): the matrix, then the block's move.

    A block without an estimate (null) has no matrix: all six are null."""
    known = F.col("dy").isNotNull() & F.col("dx").isNotNull()
    move = {"a02": F.col("dx"), "a12": F.col("dy")}
    return shifts.select("by", "bx", *[F.when(known, F.lit(float(v)) + move.get(c, F.lit(0.0))).alias(c) for c, v in zip(ENTRIES, matrix)])


def full_scale(coarse: DataFrame) -> DataFrame:
    """Matrices between thumbnails (a00..a12, ref_factor, moving_factor) made to hold for the full images."""
    ratio = F.col("ref_factor") / F.col("moving_factor")
    return coarse.select("ref_factor", "moving_factor", *[(F.col(c) * (F.col("ref_factor") if c in ("a02", "a12") else ratio)).alias(c) for c in ENTRIES])


def orientations(images: DataFrame) -> DataFrame:
    """(image, turn, a00..a12) of images (image, h, w): four quarter turns, then flips of rows, of columns and of both."""
    height, width = F.col("h").cast("double"), F.col("w").cast("double")

    def form(name: str, unit: Matrix, per_h: Matrix, per_w: Matrix) -> Column:
        """Matrices are linear in height and width: their values at (0, 0), and what a unit of each adds."""
        return F.struct(F.lit(name).alias("turn"), *[(F.lit(u) + height * (p - u) + width * (q - u)).alias(c) for c, u, p, q in zip(ENTRIES, unit, per_h, per_w)])

    forms = [form(f"rot{90 * k}", *(rotation(k, *at) for at in ((0, 0), (1, 0), (0, 1)))) for k in range(4)]
    forms += [form(name, *(flip(axis, *at) for at in ((0, 0), (1, 0), (0, 1)))) for name, axis in (("flip_rows", 0), ("flip_columns", 1))]
    forms.append(form("flip_both", *(rotation(2, *at) for at in ((0, 0), (1, 0), (0, 1)))))
    return images.select("image", F.explode(F.array(*forms)).alias("m")).select("image", "m.*")


def swapped(matrices: DataFrame, *keys: str) -> DataFrame:
    """The same maps for points given as (y, x)."""
    order = ("a11", "a10", "a12", "a01", "a00", "a02")
    return matrices.select(*keys, *[F.col(old).alias(new) for new, old in zip(ENTRIES, order)])
