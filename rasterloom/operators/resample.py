"""Affine resampling of pixel rows: destination pixels look their source up by equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Matrix = tuple[float, float, float, float, float, float]


def inverse(m: Matrix) -> Matrix:
    """The inverse of x' = m0 x + m1 y + m2, y' = m3 x + m4 y + m5."""
    a, b, c, d, e, f = m
    det = a * e - b * d
    if abs(det) < 1e-12:
        raise ValueError("the matrix has no inverse")
    return (e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det)


def _sources(grid: DataFrame, m: Matrix) -> DataFrame:
    a, b, c, d, e, f = (float(k) for k in m)
    return grid.select("y", "x", (F.col("x") * a + F.col("y") * b + c).alias("sx"), (F.col("x") * d + F.col("y") * e + f).alias("sy"))


def warp_nearest(pixels: DataFrame, grid: DataFrame, back: Matrix) -> DataFrame:
    """Each pixel of grid from the nearest source pixel; 0 outside. back maps grid to source."""
    at = _sources(grid, back).select("y", "x", F.floor(F.col("sy") + 0.5).cast("int").alias("py"), F.floor(F.col("sx") + 0.5).cast("int").alias("px"))
    source = pixels.select(F.col("y").alias("py"), F.col("x").alias("px"), "v")
    return at.join(source, ["py", "px"], "left").select("y", "x", F.coalesce("v", F.lit(0)).alias("v"))


def warp_bilinear(pixels: DataFrame, grid: DataFrame, back: Matrix) -> DataFrame:
    """Each pixel of grid from the four source pixels around it, those outside being 0."""
    at = _sources(grid, back).withColumns({"fy": F.floor("sy").cast("int"), "fx": F.floor("sx").cast("int")})
    corners = F.expr("""array(
        named_struct('py', fy, 'px', fx, 'k', (1 - (sy - fy)) * (1 - (sx - fx))), named_struct('py', fy, 'px', fx + 1, 'k', (1 - (sy - fy)) * (sx - fx)),
        named_struct('py', fy + 1, 'px', fx, 'k', (sy - fy) * (1 - (sx - fx))), named_struct('py', fy + 1, 'px', fx + 1, 'k', (sy - fy) * (sx - fx)))""")
    source = pixels.select(F.col("y").alias("py"), F.col("x").alias("px"), "v")
    parts = at.select("y", "x", F.explode(corners).alias("c")).select("y", "x", "c.*").join(source, ["py", "px"], "left")
    return parts.groupBy("y", "x").agg(F.round(F.sum(F.coalesce(F.col("v"), F.lit(0)) * F.col("k")), 6).alias("v"))
