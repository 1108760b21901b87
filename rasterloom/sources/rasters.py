"""Rasters derived from tables, as pixel rows (y, x, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_raster(vectors: DataFrame) -> DataFrame:
    """One raster row for each vector: y is vec_id, x the place, v the value scaled to 0..255."""
    pixels = vectors.select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "e"))
    return pixels.select("y", "x", F.floor((F.col("e").cast("double") + 1) * 128).cast("int").alias("v"))


def vector_rows(vectors: DataFrame) -> DataFrame:
    """vector_raster's rows as they come, (y, v array<int>)."""
    return vectors.select(F.col("vec_id").cast("int").alias("y"), F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 128).cast("int")).alias("v"))


def density_raster(items: DataFrame, size: int = 64, **sums: str) -> DataFrame:
    """A size x size grid of summed item columns modulo 256, cells without items at 0."""
    sums = sums or {"v": "l_quantity"}
    cells = items.groupBy((F.col("l_partkey") % size).cast("int").alias("y"), (F.col("l_orderkey") % size).cast("int").alias("x"))
    cells = cells.agg(*[(F.sum(c).cast("long") % 256).cast("int").alias(v) for v, c in sums.items()])
    axis = items.sparkSession.range(size * size).select((F.col("id").cast("int") / size).cast("int").alias("y"), (F.col("id") % size).cast("int").alias("x"))
    return axis.join(cells, ["y", "x"], "left").select("y", "x", *[F.coalesce(v, F.lit(0)).alias(v) for v in sums])
