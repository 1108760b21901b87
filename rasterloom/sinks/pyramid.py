"""Pyramids of rasters, as Parquet tables cut by level and clustered by tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def next_level(pixels: DataFrame, factor: int = 2, mask: bool = False) -> DataFrame:
    """(channel, y, x, v) one level up: block means, halves to even; of a mask each block's first pixel."""
    where = [F.col("channel"), *[F.expr(f"{c} div {factor}").cast("int").alias(c) for c in "yx"]]
    if mask:
        return pixels.filter(f"y % {factor} = 0 and x % {factor} = 0").select(*where, "v")
    return pixels.groupBy(*where).agg(F.rint(F.avg("v")).cast("int").alias("v"))


def pyramid_levels(pixels: DataFrame, levels: int, factor: int = 2, mask: bool = False) -> DataFrame:
    """(level, channel, y, x, v) of all levels, the full one as 0; every level is made of the one under it."""
    out, at = pixels.select(F.lit(0).alias("level"), "channel", "y", "x", "v"), pixels
    for k in range(1, levels):
        at = next_level(at, factor, mask)
        out = out.unionByName(at.select(F.lit(k).alias("level"), "channel", "y", "x", "v"))
    return out


def write_pyramid(pixels: DataFrame, path: str, levels: int, factor: int = 2, mask: bool = False, tile: int = 1024, overwrite: bool = False) -> None:
    """Write levels under path/level=k. Each is made from the table of the one before, read again,
    so no level is computed twice; a tile's pixels lie together, so a region prunes row groups."""
    spark, at = pixels.sparkSession, pixels
    mode = "overwrite" if overwrite else "errorifexists"
    for k in range(levels):
        if k:
            at = next_level(spark.read.parquet(f"{path}/level={k - 1}"), factor, mask)
        tiled = at.select("channel", F.expr(f"y div {tile}").cast("int").alias("ty"), F.expr(f"x div {tile}").cast("int").alias("tx"), "y", "x", "v")
        tiled.repartition("channel", "ty", "tx").sortWithinPartitions("channel", "ty", "tx", "y", "x").write.mode(mode).parquet(f"{path}/level={k}")


def read_level(spark: SparkSession, path: str, level: int, channels: list[int] | None = None, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(channel, y, x, v) of one level; channels are numbered anew in the order listed, region is (y0, y1, x0, x1)."""
    pixels = spark.read.parquet(f"{path}/level={level}")
    if region:
        pixels = pixels.filter((F.col("y") >= region[0]) & (F.col("y") < region[1]) & (F.col("x") >= region[2]) & (F.col("x") < region[3]))
    channel = F.col("channel")
    if channels is not None:
        pixels = pixels.filter(channel.isin(channels))
        channel = F.array_position(F.lit(channels), channel).cast("int") - 1
    return pixels.select(channel.alias("channel"), "y", "x", "v")
