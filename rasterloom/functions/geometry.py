"""Pyramid levels, matrices and channel names."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def level_count(size: int, factor: int = 2, most: int = 1024) -> int:
    """Levels until the longer side is at most `most`, the full one included; in integers."""
    count, side = 1, size
    while side > most:
        side, count = -(-side // factor), count + 1
    return count


def level_geometry(images: DataFrame, factor: int = 2, most: int = 1024, tile: int = 1024, levels: int = 32) -> DataFrame:
    """(image, level, height, width, tile_h, tile_w) of images (image, h, w)."""
    power = [factor**k for k in range(levels) if factor**k < 1 << 40]
    scaled = images.select("image", "h", "w", F.posexplode(F.array(*[F.lit(p).cast("long") for p in power])).alias("level", "p"))
    up = lambda a, b: F.expr(f"({a} + {b} - 1) div {b}")
    before = F.expr(f"level = 0 or greatest(h, w) > {most} * (p div {factor})")
    rows = scaled.filter(before).select("image", "level", up("h", "p").alias("height"), up("w", "p").alias("width"))
    even = lambda c: F.expr(f"(({c} + ({c} + {tile - 1}) div {tile} - 1) div (({c} + {tile - 1}) div {tile}) + 15) div 16 * 16")
    return rows.select("image", F.col("level").cast("int").alias("level"), "height", "width", even("height").alias("tile_h"), even("width").alias("tile_w"))


def match_levels_strict(one: DataFrame, two: DataFrame) -> DataFrame:
    """(level1, level2): the coarsest level of two that is finer than the level of one, else 0."""
    pairs = one.select(F.col("level").alias("level1"), F.col("px").alias("px1")).join(two.select(F.col("level").alias("level2"), F.col("px").alias("px2")), F.expr("px2 < px1"), "left")
    return pairs.groupBy("level1").agg(F.coalesce(F.max("level2"), F.lit(0)).cast("int").alias("level2"))


def match_levels_nearest(levels: DataFrame) -> DataFrame:
    """(reader, level): each reader's level nearest to the finest of the readers' coarsest pixels."""
    target = levels.groupBy("reader").agg(F.max("px").alias("coarsest")).agg(F.min("coarsest").alias("target"))
    near = levels.crossJoin(F.broadcast(target)).withColumn("away", F.abs(F.col("px") - F.col("target")))
    return near.groupBy("reader").agg(F.min_by("level", F.struct("away", "px", "level")).alias("level"))


def unique_names(names: DataFrame, rounds: int = 4) -> DataFrame:
    """(place, name): names that occur more than once get _1, _2, ... in order of place, until none do.

    A number can make a name equal to another; `rounds` rounds settle lists whose names are not made to clash."""
    for _ in range(rounds):
        same = Window.partitionBy("name")
        ranked = names.select("place", "name", F.count(F.lit(1)).over(same).alias("n"), F.row_number().over(same.orderBy("place")).alias("k"))
        names = ranked.select("place", F.when(F.col("n") > 1, F.concat_ws("_", "name", "k")).otherwise(F.col("name")).alias("name"))
    return names


def rotation(k: int, height: int, width: int) -> tuple[float, ...]:
    """The matrix of k quarter turns clockwise negative, moving the image back to its corner."""
    turn = -math.pi / 2 * k
    c, s = round(math.cos(turn)), round(math.sin(turn))
    tx = {0: 0, 1: 0, 2: width - 1, 3: height - 1}[k % 4]
    ty = {0: 0, 1: width - 1, 2: height - 1, 3: 0}[k % 4]
    return (float(c), float(-s), float(tx), float(s), float(c), float(ty))


def flip(axis: int, height: int, width: int) -> tuple[float, ...]:
    """The matrix that mirrors rows (axis 0) or columns (axis 1)."""
    return (1.0, 0.0, 0.0, 0.0, -1.0, height - 1.0) if axis == 0 else (-1.0, 0.0, width - 1.0, 0.0, 1.0, 0.0)


def thumbnail_level(levels: DataFrame, size: int) -> DataFrame:
    """(image, level): the level whose mean side is nearest to size, the first of equals; levels as of level_geometry."""
    away = F.abs((F.col("height") + F.col("width")) / 2 - size)
    return levels.groupBy("image").agg(F.min_by("level", F.struct(away, F.col("level"))).alias("level"))
