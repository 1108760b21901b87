"""Block shifts, their robust constraint, and what wins where several estimates exist."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.affine import ENTRIES
from ..lineage import cut
from .threshold import triangle


def blocked(pixels: DataFrame, size: int, *values: str) -> DataFrame:
    """Pixels by block (by, bx) and place in it (iy, ix)."""
    return pixels.select((F.col("y") / size).cast("int").alias("by"), (F.col("x") / size).cast("int").alias("bx"), (F.col("y") % size).alias("iy"), (F.col("x") % size).alias("ix"), *values)


def whole_blocks(blocks: DataFrame, size: int) -> DataFrame:
    """The pixels of those blocks that have all their size * size pixels."""
    own = Window.partitionBy("by", "bx")
    return blocks.withColumn("n", F.count(F.lit(1)).over(own)).filter(F.col("n") == size * size).drop("n")


def circular_scores(one: np.ndarray, two: np.ndarray, reach: int) -> np.ndarray:
    """(n, shifts): sums of products of n images with others moved circularly by each shift up to reach, in order of dy, dx."""
    steps = range(-reach, reach + 1)
    return np.stack([np.einsum("nyx,nyx->n", one, np.roll(two, (dy, dx), (1, 2))) for dy in steps for dx in steps], axis=1)


def fft_shifts(one: np.ndarray, two: np.ndarray) -> list[tuple[int, int] | None]:
    """The shift that lays each of n second images on its first, by FFT; none where one is constant."""
    surface = np.fft.ifft2(np.fft.fft2(one) * np.conj(np.fft.fft2(two))).real
    shape = one.shape[1:]
    at = np.stack(np.unravel_index(np.round(surface, 6).reshape(len(one), -1).argmax(axis=1), shape), axis=1)
    at = np.where(at > np.array(shape) // 2, at - shape, at).tolist()
    flat = [(x.min(axis=(1, 2)) == x.max(axis=(1, 2))) for x in (one, two)]
    return [None if c else tuple(p) for c, p in zip(flat[0] | flat[1], at)]


def _plane(rows: DataFrame, value: str) -> DataFrame:
    """One row (c, a, b): the least-squares plane value = c + a * by + b * bx."""
    y, x, v = (F.col(c).cast("double") for c in ("by", "bx", value))
    m = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(k) for k, e in {"y": y, "x": x, "v": v, "yy": y * y, "xx": x * x, "yx": y * x, "yv": y * v, "xv": x * v}.items()])
    m = m.selectExpr("n", "y / n as my", "x / n as mx", "v / n as mv", "yy - y * y / n as syy", "xx - x * x / n as sxx", "yx - y * x / n as syx", "yv - y * v / n as syv", "xv - x * v / n as sxv")
    m = m.withColumn("det", F.expr("syy * sxx - syx * syx"))
    m = m.withColumn("a", F.expr("case when abs(det) > 1e-9 then (syv * sxx - sxv * syx) / det when syy > 1e-9 then syv / syy else 0e0 end"))
    m = m.withColumn("b", F.expr("case when abs(det) > 1e-9 then (sxv * syy - syv * syx) / det when abs(det) <= 1e-9 and syy <= 1e-9 and sxx > 1e-9 then sxv / sxx else 0e0 end"))
    return m.select(F.expr("mv - a * my - b * mx").alias("c"), "a", "b")


def _bound(rows: DataFrame) -> float:
    """Under which values count as small: the triangle's threshold, or no bound where all are equal."""
    cut_at, ends = triangle(rows).first(), rows.agg(F.min("v"), F.max("v")).first()
    return float("inf") if cut_at is None or ends[0] == ends[1] else cut_at[0]


def constrained(shifts: DataFrame) -> DataFrame:
    """(by, bx, dy, dx, passed, fitted_dy, fitted_dx): shifts that stray from a plane through the
    small ones are replaced by the plane.

    Null and infinite shifts are no estimates: they never pass. Where all shifts are equally long, all
    are small ones, and where all are equally far from the plane, all pass. shifts has a row a block; it is cut
    from its lineage once and read by three small aggregates, of each of which the driver takes one row."""
    finite = F.expr("dy is not null and dx is not null and abs(dy) < double('infinity') and abs(dx) < double('infinity')")
    shifts = cut(shifts)
    known = shifts.filter(finite).withColumn("v", F.round(F.sqrt(F.col("dy").cast("double") ** 2 + F.col("dx").cast("double") ** 2), 6))
    small = known.filter(F.col("v") < _bound(known))
    planes = _plane(small, "dy").crossJoin(_plane(small, "dx").toDF("c2", "a2", "b2")).first()  # one row each
    planes = [p if p is not None else 0.0 for p in planes]
    by, bx = F.col("by").cast("double"), F.col("bx").cast("double")
    plane = {"dy": planes[0] + planes[1] * by + planes[2] * bx, "dx": planes[3] + planes[4] * by + planes[5] * bx}
    off = F.when(finite, F.round(F.sqrt((F.col("dy") - plane["dy"]) ** 2 + (F.col("dx") - plane["dx"]) ** 2), 6))
    fitted = shifts.withColumn("v", off)
    passed = F.coalesce(F.col("v") < _bound(fitted.filter("v is not null")), F.lit(False))
    pick: Column = lambda c: F.round(F.when(passed, F.col(c).cast("double")).otherwise(plane[c]), 6)
    return fitted.select("by", "bx", "dy", "dx", passed.alias("passed"), pick("dy").alias("fitted_dy"), pick("dx").alias("fitted_dx"))


def finest_valid(levels: DataFrame) -> DataFrame:
    """Of rows (by, bx, level, ratio, dy, dx, valid), each block's finest valid shift in full
    resolution; without a valid level, the finest level's."""
    order = Window.partitionBy("by", "bx").orderBy(F.col("valid").desc(), "level")
    best = levels.withColumn("place", F.row_number().over(order)).filter("place = 1")
    return best.select("by", "bx", "level", (F.col("dy") * F.col("ratio")).alias("dy"), (F.col("dx") * F.col("ratio")).alias("dx"))


def multires_shifts(levels: DataFrame, rows: int, columns: int, excluded: list[int] | None = None) -> DataFrame:
    """(by, bx, level, dy, dx) on the finest grid, of every level's constrained shifts (level, ratio, by, bx,
    dy, dx, passed, fitted_dy, fitted_dx).

    A level is valid in a block where the constraint left its shift as it was and it is not excluded; the
    finest valid one counts, and the finest of all where none is valid. Shifts are scaled by the whole ratio of levels."""
    valid = F.col("passed") & ~F.col("level").isin(excluded or [])
    ratio = F.col("ratio").cast("int")
    fine = levels.withColumn("valid", valid).select("level", ratio.alias("ratio"), "valid", F.col("fitted_dy").alias("dy"), F.col("fitted_dx").alias("dx"),
        F.explode(F.sequence(F.col("by") * ratio, (F.col("by") + 1) * ratio - 1)).alias("by"), "bx")
    fine = fine.filter(F.col("by") < rows).select("level", "ratio", "valid", "dy", "dx", "by", F.explode(F.sequence(F.col("bx") * F.col("ratio"), (F.col("bx") + 1) * F.col("ratio") - 1)).alias("bx"))
    return finest_valid(fine.filter(F.col("bx") < columns)).select("by", "bx", "level", "dy", "dx")


def objects_combined(matrices: DataFrame, objects: DataFrame, blocks: DataFrame, baseline: tuple[float, ...], excluded: list[int] | None = None) -> DataFrame:
    """(by, bx, obj_id, a00 .. a12): each block's matrix from the largest object that covers it, else the baseline.

    matrices has (obj_id, by, bx, a00 .. a12) for the blocks that an object covers."""
    covers = matrices.filter(~F.col("obj_id").isin(excluded or []))
    best = largest_object(blocks, covers.select("by", "bx", "obj_id"), objects)
    known = best.join(covers, ["by", "bx", "obj_id"], "left")
    return known.select("by", "bx", "obj_id", *[F.when(F.col("obj_id").isNull(), F.lit(float(b))).otherwise(F.col(n)).alias(n) for n, b in zip(ENTRIES, baseline)])


def largest_object(blocks: DataFrame, covers: DataFrame, objects: DataFrame) -> DataFrame:
    """(by, bx, obj_id): the largest object that covers a block, null where none does."""
    order = Window.partitionBy("by", "bx").orderBy(F.col("area").desc(), "obj_id")
    best = covers.join(objects, "obj_id").withColumn("place", F.row_number().over(order)).filter("place = 1")
    return blocks.join(best.select("by", "bx", "obj_id"), ["by", "bx"], "left")


#: Descriptors of a side in one tile, about.
TILE = 2048
#: Rows of a tile whose distances are held at once.
_STRIP = 256


def _nearest_in_tile(one: pa.Table, two: pa.Table) -> pa.Table:
    """(forth, id, other, d): within a tile, the nearest of each descriptor of either side."""
    one, two = one.sort_by("id"), two.sort_by("id")
    i, j = (t["id"].to_numpy() for t in (one, two))
    a, b = (t["code"].to_numpy() for t in (one, two))
    forth, back = np.zeros(len(i), dtype=np.int64), np.zeros(len(j), dtype=np.int64)
    far, near = np.zeros(len(i), dtype=np.int32), np.full(len(j), 65, dtype=np.int32)
    for k in range(0, len(i) if len(j) else 0, _STRIP):
        d = np.bitwise_count((a[k : k + _STRIP, None] ^ b[None, :]).view(np.uint64))
        at = d.argmin(axis=1)  # the first: ids are sorted
        forth[k : k + _STRIP], far[k : k + _STRIP] = j[at], d[np.arange(len(d)), at]
        at = d.argmin(axis=0)
        low = d[at, np.arange(len(j))]
        less = low < near
        back[less], near[less] = i[k + at[less]], low[less]
    if not len(i) or not len(j):
        i, j, forth, back, far, near = (x[:0] for x in (i, j, forth, back, far, near))
    return pa.table({"forth": np.repeat([True, False], [len(i), len(j)]), "id": np.concatenate([i, j]).astype(np.int64), "other": np.concatenate([forth, back]), "d": np.concatenate([far, near])})


def mutual_nearest(one: DataFrame, two: DataFrame) -> DataFrame:
    """(i, j, d): pairs of descriptors, each the other's nearest in Hamming distance.

    Exact: every descriptor of one image is compared with every one of the other, in tiles that
    give a row for each descriptor and not for each pair; ties go to the smaller id. Codes have 64 bits."""
    kind = one.schema["id"].dataType
    rows, columns = (max(1, -(-side.count() // TILE)) for side in (one, two))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    along = one.select(F.col("id").cast("long").alias("id"), "code").withColumn("r", part(rows)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    down = two.select(F.col("id").cast("long").alias("id"), "code").withColumn("c", part(columns)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    tiles = along.groupBy("r", "c").cogroup(down.groupBy("r", "c")).applyInArrow(_nearest_in_tile, "forth boolean, id long, other long, d int")
    best = tiles.groupBy("forth", "id").agg(F.min(F.struct("d", "other")).alias("m"))
    i, j = F.when(F.col("forth"), F.col("id")).otherwise(F.col("m.other")), F.when(F.col("forth"), F.col("m.other")).otherwise(F.col("id"))
    ways = best.select(i.cast(kind).alias("i"), j.cast(kind).alias("j"), F.col("m.d").alias("d")).groupBy("i", "j").agg(F.min("d").alias("d"), F.count(F.lit(1)).alias("ways"))
    return ways.filter("ways = 2").select("i", "j", "d")
