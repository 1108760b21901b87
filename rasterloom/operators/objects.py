"""Objects of a mask, their bounding boxes, and the blocks that they cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

Matrix = tuple[float, float, float, float, float, float]


def label_objects(mask: DataFrame) -> DataFrame:
    """(y, x, label) of the rows (y, x) of a mask, joined over sides and corners.

    A label is y * 2^32 + x of an object's first pixel. Pixels are put together as runs of a row
    first, so that the rounds that follow see runs and where they touch, not pixels. A round
    passes the smallest label on and follows labels to their own label; the number of rounds
    grows slowly with an object's winding. The driver sees one flag a round."""
    row = Window.partitionBy("y").orderBy("x")
    starts = mask.select("y", "x").distinct().withColumn("new", F.col("x") - F.coalesce(F.lag("x").over(row), F.col("x") - 2) > 1)
    at = F.shiftleft(F.col("y").cast("long"), 32) + F.col("x")
    runs = cut(starts.withColumn("run", F.max(F.when(F.col("new"), at)).over(row)).select("y", "x", "run"))
    above = runs.select((F.col("y") + 1).alias("y"), F.explode(F.array(F.col("x") - 1, "x", F.col("x") + 1)).alias("x"), F.col("run").alias("b"))
    down = runs.join(above, ["y", "x"]).select(F.col("run").alias("a"), "b").distinct()
    edges = cut(down.union(down.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(runs.select(F.col("run").alias("a"), F.col("run").alias("label")).distinct())
    while True:
        near = edges.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.withColumnRenamed("label", "old").join(near, "a", "left").withColumn("label", F.least("old", "near"))
        jump = labels.select(F.col("a").alias("label"), F.col("label").alias("further"))
        spread = cut(spread.join(jump, "label", "left").select("a", "old", F.least("label", "further").alias("label")))
        labels = spread.select("a", "label")
        if spread.filter("old <> label").isEmpty():
            return runs.join(labels.withColumnRenamed("a", "run"), "run").select("y", "x", "label")


def boxes_of(labelled: DataFrame) -> DataFrame:
    """(label, rs, re, cs, ce, area): half-open boxes and pixel counts of labelled pixels."""
    return labelled.groupBy("label").agg(
        F.min("y").cast("int").alias("rs"), (F.max("y") + 1).cast("int").alias("re"), F.min("x").cast("int").alias("cs"), (F.max("x") + 1).cast("int").alias("ce"), F.count(F.lit(1)).alias("area")
    )


def boxes_mapped(boxes: DataFrame, back: Matrix) -> DataFrame:
    """Boxes (id, rs, re, cs, ce) whose corners go through a matrix: starts floored, at 0 at least; ends raised."""
    a, b, c, d, e, f = back
    xs = [F.col(x) * a + F.col(y) * b + c for x in ("cs", "ce") for y in ("rs", "re")]
    ys = [F.col(x) * d + F.col(y) * e + f for x in ("cs", "ce") for y in ("rs", "re")]
    start = lambda v: F.greatest(F.floor(F.least(*v)), F.lit(0)).cast("int")
    end = lambda v: F.ceil(F.greatest(*v)).cast("int")
    return boxes.select("id", start(ys).alias("rs"), end(ys).alias("re"), start(xs).alias("cs"), end(xs).alias("ce"))


def boxes_in_blocks(boxes: DataFrame, factor: float, block_h: int, block_w: int) -> DataFrame:
    """Boxes (id, rs, re, cs, ce) of a thumbnail as ranges of blocks of the full image."""
    start = lambda c, n: F.greatest(F.floor(F.col(c) * factor / n), F.lit(0)).cast("int").alias(c)
    end = lambda c, n: F.ceil(F.col(c) * factor / n).cast("int").alias(c)
    return boxes.select("id", start("rs", block_h), end("re", block_h), start("cs", block_w), end("ce", block_w))


def blocks_by_cover(blocks: DataFrame, ranges: DataFrame, covered: bool = True) -> DataFrame:
    """The blocks (by, bx) that some range (rs, re, cs, ce) holds, or those that none holds."""
    cells = ranges.filter("re > rs and ce > cs").select(F.explode(F.expr("sequence(rs, re - 1)")).alias("by"), "cs", "ce").select("by", F.explode(F.expr("sequence(cs, ce - 1)")).alias("bx"))
    return blocks.join(cells, ["by", "bx"], "left_semi" if covered else "left_anti")


def by_area(boxes: DataFrame, factor: int = 1) -> DataFrame:
    """(obj_id, rs, re, cs, ce, area): boxes (label, ...) numbered from the largest area down, equal areas by label.

    Boxes are scaled up by the factor that their image was scaled down. Objects of one slide are few, so they are ranked in one task."""
    order = Window.orderBy(F.col("area").desc(), "label")
    scaled = [(F.col(c) * factor).cast("int").alias(c) for c in ("rs", "re", "cs", "ce")]
    return boxes.select((F.row_number().over(order) - 1).cast("int").alias("obj_id"), *scaled, "area")
