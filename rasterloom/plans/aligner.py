"""An alignment from end to end: coarse matrix, warp, block shifts, constraint, block matrices, warp."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import affine
from ..lineage import cut
from ..operators import align, tiles

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


@dataclass
class Aligner:
    """Two images as tile rows, on a grid of blocks of the reference's tile size.

    coarse maps the moving thumbnail to the reference's; the factors say how much smaller the
    thumbnails are than the images. The channel that is aligned is 0 of both."""

    reference: DataFrame
    moving: DataFrame
    tile: int
    rows: int
    columns: int
    coarse: tuple[float, ...] = IDENTITY
    ref_factor: float = 1.0
    moving_factor: float = 1.0
    channels: list[int] = field(default_factory=lambda: [0])

    @property
    def matrix(self) -> tuple[float, ...]:
        """The coarse matrix between the full images."""
        ratio = self.ref_factor / self.moving_factor
        return tuple(v * (self.ref_factor if k in (2, 5) else ratio) for k, v in enumerate(self.coarse))

    def grid(self) -> DataFrame:
        spark = self.reference.sparkSession
        return spark.range(self.rows * self.columns).select(F.expr(f"int(id div {self.columns})").alias("by"), F.expr(f"int(id % {self.columns})").alias("bx"))

    def warped(self, matrices: DataFrame | None = None, nearest: bool = False) -> DataFrame:
        """The moving image on the reference's grid, by one matrix a block or by the coarse one."""
        if matrices is None:
            matrices = self.grid().select("by", "bx", *affine.columns_of(self.matrix))
        return tiles.warped(self.moving, matrices, self.channels, self.tile, self.tile, nearest)

    def shifts(self, mask: DataFrame | None = None, sigma: float = 0.0, upsample: int = 1) -> DataFrame:
        """(by, bx, dy, dx, error) left after the coarse matrix."""
        first = F.col("channel") == self.channels[0]
        return tiles.block_shifts(self.reference.filter(first), self.warped().filter(first), self.tile, mask, sigma, upsample)

    def constrained(self, mask: DataFrame | None = None, sigma: float = 0.0, upsample: int = 1) -> DataFrame:
        """As align.constrained, from the original shifts each time."""
        return align.constrained(self.shifts(mask, sigma, upsample).select("by", "bx", "dy", "dx"))

    def matrices(self, mask: DataFrame | None = None, sigma: float = 0.0, upsample: int = 1) -> DataFrame:
        """(by, bx, a00 .. a12) with each block's constrained shift."""
        fitted = self.constrained(mask, sigma, upsample).select("by", "bx", F.col("fitted_dy").alias("dy"), F.col("fitted_dx").alias("dx"))
        return affine.block_matrices(fitted, self.matrix)

    def run(self, mask: DataFrame | None = None) -> DataFrame:
        """The moving image as tile rows on the reference's grid, every block by its own matrix."""
        return self.warped(cut(self.matrices(mask)))


def align_levels(aligners: dict[int, tuple[int, Aligner]], excluded: list[int] | None = None) -> DataFrame:
    """(by, bx, level, dy, dx) on the finest level's grid, of aligners {level: (ratio to the finest, aligner)}."""
    out = None
    for level, (ratio, aligner) in sorted(aligners.items()):
        found = aligner.constrained().withColumns({"level": F.lit(level), "ratio": F.lit(ratio)})
        out = found if out is None else out.unionByName(found)
    finest = aligners[min(aligners)][1]
    return align.multires_shifts(out, finest.rows, finest.columns, excluded)


def align_objects(aligner: Aligner, boxes: DataFrame, coarse: dict[int, tuple[float, ...]], excluded: list[int] | None = None) -> DataFrame:
    """(by, bx, obj_id, a00 .. a12) of objects (obj_id, area, rs, re, cs, ce) in blocks, each with its own coarse matrix.

    Shifts are estimated and constrained for an object in the blocks of its box; the largest object
    that covers a block gives its matrix, and blocks that none covers get the aligner's own."""
    matrices = None
    for obj_id, matrix in sorted(coarse.items()):
        own = Aligner(aligner.reference, aligner.moving, aligner.tile, aligner.rows, aligner.columns, matrix, aligner.ref_factor, aligner.moving_factor, aligner.channels)
        box = boxes.filter(F.col("obj_id") == obj_id)
        inside = aligner.grid().join(F.broadcast(box.select("rs", "re", "cs", "ce")), F.expr("by >= rs and by < re and bx >= cs and bx < ce")).select("by", "bx", F.lit(True).alias("inside"))  # one box
        found = own.matrices(inside).join(inside, ["by", "bx"], "left_semi").withColumn("obj_id", F.lit(obj_id))
        matrices = found if matrices is None else matrices.unionByName(found)
    return align.objects_combined(matrices, boxes.select("obj_id", "area"), aligner.grid(), aligner.matrix, excluded)
