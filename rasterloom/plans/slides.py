"""Whole jobs on files: slides are read, aligned to the reference, brought into its frame and written as one pyramid."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import masks, tiles
from ..sinks.tiff import write_ome_tiff
from ..sources import tiff
from . import jobs, registration
from .aligner import Aligner


@dataclass
class Slide:
    """A tiled file, its levels (height, width, channels) and how much smaller each is."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        rows = tiff.tiff_levels(self.spark, [self.path]).orderBy("level").collect()
        self.sizes = [(r.height, r.width, r.channels) for r in rows]
        self.tile = rows[0].tile_h
        if any(r.tile_h != r.tile_w or r.tile_h != self.tile for r in rows):
            raise ValueError("tiles must be square and of one size")

    def downsample(self, level: int) -> float:
        out = 1.0
        for (h0, w0, _), (h, w, _) in zip(self.sizes[:level], self.sizes[1 : level + 1]):
            out *= (h0 / h + w0 / w) / 2
        return out

    def thumbnail(self, size: int = 2500) -> int:
        away = [abs((h + w) / 2 - size) for h, w, _ in self.sizes]
        return away.index(min(away))

    def pixels(self, level: int) -> DataFrame:
        """(channel, y, x, v) of a level."""
        rows = tiff.read_tiff(self.spark, self.path).filter(F.col("level") == level)
        return tiles.unpack(rows.select("channel", "ty", "tx", "data"), self.tile, *self.sizes[level][:2])

    def rgb(self, level: int) -> DataFrame:
        by = self.pixels(level).groupBy("y", "x")
        return by.agg(*[F.max(F.when(F.col("channel") == k, F.col("v"))).cast("int").alias(c) for k, c in enumerate("rgb")])

    def processed(self, level: int, mode: str) -> DataFrame:
        """(channel, y, x, v) of a level in a mode: as it is, or one channel over the thumbnail's range."""
        if mode in ("color", "multichannel"):
            return self.pixels(level)
        thumb = len(self.sizes) - 1
        ends = masks.contrast_ranges(self.rgb(thumb), *self.sizes[thumb][:2], (mode,))
        return masks.in_contrast(self.rgb(level), mode, ends, *self.sizes[level][:2]).select(F.lit(0).alias("channel"), "y", "x", "v")


def align_slides(reference: Slide, moving: Slide, level: int = 0, size: int = 2500, block: int = 1024, keypoints: int = 2000, **search) -> Aligner:
    """The aligner of two slides' grey images, with the map that their thumbnails give."""
    ones, factors = [], []
    for s in (reference, moving):
        thumb = s.thumbnail(size)
        ones.append(cut(s.processed(thumb, "grayscale").select("y", "x", "v")))
        factors.append(s.downsample(thumb) / s.downsample(level))
    sides = [s.sizes[s.thumbnail(size)][:2] for s in (reference, moving)]
    height, width = max(h for h, _ in sides), max(w for _, w in sides)
    found = registration.feature_registration(*ones, height, width, n=keypoints, **search)
    h, w, _ = reference.sizes[level]
    packed = [tiles.pack(s.processed(level, "grayscale"), block) for s in (reference, moving)]
    return Aligner(packed[0], packed[1], block, -(-h // block), -(-w // block), found.matrix, *factors)


def run_job(spark: SparkSession, config: dict, block: int = 1024, size: int = 2500, pixel_size: float = 1.0, **search) -> str:
    """Bring a job's moving images into the frame of its reference and write all as one OME-TIFF; its path.

    Images keep the order of the configuration; a moving image that is the reference itself is not moved."""
    config = jobs.with_defaults(config)
    level = int(config["pyramid level"])
    images = jobs.image_list(spark, config).orderBy("place").collect()
    slides = [Slide(spark, os.path.join(config["input dir"], i.filename)) for i in images]
    h, w, _ = slides[0].sizes[level]
    out, names, at = None, [], 0
    for image, slide in zip(images, slides):
        shown = slide.processed(level, image.mode)
        channels = slide.sizes[level][2] if image.mode in ("color", "multichannel") else 1
        if slide.path != slides[0].path:
            aligner = align_slides(slides[0], slide, level, size, block, **search)
            moved = Aligner(aligner.reference, tiles.pack(shown, block), block, aligner.rows, aligner.columns, channels=list(range(channels)))
            shown = tiles.unpack(moved.warped(cut(aligner.matrices())), block, h, w)
        shown = shown.select((F.col("channel") + at).cast("int").alias("channel"), "y", "x", F.col("v").cast("double").alias("v"))
        own = image.names.split(", ")
        names += own * channels if len(own) == 1 and channels > 1 else own if len(own) == channels else [f"Mosaic {image.place + 1}"] * channels
        out = shown if out is None else out.unionByName(shown)
        at += channels
    path = config["output full path"]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    doubled = {n for n in names if names.count(n) > 1}
    numbered = [f"{n}_{names[: k + 1].count(n)}" if n in doubled else n for k, n in enumerate(names)]
    write_ome_tiff(cut(out), path, h, w, numbered, config["pixel size"] or pixel_size, config["pyramid downscale factor"], tile=max(16, min(1024, block)), dtype="u1", overwrite=True)
    return path


def flow_of_channels(image: DataFrame, height: int, width: int, reference: int, others: list[int], block: int, mask: DataFrame | None = None, sigma: float = 0.0, upsample: int = 10) -> DataFrame:
    """(channel, by, bx, dy, dx, error) of other channels of an image against one of its own; whole blocks only."""
    whole = image.filter((F.col("y") < height // block * block) & (F.col("x") < width // block * block))
    packed = cut(tiles.pack(whole, block))
    out = None
    for channel in others:
        found = tiles.block_shifts(packed.filter(F.col("channel") == reference), packed.filter(F.col("channel") == channel), block, mask, sigma, upsample, flow=True)
        rows = found.select(F.lit(channel).alias("channel"), "by", "bx", "dy", "dx", "error")
        out = rows if out is None else out.unionByName(rows)
    return out
