"""Whole jobs from their configuration: its checks, its images, and the levels that are aligned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import match_levels_nearest, match_levels_strict

#: Output modes of bright-field images (fixed values); fluorescent ones have the mode multichannel.
BRIGHT_MODES = ("aec", "hematoxylin", "color", "grayscale", "dab")
DEFAULTS = {"pyramid level": 0, "pyramid downscale factor": 4, "pixel size": None}

EXAMPLE = {
    "input dir": "slides",
    "output full path": "out/one.ome.tif",
    "reference image": {"filename": "P_C01R3_Hem.svs", "channel name": "Hem-C01R3", "output mode": "hematoxylin"},
    "moving images": [
        {"filename": "P_C01R1_PD1.svs", "output mode": "aec"},
        {"filename": "P_C04R1.svs", "channel names": ["R", "G", "B"], "output mode": "color"},
    ],
}


def problems(config: dict) -> list[str]:
    """What is wrong with a job's configuration; nothing if it can run."""
    out = []

    def wants(where: dict, key: str, kinds, needed: bool = False, extra=None) -> None:
        value = where.get(key)
        if value is None:
            out.extend([f"{key} is missing"] if needed else [])
        elif not isinstance(value, kinds) or isinstance(value, bool):
            out.append(f"{key} has the wrong type")
        elif extra and not extra(value):
            out.append(f"{key} has a wrong value")

    texts = lambda most: lambda v: 1 <= len(v) <= most and all(isinstance(x, str) for x in v)
    wants(config, "input dir", str, True)
    wants(config, "output full path", str, True, lambda v: v.endswith((".ome.tif", ".ome.tiff")))
    wants(config, "pixel size", (int, float))
    wants(config, "pyramid downscale factor", int, extra=lambda v: 2 <= v <= 32)
    wants(config, "pyramid level", (int, float))
    wants(config, "reference image", dict, True)
    moving = config.get("moving images", [])
    for image in [config.get("reference image", {}), *(moving if isinstance(moving, list) else [moving])]:
        if not isinstance(image, dict):
            out.append("an image is not described")
            continue
        bright = image.get("output mode") in BRIGHT_MODES
        wants(image, "filename", str, True)
        wants(image, "channel name", str)
        wants(image, "channel names", list, extra=texts(3 if bright else 1 << 20))
        wants(image, "output mode", str, True, lambda v: v in (*BRIGHT_MODES, "multichannel"))
        if "output channels" in image:
            wants(image, "output channels", list, extra=lambda v: not bright and all(isinstance(x, int) and x >= 1 for x in v))
    return out


def with_defaults(config: dict) -> dict:
    """The configuration with what it leaves out; ValueError where it cannot run."""
    if wrong := problems(config):
        raise ValueError("; ".join(wrong))
    return DEFAULTS | config


def image_list(spark: SparkSession, config: dict) -> DataFrame:
    """(place, filename, mode, names) of a job's images, the reference first; names joined by ", "."""
    config = with_defaults(config)
    moving = config.get("moving images", [])
    images = [config["reference image"], *(moving if isinstance(moving, list) else [moving])]
    rows = [(k, i["filename"], i["output mode"], ", ".join(i.get("channel names") or [i.get("channel name") or f"File {k + 1}"])) for k, i in enumerate(images)]
    return spark.createDataFrame(rows, "place int, filename string, mode string, names string")


def aligner_levels(downsamples: DataFrame, pixel_size: dict[str, float], one: str, two: str) -> DataFrame:
    """(level1, level2, ref_factor, moving_factor) for each level of slide one.

    level2 is the coarsest level of slide two that is finer; the factors are how much smaller than
    those levels the thumbnails are that match best."""
    sized = downsamples.filter(F.col("slide").isin(one, two)).withColumn("px", F.col("downsample") * F.create_map(*[F.lit(x) for kv in pixel_size.items() for x in kv])[F.col("slide")])
    thumbs = match_levels_nearest(sized.select(F.col("slide").alias("reader"), "level", "px")).withColumnsRenamed({"reader": "slide", "level": "thumb"})
    far = thumbs.join(downsamples.withColumnsRenamed({"level": "thumb", "downsample": "far"}), ["slide", "thumb"]).select("slide", "far")
    sides = {s: sized.filter(F.col("slide") == s).join(far, "slide") for s in (one, two)}
    pairs = match_levels_strict(sides[one].select("level", "px"), sides[two].select("level", "px"))
    factor = lambda s, level, name: sides[s].select(F.col("level").cast("int").alias(level), F.round(F.col("far") / F.col("downsample"), 6).alias(name))
    return pairs.join(factor(one, "level1", "ref_factor"), "level1").join(factor(two, "level2", "moving_factor"), "level2").select("level1", "level2", "ref_factor", "moving_factor")


def multires_levels(levels: DataFrame, block: int, level1: int = 0, least_blocks: int = 4) -> DataFrame:
    """(level, rows, columns): the levels from level1 on whose grids of blocks have at least so many blocks."""
    grid = levels.filter(F.col("level") >= level1).select("level", F.ceil(F.col("height") / block).cast("int").alias("rows"), F.ceil(F.col("width") / block).cast("int").alias("columns"))
    return grid.filter(F.col("rows") * F.col("columns") >= least_blocks)
