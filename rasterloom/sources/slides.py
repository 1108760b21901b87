"""Slides as rows: their order, roles and channel names, and their pixel size from OME metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Micrometres in each length unit (fixed values).
MICROMETRES = {
    "Ym": 1e30, "Zm": 1e27, "Em": 1e24, "Pm": 1e21, "Tm": 1e18, "Gm": 1e15, "Mm": 1e12, "km": 1e9, "hm": 1e8, "dam": 1e7, "m": 1e6, "dm": 1e5, "cm": 1e4, "mm": 1e3,
    "µm": 1.0, "nm": 1e-3, "pm": 1e-6, "fm": 1e-9, "am": 1e-12, "zm": 1e-15, "ym": 1e-18, "Å": 1e-4, "in": 25400.0, "ft": 304800.0, "yd": 914400.0, "mi": 1609344000.0, "pt": 25400 / 72,
}


def slide_list(slides: DataFrame, reference_like: str) -> DataFrame:
    """(place, filename, channel, mode) of slides (filename) named ..._<block>_<marker>.svs.

    Ordered by block, then name; the first that is like the pattern is the reference at place 0.
    Every slide like the pattern has mode hematoxylin, the others aec. The list of one job's
    slides is short, so it is ranked in one task."""
    token = F.split("filename", "_")
    named = slides.select("filename", F.element_at(token, -2).alias("block"), F.regexp_replace(F.element_at(token, -1), r"\.svs", "").alias("marker"), F.col("filename").like(reference_like).alias("hit"))
    ranked = named.withColumn("k", F.row_number().over(Window.orderBy("block", "filename")))
    first = F.min(F.when(F.col("hit"), F.col("k"))).over(Window.partitionBy())
    place = F.when(F.col("k") == first, 0).when(F.col("k") < first, F.col("k")).otherwise(F.col("k") - 1)
    return ranked.select(place.cast("int").alias("place"), "filename", F.concat_ws("-", "marker", "block").alias("channel"), F.when(F.col("hit"), "hematoxylin").otherwise("aec").alias("mode"))


def pixel_sizes(metadata: DataFrame) -> DataFrame:
    """(slide, pixel_size) in micrometres of rows (slide, xml); 1 where no size can be read.

    The size is the first image's, any number; without a unit it is in micrometres, and units that
    have no length (pixels) count as unreadable."""
    tag = F.regexp_extract("xml", r"<(?:\w+:)?Pixels\b[^>]*>", 0)
    found = metadata.select("slide", F.regexp_extract(tag, r'\bPhysicalSizeX\s*=\s*"([^"]*)"', 1).try_cast("double").alias("size"), F.regexp_extract(tag, r'\bPhysicalSizeXUnit\s*=\s*"([^"]*)"', 1).alias("unit"))
    scale = F.create_map(*[F.lit(x) for kv in MICROMETRES.items() for x in kv])
    unit = F.when(F.col("unit") == "", "µm").otherwise(F.regexp_replace("unit", "\u03bc", "µ"))
    return found.select("slide", F.coalesce(F.col("size") * scale[unit], F.lit(1.0)).alias("pixel_size"))
