"""Masks of what is textured, and what is done to an image inside and outside of one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colour
from . import stencil, threshold


def entropy_mask(image: DataFrame, height: int, width: int, reach: int = 4) -> DataFrame:
    """(y, x, inside): where the local entropy of the image, laid out over 0 to 1000, lies above Otsu's cut."""
    ends = F.broadcast(image.agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi")))  # one row
    unit = F.coalesce((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0))
    spread = image.crossJoin(ends).select("y", "x", F.floor(unit * 1000).cast("int").alias("v"))
    texture = stencil.local_entropy(spread, reach, height, width).select("y", "x", F.round("entropy", 6).alias("v"))
    cut = F.broadcast(threshold.otsu(texture))  # one row
    return texture.crossJoin(cut).select("y", "x", (F.col("v") > F.col("threshold")).alias("inside"))


def block_mask(mask: DataFrame, block: int, share: float = 0.1) -> DataFrame:
    """(by, bx, inside): blocks of a mask (y, x, inside) of which more than a share is inside.

    A plain mean of each block; a smoothed one differs where a block is near the share."""
    at = [F.expr(f"int({c} div {block})").alias(n) for c, n in (("y", "by"), ("x", "bx"))]
    return mask.groupBy(*at).agg((F.avg(F.col("inside").cast("int")) > share).alias("inside"))


def background_mean(image: DataFrame, mask: DataFrame) -> DataFrame:
    """One row, fill: the mean of what lies outside a mask (y, x, inside)."""
    return image.join(mask, ["y", "x"]).agg(F.avg(F.when(~F.col("inside"), F.col("v"))).alias("fill"))


def outside_box_filled(image: DataFrame, mask: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """The image inside a box (rs, re, cs, ce) and the mean of its background elsewhere."""
    rs, re, cs, ce = box
    inside = (F.col("y") >= rs) & (F.col("y") < re) & (F.col("x") >= cs) & (F.col("x") < ce)
    return image.crossJoin(F.broadcast(background_mean(image, mask))).select("y", "x", F.when(inside, F.col("v").cast("double")).otherwise(F.col("fill")).alias("v"))


def masked_matched(image: DataFrame, mask: DataFrame, reference: DataFrame, ref_mask: DataFrame) -> DataFrame:
    """(y, x, v): inside its mask the image by the reference's histogram inside its own; outside the mean of the reference's background."""
    own, ref = image.join(mask, ["y", "x"]), reference.join(ref_mask, ["y", "x"])
    table = threshold.matched_histogram(own.filter("inside").select("v"), ref.filter("inside").select("v"))
    fill = F.broadcast(ref.agg(F.avg(F.when(~F.col("inside"), F.col("v"))).alias("fill")))  # one row
    found = own.join(table, "v", "left").crossJoin(fill)  # a row a value
    return found.select("y", "x", F.when(F.col("inside"), F.col("matched")).otherwise(F.col("fill")).alias("v"))


def configured_pair(left: DataFrame, right: DataFrame, left_mask: DataFrame, right_mask: DataFrame, which: str, scalar: int, flip: bool, height: int) -> tuple[DataFrame, DataFrame]:
    """The two images as one hypothesis has them: one side matched to the other, its intensities turned round
    where scalar is -1; the right one's rows turned round where flip is set."""
    if which not in ("left", "right"):
        raise ValueError("which side is adjusted is left or right")
    turned = lambda df: df.select("y", "x", (F.col("v") * scalar).alias("v"))
    if which == "right":
        right = masked_matched(turned(right), right_mask, left, left_mask)
    else:
        left = masked_matched(turned(left), left_mask, right, right_mask)
    return left, flipped(right, height) if flip else right


def flipped(image: DataFrame, height: int) -> DataFrame:
    return image.select((F.lit(height - 1) - F.col("y")).cast("int").alias("y"), "x", "v")


def image_pairs(one: DataFrame, two: DataFrame, height: int, width: int, bright: tuple[bool, bool], invert: bool = True) -> DataFrame:
    """(variant, side, y, x, v) of two images in four variants: by Otsu's cut, by the triangle's, histograms
    matched, and these whitened.

    bright tells which images are bright-field: there the dark is what is cut out. With invert, images of
    different kinds are matched after the dark one's intensities are turned round."""
    kinds = bright if invert else (bright[0], bright[0])
    out = None

    def add(variant: str, side: int, image: DataFrame) -> None:
        nonlocal out
        rows = image.select(F.lit(variant).alias("variant"), F.lit(side).alias("side"), "y", "x", F.col("v").cast("double").alias("v"))
        out = rows if out is None else out.unionByName(rows)

    for variant, cut in (("otsu", threshold.otsu), ("triangle", threshold.triangle)):
        for side, image in enumerate((one, two)):
            joined = image.crossJoin(F.broadcast(cut(image)))  # one row
            beyond = F.col("v") < F.col("threshold") if kinds[side] else F.col("v") > F.col("threshold")
            add(variant, side, joined.select("y", "x", beyond.cast("int").alias("v")))
    by = lambda image, table: image.join(table, "v").select("y", "x", F.col("matched").alias("v"))
    negative = lambda image: image.select("y", "x", (-F.col("v")).alias("v"))
    if not invert or bright[0] == bright[1]:
        pair = one, by(two, threshold.matched_histogram(two, one))
    elif bright[0]:
        pair = one, by(negative(two), threshold.matched_histogram(negative(two), one))
    else:
        pair = by(negative(one), threshold.matched_histogram(negative(one), two)), two
    for side, image in enumerate(pair):
        add("matched", side, image)
        add("whitened", side, stencil.whitened(image, 1.0, height, width))
    return out


def contrast_ranges(rgb: DataFrame, height: int, width: int, modes: tuple[str, ...] = ("grayscale", "hematoxylin", "aec", "dab")) -> DataFrame:
    """(mode, lo, hi): the ends of each mode's intensities on a thumbnail (y, x, r, g, b)."""
    out = None
    for mode in modes:
        rows = in_mode(rgb, mode, height, width).agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi")).select(F.lit(mode).alias("mode"), "lo", "hi")
        out = rows if out is None else out.unionByName(rows)
    return out


def in_mode(rgb: DataFrame, mode: str, height: int, width: int) -> DataFrame:
    """(y, x, v): a mode's intensity; the ink of aec goes through the 3 x 3 median."""
    image = rgb.select("y", "x", F.round(colour.processed(mode), 9).alias("v"))
    return stencil.median3(image, height, width) if mode == "aec" else image


def in_contrast(rgb: DataFrame, mode: str, ends: DataFrame, height: int, width: int, top: int = 255) -> DataFrame:
    """(y, x, unit, v): a mode's intensity over its thumbnail's range (lo, hi), from 0 to 1 and as whole numbers up to top, cut."""
    unit = F.coalesce((F.least(F.greatest("v", "lo"), "hi") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0))
    found = in_mode(rgb, mode, height, width).crossJoin(F.broadcast(ends.select("lo", "hi")))  # one row
    return found.select("y", "x", unit.alias("unit")).withColumn("v", (F.round(F.col("unit") * top, 6)).cast("int"))


def marker(rgb: DataFrame, height: int, width: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(y, x, v): ink after its median; with ends, laid out between them from 0 to 1; without, from 5 to 95 % of
    the largest as whole numbers up to 255."""
    ink = in_mode(rgb, "aec", height, width)
    if low is not None and high is not None:
        return threshold.stretched(ink, low, high)
    most = F.broadcast(ink.agg(F.max("v").alias("most")))  # one row
    unit = (F.least(F.greatest(F.col("v"), 0.05 * F.col("most")), 0.95 * F.col("most")) - 0.05 * F.col("most")) / F.nullif(0.9 * F.col("most"), F.lit(0.0))
    return ink.crossJoin(most).select("y", "x", F.rint(F.round(F.coalesce(unit, F.lit(0.0)) * 255, 6)).cast("int").alias("v"))


def thumbnail_pair(one: DataFrame, mask_one: DataFrame, two: DataFrame, mask_two: DataFrame) -> DataFrame:
    """(side, y, x, v) of two thumbnails, each laid out from its background's mean to the 99.9th percentile inside its mask."""
    out = None
    for side, (image, mask) in enumerate(((one, mask_one), (two, mask_two))):
        both = image.join(mask, ["y", "x"])
        ends = F.broadcast(both.agg(F.avg(F.when(~F.col("inside"), F.col("v"))).alias("lo"), F.percentile(F.when(F.col("inside"), F.col("v")), F.lit(0.999)).alias("hi")))  # one row
        unit = (F.least(F.greatest(F.col("v").cast("double"), "lo"), "hi") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
        rows = both.crossJoin(ends).select(F.lit(side).alias("side"), "y", "x", F.coalesce(unit, F.lit(0.0)).alias("v"))
        out = rows if out is None else out.unionByName(rows)
    return out
