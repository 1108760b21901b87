"""Histogram operators: thresholds, rescaling and histogram matching. The histogram of an image
is one row a bin, so what follows the first aggregate is of fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """(bin, n, centre) over the value range; a constant image is one bin."""
    ends = pixels.agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_of = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(bins - 1)))
    filled = pixels.crossJoin(F.broadcast(ends)).groupBy(bin_of.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    return filled.select("bin", "n", (F.col("lo") + (F.col("bin") + 0.5) * width).alias("centre"))


def otsu(pixels: DataFrame) -> DataFrame:
    """One row, threshold: the centre of the bin that parts the histogram with most variance between."""
    h = histogram(pixels)
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    t = h.select("bin", "centre", F.sum("n").over(upto).alias("w1"), F.sum(F.col("n") * F.col("centre")).over(upto).alias("s1"), F.sum("n").over(after).alias("w2"), F.sum(F.col("n") * F.col("centre")).over(after).alias("s2"))
    gap = F.try_divide(F.col("s1"), F.col("w1")) - F.try_divide(F.col("s2"), F.col("w2"))
    t = t.withColumn("between", F.coalesce(F.round(F.col("w1") * F.col("w2") * gap * gap, 3), F.lit(-1.0)))
    return t.orderBy(F.desc("between"), "bin").limit(1).select(F.col("centre").alias("threshold"))


def triangle(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """One row, threshold: the bin farthest below the chord from the peak to the longer tail.

    Empty bins count, the peak itself does not; of two equal tails the lower one is taken, of equal
    bins the one nearest to the tail's end. A constant image has its value for a threshold."""
    h = histogram(pixels, bins)
    ends = h.agg(F.max(F.struct("n", (-F.col("bin")).alias("b"))).alias("top"), F.min(F.struct("bin", "centre")).alias("first"), F.max(F.struct("bin", "centre")).alias("last"))
    ends = ends.select(F.col("top.n").alias("peak_n"), (-F.col("top.b")).alias("peak"), "first", "last")
    high = F.col("last.bin") - F.col("peak") > F.col("peak") - F.col("first.bin")
    ends = ends.withColumn("tail", F.when(high, F.col("last.bin")).otherwise(F.col("first.bin")))
    away, full = F.abs(F.col("bin") - F.col("tail")), F.abs(F.col("peak") - F.col("tail"))
    every = ends.withColumn("bin", F.explode(F.expr("sequence(least(peak, tail), greatest(peak, tail))"))).filter((away < full) | (full == 0))
    drop = F.col("peak_n") * away - F.coalesce("n", F.lit(0)) * full
    step = F.coalesce((F.col("last.centre") - F.col("first.centre")) / F.nullif(F.col("last.bin") - F.col("first.bin"), F.lit(0)), F.lit(0.0))
    centre = F.col("first.centre") + (F.col("bin") - F.col("first.bin")) * step
    return every.join(h.select("bin", "n"), "bin", "left").select(drop.alias("drop"), away.alias("away"), centre.alias("threshold")).orderBy(F.desc("drop"), "away").limit(1).select("threshold")


def brightfield(pixels: DataFrame, threshold: DataFrame) -> DataFrame:
    """One row: whether what lies above the threshold of texture is darker than the rest.

    pixels has v and the texture t; threshold is one row."""
    joined = pixels.crossJoin(F.broadcast(threshold))
    inner = F.expr("percentile(case when t > threshold then v end, 0.5)")
    outer = F.expr("percentile(case when t <= threshold then v end, 0.5)")
    return joined.agg(inner.alias("inside"), outer.alias("outside")).select("inside", "outside", (F.col("inside") < F.col("outside")).alias("brightfield"))


def rescaled(pixels: DataFrame, low: float, high: float, rounding: str = "truncate") -> DataFrame:
    """Values between low and high stretched to 0..255, truncated or rounded half to even."""
    unit = (F.least(F.greatest(F.col("v").cast("double"), F.lit(float(low))), F.lit(float(high))) - float(low)) / float(high - low) * 255
    return pixels.select("y", "x", (F.rint(unit) if rounding == "even" else unit).cast("int").alias("v"))


def matched_histogram(pixels: DataFrame, reference: DataFrame) -> DataFrame:
    """(v, matched): each value of one image mapped to the value of equal cumulative share in the
    other, linear between its values and flat outside."""

    def shares(df: DataFrame) -> DataFrame:
        counts = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        total = counts.agg(F.sum("n").alias("total"))
        upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counts.crossJoin(F.broadcast(total)).select(F.col("v").cast("double").alias("v"), (F.sum("n").over(upto) / F.col("total")).alias("q"))

    # both images' values in order of their shares, each value next to the reference's steps around it
    ref, own = shares(reference), shares(pixels)
    along = Window.orderBy("q")
    steps = ref.select(F.col("v").alias("v1"), F.col("q").alias("q1"), F.lead("v").over(along).alias("v2"), F.lead("q").over(along).alias("q2"))
    low = ref.agg(F.min("v").alias("least"), F.min("q").alias("q0"))
    none = F.lit(None).cast("struct<v1:double,q1:double,v2:double,q2:double>")
    line = steps.select(F.col("q1").alias("q"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("v"), F.struct("v1", "q1", "v2", "q2").alias("s")).unionByName(own.select("q", F.lit(1).alias("kind"), "v", none.alias("s")))
    upto = Window.orderBy("q", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a distinct value
    found = line.withColumn("s", F.last("s", ignorenulls=True).over(upto)).filter("kind = 1").select("v", "q", "s.*").crossJoin(F.broadcast(low))
    between = F.col("v1") + F.coalesce((F.col("q") - F.col("q1")) / (F.col("q2") - F.col("q1")) * (F.col("v2") - F.col("v1")), F.lit(0.0))
    return found.select(F.col("v").cast("int").alias("v"), F.round(F.when(F.col("q") < F.col("q0"), F.col("least")).otherwise(between), 6).alias("matched"))


def stretched(pixels: DataFrame, low: float, high: float, out_low: float = 0.0, out_high: float = 1.0) -> DataFrame:
    """Values between low and high laid out from out_low to out_high, cut off beyond."""
    unit = (F.least(F.greatest(F.col("v").cast("double"), F.lit(float(low))), F.lit(float(high))) - float(low)) / float(high - low)
    return pixels.select("y", "x", (unit * (out_high - out_low) + out_low).alias("v"))


def log_stretched(pixels: DataFrame) -> DataFrame:
    """For display: from the 1st to the 99th percentile laid out from 500 to 5000, as logarithms."""
    ends = F.broadcast(pixels.agg(F.percentile("v", F.lit(0.01)).alias("lo"), F.percentile("v", F.lit(0.99)).alias("hi")))  # one row
    unit = (F.least(F.greatest("v", "lo"), "hi") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return pixels.crossJoin(ends).select("y", "x", F.log(F.coalesce(unit, F.lit(0.0)) * 4500 + 500).alias("v"))


def normalised(image: DataFrame) -> DataFrame:
    """Values spread to 0..255 by the image's own ends, half to even; a flat image is 0."""
    ends = F.broadcast(image.agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi")))  # one row
    spread = F.when(F.col("hi") > F.col("lo"), F.rint((F.col("v") - F.col("lo")) * (255 / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))))).otherwise(0)
    return image.crossJoin(ends).select("y", "x", spread.cast("int").alias("v"))
