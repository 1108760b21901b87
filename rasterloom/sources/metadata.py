"""What a reader knows of a slide before any pixel is read: levels, axes, tiles and pixel sizes, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import level_count

#: File endings of the two vendor kinds (fixed values); every other file is an OME-TIFF.
ENDINGS = {".svs": "svs", ".ndpi": "svs", ".vsi": "vsi"}


def reader_kind(path: str = "path") -> Column:
    """Which reader opens a file, by its last ending; case counts."""
    ending = F.regexp_extract(F.col(path), r"(\.[^./\\]+)$", 1)
    known = F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv])
    return F.coalesce(known[ending], F.lit("ome"))


def is_ome_tiff(path: str = "path") -> Column:
    return F.col(path).endswith(".ome.tif") | F.col(path).endswith(".ome.tiff")


def under(path: str, folder: str) -> Column:
    """The path without the folder it lies in."""
    return F.when(F.col(path).startswith(folder), F.expr(f"substring({path}, {len(folder) + 1})")).otherwise(F.col(path))


def axis_report(shapes: DataFrame) -> DataFrame:
    """(slide, level, rank_ok, axis_ok) of rows (slide, level, shape, channel_axis).

    A level has three axes, and the channel axis should be the smallest, the first of equals."""
    smallest = F.array_position("shape", F.array_min("shape")) - 1
    return shapes.select("slide", "level", (F.size("shape") == 3).alias("rank_ok"), (smallest == F.col("channel_axis")).alias("axis_ok"))


def normal_axes(shapes: DataFrame) -> DataFrame:
    """(slide, level, channels, height, width): the channel axis first, the others in their order."""
    rest = F.filter("shape", lambda _, i: i != F.col("channel_axis"))
    return shapes.select("slide", "level", F.element_at("shape", F.col("channel_axis") + 1).alias("channels"), rest[0].alias("height"), rest[1].alias("width"))


def normal_pixels(pixels: DataFrame, axes: str) -> DataFrame:
    """(channel, y, x, v) of pixels (i0, i1, i2, v) whose axes are named in order, such as "YXC"."""
    place = {name: f"i{k}" for k, name in enumerate(axes.upper())}
    return pixels.select(F.col(place["C"]).alias("channel"), F.col(place["Y"]).alias("y"), F.col(place["X"]).alias("x"), "v")


def _running(levels: DataFrame, ratio: Column, name: str) -> DataFrame:
    """Each level's product of the ratios up to it. A slide has a few dozen levels at most."""
    before = Window.partitionBy("slide").orderBy("level")
    steps = levels.withColumns({"h0": F.lag("height").over(before), "w0": F.lag("width").over(before)}).withColumn("ratio", F.coalesce(ratio, F.lit(1.0)))
    product = F.aggregate(F.collect_list("ratio").over(before), F.lit(1.0), lambda a, b: a * b)
    return steps.select("slide", "level", product.alias(name))


def level_downsamples(levels: DataFrame) -> DataFrame:
    """(slide, level, downsample) of (slide, level, height, width): the mean of both sides' ratios, level by level."""
    return _running(levels, (F.col("h0") / F.col("height") + F.col("w0") / F.col("width")) / 2, "downsample")


def zoom_downsamples(levels: DataFrame) -> DataFrame:
    """The same for zoom levels that are whole numbers of times smaller: ratios of heights, halves to even."""
    return _running(levels, F.rint(F.col("h0") / F.col("height")), "downsample")


def levels_to_make(images: DataFrame, most: int = 1024, factor: int = 2) -> DataFrame:
    """(slide, levels) of (slide, levels, channels, height, width): how many levels a slide has when it is read.

    Slides with several levels, and small ones, stay as they are; others get a pyramid from their base."""
    side = F.greatest("height", "width").cast("long")
    made = F.lit(1) + sum((F.ceil(side / F.lit(factor**k)) > most).cast("int") for k in range(40) if factor**k < 1 << 40)
    return images.select("slide", F.when((F.col("levels") > 1) | (F.greatest("channels", "height", "width") < most), F.col("levels")).otherwise(made).cast("int").alias("levels"))


def pyramid_from_base(pixels: DataFrame, height: int, width: int, most: int = 1024, factor: int = 2, whole: bool = True) -> DataFrame:
    """(level, channel, y, x, v): every level the means of factor^level blocks of the base itself.

    Rests that fill no block are left out; means of whole numbers are cut to whole numbers."""
    out = None
    for k in range(level_count(max(height, width), factor, most)):
        f = factor**k
        inner = pixels.filter((F.col("y") < height // f * f) & (F.col("x") < width // f * f))
        place = [F.expr(f"y div {f}").cast("int").alias("y"), F.expr(f"x div {f}").cast("int").alias("x")]
        mean = F.avg("v").cast("int") if whole else F.avg("v")
        level = inner.groupBy("channel", *place).agg(mean.alias("v")).select(F.lit(k).alias("level"), "channel", "y", "x", "v")
        out = level if out is None else out.unionByName(level)
    return out


def level_arrays(levels: DataFrame, tile: int = 1024, channels: int = 4, dtype: str = "|u1") -> DataFrame:
    """(slide, level, path, shape, chunks, dtype): the array that stands for each level of a tile store."""
    per_tile = F.array(F.lit(tile), F.lit(tile), F.lit(channels))
    shape = F.array(F.col("height").cast("int"), F.col("width").cast("int"), F.lit(channels))
    return levels.select("slide", "level", F.col("level").cast("string").alias("path"), shape.alias("shape"), per_tile.alias("chunks"), F.lit(dtype).alias("dtype"))


def chunk_places(keys: DataFrame) -> DataFrame:
    """(key, level, x, y) of chunk keys "level/y.x.channel"; keys of another form have nulls."""
    part = [F.regexp_extract("key", r"^(\d+)/(\d+)\.(\d+)\.(\d+)$", k) for k in (1, 2, 3)]
    level, y, x = (F.when(p != "", p.cast("int")) for p in part)
    return keys.select("key", level.alias("level"), x.alias("x"), y.alias("y"))


def tile_regions(tiles: DataFrame, levels: DataFrame, tile: int = 1024) -> DataFrame:
    """(slide, level, tx, ty, x, y, size): where tiles (slide, level, tx, ty) begin on the full image and how far they reach."""
    known = tiles.join(F.broadcast(levels.select("slide", "level", "downsample")), ["slide", "level"])  # a few dozen rows a slide
    at = lambda c: F.floor(F.col(c) * F.col("downsample") * tile).cast("long")
    return known.select("slide", "level", "tx", "ty", at("tx").alias("x"), at("ty").alias("y"), (F.col("downsample") * tile).alias("size"))


def native_tile_size(tiles: DataFrame, wanted: int = 1024) -> DataFrame:
    """(slide, tile_size): the multiple of a slide's larger tile side that covers the wanted size on its smaller one."""
    times = F.ceil(F.greatest(F.lit(wanted) / F.col("tile_h"), F.lit(wanted) / F.col("tile_w")))
    return tiles.select("slide", (times * F.greatest("tile_h", "tile_w")).cast("int").alias("tile_size"))


def named_objects(text: str, name: str) -> Column:
    """The JSON objects in a text that have this "name", as strings; the text itself need not be JSON."""
    quoted = "".join("\\" + c if not c.isalnum() and c != " " else c for c in name)
    return F.regexp_extract_all(F.col(text), F.lit(r'(\{[^{]*?"name":\s*"' + quoted + r'".*?\})'), F.lit(1))


def stored_pixel_sizes(metadata: DataFrame, name: str = "Physical pixel size") -> DataFrame:
    """(slide, pixel_size) of vendor metadata (slide, json): the first number of the value "(x, y)", else 1.

    The value is read by pattern and never evaluated."""
    value = F.get_json_object(F.get(named_objects("json", name), F.lit(0)), "$.value")
    return metadata.select("slide", F.coalesce(F.regexp_extract(value, r"^\(\s*([0-9.eE+-]+)", 1).try_cast("double"), F.lit(1.0)).alias("pixel_size"))


def extents(images: DataFrame) -> DataFrame:
    """(slide, x0, x1, y0, y1) of (slide, height, width, factor): the rectangle around a thumbnail's pixels at full size, rows downwards."""
    return images.select("slide", F.lit(-0.5).alias("x0"), (F.col("width") * F.col("factor") - 0.5).alias("x1"), (F.col("height") * F.col("factor") - 0.5).alias("y0"), F.lit(-0.5).alias("y1"))


def channel_counts(images: DataFrame) -> DataFrame:
    """(slide, channels, single) of pixels (slide, channel, ...)."""
    return images.groupBy("slide").agg(F.countDistinct("channel").alias("channels")).select("slide", "channels", (F.col("channels") == 1).alias("single"))
