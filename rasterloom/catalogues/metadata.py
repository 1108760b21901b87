"""Queries over what is known of slides before pixels are read, and over names and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..plans import jobs
from ..sources import metadata, rasters, slides

#: Levels (slide, level, height, width) of slides with and without an even pyramid.
LEVELS = [("a", 0, 1000, 800), ("a", 1, 500, 400), ("a", 2, 250, 200), ("b", 0, 4097, 3001), ("b", 1, 1024, 750), ("b", 2, 256, 187), ("c", 0, 700, 900)]
#: Shapes (slide, level, shape, channel axis) as files give them.
SHAPES = [("a", 0, [3, 1000, 800], 0), ("a", 1, [3, 500, 400], 0), ("b", 0, [4097, 3001, 3], 2), ("c", 0, [2, 9, 5], 1), ("d", 0, [50, 60], 0)]
PATHS = ["in/P_C01R1_CD8.svs", "in/x.ndpi", "in/y.vsi", "in/z.ome.tif", "in/z.ome.tiff", "in/u.SVS", "in/v.tif"]
KEYS = ["0/3.4.0", "2/10.0.0", ".zattrs", "1/.zarray"]
JSON = [("a", '{"x": [{"name": "Gain", "value": "1"}, {"name": "Physical pixel size", "value": "(0.325, 0.326)"}]}'), ("b", '{"name":  "Physical pixel size", "value": "( 1.5e-1,2)"}'), ("c", "{}")]
XML = [("a", '<OME><Pixels PhysicalSizeX="0.3249012345" SizeX="3"/></OME>'), ("b", '<Pixels PhysicalSizeXUnit="nm" PhysicalSizeX="3.25E+2">'), ("c", '<Pixels PhysicalSizeX="4" PhysicalSizeXUnit="Å">'), ("d", '<Pixels PhysicalSizeX="4" PhysicalSizeXUnit="pixel">'), ("e", "<Pixels>")]
MOSAICS = [1, 2, 3, 4, 5]
GIVEN = [["x"], ["x"], ["x"], ["x", "x"]]
GLOBS = ["P_C01R3_Hem.svs", "P_C01R1_PD1.svs", "sub/P_C01R3_Hem.svs", "P_C04R1_CD8.ndpi"]


def _levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEVELS, "slide string, level int, height int, width int")


def _shapes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SHAPES, "slide string, level int, shape array<int>, channel_axis int")


def _texts(spark: SparkSession, rows: list, name: str) -> DataFrame:
    return spark.createDataFrame(rows if isinstance(rows[0], tuple) else [(r,) for r in rows], f"slide string, {name} string" if isinstance(rows[0], tuple) else f"{name} string")


def _tiles(spark: SparkSession) -> DataFrame:
    grid = spark.range(3).select(F.col("id").cast("int").alias("tx")).crossJoin(spark.range(2).select(F.col("id").cast("int").alias("ty")))  # a fixed grid of six
    return _levels(spark).select("slide", "level").crossJoin(grid)


def _base_pyramid(spark: SparkSession, d: str) -> DataFrame:
    base = rasters.density_raster(rasters.table(spark, d, "lineitem"), 61).withColumn("channel", F.lit(0))
    return metadata.pyramid_from_base(base, 61, 61, most=16)


def _names(spark: SparkSession) -> DataFrame:
    mosaics = spark.createDataFrame([*enumerate(MOSAICS)], "mosaic int, channels int")
    return names.mosaic_names(mosaics, spark.createDataFrame([*enumerate(GIVEN)], "mosaic int, names array<string>"))


def _descriptions(spark: SparkSession, d: str) -> DataFrame:
    count, text = names.replaced("p_name", "a", "<a/>")
    return rasters.table(spark, d, "part").select("p_partkey", count.alias("found"), text.alias("p_name"))


def _channels(spark: SparkSession, d: str) -> DataFrame:
    items = rasters.table(spark, d, "lineitem")
    return metadata.channel_counts(items.select((F.col("l_suppkey") % 7).alias("slide"), (F.col("l_linenumber") % (F.col("l_suppkey") % 7 + 1)).alias("channel")))


def queries() -> dict:
    return {
        "reader_dispatch": lambda s, d: _texts(s, PATHS, "path").select("path", metadata.reader_kind().alias("reader"), metadata.is_ome_tiff().alias("ome_tiff"), metadata.under("path", "in/").alias("name")),
        "axis_report": lambda s, d: metadata.axis_report(_shapes(s)),
        "axis_order": lambda s, d: metadata.normal_axes(_shapes(s).filter(F.size("shape") == 3)),
        "level_downsamples": lambda s, d: metadata.level_downsamples(_levels(s)),
        "zoom_downsamples": lambda s, d: metadata.zoom_downsamples(_levels(s)),
        "levels_to_make": lambda s, d: metadata.levels_to_make(s.createDataFrame([("a", 1, 3, 5000, 3000), ("b", 3, 3, 5000, 3000), ("c", 1, 3, 1023, 900), ("d", 1, 3, 1025, 10), ("e", 1, 1, 1024, 4)], "slide string, levels int, channels int, height int, width int")),
        "pyramid_from_base": _base_pyramid,
        "level_arrays": lambda s, d: metadata.level_arrays(_levels(s)).select("slide", "path", F.concat_ws(",", F.col("shape").cast("array<string>")).alias("shape"), F.concat_ws(",", F.col("chunks").cast("array<string>")).alias("chunks"), "dtype"),
        "chunk_places": lambda s, d: metadata.chunk_places(_texts(s, KEYS, "key")),
        "tile_regions": lambda s, d: metadata.tile_regions(_tiles(s), metadata.level_downsamples(_levels(s))).withColumn("size", F.round("size", 6)),
        "zoom_regions": lambda s, d: metadata.tile_regions(_tiles(s), metadata.zoom_downsamples(_levels(s)), 512),
        "native_tile_size": lambda s, d: metadata.native_tile_size(s.createDataFrame([("a", 512, 512), ("b", 300, 512), ("c", 2048, 1024)], "slide string, tile_h int, tile_w int")),
        "stored_pixel_sizes": lambda s, d: metadata.stored_pixel_sizes(_texts(s, JSON, "json")),
        "ome_pixel_sizes": lambda s, d: slides.pixel_sizes(_texts(s, XML, "xml")).withColumn("pixel_size", F.round("pixel_size", 9)),
        "thumbnail_extents": lambda s, d: metadata.extents(s.createDataFrame([("a", 250, 200, 4.0), ("b", 10, 30, 2.5)], "slide string, height int, width int, factor double")),
        "channel_counts": _channels,
        "mosaic_names": lambda s, d: _names(s),
        "file_numbers": lambda s, d: rasters.table(s, d, "part").select("p_partkey", names.numbered("p_partkey", "p_name").alias("name")),
        "replaced_text": _descriptions,
        "log_names": lambda s, d: rasters.table(s, d, "orders").select("o_orderkey", names.log_name("o_orderstatus", "o_orderdate").alias("name")),
        "glob_match": lambda s, d: _texts(s, GLOBS, "name").select("name", names.glob_like("name", "*[Hh]em*.svs").alias("hem"), names.glob_like("name", "P_C0?R1_*.*").alias("first")),
        "job_images": lambda s, d: jobs.image_list(s, jobs.EXAMPLE),
        "aligner_levels": lambda s, d: jobs.aligner_levels(metadata.level_downsamples(_levels(s)), {"a": 0.5, "b": 0.25}, "a", "b"),
        "multires_levels": lambda s, d: jobs.multires_levels(_levels(s).filter("slide = 'b'"), block=256, level1=0, least_blocks=4),
    }


def _rows(rows: list[tuple], names_: str) -> str:
    def lit(v) -> str:
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return "[" + ", ".join(map(lit, v)) + "]" if isinstance(v, list) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") t({names_})"


_LEVELS = _rows(LEVELS, "slide, level, height, width")
_RATIO = f"r AS (SELECT *, lag(height) OVER w AS h0, lag(width) OVER w AS w0 FROM {_LEVELS} WINDOW w AS (PARTITION BY slide ORDER BY level))"


def _product(step: str, name: str) -> str:
    return f"WITH {_RATIO}, s AS (SELECT slide, level, coalesce({step}, 1e0) AS q FROM r) SELECT slide, level, list_reduce(list(q) OVER (PARTITION BY slide ORDER BY level), lambda a, b: a * b) AS {name} FROM s"


_MEAN = _product("(CAST(h0 AS DOUBLE) / height + CAST(w0 AS DOUBLE) / width) / 2e0", "downsample")
_ZOOM = _product("round_even(CAST(h0 AS DOUBLE) / height, 0)", "downsample")


def oracle_sql() -> dict[str, str]:
    paths, shapes = _rows([(p,) for p in PATHS], "path"), _rows(SHAPES, "slide, level, shape, axis")
    least = "list_position(shape, list_min(shape)) - 1"
    regions = lambda q, tile: f"SELECT slide, level, CAST(a AS INTEGER) AS tx, CAST(b AS INTEGER) AS ty, CAST(floor(a * downsample * {tile}) AS BIGINT) AS x, CAST(floor(b * downsample * {tile}) AS BIGINT) AS y, round(downsample * {tile}, 6) AS size FROM ({q}), range(3) p(a), range(2) q(b)"
    base = "c AS (SELECT CAST(l_partkey % 61 AS INTEGER) AS y, CAST(l_orderkey % 61 AS INTEGER) AS x, CAST(sum(l_quantity) AS BIGINT) % 256 AS v FROM lineitem GROUP BY 1, 2), l AS (SELECT y, x, coalesce(v, 0) AS v FROM (SELECT CAST(r // 61 AS INTEGER) AS y, CAST(r % 61 AS INTEGER) AS x FROM range(3721) t(r)) LEFT JOIN c USING (y, x))"
    level = lambda k: f"SELECT {k} AS level, 0 AS channel, CAST(y // {1 << k} AS INTEGER) AS y, CAST(x // {1 << k} AS INTEGER) AS x, CAST(trunc(avg(v)) AS INTEGER) AS v FROM l WHERE y < {61 >> k << k} AND x < {61 >> k << k} GROUP BY 3, 4"
    px = {"a": 0.5, "b": 0.25}
    sized = f"d AS ({_MEAN}), p AS (SELECT *, downsample * CASE slide WHEN 'a' THEN {px['a']}e0 ELSE {px['b']}e0 END AS px FROM d WHERE slide IN ('a', 'b')), t AS (SELECT min(m) AS target FROM (SELECT max(px) AS m FROM p GROUP BY slide)), n AS (SELECT slide, level AS thumb, downsample AS far FROM p, t QUALIFY row_number() OVER (PARTITION BY slide ORDER BY abs(px - target), px, level) = 1)"
    return {
        "reader_dispatch": f"SELECT path, CASE WHEN suffix(path, '.svs') OR suffix(path, '.ndpi') THEN 'svs' WHEN suffix(path, '.vsi') THEN 'vsi' ELSE 'ome' END AS reader, suffix(path, '.ome.tif') OR suffix(path, '.ome.tiff') AS ome_tiff, substr(path, 4) AS name FROM {paths}",
        "axis_report": f"SELECT slide, level, len(shape) = 3 AS rank_ok, {least} = axis AS axis_ok FROM {shapes}",
        "axis_order": f"SELECT slide, level, shape[axis + 1] AS channels, CASE WHEN axis = 0 THEN shape[2] ELSE shape[1] END AS height, CASE WHEN axis = 2 THEN shape[2] ELSE shape[3] END AS width FROM {shapes} WHERE len(shape) = 3",
        "level_downsamples": _MEAN,
        "zoom_downsamples": _ZOOM,
        "levels_to_make": "SELECT * FROM (VALUES ('a', 4), ('b', 3), ('c', 1), ('d', 2), ('e', 1)) t(slide, levels)",
        "pyramid_from_base": f"WITH {base} {' UNION ALL '.join(map(level, range(3)))}",
        "level_arrays": f"SELECT slide, CAST(level AS VARCHAR) AS path, height || ',' || width || ',4' AS shape, '1024,1024,4' AS chunks, '|u1' AS dtype FROM {_LEVELS}",
        "chunk_places": f"""SELECT key, CASE WHEN ok THEN CAST(split_part(key, '/', 1) AS INTEGER) END AS level, CASE WHEN ok THEN CAST(split_part(split_part(key, '/', 2), '.', 2) AS INTEGER) END AS x,
            CASE WHEN ok THEN CAST(split_part(split_part(key, '/', 2), '.', 1) AS INTEGER) END AS y FROM (SELECT key, regexp_full_match(key, '[0-9]+/[0-9]+[.][0-9]+[.][0-9]+') AS ok FROM {_rows([(k,) for k in KEYS], 'key')})""",
        "tile_regions": regions(_MEAN, 1024),
        "zoom_regions": regions(_ZOOM, 512),
        "native_tile_size": "SELECT slide, CAST(ceil(greatest(1024e0 / h, 1024e0 / w)) * greatest(h, w) AS INTEGER) AS tile_size FROM (VALUES ('a', 512, 512), ('b', 300, 512), ('c', 2048, 1024)) t(slide, h, w)",
        "stored_pixel_sizes": f"""SELECT slide, coalesce(TRY_CAST(regexp_extract(json, '"Physical pixel size"[^}}]*"value": *"[(] *([0-9.e+-]+)', 1) AS DOUBLE), 1e0) AS pixel_size FROM {_rows(JSON, 'slide, json')}""",
        "ome_pixel_sizes": "SELECT * FROM (VALUES ('a', 0.324901235e0), ('b', 0.325e0), ('c', 0.0004e0), ('d', 1e0), ('e', 1e0)) t(slide, pixel_size)",
        "thumbnail_extents": "SELECT slide, -0.5e0 AS x0, w * f - 0.5e0 AS x1, h * f - 0.5e0 AS y0, -0.5e0 AS y1 FROM (VALUES ('a', 250, 200, 4e0), ('b', 10, 30, 2.5e0)) t(slide, h, w, f)",
        "channel_counts": "SELECT l_suppkey % 7 AS slide, count(DISTINCT l_linenumber % (l_suppkey % 7 + 1)) AS channels, count(DISTINCT l_linenumber % (l_suppkey % 7 + 1)) = 1 AS single FROM lineitem GROUP BY 1",
        "mosaic_names": f"""WITH m AS (SELECT * FROM {_rows([*enumerate(MOSAICS)], 'mosaic, channels')}), g AS (SELECT * FROM {_rows([*enumerate(GIVEN)], 'mosaic, names')}),
            b AS (SELECT mosaic, coalesce(channels, 0) AS c, coalesce(names, []) AS n FROM m FULL JOIN g USING (mosaic)),
            e AS (SELECT mosaic, unnest(range(c)) AS k, c, n FROM b), f AS (SELECT row_number() OVER (ORDER BY mosaic, k) - 1 AS place, CASE WHEN len(n) = 1 THEN n[1] WHEN len(n) = c THEN n[k + 1] ELSE 'Mosaic ' || (mosaic + 1) END AS name FROM e)
            SELECT CAST(place AS INTEGER) AS place, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || '_' || row_number() OVER (PARTITION BY name ORDER BY place) ELSE name END AS name FROM f""",
        "file_numbers": "SELECT p_partkey, CASE WHEN p_partkey < 10 THEN '0' ELSE '' END || p_partkey || '-' || p_name AS name FROM part",
        "replaced_text": "SELECT p_partkey, CAST(length(p_name) - length(replace(p_name, 'a', '')) AS INTEGER) AS found, replace(p_name, 'a', '<a/>') AS p_name FROM part",
        "log_names": "SELECT o_orderkey, o_orderstatus || '-run-' || strftime(o_orderdate, '%Y%m%d-%H%M%S') || '.log' AS name FROM orders",
        "glob_match": f"SELECT name, regexp_full_match(name, '[^/]*[Hh]em[^/]*[.]svs') AS hem, regexp_full_match(name, 'P_C0[^/]R1_[^/]*[.][^/]*') AS first FROM {_rows([(g,) for g in GLOBS], 'name')}",
        "job_images": f"SELECT * FROM {_rows([(k, i['filename'], i['output mode'], ', '.join(i.get('channel names') or [i.get('channel name') or f'File {k + 1}'])) for k, i in enumerate([jobs.EXAMPLE['reference image'], *jobs.EXAMPLE['moving images']])], 'place, filename, mode, names')}",
        "aligner_levels": f"WITH {sized}, o AS (SELECT r.level AS level1, r.px AS px1, r.downsample AS d1 FROM p r WHERE slide = 'a'), q AS (SELECT level1, px1, d1, coalesce(max(p.level), 0) AS level2 FROM o LEFT JOIN p ON p.slide = 'b' AND p.px < px1 GROUP BY 1, 2, 3) SELECT CAST(level1 AS INTEGER) AS level1, CAST(level2 AS INTEGER) AS level2, round((SELECT far FROM n WHERE slide = 'a') / d1, 6) AS ref_factor, round((SELECT far FROM n WHERE slide = 'b') / p.downsample, 6) AS moving_factor FROM q JOIN p ON p.slide = 'b' AND p.level = level2",
        "multires_levels": f"SELECT level, CAST(ceil(height / 256e0) AS INTEGER) AS rows, CAST(ceil(width / 256e0) AS INTEGER) AS columns FROM {_LEVELS} WHERE slide = 'b' AND ceil(height / 256e0) * ceil(width / 256e0) >= 4",
    }
