"""The named queries over the raster operators, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogues import alignment as alignment_catalogue
from .catalogues import images as images_catalogue
from .catalogues import metadata as metadata_catalogue
from .functions import affine, colour, geometry
from .operators import align, matching, objects, resample, stencil, threshold
from .plans import displacement
from .sinks import pyramid
from .sources import rasters, slides

SIZE = 64
#: Destination to source: a small turn and a half-pixel move.
BACK = (0.96, 0.12, 1.5, -0.12, 0.96, 2.25)

LEVELS = [("a", 0, 5000, 3000), ("b", 0, 1025, 400), ("c", 0, 500, 500), ("d", 0, 128000, 90000)]
PIXELS = [("r", 0, 1.0), ("r", 1, 2.0), ("r", 2, 4.0), ("s", 0, 0.5), ("s", 1, 1.0), ("s", 2, 2.0), ("s", 3, 8.0)]
NAMES = ["DAPI", "CD3", "DAPI", "CD8", "CD3", "DAPI", "Ki67"]

#: Boxes (id, rs, re, cs, ce) on a thumbnail.
BOXES = [(0, 0, 9, 0, 7), (1, 5, 30, 12, 44), (2, 40, 64, 3, 20), (3, 33, 36, 50, 64)]

SLIDES = ["P_C04R1_CD8.svs", "P_C01R1_PD1.svs", "P_C01R3_Hem.svs", "P_C03R1_CD3.svs", "P_C03R3_DCLAMP.svs", "P_C01R2_PDL1.svs", "P_C02R1_CD4.svs"]

Query = Callable[[SparkSession, str], DataFrame]


def _e(spark: SparkSession, d: str) -> DataFrame:
    return rasters.vector_raster(rasters.table(spark, d, "embeddings"))


def _l(spark: SparkSession, d: str) -> DataFrame:
    return rasters.density_raster(rasters.table(spark, d, "lineitem"), SIZE)


def _rgb(spark: SparkSession, d: str) -> DataFrame:
    return rasters.density_raster(rasters.table(spark, d, "lineitem"), SIZE, r="l_quantity", g="l_suppkey", b="l_linenumber")


def _levels(spark: SparkSession, reader: str) -> DataFrame:
    return spark.createDataFrame([(k, p) for r, k, p in PIXELS if r == reader], "level int, px double")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return displacement.constrained_shifts(spark, sf_dir)


def _merge(spark: SparkSession, d: str) -> DataFrame:
    rgb = _rgb(spark, d)
    one = rgb.select("y", "x", F.explode(F.array(*[F.struct(F.lit(k).alias("channel"), F.col(c).alias("v")) for k, c in enumerate("rgb")])).alias("p")).select("y", "x", "p.*")
    return one.unionByName(_l(spark, d).withColumn("channel", F.lit(3)))


def _brightfield(spark: SparkSession, d: str) -> DataFrame:
    image = _l(spark, d)
    texture = stencil.local_entropy(image, 4, SIZE, SIZE).withColumn("t", F.round("entropy", 6))
    cut = threshold.otsu(texture.select(F.col("t").alias("v")))
    out = threshold.brightfield(image.join(texture, ["y", "x"]), cut)
    return out.select(F.round("inside", 6).alias("inside"), F.round("outside", 6).alias("outside"), "brightfield")


def _match(spark: SparkSession, d: str) -> DataFrame:
    return threshold.matched_histogram(_e(spark, d).filter("x < 32"), _e(spark, d).filter("x >= 32"))


def _codes(spark: SparkSession, d: str, parity: int) -> DataFrame:
    e = _e(spark, d).filter(F.col("y") % 2 == parity)
    return e.groupBy(F.col("y").alias("id")).agg(F.bit_or(F.when(F.col("v") > 128, F.expr("shiftleft(1L, x)")).otherwise(F.lit(0).cast("long"))).alias("code"))


def _multires(spark: SparkSession, d: str) -> DataFrame:
    items = rasters.table(spark, d, "lineitem")
    rows = items.groupBy((F.col("l_partkey") % 16).cast("int").alias("by"), (F.col("l_suppkey") % 8).cast("int").alias("bx"), ((F.col("l_linenumber") - 1) % 3).cast("int").alias("level"))
    rows = rows.agg((F.sum("l_quantity").cast("long") % 7 - 3).cast("double").alias("dy"), (F.count(F.lit(1)) % 7 - 3).cast("double").alias("dx"), (F.sum("l_orderkey") % 3 == 0).alias("valid"))
    return align.finest_valid(rows.withColumn("ratio", F.expr("cast(shiftleft(1, level) as double)")))


def _objects(spark: SparkSession, d: str) -> DataFrame:
    items = rasters.table(spark, d, "lineitem").filter("l_quantity > 45")
    covers = items.select((F.col("l_partkey") % 32).cast("int").alias("by"), (F.col("l_orderkey") % 32).cast("int").alias("bx"), (F.col("l_suppkey") % 10).cast("int").alias("obj_id")).distinct()
    objects = covers.groupBy("obj_id").agg(F.count(F.lit(1)).alias("area"))
    cells = spark.range(32 * 32).select((F.col("id") / 32).cast("int").alias("by"), (F.col("id") % 32).cast("int").alias("bx"))
    return align.largest_object(cells, covers, objects)


def _boxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOXES, "id int, rs int, re int, cs int, ce int")


def _cover(spark: SparkSession, covered: bool) -> DataFrame:
    cells = spark.range(32 * 32).select((F.col("id") / 32).cast("int").alias("by"), (F.col("id") % 32).cast("int").alias("bx"))
    return objects.blocks_by_cover(cells, objects.boxes_in_blocks(_boxes(spark), 8, 16, 24), covered)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return objects.boxes_of(objects.label_objects(_l(spark, d).filter("v >= 200")))


def _flow(spark: SparkSession, d: str) -> DataFrame:
    s = displacement.block_shifts(spark, d)
    light, a, b = colour.flow_lab("dy", "dx", 2.0)
    return s.select("by", "bx", F.round(light, 6).alias("l"), F.round(a, 6).alias("a"), F.round(b, 6).alias("b"))


def _grid_shifts(spark: SparkSession, d: str) -> DataFrame:
    parts = rasters.table(spark, d, "part")
    known = F.col("p_size") % 7 != 0
    move = [F.when(known, v.cast("double")).alias(n) for n, v in (("dy", F.col("p_size") - 25), ("dx", F.floor("p_retailprice") % 11 - 5))]
    return parts.select(F.expr("p_partkey div 16").cast("int").alias("by"), (F.col("p_partkey") % 16).cast("int").alias("bx"), *move)


def _matches(spark: SparkSession, d: str) -> DataFrame:
    """Points of parts and where BACK moves them; two in seven are elsewhere."""
    a, b, c, e, f, g = BACK
    x, y = F.col("p_partkey") % 97, F.col("p_size").cast("double")
    wrong = F.when(F.col("p_partkey") % 7 < 2, F.col("p_partkey") % 1013 + 500).otherwise(0)
    return rasters.table(spark, d, "part").select((F.col("p_partkey") % 4).alias("config"), x.cast("double").alias("sx"), y.alias("sy"), (x * a + y * b + c + wrong).alias("tx"), (x * e + y * f + g - wrong).alias("ty"))


def _fitted(spark: SparkSession, d: str) -> DataFrame:
    fit = matching.spread_robust_affine(_matches(spark, d), reach=5.0)
    return fit.select("config", *[F.round(c, 6).alias(c) for c in affine.ENTRIES], "inliers", "matches")


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    counts = rasters.table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 8).alias("config")).agg(F.expr("count_if(l_quantity > 40)").alias("inliers"))
    return matching.best_configuration(counts, fold=1.05).withColumn("ratio", F.round("ratio", 6))


def _channels(spark: SparkSession, d: str) -> DataFrame:
    return _l(spark, d).withColumn("channel", F.lit(0)).unionByName(_rgb(spark, d).select("y", "x", F.col("g").alias("v"), F.lit(1).alias("channel")))


#: Further queries by subject, each with queries() and oracle_sql().
SUBJECTS = (metadata_catalogue, alignment_catalogue, images_catalogue)


def queries() -> dict[str, Query]:
    out = _raster_queries()
    for subject in SUBJECTS:
        out |= subject.queries()
    return out


def oracle_sql() -> dict[str, str]:
    out = _raster_sql()
    for subject in SUBJECTS:
        out |= subject.oracle_sql()
    return out


def _raster_queries() -> dict[str, Query]:
    return {
        "block_matrices": lambda s, d: affine.block_matrices(_grid_shifts(s, d), BACK),
        "full_scale_matrices": lambda s, d: affine.full_scale(s.createDataFrame([(float(r), float(m)) for r in (1, 4, 16) for m in (2, 8)], "ref_factor double, moving_factor double").select("*", *affine.columns_of(BACK))),
        "orientation_matrices": lambda s, d: affine.orientations(s.createDataFrame([(i, h, w) for i, _, h, w in LEVELS], "image string, h int, w int")),
        "robust_affine": _fitted,
        "best_configuration": _chosen,
        "pyramid_levels": lambda s, d: pyramid.pyramid_levels(_channels(s, d), 4),
        "raster_scan": _e,
        "density_scan": _l,
        "channel_extract": lambda s, d: _rgb(s, d).select("y", "x", F.col("g").alias("v")),
        "channel_merge": _merge,
        "grayscale": lambda s, d: _rgb(s, d).select("y", "x", colour.luma().alias("v")),
        "laplacian_sharpen": lambda s, d: stencil.laplacian(_e(s, d)),
        "box_downscale": lambda s, d: stencil.blocks_mean(_e(s, d), 2).withColumn("v", F.round("v", 6)),
        "coarsen_trunc": lambda s, d: stencil.coarsened(_l(s, d), 5, SIZE, SIZE),
        "mean_round_even": lambda s, d: stencil.blocks_mean(_l(s, d), 2).withColumn("v", F.rint("v").cast("int")),
        "mask_stride_pyramid": lambda s, d: stencil.strided(_l(s, d).withColumn("v", F.col("v") > 128), 2),
        "local_median3": lambda s, d: stencil.median3(_l(s, d), SIZE, SIZE),
        "local_entropy9": lambda s, d: stencil.local_entropy(_l(s, d), 4, SIZE, SIZE).withColumn("entropy", F.round("entropy", 6)),
        "otsu_threshold": lambda s, d: threshold.otsu(_e(s, d)).select(F.round("threshold", 6).alias("threshold")),
        "triangle_threshold": lambda s, d: threshold.triangle(_e(s, d)).select(F.round("threshold", 6).alias("threshold")),
        "brightfield_flag": _brightfield,
        "hist_match": _match,
        "rescale_trunc": lambda s, d: threshold.rescaled(_l(s, d), 20, 230),
        "rescale_round": lambda s, d: threshold.rescaled(_l(s, d), 20, 230, "even"),
        "cmyk_marker": lambda s, d: stencil.median3(_rgb(s, d).select("y", "x", F.round(colour.marker_ink(), 6).alias("v")), SIZE, SIZE),
        "stain_unmix": lambda s, d: _rgb(s, d).select("y", "x", F.round(colour.stain(0), 6).alias("hematoxylin"), F.round(colour.stain(1), 6).alias("aec")),
        "level_geometry": lambda s, d: geometry.level_geometry(s.createDataFrame([(i, h, w) for i, _, h, w in LEVELS], "image string, h long, w long")),
        "level_match_strict": lambda s, d: geometry.match_levels_strict(_levels(s, "r"), _levels(s, "s")),
        "level_match_nearest": lambda s, d: geometry.match_levels_nearest(s.createDataFrame(PIXELS, "reader string, level int, px double")),
        "channel_naming": lambda s, d: geometry.unique_names(s.createDataFrame([*enumerate(NAMES)], "place int, name string")),
        "block_shift_int": displacement.block_shifts,
        "block_shift_fft": displacement.fft_shifts,
        "constrain_shifts": displacement.constrained_shifts,
        "multires_coalesce": _multires,
        "object_priority": _objects,
        "warp_nearest": lambda s, d: resample.warp_nearest(_l(s, d), _l(s, d).select("y", "x"), BACK),
        "warp_bilinear": lambda s, d: resample.warp_bilinear(_l(s, d), _l(s, d).select("y", "x"), BACK),
        "mutual_nn_hamming": lambda s, d: align.mutual_nearest(_codes(s, d, 0), _codes(s, d, 1)),
        "flow_lab": _flow,
        "slide_list": lambda s, d: slides.slide_list(s.createDataFrame([(n,) for n in SLIDES], "filename string"), "%Hem%"),
        "repeat_upsample": lambda s, d: stencil.repeated(_l(s, d), 2, 3),
        "block_labels": lambda s, d: stencil.block_labels(_l(s, d), 24, 20, SIZE),
        "normalise_uint8": lambda s, d: threshold.normalised(_e(s, d)),
        "thumbnail_level": lambda s, d: geometry.thumbnail_level(geometry.level_geometry(s.createDataFrame([(i, h, w) for i, _, h, w in LEVELS], "image string, h long, w long")), 2000),
        "segment_objects": _segments,
        "transform_bbox": lambda s, d: objects.boxes_mapped(_boxes(s), BACK),
        "bbox_blocks": lambda s, d: objects.boxes_in_blocks(_boxes(s), 8, 16, 24),
        "blocks_covered": lambda s, d: _cover(s, True),
        "blocks_uncovered": lambda s, d: _cover(s, False),
    }


_E = "e AS (SELECT CAST(vec_id AS INTEGER) AS y, CAST(unnest(range(len(embedding))) AS INTEGER) AS x, CAST(floor((CAST(unnest(embedding) AS DOUBLE) + 1) * 128) AS INTEGER) AS v FROM embeddings)"
_AXIS = f"axis AS (SELECT CAST(r // {SIZE} AS INTEGER) AS y, CAST(r % {SIZE} AS INTEGER) AS x FROM range({SIZE * SIZE}) t(r))"
_CELLS = f"""cells AS (SELECT CAST(l_partkey % {SIZE} AS INTEGER) AS y, CAST(l_orderkey % {SIZE} AS INTEGER) AS x, CAST(CAST(sum(l_quantity) AS BIGINT) % 256 AS INTEGER) AS r,
    CAST(sum(l_suppkey) % 256 AS INTEGER) AS g, CAST(sum(l_linenumber) % 256 AS INTEGER) AS b FROM lineitem GROUP BY 1, 2)"""
_RGB = f"{_AXIS}, {_CELLS}, rgb AS (SELECT y, x, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM axis LEFT JOIN cells USING (y, x)), l AS (SELECT y, x, r AS v FROM rgb)"


def _steps(reach: int) -> str:
    return f"(SELECT CAST(r AS INTEGER) AS k FROM range({-reach}, {reach + 1}) t(r))"


_LAPLACE = """w AS (SELECT y, x, CAST(coalesce(lag(v) OVER a, v) + coalesce(lead(v) OVER a, v) + coalesce(lag(v) OVER d, v) + coalesce(lead(v) OVER d, v) - 4 * v AS INTEGER) AS w
    FROM e WINDOW a AS (PARTITION BY y ORDER BY x), d AS (PARTITION BY x ORDER BY y))"""
_ENTROPY = """{name} AS (SELECT y, x, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM (
    SELECT p.y, p.x, q.v, count(*) AS c FROM l p, {steps} a, {steps} b, l q WHERE q.y = p.y + a.k AND q.x = p.x + b.k GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
_SHIFTS = f"""f AS (SELECT CAST(y // 16 AS INTEGER) AS by_, CAST(x // 16 AS INTEGER) AS bx, y % 16 AS iy, x % 16 AS ix, w FROM w QUALIFY count(*) OVER (PARTITION BY y // 16, x // 16) = 256),
    m AS (SELECT by_, bx, (iy - (by_ % 3 - 1) + 16) % 16 AS iy, (ix - (bx % 3 - 1) + 16) % 16 AS ix, w AS w2 FROM f),
    mv AS (SELECT by_, bx, (iy + a.k + 16) % 16 AS iy, (ix + b.k + 16) % 16 AS ix, w2, a.k AS dy, b.k AS dx FROM m, {_steps(2)} a, {_steps(2)} b),
    sc AS (SELECT by_, bx, dy, dx, CAST(sum(CAST(w AS BIGINT) * w2) AS BIGINT) AS score FROM f JOIN mv USING (by_, bx, iy, ix) GROUP BY 1, 2, 3, 4),
    sh AS (SELECT by_ AS "by", bx, dy, dx, score FROM sc QUALIFY row_number() OVER (PARTITION BY by_, bx ORDER BY score DESC, dy, dx) = 1)"""
_HIST = "ends AS (SELECT CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM e), h AS (SELECT CAST(least(floor((v - lo) / ((hi - lo) / 256)), 255) AS INTEGER) AS bin, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM e, ends GROUP BY 1), hc AS (SELECT bin, n, lo + (bin + 0.5e0) * ((hi - lo) / 256) AS centre FROM h)"


def _otsu(rows: str, v: str) -> str:
    """CTEs whose last, cut(threshold), has Otsu's threshold of a column over 256 bins."""
    return f"""oe AS (SELECT CAST(min({v}) AS DOUBLE) AS lo, CAST(max({v}) AS DOUBLE) AS hi FROM {rows}), oh AS (SELECT CAST(least(floor(({v} - lo) / ((hi - lo) / 256)), 255) AS INTEGER) AS bin, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM {rows}, oe GROUP BY 1),
    oc AS (SELECT bin, n, lo + (bin + 0.5e0) * ((hi - lo) / 256) AS centre FROM oh), ot AS (SELECT bin, centre, sum(n) OVER u AS w1, sum(n * centre) OVER u AS s1, sum(n) OVER r AS w2, sum(n * centre) OVER r AS s2 FROM oc
    WINDOW u AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), r AS (ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    cut AS (SELECT centre AS threshold FROM ot ORDER BY coalesce(round(CAST(w1 AS DOUBLE) * CAST(w2 AS DOUBLE) * pow(s1 / w1 - s2 / w2, 2), 3), -1) DESC, bin LIMIT 1)"""


def _triangle(rows: str, v: str, name: str) -> str:
    """CTEs whose last, name(threshold), has the triangle's threshold of a column over 256 bins, empty ones too."""
    return f"""{name}e AS (SELECT CAST(min({v}) AS DOUBLE) AS lo, CAST(max({v}) AS DOUBLE) AS hi FROM {rows}), {name}h AS (SELECT CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor(({v} - lo) / ((hi - lo) / 256)), 255) AS INTEGER) END AS bin, count(*) AS n FROM {rows}, {name}e GROUP BY 1),
    {name}p AS (SELECT n AS peak_n, bin AS peak FROM {name}h ORDER BY n DESC, bin LIMIT 1), {name}b AS (SELECT min(bin) AS f, max(bin) AS l FROM {name}h), {name}g AS (SELECT *, CASE WHEN l - peak > peak - f THEN l ELSE f END AS tail FROM {name}p, {name}b),
    {name}k AS (SELECT CAST(r AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(256) q(r) LEFT JOIN {name}h ON bin = r),
    {name} AS (SELECT lo + (bin + 0.5e0) * ((hi - lo) / 256) AS threshold FROM {name}k, {name}g, {name}e WHERE bin BETWEEN least(peak, tail) AND greatest(peak, tail) AND (bin <> peak OR peak = tail) ORDER BY peak_n * abs(bin - tail) - n * abs(peak - tail) DESC, abs(bin - tail) LIMIT 1)"""


def _plane_sql(rows: str, v: str, name: str) -> str:
    """CTEs whose last, name(c, a, b), has the least-squares plane c + a * by + b * bx of a column."""
    return f"""{name}m AS (SELECT avg({v}) AS mv, avg(by_) AS my, avg(bx) AS mx, regr_sxx(by_, by_) AS syy, regr_sxx(bx, bx) AS sxx, coalesce(regr_sxy(by_, bx), 0) AS syx, coalesce(regr_sxy({v}, by_), 0) AS syv, coalesce(regr_sxy({v}, bx), 0) AS sxv FROM (SELECT CAST(by_ AS DOUBLE) AS by_, CAST(bx AS DOUBLE) AS bx, CAST({v} AS DOUBLE) AS {v} FROM {rows})),
    {name}d AS (SELECT *, syy * sxx - syx * syx AS det FROM {name}m), {name}s AS (SELECT *, CASE WHEN abs(det) > 1e-9 THEN (syv * sxx - sxv * syx) / det WHEN syy > 1e-9 THEN syv / syy ELSE 0 END AS a, CASE WHEN abs(det) > 1e-9 THEN (sxv * syy - syv * syx) / det WHEN syy <= 1e-9 AND sxx > 1e-9 THEN sxv / sxx ELSE 0 END AS b FROM {name}d),
    {name} AS (SELECT mv - a * my - b * mx AS c, a, b FROM {name}s)"""


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS {'DOUBLE' if isinstance(v, float) else 'BIGINT'})"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") t({names})"


def _raster_sql() -> dict[str, str]:
    a, b, c, d, e, f = BACK
    src = f"src AS (SELECT y, x, x * {a}e0 + y * {b}e0 + {c}e0 AS sx, x * {d}e0 + y * {e}e0 + {f}e0 AS sy FROM l)"
    ink = "SELECT y, x, 1 - r / 255e0 AS c, 1 - g / 255e0 AS m, 1 - b / 255e0 AS k2, least(1 - r / 255e0, 1 - g / 255e0, 1 - b / 255e0) AS k FROM rgb"
    stain = lambda k: f"round({images_catalogue.stain_sql(colour.HAX, k)}, 6)"
    level_rows = _values([(i, h, w) for i, _, h, w in LEVELS], "image, h, w")
    up = lambda n, p: f"(({n} + {p} - 1) // {p})"
    tile = lambda n: f"CAST((({n} + ({n} + 1023) // 1024 - 1) // (({n} + 1023) // 1024) + 15) // 16 * 16 AS BIGINT)"
    px = _values(PIXELS, "reader, level, px")
    share = lambda name, cond: f"{name}c AS (SELECT v, count(*) AS n FROM e WHERE {cond} GROUP BY v), {name} AS (SELECT CAST(v AS DOUBLE) AS v, sum(n) OVER (ORDER BY v) / CAST((SELECT sum(n) FROM {name}c) AS DOUBLE) AS q FROM {name}c)"
    codes = lambda name, parity: f"{name} AS (SELECT y AS id, bit_or(CASE WHEN v > 128 THEN CAST(1 AS UBIGINT) << x ELSE CAST(0 AS UBIGINT) END) AS code FROM e WHERE y % 2 = {parity} GROUP BY y)"
    rescale = lambda how: f"WITH {_RGB} SELECT y, x, CAST({how}((least(greatest(CAST(v AS DOUBLE), 20e0), 230e0) - 20e0) / 210e0 * 255) AS INTEGER) AS v FROM l"
    median = f"""WITH {_RGB} SELECT p.y, p.x, CAST(median(q.v) AS DOUBLE) AS v FROM l p, {_steps(1)} a, {_steps(1)} b, l q
        WHERE q.y = least(greatest(p.y + a.k, 0), {SIZE - 1}) AND q.x = least(greatest(p.x + b.k, 0), {SIZE - 1}) GROUP BY 1, 2"""
    boxes = _values(BOXES, "id, rs, re, cs, ce")
    ranges = f"SELECT CAST(id AS INTEGER) AS id, CAST(floor(rs * 8e0 / 16) AS INTEGER) AS rs, CAST(ceil(re * 8e0 / 16) AS INTEGER) AS re, CAST(floor(cs * 8e0 / 24) AS INTEGER) AS cs, CAST(ceil(ce * 8e0 / 24) AS INTEGER) AS ce FROM {boxes}"
    grid = 'SELECT CAST(r // 32 AS INTEGER) AS "by", CAST(r % 32 AS INTEGER) AS bx FROM range(1024) t(r)'
    inside = 'g."by" >= k.rs AND g."by" < k.re AND g.bx >= k.cs AND g.bx < k.ce'
    flow = "sqrt(CAST(dy * dy + dx * dx AS DOUBLE))"
    return {
        "raster_scan": f"WITH {_E} SELECT y, x, v FROM e",
        "density_scan": f"WITH {_RGB} SELECT y, x, v FROM l",
        "channel_extract": f"WITH {_RGB} SELECT y, x, g AS v FROM rgb",
        "channel_merge": f"WITH {_RGB} SELECT y, x, 0 AS channel, r AS v FROM rgb UNION ALL SELECT y, x, 1, g FROM rgb UNION ALL SELECT y, x, 2, b FROM rgb UNION ALL SELECT y, x, 3, v FROM l",
        "grayscale": f"WITH {_RGB} SELECT y, x, CAST(round_even(0.299e0 * r + 0.587e0 * g + 0.114e0 * b, 0) AS INTEGER) AS v FROM rgb",
        "laplacian_sharpen": f"WITH {_E}, {_LAPLACE} SELECT y, x, w FROM w",
        "box_downscale": f"WITH {_E} SELECT CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, round(avg(v), 6) AS v FROM e GROUP BY 1, 2",
        "coarsen_trunc": f"WITH {_RGB} SELECT CAST(y // 5 AS INTEGER) AS y, CAST(x // 5 AS INTEGER) AS x, CAST(trunc(avg(v)) AS INTEGER) AS v FROM l WHERE y < {SIZE // 5 * 5} AND x < {SIZE // 5 * 5} GROUP BY 1, 2",
        "mean_round_even": f"WITH {_RGB} SELECT CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, CAST(round_even(avg(v), 0) AS INTEGER) AS v FROM l GROUP BY 1, 2",
        "mask_stride_pyramid": f"WITH {_RGB} SELECT CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, v > 128 AS v FROM l WHERE y % 2 = 0 AND x % 2 = 0",
        "local_median3": median,
        "local_entropy9": f"WITH {_RGB}, {_ENTROPY.format(name='h', steps=_steps(4))} SELECT y, x, round(entropy, 6) AS entropy FROM h",
        "otsu_threshold": f"""WITH {_E}, {_HIST}, t AS (SELECT bin, centre, sum(n) OVER u AS w1, sum(n * centre) OVER u AS s1, sum(n) OVER r AS w2, sum(n * centre) OVER r AS s2 FROM hc
            WINDOW u AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), r AS (ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
            SELECT round(centre, 6) AS threshold FROM t ORDER BY coalesce(round(CAST(w1 AS DOUBLE) * CAST(w2 AS DOUBLE) * pow(s1 / w1 - s2 / w2, 2), 3), -1) DESC, bin LIMIT 1""",
        "triangle_threshold": f"WITH {_E}, {_triangle('e', 'v', 't')} SELECT round(threshold, 6) AS threshold FROM t",
        "brightfield_flag": f"""WITH {_RGB}, {_ENTROPY.format(name='g', steps=_steps(4))}, j AS (SELECT v, round(entropy, 6) AS t FROM l JOIN g USING (y, x)), {_otsu("j", "t")},
            m AS (SELECT median(v) FILTER (WHERE t > threshold) AS inside, median(v) FILTER (WHERE t <= threshold) AS outside FROM j, cut) SELECT CAST(inside AS DOUBLE) AS inside, CAST(outside AS DOUBLE) AS outside, inside < outside AS brightfield FROM m""",
        "hist_match": f"""WITH {_E}, {share("o", "x < 32")}, {share("r", "x >= 32")}, s AS (SELECT v AS v1, q AS q1, lead(v) OVER (ORDER BY q) AS v2, lead(q) OVER (ORDER BY q) AS q2 FROM r)
            SELECT CAST(o.v AS INTEGER) AS v, round(CASE WHEN o.q < (SELECT min(q) FROM r) THEN (SELECT min(v) FROM r) ELSE v1 + coalesce((o.q - q1) / (q2 - q1) * (v2 - v1), 0) END, 6) AS matched FROM o LEFT JOIN s ON o.q >= q1 AND (q2 IS NULL OR o.q < q2)""",
        "rescale_trunc": rescale("trunc"),
        "rescale_round": rescale("rint").replace("rint((", "round_even((").replace("* 255) AS", "* 255, 0) AS"),
        "cmyk_marker": median.replace(f"WITH {_RGB}", f"WITH {_RGB}, i AS ({ink}), n AS (SELECT y, x, round(CASE WHEN k >= 1 THEN 0 ELSE (m - k) / (1 - k) + (k2 - k) / (1 - k) END, 6) AS v FROM i)").replace("FROM l p", "FROM n p").replace("b, l q", "b, n q"),
        "stain_unmix": f"WITH {_RGB} SELECT y, x, {stain(0)} AS hematoxylin, {stain(1)} AS aec FROM rgb",
        "level_geometry": f"""WITH i AS (SELECT * FROM {level_rows}), s AS (SELECT image, h, w, CAST(r AS INTEGER) AS level, CAST(1 AS BIGINT) << r AS p FROM i, range(32) t(r)),
            k AS (SELECT image, level, CAST({up('h', 'p')} AS BIGINT) AS height, CAST({up('w', 'p')} AS BIGINT) AS width FROM s WHERE level = 0 OR greatest(h, w) > 1024 * (p // 2)) SELECT *, {tile('height')} AS tile_h, {tile('width')} AS tile_w FROM k""",
        "level_match_strict": f"WITH p AS (SELECT * FROM {px}) SELECT CAST(a.level AS INTEGER) AS level1, CAST(coalesce(max(b.level), 0) AS INTEGER) AS level2 FROM p a LEFT JOIN p b ON b.reader = 's' AND b.px < a.px WHERE a.reader = 'r' GROUP BY 1",
        "level_match_nearest": f"WITH p AS (SELECT * FROM {px}), t AS (SELECT min(c) AS target FROM (SELECT max(px) AS c FROM p GROUP BY reader)) SELECT reader, CAST(level AS INTEGER) AS level FROM p, t QUALIFY row_number() OVER (PARTITION BY reader ORDER BY abs(px - target), px, level) = 1",
        "channel_naming": f"WITH n AS (SELECT CAST(place AS INTEGER) AS place, name FROM {_values([*enumerate(NAMES)], 'place, name')}) SELECT place, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || '_' || row_number() OVER (PARTITION BY name ORDER BY place) ELSE name END AS name FROM n",
        "block_shift_int": f'WITH {_E}, {_LAPLACE}, {_SHIFTS} SELECT "by", bx, dy, dx, score FROM sh',
        "constrain_shifts": f"""WITH {_E}, {_LAPLACE}, {_SHIFTS}, z AS (SELECT "by" AS by_, bx, dy, dx, round(sqrt(CAST(dy * dy + dx * dx AS DOUBLE)), 6) AS v FROM sh), {_triangle("z", "v", "t")}, k AS (SELECT z.* FROM z, t WHERE v < threshold OR (SELECT min(v) = max(v) FROM z)),
            {_plane_sql("k", "dy", "p")}, {_plane_sql("k", "dx", "q")}, fz AS (SELECT z.by_, z.bx, dy, dx, coalesce(p.c + p.a * by_ + p.b * bx, 0) AS py, coalesce(q.c + q.a * by_ + q.b * bx, 0) AS px FROM z, p, q),
            oz AS (SELECT *, round(sqrt(pow(dy - py, 2) + pow(dx - px, 2)), 6) AS v FROM fz), {_triangle("oz", "v", "u")}, wz AS (SELECT oz.*, v < threshold OR (SELECT min(v) = max(v) FROM oz) AS passed FROM oz, u)
            SELECT by_ AS "by", bx, dy, dx, passed, round(CASE WHEN passed THEN dy ELSE py END, 6) AS fitted_dy, round(CASE WHEN passed THEN dx ELSE px END, 6) AS fitted_dx FROM wz""",
        "block_shift_fft": f"""WITH {_E}, {_LAPLACE}, {_SHIFTS}, al AS (SELECT by_, bx, (f.iy - m.iy + 16) % 16 AS dy, (f.ix - m.ix + 16) % 16 AS dx, sum(CAST(w AS BIGINT) * w2) AS s FROM f JOIN m USING (by_, bx) GROUP BY 1, 2, 3, 4),
            be AS (SELECT by_, bx, dy, dx FROM al QUALIFY row_number() OVER (PARTITION BY by_, bx ORDER BY s DESC, dy, dx) = 1) SELECT by_ AS "by", bx, CAST(CASE WHEN dy > 8 THEN dy - 16 ELSE dy END AS INTEGER) AS dy, CAST(CASE WHEN dx > 8 THEN dx - 16 ELSE dx END AS INTEGER) AS dx FROM be""",
        "multires_coalesce": """WITH r AS (SELECT CAST(l_partkey % 16 AS INTEGER) AS by_, CAST(l_suppkey % 8 AS INTEGER) AS bx, CAST((l_linenumber - 1) % 3 AS INTEGER) AS level, CAST(CAST(sum(l_quantity) AS BIGINT) % 7 - 3 AS DOUBLE) AS dy,
            CAST(count(*) % 7 - 3 AS DOUBLE) AS dx, sum(l_orderkey) % 3 = 0 AS valid FROM lineitem GROUP BY 1, 2, 3) SELECT by_ AS "by", bx, level, dy * (1 << level) AS dy, dx * (1 << level) AS dx FROM r QUALIFY row_number() OVER (PARTITION BY by_, bx ORDER BY valid DESC, level) = 1""",
        "object_priority": """WITH c AS (SELECT DISTINCT CAST(l_partkey % 32 AS INTEGER) AS by_, CAST(l_orderkey % 32 AS INTEGER) AS bx, CAST(l_suppkey % 10 AS INTEGER) AS obj_id FROM lineitem WHERE l_quantity > 45), o AS (SELECT obj_id, count(*) AS area FROM c GROUP BY 1),
            b AS (SELECT by_, bx, obj_id FROM c JOIN o USING (obj_id) QUALIFY row_number() OVER (PARTITION BY by_, bx ORDER BY area DESC, obj_id) = 1), g AS (SELECT CAST(r // 32 AS INTEGER) AS by_, CAST(r % 32 AS INTEGER) AS bx FROM range(1024) t(r))
            SELECT by_ AS "by", bx, obj_id FROM g LEFT JOIN b USING (by_, bx)""",
        "warp_nearest": f"WITH {_RGB}, {src} SELECT s.y, s.x, coalesce(l.v, 0) AS v FROM src s LEFT JOIN l ON l.y = CAST(floor(sy + 0.5e0) AS INTEGER) AND l.x = CAST(floor(sx + 0.5e0) AS INTEGER)",
        "warp_bilinear": f"""WITH {_RGB}, {src}, c AS (SELECT s.y, s.x, CAST(floor(sy) AS INTEGER) + a AS py, CAST(floor(sx) AS INTEGER) + b AS px, (CASE a WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END) * (CASE b WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END) AS k
            FROM src s, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b)) SELECT c.y, c.x, round(sum(coalesce(l.v, 0) * k), 6) AS v FROM c LEFT JOIN l ON l.y = py AND l.x = px GROUP BY 1, 2""",
        "mutual_nn_hamming": f"""WITH {_E}, {codes("o", 0)}, {codes("t", 1)}, p AS (SELECT o.id AS i, t.id AS j, CAST(bit_count(xor(o.code, t.code)) AS INTEGER) AS d FROM o, t)
            SELECT i, j, d FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 1 AND row_number() OVER (PARTITION BY j ORDER BY d, i) = 1""",
        "flow_lab": f"""WITH {_E}, {_LAPLACE}, {_SHIFTS}, z AS (SELECT "by", bx, dx / greatest({flow}, 2e0) AS a, dy / greatest({flow}, 2e0) AS b FROM sh) SELECT "by", bx, round(sqrt(a * a + b * b) * 50, 6) AS l, round(a * 100, 6) AS a, round(b * 100, 6) AS b FROM z""",
        "slide_list": f"""WITH n AS (SELECT filename, string_split(filename, '_') AS t, filename LIKE '%Hem%' AS hit FROM {_values([(n,) for n in SLIDES], 'filename')}),
            k AS (SELECT *, row_number() OVER (ORDER BY t[-2], filename) AS k FROM n), f AS (SELECT min(k) AS f FROM k WHERE hit)
            SELECT CAST(CASE WHEN k = f THEN 0 WHEN k < f THEN k ELSE k - 1 END AS INTEGER) AS place, filename, replace(t[-1], '.svs', '') || '-' || t[-2] AS channel, CASE WHEN hit THEN 'hematoxylin' ELSE 'aec' END AS mode FROM k, f""",
        "repeat_upsample": f"WITH {_RGB} SELECT CAST(y * 2 + p.r AS INTEGER) AS y, CAST(x * 3 + q.r AS INTEGER) AS x, v FROM l, range(2) p(r), range(3) q(r)",
        "block_labels": f"WITH {_RGB} SELECT y, x, CAST(y // 24 * 4 + x // 20 + 1 AS INTEGER) AS label FROM l",
        "normalise_uint8": f"WITH {_E}, m AS (SELECT CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM e) SELECT y, x, CAST(round_even((v - lo) * (255e0 / (hi - lo)), 0) AS INTEGER) AS v FROM e, m",
        "thumbnail_level": f"""WITH i AS (SELECT * FROM {level_rows}), s AS (SELECT image, h, w, CAST(r AS INTEGER) AS level, CAST(1 AS BIGINT) << r AS p FROM i, range(32) t(r)),
            k AS (SELECT image, level, {up('h', 'p')} + {up('w', 'p')} AS sides FROM s WHERE level = 0 OR greatest(h, w) > 1024 * (p // 2)) SELECT image, level FROM k QUALIFY row_number() OVER (PARTITION BY image ORDER BY abs(sides / 2e0 - 2000), level) = 1""",
        "segment_objects": f"""WITH RECURSIVE {_RGB}, m AS (SELECT y, x, (CAST(y AS BIGINT) << 32) + x AS spot FROM l WHERE v >= 200), t(seed, y, x) AS (SELECT spot, y, x FROM m UNION
            SELECT t.seed, m.y, m.x FROM t, (VALUES (-1), (0), (1)) p(a), (VALUES (-1), (0), (1)) q(b), m WHERE m.y = t.y + a AND m.x = t.x + b), f AS (SELECT y, x, min(seed) AS label FROM t GROUP BY y, x)
            SELECT label, min(y) AS rs, max(y) + 1 AS re, min(x) AS cs, max(x) + 1 AS ce, count(*) AS area FROM f GROUP BY label""",
        "transform_bbox": f"""WITH c AS (SELECT id, px * {a}e0 + py * {b}e0 + {c}e0 AS sx, px * {d}e0 + py * {e}e0 + {f}e0 AS sy FROM (SELECT id, unnest([cs, cs, ce, ce]) AS px, unnest([rs, re, rs, re]) AS py FROM {boxes}))
            SELECT CAST(id AS INTEGER) AS id, CAST(greatest(floor(min(sy)), 0) AS INTEGER) AS rs, CAST(ceil(max(sy)) AS INTEGER) AS re, CAST(greatest(floor(min(sx)), 0) AS INTEGER) AS cs, CAST(ceil(max(sx)) AS INTEGER) AS ce FROM c GROUP BY id""",
        "bbox_blocks": f"SELECT * FROM ({ranges})",
        "blocks_covered": f"WITH k AS ({ranges}), g AS ({grid}) SELECT * FROM g WHERE EXISTS (FROM k WHERE {inside})",
        "blocks_uncovered": f"WITH k AS ({ranges}), g AS ({grid}) SELECT * FROM g WHERE NOT EXISTS (FROM k WHERE {inside})",
        "block_matrices": f"""WITH s AS (SELECT CAST(p_partkey // 16 AS INTEGER) AS "by", CAST(p_partkey % 16 AS INTEGER) AS bx, p_size % 7 <> 0 AS known, CAST(p_size - 25 AS DOUBLE) AS dy, CAST(floor(p_retailprice) AS BIGINT) % 11 - 5e0 AS dx FROM part)
            SELECT "by", bx, {", ".join(f"CASE WHEN known THEN {v}e0{m} END AS {n}" for n, v, m in zip(affine.ENTRIES, BACK, ("", "", " + dx", "", "", " + dy")))} FROM s""",
        "full_scale_matrices": f"""SELECT r AS ref_factor, m AS moving_factor, {", ".join(f"{v}e0 * {w} AS {n}" for n, v, w in zip(affine.ENTRIES, BACK, ("(r / m)", "(r / m)", "r") * 2))} FROM (VALUES (1e0), (4e0), (16e0)) a(r), (VALUES (2e0), (8e0)) b(m)""",
        "orientation_matrices": f"""WITH i AS (SELECT * FROM {level_rows}) {" UNION ALL ".join(f"SELECT image, '{t}' AS turn, " + ", ".join(f"CAST({v} AS DOUBLE) AS {n}" for n, v in zip(affine.ENTRIES, m)) + " FROM i" for t, m in (
            ("rot0", (1, 0, 0, 0, 1, 0)), ("rot90", (0, 1, 0, -1, 0, "w - 1")), ("rot180", (-1, 0, "w - 1", 0, -1, "h - 1")), ("rot270", (0, -1, "h - 1", 1, 0, 0)),
            ("flip_rows", (1, 0, 0, 0, -1, "h - 1")), ("flip_columns", (-1, 0, "w - 1", 0, 1, 0)), ("flip_both", (-1, 0, "w - 1", 0, -1, "h - 1"))))}""",
        "robust_affine": f"""SELECT p_partkey % 4 AS config, {", ".join(f"{v}e0 AS {n}" for n, v in zip(affine.ENTRIES, BACK))}, count_if(p_partkey % 7 >= 2) AS inliers, count(*) AS matches FROM part GROUP BY config""",
        "best_configuration": """WITH c AS (SELECT l_orderkey % 8 AS config, count_if(l_quantity > 40) AS inliers FROM lineitem GROUP BY config), m AS (SELECT max(inliers) AS most FROM c), r AS (SELECT most / avg(inliers) AS ratio FROM c, m WHERE inliers < most GROUP BY most)
            SELECT (SELECT config FROM c ORDER BY inliers DESC, config LIMIT 1) AS config, most AS inliers, round((FROM r), 6) AS ratio, coalesce((FROM r) > 1.05, false) AS accepted FROM m""",
        "pyramid_levels": f"""WITH {_RGB}, p0 AS (SELECT 0 AS channel, y, x, v FROM l UNION ALL SELECT 1, y, x, g FROM rgb), {", ".join(f"p{k} AS (SELECT channel, y // 2 AS y, x // 2 AS x, CAST(round_even(avg(v), 0) AS INTEGER) AS v FROM p{k - 1} GROUP BY channel, y // 2, x // 2)" for k in (1, 2, 3))}
            {" UNION ALL ".join(f"SELECT {k} AS level, * FROM p{k}" for k in range(4))}""",
    }
