"""Queries over tiles: warps by a matrix a block, phase shifts, and alignments put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import affine
from ..operators import align, objects, tiles
from ..plans import displacement
from ..plans.aligner import Aligner
from ..sources import rasters

SIZE, TILE, BLOCK = 64, 24, 16
#: Moving image to grid; the shift of a block is added to it.
COARSE = (0.97, 0.08, 1.25, -0.06, 1.02, 2.5)
BASELINE = (1.0, 0.0, 2.0, 0.0, 1.0, -3.0)


def _image(spark: SparkSession, d: str) -> DataFrame:
    items = rasters.table(spark, d, "lineitem")
    one = rasters.density_raster(items, SIZE).withColumn("channel", F.lit(0))
    return one.unionByName(rasters.density_raster(items, SIZE, v="l_suppkey").withColumn("channel", F.lit(1)))


def _matrices(spark: SparkSession) -> DataFrame:
    grid = spark.range((SIZE // BLOCK) ** 2).select(F.expr(f"int(id div {SIZE // BLOCK})").alias("by"), F.expr(f"int(id % {SIZE // BLOCK})").alias("bx"))
    known = F.expr("by * 4 + bx <> 6")
    return affine.block_matrices(grid.select("by", "bx", F.when(known, F.expr("double(by - 1)")).alias("dy"), F.when(known, F.expr("bx * 0.5 - 1.25")).cast("double").alias("dx")), COARSE)


def _warp(spark: SparkSession, d: str, nearest: bool) -> DataFrame:
    packed = tiles.pack(_image(spark, d), TILE)
    out = tiles.unpack(tiles.warped(packed, _matrices(spark), [0, 1], TILE, BLOCK, nearest), BLOCK, SIZE, SIZE)
    return out.withColumn("v", F.col("v").cast("int") if nearest else F.round("v", 6))


def _phase(spark: SparkSession, d: str) -> DataFrame:
    one, two = displacement.raw_pairs(spark, d)
    mask = one.select(F.col("ty").alias("by"), F.col("tx").alias("bx"), (F.col("ty") % 5 != 2).alias("inside"))
    found = tiles.block_shifts(one, two, displacement.BLOCK, mask)
    return found.select("by", "bx", F.col("dy").cast("int").alias("dy"), F.col("dx").cast("int").alias("dx"), F.round("error", 6).alias("error"))


def _flow(spark: SparkSession, d: str) -> DataFrame:
    one, two = displacement.raw_pairs(spark, d)
    found = tiles.block_shifts(one, two, displacement.BLOCK, None, 0.0, 10, flow=True)
    return found.select("by", "bx", *[F.round(c, 6).alias(c) for c in ("dy", "dx", "error")])


def _density(spark: SparkSession, d: str) -> DataFrame:
    """Shifts of a flow counted in 50 x 50 cells between their ends, as shares."""
    every = Window.partitionBy()  # a row for each different shift, 25 at most
    s = displacement.block_shifts(spark, d).groupBy("dy", "dx").agg(F.count(F.lit(1)).alias("n"))
    s = s.select("*", *[f(c).over(every).cast("double").alias(f"{n}_{c}") for c in ("dy", "dx") for n, f in (("lo", F.min), ("hi", F.max))], F.sum("n").over(every).alias("total"))
    cell = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / ((F.col(f"hi_{c}") - F.col(f"lo_{c}")) / 50)), F.lit(49))).otherwise(0).cast("int")
    counted = s.groupBy(cell("dy").alias("row"), cell("dx").alias("column")).agg(F.sum("n").alias("n"), F.first("total").alias("total"))
    return counted.select("row", "column", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def _distances(spark: SparkSession, d: str) -> DataFrame:
    size = F.sqrt((F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).cast("double"))
    return displacement.block_shifts(spark, d).select(size.alias("v")).agg(*[F.round(F.percentile("v", F.lit(p / 100)), 6).alias(f"p{p}") for p in (0, 1, 50, 99, 100)])


def _levels(spark: SparkSession, d: str) -> DataFrame:
    """Constrained shifts of three levels; a level's ratio is a power of two."""
    parts = rasters.table(spark, d, "part").filter("p_partkey between 1 and 84").withColumn("k", F.col("p_partkey") - 1)
    level = F.expr("int(case when k < 64 then 0 when k < 80 then 1 else 2 end)")
    side, start = F.expr("int(8 >> level)"), F.expr("int(case level when 0 then 0 when 1 then 64 else 80 end)")
    rows = parts.withColumn("level", level).withColumns({"side": side, "i": F.expr("int(k)") - start})
    return rows.select("level", F.expr("int(1 << level)").alias("ratio"), F.expr("int(i div side)").alias("by"), F.expr("int(i % side)").alias("bx"),
        F.col("p_size").cast("double").alias("dy"), F.lit(0.0).alias("dx"), (F.col("p_size") % 3 == 0).alias("passed"), F.col("p_size").cast("double").alias("fitted_dy"), (-F.col("p_size")).cast("double").alias("fitted_dx"))


def _object_matrices(spark: SparkSession, d: str) -> DataFrame:
    covers = rasters.table(spark, d, "lineitem").filter("l_quantity > 45").select((F.col("l_partkey") % 32).cast("int").alias("by"), (F.col("l_orderkey") % 32).cast("int").alias("bx"), (F.col("l_suppkey") % 10).cast("int").alias("obj_id")).distinct()
    areas = covers.groupBy("obj_id").agg(F.count(F.lit(1)).alias("area"))
    entry = [(F.col("obj_id") * (k + 1)).cast("double").alias(n) for k, n in enumerate(affine.ENTRIES)]
    cells = spark.range(32 * 32).select(F.expr("int(id div 32)").alias("by"), F.expr("int(id % 32)").alias("bx"))
    return align.objects_combined(covers.select("*", *entry), areas, cells, BASELINE, excluded=[3])


def _objects_by_area(spark: SparkSession, d: str) -> DataFrame:
    found = objects.boxes_of(objects.label_objects(rasters.density_raster(rasters.table(spark, d, "lineitem"), SIZE).filter("v >= 215")))
    return objects.by_area(found, 8)


def aligned(spark: SparkSession, d: str) -> DataFrame:
    """The vector raster against itself moved by whole pixels: warp, shifts, constraint, matrices."""
    pixels = rasters.vector_raster(rasters.table(spark, d, "embeddings")).withColumn("channel", F.lit(0))
    moved = pixels.withColumns({"y": F.col("y") + 3, "x": F.col("x") + 2})
    rows = pixels.agg(F.max("y")).first()[0] // 32 + 1  # the grid is known of any image
    job = Aligner(tiles.pack(pixels, 32), tiles.pack(moved, 32), 32, rows, 2, coarse=(1.0, 0.0, -1.0, 0.0, 1.0, -2.0))
    return job.matrices().select("by", "bx", *[F.round(n, 6).alias(n) for n in affine.ENTRIES])


def queries() -> dict:
    return {
        "warp_blocks": lambda s, d: _warp(s, d, False),
        "warp_blocks_mask": lambda s, d: _warp(s, d, True),
        "phase_shifts": _phase,
        "flow_shifts": _flow,
        "flow_density": _density,
        "flow_distances": _distances,
        "multires_shifts": lambda s, d: align.multires_shifts(_levels(s, d), 8, 8, excluded=[1]),
        "object_matrices": _object_matrices,
        "objects_by_area": _objects_by_area,
        "aligner_matrices": aligned,
    }


def oracle_sql() -> dict[str, str]:
    from ..catalogue import _E, _LAPLACE, _RGB, _SHIFTS

    n = SIZE // BLOCK
    a, b, c, d, e, f = COARSE
    det = f"({a}e0 * {e}e0 - {b}e0 * {d}e0)"
    image = f"{_RGB}, im AS (SELECT 0 AS channel, y, x, r AS v FROM rgb UNION ALL SELECT 1, y, x, g FROM rgb)"
    grid = f"""g AS (SELECT y, x, y // {BLOCK} AS py, x // {BLOCK} AS px FROM l), m AS (SELECT y, x, x - ({c}e0 + px * 0.5e0 - 1.25e0) AS ux, y - ({f}e0 + py - 1) AS uy, py * {n} + px <> 6 AS known FROM g),
        s AS (SELECT channel, y, x, known, ({e}e0 * ux - {b}e0 * uy) / {det} AS sx, ({a}e0 * uy - {d}e0 * ux) / {det} AS sy FROM m, (VALUES (0), (1)) q(channel))"""
    raw = """r AS (SELECT CAST(y // 16 AS INTEGER) AS b, CAST(x // 16 AS INTEGER) AS a, y % 16 AS iy, x % 16 AS ix, v FROM e QUALIFY count(*) OVER (PARTITION BY y // 16, x // 16) = 256),
        t AS (SELECT b, a, (iy - (b % 3 - 1) + 16) % 16 AS iy, (ix - (a % 3 - 1) + 16) % 16 AS ix, v FROM r)"""
    white = lambda name, out: f"{out} AS (SELECT b, a, iy, ix, coalesce(lag(v) OVER p, v) + coalesce(lead(v) OVER p, v) + coalesce(lag(v) OVER q, v) + coalesce(lead(v) OVER q, v) - 4 * v AS w FROM {name} WINDOW p AS (PARTITION BY b, a, iy ORDER BY ix), q AS (PARTITION BY b, a, ix ORDER BY iy))"
    return {
        "warp_blocks": f"""WITH {image}, {grid}, k AS (SELECT s.channel, s.y, s.x, sum(CASE WHEN known THEN coalesce(im.v, 0) * (CASE i WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END) * (CASE j WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END) ELSE 0 END) AS v
            FROM s CROSS JOIN (VALUES (0), (1)) p(i) CROSS JOIN (VALUES (0), (1)) q(j) LEFT JOIN im ON im.channel = s.channel AND im.y = floor(sy) + i AND im.x = floor(sx) + j GROUP BY 1, 2, 3) SELECT channel, y, x, round(v, 6) AS v FROM k""",
        "warp_blocks_mask": f"WITH {image}, {grid} SELECT s.channel, s.y, s.x, CAST(CASE WHEN known THEN coalesce(im.v, 0) ELSE 0 END AS INTEGER) AS v FROM s LEFT JOIN im ON im.channel = s.channel AND im.y = floor(sy + 0.5e0) AND im.x = floor(sx + 0.5e0)",
        "phase_shifts": f"""WITH {_E}, {raw}, {white("r", "u")}, {white("t", "z")},
            x AS (SELECT b, a, u.iy - z.iy AS ey, u.ix - z.ix AS ex, CAST(sum(CAST(u.w AS BIGINT) * z.w) AS DOUBLE) AS s FROM u JOIN z USING (b, a) GROUP BY 1, 2, 3, 4),
            o AS (SELECT b, a, (ey + 16) % 16 AS dy, (ex + 16) % 16 AS dx, abs(sum(s)) AS s FROM x GROUP BY 1, 2, 3, 4),
            best AS (SELECT b, a, dy, dx FROM o QUALIFY row_number() OVER (PARTITION BY b, a ORDER BY s DESC, dy, dx) = 1),
            four AS (SELECT b, a, dy - 16 * i AS ey, dx - 16 * j AS ex, i, j FROM best, (VALUES (0), (1)) p(i), (VALUES (0), (1)) q(j)),
            got AS (SELECT b, a, ey, ex, abs(coalesce(s, 0)) AS fit FROM four LEFT JOIN x USING (b, a, ey, ex) QUALIFY row_number() OVER (PARTITION BY b, a ORDER BY abs(coalesce(s, 0)) DESC, i, j) = 1),
            n1 AS (SELECT b, a, sqrt(sum(w * w)) AS n1, count(DISTINCT w) AS c1 FROM u GROUP BY 1, 2), n2 AS (SELECT b, a, sqrt(sum(w * w)) AS n2 FROM z GROUP BY 1, 2)
            SELECT b AS "by", a AS bx, CASE WHEN b % 5 <> 2 THEN CAST(ey AS INTEGER) END AS dy, CASE WHEN b % 5 <> 2 THEN CAST(ex AS INTEGER) END AS dx, CASE WHEN b % 5 <> 2 THEN round(-ln(fit / (n1 * n2)), 6) END AS error FROM got JOIN n1 USING (b, a) JOIN n2 USING (b, a)""",
        "flow_density": f"""WITH {_E}, {_LAPLACE}, {_SHIFTS}, k AS (SELECT min(dy) AS y0, max(dy) AS y1, min(dx) AS x0, max(dx) AS x1, count(*) AS total FROM sh)
            SELECT CAST(least(floor((dy - y0) / ((y1 - y0) / 50e0)), 49) AS INTEGER) AS "row", CAST(least(floor((dx - x0) / ((x1 - x0) / 50e0)), 49) AS INTEGER) AS "column", count(*) AS n, round(count(*) / any_value(total), 6) AS share FROM sh, k GROUP BY 1, 2""",
        "flow_distances": f"WITH {_E}, {_LAPLACE}, {_SHIFTS}, v AS (SELECT sqrt(CAST(dy * dy + dx * dx AS DOUBLE)) AS v FROM sh) SELECT {', '.join(f'round(quantile_cont(v, {p / 100}), 6) AS p{p}' for p in (0, 1, 50, 99, 100))} FROM v",
        "multires_shifts": """WITH p AS (SELECT p_partkey - 1 AS k, p_size, CASE WHEN p_partkey <= 64 THEN 0 WHEN p_partkey <= 80 THEN 1 ELSE 2 END AS level FROM part WHERE p_partkey BETWEEN 1 AND 84),
            s AS (SELECT level, 8 >> level AS side, 1 << level AS ratio, k - [0, 64, 80][level + 1] AS i, p_size FROM p), b AS (SELECT level, ratio, i // side AS b, i % side AS a, p_size, p_size % 3 = 0 AND level <> 1 AS valid FROM s),
            g AS (SELECT r // 8 AS y, r % 8 AS x FROM range(64) t(r)) SELECT CAST(y AS INTEGER) AS "by", CAST(x AS INTEGER) AS bx, level, CAST(p_size * ratio AS DOUBLE) AS dy, CAST(-p_size * ratio AS DOUBLE) AS dx
            FROM g JOIN b ON b.b = y // ratio AND b.a = x // ratio QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY valid DESC, level) = 1""",
        "object_matrices": f"""WITH c AS (SELECT DISTINCT CAST(l_partkey % 32 AS INTEGER) AS b, CAST(l_orderkey % 32 AS INTEGER) AS a, CAST(l_suppkey % 10 AS INTEGER) AS obj_id FROM lineitem WHERE l_quantity > 45), o AS (SELECT obj_id, count(*) AS area FROM c GROUP BY 1),
            w AS (SELECT b, a, obj_id FROM c JOIN o USING (obj_id) WHERE obj_id <> 3 QUALIFY row_number() OVER (PARTITION BY b, a ORDER BY area DESC, obj_id) = 1), g AS (SELECT CAST(r // 32 AS INTEGER) AS b, CAST(r % 32 AS INTEGER) AS a FROM range(1024) t(r))
            SELECT b AS "by", a AS bx, obj_id, {", ".join(f"CASE WHEN obj_id IS NULL THEN {v}e0 ELSE CAST(obj_id * {k + 1} AS DOUBLE) END AS {m}" for k, (m, v) in enumerate(zip(affine.ENTRIES, BASELINE)))} FROM g LEFT JOIN w USING (b, a)""",
        "objects_by_area": f"""WITH RECURSIVE {_RGB}, m AS (SELECT y, x, (CAST(y AS BIGINT) << 32) + x AS spot FROM l WHERE v >= 215), t(seed, y, x) AS (SELECT spot, y, x FROM m UNION
            SELECT t.seed, m.y, m.x FROM t, (VALUES (-1), (0), (1)) p(a), (VALUES (-1), (0), (1)) q(b), m WHERE m.y = t.y + a AND m.x = t.x + b), f AS (SELECT y, x, min(seed) AS label FROM t GROUP BY y, x),
            z AS (SELECT label, min(y) * 8 AS rs, (max(y) + 1) * 8 AS re, min(x) * 8 AS cs, (max(x) + 1) * 8 AS ce, count(*) AS area FROM f GROUP BY label)
            SELECT CAST(row_number() OVER (ORDER BY area DESC, label) - 1 AS INTEGER) AS obj_id, rs, re, cs, ce, area FROM z""",
    }
