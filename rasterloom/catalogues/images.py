"""Queries over masks, colours, neighbourhoods and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour
from ..operators import halo, masks, stencil, threshold
from ..sources import rasters

SIZE, ODD = 64, 61


def _one(spark: SparkSession, d: str, size: int = SIZE) -> DataFrame:
    return rasters.density_raster(rasters.table(spark, d, "lineitem"), size)


def _two(spark: SparkSession, d: str) -> DataFrame:
    return rasters.density_raster(rasters.table(spark, d, "lineitem"), SIZE, v="l_suppkey")


def _rgb(spark: SparkSession, d: str) -> DataFrame:
    return rasters.density_raster(rasters.table(spark, d, "lineitem"), SIZE, r="l_quantity", g="l_suppkey", b="l_linenumber")


def _mask(image: DataFrame) -> DataFrame:
    return masks.entropy_mask(image, SIZE, SIZE)


def _dark(image: DataFrame) -> DataFrame:
    """A mask that needs no neighbourhood, for queries that are about what follows."""
    return image.select("y", "x", (F.col("v") > 96).alias("inside"))


def _matched(spark: SparkSession, d: str) -> DataFrame:
    one, two = _one(spark, d), _two(spark, d)
    return masks.masked_matched(one, _dark(one), two, _dark(two)).withColumn("v", F.round("v", 6))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = masks.image_pairs(_one(spark, d), _two(spark, d), SIZE, SIZE, (False, False))
    return pairs.filter("variant in ('otsu', 'triangle', 'matched')").withColumn("v", F.round("v", 6))


def _configs(spark: SparkSession, d: str) -> DataFrame:
    """Each hypothesis's two images, as sums weighted by place."""
    one, two = _one(spark, d), _two(spark, d)
    out = None
    for k, (which, scalar, flip) in enumerate((w, s, f) for w in ("right", "left") for s in (1, -1) for f in (False, True)):
        for side, image in enumerate(masks.configured_pair(one, two, _dark(one), _dark(two), which, scalar, flip, SIZE)):
            rows = image.agg(F.round(F.sum("v"), 3).alias("total"), F.round(F.sum(F.col("v") * F.col("y")), 3).alias("by_row")).select(F.lit(k).alias("config"), F.lit(side).alias("side"), "total", "by_row")
            out = rows if out is None else out.unionByName(rows)
    return out


def _processed(spark: SparkSession, d: str) -> DataFrame:
    rgb = _rgb(spark, d)
    ends = masks.contrast_ranges(rgb, SIZE, SIZE, ("hematoxylin",))
    return masks.in_contrast(rgb, "hematoxylin", ends, SIZE, SIZE).withColumn("unit", F.round("unit", 6))


def _thumbnails(spark: SparkSession, d: str) -> DataFrame:
    one, two = _one(spark, d), _two(spark, d)
    return masks.thumbnail_pair(one, _dark(one), two, _dark(two)).withColumn("v", F.round("v", 6))


def queries() -> dict:
    rounded = lambda df: df.withColumn("v", F.round("v", 6))
    return {
        "entropy_mask": lambda s, d: _mask(_one(s, d)),
        "block_mask": lambda s, d: masks.block_mask(_mask(_one(s, d)), 16),
        "masked_match": _matched,
        "image_pairs": _pairs,
        "match_configs": _configs,
        "background_fill": lambda s, d: rounded(masks.outside_box_filled(_one(s, d), _dark(_one(s, d)), (8, 40, 5, 60))),
        "contrast_ranges": lambda s, d: masks.contrast_ranges(_rgb(s, d), SIZE, SIZE, ("grayscale", "hematoxylin", "dab")).select("mode", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi")),
        "processed_colour": _processed,
        "dab_stain": lambda s, d: _rgb(s, d).select("y", "x", F.round(colour.processed("dab"), 6).alias("v")),
        "cmyk_planes": lambda s, d: _rgb(s, d).select("y", "x", *[F.round(c, 6).alias(n) for c, n in zip(colour.cmyk(), ("cyan", "magenta", "yellow", "black"))]),
        "marker_unit": lambda s, d: rounded(masks.marker(_rgb(s, d), SIZE, SIZE, 0.2, 1.4)),
        "marker_bytes": lambda s, d: masks.marker(_rgb(s, d), SIZE, SIZE),
        "downscale_reflected": lambda s, d: rounded(stencil.downscaled_mean(_one(s, d, ODD), 7, ODD, ODD)),
        "whiten_gaussian": lambda s, d: rounded(stencil.whitened(_one(s, d, ODD), 1.0, ODD, ODD, side=32)),
        "gaussian_pyramid": lambda s, d: rounded(stencil.gaussian_pyramid(_one(s, d, ODD), ODD, ODD, most=32, side=32)),
        "translated": lambda s, d: rounded(stencil.translated(_one(s, d), 1.25, -2.5, SIZE, SIZE)),
        "log_stretched": lambda s, d: rounded(threshold.log_stretched(_one(s, d))),
        "thumbnail_pair": _thumbnails,
    }


def _inverse_column(stains: tuple, which: int) -> list[str]:
    """A column of the inverse stain matrix in plain arithmetic: the two given rows and their cross product, by Cramer's rule."""
    (a, b, c), (d, e, f) = stains
    n = [f"({b}e0 * {f}e0 - {c}e0 * {e}e0)", f"({c}e0 * {d}e0 - {a}e0 * {f}e0)", f"({a}e0 * {e}e0 - {b}e0 * {d}e0)"]
    det = "(" + " + ".join(f"{v} * {v}" for v in n) + ")"
    row = [f"{v}e0" for v in (stains[1] if which == 0 else stains[0])]
    sign = "" if which == 0 else "-"
    cross = [f"({row[1]} * {n[2]} - {row[2]} * {n[1]})", f"({row[2]} * {n[0]} - {row[0]} * {n[2]})", f"({row[0]} * {n[1]} - {row[1]} * {n[0]})"]
    return [f"({sign}{v} / {det})" for v in cross]


def stain_sql(stains: tuple, which: int) -> str:
    density = lambda ch: f"ln(greatest({ch} / 255e0, 1e-6)) / ln(1e-6)"
    return "greatest(" + " + ".join(f"({density(ch)}) * {w}" for ch, w in zip("rgb", _inverse_column(stains, which))) + ", 0e0)"


def oracle_sql() -> dict[str, str]:
    from ..catalogue import _ENTROPY, _RGB, _otsu, _steps, _triangle

    two = f"{_RGB}, t AS (SELECT y, x, g AS v FROM rgb)"
    odd = "c AS (SELECT CAST(l_partkey % 61 AS INTEGER) AS y, CAST(l_orderkey % 61 AS INTEGER) AS x, CAST(CAST(sum(l_quantity) AS BIGINT) % 256 AS INTEGER) AS v FROM lineitem GROUP BY 1, 2), o AS (SELECT y, x, coalesce(v, 0) AS v FROM (SELECT CAST(r // 61 AS INTEGER) AS y, CAST(r % 61 AS INTEGER) AS x FROM range(3721) q(r)) LEFT JOIN c USING (y, x))"
    spread = "ends AS (SELECT min(v) AS lo, max(v) AS hi FROM raw), l AS (SELECT y, x, CAST(floor((v - lo) / CAST(hi - lo AS DOUBLE) * 1000) AS INTEGER) AS v FROM raw, ends)"
    inside = f"{_RGB.replace('l AS (SELECT', 'raw AS (SELECT')}, {spread}, {_ENTROPY.format(name='g', steps=_steps(4))}, j AS (SELECT y, x, round(entropy, 6) AS t FROM g), {_otsu('j', 't')}, m AS (SELECT y, x, t > threshold AS inside FROM j, cut)"

    def share(name: str, rows: str, sign: str = "") -> str:
        return f"{name}c AS (SELECT {sign}v AS v, count(*) AS n FROM {rows} GROUP BY 1), {name} AS (SELECT CAST(v AS DOUBLE) AS v, sum(n) OVER (ORDER BY v) / CAST((SELECT sum(n) FROM {name}c) AS DOUBLE) AS q FROM {name}c)"

    def table(name: str, own: str, ref: str) -> str:
        """CTE name(v, matched) from shares own and ref."""
        return f"""{name}s AS (SELECT v AS v1, q AS q1, lead(v) OVER (ORDER BY q) AS v2, lead(q) OVER (ORDER BY q) AS q2 FROM {ref}),
            {name} AS (SELECT a.v, round(CASE WHEN a.q < (SELECT min(q) FROM {ref}) THEN (SELECT min(v) FROM {ref}) ELSE v1 + coalesce((a.q - q1) / (q2 - q1) * (v2 - v1), 0) END, 6) AS matched FROM {own} a LEFT JOIN {name}s ON a.q >= q1 AND (q2 IS NULL OR a.q < q2))"""

    otsu = lambda rows, k: _otsu(rows, "v").replace("oe AS", f"{k}oe AS").replace(", oe ", f", {k}oe ").replace("oh AS", f"{k}oh AS").replace("FROM oh", f"FROM {k}oh").replace("oc AS", f"{k}oc AS").replace("FROM oc", f"FROM {k}oc").replace("ot AS", f"{k}ot AS").replace("FROM ot", f"FROM {k}ot").replace("cut AS", f"{k}cut AS")
    ink = "pl AS (SELECT *, least(1 - r / 255e0, 1 - g / 255e0, 1 - b / 255e0) AS k FROM rgb), i AS (SELECT y, x, round(CASE WHEN k >= 1 THEN 0 ELSE (1 - g / 255e0 - k) / (1 - k) + (1 - b / 255e0 - k) / (1 - k) END, 9) AS v FROM pl)"
    median = f"md AS (SELECT p.y, p.x, median(q.v) AS v FROM i p, {_steps(1)} a, {_steps(1)} b, i q WHERE q.y = least(greatest(p.y + a.k, 0), {SIZE - 1}) AND q.x = least(greatest(p.x + b.k, 0), {SIZE - 1}) GROUP BY 1, 2)"
    plane = lambda c: f"round(CASE WHEN k >= 1 THEN 0 ELSE (1 - {c} / 255e0 - k) / (1 - k) END, 6)"
    mirror = lambda e, n: f"(CASE WHEN {e} < 0 THEN -1 - ({e}) WHEN {e} >= {n} THEN {2 * n - 1} - ({e}) ELSE {e} END)"
    about = lambda e, n: f"(CASE WHEN {e} < 0 THEN -({e}) WHEN {e} >= {n} THEN {2 * n - 2} - ({e}) ELSE {e} END)"
    weights = lambda ws: "(VALUES " + ", ".join(f"({k - len(ws) // 2}, {float(w)!r}::DOUBLE)" for k, w in enumerate(ws)) + ") kw(k, w)"
    smooth = lambda rows, out, ws, side: f"{out}v AS (SELECT p.y, p.x, sum(q.v * w) AS v FROM {rows} p, {weights(ws)}, {rows} q WHERE q.x = p.x AND q.y = {side('p.y + k', ODD)} GROUP BY 1, 2), {out} AS (SELECT p.y, p.x, sum(q.v * w) AS v FROM {out}v p, {weights(ws)}, {out}v q WHERE q.y = p.y AND q.x = {side('p.x + k', ODD)} GROUP BY 1, 2)"
    sides = f"{two}, {share('os', 'l')}, {share('ts', 't')}, {table('tm', 'ts', 'os')}"
    masked = f"li AS (SELECT * FROM l WHERE v > 96), ti AS (SELECT * FROM t WHERE v > 96), lf AS (SELECT avg(v) FILTER (WHERE v <= 96) AS fill FROM l), tf AS (SELECT avg(v) FILTER (WHERE v <= 96) AS fill FROM t)"
    configs, parts = [], [two, masked, share("ls", "li"), share("us", "ti"), share("ln", "li", "-"), share("un", "ti", "-"), table("rp", "us", "ls"), table("rn", "un", "ls"), table("lp", "ls", "us"), table("lq", "ln", "us")]
    for k, (which, scalar, flip) in enumerate((w, s, f) for w in ("right", "left") for s in (1, -1) for f in (False, True)):
        own, tab, fill = ("t", "rp" if scalar > 0 else "rn", "lf") if which == "right" else ("l", "lp" if scalar > 0 else "lq", "tf")
        changed = f"(SELECT a.y, a.x, CASE WHEN a.v > 96 THEN m.matched ELSE fill END AS v FROM {own} a LEFT JOIN {tab} m ON m.v = {'' if scalar > 0 else '-'}a.v, {fill})"
        pair = ("l", changed) if which == "right" else (changed, "t")
        for side, rows in enumerate(pair):
            row = f"({SIZE - 1} - y)" if side == 1 and flip else "y"
            configs.append(f"SELECT {k} AS config, {side} AS side, round(CAST(sum(v) AS DOUBLE), 3) AS total, round(CAST(sum(v * {row}) AS DOUBLE), 3) AS by_row FROM {rows}")
    ranges = [("grayscale", "round_even(0.299e0 * r + 0.587e0 * g + 0.114e0 * b, 0)"), ("hematoxylin", stain_sql(colour.HAX, 0)), ("dab", stain_sql(colour.HDX, 1))]
    return {
        "entropy_mask": f"WITH {inside} SELECT y, x, inside FROM m",
        "block_mask": f'WITH {inside} SELECT CAST(y // 16 AS INTEGER) AS "by", CAST(x // 16 AS INTEGER) AS bx, avg(CAST(inside AS INTEGER)) > 0.1 AS inside FROM m GROUP BY 1, 2',
        "masked_match": f"WITH {two}, {masked}, {share('ls', 'li')}, {share('us', 'ti')}, {table('m', 'ls', 'us')} SELECT l.y, l.x, round(CASE WHEN l.v > 96 THEN matched ELSE fill END, 6) AS v FROM l LEFT JOIN m ON m.v = l.v, tf",
        "image_pairs": f"""WITH {sides}, {_triangle('l', 'v', 'atri')}, {_triangle('t', 'v', 'btri')}, {otsu('l', 'a')}, {otsu('t', 'b')}
            SELECT 'otsu' AS variant, 0 AS side, y, x, CAST(v > threshold AS DOUBLE) AS v FROM l, acut UNION ALL SELECT 'otsu', 1, y, x, CAST(v > threshold AS DOUBLE) FROM t, bcut
            UNION ALL SELECT 'triangle', 0, y, x, CAST(v > threshold AS DOUBLE) FROM l, atri UNION ALL SELECT 'triangle', 1, y, x, CAST(v > threshold AS DOUBLE) FROM t, btri
            UNION ALL SELECT 'matched', 0, y, x, CAST(v AS DOUBLE) FROM l UNION ALL SELECT 'matched', 1, y, x, matched FROM t JOIN tm ON tm.v = t.v""",
        "match_configs": f"WITH {', '.join(parts)} {' UNION ALL '.join(configs)}",
        "background_fill": f"WITH {_RGB}, f AS (SELECT avg(v) FILTER (WHERE v <= 96) AS fill FROM l) SELECT y, x, round(CASE WHEN y BETWEEN 8 AND 39 AND x BETWEEN 5 AND 59 THEN v ELSE fill END, 6) AS v FROM l, f",
        "contrast_ranges": f"WITH {_RGB} {' UNION ALL '.join(f'''SELECT '{m}' AS mode, round(min({e}), 6) AS lo, round(max({e}), 6) AS hi FROM rgb''' for m, e in ranges)}",
        "processed_colour": f"WITH {_RGB}, h AS (SELECT y, x, round({stain_sql(colour.HAX, 0)}, 9) AS v FROM rgb), e AS (SELECT min(v) AS lo, max(v) AS hi FROM h), u AS (SELECT y, x, (v - lo) / (hi - lo) AS unit FROM h, e) SELECT y, x, round(unit, 6) AS unit, CAST(trunc(round(unit * 255, 6)) AS INTEGER) AS v FROM u",
        "dab_stain": f"WITH {_RGB} SELECT y, x, round({stain_sql(colour.HDX, 1)}, 6) AS v FROM rgb",
        "cmyk_planes": f"WITH {_RGB}, p AS (SELECT *, least(1 - r / 255e0, 1 - g / 255e0, 1 - b / 255e0) AS k FROM rgb) SELECT y, x, {plane('r')} AS cyan, {plane('g')} AS magenta, {plane('b')} AS yellow, round(k, 6) AS black FROM p",
        "marker_unit": f"WITH {_RGB}, {ink}, {median} SELECT y, x, round((least(greatest(v, 0.2e0), 1.4e0) - 0.2e0) / 1.2e0, 6) AS v FROM md",
        "marker_bytes": f"WITH {_RGB}, {ink}, {median}, mx AS (SELECT max(v) AS most FROM md) SELECT y, x, CAST(round_even(round((least(greatest(v, 0.05e0 * most), 0.95e0 * most) - 0.05e0 * most) / (0.9e0 * most) * 255, 6), 0) AS INTEGER) AS v FROM md, mx",
        "downscale_reflected": f"WITH {odd}, b AS (SELECT y, x FROM range(9) p(y), range(9) q(x)) SELECT CAST(b.y AS INTEGER) AS y, CAST(b.x AS INTEGER) AS x, round(avg(o.v), 6) AS v FROM b, range(7) i(i), range(7) j(j), o WHERE o.y = {about('b.y * 7 + i', ODD)} AND o.x = {about('b.x * 7 + j', ODD)} GROUP BY 1, 2",
        "whiten_gaussian": f"WITH {odd}, {smooth('o', 's', halo.gaussian_weights(1.0), mirror)} SELECT y, x, round(coalesce(lag(v) OVER a, v) + coalesce(lead(v) OVER a, v) + coalesce(lag(v) OVER d, v) + coalesce(lead(v) OVER d, v) - 4 * v, 6) AS v FROM s WINDOW a AS (PARTITION BY y ORDER BY x), d AS (PARTITION BY x ORDER BY y)",
        "gaussian_pyramid": f"WITH {odd}, {smooth('o', 's', halo.STEP, about)} SELECT 0 AS level, y, x, CAST(v AS DOUBLE) AS v FROM o UNION ALL SELECT 1, CAST(y // 2 AS INTEGER), CAST(x // 2 AS INTEGER), round(v, 6) FROM s WHERE y % 2 = 0 AND x % 2 = 0",
        "translated": f"""WITH {_RGB}, s AS (SELECT y, x, y - 1.25e0 AS sy, x + 2.5e0 AS sx FROM l), c AS (SELECT s.y, s.x, coalesce(l.v, 0) * (CASE i WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END) * (CASE j WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END) AS v
            FROM s CROSS JOIN (VALUES (0), (1)) p(i) CROSS JOIN (VALUES (0), (1)) q(j) LEFT JOIN l ON l.y = floor(sy) + i AND l.x = floor(sx) + j) SELECT y, x, round(sum(v), 6) AS v FROM c GROUP BY 1, 2""",
        "log_stretched": f"WITH {_RGB}, p AS (SELECT quantile_cont(CAST(v AS DOUBLE), 0.01) AS lo, quantile_cont(CAST(v AS DOUBLE), 0.99) AS hi FROM l) SELECT y, x, round(ln((least(greatest(v, lo), hi) - lo) / (hi - lo) * 4500 + 500), 6) AS v FROM l, p",
        "thumbnail_pair": f"WITH {two} " + " UNION ALL ".join(f"SELECT {k} AS side, y, x, round(coalesce((least(greatest(CAST(v AS DOUBLE), lo), hi) - lo) / CASE WHEN hi IS NOT NULL THEN hi - lo END, 0e0), 6) AS v FROM {r}, (SELECT avg(v) FILTER (WHERE v <= 96) AS lo, quantile_cont(CAST(v AS DOUBLE), 0.999) FILTER (WHERE v > 96) AS hi FROM {r})" for k, r in enumerate("lt")),
    }
