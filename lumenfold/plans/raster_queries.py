"""Raster operators bound to 8 x 8 images made of the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import expr as E
from lumenfold.operators import raster as R

from . import tables as T
from .register import Register

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.sql

_LUM = "(0.2289746 * r + 0.6917385 * g + 0.0792869 * b)"


def _rank(p: str) -> str:
    return f"max(CASE WHEN k = CAST(floor({p} * (n - 1)) AS BIGINT) THEN x END)"


def _sized(*n: int):
    return tuple(F.lit(k) for k in n)


@query(f"""WITH {T.SQL_PIXELS}, s AS (SELECT image_id, {_LUM} AS x FROM pixels), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n FROM s WHERE x > 0),
 q AS (SELECT image_id, count(*) AS samples, {_rank('0.001')} AS lo, {_rank('0.999')} AS hi, {_rank('0.995')} AS p995, {_rank('0.9999')} AS p9999 FROM r GROUP BY 1)
 SELECT image_id, samples, round(exp(avg(ln(greatest(least(greatest(x, lo), hi), 1e-6)))), 6) AS log_average, round(max(p995), 6) AS p995, round(max(p9999), 6) AS p9999 FROM s JOIN q USING (image_id) WHERE x > 0 GROUP BY 1, 2""")
def ag19_scene_statistics(spark, d):
    return T.rounded(R.scene_statistics(T.pixels(spark, d)))


@query(f"WITH {T.SQL_PIXELS} SELECT image_id, y // 2 AS gy, x // 2 AS gx, round(avg({_LUM}), 6) AS cell_mean, round(max({_LUM}), 6) AS cell_peak FROM pixels GROUP BY 1, 2, 3")
def ag20_cell_means(spark, d):
    return T.rounded(R.cell_means(T.pixels(spark, d)))


@query(f"WITH {T.SQL_PIXELS} SELECT image_id, y // 2 AS gy, x // 2 AS gx, round(avg(log2(1 + r)), 6) AS cell_mean, round(max(log2(1 + r)), 6) AS cell_peak FROM pixels GROUP BY 1, 2, 3")
def ag21_cell_gain(spark, d):
    return T.rounded(R.cell_means(T.pixels(spark, d), F.log2(1 + F.col("r"))))


_POINTS = ("0.5", "0.75", "0.9", "0.95", "0.99", "0.999", "0.9999", "1.0")


def _sql_distribution(clipped: str) -> str:
    return f"""WITH {T.SQL_CELLS}, r AS (SELECT image_id, label, v AS x, row_number() OVER (PARTITION BY image_id ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n FROM cells)
 SELECT image_id, round(avg((x > 0.5)::INT), 6) AS over_half, round(avg((x > 1)::INT), 6) AS over_one, round(avg((x > 2)::INT), 6) AS over_two, round(avg(coalesce({clipped}, false)::INT), 6) AS clipped,
 {', '.join(f"round({_rank(p)}, 6) AS q{k}" for k, p in enumerate(_POINTS))} FROM r GROUP BY 1"""


@query(_sql_distribution("label % 4 > 0 AND x >= label % 4 - 1e-6"))
def ag22_gain_distribution(spark, d):
    limits = T.images(spark, d).selectExpr("image_id", "cast(label % 4 AS double) AS ceiling")
    return T.rounded(R.gain_distribution(T.cells(spark, d), "display", limits))


@query(_sql_distribution("x >= 0.5 + label % 3 AND 0.5 + label % 3 > label * 0.2"))
def ag22_external(spark, d):
    limits = T.images(spark, d).selectExpr("image_id", "label * 0.2D AS gain_min", "0.5D + label % 3 AS gain_max")
    return T.rounded(R.gain_distribution(T.cells(spark, d), "external", limits))


@query(_sql_distribution("false"))
def ag22_photographic(spark, d):
    return T.rounded(R.gain_distribution(T.cells(spark, d), "photographic"))


@query(f"""WITH {T.SQL_PIXELS}, s AS (SELECT image_id, {_LUM} >= 0.02 AS e, least(1.22494018 * r - 0.22494018 * g, -0.04205695 * r + 1.04205695 * g, -0.01963755 * r - 0.07863605 * g + 1.0982736 * b) < -1e-4 AS o
  FROM (SELECT image_id, r * (1 + x % 3) AS r, g / (1 + y) AS g, b FROM pixels))
 SELECT image_id, count(*) FILTER (e) AS eligible, count(*) FILTER (e AND o) AS wide FROM s GROUP BY 1""")
def ag23_wide_gamut(spark, d):
    return R.wide_gamut(T.pixels(spark, d).selectExpr("image_id", "y", "x", "r * (1 + x % 3) AS r", "g / (1 + y) AS g", "b"))


@query(f"""WITH {T.SQL_PIXELS}, t AS (SELECT image_id, greatest(0, 0.753833 * r + 0.1985974 * g + 0.0475696 * b) AS r, greatest(0, 0.0457439 * r + 0.9417772 * g + 0.0124789 * b) AS g,
  greatest(0, -0.0012103 * r + 0.0176017 * g + 0.9836086 * b) AS b FROM pixels)
 SELECT image_id, CAST(least(ceil(max(greatest(r, g, b)) * 203), 10000) AS BIGINT) AS max_cll, CAST(least(ceil(avg(0.2627 * r + 0.678 * g + 0.0593 * b) * 203), 10000) AS BIGINT) AS max_fall FROM t GROUP BY 1""")
def ag25_light_levels(spark, d):
    return R.light_levels(T.pixels(spark, d))


@query(f"""WITH {T.SQL_PIXELS}, e AS (SELECT image_id, 'luma' AS channel, {_LUM} AS v FROM pixels UNION ALL SELECT image_id, 'r', r FROM pixels UNION ALL SELECT image_id, 'g', g FROM pixels UNION ALL SELECT image_id, 'b', b FROM pixels)
 SELECT image_id, channel, CAST(greatest(least(floor(v * 255 + 0.5), 255), 0) AS INT) AS bin, count(*) AS n FROM e GROUP BY 1, 2, 3""")
def ag26_histogram(spark, d):
    return R.histogram(T.pixels(spark, d))


@query(f"WITH {T.SQL_PIXELS} SELECT image_id, round(avg((greatest(r, g, b) >= 0.5)::INT), 6) AS hot, round(avg((least(r, g, b) <= 0.02)::INT), 6) AS cold FROM pixels GROUP BY 1")
def ag27_clipping(spark, d):
    return T.rounded(R.clipping(T.pixels(spark, d), 0.02, 0.5))


@query(f"""WITH {T.SQL_CELLS} SELECT a.image_id, a.gy, a.gx, round(avg(b.v), 6) AS mean FROM cells a JOIN cells b ON a.image_id = b.image_id AND abs(a.gy - b.gy) <= 2 AND abs(a.gx - b.gx) <= 2 GROUP BY 1, 2, 3""")
def w4_box_mean(spark, d):
    return T.rounded(R.box_mean(T.cells(spark, d), "v", 2, "mean").select("image_id", "gy", "gx", "mean"))


def _box(table: str, value: str, out: str) -> str:
    return f"{out} AS (SELECT a.image_id, a.gy, a.gx, avg(b.{value}) AS m FROM {table} a JOIN {table} b ON a.image_id = b.image_id AND abs(a.gy - b.gy) <= 4 AND abs(a.gx - b.gx) <= 4 GROUP BY 1, 2, 3)"


@query(f"""WITH {T.SQL_CELLS}, g AS (SELECT image_id, gy, gx, ln(1 + v) AS guide, v / 2 AS gain, v AS global_gain, ln(1 + v) * ln(1 + v) AS ii, ln(1 + v) * v / 2 AS ip FROM cells),
 {_box('g', 'guide', 'mi')}, {_box('g', 'gain', 'mp')}, {_box('g', 'ii', 'mii')}, {_box('g', 'ip', 'mip')},
 ab AS (SELECT image_id, gy, gx, (mip.m - mi.m * mp.m) / (greatest(0, mii.m - mi.m * mi.m) + 5e-3) AS a, mp.m - (mip.m - mi.m * mp.m) / (greatest(0, mii.m - mi.m * mi.m) + 5e-3) * mi.m AS b
  FROM mi JOIN mp USING (image_id, gy, gx) JOIN mii USING (image_id, gy, gx) JOIN mip USING (image_id, gy, gx)), {_box('ab', 'a', 'ma')}, {_box('ab', 'b', 'mb')}
 SELECT image_id, gy, gx, round(CASE WHEN global_gain <= 0 THEN 0 ELSE least(greatest(ma.m * guide + mb.m, 0), global_gain) END, 6) AS filtered FROM g JOIN ma USING (image_id, gy, gx) JOIN mb USING (image_id, gy, gx)""")
def w5_guided_filter(spark, d):
    g = T.cells(spark, d).selectExpr("image_id", "gy", "gx", "ln(1 + v) AS guide", "v / 2 AS gain", "v AS global_gain")
    return T.rounded(R.guided_filter(g, 4).select("image_id", "gy", "gx", "filtered"))


@query(f"""WITH {T.SQL_CELLS} SELECT a.image_id, a.gy, a.gx, round(avg(b.v), 6) AS environment, round(log2((any_value(a.v) + 1e-6) / (avg(b.v) + 1e-6)), 6) AS contrast
 FROM cells a JOIN cells b ON a.image_id = b.image_id AND abs(a.gy - b.gy) <= 1 AND abs(a.gx - b.gx) <= 1 AND NOT (a.gy = b.gy AND a.gx = b.gx) GROUP BY 1, 2, 3""")
def w6_local_contrast(spark, d):
    c = T.cells(spark, d).selectExpr("image_id", "gy", "gx", "v AS cell_mean", "v AS cell_peak")
    return T.rounded(R.local_contrast(c).select("image_id", "gy", "gx", "environment", "contrast"))


@query(f"""WITH RECURSIVE {T.SQL_CELLS}, n AS (SELECT a.image_id, a.gy, a.gx, any_value(a.v) * 2 AS peak, avg(b.v) * 2 AS env FROM cells a JOIN cells b ON a.image_id = b.image_id AND abs(a.gy - b.gy) <= 1 AND abs(a.gx - b.gx) <= 1 AND NOT (a.gy = b.gy AND a.gx = b.gx) GROUP BY 1, 2, 3),
 c AS (SELECT *, log2((peak + 1e-6) / (env + 1e-6)) AS contrast FROM n WHERE peak > 1),
 q AS (SELECT *, least(greatest((peak - 1) / 3.0, 0), 1) AS t1, least(greatest((contrast - 0.4) / 2.1, 0), 1) AS t2 FROM c WHERE contrast >= 0.4),
 k AS (SELECT image_id, gy, gx, peak, t1 * t1 * (3 - 2 * t1) * t2 * t2 * (3 - 2 * t2) * 0.7 AS quality FROM q WHERE t1 * t1 * (3 - 2 * t1) * t2 * t2 * (3 - 2 * t2) * 0.7 >= 0.05),
 w(image_id, gy, gx, sy, sx) AS (SELECT image_id, gy, gx, gy, gx FROM k UNION SELECT w.image_id, w.gy, w.gx, k.gy, k.gx FROM w JOIN k ON k.image_id = w.image_id AND abs(k.gy - w.sy) <= 1 AND abs(k.gx - w.sx) <= 1),
 r AS (SELECT image_id, gy, gx, min(sy * 100 + sx) AS root FROM w GROUP BY 1, 2, 3), g AS (SELECT image_id, root, count(*) AS cells, max(peak) AS peak, max(quality) AS quality FROM r JOIN k USING (image_id, gy, gx) GROUP BY 1, 2),
 m AS (SELECT image_id, root, peak, least(greatest(quality * (0.6 + 0.4 * (least(greatest((cells - 1) / 7.0, 0), 1) ** 2) * (3 - 2 * least(greatest((cells - 1) / 7.0, 0), 1))), 0), 1) AS merit FROM g WHERE cells >= 2 AND quality >= 0.1)
 SELECT image_id, round(peak, 6) AS peak, round(merit, 6) AS merit FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY peak DESC, root) AS o FROM m) WHERE o = 1""")
def g2_highlight_components(spark, d):
    c = T.cells(spark, d).selectExpr("image_id", "gy", "gx", "v AS cell_mean", "v AS cell_peak")
    return T.rounded(R.best_highlight(R.highlight_components(R.highlight_candidates(c, exposure=2.0))))


@query(f"""WITH {T.SQL_CELLS}, spots AS (SELECT image_id, y, x, least(greatest((x + 0.5) * 8 / 12.0 - 0.5, 0), 7) AS px, least(greatest((y + 0.5) * 8 / 12.0 - 0.5, 0), 7) AS py FROM (SELECT DISTINCT image_id FROM cells), range(12) a(y), range(12) b(x)),
 t AS (SELECT *, floor(px)::INT AS x0, floor(py)::INT AS y0, least(floor(px) + 1, 7)::INT AS x1, least(floor(py) + 1, 7)::INT AS y1 FROM spots)
 SELECT t.image_id, y, x, round((a.v * (1 - (px - x0)) + b.v * (px - x0)) * (1 - (py - y0)) + (c.v * (1 - (px - x0)) + e.v * (px - x0)) * (py - y0), 6) AS v FROM t
 JOIN cells a ON a.image_id = t.image_id AND a.gy = y0 AND a.gx = x0 JOIN cells b ON b.image_id = t.image_id AND b.gy = y0 AND b.gx = x1
 JOIN cells c ON c.image_id = t.image_id AND c.gy = y1 AND c.gx = x0 JOIN cells e ON e.image_id = t.image_id AND e.gy = y1 AND e.gx = x1""")
def j14_bilinear_lookup(spark, d):
    grid = T.cells(spark, d)
    at = grid.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("x"))
    return T.rounded(R.bilinear_lookup(at, grid, "v", _sized(8, 8, 12, 12)))


@query(f"""WITH {T.SQL_ODD}, o AS (SELECT *, label + 1 AS k FROM odd)
 SELECT image_id, round(r, 6) AS r, CASE WHEN k IN (3, 4) THEN 4 - y WHEN k IN (5, 6) THEN x WHEN k IN (7, 8) THEN 12 - x ELSE y END AS y,
 CASE WHEN k IN (2, 3) THEN 12 - x WHEN k IN (5, 8) THEN y WHEN k IN (6, 7) THEN 4 - y ELSE x END AS x FROM o""")
def ra2_reorient(spark, d):
    """Images of 13 x 5 by orientations 1 to 10; 9 and 10 are none and leave the image."""
    p = T.odd_pixels(spark, d)
    labels = p.select("image_id", "label").distinct()
    turned = R.reorient(p.select("image_id", "y", "x", "r", "label"), F.col("label") + 1)
    return T.rounded(turned.select("image_id", "r", "y", "x"))


@query(f"WITH {T.SQL_PIXELS} SELECT image_id, y // 2 AS y, x // 2 AS x, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM pixels GROUP BY 1, 2, 3")
def ra3_halve(spark, d):
    return T.rounded(R.halve(T.pixels(spark, d)))


@query(f"""WITH {T.SQL_PIXELS}, s AS (SELECT image_id, gy, gx, r, greatest(0, least((x + 1) * 3 / 8.0, gx + 1) - greatest(x * 3 / 8.0, gx)) * greatest(0, least((y + 1) * 3 / 8.0, gy + 1) - greatest(y * 3 / 8.0, gy)) AS p FROM pixels, range(3) a(gy), range(3) b(gx))
 SELECT image_id, gy, gx, round(sum(r * p) / sum(p), 6) AS v FROM s WHERE p > 0 GROUP BY 1, 2, 3""")
def ra3_area_average(spark, d):
    return T.rounded(R.area_average(T.pixels(spark, d), "r", 3, 3))


@query(f"""WITH {T.SQL_ODD}, h AS (SELECT image_id, y // 2 AS gy, x // 2 AS gx, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM odd GROUP BY 1, 2, 3),
 q AS (SELECT image_id, gy, gx // CASE WHEN label % 2 = 0 THEN 2 ELSE 1 END AS gx, avg(r) AS r, avg(g) AS g, avg(b) AS b, min(label) AS label FROM h JOIN (SELECT DISTINCT image_id, label FROM odd) USING (image_id) GROUP BY 1, 2, 3),
 t AS (SELECT image_id, label, y, x, least(greatest((y + 0.5) * 3 / 2 - 0.5, 0), 2) AS py, CASE WHEN label % 2 = 0 THEN least(greatest((x + 0.5) * 4 / 3 - 0.5, 0), 3) ELSE least(greatest((x + 0.5) * 7 / 4 - 0.5, 0), 6) END AS px
  FROM (SELECT DISTINCT image_id, label FROM odd), range(2) a(y), range(4) b(x) WHERE label % 2 = 1 OR x < 3)
 SELECT t.image_id, t.y, t.x, round(sum(r * wx * wy), 6) AS r, round(sum(g * wx * wy), 6) AS g, round(sum(b * wx * wy), 6) AS b
 FROM (SELECT t.*, q.r, q.g, q.b, greatest(0, 1 - abs(px - q.gx)) AS wx, greatest(0, 1 - abs(py - q.gy)) AS wy FROM t JOIN q USING (image_id)) t GROUP BY 1, 2, 3""")
def ra3_resample_to(spark, d):
    """13 x 5 to 4 x 2 (one halving) or to 3 x 2 (two across, one down), then between cells."""
    p = T.odd_pixels(spark, d)
    targets = p.select("image_id", "label").distinct().selectExpr("image_id", "CASE WHEN label % 2 = 0 THEN 3 ELSE 4 END AS tw", "2 AS th")
    return T.rounded(R.resample_to(p.select("image_id", "y", "x", "r", "g", "b"), targets))


@query(f"""WITH {T.SQL_PIXELS}, m AS (SELECT image_id, y, x, r, (y % 2) * 2 + x % 2 AS spot, image_id % 5 AS p FROM pixels WHERE image_id % 5 < 4)
 SELECT image_id, y // 2 AS y, x // 2 AS x, round(max(CASE WHEN spot = [0, 3, 1, 2][(p + 1)::INT] THEN r END), 6) AS "R", round(max(CASE WHEN spot = [1, 2, 0, 3][(p + 1)::INT] THEN r END), 6) AS "Gr",
 round(max(CASE WHEN spot = [2, 1, 3, 0][(p + 1)::INT] THEN r END), 6) AS "Gb", round(max(CASE WHEN spot = [3, 0, 2, 1][(p + 1)::INT] THEN r END), 6) AS "B" FROM m GROUP BY 1, 2, 3""")
def ra16_bayer_pack(spark, d):
    m = T.pixels(spark, d).selectExpr("image_id", "y", "x", "r AS v")
    patterns = m.select("image_id").distinct().selectExpr("image_id", "element_at(array('RGGB', 'BGGR', 'GRBG', 'GBRG', 'XTRANS'), cast(image_id % 5 + 1 AS int)) AS pattern")
    return T.rounded(R.bayer_pack(m, patterns))


@query("""SELECT 'img-' || vec_id AS image_id, CASE WHEN label % 3 = 0 THEN 'unknown pattern' ELSE 'odd size' END AS reason FROM embeddings""")
def ra16_rejected_mosaics(spark, d):
    m = T.odd_pixels(spark, d).selectExpr("image_id", "label", "y", "x", "r AS v")
    patterns = m.select("image_id", "label").distinct().selectExpr("image_id", "CASE WHEN label % 3 > 0 THEN 'RGGB' END AS pattern")
    return R.rejected_mosaics(m.drop("label"), patterns)


@query(f"""WITH {T.SQL_CELLS}, s AS (SELECT image_id, gy, gx, round(v * 100) AS v, 4 + image_id % 2 AS black, 160 AS white FROM cells),
 n AS (SELECT a.image_id, a.gy, a.gx, any_value(a.v) AS v, any_value(a.black) AS black, any_value(a.white) AS white, list_sort(list(b.v)) AS near FROM s a
  JOIN s b ON a.image_id = b.image_id AND ((a.gy = b.gy AND abs(a.gx - b.gx) = 2) OR (a.gx = b.gx AND abs(a.gy - b.gy) = 2)) GROUP BY 1, 2, 3),
 m AS (SELECT *, CASE WHEN gx BETWEEN 2 AND 5 AND gy BETWEEN 2 AND 5 THEN near[3] END AS mid FROM n),
 r AS (SELECT *, coalesce((v <= black + 2 AND mid > black + white * 0.02) OR (v >= white * 0.995 AND mid < white * 0.8), false) AS repaired FROM m)
 SELECT image_id, gy AS y, gx AS x, repaired, round(CASE WHEN repaired THEN mid ELSE v END, 6) AS v FROM r""")
def w8_repair_sites(spark, d):
    m = T.cells(spark, d).selectExpr("image_id", "gy AS y", "gx AS x", "round(v * 100) AS v")
    levels = T.images(spark, d).selectExpr("image_id", "4.0D + image_id % 2 AS black", "160.0D AS white")
    return T.rounded(R.repair_sites(m, levels).select("image_id", "y", "x", "repaired", "v"))


def _sql_dither(salt: int) -> str:
    c = salt * 0x27D4EB2F & 0xFFFFFFFF
    # plain 64-bit products overflow in the last steps, so they are taken as HUGEINT
    s = f"xor(xor((x * 2654435761) & 4294967295, (y * 2246822519) & 4294967295), {c}::BIGINT)"
    a = f"xor(({s}), ({s}) >> 16)"
    b = f"CAST((CAST({a} AS HUGEINT) * 2146121005) % 4294967296 AS BIGINT)"
    e = f"xor({b}, {b} >> 15)"
    g = f"CAST((CAST({e} AS HUGEINT) * 2221713035) % 4294967296 AS BIGINT)"
    return f"((xor({g}, {g} >> 16)) >> 8) / 16777216.0"


@query(f"""WITH {T.SQL_CELLS}, n AS (SELECT image_id, gy::BIGINT AS y, gx::BIGINT AS x, least(v / 2, 1) AS code FROM cells), k AS (SELECT *, floor(code * 255 + 0.5) AS plain, {_sql_dither(0)} + {_sql_dither(1)} - 1 AS noise FROM n)
 SELECT image_id, y, x, CAST(CASE WHEN code <= 0 THEN 0 WHEN code >= 1 THEN 255 WHEN plain <= 1 THEN plain ELSE least(greatest(sign(code * 255 + noise) * floor(abs(code * 255 + noise) + 0.5), 0), 255) END AS INT) AS code FROM k""")
def ra11_dithered_codes(spark, d):
    c = T.cells(spark, d)
    return c.select("image_id", F.col("gy").alias("y"), F.col("gx").alias("x"), R.quantize_dithered(F.least(F.col("v") / 2, E.lit(1)), F.col("gx"), F.col("gy")).alias("code"))


@query(f"""WITH {T.SQL_CELLS}, c AS (SELECT image_id, least(v / 3, 1) AS q FROM cells), e AS (SELECT image_id, g, sum((1 + 0.15 / (q + 0.05)) * pow(pow(floor(255 * pow(q, g) + 0.5) / 255, 1 / g) - q, 2)) AS e FROM c, (VALUES (0.4), (0.5), (0.6), (0.75), (0.9), (1.0), (1.2), (1.5), (2.0)) x(g) GROUP BY 1, 2),
 b AS (SELECT image_id, min(e) AS best, max(CASE WHEN g = 1 THEN e END) AS unity, arg_min(g, e) AS g FROM e GROUP BY 1)
 SELECT image_id, CAST(CASE WHEN unity <= best * 1.01 + 1e-12 THEN 1 ELSE g END AS DOUBLE) AS gamma FROM b""")
def ag28_w10_choose_gamma(spark, d):
    return R.choose_gamma(T.cells(spark, d).selectExpr("image_id", "gy", "gx", "least(v / 3, 1.0D) AS v"))


_META = {"base": 0.0, "alternate": 2.0, "min": 0.0, "max": 2.0, "gamma": 0.8, "base_offset": 1 / 64, "alternate_offset": 1 / 16}


@query(f"""WITH {T.SQL_PIXELS}, p AS (SELECT image_id, y, x, r, g, b, least(g, 1) AS code FROM pixels),
 h AS (SELECT image_id, y, x, hs, pow(2, 2 * pow(code, 1 / 0.8) * hs / 2) AS k, r, g, b FROM p, (VALUES (0.5), (1.0), (2.0)) v(hs)),
 o AS (SELECT hs, unnest([(r + 1 / 64.0) * k - 1 / 16.0, (g + 1 / 64.0) * k - 1 / 16.0, (b + 1 / 64.0) * k - 1 / 16.0]) AS raw, unnest([r, g, b]) AS was, unnest([1, 0, 0]) AS one, unnest([1, 1, 1]) * image_id * 1000 + y * 8 + x AS px FROM h)
 SELECT CAST(hs AS DOUBLE) AS headroom, CAST(sum(one) AS BIGINT) AS pixels, count(DISTINCT CASE WHEN raw < 0 THEN px END) AS clamped_pixels, count(*) FILTER (raw < 0) AS clamped_values,
  round(avg(abs(greatest(raw, 0) - was)), 6) AS mae, round(avg(pow(greatest(raw, 0) - was, 2)), 6) AS mse, round(max(abs(greatest(raw, 0) - was)), 6) AS worst FROM o GROUP BY 1""")
def ag29_ra12_reconstruction_curve(spark, d):
    p = T.pixels(spark, d)
    codes = p.selectExpr("image_id", "y AS gy", "x AS gx", "least(g, 1.0D) AS code")
    rebuilt = R.reconstruct(p.select("image_id", "y", "x", "r", "g", "b"), codes, (0.5, 1.0, 2.0), _META, _sized(8, 8, 8, 8))
    return T.rounded(R.reconstruction_error(rebuilt, ("r", "g", "b")))


@query(f"""WITH {T.SQL_PIXELS} SELECT image_id, y, x, round(greatest((r + 1 / 64.0) * pow(2, pow(least(r, 1), 1 / 0.8)) - 1 / 16.0, 0), 6) AS hdr_r, round(greatest((g + 1 / 64.0) * pow(2, (-0.5 + 1.5 * least(g, 1)) / 2) - 1 / 16.0, 0), 6) AS hdr_g,
 round(greatest((b + 1 / 64.0) * pow(2, 1.5 * pow(least(b, 1), 1 / 1.25)) - 1 / 16.0, 0), 6) AS hdr_b,
 (((r + 1 / 64.0) * pow(2, pow(least(r, 1), 1 / 0.8)) < 1 / 16.0)::INT + ((g + 1 / 64.0) * pow(2, (-0.5 + 1.5 * least(g, 1)) / 2) < 1 / 16.0)::INT + ((b + 1 / 64.0) * pow(2, 1.5 * pow(least(b, 1), 1 / 1.25)) < 1 / 16.0)::INT) AS clamped FROM pixels""")
def ra12_three_channels(spark, d):
    """A code and a range for each colour, at half the map's headroom."""
    p = T.pixels(spark, d)
    codes = p.selectExpr("image_id", "y AS gy", "x AS gx", "least(r, 1.0D) AS cr", "least(g, 1.0D) AS cg", "least(b, 1.0D) AS cb")
    each = [_META, _META | {"min": -0.5, "max": 1.0, "gamma": 1.0}, _META | {"max": 3.0, "gamma": 1.25}]
    out = R.reconstruct(p.select("image_id", "y", "x", "r", "g", "b"), codes, (1.0,), each, _sized(8, 8, 8, 8), ("cr", "cg", "cb"))
    return T.rounded(out.select("image_id", "y", "x", "hdr_r", "hdr_g", "hdr_b", "clamped"))


@query(f"""WITH {T.SQL_PIXELS}, t AS (SELECT image_id, y, x, r, CASE WHEN r <= 0 THEN 0 WHEN r <= 0.02 THEN greatest(0, (3 * 0.016 - 0.02) / 0.0004 * r * r + (0.02 - 2 * 0.016) / 0.000008 * r * r * r) WHEN r <= 0.02 + (0.5 - 0.016) THEN 0.016 + (r - 0.02)
  ELSE 1 - 0.5 * exp(greatest(-(r - 0.504) / 0.5, -80)) END AS sdr FROM pixels) SELECT image_id, y, x, round(sdr, 6) AS sdr FROM t""")
def ra5_tone_curve(spark, d):
    return T.rounded(T.pixels(spark, d).select("image_id", "y", "x", R.tone_curve(F.col("r"), 1.0, R.tone_parameters()).alias("sdr")))


@query(f"""WITH {T.SQL_CELLS}, c AS (SELECT *, least(v, 1) AS code, image_id % 5 AS k FROM cells)
 SELECT image_id, gy, gx, CASE WHEN k = 3 THEN 'headroom out of range' WHEN k = 4 THEN 'unknown form' END AS reason, round(CASE k WHEN 0 THEN 2.5 * pow(code, 0.8) - 0.5
  WHEN 1 THEN ln(1 + 3 * CASE WHEN code >= 0.081 THEN pow((code + 0.099) / 1.099, 1 / 0.45) ELSE code / 4.5 END) / ln(2)
  WHEN 2 THEN ln(1 + 3 * CASE WHEN code > 0.04045 THEN pow((code + 0.055) / 1.055, 2.4) ELSE code / 12.92 END) / ln(2) END, 6) AS log2_gain FROM c""")
def ra4_decode_gain(spark, d):
    """Stored codes in the three forms, a legacy headroom out of range, and an unknown form."""
    c = T.cells(spark, d).selectExpr("image_id", "gy", "gx", "least(v, 1.0D) AS code")
    meta = c.select("image_id").distinct().selectExpr(
        "image_id", "element_at(array('iso', 'legacy', 'v1', 'legacy', 'other'), cast(image_id % 5 + 1 AS int)) AS form", "CASE WHEN image_id % 5 = 3 THEN 40D ELSE 4D END AS headroom",
        "-0.5D AS gain_min", "2.0D AS gain_max", "1.25D AS gamma",
    )
    return T.rounded(R.decode_gain(c, meta).select("image_id", "gy", "gx", "reason", "log2_gain"))


def _sql_light(c: str) -> str:
    return f"""CASE WHEN t IN (1, 6, 11, 12, 14, 15) THEN CASE WHEN {c} < 0.081 THEN {c} / 4.5 ELSE pow(({c} + 0.099) / 1.099, 1 / 0.45) END WHEN t IN (0, 2, 13) THEN CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END
  WHEN t = 4 THEN pow({c}, 2.2) WHEN t = 5 THEN pow({c}, 2.8) WHEN t = 8 THEN {c}
  WHEN t = 16 THEN 10000 / 203.0 * pow(greatest(pow({c}, 32 / 2523.0) - 3424 / 4096.0, 0) / (2413 / 128.0 - 2392 / 128.0 * pow({c}, 32 / 2523.0)), 16384 / 2610.0)
  WHEN t = 18 THEN 1000 / 203.0 * pow(CASE WHEN {c} <= 0.5 THEN {c} * {c} / 3 ELSE (exp(({c} - 0.55991073) / 0.17883277) + 0.28466892) / 12 END, 1.2) END"""


@query(f"""WITH {T.SQL_PIXELS}, c AS (SELECT image_id, y, x, least(r, 1) AS r, least(g, 1) AS g, least(b, 1) AS b, [1, 4, 5, 8, 13, 2, 16, 18, 99][(image_id % 9 + 1)::INT] AS t, [1, 9, 12, 2, 7][(image_id % 5 + 1)::INT] AS p FROM pixels),
 l AS (SELECT image_id, y, x, t, p, {_sql_light('r')} AS r, {_sql_light('g')} AS g, {_sql_light('b')} AS b FROM c)
 SELECT image_id, y, x, CASE WHEN t = 99 THEN 'unknown transfer' WHEN p = 7 THEN 'unknown primaries' END AS error,
  round(CASE WHEN t = 99 OR p = 7 THEN NULL WHEN p = 12 THEN r WHEN p = 9 THEN greatest(0, 1.3435783 * r - 0.2821797 * g - 0.0613986 * b) ELSE 0.82246197 * r + 0.17753803 * g END, 6) AS r,
  round(CASE WHEN t = 99 OR p = 7 THEN NULL WHEN p = 12 THEN g WHEN p = 9 THEN greatest(0, -0.0652975 * r + 1.0757879 * g - 0.0104905 * b) ELSE 0.0331942 * r + 0.9668058 * g END, 6) AS g,
  round(CASE WHEN t = 99 OR p = 7 THEN NULL WHEN p = 12 THEN b WHEN p = 9 THEN greatest(0, 0.0028218 * r - 0.0195985 * g + 1.0167767 * b) ELSE 0.01708263 * r + 0.07239741 * g + 0.91051996 * b END, 6) AS b FROM l""")
def ra1_linearise(spark, d):
    p = T.pixels(spark, d).selectExpr("image_id", "y", "x", "least(r, 1.0D) AS r", "least(g, 1.0D) AS g", "least(b, 1.0D) AS b")
    colours = p.select("image_id").distinct().selectExpr(
        "image_id", "element_at(array(1, 4, 5, 8, 13, 2, 16, 18, 99), cast(image_id % 9 + 1 AS int)) AS transfer", "element_at(array(1, 9, 12, 2, 7), cast(image_id % 5 + 1 AS int)) AS primaries"
    )
    return T.rounded(R.to_linear_p3(p, colours))


@query(f"WITH {T.SQL_PIXELS} SELECT image_id, y, x, round(least(greatest((ln(r + 0.015625) - ln(b + 0.015625)) / ln(2) / 3, 0), 1), 6) AS mask FROM pixels")
def ra17_gain_mask(spark, d):
    return T.rounded(T.pixels(spark, d).select("image_id", "y", "x", R.gain_mask(F.col("r"), F.col("b"), 3.0).alias("mask")))
