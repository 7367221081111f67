"""Gain-map operators bound to 8 x 8 images made of the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions.expr import lit
from lumenfold.operators import gain as G
from lumenfold.operators import raster as R

from . import tables as T
from .register import Register

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.sql

_SIZES = (4, 4, 8, 8)


def _sizes():
    return tuple(F.lit(k) for k in _SIZES)


def _developed(spark, d):
    """Every image with a fixed development that differs by image."""
    return T.read(spark, d, "embeddings").selectExpr("vec_id AS image_id", "vec_id % 3 - 0.5D AS exposure_ev", "cast(2 + vec_id % 2 AS double) AS headroom", "cast(100 * (1 + vec_id % 9) AS double) AS iso")


@query()
def ra6_ra7_analyse(spark, d):
    """Exposure and headroom chosen from each image's own content."""
    capture = T.read(spark, d, "embeddings").selectExpr("vec_id AS image_id", "cast(100 * (1 + label) AS double) AS iso", "1 / (10.0D + vec_id % 50) AS seconds", "cast(2 + vec_id % 4 AS double) AS aperture")
    return T.rounded(G.analyse(T.pixels(spark, d), capture))


@query()
def ra8_photographic_gain(spark, d):
    return T.rounded(G.photographic_gain(T.pixels(spark, d), _developed(spark, d)).select("image_id", "gy", "gx", "gain", "code", "gain_max", "gamma"))


@query()
def ra9_ag24_render_statistics(spark, d):
    images = _developed(spark, d)
    p = T.pixels(spark, d)
    cells = G.photographic_gain(p, images).checkpoint()  # read twice; small next to the pixels
    rendered = G.render_base(p, images.drop("iso"), cells)
    return T.rounded(G.render_statistics(rendered, images), 4)


@query(f"""WITH {T.SQL_PIXELS}, x AS (SELECT image_id, y, x, r * 1.2 AS r, g, b * 0.5 AS b FROM pixels), k AS (SELECT *, greatest(r, g, b) AS peak, 0.2289746 * r + 0.6917385 * g + 0.0792869 * b AS lum FROM x),
 t AS (SELECT *, CASE WHEN peak > 1 THEN least(greatest((1 - lum) / (peak - lum), 0), 1) END AS t FROM k)
 SELECT image_id, y, x, round(CASE WHEN peak <= 1 THEN r WHEN lum >= 1 THEN 1 ELSE least(greatest(lum + t * (r - lum), 0), 1) END, 6) AS r, round(CASE WHEN peak <= 1 THEN g WHEN lum >= 1 THEN 1 ELSE least(greatest(lum + t * (g - lum), 0), 1) END, 6) AS g,
 round(CASE WHEN peak <= 1 THEN b WHEN lum >= 1 THEN 1 ELSE least(greatest(lum + t * (b - lum), 0), 1) END, 6) AS b FROM t""")
def ra10_display_sdr(spark, d):
    p = T.pixels(spark, d).selectExpr("image_id", "y", "x", "r * 1.2 AS r", "g", "b * 0.5 AS b")
    return T.rounded(G.display_sdr(p, p.select("image_id").distinct().withColumn("exposure_ev", lit(0))))


@query()
def ra10_display_sdr_brightened(spark, d):
    p = T.pixels(spark, d)
    return T.rounded(G.display_sdr(p, p.select("image_id").distinct().withColumn("exposure_ev", F.col("image_id") % 3 * 0.5)))


@query()
def ra10_display_hdr(spark, d):
    p = T.pixels(spark, d)
    images = p.select("image_id").distinct().selectExpr("image_id", "1.0D + image_id % 2 AS available", "1.0D AS output")
    return T.rounded(G.display_hdr(p, images)[1])


@query(f"""WITH {T.SQL_CELLS}, m AS (SELECT *, least(2.0 * 1.25, 2.2) AS top, least((-0.5 + image_id % 2) * 1.25, least(2.0 * 1.25, 2.2)) AS lo FROM cells), s AS (SELECT *, greatest(least(signed * 8 * 1.25, top), lo) AS stops FROM m)
 SELECT image_id, gy, gx, round(stops, 6) AS stops, round(pow(least(greatest((stops - lo) / (top - lo), 0), 1), 0.9), 6) AS code FROM s""")
def ra13_external_gain(spark, d):
    c = T.cells(spark, d).selectExpr("image_id", "gy", "gx", "signed * 8 AS v")
    meta = c.select("image_id").distinct().selectExpr("image_id", "-0.5D + image_id % 2 AS gain_min", "2.0D AS gain_max", "0.9D AS gamma")
    return T.rounded(G.external_gain(c, meta, 1.25, 2.2))


@query("""SELECT renderer, error, count(*) AS n FROM (SELECT CASE label % 4 WHEN 0 THEN 'sdr_split' WHEN 1 THEN 'hdr_split' WHEN 2 THEN 'photographic' END AS renderer, CASE WHEN label % 4 = 3 THEN 'unknown domain' END AS error FROM embeddings) GROUP BY 1, 2""")
def ra14_route(spark, d):
    images = T.read(spark, d, "embeddings").selectExpr("vec_id AS image_id", "element_at(array('display_sdr', 'display_hdr', 'scene', 'other'), cast(label % 4 + 1 AS int)) AS domain")
    return G.route(images).groupBy("renderer", "error").agg(F.count("*").alias("n"))


@query(f"""WITH {T.SQL_CELLS}, l AS (SELECT range AS k, range * range * 0.5 AS v FROM range(9)), p AS (SELECT image_id, gy, gx, least(greatest(v / 2, 0), 1) * 8 AS p FROM cells)
 SELECT image_id, gy AS y, gx AS x, round(a.v * (1 - (p - floor(p))) + b.v * (p - floor(p)), 6) AS v FROM p JOIN l a ON a.k = floor(p) JOIN l b ON b.k = least(floor(p) + 1, 8)""")
def j12_linearise(spark, d):
    lut = spark.range(9).selectExpr("id AS k", "id * id * 0.5D AS v")
    return T.rounded(G.linearise(T.cells(spark, d).selectExpr("image_id", "gy AS y", "gx AS x", "v"), lut, 2.0))


@query(f"""WITH {T.SQL_CELLS}, p AS (SELECT image_id, gy AS y, gx AS x, v, gx / 7.0 * 2 AS fx, gy / 7.0 * 2 AS fy, (ARRAY[0, 1, 1, 2])[((gy % 2) * 2 + gx % 2 + 1)::INT] AS c FROM cells),
 g AS (SELECT c.range AS c, y.range AS y, x.range AS x, 1 + c.range * 0.1 + y.range * 0.2 + x.range * x.range * 0.05 AS gain FROM range(3) c, range(3) y, range(3) x)
 SELECT image_id, p.y, p.x, round(p.v * ((a.gain * (1 - (fx - floor(fx))) + b.gain * (fx - floor(fx))) * (1 - (fy - floor(fy))) + (e.gain * (1 - (fx - floor(fx))) + h.gain * (fx - floor(fx))) * (fy - floor(fy))), 6) AS v FROM p
 JOIN g a ON a.c = p.c AND a.y = floor(fy) AND a.x = floor(fx) JOIN g b ON b.c = p.c AND b.y = floor(fy) AND b.x = least(floor(fx) + 1, 2)
 JOIN g e ON e.c = p.c AND e.y = least(floor(fy) + 1, 2) AND e.x = floor(fx) JOIN g h ON h.c = p.c AND h.y = least(floor(fy) + 1, 2) AND h.x = least(floor(fx) + 1, 2)""")
def j13_lens_shading(spark, d):
    nodes = spark.range(27).selectExpr("cast(id % 3 AS int) AS channel", "(id DIV 3) % 3 AS y", "id DIV 9 AS x").withColumn("gain", F.expr("1 + channel * 0.1D + y * 0.2D + x * x * 0.05D"))
    return T.rounded(G.shade(T.cells(spark, d).selectExpr("image_id", "gy AS y", "gx AS x", "v"), nodes))


@query(f"""WITH {T.SQL_CELLS}, i AS (SELECT DISTINCT image_id, CASE image_id % 3 WHEN 0 THEN 'RGGB' WHEN 1 THEN 'GBRG' END AS pattern, 5.0 + image_id % 2 AS black, 150.0 + image_id % 4 * 50 AS white FROM cells WHERE image_id % 3 < 2),
 l AS (SELECT image_id, pattern, black, white, gy AS y, gx AS x, least(greatest(round(v * 100) / white, 0), 1) * 200.24 AS v FROM cells JOIN i USING (image_id)),
 n AS (SELECT a.image_id, a.y, a.x, list_sort(list(b.v))[3] AS mid FROM l a JOIN l b ON a.image_id = b.image_id AND ((a.y = b.y AND abs(a.x - b.x) = 2) OR (a.x = b.x AND abs(a.y - b.y) = 2))
  WHERE a.x BETWEEN 2 AND 5 AND a.y BETWEEN 2 AND 5 GROUP BY 1, 2, 3),
 f AS (SELECT l.* REPLACE (CASE WHEN (v <= black + 2 AND mid > black + white * 0.02) OR (v >= white * 0.995 AND mid < white * 0.8) THEN round(mid) ELSE v END AS v) FROM l LEFT JOIN n USING (image_id, y, x)),
 c AS (SELECT *, CASE WHEN pattern = 'RGGB' THEN [0, 1, 1, 2] ELSE [1, 2, 0, 1] END[((y % 2) * 2 + x % 2 + 1)::INT] AS ch FROM f)
 SELECT image_id, y, x, round(greatest(0, v * (1 + ch * 0.1 + y / 7.0 * 2 * 0.02) - black) / (white - black) * (1 + image_id % 2), 6) AS v FROM c""")
def ra15_calibrate(spark, d):
    """Each image with its own pattern, black, white and gain; the third without a pattern is rejected."""
    lut = spark.range(9).selectExpr("id AS k", "id * 25.03D AS v")
    nodes = spark.range(27).selectExpr("cast(id % 3 AS int) AS channel", "(id DIV 3) % 3 AS y", "id DIV 9 AS x").withColumn("gain", F.expr("1 + channel * 0.1D + y * 0.02D"))
    mosaic = T.cells(spark, d).selectExpr("image_id", "gy AS y", "gx AS x", "round(v * 100) AS v")
    images = mosaic.select("image_id").distinct().selectExpr(
        "image_id", "element_at(array('RGGB', 'GBRG', 'none'), cast(image_id % 3 + 1 AS int)) AS pattern", "5.0D + image_id % 2 AS black",
        "150.0D + image_id % 4 * 50 AS white", "1.0D + image_id % 2 AS digital_gain",
    )
    return T.rounded(G.calibrate(mosaic, lut, nodes, images))


def _sql_noise(channel: int, salt: int) -> str:
    fixed = (channel * 0xC2B2AE3D & 0xFFFFFFFF) ^ (salt * 0x27D4EB2F & 0xFFFFFFFF)
    s = f"xor(xor((x::BIGINT * 2654435761) & 4294967295, (y::BIGINT * 2246822519) & 4294967295), {fixed}::BIGINT)"
    a = f"xor(({s}), ({s}) >> 16)"
    b = f"CAST((CAST({a} AS HUGEINT) * 2146121005) % 4294967296 AS BIGINT)"
    e = f"xor({b}, {b} >> 15)"
    g = f"CAST((CAST({e} AS HUGEINT) * 2221713035) % 4294967296 AS BIGINT)"
    return f"((xor({g}, {g} >> 16)) >> 8) / 16777216.0"


_PLANES = "greatest(0, 0.753833 * r + 0.1985974 * g + 0.0475696 * b) AS cr, greatest(0, 0.0457439 * r + 0.9417772 * g + 0.0124789 * b) AS cg, greatest(0, -0.0012103 * r + 0.0176017 * g + 0.9836086 * b) AS cb"


def _sql_codes(signal: str) -> str:
    """SQL of dithered 10-bit codes; signal is the encoding of a plane {c}."""
    columns = []
    for k, c in enumerate("rgb"):
        v, noise = f"s{c}", f"({_sql_noise(k, 0)} + {_sql_noise(k, 1)} - 1)"
        dithered = f"least(greatest(sign({v} * 1023 + {noise}) * floor(abs({v} * 1023 + {noise}) + 0.5), 0), 1023)"
        columns.append(f"CAST(CASE WHEN {v} <= 0 THEN 0 WHEN {v} >= 1 THEN 1023 WHEN floor({v} * 1023 + 0.5) <= 1 THEN floor({v} * 1023 + 0.5) ELSE {dithered} END AS INT) AS {c}")
    signals = ", ".join(f"{signal.format(c='c' + c)} AS s{c}" for c in "rgb")
    return f"WITH {T.SQL_PIXELS}, p AS (SELECT image_id, y, x, {_PLANES} FROM pixels), s AS (SELECT image_id, y, x, {signals} FROM p) SELECT image_id, y, x, {', '.join(columns)} FROM s"


_PQ = "pow((3424 / 4096.0 + 2413 / 128.0 * pow(least({c} * 203, 10000) / 10000, 2610 / 16384.0)) / (1 + 2392 / 128.0 * pow(least({c} * 203, 10000) / 10000, 2610 / 16384.0)), 2523 / 32.0)"
_HLG = "CASE WHEN pow(least({c} * 0.203, 1), 1 / 1.2) <= 1 / 12.0 THEN sqrt(3 * pow(least({c} * 0.203, 1), 1 / 1.2)) ELSE 0.17883277 * ln(12 * pow(least({c} * 0.203, 1), 1 / 1.2) - 0.28466892) + 0.55991073 END"


@query(_sql_codes(_PQ))
def ra18_pq_codes(spark, d):
    return R.bt2100_codes(T.pixels(spark, d))


@query(_sql_codes(_HLG))
def ra18_hlg_codes(spark, d):
    return R.bt2100_codes(T.pixels(spark, d), "hlg")


@query()
def ag37_perceptual_hashes(spark, d):
    return R.area_hashes(T.pixels(spark, d).selectExpr("image_id", "y", "x", "r AS luma"))


@query(f"""WITH RECURSIVE {T.SQL_PIXELS}, t AS (SELECT image_id, least(avg(r), 0.9995) AS t FROM pixels GROUP BY 1),
 b(image_id, t, low, high, k) AS (SELECT image_id, t, 0.0::DOUBLE, 64.0::DOUBLE, 0 FROM t
  UNION ALL SELECT image_id, t, CASE WHEN f < t THEN mid ELSE low END, CASE WHEN f < t THEN high ELSE mid END, k + 1 FROM (SELECT *, CASE
    WHEN mid <= 0.08 THEN (3 * 0.0576 - 1.08 * 0.08) / 0.0064 * mid * mid + (1.08 * 0.08 - 2 * 0.0576) / 0.000512 * mid * mid * mid
    WHEN mid <= 0.08 + (0.48 - 0.0576) / 1.08 THEN 0.0576 + 1.08 * (mid - 0.08) ELSE 1 - 0.52 * exp(-1.08 * (mid - 0.08 - (0.48 - 0.0576) / 1.08) / 0.52) END AS f
   FROM (SELECT *, (low + high) / 2 AS mid FROM b WHERE k < 60)))
 SELECT image_id, round((low + high) / 2, 5) AS scene FROM b WHERE k = 60""")
def ra5_inverse_tone(spark, d):
    """The scene light behind each image's mean level."""
    level = T.pixels(spark, d).groupBy("image_id").agg(F.least(F.avg("r"), lit(0.9995)).alias("t"))
    return level.select("image_id", F.round(R.once(R.inverse_tone(F.col("t"), G.Look().curve), lambda x: x), 5).alias("scene"))


@query(f"""WITH RECURSIVE t AS (SELECT DISTINCT label AS k, label / 9.0 AS sdr FROM embeddings),
 b(k, sdr, low, high, n) AS (SELECT k, sdr, 0.0::DOUBLE, 64.0::DOUBLE, 0 FROM t
  UNION ALL SELECT k, sdr, CASE WHEN f < least(sdr, 0.9995) THEN mid ELSE low END, CASE WHEN f < least(sdr, 0.9995) THEN high ELSE mid END, n + 1 FROM (SELECT *, CASE
    WHEN mid <= 0.08 THEN (3 * 0.0576 - 1.08 * 0.08) / 0.0064 * mid * mid + (1.08 * 0.08 - 2 * 0.0576) / 0.000512 * mid * mid * mid
    WHEN mid <= 0.08 + (0.48 - 0.0576) / 1.08 THEN 0.0576 + 1.08 * (mid - 0.08) ELSE 1 - 0.52 * exp(-1.08 * (mid - 0.08 - (0.48 - 0.0576) / 1.08) / 0.52) END AS f
   FROM (SELECT *, (low + high) / 2 AS mid FROM b WHERE n < 60))),
 s AS (SELECT k, sdr, CASE WHEN sdr <= 0 THEN 0 ELSE (low + high) / 2 END AS scene FROM b WHERE n = 60),
 g AS (SELECT *, CASE WHEN scene > 0.08 + (0.48 - 0.0576) / 1.08 THEN (8 - 7.52 * exp(-1.08 * (scene - 0.08 - (0.48 - 0.0576) / 1.08) / 7.52)) / (1 - 0.52 * exp(-1.08 * (scene - 0.08 - (0.48 - 0.0576) / 1.08) / 0.52)) ELSE 1 END AS up FROM s)
 SELECT e.vec_id AS image_id, round(scene, 5) AS scene, round(ln(up) / ln(2), 5) AS gain_stops FROM embeddings e JOIN g ON g.k = e.label""")
def ra5_tone_table(spark, d):
    """The sampled curve with ten samples and three stops, read at each image's label."""
    table = R.tone_table(spark, 10, G.Look().curve, 3.0)
    images = T.read(spark, d, "embeddings").selectExpr("vec_id AS image_id", "cast(label AS long) AS k")
    return T.rounded(images.join(F.broadcast(table), "k").select("image_id", "scene", "gain_stops"), 5)


@query(f"""WITH {T.SQL_CELLS}, c AS (SELECT image_id, gy, gx, least(v / 2, 1) AS code FROM cells),
 t AS (SELECT image_id, y, x, CASE WHEN image_id % 2 = 0 THEN 16 ELSE 8 END AS n FROM (SELECT DISTINCT image_id FROM cells), range(16) a(y), range(16) b(x) WHERE image_id % 2 = 0 OR (y < 8 AND x < 8))
 SELECT t.image_id, t.y AS gy, t.x AS gx, round(sum(code * greatest(0, 1 - abs(least(greatest((t.x + 0.5) * 8 / n - 0.5, 0), 7) - c.gx)) * greatest(0, 1 - abs(least(greatest((t.y + 0.5) * 8 / n - 0.5, 0), 7) - c.gy))), 6) AS code
 FROM t JOIN c USING (image_id) GROUP BY 1, 2, 3""")
def ra13_lift_grid(spark, d):
    """8 x 8 codes of a 32 x 32 image are raised to 16 x 16; those of a 10 x 10 image are finer than its own grid and stay."""
    codes = T.cells(spark, d).selectExpr("image_id", "gy", "gx", "least(v / 2, 1.0D) AS code")
    images = codes.select("image_id").distinct().selectExpr("image_id", "CASE WHEN image_id % 2 = 0 THEN 32 ELSE 10 END AS w", "CASE WHEN image_id % 2 = 0 THEN 32 ELSE 10 END AS h")
    return T.rounded(G.lift_grid(codes, images))


@query()
def ra14_render_all(spark, d):
    """Every image by the renderer of its domain, as one line an image."""
    p = T.pixels(spark, d)
    images = _developed(spark, d).withColumn("domain", F.expr("element_at(array('display_sdr', 'display_hdr', 'scene', 'other'), cast(image_id % 4 + 1 AS int))"))
    images = images.withColumn("available", F.col("headroom"))
    base, gains = G.render_all(p.select("image_id", "y", "x", "r", "g", "b"), images)
    g = gains.groupBy("image_id", "renderer").agg(F.count("*").alias("cells"), F.max("gain").alias("gain"))
    b = base.groupBy("image_id", "renderer").agg(F.count("*").alias("pixels"), F.avg("r").alias("r"))
    return T.rounded(g.join(b, ["image_id", "renderer"]), 4)
