"""Label rules, reconciliations and summaries bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import bookkeeping as B
from lumenfold.operators import labels as L

from . import tables as T
from .register import Register

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.sql


def _manifest(spark, d):
    """Documents with their label as manifest rows."""
    j = T.samples(spark, d).join(T.read(spark, d, "labels").withColumnRenamed("doc_id", "sample_id"), "sample_id", "left")
    return j.selectExpr(
        "sample_id", "split", "model", "text",
        "CASE WHEN headroom_source = 'en' THEN 'xmp_hdr_gain_map_headroom' ELSE 'unresolved' END AS headroom_source",
        "CASE quality WHEN 1 THEN 131072 WHEN 0 THEN 65536 END AS gain_map_version",
        "CASE WHEN toxic = 1 THEN 'legacy_apple' WHEN sample_id % 9 = 0 THEN 'iso_21496_1_tmap' END AS phase_a_source_type",
    )


@query(f"""WITH {T.SQL_SAMPLES}, m AS (SELECT s.*, l.quality, l.toxic FROM samples s LEFT JOIN labels l ON l.doc_id = s.sample_id),
 x AS (SELECT split, 'all' AS subset FROM m
  UNION ALL SELECT split, 'xmp' FROM m WHERE headroom_source = 'en'
  UNION ALL SELECT split, 'iso_native' FROM m WHERE quality = 1 OR (coalesce(toxic, 0) <> 1 AND sample_id % 9 = 0)
  UNION ALL SELECT split, 'legacy_apple' FROM m WHERE quality = 0 OR toxic = 1)
 SELECT split, subset, count(*) AS n FROM x GROUP BY 1, 2""")
def pf1_label_subsets(spark, d):
    m = _manifest(spark, d)
    out = None
    for subset in ("all", "xmp", "iso_native", "legacy_apple"):
        part = L.label_subset(m, subset).groupBy("split").agg(F.count("*").alias("n")).withColumn("subset", F.lit(subset))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {T.SQL_CELLS}, m AS (SELECT image_id, CASE image_id % 7 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE max(signed) * 10 - 2 END AS top FROM cells GROUP BY 1)
 SELECT image_id, coalesce(top > 0, false) AS per_image_eligible, coalesce(image_id % 5 <> 0 AND top = 0, false) AS degenerate_gain_label FROM m""")
def pf2_eligibility(spark, d):
    top = T.cells(spark, d).groupBy("image_id").agg(F.max("signed").alias("m")).selectExpr(
        "image_id", "image_id % 5 <> 0 AS gain_map_present", "CASE image_id % 7 WHEN 0 THEN 0D WHEN 1 THEN NULL ELSE m * 10 - 2 END AS canonical_max_log2_gain"
    )
    return L.with_eligibility(top).select("image_id", "per_image_eligible", "degenerate_gain_label")


@query("""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_tax * 20 AS m33, l_discount / 5 AS m48, CASE WHEN l_returnflag = 'A' THEN l_quantity / 10 END AS xmp,
  l_linestatus = 'F' AS noted, l_linenumber <> 7 AS present FROM lineitem),
 s AS (SELECT *, CASE WHEN m33 >= 1 AND m48 > 0.01 THEN 2.303 - m48 * 0.303 WHEN m33 >= 1 THEN 3 - m48 * 70 WHEN m48 > 0.01 THEN 1.601 - m48 * 0.101 ELSE 1.8 - m48 * 20 END AS stops FROM x),
 h AS (SELECT *, CASE WHEN NOT present THEN NULL WHEN xmp IS NOT NULL THEN xmp WHEN noted THEN pow(2, CASE WHEN stops > 0 THEN stops ELSE 0 END) END AS headroom FROM s)
 SELECT id, CASE WHEN NOT present THEN NULL WHEN xmp IS NOT NULL THEN 'xmp_hdr_gain_map_headroom' WHEN noted THEN 'apple_makernote_piecewise_estimate' ELSE 'unresolved' END AS headroom_source,
  round(headroom, 6) AS canonical_headroom, round(ln(headroom) / ln(2), 6) AS canonical_max_log2_gain FROM h""")
def pf3_pf4_headroom(spark, d):
    x = T.read(spark, d, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS id", "CASE WHEN l_linestatus = 'F' THEN l_tax * 20 END AS maker33", "l_discount / 5 AS maker48",
        "CASE WHEN l_returnflag = 'A' THEN l_quantity / 10 END AS xmp_headroom", "l_linenumber <> 7 AS gain_map_present",
    )
    return T.rounded(L.resolve_headroom(x).select("id", "headroom_source", "canonical_headroom", "canonical_max_log2_gain"))


@query("""SELECT key, count(*) AS rows FROM (SELECT unnest(CASE event_type WHEN 'error' THEN ['k', 'GPS'] WHEN 'click' THEN ['k', 'gps', 'Latitude'] ELSE ['k'] END) AS key FROM events)
 WHERE lower(key) IN ('source_name', 'capture_datetime', 'capture_timezone_offset', 'gps', 'latitude', 'longitude') GROUP BY 1""")
def pf8_privacy_guard(spark, d):
    """Private keys hidden in the raw lines of a manifest made of the events."""
    extra = "CASE event_type WHEN 'error' THEN ', \"GPS\": 1}' WHEN 'click' THEN ', \"gps\": 1, \"Latitude\": 2}' ELSE '}' END"
    return L.leaked_keys(T.read(spark, d, "events").select(F.expr(f"concat(substring(props, 1, length(props) - 1), {extra})").alias("value")))


@query("""WITH s AS (SELECT p_partkey AS id, p_size * 97 AS w, CAST(floor(p_retailprice) AS BIGINT) * 3 AS h FROM part),
 f AS (SELECT id, w * least(1.0, 1024.0 / greatest(w, h)) AS fw, h * least(1.0, 1024.0 / greatest(w, h)) AS fh FROM s),
 a AS (SELECT id, greatest(1, CAST(ceil(greatest(1, round_even(fw, 0)) / 16) AS BIGINT)) AS gw, greatest(1, CAST(ceil(greatest(1, round_even(fh, 0)) / 16) AS BIGINT)) AS gh FROM f)
 SELECT id, gw * 16 AS aw, gh * 16 AS ah, gw AS grid_w, gh AS grid_h FROM a""")
def pf11_geometry(spark, d):
    s = T.read(spark, d, "part").selectExpr("p_partkey AS id", "p_size * 97 AS w", "floor(p_retailprice) * 3 AS h")
    aw, ah = L.aligned_size(F.col("w"), F.col("h"), 1024)
    return s.select("id", aw.alias("aw"), ah.alias("ah")).selectExpr("id", "aw", "ah", "aw DIV 16 AS grid_w", "ah DIV 16 AS grid_h")


_DECODES = """o_orderkey AS file, o_orderstatus <> 'P' AS success, o_custkey % 3 = 0 AS decode_degraded, o_custkey % 2 = 0 AS target_dimensions_applied,
 o_custkey AS decoded_width, 700 AS decoded_height, 800 AS target_width, 600 AS target_height"""


@query("""SELECT o_orderkey AS file, CASE WHEN o_custkey % 2 = 1 THEN 'crop refused' WHEN o_custkey < 800 THEN 'short of target' ELSE 'other' END AS degradation
 FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey % 3 = 0""")
def pf12_degraded_decodes(spark, d):
    columns = [c.strip() for c in _DECODES.split(",")]
    return L.degraded_decodes(T.read(spark, d, "orders").selectExpr(*columns)).select("file", "degradation")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'scene' WHEN p_size % 4 = 1 AND p_retailprice > 1500 THEN 'display_hdr' ELSE 'display_sdr' END AS domain,
 CASE WHEN p_size % 4 = 1 AND p_retailprice > 1500 THEN round(p_retailprice / 1500, 6) ELSE 1.0 END AS headroom FROM part""")
def pf13_domain(spark, d):
    p = T.read(spark, d, "part").withColumn("d", F.expr("element_at(array('scene', 'display_hdr', 'unknown', 'display_sdr'), cast(p_size % 4 + 1 AS int))"))
    domain, headroom = L.declared_domain(F.col("d"), F.col("p_retailprice") / 1500)
    return T.rounded(p.select(F.col("p_partkey").alias("id"), domain.alias("domain"), headroom.alias("headroom")))


@query("""WITH s AS (SELECT *, l_quantity / 10 AS stops, CASE WHEN l_linenumber IN (4) THEN 'iso' WHEN l_linenumber IN (3, 7) THEN 'other' ELSE 'legacy' END AS v FROM lineitem),
 r AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, v, stops, CASE
  WHEN v = 'other' THEN 'unknown version' WHEN v = 'iso' AND l_tax = 0 THEN 'no XMP headroom' WHEN v = 'iso' AND l_tax >= 0.05 THEN 'headroom conflict'
  WHEN v = 'iso' AND l_discount > 0.08 THEN 'gain max against headroom' WHEN v = 'legacy' AND l_tax = 0 THEN 'no resolved headroom'
  WHEN v = 'legacy' AND (l_quantity < 1.5 OR l_quantity > 48) THEN 'headroom out of range' END AS reason FROM s)
 SELECT l_orderkey, l_linenumber, l_suppkey, CASE v WHEN 'iso' THEN 'iso_21496_1_tmap' WHEN 'legacy' THEN 'legacy_apple' END AS source_type, CASE v WHEN 'iso' THEN 'high' WHEN 'legacy' THEN 'low' END AS confidence, reason,
  CASE WHEN v = 'legacy' AND reason IS NULL THEN round(log2(l_quantity_), 6) END AS stops
 FROM (SELECT r.*, CASE WHEN v = 'legacy' THEN stops * 10 / 1.5 END AS l_quantity_ FROM r)""")
def pf14_label_routing(spark, d):
    s = T.read(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_suppkey", "CASE l_linenumber WHEN 4 THEN 131072 WHEN 3 THEN 5 WHEN 7 THEN NULL ELSE 65536 END AS gain_map_version",
        "l_quantity / 10 AS alternate_stops", "l_quantity / 10 + CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END AS gain_max",
        "CASE WHEN l_tax > 0 THEN pow(2, l_quantity / 10) * CASE WHEN l_tax >= 0.05 THEN 1.5 ELSE 1 END END AS xmp_headroom",
        "CASE WHEN l_tax > 0 THEN l_quantity / 1.5 END AS canonical_headroom",
    )
    stops = F.round(F.col("metadata.gain_max.numerator") / F.col("metadata.gain_max.denominator"), 6)
    return L.route_labels(s).select("l_orderkey", "l_linenumber", "l_suppkey", "source_type", "confidence", "reason", stops.alias("stops"))


@query("""SELECT doc_id AS sample_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'unexpected' WHEN doc_id % 17 = 0 THEN 'changed' ELSE 'same' END AS state
 FROM documents WHERE NOT (doc_id % 11 = 0 AND doc_id % 13 = 0)""")
def pf15_content_check(spark, d):
    s = T.samples(spark, d).select("sample_id", F.coalesce("text", F.lit("")).alias("text"))
    manifest = s.filter("sample_id % 13 <> 0").select("sample_id", F.sha2("text", 256).alias("sha256"))
    now = F.expr("encode(CASE WHEN sample_id % 17 = 0 THEN concat(text, ' ') ELSE text END, 'UTF-8')")
    return L.content_check(manifest, s.filter("sample_id % 11 <> 0").select("sample_id", now.alias("content")))


@query(f"""WITH {T.SQL_SAMPLES} SELECT split, CASE WHEN sample_id % 23 = 0 THEN 'no manifest row' WHEN quality IS NULL THEN 'no group' END AS reason, count(*) AS n, count(DISTINCT CASE WHEN sample_id % 23 <> 0 THEN model END) AS models
 FROM samples LEFT JOIN labels ON doc_id = sample_id GROUP BY 1, 2""")
def j2_split_manifest_groups(spark, d):
    s = T.samples(spark, d)
    members = T.read(spark, d, "labels").selectExpr("doc_id AS sample_id", "concat('grp_', quality) AS group_id")
    j = L.join_corpus(s.select("sample_id", "split"), s.filter("sample_id % 23 <> 0").select("sample_id", "model"), members)
    return j.groupBy("split", "reason").agg(F.count("*").alias("n"), F.count_distinct("model").alias("models"))


@query("""SELECT coalesce(a.id, b.id) AS id, a.id IS NULL AS extra, b.id IS NULL AS missing FROM (SELECT doc_id AS id FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL) a
 FULL OUTER JOIN (SELECT doc_id AS id FROM labels) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL""")
def j3_missing_and_extra(spark, d):
    documents = T.read(spark, d, "documents").filter("text IS NOT NULL AND lang IS NOT NULL")
    return L.missing_and_extra(documents.select(F.col("doc_id").alias("id")), T.read(spark, d, "labels").select(F.col("doc_id").alias("id")), "id")


@query("""WITH g AS (SELECT o_custkey AS c, o_orderstatus AS s FROM orders), t AS (SELECT DISTINCT c FROM g WHERE s = 'F'), v AS (SELECT DISTINCT c FROM g WHERE s = 'P'), r AS (SELECT DISTINCT c FROM g WHERE s = 'O')
 SELECT count(*) FILTER (t AND v) AS overlap, count(*) FILTER (v AND NOT r) AS unregistered, count(*) FILTER (r AND NOT v) AS unselected,
  count(*) FILTER ((t AND v) OR (v AND NOT r) OR (r AND NOT v)) = 0 AS holds
 FROM (SELECT k.c, k.c IN (SELECT c FROM t) AS t, k.c IN (SELECT c FROM v) AS v, k.c IN (SELECT c FROM r) AS r FROM (SELECT DISTINCT c FROM g) k)""")
def j16_fold_guards(spark, d):
    """Customers by the states of their orders as folds."""
    o = T.read(spark, d, "orders")
    fold = lambda s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("sample_id"))
    return L.fold_guards(fold("F"), fold("P"), fold("O"))


@query("""SELECT count(*) AS samples, sum((lang = 'en')::INT)::BIGINT AS iso, sum((lang = 'fr')::INT)::BIGINT AS legacy, count(*) - count(CASE WHEN lang IN ('en', 'fr') THEN 1 END) AS unresolved,
 bool_and(coalesce(lang IN ('en', 'fr'), false)) AND sum((lang = 'en')::INT) = 423 AND sum((lang = 'fr')::INT) = 388 AS accepted FROM documents""")
def ag31_corpus_lock(spark, d):
    kind = F.expr("CASE lang WHEN 'en' THEN 'iso_21496_1_tmap' WHEN 'fr' THEN 'legacy_apple' ELSE 'none' END")
    return L.corpus_lock(T.read(spark, d, "documents").select(kind.alias("source_type")), 423, 388)


@query("""WITH l AS (SELECT p_partkey AS sample_id, CASE WHEN p_size < 25 THEN 'iso' WHEN p_size < 45 THEN 'legacy' END AS kind, p_retailprice / 1000 - 1.2 AS lo, p_size * 0.1 AS hi, CASE WHEN p_size % 9 = 0 THEN p_size * 0.1 + 1 ELSE p_size * 0.1 END AS alt FROM part),
 c AS (SELECT count(*) AS n, count(*) FILTER (kind = 'iso') AS i, count(*) FILTER (kind = 'legacy') AS g, count(*) FILTER (kind IS NULL) AS u, count(*) FILTER (kind = 'iso' AND abs(hi - alt) > 1e-6) AS b, count(*) FILTER (kind = 'iso' AND lo < 0) AS m FROM l),
 r AS (SELECT count(*) FILTER (NOT (l_discount <= 0.09)) AS x FROM lineitem)
 SELECT gate, value, expected, passed FROM c, r, LATERAL (VALUES ('corpus_counts', n, 811, n = 811 AND i = 423 AND g = 388), ('unresolved_zero', u, 0, u = 0), ('native_metadata_consistent', b, 0, b = 0),
 ('negative_gain_min_preserved', m, 382, m = 382), ('golden_roundtrip', x, 0, x = 0), ('desktop_golden', 0, 0, false)) v(gate, value, expected, passed)""")
def ag31_acceptance_gates(spark, d):
    labels = T.read(spark, d, "part").selectExpr(
        "p_partkey AS sample_id", f"CASE WHEN p_size < 25 THEN '{L.ISO_TYPE}' WHEN p_size < 45 THEN '{L.LEGACY_TYPE}' END AS source_type", "p_retailprice / 1000 - 1.2D AS gain_min",
        "p_size * 0.1D AS gain_max", "CASE WHEN p_size % 9 = 0 THEN p_size * 0.1D + 1 ELSE p_size * 0.1D END AS alternate_headroom",
    )
    trips = T.read(spark, d, "lineitem").selectExpr("l_discount <= 0.09 AS ok")
    return L.acceptance_gates(labels, trips, {"samples": 811, "iso": 423, "legacy": 388, "negative_gain_min": 382})


@query(f"""SELECT count(*) AS samples, count(*) FILTER (o_orderstatus <> 'P') AS gain_maps, count(*) FILTER (o_orderpriority = '1-URGENT') AS headroom_from_xmp, count(*) FILTER (o_orderpriority = '2-HIGH') AS headroom_from_makernote,
 count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS unresolved, count(*) FILTER (o_totalprice > 100000) AS per_image_eligible, count(*) FILTER (o_totalprice < 5000) AS degenerate_gain_labels FROM orders""")
def ag34_enrichment_summary(spark, d):
    rows = T.read(spark, d, "orders").selectExpr(
        "o_orderkey AS sample_id", "o_orderstatus <> 'P' AS gain_map_present", f"CASE o_orderpriority WHEN '1-URGENT' THEN '{L.XMP_SOURCE}' WHEN '2-HIGH' THEN '{L.NOTE_SOURCE}' ELSE 'unresolved' END AS headroom_source",
        "o_totalprice > 100000 AS per_image_eligible", "o_totalprice < 5000 AS degenerate_gain_label",
    )
    return L.enrichment_summary(rows)


@query(f"""WITH {T.SQL_SAMPLES}, m AS (SELECT *, sample_id % 37 AS g FROM samples), n AS (SELECT split, g, count(*) AS n FROM m GROUP BY 1, 2)
 SELECT split, count(*) AS samples, count(DISTINCT model) AS models, count(DISTINCT g) AS groups, (SELECT max(n) FROM n WHERE n.split = m.split) AS largest FROM m GROUP BY split""")
def ag34_split_summary(spark, d):
    s = T.samples(spark, d)
    return L.split_summary(s.selectExpr("sample_id", "split", "sample_id % 37 AS group_id"), s)


_RUNS = """p_partkey AS run; CASE WHEN p_size = 1 THEN '' ELSE p_brand END AS output; CASE WHEN p_size % 2 = 0 THEN 'preview' ELSE 'full' END AS decode_intent; p_size % 4 AS preview_max_edge;
 p_partkey % 2 = 0 AS half_size; element_at(array('ultrahdr', 'hlg_heif', 'pq_avif'), cast(p_partkey % 3 + 1 AS int)) AS encoding; CASE WHEN p_size > 25 THEN 10 ELSE 8 END AS depth;
 p_partkey % 5 = 0 AS auto_headroom; p_retailprice / 500 AS headroom_stops; CASE WHEN p_partkey % 7 = 0 THEN 'g' END AS external_gain; CASE WHEN p_partkey % 14 = 0 THEN 'r' END AS external_gain_report;
 p_size % 3 = 0 AS recursive; p_retailprice - 1000 AS digital_gain"""


@query("""SELECT p_partkey AS run, rule FROM part, LATERAL (VALUES ('output missing', p_size = 1), ('preview without max edge', p_size IN (4, 8, 12, 16, 20, 24, 28, 32, 36, 40, 44, 48)),
 ('half size outside preview', (p_size + p_partkey) % 2 = 1), ('ultra hdr depth', p_partkey % 3 = 0 AND p_size >= 26), ('hlg headroom', p_partkey % 3 = 1 AND p_partkey % 5 > 0 AND p_retailprice > 1150),
 ('external gain without report', p_partkey % 14 = 7), ('external gain in batch', p_partkey % 7 = 0 AND p_size % 3 = 0), ('digital gain', p_retailprice <= 1000 OR p_retailprice > 1064)) x(rule, broken) WHERE broken""")
def pf10_cross_settings(spark, d):
    return L.cross_settings(T.read(spark, d, "part").selectExpr(*[c.strip() for c in _RUNS.split(";")]))


@query("""SELECT o_orderkey AS run, sha256('1.0|' || 'priority=' || o_orderpriority || '|' || 'status=' || o_orderstatus) AS fingerprint FROM orders""")
def hash_settings_fingerprint(spark, d):
    """The clerk does not affect the output and stays out of the fingerprint."""
    o = T.read(spark, d, "orders")
    pairs = F.explode(F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority", F.lit("customer"), F.col("o_custkey").cast("string"))).alias("key", "value")
    rules = spark.createDataFrame([("status", True), ("priority", True), ("customer", False)], "key string, affects_output_bytes boolean")
    return L.settings_fingerprint(o.select(F.col("o_orderkey").alias("run"), pairs), rules, "1.0")


@query("""WITH p AS (SELECT *, p_partkey AS run FROM part), s AS (SELECT run, 'depth' AS key, (p_size % 13)::VARCHAR AS value FROM p UNION ALL SELECT run, 'recursive', CASE WHEN p_size % 3 = 0 THEN 'true' WHEN p_size % 3 = 1 THEN 'false' ELSE 'maybe' END FROM p
  UNION ALL SELECT run, 'headroom', CASE WHEN p_size % 5 = 0 THEN 'auto' WHEN p_size % 5 = 1 THEN 'much' ELSE (p_size / 10.0)::DOUBLE::VARCHAR END FROM p)
 SELECT run, key, CASE WHEN key = 'depth' THEN 'out of range' WHEN key = 'recursive' THEN 'not a boolean' WHEN value = 'much' THEN 'not a number' ELSE 'out of range' END AS reason FROM s
 WHERE (key = 'depth' AND TRY_CAST(value AS INT) NOT BETWEEN 8 AND 12) OR (key = 'recursive' AND value = 'maybe') OR (key = 'headroom' AND (value = 'much' OR (value <> 'auto' AND TRY_CAST(value AS DOUBLE) > 4)))""")
def pf9_boolean_and_auto_settings(spark, d):
    p = T.read(spark, d, "part").selectExpr(
        "p_partkey AS run", "cast(p_size % 13 AS string) AS depth", "element_at(array('true', 'false', 'maybe'), cast(p_size % 3 + 1 AS int)) AS recursive",
        "CASE p_size % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'much' ELSE cast(p_size / 10 AS string) END AS headroom",
    )
    pairs = F.explode(F.create_map(*[x for c in ("depth", "recursive", "headroom") for x in (F.lit(c), F.col(c))])).alias("key", "value")
    rules = [("depth", "integer", 8.0, 12.0, None), ("recursive", "boolean", None, None, None), ("headroom", "auto_or_number", 0.0, 4.0, None)]
    return B.validate_settings(p.select("run", pairs), spark.createDataFrame(rules, "key string, kind string, minimum double, maximum double, choices array<string>"))
