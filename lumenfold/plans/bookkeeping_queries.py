"""Bookkeeping, conformance and time-driven operators bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import bookkeeping as B
from lumenfold.operators import conformance as G

from . import tables as T
from .register import Register

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query("""WITH s AS (SELECT o_orderkey AS source, o_orderstatus AS recovery, o_custkey % 8 AS orientation, CAST(floor(o_totalprice) AS BIGINT) AS width, o_orderkey % 2 = 0 AS half_size FROM orders),
 d AS (SELECT source, CASE WHEN source % 11 = 0 THEN 'X' ELSE recovery END AS recovery, CASE WHEN source % 7 = 0 THEN 9 ELSE orientation END AS orientation, CASE WHEN source % 3 = 0 THEN width * 2 ELSE width END AS width FROM s WHERE source % 13 <> 0)
 SELECT s.source, CASE WHEN s.recovery IS DISTINCT FROM d.recovery THEN 'recovery' WHEN s.orientation IS DISTINCT FROM d.orientation THEN 'orientation'
 WHEN NOT coalesce((NOT half_size AND s.width = d.width) OR (half_size AND s.width > 0 AND (d.width = s.width * 2 OR d.width + 1 = s.width * 2)), false) THEN 'width' END AS reason FROM s LEFT JOIN d USING (source)""")
def j9_binding_mismatch(spark, d):
    s = T.read(spark, d, "orders").selectExpr("o_orderkey AS source", "o_orderstatus AS recovery", "o_custkey % 8 AS orientation", "floor(o_totalprice) AS width", "o_orderkey % 2 = 0 AS half_size")
    now = s.filter("source % 13 <> 0").selectExpr("source", "CASE WHEN source % 11 = 0 THEN 'X' ELSE recovery END AS recovery", "CASE WHEN source % 7 = 0 THEN 9 ELSE orientation END AS orientation", "CASE WHEN source % 3 = 0 THEN width * 2 ELSE width END AS width")
    return B.binding_mismatch(s, now, "source", ["recovery", "orientation"], ["width"])


@query("""WITH i AS (SELECT doc_id AS input, n_chars AS size, sha256(coalesce(text, '')) AS digest FROM documents), s AS (SELECT input, CASE WHEN input % 5 = 0 THEN size + 1 ELSE size END AS size, digest FROM i WHERE input % 4 <> 0)
 SELECT i.input, coalesce(i.size = s.size AND i.digest = s.digest, false) AS current FROM i LEFT JOIN s USING (input)""")
def j10_current_outputs(spark, d):
    i = T.samples(spark, d).select(F.col("sample_id").alias("input"), F.col("iso").alias("size"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    state = i.filter("input % 4 <> 0").withColumn("size", F.expr("CASE WHEN input % 5 = 0 THEN size + 1 ELSE size END"))
    return B.current_outputs(i, state, "input", ["size", "digest"]).select("input", "current")


@query("""SELECT doc_id AS input, CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 1 END AS times, n_chars AS size FROM documents""")
def st1_ingest(spark, d):
    """Three batches: all inputs, a fifth of them changed, and those back at their first stamp; how often each was processed."""
    from lumenfold.sources.sinks import scratch_folder, taken
    from lumenfold.streaming import jobs

    folder = scratch_folder(spark, "ingest")
    first = T.samples(spark, d).selectExpr("sample_id AS input", "cast(iso AS long) AS size")
    for batch in (first, first.withColumn("size", F.expr("CASE WHEN input % 5 = 0 THEN size + 1 ELSE size END")), first):
        jobs.ingest_batch(batch, f"{folder}/state", "input", ["size"], lambda df: df.select("input").write.mode("append").parquet(f"{folder}/work"))
    times = spark.read.parquet(f"{folder}/work").groupBy("input").agg(F.count("*").cast("int").alias("times"))
    return taken(times.join(jobs.ingest_state(spark, f"{folder}/state", "input"), "input"), folder)


@query("""WITH i AS (SELECT doc_id AS input, n_chars AS size FROM documents), s AS (SELECT input, CASE WHEN input % 5 = 0 THEN size + 1 ELSE size END AS size FROM i WHERE input % 4 <> 0)
 SELECT input, size FROM i WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.input = i.input AND s.size = i.size)""")
def st1_j10_stale_inputs(spark, d):
    i = T.samples(spark, d).selectExpr("sample_id AS input", "iso AS size")
    return B.stale_inputs(i, i.filter("input % 4 <> 0").withColumn("size", F.expr("CASE WHEN input % 5 = 0 THEN size + 1 ELSE size END")), "input", ["size"])


@query("""WITH o AS (SELECT p_partkey AS input, 'out/' || p_brand || '-' || p_size || '.img' AS output FROM part) SELECT input, output FROM o WHERE output IN (SELECT output FROM o GROUP BY 1 HAVING count(*) > 1)""")
def j11_collisions(spark, d):
    return B.collisions(T.read(spark, d, "part").selectExpr("p_partkey AS input", "concat('out/', p_brand, '-', p_size, '.img') AS output"), "output")


@query("""WITH e AS (SELECT user_id AS cache, event_id AS entry, ts AS modified, CAST(floor(abs(value) * 100) AS BIGINT) + 1 AS size FROM events),
 r AS (SELECT *, sum(size) OVER (PARTITION BY cache) AS total, coalesce(sum(size) OVER (PARTITION BY cache ORDER BY modified, entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM e)
 SELECT cache, entry, size, total - gone > 20000 AS "delete" FROM r""")
def w9_retention(spark, d):
    e = T.read(spark, d, "events").selectExpr("user_id AS cache", "event_id AS entry", "ts AS modified", "floor(abs(value) * 100) + 1 AS size")
    return B.retention(e, 20_000, "cache").select("cache", "entry", "size", "delete")


_RULES = [("size", "integer", 1.0, 40.0, None), ("price", "number", 950.0, 1700.0, None), ("brand", "enum", None, None, ["Brand#11", "Brand#12", "Brand#21", "Brand#22", "Brand#13"])]


@query("""WITH s AS (SELECT p_partkey AS run, 'size' AS key, p_size::VARCHAR AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice::VARCHAR FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part UNION ALL SELECT p_partkey, 'unheard', 'x' FROM part WHERE p_partkey % 10 = 0)
 SELECT run, key, CASE key WHEN 'unheard' THEN 'unknown key' WHEN 'brand' THEN 'not a choice' ELSE 'out of range' END AS reason FROM s
 WHERE key = 'unheard' OR (key = 'brand' AND value NOT IN ('Brand#11', 'Brand#12', 'Brand#21', 'Brand#22', 'Brand#13')) OR (key = 'size' AND NOT (value::DOUBLE BETWEEN 1 AND 40)) OR (key = 'price' AND NOT (value::DOUBLE BETWEEN 950 AND 1700))""")
def pf9_validate_settings(spark, d):
    p = T.read(spark, d, "part")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in (("size", F.col("p_size")), ("price", F.col("p_retailprice")), ("brand", F.col("p_brand")))])).alias("e")
    settings = p.select(F.col("p_partkey").alias("run"), pairs).select("run", "e.key", "e.value").unionByName(p.filter("p_partkey % 10 = 0").selectExpr("p_partkey AS run", "'unheard' AS key", "'x' AS value"))
    rules = spark.createDataFrame(_RULES, "key string, kind string, minimum double, maximum double, choices array<string>")
    return B.validate_settings(settings, rules)


#: A payload from a line item: version bytes, flags, and a common denominator of 1000 with numerators of the row.
_FLAGS = "CASE WHEN l_linenumber % 7 = 0 THEN 4 WHEN l_linenumber % 5 = 0 THEN 9 ELSE 8 END"


@query("""WITH p AS (SELECT l_returnflag AS corpus, CASE WHEN l_linenumber % 7 = 0 THEN 4 WHEN l_linenumber % 5 = 0 THEN 9 ELSE 8 END AS flags, CAST(floor(l_quantity * 10) AS BIGINT) AS alt,
  CASE WHEN l_linenumber % 3 = 0 THEN CAST(floor(l_quantity * 10) AS BIGINT) ELSE CAST(floor(l_quantity * 10) AS BIGINT) - 7 END AS gmax, CAST(floor(l_discount * 100) AS BIGINT) * 100 - 300 AS gmin, l_suppkey % 4 = 0 AS long FROM lineitem),
 r AS (SELECT corpus, profile, CASE WHEN flags = 4 THEN 'backward direction' WHEN flags = 9 THEN 'reserved flags' WHEN long THEN 'length' WHEN gmax < gmin THEN 'gain order'
  WHEN profile = 'apple_strict' AND abs(gmax / 1000.0 - alt / 1000.0) > 1e-6 THEN 'gain max against headroom' ELSE 'accepted' END AS reason FROM p, (VALUES ('iso'), ('apple_strict')) x(profile))
 SELECT corpus, profile, reason, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def ag35_pf6_pf7_profile_regression(spark, d):
    word = lambda e: f"lpad(hex(({e}) & 4294967295L), 8, '0')"
    alt = "floor(l_quantity * 10)"
    gmax = f"CASE WHEN l_linenumber % 3 = 0 THEN {alt} ELSE {alt} - 7 END"
    gmin = "floor(l_discount * 100) * 100 - 300"
    parts = ["'0000000000'", f"lpad(hex({_FLAGS}), 2, '0')", word("1000L"), word("0L"), word(alt), word(gmin), word(gmax), word("1000L"), word("16L"), word("16L"), "CASE WHEN l_suppkey % 4 = 0 THEN '00' ELSE '' END"]
    return G.profile_regression(T.read(spark, d, "lineitem").selectExpr("l_returnflag AS corpus", f"unhex(concat({', '.join(parts)})) AS payload"))


@query("""WITH a AS (SELECT vec_id AS fixture_id, label AS headroom, unnest(embedding) AS u, unnest(range(64)) AS k FROM embeddings WHERE vec_id % 5 <> 0),
 b AS (SELECT vec_id AS fixture_id, label AS headroom, unnest(embedding[1:(63 + vec_id % 2)]) * (1 + vec_id % 3 * 0.01::FLOAT) AS v, unnest(range(63 + vec_id % 2)) AS k FROM embeddings WHERE vec_id % 7 <> 0),
 j AS (SELECT coalesce(a.fixture_id, b.fixture_id) AS fixture_id, coalesce(a.headroom, b.headroom) AS headroom, u::DOUBLE AS u, v::DOUBLE AS v FROM a FULL OUTER JOIN b ON a.fixture_id = b.fixture_id AND a.headroom = b.headroom AND a.k = b.k)
 SELECT fixture_id, headroom, count(*) FILTER (u IS NOT NULL AND v IS NOT NULL) AS compared, count(*) FILTER (u IS NULL) AS missing_left, count(*) FILTER (v IS NULL) AS missing_right,
 round(max(abs(u - v)), 4) AS worst, round(avg(abs(u - v)), 4) AS mean, count(*) FILTER (abs(u - v) > 1) AS beyond FROM j GROUP BY 1, 2""")
def j8_compare_nodes(spark, d):
    e = T.read(spark, d, "embeddings")
    a = e.filter("vec_id % 5 <> 0").selectExpr("vec_id AS fixture_id", "label AS headroom", "transform(embedding, x -> cast(x AS double)) AS rgb")
    b = e.filter("vec_id % 7 <> 0").selectExpr("vec_id AS fixture_id", "label AS headroom", "transform(slice(embedding, 1, cast(63 + vec_id % 2 AS int)), x -> cast(x * cast(1 + vec_id % 3 * 0.01 AS float) AS double)) AS rgb")
    return T.rounded(G.compare_nodes(a, b, tolerance=1.0), 4)


@query("""WITH f AS (SELECT user_id % 20 AS client, event_id, ts AS "at", epoch_us(ts) AS us FROM events WHERE event_type = 'error'),
 r AS (SELECT f.*, (SELECT count(*) FROM f o WHERE o.client = f.client AND o.us > f.us - 86400000000 AND (o.us < f.us OR (o.us = f.us AND o.event_id <= f.event_id))) AS recent FROM f)
 SELECT client, event_id, "at", recent, CASE WHEN recent >= 8 THEN 60 ELSE 0 END AS locked_seconds FROM r""")
def st2_failure_throttle(spark, d):
    f = T.read(spark, d, "events").filter("event_type = 'error'").selectExpr("user_id % 20 AS client", "event_id", "ts AS at")
    return B.failure_throttle(f, 86_400, 8, 60)


@query("""WITH l AS (SELECT user_id AS session, max(ts) AS last FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
 SELECT session, last FROM l, n WHERE epoch_us(now) - epoch_us(last) > 86400000000 AND session % 10 <> 0""")
def st3_idle_sessions(spark, d):
    e = T.read(spark, d, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    activity = e.selectExpr("user_id AS session", "ts AS at")
    return B.idle_sessions(activity, now, activity.select("session").distinct().filter("session % 10 = 0"))


@query(f"""WITH {T.SQL_CAPTURES}, g AS (SELECT model, capture_datetime AS t, CASE WHEN epoch_us(capture_datetime) - epoch_us(lag(capture_datetime) OVER (PARTITION BY model ORDER BY capture_datetime)) <= 1800000000 THEN 0 ELSE 1 END AS new FROM captures),
 s AS (SELECT *, sum(new) OVER (PARTITION BY model ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT model, min(t) AS first_capture, max(t) AS last_capture, count(*) AS captures FROM s GROUP BY model, run""")
def st4_capture_sessions(spark, d):
    """The streaming job over a table: Spark's session windows merge at exactly the gap."""
    from lumenfold.streaming import jobs

    found = jobs.capture_sessions(T.captures(spark, d).withColumn("capture_datetime", F.col("capture_datetime").cast("timestamp")))
    return found.selectExpr("model", "cast(first AS timestamp_ntz) AS first_capture", "cast(last AS timestamp_ntz) AS last_capture", "captures")


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS worst, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY 1, 2""")
def st5_running_statistics(spark, d):
    """The streaming job over a table; its percentiles are exact for as few values as an hour has here."""
    from lumenfold.streaming import jobs

    e = T.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = jobs.running_statistics(e, "ts", "event_type", "value")
    return T.rounded(found.selectExpr("cast(start AS timestamp_ntz) AS hour", "event_type", "n", "mean", "worst", "q[0] AS p50", "q[1] AS p95"))


@query("""SELECT o_custkey::VARCHAR AS tool, 'in/' || o_orderkey AS input, o_orderstatus <> 'P' AS success, round(o_totalprice / 1000 + o_orderkey % 7, 6) AS total_ms, round(o_totalprice / 10000, 6) AS rendered_peak FROM orders""")
def sink4_src4_run_reports(spark, d):
    """Results gathered into one report a run, written as JSON, and read back file by file."""
    from lumenfold.sources.manifests import read_reports
    from lumenfold.sources.sinks import run_report, scratch_folder, taken

    results = T.read(spark, d, "orders").selectExpr(
        "o_custkey AS run", "concat('in/', o_orderkey) AS input", "o_orderstatus <> 'P' AS success", "o_totalprice / 1000 AS decode_ms", "cast(o_orderkey % 7 AS double) AS process_ms",
        "named_struct('rendered_peak', o_totalprice / 10000) AS render",
    )
    settings = results.select("run").distinct().selectExpr("run", "8 AS schema", "cast(run AS string) AS tool", "map('depth', '10') AS settings")
    folder = scratch_folder(spark, "reports")
    run_report(results, settings, key="input").drop("run").write.json(f"{folder}/all")
    rows = read_reports(spark, f"{folder}/all", lines=True).select("tool", "input", "success", "total_ms", F.col("render.rendered_peak").alias("rendered_peak"))
    return taken(T.rounded(rows), folder)


@query("""SELECT doc_id AS sample_id, 'out/' || source || '/' || doc_id || '-hdr.avif' AS output, 'dng' AS suffix FROM documents""")
def src7_src8_output_paths(spark, d):
    from lumenfold.sources.manifests import extension, output_path

    paths = T.samples(spark, d).select("sample_id", F.concat(F.lit("file:/in/root/"), F.col("model"), F.lit("/"), F.col("sample_id").cast("string"), F.lit(".DNG")).alias("path"))
    return paths.select("sample_id", output_path(F.col("path"), "/in/root", "out", ".avif").alias("output"), extension(F.col("path")).alias("suffix"))
