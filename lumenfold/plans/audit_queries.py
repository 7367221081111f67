"""Audit operators bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import expr as E
from lumenfold.operators import audit as A
from lumenfold.operators.labels import NOTE_SOURCE, XMP_SOURCE

from . import tables as T
from .register import Register

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query(f"""WITH {T.SQL_CELLS}, {T.SQL_IMAGES},
 b AS (SELECT image_id, {T.sql_band('v')} AS band, count(*) AS n FROM cells GROUP BY 1, 2),
 every AS (SELECT i.image_id, split, band FROM images i, (VALUES ('0-1'), ('1-2'), ('2-3'), ('3+')) x(band)),
 t AS (SELECT split, e.band, CAST(sum(coalesce(n, 0)) AS BIGINT) AS cells, count(*) FILTER (n > 0) AS images_with, count(*) AS grids
       FROM every e LEFT JOIN b USING (image_id, band) GROUP BY 1, 2)
SELECT split, band, cells, round(cells / sum(cells) OVER (PARTITION BY split), 6) AS cell_fraction, images_with,
       round(images_with / grids, 6) AS image_fraction, 0 AS missing_grids FROM t""")
def ag4_stop_band_coverage(spark, d):
    return A.stop_band_coverage(T.cells(spark, d), T.images(spark, d))


@query(f"""WITH {T.SQL_SAMPLES} SELECT model, count(iso) AS n, min(iso)::DOUBLE AS v_min, quantile_cont(iso::DOUBLE, 0.1) AS p10,
 quantile_cont(iso::DOUBLE, 0.25) AS p25, quantile_cont(iso::DOUBLE, 0.5) AS median, quantile_cont(iso::DOUBLE, 0.75) AS p75, quantile_cont(iso::DOUBLE, 0.9) AS p90, max(iso)::DOUBLE AS v_max
 FROM samples GROUP BY model""")
def ag1_profile(spark, d):
    return A.profile(T.samples(spark, d), "iso", ["model"])


@query(f"""WITH {T.SQL_SAMPLES}, r AS (SELECT model, iso, row_number() OVER (PARTITION BY model ORDER BY iso) - 1 AS k, count(*) OVER (PARTITION BY model) AS n FROM samples WHERE iso IS NOT NULL)
 SELECT model, p, iso AS v FROM r, (VALUES (0.5::DOUBLE), (0.95), (0.99)) x(p) WHERE k = CAST(floor(p * (n - 1)) AS BIGINT)""")
def ag2_floor_rank(spark, d):
    return A.floor_rank(T.samples(spark, d), "iso", (0.5, 0.95, 0.99), ["model"])


@query(f"""WITH {T.SQL_CELLS}, c AS (SELECT {T.sql_band('signed * 12')} AS band, count(*) AS n FROM cells GROUP BY 1)
 SELECT band, coalesce(n, 0) AS n FROM (VALUES ('0-1'), ('1-2'), ('2-3'), ('3+')) x(band) FULL OUTER JOIN c USING (band)""")
def ag3_band_counts(spark, d):
    return A.band_counts(T.cells(spark, d).withColumn("stops", F.col("signed") * 12), "stops")


@query(f"WITH {T.SQL_SAMPLES} SELECT split, headroom_source, count(*) AS n FROM samples GROUP BY 1, 2")
def ag5_category_counts(spark, d):
    return A.category_counts(T.samples(spark, d), "split", "headroom_source")


@query(f"WITH {T.SQL_SAMPLES} SELECT split, count(DISTINCT model) AS groups, count(DISTINCT CASE WHEN headroom_source = 'en' THEN model END) AS groups_where FROM samples GROUP BY 1")
def ag6_distinct_groups(spark, d):
    return A.distinct_groups(T.samples(spark, d), "model", F.col("headroom_source") == "en", "split")


@query("""WITH h AS (SELECT sha256(text) AS s, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1)
 SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates, count(*) FILTER (n > 1) AS repeated_digests FROM h""")
def ag7_duplicate_files(spark, d):
    return A.duplicate_files(T.samples(spark, d).select(F.sha2("text", 256).alias("digest")), "digest")


@query("""WITH g AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1)
 SELECT count(*) AS groups, count(*) FILTER (size = 1) AS singletons, count(*) FILTER (size > 1) AS multi, CAST(coalesce(sum(size) FILTER (size > 1), 0) AS BIGINT) AS in_multi,
 max(size) AS largest, quantile_cont(size::DOUBLE, 0.5) AS median, quantile_cont(size::DOUBLE, 0.9) AS p90 FROM g""")
def ag8_group_sizes(spark, d):
    return A.group_sizes(T.read(spark, d, "orders"), "o_custkey")


@query("""WITH m AS (SELECT CASE WHEN event_type = 'error' THEN NULL ELSE strftime(ts, '%Y-%m') END AS month FROM events)
 SELECT min(month) AS first_month, max(month) AS last_month, count(DISTINCT month) AS months, count(*) FILTER (month IS NULL) AS missing FROM m""")
def ag9_month_range(spark, d):
    month = F.when(F.col("event_type") != "error", F.date_format("capture_datetime", "yyyy-MM"))
    return A.month_range(T.captures(spark, d).select(month.alias("month")), "month")


@query(f"""WITH s AS (SELECT o_orderkey AS sample_id, o_orderstatus <> 'P' AS there, o_totalprice / 100000 AS headroom, o_totalprice / 100000 - 0.5 AS gain, o_orderpriority AS p, o_custkey % 5 = 0 AS bare FROM orders)
 SELECT sample_id, 'invalid_canonical_headroom' AS violation FROM s WHERE there AND headroom < 1 UNION ALL SELECT sample_id, 'invalid_canonical_max_log2_gain' FROM s WHERE there AND gain < 0
 UNION ALL SELECT sample_id, 'missing_xmp_headroom' FROM s WHERE p = '1-URGENT' AND bare UNION ALL SELECT sample_id, 'missing_makernote_headroom' FROM s WHERE p = '2-HIGH' AND bare""")
def pf5_violations(spark, d):
    rows = T.read(spark, d, "orders").selectExpr(
        "o_orderkey AS sample_id", "o_orderstatus <> 'P' AS gain_map_present", "o_totalprice / 100000 AS canonical_headroom", "o_totalprice / 100000 - 0.5D AS canonical_max_log2_gain",
        f"CASE o_orderpriority WHEN '1-URGENT' THEN '{XMP_SOURCE}' WHEN '2-HIGH' THEN '{NOTE_SOURCE}' ELSE 'unresolved' END AS headroom_source",
        "CASE WHEN o_custkey % 5 = 0 THEN cast('NaN' AS double) ELSE 2.0D END AS gain_map_headroom_xmp", "CASE WHEN o_custkey % 5 > 0 THEN 1.5D END AS apple_maker_hdr_headroom",
    )
    return A.manifest_violations(rows)


@query("""WITH e AS (SELECT DISTINCT n_name AS contract, c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 <> 0),
 f AS (SELECT DISTINCT n_name AS contract, c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 <> 0),
 j AS (SELECT coalesce(e.contract, f.contract) AS contract, coalesce(e.id, f.id) AS id, e.id AS ei, f.id AS fi FROM e FULL OUTER JOIN f ON e.contract = f.contract AND e.id = f.id),
 r AS (SELECT *, row_number() OVER (PARTITION BY contract, fi IS NULL, ei IS NULL ORDER BY id) AS k FROM j)
 SELECT contract, count(ei) AS expected, count(fi) AS found, count(*) FILTER (fi IS NULL) AS missing, count(*) FILTER (ei IS NULL) AS extra,
 coalesce(string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) FILTER (fi IS NULL AND k <= 10), '') AS missing_examples,
 coalesce(string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) FILTER (ei IS NULL AND k <= 10), '') AS extra_examples FROM r GROUP BY 1""")
def j4_reconcile(spark, d):
    assets = T.read(spark, d, "customer").join(F.broadcast(T.read(spark, d, "nation").select("n_nationkey", "n_name")), F.expr("c_nationkey = n_nationkey"))
    assets = assets.selectExpr("n_name AS contract", "c_custkey AS id")
    return A.reconcile(assets.filter("id % 7 <> 0"), assets.filter("id % 5 <> 0"), "contract", "id")


@query(f"""WITH {T.SQL_SAMPLES}, f AS (SELECT sample_id, split AS frozen_split FROM samples WHERE sample_id % 3 <> 0),
 c AS (SELECT sample_id, CASE WHEN sample_id % 11 = 0 THEN 'test' ELSE split END AS current_split FROM samples WHERE sample_id % 13 <> 0)
 SELECT coalesce(f.sample_id, c.sample_id) AS sample_id, frozen_split, current_split,
 CASE WHEN frozen_split IS NULL THEN 'new' WHEN current_split IS NULL THEN 'missing' WHEN frozen_split <> current_split THEN 'moved' ELSE 'same' END AS state
 FROM f FULL OUTER JOIN c ON f.sample_id = c.sample_id""")
def j5_assignment_changes(spark, d):
    s = T.samples(spark, d).select("sample_id", "split")
    current = s.filter("sample_id % 13 <> 0").withColumn("split", F.expr("CASE WHEN sample_id % 11 = 0 THEN 'test' ELSE split END"))
    return A.assignment_changes(s.filter("sample_id % 3 <> 0"), current)


_SQL_AUDIT = f"""s AS (SELECT doc_id AS sample_id, n_chars % 7 <> 0 AS there, CASE lang WHEN 'en' THEN '{XMP_SOURCE}' WHEN 'de' THEN '{NOTE_SOURCE}' ELSE 'unresolved' END AS hs, source AS model, text FROM documents),
 l AS (SELECT DISTINCT sample_id FROM s WHERE there), sp AS (SELECT doc_id AS sample_id, {T.split_of('doc_id')} AS split, quality FROM labels),
 g AS (SELECT text AS group_id, min(sample_id) OVER (PARTITION BY text) AS root, sample_id FROM s), mb AS (SELECT group_id, {T.split_of('root')} AS split, sample_id FROM g),
 fr AS (SELECT sample_id, CASE WHEN quality = 1 THEN 'train' ELSE split END AS split FROM sp),
 c AS (SELECT vec_id AS sample_id, abs(unnest(embedding)::DOUBLE) * 8 AS v FROM embeddings),
 tp AS (SELECT v FROM c JOIN sp USING (sample_id) JOIN s USING (sample_id) WHERE split = 'test' AND hs = '{XMP_SOURCE}'),
 m AS (SELECT (SELECT count(*) FROM l) AS labelled, (SELECT count(*) - count(DISTINCT sample_id) FROM s) AS ds, (SELECT count(*) - count(DISTINCT sample_id) FROM sp) AS da,
  (SELECT count(*) FROM l WHERE sample_id NOT IN (SELECT sample_id FROM sp)) AS sm, (SELECT count(DISTINCT sample_id) FROM sp WHERE sample_id NOT IN (SELECT sample_id FROM l)) AS se,
  (SELECT count(*) FROM l WHERE sample_id NOT IN (SELECT sample_id FROM mb)) AS gm, (SELECT count(DISTINCT sample_id) FROM mb WHERE sample_id NOT IN (SELECT sample_id FROM l)) AS ge,
  (SELECT count(DISTINCT group_id) FROM mb LEFT JOIN sp USING (sample_id) WHERE sp.split IS DISTINCT FROM mb.split) AS cg,
  (SELECT count(*) FROM fr) AS f, (SELECT count(*) FROM fr WHERE sample_id NOT IN (SELECT sample_id FROM l)) AS fm, (SELECT count(*) FROM fr LEFT JOIN sp USING (sample_id) WHERE sp.split IS DISTINCT FROM fr.split) AS fv,
  (SELECT count(*) FROM tp) AS tn, (SELECT count(*) FROM tp WHERE v >= 2 AND v < 3) AS th, (SELECT count(*) FROM s WHERE there AND hs = '{NOTE_SOURCE}') AS es,
  (SELECT count(DISTINCT model) FROM s WHERE hs = '{XMP_SOURCE}') AS mo, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS am, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS ae)"""


@query(f"""WITH {_SQL_AUDIT}, r AS (SELECT *, ds + da + sm + se + gm + ge + cg > 0 AS f1, fm + fv > 0 AS f2 FROM m)
 SELECT finding, severity, status, evidence, CASE WHEN f1 OR f2 THEN 'blocked' ELSE 'ready_with_known_gaps' END AS overall FROM r, LATERAL (VALUES
 ('DQ-001', 'critical', CASE WHEN f1 THEN 'fail' ELSE 'pass' END, concat('labelled=', labelled, '; duplicate_samples=', ds, '; duplicate_assignments=', da, '; split_missing=', sm, '; split_extra=', se, '; group_missing=', gm, '; group_extra=', ge, '; crossing_groups=', cg)),
 ('DQ-002', 'critical', CASE WHEN f2 THEN 'fail' ELSE 'pass' END, concat('frozen=', f, '; frozen_missing=', fm, '; frozen_moved=', fv)),
 ('DQ-003', 'high', CASE WHEN th < 100 THEN 'fail' ELSE 'pass' END, concat('test_pixels=', tn, '; test_high_pixels=', th)), ('DQ-004', 'high', 'warning', concat('labelled=', labelled, '; estimated=', es)),
 ('DQ-005', 'medium', 'warning', concat('models=', mo)), ('DQ-006', 'high', CASE WHEN am + ae > 0 THEN 'fail' ELSE 'pass' END, concat('assets_missing=', am, '; assets_extra=', ae))) x(finding, severity, status, evidence)""")
def g5_findings(spark, d):
    docs, labels = T.read(spark, d, "documents"), T.read(spark, d, "labels")
    samples = docs.selectExpr(
        "doc_id AS sample_id", "n_chars % 7 <> 0 AS gain_map_present", f"CASE lang WHEN 'en' THEN '{XMP_SOURCE}' WHEN 'de' THEN '{NOTE_SOURCE}' ELSE 'unresolved' END AS headroom_source", "source AS model"
    )
    splits = labels.selectExpr("doc_id AS sample_id", f"{T.split_of('doc_id')} AS split", "quality")
    groups = docs.select(F.sha2("text", 256).alias("group_id"), F.col("doc_id").alias("sample_id"))
    roots = groups.groupBy("group_id").agg(F.min("sample_id").alias("root"))
    members = groups.join(roots, "group_id").selectExpr("group_id", f"{T.split_of('root')} AS split", "sample_id")
    frozen = splits.selectExpr("sample_id", "CASE WHEN quality = 1 THEN 'train' ELSE split END AS split")
    cells = T.cells(spark, d).selectExpr("image_id AS sample_id", "v")
    ids = docs.select("doc_id").join(labels.select("doc_id", F.lit(True).alias("l")), "doc_id", "full_outer").join(docs.select("doc_id", F.lit(True).alias("d")), "doc_id", "left")
    assets = ids.agg(F.count_if(F.col("d").isNull()).alias("missing"), F.count_if(F.col("l").isNull()).alias("extra"))
    return A.findings(A.audit_metrics(samples, splits.drop("quality"), members, frozen, cells, assets))


@query("""SELECT doc_id AS name, text = lower(text) AS matches FROM documents""")
def j5_snapshot_matches(spark, d):
    docs = T.read(spark, d, "documents")
    digests = lambda c: docs.select(F.col("doc_id").alias("name"), F.sha2(c, 256).alias("sha256"))
    return A.snapshot_matches(digests("text"), digests(F.lower("text")))


@query("""WITH s AS (SELECT o_orderkey AS sample_id, o_orderstatus <> 'P' AS there, o_totalprice / 100000 AS headroom, o_totalprice / 100000 - 0.5 AS gain, o_orderpriority AS p, o_custkey % 5 = 0 AS bare FROM orders),
 v AS (SELECT sample_id, 'invalid_canonical_headroom' AS violation FROM s WHERE there AND headroom < 1 UNION ALL SELECT sample_id, 'invalid_canonical_max_log2_gain' FROM s WHERE there AND gain < 0
 UNION ALL SELECT sample_id, 'missing_xmp_headroom' FROM s WHERE p = '1-URGENT' AND bare UNION ALL SELECT sample_id, 'missing_makernote_headroom' FROM s WHERE p = '2-HIGH' AND bare)
 SELECT violation, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY violation ORDER BY sample_id) AS k FROM v) WHERE k <= 10""")
def s1_first_examples(spark, d):
    return A.first_examples(pf5_violations(spark, d), ["violation"], "sample_id", 10)