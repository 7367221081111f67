"""Corpus operators bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import expr as E
from lumenfold.operators import corpus as C

from . import tables as T
from .register import Register

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.sql

_EDGES = """e AS (SELECT lag(sample_id) OVER w AS p, sample_id AS s, epoch_us(capture_datetime) - epoch_us(lag(capture_datetime) OVER w) AS gap, model FROM captures
 WHERE capture_datetime IS NOT NULL WINDOW w AS (PARTITION BY model ORDER BY capture_datetime, sample_id))"""


@query(f"WITH {T.SQL_CAPTURES}, {_EDGES} SELECT least(p, s) AS a, greatest(p, s) AS b FROM e WHERE p IS NOT NULL AND gap <= 1800000000")
def w1_session_edges(spark, d):
    return C.session_edges(T.captures(spark, d))


@query(f"""WITH {T.SQL_CAPTURES}, {_EDGES}, r AS (SELECT s, model, sum(CASE WHEN gap <= 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY e.model ORDER BY c.capture_datetime, s ROWS UNBOUNDED PRECEDING) AS run
  FROM e JOIN (SELECT sample_id, capture_datetime FROM captures) c ON c.sample_id = s)
 SELECT s AS sample_id, min(s) OVER (PARTITION BY model, run) AS session FROM r""")
def w1_capture_sessions(spark, d):
    return C.capture_sessions(T.captures(spark, d))


#: Two 64-bit fingerprints of each text: the ends of its MD5 digests, with a few bits flipped by the row, so that near pairs exist.
_HASHES = """hashes AS (SELECT doc_id AS sample_id, h1 # (CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 63 ELSE 127 END)::BIGINT AS phash,
  h2 # (CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 7 ELSE 255 END)::BIGINT AS dhash FROM (SELECT doc_id, ('0x' || substr(m, 1, 15))::BIGINT AS h1, ('0x' || substr(m, 17, 15))::BIGINT AS h2
  FROM (SELECT doc_id, md5(coalesce(text, '')) AS m FROM documents)))"""


def hashes(spark, d):
    m = F.md5(F.coalesce(F.col("text"), F.lit("")))
    number = lambda at: F.conv(F.substring(m, at, 15), 16, 10).cast("long")
    flip1 = F.expr("CASE sample_id % 4 WHEN 0 THEN 0L WHEN 1 THEN 5L WHEN 2 THEN 63L ELSE 127L END")
    flip2 = F.expr("CASE sample_id % 3 WHEN 0 THEN 0L WHEN 1 THEN 7L ELSE 255L END")
    return T.samples(spark, d).select("sample_id", number(1).bitwiseXOR(flip1).alias("phash"), number(17).bitwiseXOR(flip2).alias("dhash"))


_NEAR = "near AS (SELECT x.sample_id AS a, y.sample_id AS b FROM hashes x JOIN hashes y ON x.sample_id < y.sample_id AND bit_count(xor(x.phash, y.phash)) <= 5 AND bit_count(xor(x.dhash, y.dhash)) <= 6)"
_HASHES = _HASHES.replace("h1 # (", "xor(h1, (").replace("END)::BIGINT AS phash", "END)::BIGINT) AS phash").replace("h2 # (", "xor(h2, (").replace("END)::BIGINT AS dhash", "END)::BIGINT) AS dhash")


@query(f"""WITH {_HASHES}, {_NEAR}, r AS (SELECT phash, dhash, min(sample_id) AS rep FROM hashes GROUP BY 1, 2)
 SELECT a, b FROM near JOIN r ra ON ra.rep = a JOIN r rb ON rb.rep = b
 UNION ALL SELECT rep, sample_id FROM hashes JOIN r USING (phash, dhash) WHERE sample_id <> rep""")
def j6_near_pairs(spark, d):
    return C.near_pairs(hashes(spark, d))


@query(f"""WITH RECURSIVE {_HASHES}, {_NEAR}, both_ways AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
 walk(node, seen) AS (SELECT sample_id, sample_id FROM hashes UNION SELECT walk.node, b FROM walk JOIN both_ways ON a = walk.seen)
 SELECT node AS sample_id, min(seen) AS root FROM walk GROUP BY 1""")
def g1_components(spark, d):
    h = hashes(spark, d)
    return C.components(h.select("sample_id"), C.near_pairs(h))


@query(f"""WITH RECURSIVE {_HASHES}, {_NEAR}, both_ways AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
 walk(node, seen) AS (SELECT sample_id, sample_id FROM hashes UNION SELECT walk.node, b FROM walk JOIN both_ways ON a = walk.seen),
 r AS (SELECT node AS sample_id, min(seen) AS root FROM walk GROUP BY 1)
 SELECT root, 'grp_' || substr(sha256(string_agg(sample_id::VARCHAR, chr(10) ORDER BY sample_id::VARCHAR)), 1, 16) AS group_id, count(*) AS size FROM r GROUP BY 1""")
def ag33_group_ids(spark, d):
    return C.group_ids(g1_components(spark, d))


_GROUPS = f"""{_HASHES}, {_NEAR}, cap AS (SELECT h.sample_id, d.source AS model, e.ts FROM hashes h JOIN documents d ON d.doc_id = h.sample_id LEFT JOIN events e ON e.event_id = h.sample_id),
 lagged AS (SELECT *, lag(sample_id) OVER w AS prev, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM cap WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY model ORDER BY ts, sample_id)),
 tied AS (SELECT prev AS a, sample_id AS b FROM lagged WHERE gap <= 1800000000),
 linked AS (SELECT a, b FROM near UNION SELECT b, a FROM near UNION SELECT a, b FROM tied UNION SELECT b, a FROM tied),
 walk(node, seen) AS (SELECT sample_id, sample_id FROM hashes UNION SELECT walk.node, b FROM walk JOIN linked ON a = walk.seen),
 rooted AS (SELECT node AS sample_id, min(seen) AS root FROM walk GROUP BY 1),
 fr AS (SELECT doc_id AS sample_id, {T.split_of('doc_id')} AS fs FROM labels),
 gr AS (SELECT root, 'grp_' || substr(sha256(string_agg(sample_id::VARCHAR, chr(10) ORDER BY sample_id::VARCHAR)), 1, 16) AS group_id, count(*) AS size, count(DISTINCT fs) AS n, min(fs) AS s,
  count(*) FILTER (fs IS NULL) AS new_members FROM rooted LEFT JOIN fr USING (sample_id) GROUP BY 1),
 named AS (SELECT *, CASE WHEN n > 1 THEN NULL WHEN n = 1 THEN s ELSE 'train' END AS split FROM gr)"""


def _group_tables(spark, d):
    """documents as samples, captured when the event of their number happened; a document without one is undated."""
    h = hashes(spark, d)
    samples = T.samples(spark, d).select("sample_id", "model")
    times = T.captures(spark, d).select("sample_id", "capture_datetime")
    frozen = T.read(spark, d, "labels").selectExpr("doc_id AS sample_id", f"{T.split_of('doc_id')} AS split")
    return samples, samples.select("sample_id").join(times, "sample_id", "left"), h, frozen


@query(f"WITH RECURSIVE {_GROUPS} SELECT sample_id, root, group_id, split FROM rooted JOIN named USING (root)")
def g1_build_groups(spark, d):
    return C.build_groups(*_group_tables(spark, d))[0].select("sample_id", "root", "group_id", "split")


@query(f"WITH RECURSIVE {_GROUPS} SELECT group_id, size, split, n > 1 AS conflict, new_members FROM named")
def g1_group_table(spark, d):
    return C.build_groups(*_group_tables(spark, d))[1].drop("models")


@query(f"WITH {_GROUPS.split(' linked AS')[0].rstrip(', ').rstrip(',')} SELECT (SELECT count(*) FROM tied) AS temporal_adjacency_edges, (SELECT count(*) FROM near) AS visual_near_duplicate_pairs")
def g1_edge_counts(spark, d):
    samples, captures, h, _ = _group_tables(spark, d)
    return C.group_edges(samples.join(captures, "sample_id"), h)


@query(f"""WITH {T.SQL_SAMPLES}, m AS (SELECT *, sample_id // 3 AS group_id FROM samples), f AS (SELECT sample_id, split AS fs FROM samples WHERE sample_id % 4 = 1),
 g AS (SELECT group_id, count(DISTINCT fs) AS n, min(fs) AS s FROM m LEFT JOIN f USING (sample_id) GROUP BY 1)
 SELECT group_id, CASE WHEN n > 1 THEN NULL WHEN n = 1 THEN s ELSE 'train' END AS split, n > 1 AS conflict FROM g""")
def g3_assign_groups(spark, d):
    s = T.samples(spark, d).select("sample_id", "split")
    return C.assign_groups(s.select("sample_id", F.expr("sample_id DIV 3").alias("group_id")), s.filter("sample_id % 4 = 1"))


@query(f"""WITH {T.SQL_SAMPLES}, m AS (SELECT sample_id, split, model AS group_id FROM samples UNION ALL SELECT sample_id, split, 'extra' FROM samples WHERE sample_id % 50 = 0)
 SELECT (SELECT count(*) FROM (SELECT group_id FROM m GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS crossing,
 (SELECT count(*) FROM (SELECT sample_id FROM m GROUP BY 1 HAVING count(DISTINCT group_id) > 1)) AS overlapping, CAST(0 AS BIGINT) AS empty""")
def g4_group_consistency(spark, d):
    s = T.samples(spark, d)
    members = s.selectExpr("sample_id", "split", "model AS group_id").unionByName(s.filter("sample_id % 50 = 0").selectExpr("sample_id", "split", "'extra' AS group_id"))
    return C.group_consistency(members)


@query("""SELECT d.doc_id AS sample_id, source AS model, quality FROM documents d JOIN labels l USING (doc_id)""")
def j1_with_private(spark, d):
    private = T.read(spark, d, "labels").selectExpr("doc_id AS sample_id", "quality")
    return C.with_private(T.samples(spark, d).select("sample_id", "model"), private)[0]


@query("""SELECT doc_id AS sample_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def j1_missing_private(spark, d):
    return C.with_private(T.samples(spark, d).select("sample_id"), T.read(spark, d, "labels").selectExpr("doc_id AS sample_id"))[1]


@query(f"""WITH {T.SQL_CAPTURES}, {_EDGES}, {_HASHES}, {_NEAR}, r AS (SELECT phash, dhash, min(sample_id) AS rep FROM hashes GROUP BY 1, 2)
 SELECT least(p, s) AS a, greatest(p, s) AS b, 'temporal' AS kind FROM e WHERE p IS NOT NULL AND gap <= 1800000000
 UNION ALL SELECT a, b, 'visual' FROM near JOIN r ra ON ra.rep = a JOIN r rb ON rb.rep = b
 UNION ALL SELECT rep, sample_id, 'visual' FROM hashes JOIN r USING (phash, dhash) WHERE sample_id <> rep""")
def set1_union_of_edges(spark, d):
    return w1_session_edges(spark, d).withColumn("kind", F.lit("temporal")).unionByName(j6_near_pairs(spark, d).withColumn("kind", F.lit("visual")))


@query("SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def set2_difference(spark, d):
    return T.read(spark, d, "documents").select("doc_id").exceptAll(T.read(spark, d, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set3_intersection(spark, d):
    return T.read(spark, d, "documents").select("doc_id").intersect(T.read(spark, d, "labels").select("doc_id"))


@query("""WITH a AS (SELECT doc_id FROM documents), b AS (SELECT doc_id FROM labels)
 SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_right,
 (SELECT count(*) FROM (SELECT doc_id FROM a GROUP BY 1 HAVING count(*) > 1)) AS duplicates,
 (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) = 0 AND (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) = 0
  AND (SELECT count(*) FROM (SELECT doc_id FROM a GROUP BY 1 HAVING count(*) > 1)) = 0 AS equal""")
def set4_equality_gate(spark, d):
    return C.set_gate(T.read(spark, d, "documents"), T.read(spark, d, "labels"), "doc_id")


@query("""WITH s AS (SELECT p_partkey AS sample_id, p_size, p_retailprice, p_brand = 'Brand#11' AS old FROM part), n AS (SELECT * FROM s WHERE NOT old),
 p AS (SELECT CASE sample_id WHEN 11 THEN 0.0 ELSE 0.5 END AS priority, sample_id FROM n WHERE sample_id IN (7, 11)
 UNION ALL SELECT 1, sample_id FROM (SELECT * FROM n ORDER BY p_size, sample_id LIMIT 1) UNION ALL SELECT 2, sample_id FROM (SELECT * FROM n ORDER BY p_size DESC, sample_id LIMIT 1)
 UNION ALL SELECT 3, sample_id FROM (SELECT * FROM n ORDER BY p_retailprice, sample_id LIMIT 1) UNION ALL SELECT 4, sample_id FROM (SELECT * FROM n ORDER BY p_retailprice DESC, sample_id LIMIT 1)
 UNION ALL SELECT 100, sample_id FROM (SELECT * FROM n ORDER BY sample_id LIMIT 14)),
 g AS (SELECT sample_id, min(priority) AS o FROM p GROUP BY 1 ORDER BY 2, 1 LIMIT 8),
 r AS (SELECT sample_id, row_number() OVER (ORDER BY p_retailprice, sample_id) - 1 AS k, count(*) OVER () AS n FROM s WHERE old),
 l AS (SELECT sample_id, min(1000 + i) AS o FROM r, range(4) x(i) WHERE i < least(4, n) AND k = i * (n - 1) // greatest(least(4, n) - 1, 1) GROUP BY 1)
 SELECT row_number() OVER (ORDER BY o, sample_id)::INT AS position, sample_id, kind AS source_type FROM (SELECT sample_id, o, 'iso_21496_1_tmap' AS kind FROM g UNION ALL SELECT sample_id, o, 'legacy_apple' FROM l)""")
def w2_golden_list(spark, d):
    labels = T.read(spark, d, "part").selectExpr("p_partkey AS sample_id", "p_size", "p_retailprice", "CASE WHEN p_brand = 'Brand#11' THEN 'legacy_apple' ELSE 'iso_21496_1_tmap' END AS source_type")
    return C.golden_list(labels, [11, 7], ["p_size", "p_retailprice"], "p_retailprice")


@query("""WITH s AS (SELECT p_partkey AS sample_id, p_size, p_retailprice FROM part), p AS (SELECT 0 AS priority, sample_id FROM s WHERE sample_id IN (7, 11)
 UNION ALL SELECT 1, sample_id FROM (SELECT * FROM s ORDER BY p_size, sample_id LIMIT 1) UNION ALL SELECT 2, sample_id FROM (SELECT * FROM s ORDER BY p_size DESC, sample_id LIMIT 1)
 UNION ALL SELECT 3, sample_id FROM (SELECT * FROM s ORDER BY p_retailprice, sample_id LIMIT 1) UNION ALL SELECT 4, sample_id FROM (SELECT * FROM s ORDER BY p_retailprice DESC, sample_id LIMIT 1)
 UNION ALL SELECT 100, sample_id FROM (SELECT * FROM s ORDER BY sample_id LIMIT 14))
 SELECT sample_id, min(priority) AS priority FROM p GROUP BY 1 ORDER BY 2, 1 LIMIT 8""")
def w2_golden_samples(spark, d):
    s = T.read(spark, d, "part").selectExpr("p_partkey AS sample_id", "p_size", "p_retailprice")
    return C.golden_samples(s, ["p_size", "p_retailprice"], [7, 11])


@query("""WITH r AS (SELECT o_orderkey AS sample_id, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)
 SELECT sample_id, min(p + 200)::INT AS priority FROM r, (VALUES (0), (1), (2), (3)) x(p) WHERE k = p * (n - 1) // 3 GROUP BY 1""")
def w2_spread_samples(spark, d):
    return C.spread_samples(T.read(spark, d, "orders").withColumnRenamed("o_orderkey", "sample_id"), "o_totalprice")


@query("SELECT doc_id AS sample_id, 'group-' || (doc_id // 5) AS group_id, CASE WHEN (doc_id // 5) % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM documents")
def src3_group_members(spark, d):
    """Groups with member lists, written as a file of groups and read back by the reader of such files."""
    from lumenfold.sources.manifests import read_groups
    from lumenfold.sources.sinks import scratch_folder, taken

    number = F.expr("sample_id DIV 5")
    groups = T.samples(spark, d).groupBy(number.alias("g")).agg(F.array_sort(F.collect_list(F.col("sample_id").cast("string"))).alias("members"))
    groups = groups.select(F.concat(F.lit("group-"), F.col("g").cast("string")).alias("group_id"), F.when(F.col("g") % 2 == 0, "train").otherwise("test").alias("split"), F.size("members").alias("size"), "members")
    path = scratch_folder(spark, "groups")
    groups.select(F.array(F.struct("*")).alias("groups")).write.json(path)
    return taken(read_groups(spark, path, lines=True).select(F.col("sample_id").cast("long").alias("sample_id"), "group_id", "split"), path)


@query("""SELECT doc_id AS sample_id, bit_count(xor(('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT, ('0x' || substr(md5(coalesce(text, '')), 17, 15))::BIGINT))::INT AS distance FROM documents""")
def expr_hamming(spark, d):
    m = F.md5(F.coalesce(F.col("text"), F.lit("")))
    number = lambda at: F.conv(F.substring(m, at, 15), 16, 10).cast("long")
    return T.samples(spark, d).select("sample_id", E.hamming(number(1), number(17)).alias("distance"))
