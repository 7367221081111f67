"""Metric operators bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import metrics as M
from lumenfold.operators.labels import NOTE_SOURCE, XMP_SOURCE

from . import tables as T
from .register import Register

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query(f"""WITH {T.SQL_CELLS} SELECT image_id, round(min(v), 6) AS v_min, round(avg(v), 6) AS v_mean, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(max(v), 6) AS v_max
 FROM cells GROUP BY 1""")
def ag10_grid_stats(spark, d):
    return T.rounded(M.grid_stats(T.cells(spark, d)))


_DECLARED = "CASE WHEN vec_id % 5 = 1 THEN 1.5 WHEN vec_id % 5 > 1 THEN (vec_id % 9) * 0.5 END"
_SOURCE = f"CASE WHEN label % 3 = 0 THEN '{XMP_SOURCE}' ELSE '{NOTE_SOURCE}' END"


@query(f"""WITH {T.SQL_CELLS}, i AS (SELECT vec_id AS image_id, {T.split_of('label')} AS split, {_SOURCE} AS source, {_DECLARED} AS own FROM embeddings),
 m AS (SELECT image_id, mode, CASE mode WHEN 'per_image' THEN own ELSE 3.0 END AS scale, split, source, own FROM i, (VALUES ('fixed_3stops'), ('per_image')) x(mode) WHERE mode = 'fixed_3stops' OR own > 0),
 p AS (SELECT m.image_id, m.mode, any_value(split) AS split, any_value(source) AS source, any_value(own) AS own, count(v) AS n, count(*) FILTER (v / scale > 1) AS hit, sum(least(greatest(v / scale, 0), 1)) AS t
   FROM m LEFT JOIN cells USING (image_id) GROUP BY 1, 2),
 s AS (SELECT 'all' AS subset, * FROM p UNION ALL SELECT 'xmp', * FROM p WHERE source = '{XMP_SOURCE}')
 SELECT subset, mode, split, count(*) AS samples, CAST(sum(n) AS BIGINT) AS pixels, round(sum(t) / sum(n), 6) AS target_mean, count(*) FILTER (hit > 0) AS saturated_samples,
 round(count(*) FILTER (hit > 0) / count(*), 6) AS saturated_sample_fraction, count(*) FILTER (own > 3) AS above_3_stops, round(count(*) FILTER (own > 3) / count(*), 6) AS above_3_stops_fraction,
 CAST(sum(hit) AS BIGINT) AS saturated_pixels, round(sum(hit) / sum(n), 6) AS saturated_pixel_fraction FROM s GROUP BY 1, 2, 3""")
def ag11_target_saturation(spark, d):
    images = T.read(spark, d, "embeddings").selectExpr(
        "vec_id AS image_id", f"{T.split_of('label')} AS split", f"{_SOURCE} AS headroom_source", f"cast({_DECLARED} AS double) AS max_log2_gain"
    )
    return T.rounded(M.target_saturation(T.cells(spark, d), images))


@query(f"""WITH {T.SQL_EVAL}, t AS (SELECT avg(target) AS m FROM ev WHERE sample_id % 10 < 7),
 p AS (SELECT sample_id, count(*) AS n, sum(abs(prediction - target)) AS e, sum(abs(target)) AS z, sum(abs(0.5 - target)) AS h, sum(abs(m - target)) AS c FROM (SELECT a.sample_id, a.prediction, b.target FROM ev a JOIN ev b USING (sample_id, gy, gx)), t WHERE sample_id % 10 >= 7 GROUP BY 1)
 SELECT CAST(sum(n) AS BIGINT) AS cells, round(sum(e) / sum(n), 6) AS mae, round(sum(z) / sum(n), 6) AS mae_zero, round(sum(h) / sum(n), 6) AS mae_half, round(sum(c) / sum(n), 6) AS mae_mean,
 round(avg(e / n), 6) AS sample_mae, round(min(e / n), 6) AS sample_min, round(max(e / n), 6) AS sample_max,
 round((sum(c) - sum(e)) / sum(c), 6) AS improvement FROM p""")
def ag12_j7_baseline_mae(spark, d):
    ev = T.eval_cells(spark, d)
    # prediction and target come from two tables; the join is on the cell
    predicted = ev.filter("sample_id % 10 >= 7").select("sample_id", "gy", "gx", "prediction")
    target = ev.select("sample_id", "gy", "gx", "target")
    return T.rounded(M.baseline_mae(predicted.join(target, ["sample_id", "gy", "gx"]), target.filter("sample_id % 10 < 7").agg(F.avg("target").alias("train_mean"))))


_SQL_ONE_SOURCE = """(SELECT l_orderkey AS sample_id, l_linenumber AS gx, 0 AS gy, l_discount * 10 AS prediction, l_tax * 10 AS target, CASE o_orderstatus WHEN 'F' THEN 'xmp' ELSE 'legacy' END AS source FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_STOPS = "st AS (SELECT sample_id, prediction * 4 AS prediction, target * 4 AS target, source, abs(prediction - target) * 4 AS e FROM ev)"


def _one_source(spark, d):
    """lineitem as evaluated cells, each sample of the source that its order's status gives."""
    orders = T.read(spark, d, "orders").selectExpr("o_orderkey AS sample_id", "CASE o_orderstatus WHEN 'F' THEN 'xmp' ELSE 'legacy' END AS source")
    return T.eval_cells(spark, d).drop("source").join(orders, "sample_id")


@query(f"""WITH ev AS {_SQL_ONE_SOURCE}, {_STOPS}, p AS (SELECT sample_id, source, abs(avg(prediction) - avg(target)) AS m FROM st GROUP BY 1, 2),
 q AS (SELECT sample_id, abs(quantile_cont(prediction, 0.95) - quantile_cont(target, 0.95)) AS h FROM st GROUP BY 1),
 c AS (SELECT 'all' AS bucket, e FROM st UNION ALL SELECT source, e FROM st
  UNION ALL SELECT CASE WHEN target < 1 THEN 'low_0_to_1_stop' WHEN target < 2 THEN 'hdr_1_to_2_stops' ELSE 'hdr_2_to_3_stops' END, e FROM st),
 i AS (SELECT bucket, count(*) AS samples, round(avg(m), 6) AS image_mean_mae, round(avg(h), 6) AS image_p95_mae
  FROM (SELECT 'all' AS bucket, m, h FROM p JOIN q USING (sample_id) UNION ALL SELECT source, m, h FROM p JOIN q USING (sample_id)) GROUP BY 1)
 SELECT bucket, count(*) AS pixels, round(avg(e), 6) AS pixel_mae, samples, image_mean_mae, image_p95_mae FROM c LEFT JOIN i USING (bucket) GROUP BY ALL""")
def ag13_bucketed_errors(spark, d):
    # a sample has one source, its order's status; predictions and targets in stops
    stops = _one_source(spark, d).selectExpr("sample_id", "source", "prediction * 4 AS prediction", "target * 4 AS target")
    return T.rounded(M.bucketed_errors(stops))


@query(f"""WITH {T.SQL_EVAL}, t AS (SELECT avg(target) AS m FROM ev WHERE sample_id % 10 < 7)
 SELECT round(avg(abs(prediction - target)), 6) AS mae, round(avg(abs(m - target)), 6) AS constant_mae, round((avg(abs(m - target)) - avg(abs(prediction - target))) / avg(abs(m - target)), 6) AS improvement FROM ev, t""")
def ag13_constant_baseline(spark, d):
    ev = T.eval_cells(spark, d)
    return T.rounded(M.constant_baseline(ev, ev.filter("sample_id % 10 < 7").agg(F.avg("target").alias("train_mean"))))


_SQL_LOSS = "ev AS (SELECT image_id AS sample_id, gy, gx, v / 3 AS prediction, greatest(v * 0.3 - gx * 0.04, 0) AS target FROM cells)"


@query(f"""WITH {T.SQL_CELLS}, {_SQL_LOSS}, s AS (SELECT *, abs(prediction - target) AS d, 1 + 2.5 * target * target AS w FROM ev),
 p AS (SELECT sample_id, sum(CASE WHEN d < 0.05 THEN d * d / 0.1 ELSE d - 0.025 END * w) / sum(w) AS r, abs(avg(prediction) - avg(target)) AS g, avg(d) AS m,
  avg(CASE WHEN target >= 1.0 / 3 THEN d END) AS h, avg(CASE WHEN target <= 1e-6 THEN CASE WHEN prediction >= 1.0 / 3 THEN 1.0 ELSE 0.0 END END) AS f FROM s GROUP BY 1),
 x AS (SELECT a.sample_id, avg(abs((b.prediction - a.prediction) - (b.target - a.target))) AS e FROM ev a JOIN ev b ON a.sample_id = b.sample_id AND b.gy = a.gy AND b.gx = a.gx + 1 GROUP BY 1),
 y AS (SELECT a.sample_id, avg(abs((b.prediction - a.prediction) - (b.target - a.target))) AS e FROM ev a JOIN ev b ON a.sample_id = b.sample_id AND b.gx = a.gx AND b.gy = a.gy + 1 GROUP BY 1),
 t AS (SELECT count(*) AS images, avg(r) AS r, avg((x.e + y.e) / 2) AS e, avg(g) AS g, avg(m) AS m, coalesce(avg(h), 0) * 3 AS h, coalesce(avg(f), 0) AS f, count(h) AS nh, count(f) AS nf
  FROM p JOIN x USING (sample_id) JOIN y USING (sample_id))
 SELECT images, round(r, 6) AS reconstruction, round(e, 6) AS gradient, round(g, 6) AS global_mean, round(m, 6) AS mae, round(h, 6) AS highlight_mae, round(f, 6) AS false_high_rate,
 nh AS highlight_images, nf AS zero_target_images, round(r + 0.2 * e + 0.1 * g, 6) AS loss FROM t""")
def ag14_loss_parts(spark, d):
    cells = T.cells(spark, d).selectExpr("image_id AS sample_id", "gy", "gx", "v / 3 AS prediction", "greatest(v * 0.3D - gx * 0.04D, 0.0D) AS target")
    return T.rounded(M.loss_parts(cells, highlight_weight=2.5))


@query(f"""WITH {T.SQL_FILES} SELECT run % 50 AS epoch, round(sum(decode_ms * 1) / count(*), 6) AS decode_ms, round(sum(process_ms * decode_ms) / sum(decode_ms), 6) AS process_ms FROM files GROUP BY 1""")
def ag15_epoch_metrics(spark, d):
    rows = T.file_results(spark, d).selectExpr("run % 50 AS epoch", "decode_ms", "process_ms", "decode_ms AS weight", "1.0D AS one")
    return T.rounded(M.weighted_metrics(rows, {"decode_ms": "one", "process_ms": "weight"}, "epoch"))


@query(f"""WITH {T.SQL_FILES}, r AS (SELECT run % 20 AS g, decode_ms AS x, process_ms AS y, row_number() OVER (PARTITION BY run % 20 ORDER BY decode_ms, file, process_ms) AS rx, row_number() OVER (PARTITION BY run % 20 ORDER BY process_ms, file, decode_ms) AS ry FROM files)
 SELECT g, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1""")
def ag16_w3_correlations(spark, d):
    rows = T.file_results(spark, d).selectExpr("run % 20 AS g", "struct(file, decode_ms, process_ms) AS place", "decode_ms AS x", "process_ms AS y")
    return T.rounded(M.correlations(rows, "x", "y", "place", ["g"]))


@query(f"""WITH {T.SQL_EVAL}, b AS (SELECT source, min(target) AS a0, quantile_cont(target, 0.25) AS a1, quantile_cont(target, 0.5) AS a2, quantile_cont(target, 0.75) AS a3, max(target) AS a4 FROM ev GROUP BY 1),
 r AS (SELECT source, CASE WHEN target < a1 THEN 0 WHEN target < a2 THEN 1 WHEN target < a3 THEN 2 ELSE 3 END AS bucket, count(*) AS n, round(avg(prediction - target), 6) AS mean_residual,
  round(avg(abs(prediction - target)), 6) AS mean_abs_residual FROM ev JOIN b USING (source) GROUP BY 1, 2),
 e AS (SELECT source, bucket, round([a0, a1, a2, a3, a4][bucket + 1], 6) AS low, round([a0, a1, a2, a3, a4][bucket + 2], 6) AS high FROM b, (VALUES (0), (1), (2), (3)) x(bucket))
 SELECT source, bucket, low, high, coalesce(n, 0) AS n, mean_residual, mean_abs_residual FROM e LEFT JOIN r USING (source, bucket)""")
def ag17_quartile_residuals(spark, d):
    return T.rounded(M.quartile_residuals(T.eval_cells(spark, d), "target", F.col("prediction") - F.col("target"), ["source"]))


@query(f"""WITH {T.SQL_EPOCHS}, b AS (SELECT architecture, run_dir, min(mae) AS m FROM epochs GROUP BY 1, 2)
 SELECT architecture, count(*) AS runs, round(avg(m), 6) AS mean_mae, round(coalesce(stddev_samp(m), 0), 6) AS std_mae, round(min(m), 6) AS best_mae FROM b GROUP BY 1""")
def ag18_architecture_summary(spark, d):
    return T.rounded(M.architecture_summary(T.epochs(spark, d)))


@query(f"""WITH {T.SQL_EPOCHS}, r AS (SELECT *, row_number() OVER (PARTITION BY architecture, run_dir ORDER BY mae, epoch) AS k FROM epochs)
 SELECT architecture, run_dir, epoch AS best_epoch, round(mae, 9) AS best_mae FROM r WHERE k = 1""")
def s3_best_epochs(spark, d):
    return T.rounded(M.best_epochs(T.epochs(spark, d)), 9)


@query(f"""WITH {T.SQL_CELLS}, m AS (SELECT vec_id AS image_id, label * 0.02 AS lo, 1.0 + vec_id % 3 - label * 0.02 AS span, 0.5 + vec_id % 4 * 0.25 AS gamma FROM embeddings),
 r AS (SELECT image_id, max(abs(lo + span * pow(round_even(pow(least(greatest((v - lo) / span, 0), 1), gamma) * 255, 0) / 255, 1 / gamma) - v)) AS e, max(span) / 510 + 2e-5 AS allowed FROM cells JOIN m USING (image_id) GROUP BY 1)
 SELECT image_id, round(e, 6) AS max_error, round(allowed, 6) AS allowed, e <= allowed + 1e-7 AS ok FROM r""")
def ag30_round_trip_error(spark, d):
    metadata = T.read(spark, d, "embeddings").selectExpr("vec_id AS image_id", "label * 0.02D AS gain_min", "1.0D + vec_id % 3 AS gain_max", "0.5D + vec_id % 4 * 0.25D AS gamma")
    return T.rounded(M.round_trip_error(T.cells(spark, d), metadata))


@query(f"""WITH {T.SQL_FILES}, l AS (SELECT 'decode_ms' AS metric, decode_ms AS x FROM files WHERE success UNION ALL SELECT 'process_ms', process_ms FROM files WHERE success UNION ALL SELECT 'encode_ms', encode_ms FROM files WHERE success),
 r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY metric) AS c FROM l)
 SELECT metric, count(*) AS n, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, round(avg(x), 6) AS x_mean, round(max(CASE WHEN k = CAST(floor(0.5 * (c - 1)) AS BIGINT) THEN x END), 6) AS p50,
 round(max(CASE WHEN k = CAST(floor(0.95 * (c - 1)) AS BIGINT) THEN x END), 6) AS p95 FROM r GROUP BY 1""")
def ag32_report_summary(spark, d):
    return T.rounded(M.report_summary(T.file_results(spark, d), ["decode_ms", "process_ms", "encode_ms"]))


@query(f"""WITH {T.SQL_FILES}, f AS (SELECT *, decode_ms + process_ms + encode_ms AS total_ms, decode_ms / 10 AS rendered_peak, process_ms / 50 AS headroom_stops, encode_ms / 100 AS wide_gamut_fraction, decode_ms / 25 AS gain_max_stops FROM files),
 c AS (SELECT count(*) FILTER (success) AS files_ok, count(*) FILTER (NOT success) AS files_err FROM f),
 l AS (UNPIVOT (SELECT decode_ms, process_ms, encode_ms, total_ms, headroom_stops, rendered_peak, wide_gamut_fraction, gain_max_stops FROM f WHERE success) ON COLUMNS(*) INTO NAME metric VALUE x),
 r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY metric) AS n FROM l)
 SELECT metric, any_value(n) AS n, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, round(avg(x), 6) AS x_mean, round(max(CASE WHEN k = CAST(floor(0.5 * (n - 1)) AS BIGINT) THEN x END), 6) AS p50,
 round(max(CASE WHEN k = CAST(floor(0.95 * (n - 1)) AS BIGINT) THEN x END), 6) AS p95, any_value(files_ok) AS files_ok, any_value(files_err) AS files_err FROM r, c GROUP BY 1""")
def ag32_run_summary(spark, d):
    """Counts and all eight metrics of run reports, as read_reports() gives their files."""
    files = T.file_results(spark, d).selectExpr(
        "success", "decode_ms", "process_ms", "encode_ms", "decode_ms + process_ms + encode_ms AS total_ms",
        "named_struct('headroom_stops', process_ms / 50, 'rendered_peak', decode_ms / 10, 'wide_gamut_fraction', encode_ms / 100) AS render", "named_struct('max_stops', decode_ms / 25) AS gain_map",
    )
    counts, summary = M.run_summary(files)
    return T.rounded(summary.crossJoin(F.broadcast(counts)))


@query(f"""WITH {T.SQL_FILES}, a AS (SELECT avg(decode_ms + process_ms + encode_ms) AS before FROM files WHERE success AND run % 2 = 0), b AS (SELECT avg(decode_ms + process_ms + encode_ms) AS after FROM files WHERE success AND run % 2 = 1)
 SELECT round(before, 6) AS before, round(after, 6) AS after, round(before / after, 6) AS speedup FROM a, b""")
def j15_compare_reports(spark, d):
    files = T.file_results(spark, d)
    return T.rounded(M.compare_reports(files.filter("run % 2 = 0"), files.filter("run % 2 = 1")))


@query(f"""WITH {T.SQL_EVAL}, i AS (SELECT sample_id, avg(abs(prediction - target)) AS mae FROM ev GROUP BY 1), g AS (SELECT o_custkey, avg(mae) AS mae FROM i JOIN orders ON o_orderkey = sample_id GROUP BY 1)
 SELECT count(*) AS groups, round(avg(mae), 6) AS mae FROM g""")
def ag36_group_weighted_mae(spark, d):
    groups = T.read(spark, d, "orders").selectExpr("o_orderkey AS sample_id", "o_custkey AS group_id")
    return T.rounded(M.group_weighted_mae(T.eval_cells(spark, d), groups))


@query(f"""WITH {T.SQL_EVAL}, g AS (SELECT sample_id, min(prediction) AS lo, max(prediction) AS hi FROM ev GROUP BY 1)
 SELECT sample_id, CAST(floor(lo * 1000000) AS BIGINT) AS low_numerator, greatest(CAST(ceil(hi * 1000000) AS BIGINT), CAST(floor(lo * 1000000) AS BIGINT) + 1) AS high_numerator, 1000000 AS denominator,
 CASE WHEN abs(lo) > 64 OR abs(hi) > 64 THEN 'range' WHEN hi < 0 THEN 'negative' END AS refused FROM g""")
def ag38_prediction_interval(spark, d):
    return M.prediction_interval(T.eval_cells(spark, d))


_PAIRS = "pc AS (SELECT image_id, gy, gx, v AS prediction, v * 0.9 + gx * gx * 0.01 AS target FROM cells WHERE (image_id + gy + gx) % 9 <> 0)"


@query(f"""WITH {T.SQL_CELLS}, {_PAIRS}, h AS (SELECT a.image_id, avg(abs((b.prediction - a.prediction) - (b.target - a.target))) AS e FROM pc a JOIN pc b ON a.image_id = b.image_id AND a.gy = b.gy AND b.gx = a.gx + 1 GROUP BY 1),
 w AS (SELECT a.image_id, avg(abs((b.prediction - a.prediction) - (b.target - a.target))) AS e FROM pc a JOIN pc b ON a.image_id = b.image_id AND a.gx = b.gx AND b.gy = a.gy + 1 GROUP BY 1)
 SELECT image_id, round(h.e, 6) AS horizontal, round(w.e, 6) AS vertical FROM h JOIN w USING (image_id)""")
def w7_gradient_errors(spark, d):
    pairs = T.cells(spark, d).filter("(image_id + gy + gx) % 9 <> 0").selectExpr("image_id", "gy", "gx", "v AS prediction", "v * 0.9 + gx * gx * 0.01 AS target")
    return T.rounded(M.gradient_errors(pairs))
