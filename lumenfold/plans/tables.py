"""The given tables seen as corpus, cell, pixel and run tables, in Spark and as DuckDB SQL of the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def split_of(key: str) -> str:
    return f"CASE WHEN {key} % 10 < 7 THEN 'train' WHEN {key} % 10 < 9 THEN 'validation' ELSE 'test' END"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as manifest rows."""
    return read(spark, sf_dir, "documents").selectExpr(
        "doc_id AS sample_id", "source AS model", "lang AS headroom_source", "n_chars AS iso", "text", f"{split_of('doc_id')} AS split"
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as dated captures."""
    return read(spark, sf_dir, "events").selectExpr("event_id AS sample_id", "user_id AS model", "ts AS capture_datetime", "event_type", "value")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8 x 8 grids of stops."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), "label", F.posexplode("embedding").alias("i", "e")
    ).selectExpr("image_id", "label", "i DIV 8 AS gy", "i % 8 AS gx", "abs(cast(e AS double)) * 8 AS v", "cast(e AS double) AS signed")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8 x 8 images in linear light."""
    return cells(spark, sf_dir).selectExpr("image_id", "label", "gy AS y", "gx AS x", "v / 4 AS r", "v / 5 AS g", "v / 8 AS b")


def odd_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings and their label as images of 13 x 5 with names for ids."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.concat("embedding", F.array((F.col("label") / 10).cast("float")))).alias("i", "e"))
    return e.selectExpr("concat('img-', vec_id) AS image_id", "label", "i DIV 13 AS y", "i % 13 AS x", "abs(cast(e AS double)) * 2 AS r", "abs(cast(e AS double)) * 1.5D AS g", "abs(cast(e AS double)) AS b")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").selectExpr("vec_id AS image_id", "label", f"{split_of('label')} AS split")


def eval_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as prediction and target cells."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS sample_id", "l_linenumber AS gx", "0 AS gy", "l_discount * 10 AS prediction", "l_tax * 10 AS target", "l_returnflag AS source"
    )


def file_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem and orders as the file results of archived runs."""
    return read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey")).selectExpr(
        "o_custkey AS run", "l_orderkey * 10 + l_linenumber AS file", "o_orderstatus = 'F' AS success",
        "l_quantity AS decode_ms", "l_extendedprice / 100 AS process_ms", "l_tax * 1000 AS encode_ms",
    )


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as epochs of training runs."""
    return read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).selectExpr(
        "c_mktsegment AS architecture", "o_custkey AS run_dir", "o_orderkey AS epoch", "o_totalprice / 100000 AS mae"
    )


SPLIT = split_of
SQL_SAMPLES = f"samples AS (SELECT doc_id AS sample_id, source AS model, lang AS headroom_source, n_chars AS iso, text, {split_of('doc_id')} AS split FROM documents)"
SQL_CAPTURES = "captures AS (SELECT event_id AS sample_id, user_id AS model, ts AS capture_datetime, event_type, value FROM events)"
SQL_CELLS = """cells AS (SELECT image_id, label, i // 8 AS gy, i % 8 AS gx, abs(CAST(e AS DOUBLE)) * 8 AS v, CAST(e AS DOUBLE) AS signed
  FROM (SELECT vec_id AS image_id, label, unnest(embedding) AS e, unnest(range(64)) AS i FROM embeddings))"""
SQL_PIXELS = SQL_CELLS + ", pixels AS (SELECT image_id, label, gy AS y, gx AS x, v / 4 AS r, v / 5 AS g, v / 8 AS b FROM cells)"
SQL_ODD = """odd AS (SELECT 'img-' || vec_id AS image_id, label, i // 13 AS y, i % 13 AS x, abs(CAST(e AS DOUBLE)) * 2 AS r, abs(CAST(e AS DOUBLE)) * 1.5 AS g, abs(CAST(e AS DOUBLE)) AS b
  FROM (SELECT vec_id, label, unnest(list_append(embedding, CAST(label / 10 AS FLOAT))) AS e, unnest(range(65)) AS i FROM embeddings))"""
SQL_IMAGES = f"images AS (SELECT vec_id AS image_id, label, {split_of('label')} AS split FROM embeddings)"
SQL_EVAL = "ev AS (SELECT l_orderkey AS sample_id, l_linenumber AS gx, 0 AS gy, l_discount * 10 AS prediction, l_tax * 10 AS target, l_returnflag AS source FROM lineitem)"
SQL_FILES = """files AS (SELECT o_custkey AS run, l_orderkey * 10 + l_linenumber AS file, o_orderstatus = 'F' AS success,
  l_quantity AS decode_ms, l_extendedprice / 100 AS process_ms, l_tax * 1000 AS encode_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SQL_EPOCHS = "epochs AS (SELECT c_mktsegment AS architecture, o_custkey AS run_dir, o_orderkey AS epoch, o_totalprice / 100000 AS mae FROM orders JOIN customer ON o_custkey = c_custkey)"


def sql_band(v: str) -> str:
    return f"CASE WHEN {v} IS NULL OR isnan({v}) OR isinf({v}) THEN 'missing' WHEN {v} < 1 THEN '0-1' WHEN {v} < 2 THEN '1-2' WHEN {v} < 3 THEN '2-3' ELSE '3+' END"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, without a negative zero."""
    return df.select(*[(F.round(f"`{c}`", digits) + F.lit(0.0)).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in df.dtypes])
