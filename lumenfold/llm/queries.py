"""The registered queries of this folder, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bestfit_packing, cost_packing, exact_dedup, jaccard_join, langid, prefix_trie, quality, sentencepiece_lattice, spelling_variants, substring_dedup, suffix_dedup, telephony, toxicity
from .common import documents, labels


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_packing.best_fit_packing(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.encoding_digest(sentencepiece_lattice.encode(documents(spark, sf_dir)))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.media_digest(telephony.decoded_pcm(telephony.media_columns(documents(spark, sf_dir))))


def op11_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_packing.pack_by_cost(documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(documents(spark, sf_dir), slip=97)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_head_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_jaccard_join, op3_exact_dedup, op4_toxicity, op5_bestfit_packing, op6_quality, op7_language_id, op8_substring_dedup, op9_sentencepiece, op10_media_columns, op11_cost_packing, op12_spelling_variants, op13_prefix_trie)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY norm)
    """,
    "op13_prefix_trie": """
        WITH turns AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT c, length(text) AS points, md5(length(role) || ':' || role || text) AS mark,
                       row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i FROM turns),
        ids AS (SELECT DISTINCT c FROM own),
        heads AS (SELECT c, c - c % 100 AS base,
                         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                             lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda a, k: xor(a >> 1, 3988292384 * (a & 1))))) % 6 AS h FROM ids),
        sizes AS (SELECT c AS base, count(*) AS size FROM own GROUP BY c),
        rebuilt AS (SELECT heads.c, own.i, mark, points FROM heads JOIN own ON own.c = base AND own.i <= h
                    UNION ALL
                    SELECT own.c, i - h + least(h, coalesce(size, 0)), mark, points
                    FROM own JOIN heads ON own.c = heads.c LEFT JOIN sizes ON sizes.base = heads.base WHERE i > h),
        paths AS (SELECT c, i, list(mark) OVER (PARTITION BY c ORDER BY i) AS key, points FROM rebuilt
                  UNION ALL SELECT c, 0, [], 0 FROM ids),
        nodes AS (SELECT key, len(key) AS depth, count(*) AS n_convs, min(c) AS owner, min(points) AS points,
                         CASE WHEN len(key) > 0 THEN key[1:len(key) - 1] END AS parent FROM paths GROUP BY key),
        kids AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
        own_part AS (SELECT nodes.key, depth, (n_convs - 1) * points AS saved, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS leaf
                     FROM nodes LEFT JOIN kids ON kids.key = nodes.key),
        above AS (SELECT key[1:k] AS key, saved, leaf FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM own_part)),
        sums AS (SELECT key, sum(saved) AS saved, sum(leaf) AS leaves FROM above GROUP BY key),
        last AS (SELECT c, max(i) AS depth FROM paths GROUP BY c),
        ends AS (SELECT key, sha256(string_agg(paths.c::VARCHAR, ',' ORDER BY paths.c)) AS sha FROM paths JOIN last ON last.c = paths.c AND last.depth = paths.i GROUP BY key)
        SELECT nodes.owner AS conv_id, nodes.depth::BIGINT AS depth, up.owner AS parent_conv_id, nodes.n_convs, coalesce(kids.n, 0) AS n_children,
               sums.leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens, coalesce(ends.sha, sha256('')) AS ends_sha256
        FROM nodes JOIN sums ON sums.key = nodes.key LEFT JOIN kids ON kids.key = nodes.key LEFT JOIN ends ON ends.key = nodes.key
        LEFT JOIN nodes AS up ON up.key = nodes.parent
    """,
}
