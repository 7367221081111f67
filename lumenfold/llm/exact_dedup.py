"""Exact deduplication by progressive refinement: length, then head hash, then full hash.

Only DataFrame functions run here.  Each step looks at less of fewer rows: lengths come from the column's
byte counts, the head hash reads the first characters of texts whose length occurs twice, and the full hash
decides among texts that still agree.  Every step is a counted aggregate, so Spark combines it before the
shuffle and a group of copies arrives as one row per task however large it is.

Defined cases: a null text equals the empty text; texts compare after lower-casing A-Z only; the largest
doc_id of a group stays; rows repeated with one doc_id are marked alike; a row without doc_id stays only if
no row of its group has one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, id_and_text

HEAD_CHARS = 64
#: Blocks of the map of repeated (length, head) pairs, and the bits of a block: 8 MB at most.
MAP_BLOCKS, MAP_BITS = 2048, 32768


def copy_keys(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, head, text_sha256) of every row: what the refinement compares, and the published hash."""
    base = id_and_text(df, id_col, text_col)
    return base.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.xxhash64(ascii_lower(F.substring("text", 1, HEAD_CHARS))).alias("head"),
        F.sha2(ascii_lower(F.col("text")), 256).alias("text_sha256"),
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = copy_keys(df, id_col, text_col)
    groups = _groups_from_keys(keys)
    return keys.join(groups, ["n_bytes", "head", "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True))
        .otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .alias("kept"),
        "text_sha256",
    )


def _groups_from_keys(keys: DataFrame) -> DataFrame:
    """The refinement over keys that a caller needs for every row anyway."""
    by_length = keys.groupBy("n_bytes").agg(F.count("*").alias("n")).filter("n > 1").select("n_bytes")
    by_head = (
        keys.join(by_length, "n_bytes", "left_semi")
        .groupBy("n_bytes", "head")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select("n_bytes", "head")
    )
    return (
        keys.join(by_head, ["n_bytes", "head"], "left_semi")
        .groupBy("n_bytes", "head", "text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", map_blocks: int = MAP_BLOCKS) -> DataFrame:
    """The input's columns and rows without the copies.

    Lengths and heads are counted first.  The (length, head) pairs that occur twice set bits in a map of at most
    map_blocks x 4 kB, the only broadcast.  Rows whose bit is not set pass through unread beyond their head and are
    not shuffled; the full text is hashed only where it is set.  Copies are found among keys alone, and texts move
    once: those of rows with the bit set, by document, to leave out the copies.
    """
    names = {c: free_name(df, f"copy_{c}") for c in ("n", "head", "bit", "sha", "id")}
    n, head, bit, sha, row_id = (names[c] for c in ("n", "head", "bit", "sha", "id"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = df.withColumns(
        {
            n: F.octet_length(text).cast("long"),
            head: F.xxhash64(ascii_lower(F.substring(text, 1, HEAD_CHARS))),
            row_id: F.col(f"`{id_col}`").cast("long"),
        }
    ).withColumn(bit, F.pmod(F.xxhash64(n, head), F.lit(map_blocks * MAP_BITS)))
    pairs = keyed.select(F.col(n).alias("n"), F.col(head).alias("head"), F.col(bit).alias("bit"))
    by_length = pairs.groupBy("n").agg(F.count("*").alias("rows")).filter("rows > 1").select("n")
    by_head = pairs.join(by_length, "n", "left_semi").groupBy("n", "head", "bit").agg(F.count("*").alias("rows")).filter("rows > 1")
    block, place = free_name(df, "copy_block"), free_name(df, "copy_map")
    bits = by_head.groupBy(F.bitmap_bucket_number("bit").alias(block)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias(place))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col(place), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast(bitmap_bit_position(`{bit}`) % 8 AS int))")) != 0, F.lit(False))
    met = keyed.join(F.broadcast(bits), F.bitmap_bucket_number(bit) == F.col(block), "left").withColumn(bit, is_set).drop(block, place)
    alone = met.filter(~F.col(bit))
    several = met.filter(F.col(bit)).withColumn(sha, F.sha2(ascii_lower(text), 256))
    groups = (
        several.groupBy(n, head, sha).agg(F.max(row_id).alias("keep"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    )
    gone = (
        several.select(n, head, sha, row_id).join(groups, [n, head, sha]).filter(~F.col(row_id).eqNullSafe(F.col("keep")))
        .select(*[F.col(c).alias(f"{c}_") for c in (n, head, sha, row_id)]).distinct()
    )
    same = [F.col(c) == F.col(f"{c}_") for c in (n, head, sha)]
    kept = several.join(gone, [*same, F.col(row_id).eqNullSafe(F.col(f"{row_id}_"))], "left_anti")
    columns = [F.col(f"`{c}`") for c in df.columns]
    return alone.select(*columns).unionByName(kept.select(*columns))
