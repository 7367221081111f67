"""Pieces that several operators share: id and text selection, shard keys, sizes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word class of the contracts: runs of anything but space and \t \n \v \f \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, whatever else the input has; a null text becomes the empty text."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds; null ids count as fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds, F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def text_bytes(df: DataFrame) -> int:
    """UTF-8 bytes of all texts: one scan, one row."""
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shards_for(total_bytes: int, shard_bytes: int) -> int:
    return max(1, math.ceil(total_bytes / shard_bytes))


def shard_of(id_col: Column, shards: int) -> Column:
    """Documents meet shards by a hash of their id, so no key of the data can make one large."""
    return F.pmod(F.xxhash64(id_col, F.lit(17)), F.lit(shards)).cast("int")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts_of(b: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes each, a row at least."""
    total, at = np.cumsum(sizes), 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        yield b.slice(at, to - at)
        at = to
