"""Ranks, running totals and neighbours over a whole order, without one task per group.

Rows are dealt by ranges of (group, order), so a group of any size spreads over many tasks.  Inside a range the
number is a window's; what the ranges before hold comes from one row for each range and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.session import ensure_checkpoint_dir


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with `_range`, the number of the range that they lie in.  Kept in a checkpoint: ranges follow from a sample of the rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()).checkpoint()


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Adds the sum of value over the group's rows up to each row, itself included; rows come from ranged()."""
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("_range", *by).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1) if by else None
    if before is None:
        # one row for each range: as many as there are shuffle partitions
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    joined = rows.withColumn("_inside", F.sum(value).over(inside)).alias("r").join(
        offsets.alias("o"), (F.col("r._range") == F.col("o._range")) & _same(by), "inner"
    )
    return joined.select("r.*", (F.col("r._inside") + F.col("o._before")).alias(out)).drop("_inside")


def _same(by: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"r.`{c}`").eqNullSafe(F.col(f"o.`{c}`"))
    return out


def with_rank(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "rank") -> DataFrame:
    """Adds each row's place in its group from 1 on; order must tell all rows of a group apart."""
    return running(ranged(df, by, order), by, order, F.lit(1), out).drop("_range")


def with_previous(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], out: str = "previous") -> DataFrame:
    """Adds a struct of the columns of the row before in the group, null for its first row; keeps `_range`."""
    rows = ranged(df, by, order)
    row = F.struct(*columns)
    inside = Window.partitionBy("_range", *by).orderBy(*order)
    last = rows.groupBy("_range", *by).agg(F.max_by(row, F.struct(*order)).alias("_last"))
    before = Window.partitionBy(*by).orderBy("_range") if by else Window.orderBy("_range")
    border = last.withColumn("_border", F.lag("_last").over(before)).drop("_last")
    joined = rows.withColumn("_lag", F.lag(row).over(inside)).alias("r").join(
        border.alias("o"), (F.col("r._range") == F.col("o._range")) & _same(by), "inner"
    )
    return joined.select("r.*", F.coalesce("r._lag", "o._border").alias(out)).drop("_lag")
