"""Exact quantiles of groups of any size, by refining histograms.

A pass counts a group's values in BINS equal ranges; the range that holds a wanted rank, cut to the values that it
has, is the next pass's group, until it has one value or at most FEW rows.  Only counts are shuffled; rows of a range
are gathered when they are few.  So a group with a third of all rows is counted by all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.expr import finite
from lumenfold.functions.session import ensure_checkpoint_dir

BINS = 1024
FEW = 4096


def _same(by: Sequence[str], left: str, right: str) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`"))
    return out


def _in_ranges(rows: DataFrame, wanted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with each range (_lo, _hi, _below) of their group that they lie in."""
    ranges = wanted.select(*by, "_lo", "_hi", "_below").distinct()
    if not by:
        ranges = F.broadcast(ranges)  # two for each point at most
    on = _same(by, "r", "w") & F.col("r._v").between(F.col("w._lo"), F.col("w._hi"))
    return rows.alias("r").join(ranges.alias("w"), on).select("r.*", "w._lo", "w._hi", "w._below")


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group; only counts are shuffled."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def gathered_quantile(value: str, p: float) -> Column:
    """Aggregate: the quantile of a group's finite values, linear between ranks; the group must be small, as it is gathered."""
    v = F.col(value).cast("double")
    ordered = F.array_sort(F.collect_list(F.when(finite(v), v)))
    place = F.lit(float(p)) * (F.size(ordered) - 1)
    low, high = F.get(ordered, F.floor(place).cast("int")), F.get(ordered, F.ceil(place).cast("int"))
    return low + (high - low) * (place - F.floor(place))


def quantiles(df: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = (), few: int = FEW, bins: int = BINS) -> DataFrame:
    """(*by, n, v_min, v_max, q: array of the points' quantiles) of the finite values, linear between ranks.

    Null and non-finite values do not count; a group without any has n 0 and nulls.
    """
    ensure_checkpoint_dir(df.sparkSession)
    by = list(by)
    v = F.col(value).cast("double")
    rows = df.select(*by, F.when(finite(v), v).alias("_v"))
    stats = rows.groupBy(*by).agg(F.count("_v").alias("n"), F.min("_v").alias("v_min"), F.max("_v").alias("v_max")).checkpoint()
    rows = rows.filter("_v IS NOT NULL")
    place = [F.struct(F.lit(k).alias("k"), (F.lit(float(p)) * (F.col("n") - 1)).alias("place")) for k, p in enumerate(points)]
    places = stats.filter("n > 0").select(*by, "n", "v_min", "v_max", F.explode(F.array(*place)).alias("p")).select(*by, "n", "v_min", "v_max", "p.*")
    ranks = places.select(*by, "v_min", "v_max", "n", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("_rank")).distinct()
    targets = ranks.select(*by, "_rank", F.col("v_min").alias("_lo"), F.col("v_max").alias("_hi"), F.lit(0).cast("long").alias("_below"), F.col("n").alias("_in"))
    while True:
        targets = targets.checkpoint()
        wide = targets.filter((F.col("_in") > few) & (F.col("_lo") < F.col("_hi")))
        if wide.isEmpty():
            break
        # halves keep the difference of the largest values finite
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        counted = _in_ranges(rows, wide, by).groupBy(*by, "_lo", "_hi", "_below", F.least(F.floor(share * bins), F.lit(bins - 1)).alias("_bin")).agg(
            F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
        )
        upto = Window.partitionBy(*by, "_lo", "_hi", "_below").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("_first", F.col("_below") + F.coalesce(F.sum("_c").over(upto), F.lit(0)))
        on = _same([*by, "_lo", "_hi", "_below"], "t", "c") & (F.col("t._rank") >= F.col("c._first")) & (F.col("t._rank") < F.col("c._first") + F.col("c._c"))
        finer = wide.alias("t").join(counted.alias("c"), on).select(
            *[f"t.`{c}`" for c in by], "t._rank", F.col("c._least").alias("_lo"), F.col("c._most").alias("_hi"), F.col("c._first").alias("_below"), F.col("c._c").alias("_in")
        )
        targets = targets.filter((F.col("_in") <= few) | (F.col("_lo") >= F.col("_hi"))).unionByName(finer)
    alone = targets.filter("_lo = _hi").select(*by, "_rank", F.col("_lo").alias("_v"))
    some = targets.filter("_lo < _hi")
    order = Window.partitionBy(*by, "_lo", "_hi", "_below").orderBy("_v")
    ranked = _in_ranges(rows, some, by).select(*by, "_v", (F.col("_below") + F.row_number().over(order) - 1).alias("_rank"))
    at = alone.unionByName(ranked.alias("r").join(some.alias("t"), _same([*by, "_rank"], "r", "t"), "left_semi").select(*by, "_rank", "_v"))
    low, high = (at.select(*[F.col(c).alias(f"_{c}_") for c in by], F.col("_rank").alias("_r"), F.col("_v").alias(name)) for name in ("_a", "_b"))
    found = places
    for side, step in ((low, F.floor("place")), (high, F.ceil("place"))):
        on = F.col("_r") == step
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"_{c}_"))
        found = found.join(side, on).drop("_r", *[f"_{c}_" for c in by])
    part = F.col("place") - F.floor("place")
    q = F.transform(F.array_sort(F.collect_list(F.struct("k", (F.col("_a") + (F.col("_b") - F.col("_a")) * part).alias("v")))), lambda e: e["v"])
    listed = found.groupBy(*by).agg(q.alias("q"))
    if not by:
        return stats.crossJoin(F.broadcast(listed)) if stats.first()["n"] else stats.withColumn("q", F.lit(None).cast("array<double>"))
    return stats.alias("r").join(listed.alias("w"), _same(by, "r", "w"), "left").select("r.*", "w.q")
