"""Read-only audit of a corpus: profiles, bands, counters, reconciliations, findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.expr import finite, safe_rate

from .labels import NOTE_SOURCE, XMP_SOURCE
from .ranking import ranged, running
from .selection import quantiles

#: (label, least value, first value above); null bounds are open.
STOP_BANDS = (("0-1", None, 1.0), ("1-2", 1.0, 2.0), ("2-3", 2.0, 3.0), ("3+", 3.0, None))
PROFILE_POINTS = (0.1, 0.25, 0.5, 0.75, 0.9)


def profile(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, min, five quantiles and max of the finite values, linear between ranks."""
    names = ("p10", "p25", "median", "p75", "p90")
    out = quantiles(df, value, PROFILE_POINTS, by)
    return out.select(*by, "n", "v_min", *[F.col("q")[k].alias(n) for k, n in enumerate(names)], "v_max")


def floor_rank(df: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The value at rank floor(p * (n - 1)) for each p: one row per group and point, from distinct values' counts.

    Values are counted first, so a group costs its distinct values and no group is gathered.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    if by:
        w = Window.partitionBy(*by)
        ranked = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    else:
        # one group is the whole table: its distinct values are dealt by ranges
        rows = ranged(counts, [], [value])
        ranked = running(rows, [], [value], F.col("_c"), "_upto").crossJoin(F.broadcast(rows.agg(F.sum("_c").alias("_n"))))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("p")
    hit = ranked.select(*by, value, "_upto", "_c", "_n", wanted)
    rank = F.floor(F.col("p") * (F.col("_n") - 1))
    return hit.filter((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c"))).select(*by, "p", F.col(value).alias("v"))


def band_label(v: Column, bands=STOP_BANDS) -> Column:
    """Half-open band of a value, `missing` if it is not finite, `out_of_range` if no band has it."""
    label = F.when(~finite(v), "missing")
    for name, low, high in bands:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (v >= low)
        if high is not None:
            inside = inside & (v < high)
        label = label.when(inside, name)
    return label.otherwise("out_of_range")


def band_counts(df: DataFrame, value: str, bands=STOP_BANDS) -> DataFrame:
    """(band, n): every band even if empty, and missing or out_of_range only if some value is."""
    spark = df.sparkSession
    have = df.groupBy(band_label(F.col(value).cast("double"), bands).alias("band")).agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(name,) for name, _, _ in bands], "band string")
    return every.join(have, "band", "full_outer").select("band", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def stop_band_coverage(cells: DataFrame, images: DataFrame, bands=STOP_BANDS) -> DataFrame:
    """By split and band: cells, their share, images with any such cell, their share; and images without a grid.

    cells(image_id, v); images(image_id, split).  Cells are counted within their image first.
    """
    per_image = (
        cells.groupBy("image_id").pivot("band", [b[0] for b in bands]).agg(F.count(F.lit(1)))
        if "band" in cells.columns
        else cells.withColumn("band", band_label(F.col("v"), bands)).groupBy("image_id").pivot("band", [b[0] for b in bands]).agg(F.count(F.lit(1)))
    )
    joined = images.join(per_image.withColumn("_grid", F.lit(True)), "image_id", "left")
    stacked = joined.select(
        "split", "_grid",
        F.explode(F.array(*[F.struct(F.lit(b[0]).alias("band"), F.coalesce(F.col(f"`{b[0]}`"), F.lit(0)).alias("n")) for b in bands])).alias("e"),
    )
    totals = stacked.groupBy("split", F.col("e.band").alias("band")).agg(
        F.sum("e.n").alias("cells"),
        F.count_if(F.col("e.n") > 0).alias("images_with"),
        F.count("*").alias("images"),
        F.count_if(F.col("_grid").isNull()).alias("missing_grids"),
    )
    w = Window.partitionBy("split")
    return totals.select(
        "split", "band", "cells",
        F.round(safe_rate(F.col("cells"), F.sum("cells").over(w)), 6).alias("cell_fraction"),
        "images_with",
        F.round(safe_rate(F.col("images_with"), F.col("images")), 6).alias("image_fraction"),
        "missing_grids",
    )


def category_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def distinct_groups(df: DataFrame, group: str, condition: Column, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count_distinct(group).alias("groups"), F.count_distinct(F.when(condition, F.col(group))).alias("groups_where"))


def duplicate_files(df: DataFrame, digest: str) -> DataFrame:
    """Rows beyond the first of each digest, summed."""
    return df.filter(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count_if(F.col("n") > 1).alias("repeated_digests")
    )


def group_sizes(members: DataFrame, group: str) -> DataFrame:
    sizes = members.groupBy(group).agg(F.count("*").alias("size"))
    counts = sizes.agg(
        F.count("*").alias("groups"), F.count_if(F.col("size") == 1).alias("singletons"), F.count_if(F.col("size") > 1).alias("multi"),
        F.coalesce(F.sum(F.when(F.col("size") > 1, F.col("size"))), F.lit(0)).alias("in_multi"), F.max("size").alias("largest"),
    )
    q = quantiles(sizes, "size", (0.5, 0.9)).select(F.col("q")[0].alias("median"), F.col("q")[1].alias("p90"))
    return counts.crossJoin(F.broadcast(q))


def month_range(df: DataFrame, month: str) -> DataFrame:
    m = F.col(month)
    return df.agg(F.min(m).alias("first_month"), F.max(m).alias("last_month"), F.count_distinct(m).alias("months"), F.count_if(m.isNull()).alias("missing"))


def violations(df: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row per broken rule of a row; a rule whose condition is null counts as broken."""
    codes = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules]))
    return df.select(key, F.explode(codes).alias("violation"))


def manifest_rules() -> list[tuple[str, Column]]:
    """What every manifest row must keep, by violation code; for violations()."""
    labelled = F.coalesce(F.col("gain_map_present"), F.lit(False))
    number = lambda c: F.coalesce(finite(F.col(c).cast("double")), F.lit(False))
    at_least = lambda c, least: number(c) & (F.col(c) >= least)
    of = lambda source: F.coalesce(F.col("headroom_source") == source, F.lit(False))
    return [
        ("invalid_canonical_headroom", ~labelled | at_least("canonical_headroom", 1.0)),
        ("invalid_canonical_max_log2_gain", ~labelled | at_least("canonical_max_log2_gain", 0.0)),
        ("missing_xmp_headroom", ~of(XMP_SOURCE) | number("gain_map_headroom_xmp")),
        ("missing_makernote_headroom", ~of(NOTE_SOURCE) | number("apple_maker_hdr_headroom")),
    ]


def manifest_violations(samples: DataFrame) -> DataFrame:
    """(sample_id, violation) of manifest rows with unusable headroom or gain."""
    return violations(samples, "sample_id", manifest_rules())


def reconcile(expected: DataFrame, found: DataFrame, contract: str, key: str, examples: int = 10) -> DataFrame:
    """By contract: expected, found, missing and extra ids, with the first examples of each in order."""
    both = (
        expected.select(contract, key).distinct().withColumn("_e", F.lit(True))
        .join(found.select(contract, key).distinct().withColumn("_f", F.lit(True)), [contract, key], "full_outer")
        .withColumn("_kind", F.when(F.col("_f").isNull(), "missing").when(F.col("_e").isNull(), "extra"))
    )
    counts = both.groupBy(contract).agg(
        F.count("_e").alias("expected"), F.count("_f").alias("found"),
        F.count_if(F.col("_kind") == "missing").alias("missing"), F.count_if(F.col("_kind") == "extra").alias("extra"),
    )
    shown = first_examples(both.filter("_kind is not null"), [contract, "_kind"], key, examples)
    listed = shown.groupBy(contract).agg(
        *[F.array_join(F.array_sort(F.collect_list(F.when(F.col("_kind") == k, F.col(key).cast("string")))), ",").alias(f"{k}_examples") for k in ("missing", "extra")]
    )
    return counts.join(listed, contract, "left").fillna("", ["missing_examples", "extra_examples"])


def first_examples(df: DataFrame, by: Sequence[str], key: str, n: int) -> DataFrame:
    """The first n rows of each group by key; Spark keeps n per task before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(key))).filter(F.col("_rank") <= n).drop("_rank")


def assignment_changes(frozen: DataFrame, current: DataFrame, key: str = "sample_id") -> DataFrame:
    """Frozen rows against the current assignment: missing, moved or same; current rows that are not frozen are new."""
    j = frozen.select(key, F.col("split").alias("frozen_split")).join(current.select(key, F.col("split").alias("current_split")), key, "full_outer")
    state = (
        F.when(F.col("frozen_split").isNull(), "new").when(F.col("current_split").isNull(), "missing")
        .when(~F.col("frozen_split").eqNullSafe(F.col("current_split")), "moved").otherwise("same")
    )
    return j.withColumn("state", state)


def snapshot_matches(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """(name, matches) of each file that a freeze was made from: whether its hash is still the same.

    frozen, current: (name, sha256).
    """
    j = frozen.select("name", F.col("sha256").alias("_then")).join(current.select("name", F.col("sha256").alias("_now")), "name", "left")
    return j.select("name", F.coalesce(F.col("_then") == F.col("_now"), F.lit(False)).alias("matches"))


def audit_metrics(samples: DataFrame, splits: DataFrame, members: DataFrame, frozen: DataFrame | None, cells: DataFrame, assets: DataFrame) -> DataFrame:
    """One row of what findings() judges.

    samples(sample_id, gain_map_present, headroom_source, model), splits(sample_id, split), members(group_id, split,
    sample_id), frozen(sample_id, split) or None where nothing is frozen, cells(sample_id, v) in stops, assets(missing, extra).
    """
    labelled = samples.filter("gain_map_present").select("sample_id").distinct()
    extra_rows = lambda df, name: df.groupBy("sample_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(name))
    parts = [extra_rows(samples, "duplicate_samples"), extra_rows(splits, "duplicate_assignments")]
    for name, other in (("split", splits), ("group", members)):
        both = labelled.withColumn("_a", F.lit(True)).join(other.select("sample_id").distinct().withColumn("_b", F.lit(True)), "sample_id", "full_outer")
        parts.append(both.agg(F.count_if(F.col("_b").isNull()).alias(f"{name}_missing"), F.count_if(F.col("_a").isNull()).alias(f"{name}_extra")))
    one_split = splits.groupBy("sample_id").agg(F.max("split").alias("_own"))
    # the group is crossing if a member's split is not the group's, or a member is in another group too
    seen = members.groupBy("sample_id").agg(F.count("*").alias("_times"))
    crossing = members.join(one_split, "sample_id", "left").join(seen, "sample_id").filter(~F.col("_own").eqNullSafe(F.col("split")) | (F.col("_times") > 1))
    parts.append(crossing.agg(F.count_distinct("group_id").alias("crossing_groups")))
    there = frozen is not None
    frozen = splits.select("sample_id", "split").limit(0) if frozen is None else frozen
    moved = frozen.select("sample_id", F.col("split").alias("_then")).join(labelled.withColumn("_there", F.lit(True)), "sample_id", "left").join(one_split, "sample_id", "left")
    parts.append(moved.agg(
        (F.count("*") if there else F.lit(None).cast("long")).alias("frozen"), F.count_if(F.col("_there").isNull()).alias("frozen_missing"), F.count_if(~F.col("_own").eqNullSafe(F.col("_then"))).alias("frozen_moved")
    ))
    tested = splits.filter("split = 'test'").join(samples.filter(F.col("headroom_source") == XMP_SOURCE).select("sample_id").distinct(), "sample_id")
    parts.append(cells.join(tested.select("sample_id"), "sample_id").agg(F.count("*").alias("test_pixels"), F.count_if((F.col("v") >= 2) & (F.col("v") < 3)).alias("test_high_pixels")))
    has = F.coalesce("gain_map_present", F.lit(False))
    parts.append(samples.agg(
        F.count_distinct(F.when(has, F.col("sample_id"))).alias("labelled"), F.count_if(has & (F.col("headroom_source") == NOTE_SOURCE)).alias("estimated"),
        F.count_distinct(F.when(F.col("headroom_source") == XMP_SOURCE, F.col("model"))).alias("models"),
    ))
    parts.append(assets.agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("assets_missing"), F.coalesce(F.sum("extra"), F.lit(0)).alias("assets_extra")))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


#: id, severity, the metrics that are its evidence.
FINDINGS = (
    ("DQ-001", "critical", ("labelled", "duplicate_samples", "duplicate_assignments", "split_missing", "split_extra", "group_missing", "group_extra", "crossing_groups")),
    ("DQ-002", "critical", ("frozen", "frozen_missing", "frozen_moved")),
    ("DQ-003", "high", ("test_pixels", "test_high_pixels")),
    ("DQ-004", "high", ("labelled", "estimated")),
    ("DQ-005", "medium", ("models",)),
    ("DQ-006", "high", ("assets_missing", "assets_extra")),
)
FEW_HIGH_PIXELS = 100


def findings(metrics: DataFrame) -> DataFrame:
    """Six findings of one row of metrics: (finding, severity, status, evidence, overall).

    DQ-001 splits and groups cover the labelled samples once; DQ-002 the freeze is there (frozen is not null) and nothing
    in it is missing or moved; DQ-003 the test split has a hundred pixels of two to three stops; DQ-004 some labels
    are estimates and DQ-005 a model name stands for the device, both always warnings; DQ-006 no asset is missing or
    unexpected.  Only a critical failure blocks.
    """
    none = lambda *names: sum((F.col(c) for c in names), F.lit(0)) == 0
    failed = {
        "DQ-001": ~none(*FINDINGS[0][2][1:]), "DQ-002": F.col("frozen").isNull() | ~none("frozen_missing", "frozen_moved"),
        "DQ-003": F.col("test_high_pixels") < FEW_HIGH_PIXELS, "DQ-006": ~none("assets_missing", "assets_extra"),
    }
    rows = [
        F.struct(
            F.lit(i).alias("finding"), F.lit(severity).alias("severity"),
            (F.when(failed[i], "fail").otherwise("pass") if i in failed else F.lit("warning")).alias("status"),
            F.concat_ws("; ", *[F.concat(F.lit(c + "="), F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in evidence]).alias("evidence"),
        )
        for i, severity, evidence in FINDINGS
    ]
    critical = [failed[i] for i, severity, _ in FINDINGS if severity == "critical" and i in failed]
    overall = F.when(critical[0] | critical[1], "blocked").otherwise("ready_with_known_gaps")
    return metrics.select(F.explode(F.array(*rows)).alias("f"), overall.alias("overall")).select("f.*", "overall")
