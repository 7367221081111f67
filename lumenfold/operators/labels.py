"""Label rules of a gain-map corpus: subsets, eligibility, headroom, geometry, domains, routing, locks, summaries.

All are expressions or plain joins over manifest rows, so they run inside the scans that feed them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.expr import exp2, finite, lit, positive_finite

# Gain-map versions, source types and the keys that must not be in a public manifest.
ISO_VERSION, LEGACY_VERSION = 131072, 65536
ISO_TYPE, LEGACY_TYPE = "iso_21496_1_tmap", "legacy_apple"
XMP_SOURCE, NOTE_SOURCE = "xmp_hdr_gain_map_headroom", "apple_makernote_piecewise_estimate"
PRIVATE_KEYS = ("source_name", "capture_datetime", "capture_timezone_offset", "gps", "latitude", "longitude")
HLG_HEADROOM_STOPS = 2.3
STRIDE = 16


def label_subset(samples: DataFrame, subset: str) -> DataFrame:
    """Rows of one label subset: all, xmp, iso_native or legacy_apple; a null version or type matches nothing."""
    version, kind = F.coalesce("gain_map_version", F.lit(0)), F.col("phase_a_source_type")
    rules = {
        "all": F.lit(True),
        "xmp": F.col("headroom_source") == XMP_SOURCE,
        "iso_native": (version == ISO_VERSION) | (kind == ISO_TYPE),
        "legacy_apple": (version == LEGACY_VERSION) | (kind == LEGACY_TYPE),
    }
    if subset not in rules:
        raise ValueError(f"unknown label subset: {subset}")
    return samples.filter(F.coalesce(rules[subset], F.lit(False)))


def with_eligibility(samples: DataFrame, stops: str = "canonical_max_log2_gain", present: str = "gain_map_present") -> DataFrame:
    """Adds per_image_eligible (a finite number above 0) and degenerate_gain_label (exactly 0 where a gain map is)."""
    v = F.col(stops)
    return samples.withColumns(
        {
            "per_image_eligible": F.coalesce(positive_finite(v), F.lit(False)),
            "degenerate_gain_label": F.coalesce(F.col(present) & finite(v) & (v == 0), F.lit(False)),
        }
    )


def legacy_headroom(maker33: Column, maker48: Column) -> Column:
    """Linear headroom from the two maker-note numbers: four straight segments in stops, never below 1."""
    bright = F.when(maker48 <= 0.01, 3.0 - 70.0 * maker48).otherwise(2.303 - 0.303 * maker48)
    dim = F.when(maker48 <= 0.01, 1.8 - 20.0 * maker48).otherwise(1.601 - 0.101 * maker48)
    return exp2(F.greatest(F.when(maker33 < 1.0, dim).otherwise(bright), lit(0)))


def resolve_headroom(samples: DataFrame) -> DataFrame:
    """Adds headroom_source, canonical_headroom and canonical_max_log2_gain: XMP first, then the maker note, else unresolved.

    Rows without a gain map have neither source nor headroom.
    """
    noted = F.when(F.col("maker33").isNotNull() & F.col("maker48").isNotNull(), legacy_headroom(F.col("maker33"), F.col("maker48")))
    present = F.coalesce("gain_map_present", F.lit(False))
    source = F.when(F.col("xmp_headroom").isNotNull(), XMP_SOURCE).when(noted.isNotNull(), NOTE_SOURCE).otherwise("unresolved")
    headroom = F.when(present, F.coalesce(F.col("xmp_headroom").cast("double"), noted))
    return samples.withColumns(
        {"headroom_source": F.when(present, source), "canonical_headroom": headroom, "canonical_max_log2_gain": F.log2(headroom)}
    )


def leaked_keys(raw: DataFrame, column: str = "value", forbidden: Sequence[str] = PRIVATE_KEYS) -> DataFrame:
    """(key, rows): private keys that occur in the lines of a raw JSON manifest, in whatever case, and in how many rows."""
    key = F.explode(F.array_distinct(F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))))
    return raw.select(key.alias("key")).filter(F.lower("key").isin(*forbidden)).groupBy("key").agg(F.count("*").alias("rows"))


def leaked_columns(df: DataFrame, forbidden: Sequence[str] = PRIVATE_KEYS) -> list[str]:
    """Private columns of a parsed manifest, sorted."""
    return sorted(c for c in df.columns if c.lower() in forbidden)


def aligned_size(width: Column, height: Column, long_side: int, half_even: bool = True) -> tuple[Column, Column]:
    """Fit to a long side without enlarging, then round both sides up to the stride; ties half-even or away from 0."""
    scale = F.least(lit(1), lit(long_side) / F.greatest(width, height))
    whole = F.rint if half_even else (lambda v: F.floor(v + 0.5))
    side = lambda v: F.greatest(F.lit(STRIDE), F.ceil(F.greatest(lit(1), whole(v * scale)) / STRIDE) * STRIDE).cast("long")
    return side(width), side(height)


def geometry_violations(samples: DataFrame, long_side: int) -> DataFrame:
    """Rows whose stored proxy or grid is not what the geometry contract gives: width, height, proxy_w/h, grid_w/h."""
    w, h = aligned_size(F.col("width"), F.col("height"), long_side)
    wrong = (F.col("proxy_w") != w) | (F.col("proxy_h") != h) | (F.col("grid_w") != w / STRIDE) | (F.col("grid_h") != h / STRIDE)
    return samples.filter(F.coalesce(wrong, F.lit(True)))


def degraded_decodes(files: DataFrame) -> DataFrame:
    """Successful files whose decode was degraded, with what it means.

    Only where the target was applied is decoded against target a shortfall of size; elsewhere the target is a
    request that was refused.  Reasons are for display and decide nothing.
    """
    short = (F.col("decoded_width") < F.col("target_width")) | (F.col("decoded_height") < F.col("target_height"))
    kind = F.when(~F.col("target_dimensions_applied"), "crop refused").when(short, "short of target").otherwise("other")
    return files.filter("success AND decode_degraded").withColumn("degradation", kind)


def declared_domain(domain: Column, headroom: Column) -> tuple[Column, Column]:
    """(domain, headroom) to render by: HDR needs a finite headroom above 1, unknown counts as SDR, others have 1."""
    hdr = (domain == "display_hdr") & finite(headroom) & (headroom > 1)
    fallen = F.when(domain.isNull() | domain.isin("unknown", "display_hdr"), "display_sdr").otherwise(domain)
    return F.when(hdr, domain).otherwise(fallen), F.when(hdr, headroom).otherwise(lit(1))


def _q(v: Column) -> Column:
    return F.struct(F.rint(v * 1_000_000).cast("long").alias("numerator"), F.lit(1_000_000).cast("long").alias("denominator"))


def route_labels(samples: DataFrame) -> DataFrame:
    """Adds source_type, confidence, metadata (legacy rows) and reason, null where the label can be built.

    samples: gain_map_version, xmp_headroom, alternate_stops and gain_max (of the payload), canonical_headroom.
    """
    version = F.coalesce("gain_map_version", F.lit(0))
    iso, legacy = version == ISO_VERSION, version == LEGACY_VERSION
    expected = exp2(F.col("alternate_stops"))
    resolved = F.col("canonical_headroom")
    reason = (
        F.when(iso & F.col("xmp_headroom").isNull(), "no XMP headroom")
        .when(iso & (F.abs(expected - F.col("xmp_headroom")) > 2e-5 * F.greatest(lit(1), expected)), "headroom conflict")
        .when(iso & (F.abs(F.col("gain_max") - F.col("alternate_stops")) > 1e-6), "gain max against headroom")
        .when(legacy & resolved.isNull(), "no resolved headroom")
        .when(legacy & (~finite(resolved) | (resolved < 1) | (resolved > 32)), "headroom out of range")
        .when(~(iso | legacy), "unknown version")
    )
    stops = _q(F.log2(resolved))
    built = F.struct(
        F.lit(0x40).alias("flags"), _q(lit(0)).alias("base_headroom"), stops.alias("alternate_headroom"), _q(lit(0)).alias("gain_min"),
        stops.alias("gain_max"), _q(lit(1)).alias("gamma"), _q(lit(0)).alias("base_offset"), _q(lit(0)).alias("alternate_offset"),
    )
    return samples.withColumns(
        {
            "source_type": F.when(iso, ISO_TYPE).when(legacy, LEGACY_TYPE),
            "confidence": F.when(iso, "high").when(legacy, "low"),
            "metadata": F.when(legacy & reason.isNull(), built),
            "reason": reason,
        }
    )


def content_check(manifest: DataFrame, files: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, state): manifest(key, sha256) against files(key, content): same, changed, missing, or unexpected without a row."""
    found = files.select(F.col(key), F.sha2("content", 256).alias("_now"), F.lit(True).alias("_there"))
    j = manifest.select(key, "sha256", F.lit(True).alias("_listed")).join(found, key, "full_outer")
    state = F.when(F.col("_listed").isNull(), "unexpected").when(F.col("_there").isNull(), "missing").when(F.col("sha256").eqNullSafe(F.col("_now")), "same")
    return j.select(key, state.otherwise("changed").alias("state"))


def join_corpus(splits: DataFrame, samples: DataFrame, members: DataFrame, key: str = "sample_id") -> DataFrame:
    """Every split row with its manifest row and its group; what is missing stays null and has a reason."""
    j = splits.join(samples.withColumn("_s", F.lit(True)), key, "left").join(members.withColumn("_g", F.lit(True)), key, "left")
    reason = F.when(F.col("_s").isNull(), "no manifest row").when(F.col("_g").isNull(), "no group")
    return j.withColumn("reason", reason).drop("_s", "_g")


def missing_and_extra(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, missing, extra) of the keys that only one side has."""
    a, b = expected.select(key).distinct().withColumn("_e", F.lit(True)), found.select(key).distinct().withColumn("_f", F.lit(True))
    return a.join(b, key, "full_outer").filter("_e IS NULL OR _f IS NULL").select(key, F.col("_f").isNull().alias("missing"), F.col("_e").isNull().alias("extra"))


def fold_guards(train: DataFrame, selection: DataFrame, registered: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row: keys in both folds, selected but not registered, registered but not selected, and whether all are 0."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    t, s, r = (d.select(key).distinct() for d in (train, selection, registered))
    row = n(t.intersect(s), "overlap").crossJoin(n(s.exceptAll(r), "unregistered")).crossJoin(n(r.exceptAll(s), "unselected"))
    return row.withColumn("holds", (F.col("overlap") == 0) & (F.col("unregistered") == 0) & (F.col("unselected") == 0))


def corpus_lock(labels: DataFrame, expected_iso: int, expected_legacy: int) -> DataFrame:
    """One row: labels by source type, rows without one, and whether the counts are the registered ones and none is unresolved."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    kind = F.col("source_type")
    one = labels.agg(
        F.count("*").alias("samples"), n(kind == ISO_TYPE).alias("iso"), n(kind == LEGACY_TYPE).alias("legacy"),
        n(kind.isNull() | ~kind.isin(ISO_TYPE, LEGACY_TYPE)).alias("unresolved"),
    )
    return one.withColumn("accepted", (F.col("unresolved") == 0) & (F.col("iso") == expected_iso) & (F.col("legacy") == expected_legacy))


def acceptance_gates(labels: DataFrame, round_trips: DataFrame, expected: dict[str, int], desktop: DataFrame | None = None) -> DataFrame:
    """(gate, value, expected, passed) of a label corpus, six gates; all must pass.

    labels(sample_id, source_type, gain_min, gain_max, alternate_headroom); round_trips(.., ok) of the golden samples;
    expected: samples, iso, legacy and negative_gain_min; desktop(.., passed), results of another implementation: without
    any, its gate fails.
    """
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    kind, iso = F.col("source_type"), F.col("source_type") == ISO_TYPE
    own = labels.agg(
        F.count("*").alias("samples"), n(iso).alias("iso"), n(kind == LEGACY_TYPE).alias("legacy"), n(kind.isNull() | ~kind.isin(ISO_TYPE, LEGACY_TYPE)).alias("unresolved"),
        F.count_if(iso & ~F.coalesce(F.abs(F.col("gain_max") - F.col("alternate_headroom")) <= 1e-6, F.lit(False))).alias("inconsistent"),
        n(iso & (F.col("gain_min") < 0)).alias("negative"),
    )
    failed = lambda df, c, name: df.agg(F.count("*").alias(f"{name}_n"), F.count_if(~F.coalesce(F.col(c), F.lit(False))).alias(name))
    other = desktop if desktop is not None else labels.limit(0).selectExpr("false AS passed")
    row = own.crossJoin(F.broadcast(failed(round_trips, "ok", "broken"))).crossJoin(F.broadcast(failed(other, "passed", "refused")))
    gate = lambda name, value, want, ok: F.struct(F.lit(name).alias("gate"), value.cast("long").alias("value"), F.lit(want).cast("long").alias("expected"), ok.alias("passed"))
    counted = (F.col("samples") == expected["samples"]) & (F.col("iso") == expected["iso"]) & (F.col("legacy") == expected["legacy"])
    zero = lambda name, c: gate(name, F.col(c), 0, F.col(c) == 0)
    gates = F.array(
        gate("corpus_counts", F.col("samples"), expected["samples"], counted), zero("unresolved_zero", "unresolved"), zero("native_metadata_consistent", "inconsistent"),
        gate("negative_gain_min_preserved", F.col("negative"), expected["negative_gain_min"], F.col("negative") == expected["negative_gain_min"]),
        zero("golden_roundtrip", "broken"), gate("desktop_golden", F.col("refused"), 0, (F.col("refused") == 0) & (F.col("refused_n") > 0)),
    )
    return row.select(F.explode(gates).alias("g")).select("g.*")


def enrichment_summary(samples: DataFrame) -> DataFrame:
    """One row: samples, those with a gain map, by headroom source, eligible for per-image targets, degenerate labels."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    source = F.col("headroom_source")
    return samples.agg(
        F.count("*").alias("samples"), n(F.col("gain_map_present")).alias("gain_maps"), n(source == XMP_SOURCE).alias("headroom_from_xmp"),
        n(source == NOTE_SOURCE).alias("headroom_from_makernote"), n(source == "unresolved").alias("unresolved"),
        n(F.col("per_image_eligible")).alias("per_image_eligible"), n(F.col("degenerate_gain_label")).alias("degenerate_gain_labels"),
    )


def validation_errors(samples: DataFrame, splits: DataFrame, members: DataFrame, key: str = "sample_id") -> DataFrame:
    """(error, item) of a labelled corpus: splits and groups must hold each labelled sample once, groups one split.

    samples(key, gain_map_present, ..), splits(key, split), members(group_id, split, key).
    """
    labelled = samples.filter("gain_map_present").select(key).distinct()
    item = F.col(key).cast("string").alias("item")
    parts = []
    for name, rows in (("split", splits), ("group", members)):
        parts += [
            labelled.join(rows, key, "left_anti").select(F.lit(f"{name} incomplete").alias("error"), item),
            rows.join(labelled, key, "left_anti").select(F.lit(f"{name} has a stranger").alias("error"), item),
            rows.groupBy(key).count().filter("count > 1").select(F.lit(f"{name} overlap").alias("error"), item),
        ]
    own = splits.select(key, F.col("split").alias("_own"))
    crossing = members.join(own, key, "left").filter(~F.col("_own").eqNullSafe(F.col("split"))).select("group_id").distinct()
    parts.append(crossing.select(F.lit("group crosses split").alias("error"), F.col("group_id").cast("string").alias("item")))
    leaked = leaked_columns(samples)
    if leaked:
        parts.append(samples.sparkSession.createDataFrame([("private key in manifest", c) for c in leaked], "error string, item string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validation_summary(samples: DataFrame, splits: DataFrame, members: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: whether there is no error, counts of samples, sky mattes, groups, by split and by headroom source."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    tally = lambda df, c, name: df.groupBy(c).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(name))
    row = samples.agg(
        F.count("*").alias("samples"), n(F.col("gain_map_present")).alias("gain_samples"), n(F.col("sky_matte_present")).alias("sky_mattes"),
        n(F.col("per_image_eligible")).alias("per_image_eligible"), n(F.col("degenerate_gain_label")).alias("degenerate_gain_labels"),
    )
    for other in (
        members.agg(F.count_distinct("group_id").alias("capture_groups")), tally(splits, "split", "splits"),
        tally(samples.filter("gain_map_present").fillna("missing", ["headroom_source"]), "headroom_source", "headroom_sources"), errors.agg((F.count("*") == 0).alias("valid")),
    ):
        row = row.crossJoin(F.broadcast(other))
    return row


def grouping_summary(members: DataFrame, groups: DataFrame, frozen: DataFrame) -> DataFrame:
    """(split, samples, groups, models, largest_group, new_samples, inherited_samples, new_groups) of build_groups()' tables.

    Inherited samples are new ones in a group that a frozen sample put in its split; new groups have no frozen sample.
    """
    known = frozen.select("sample_id", F.lit(True).alias("_frozen"))
    per = members.join(known, "sample_id", "left").groupBy("split", "group_id", "model").agg(F.count("*").alias("n"), F.count("_frozen").alias("f"))
    whole = per.groupBy("split", "group_id").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    models = per.groupBy("split", "model").agg(F.sum("n").alias("n")).groupBy("split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "n")))).alias("models"))
    out = whole.groupBy("split").agg(
        F.sum("n").alias("samples"), F.count("*").alias("groups"), F.max("n").alias("largest_group"), F.sum(F.col("n") - F.col("f")).alias("new_samples"),
        F.sum(F.when(F.col("f") > 0, F.col("n") - F.col("f")).otherwise(0)).alias("inherited_samples"), F.count_if(F.col("f") == 0).alias("new_groups"),
    )
    return out.alias("o").join(models.withColumnRenamed("split", "_of"), F.col("o.split").eqNullSafe(F.col("_of"))).drop("_of")


def split_summary(members: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Per split: samples, groups, models and the largest group; members: key, group_id, split."""
    j = members.join(samples.select(key, "model"), key, "left")
    groups = j.groupBy("split", "group_id").agg(F.count("*").alias("n")).groupBy("split").agg(F.count("*").alias("groups"), F.max("n").alias("largest"))
    return j.groupBy("split").agg(F.count("*").alias("samples"), F.count_distinct("model").alias("models")).join(groups, "split")


#: Rules over several settings of one run, each true where it is broken.  Columns are the settings' keys.
CROSS_RULES = (
    ("output missing", "output IS NULL OR output = ''"),
    ("preview without max edge", "decode_intent = 'preview' AND coalesce(preview_max_edge, 0) = 0"),
    ("half size outside preview", "(decode_intent = 'preview') <> half_size"),
    ("ultra hdr depth", "encoding = 'ultrahdr' AND depth <> 8"),
    ("hlg headroom", f"encoding LIKE 'hlg%' AND NOT auto_headroom AND headroom_stops > {HLG_HEADROOM_STOPS}"),
    ("external gain without report", "(external_gain IS NULL) <> (external_gain_report IS NULL)"),
    ("external gain in batch", "external_gain IS NOT NULL AND recursive"),
    ("digital gain", "NOT (digital_gain > 0 AND digital_gain <= 64)"),
)


def cross_settings(runs: DataFrame, rules: Sequence[tuple[str, str]] = CROSS_RULES) -> DataFrame:
    """(run, rule) of every broken rule; runs: run and one typed column for each setting; an unknown outcome is not broken."""
    broken = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in rules]))
    return runs.select("run", F.explode(broken).alias("rule"))


def settings_fingerprint(settings: DataFrame, rules: DataFrame, version: str, by: str = "run") -> DataFrame:
    """(run, fingerprint): SHA-256 over the version and key=value of the settings that affect output bytes, in key order.

    settings(run, key, value); rules(key, affects_output_bytes).  A run has a few dozen settings, so its list is small.
    """
    used = settings.join(F.broadcast(rules.filter("affects_output_bytes").select("key")), "key")
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("key", F.coalesce("value", F.lit("")).alias("value")))), lambda p: F.concat(p["key"], F.lit("="), p["value"]))
    return used.groupBy(by).agg(F.sha2(F.concat_ws("|", F.lit(version), pairs), 256).alias("fingerprint"))
