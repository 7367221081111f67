"""Acceptance gates, summaries and the golden list on small tables, worked out by hand."""

import pytest

from lumenfold.operators import corpus, labels
from lumenfold.operators.labels import ISO_TYPE, LEGACY_TYPE, NOTE_SOURCE, XMP_SOURCE


def test_acceptance_gates(spark):
    rows = [("a", ISO_TYPE, -0.5, 2.0, 2.0), ("b", ISO_TYPE, 0.0, 2.0, 2.0), ("c", LEGACY_TYPE, None, None, None)]
    df = spark.createDataFrame(rows, "sample_id string, source_type string, gain_min double, gain_max double, alternate_headroom double")
    ok = spark.createDataFrame([(True,)], "ok boolean")
    expected = {"samples": 3, "iso": 2, "legacy": 1, "negative_gain_min": 1}
    gates = lambda *how: {r.gate: r.passed for r in labels.acceptance_gates(*how).collect()}
    assert set(gates(df, ok, expected, ok.selectExpr("ok AS passed")).values()) == {True}
    alone = gates(df, ok, expected)
    assert not alone.pop("desktop_golden") and all(alone.values())
    bad = df.selectExpr("sample_id", "CASE WHEN sample_id = 'c' THEN NULL ELSE source_type END AS source_type", "abs(gain_min) AS gain_min", "gain_max", "gain_max + 0.01 AS alternate_headroom")
    got = gates(bad, ok.selectExpr("cast(NULL AS boolean) AS ok"), expected, ok.selectExpr("false AS passed"))
    assert set(got.values()) == {False} and len(got) == 6


def test_validation(spark):
    samples = spark.createDataFrame(
        [("a", True, XMP_SOURCE, True, True, False), ("b", True, NOTE_SOURCE, False, None, True), ("c", False, None, True, False, False), ("d", True, None, None, True, False)],
        "sample_id string, gain_map_present boolean, headroom_source string, sky_matte_present boolean, per_image_eligible boolean, degenerate_gain_label boolean",
    )
    splits = spark.createDataFrame([("a", "train"), ("b", "test"), ("d", "train")], "sample_id string, split string")
    members = spark.createDataFrame([("g", "train", "a"), ("g", "train", "d"), ("h", "test", "b")], "group_id string, split string, sample_id string")
    errors = labels.validation_errors(samples, splits, members)
    assert errors.collect() == []
    r = labels.validation_summary(samples, splits, members, errors).first()
    assert (r.valid, r.samples, r.gain_samples, r.sky_mattes, r.capture_groups, r.per_image_eligible, r.degenerate_gain_labels) == (True, 4, 3, 2, 2, 2, 1)
    assert r.splits == {"train": 2, "test": 1} and r.headroom_sources == {XMP_SOURCE: 1, NOTE_SOURCE: 1, "missing": 1}
    bad_splits = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "test"), ("c", "test")], "sample_id string, split string")
    bad_members = spark.createDataFrame([("g", "train", "a"), ("h", "train", "b"), ("h", "train", "c")], "group_id string, split string, sample_id string")
    got = sorted(map(tuple, labels.validation_errors(samples.withColumnRenamed("sky_matte_present", "GPS"), bad_splits, bad_members).collect()))
    assert got == sorted([
        ("split incomplete", "d"), ("split has a stranger", "c"), ("split overlap", "a"), ("group incomplete", "d"), ("group has a stranger", "c"),
        ("group crosses split", "g"), ("group crosses split", "h"), ("private key in manifest", "GPS"),
    ])
    assert not labels.validation_summary(samples, bad_splits, bad_members, labels.validation_errors(samples, bad_splits, bad_members)).first().valid
    e = labels.enrichment_summary(samples).first()
    assert (e.samples, e.gain_maps, e.headroom_from_xmp, e.headroom_from_makernote, e.unresolved, e.per_image_eligible, e.degenerate_gain_labels) == (4, 3, 1, 1, 0, 2, 1)


def test_grouping_summary(spark):
    members = spark.createDataFrame([("a", "m", "g", "train"), ("b", "n", "g", "train"), ("c", "m", "h", "train"), ("d", "m", "k", "test")], "sample_id string, model string, group_id string, split string")
    frozen = spark.createDataFrame([("a", "train"), ("d", "test")], "sample_id string, split string")
    got = {r.split: r for r in labels.grouping_summary(members, members, frozen).collect()}
    t = got["train"]
    assert (t.samples, t.groups, t.largest_group, t.new_samples, t.inherited_samples, t.new_groups, t.models) == (3, 2, 2, 2, 1, 1, {"m": 2, "n": 1})
    assert (got["test"].samples, got["test"].new_samples) == (1, 0)


@pytest.mark.parametrize("n", [0, 1, 30])
def test_golden_list(spark, n):
    rows = [(f"s{k:02d}", ISO_TYPE, float(k % 7), float(-k), 0.0) for k in range(n)] + [(f"t{k:02d}", LEGACY_TYPE, 0.0, 0.0, float(50 - k)) for k in range(n // 2)]
    df = spark.createDataFrame(rows, "sample_id string, source_type string, x double, y double, v double")
    got = [(r.position, r.sample_id) for r in corpus.golden_list(df, ["s09", "zz", "s02"], ["x", "y"], "v").collect()]
    # known as listed, least and greatest x, least and greatest y (s00 is there already), then by id; ranks 0, 4, 9, 14 of 15
    expected = {0: [], 1: ["s00"], 30: ["s09", "s02", "s00", "s06", "s29", "s01", "s03", "s04", "t14", "t10", "t05", "t00"]}[n]
    assert [s for _, s in sorted(got)] == expected and [p for p, _ in sorted(got)] == list(range(1, len(expected) + 1))
