"""Rules of labels, metrics and audits on small tables; the expected numbers are worked out by hand from the formulas."""

import math
import random

import pytest

from lumenfold.operators import audit, metrics, raster
from lumenfold.operators.labels import NOTE_SOURCE, XMP_SOURCE
from lumenfold.operators.selection import quantiles

close = lambda *v: pytest.approx(v, abs=1e-9)


def test_target_saturation(spark):
    cells = spark.createDataFrame([("a", 1.5), ("a", 3.0), ("a", 4.5), ("b", 1.0), ("b", 1.5)], "image_id string, v double")
    images = spark.createDataFrame([("a", "train", XMP_SOURCE, 4.0), ("b", "train", NOTE_SOURCE, 1.0), ("c", "test", NOTE_SOURCE, None)], "image_id string, split string, headroom_source string, max_log2_gain double")
    got = {(r["subset"], r["mode"], r["split"]): r for r in metrics.target_saturation(cells, images).collect()}
    # fixed: a has .5, 1, 1.5 -> one above; b has 1/3, .5.  own: a has .375, .75, 1.125; b has 1, 1.5
    r = got["all", "fixed_3stops", "train"]
    assert (r.samples, r.pixels, r.saturated_samples, r.saturated_pixels, r.above_3_stops) == (2, 5, 1, 1, 1)
    assert r.target_mean == pytest.approx((0.5 + 1 + 1 + 1 / 3 + 0.5) / 5)
    r = got["all", "per_image", "train"]
    assert (r.samples, r.saturated_samples, r.saturated_pixels) == (2, 2, 2) and r.target_mean == pytest.approx((0.375 + 0.75 + 1 + 1 + 1) / 5)
    r = got["xmp", "per_image", "train"]
    assert (r.samples, r.pixels, r.saturated_sample_fraction, r.above_3_stops_fraction) == (1, 3, 1.0, 1.0)
    r = got["all", "fixed_3stops", "test"]  # no cells
    assert (r.samples, r.pixels, r.target_mean, r.saturated_pixel_fraction) == (1, 0, 0.0, 0.0) and ("all", "per_image", "test") not in got


def test_baselines(spark):
    cells = spark.createDataFrame([("a", 0.5, 1.0), ("a", 0.0, 0.0), ("b", 0.25, 0.5)], "sample_id string, prediction double, target double")
    r = metrics.baseline_mae(cells, spark.createDataFrame([(0.2,)], "train_mean double")).first()
    assert (r.mae, r.mae_zero, r.mae_half, r.mae_mean) == close(0.25, 0.5, 1 / 3, (0.8 + 0.2 + 0.3) / 3)
    assert r.improvement == pytest.approx(1 - 0.75 / 1.3) and (r.sample_mae, r.sample_min, r.sample_max) == close(0.25, 0.25, 0.25)
    c = metrics.constant_baseline(cells, spark.createDataFrame([(0.2,)], "train_mean double")).first()
    assert (c.mae, c.constant_mae, c.improvement) == close(0.25, 1.3 / 3, 1 - 0.75 / 1.3)


def test_bucketed_errors(spark):
    rows = [("a", "xmp", 0.5, 0.0), ("a", "xmp", 1.5, 1.0), ("a", "xmp", 4.0, 5.0), ("b", "legacy", 0.25, -0.5)]
    got = {r.bucket: r for r in metrics.bucketed_errors(spark.createDataFrame(rows, "sample_id string, source string, prediction double, target double")).collect()}
    assert {b: (r.pixels, r.samples) for b, r in got.items()} == {"all": (4, 2), "xmp": (3, 1), "legacy": (1, 1), "low_0_to_1_stop": (2, None), "hdr_1_to_2_stops": (1, None), "hdr_2_to_3_stops": (1, None)}
    assert got["low_0_to_1_stop"].pixel_mae == pytest.approx(0.625) and got["hdr_2_to_3_stops"].pixel_mae == 1.0
    # a: means 2 and 2; 95th percentiles 1.5 + .9 * 2.5 and 1 + .9 * 4; b: .75 for both
    assert (got["xmp"].image_mean_mae, got["xmp"].image_p95_mae) == close(0.0, 4.6 - 3.75)
    assert (got["all"].image_mean_mae, got["all"].image_p95_mae) == close(0.375, (0.85 + 0.75) / 2)
    one = spark.createDataFrame(rows[3:], "sample_id string, source string, prediction double, target double")
    empty = {r.bucket: r for r in metrics.bucketed_errors(one).collect()}["hdr_2_to_3_stops"]
    assert (empty.pixels, empty.pixel_mae) == (0, None)


def test_loss_parts(spark):
    rows = [("a", 0, 0, 0.5, 0.4), ("a", 0, 1, 0.4, 0.0), ("a", 1, 0, 0.02, 0.0), ("b", 0, 0, 1.0, 0.5), ("b", 0, 2, 0.5, 0.5)]
    r = metrics.loss_parts(spark.createDataFrame(rows, "sample_id string, gy int, gx int, prediction double, target double"), highlight_weight=2.0).first()
    w = 1 + 2 * 0.16
    a = ((0.1 - 0.025) * w + (0.4 - 0.025) + 0.02**2 / 0.1) / (w + 2)
    b = (0.5 - 0.025) / 2
    assert r.reconstruction == pytest.approx((a + b) / 2)
    # a: along x |(-.1) - (-.4)| = .3, along y |(-.48) - (-.4)| = .08; b has a gap and no pair
    assert r.gradient == pytest.approx(0.19)
    assert r.global_mean == pytest.approx((0.52 / 3 + 0.25) / 2)
    assert r.loss == pytest.approx(r.reconstruction + 0.2 * r.gradient + 0.1 * r.global_mean)
    assert r.highlight_mae == pytest.approx(3 * (0.1 + 0.25) / 2) and (r.highlight_images, r.zero_target_images, r.images) == (2, 1, 2)
    assert r.false_high_rate == pytest.approx(0.5)


def test_gain_distribution(spark):
    cells = spark.createDataFrame([("a", k / 4) for k in range(11)] + [("b", 1.0)] * 3, "image_id string, v double")
    limits = spark.createDataFrame([("a", 2.5, 0.0, 2.0), ("b", 0.0, 1.0, 1.0)], "image_id string, ceiling double, gain_min double, gain_max double")
    get = lambda *how: {r.image_id: r for r in raster.gain_distribution(cells, *how).collect()}
    display, external, photographic = get("display", limits), get("external", limits), get("photographic")
    a = display["a"]
    assert (a.over_half, a.over_one, a.over_two) == close(8 / 11, 6 / 11, 2 / 11)
    assert [a[f"q{k}"] for k in range(8)] == [1.25, 1.75, 2.25, 2.25, 2.25, 2.25, 2.25, 2.5]
    assert [x["a"].clipped for x in (display, external, photographic)] == pytest.approx([1 / 11, 3 / 11, 0])
    assert [x["b"].clipped for x in (display, external, photographic)] == [0, 0, 0]


def test_light_levels(spark):
    px = spark.createDataFrame([("a", 0, 0, 1.0, 1.0, 1.0), ("a", 0, 1, 0.0, 0.0, 0.0), ("b", 0, 0, 400.0, 0.0, 0.0)], "image_id string, y int, x int, r double, g double, b double")
    got = {r.image_id: (r.max_cll, r.max_fall) for r in raster.light_levels(px).collect()}
    assert got["a"] == (203, math.ceil(203 / 2)) or got["a"] == (204, 102)
    red = (0.2627 * 0.753833 + 0.678 * 0.0457439) * 400
    assert got["b"] == (10_000, math.ceil(min(10_000, red * 203)))
    assert {r.image_id: r.max_cll for r in raster.light_levels(px, most=65_535).collect()}["b"] == math.ceil(0.753833 * 400 * 203)


def test_round_trip(spark):
    cells = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("a", 0.5), ("b", 3.0)], "image_id string, v double")
    meta = spark.createDataFrame([("a", 0.0, 2.0, 0.5), ("b", 0.0, 2.0, 1.0)], "image_id string, gain_min double, gain_max double, gamma double")
    got = {r.image_id: r for r in metrics.round_trip_error(cells, meta).collect()}
    code = round(math.sqrt(0.25) * 255) / 255  # half to even: 127.5 -> 128
    assert got["a"].max_error == pytest.approx(abs(2 * code * code - 0.5)) and got["a"].allowed == pytest.approx(2 / 510 + 2e-5)
    assert (got["b"].max_error, got["b"].ok) == (1.0, False)


def test_repaired_sites(spark):
    grid = [[100] * 9 for _ in range(7)]
    grid[3][4], grid[2][2], grid[0][0], grid[4][6] = 5, 1000, 1000, 990
    grid[2][6], grid[4][4] = 98, 103
    rows = [("a", y, x, float(v)) for y, line in enumerate(grid) for x, v in enumerate(line)]
    rows += [("b", y, x, float(v)) for y, line in enumerate(grid) for x, v in enumerate(line) if (y, x) not in {(3, 2), (3, 6)}]
    mosaic = spark.createDataFrame(rows, "image_id string, y int, x int, v double")
    levels = spark.createDataFrame([("a", 4.0, 1000.0), ("b", 4.0, 1000.0)], "image_id string, black double, white double")
    got = {(r.image_id, r.y, r.x): r.v for r in raster.repair_sites(mosaic, levels).filter("repaired").collect()}
    # 5 is within two of black and 100 over black + 20; the corner is at the edge; 990 is under 99.5 % of white
    assert got == {("a", 3, 4): 100.0, ("a", 2, 2): 100.0, ("b", 2, 2): 100.0}  # b's dead site has two neighbours


def test_manifest_violations(spark):
    rows = [
        ("a", True, 2.0, 1.0, XMP_SOURCE, 2.0, None), ("b", True, 0.5, -1.0, XMP_SOURCE, float("nan"), None), ("c", False, None, None, NOTE_SOURCE, None, None),
        ("d", True, None, float("inf"), NOTE_SOURCE, None, 1.0), ("e", None, None, None, None, None, None),
    ]
    schema = "sample_id string, gain_map_present boolean, canonical_headroom double, canonical_max_log2_gain double, headroom_source string, gain_map_headroom_xmp double, apple_maker_hdr_headroom double"
    got = sorted(map(tuple, audit.manifest_violations(spark.createDataFrame(rows, schema)).collect()))
    assert got == [
        ("b", "invalid_canonical_headroom"), ("b", "invalid_canonical_max_log2_gain"), ("b", "missing_xmp_headroom"),
        ("c", "missing_makernote_headroom"), ("d", "invalid_canonical_headroom"), ("d", "invalid_canonical_max_log2_gain"),
    ]


def test_findings(spark):
    samples = spark.createDataFrame([("a", True, XMP_SOURCE, "m"), ("b", True, NOTE_SOURCE, "m"), ("c", False, None, "n")], "sample_id string, gain_map_present boolean, headroom_source string, model string")
    splits = spark.createDataFrame([("a", "test"), ("b", "train")], "sample_id string, split string")
    members = spark.createDataFrame([("g", "test", "a"), ("h", "train", "b")], "group_id string, split string, sample_id string")
    cells = spark.createDataFrame([("a", 2.5)] * 100 + [("a", 3.5), ("b", 2.5)], "sample_id string, v double")
    assets = spark.createDataFrame([(0, 0)], "missing long, extra long")
    status = lambda *tables: {r.finding: (r.status, r.overall) for r in audit.findings(audit.audit_metrics(*tables)).collect()}
    ready, blocked = "ready_with_known_gaps", "blocked"
    good = status(samples, splits, members, splits, cells, assets)
    assert good == {"DQ-001": ("pass", ready), "DQ-002": ("pass", ready), "DQ-003": ("pass", ready), "DQ-004": ("warning", ready), "DQ-005": ("warning", ready), "DQ-006": ("pass", ready)}
    assert status(samples, splits, members, None, cells, assets)["DQ-002"] == ("fail", blocked)
    assert status(samples, splits, members, splits.selectExpr("sample_id", "'train' AS split"), cells, assets)["DQ-002"] == ("fail", blocked)
    for bad in (splits.filter("sample_id = 'a'"), splits.union(splits), splits.selectExpr("sample_id", "'train' AS split")):
        assert status(samples, bad, members, None, cells, assets)["DQ-001"] == ("fail", blocked)
    twice = members.union(spark.createDataFrame([("h", "train", "a")], members.schema))
    assert status(samples, splits, twice, splits, cells, assets)["DQ-001"] == ("fail", blocked)
    few = status(samples, splits, members, splits, cells.filter("v > 3"), assets.selectExpr("missing", "1L AS extra"))
    assert few["DQ-003"] == ("fail", ready) and few["DQ-006"] == ("fail", ready)
    r = audit.audit_metrics(samples, splits, members, splits, cells, assets).first()
    assert (r.labelled, r.estimated, r.models, r.test_pixels, r.test_high_pixels) == (2, 1, 1, 101, 100)


@pytest.mark.parametrize(("few", "bins"), [(4, 3), (1, 2), (4096, 1024)])
def test_quantiles(spark, few, bins):
    np = pytest.importorskip("numpy")
    rng = random.Random(4)
    rows = [("hot", rng.choice([rng.gauss(0, 1), 7.0, 1e300, -1e300, 1e-9 * rng.random()])) for _ in range(3000)]
    rows += [("small", 1.0), ("two", -1.0), ("two", 2.0), ("none", None), ("odd", float("nan")), ("odd", float("inf")), ("odd", 5.0), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    points = (0.0, 0.1, 0.5, 0.95, 1.0)
    for r in quantiles(df, "v", points, ["g"], few, bins).collect():
        own = [v for g, v in rows if g == r.g and v is not None and math.isfinite(v)]
        assert r.n == len(own)
        if own:
            assert (r.v_min, r.v_max) == (min(own), max(own)) and list(r.q) == pytest.approx(list(np.quantile(own, points)), rel=1e-12)
        else:
            assert r.q is None
    all_ = [v for _, v in rows if v is not None and math.isfinite(v)]
    assert list(quantiles(df, "v", points, (), few, bins).first().q) == pytest.approx(list(np.quantile(all_, points)), rel=1e-12)
    assert quantiles(df.filter("v > 1e308").filter("v < 0"), "v", points).first().n == 0


def test_snapshot(spark):
    then, now = (spark.createDataFrame(x, "name string, sha256 string") for x in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "9")]))
    assert {r.name: r.matches for r in audit.snapshot_matches(then, now).collect()} == {"a": True, "b": False, "c": False}



def test_bucketed_errors_of_small_samples_gather_once(spark, monkeypatch):
    """Samples of a few cells take no refinement of histograms, and give what it gives."""
    from lumenfold.operators import selection

    nan = float("nan")
    rows = [(f"s{k % 7}", "ab"[k % 7 % 2], (k * 37 % 101) / 20, (k * 53 % 97) / 30) for k in range(200)] + [("s8", "a", nan, 1.0), ("s8", "a", 2.0, 1.5), ("s9", "b", nan, 2.0)]
    cells = spark.createDataFrame(rows, "sample_id string, source string, prediction double, target double").repartition(3)
    read = lambda: {r.bucket: tuple(r)[1:] for r in metrics.bucketed_errors(cells).collect()}
    monkeypatch.setattr(metrics, "FEW", 0)
    refined = read()
    monkeypatch.undo()
    monkeypatch.setattr(metrics, "quantiles", None)
    assert str(read()) == str(refined)
    assert selection.largest_group(cells, ["sample_id"]) == 29
