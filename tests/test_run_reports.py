"""Run reports as their writer makes them, tables that cannot be used, and the throttle's state after silence."""

import json

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import labels, metrics
from lumenfold.sources import manifests
from lumenfold.streaming import jobs


def one_file(**over):
    """A file result with every field of the writer."""
    whole = dict.fromkeys("sensor_width sensor_height target_width target_height decoded_width decoded_height requested_crop_width requested_crop_height delivered_crop_width delivered_crop_height width height".split(), 100)
    return {
        "input": "/in/a.dng", "output": "/out/a-hdr.heic", "success": True, "skipped": False, "self_verified": True, "message": "", **whole,
        "target_dimensions_applied": True, "default_crop_present": False, "decode_degraded": False, "input_domain": "scene", "input_headroom": 1.0,
        "decode_degradation_reasons": ["crop", "half"], "exposure_ev": 0.5, "headroom_stops": 2.0, "gain_min": 0.0, "gain_max": 2.0, "decode_ms": 5.0, "process_ms": 7.0, "encode_ms": 1.0,
        "look": {"exposure_ev": 0.5, "ev100": 12.0, "target_middle_gray": 0.18},
        "render": {"headroom_stops": 2.0, "headroom_linear": 4.0, "rendered_peak": 3.5, "headroom_utilization": 0.8, "below_knee_relative_difference_max": 0.0, "wide_gamut_fraction": 0.25, "wide_gamut_pixels": 25, "wide_gamut_eligible_pixels": 100, "wide_gamut_luminance_threshold": 0.02},
        "gain_map": {"gamma": 1.0, "min_stops": 0.0, "max_stops": 1.75, "percentiles_stops": {k: 0.5 for k in ("p50", "p75", "p90", "p95", "p99", "p99_9", "p99_99", "max")}, "fraction_gt_0_5": 0.5, "fraction_gt_1_0": 0.25, "fraction_gt_2_0": 0.0, "clipped_fraction": 0.0, "local_weight_mean": 0.5, "local_weight_p95": 0.9},
        **over,
    }


def test_reports_and_their_problems(spark, tmp_path):
    write = lambda name, v: (tmp_path / name).write_text(v if isinstance(v, str) else json.dumps(v, indent=1))
    lost = one_file(input="b", success=False, message="broken", render=None, gain_map=None, decode_ms=None)
    short = one_file(input="c", decode_degraded=True, decoded_width=50, encode_ms=4.0)
    write("a.json", {"schema": 8, "tool": "1.2", "settings": {"depth": 10, "encoding": "hlg"}, "raw_processing": {"digital_gain": 1.0}, "files": [one_file(), lost]})
    write("b.json", {"schema": 7, "tool": "1.1", "files": [short], "novel": 1})
    write("c.json", {"schema": 9, "files": [one_file()]})
    write("d.json", "{ not json")
    write("e.json", {"schema": 8, "tool": "1.2"})
    write("f.json", {"schema": 8, "files": [one_file(extra_ms=1)]})
    rows = manifests.read_reports(spark, str(tmp_path))
    got = {(r.report[-6:], r.input): r for r in rows.collect()}
    assert set(got) == {("a.json", "/in/a.dng"), ("a.json", "b"), ("b.json", "c"), ("f.json", "/in/a.dng")}
    first = got["a.json", "/in/a.dng"]
    assert (first.total_ms, first.settings["depth"], first.render.wide_gamut_pixels, first.gain_map.percentiles_stops.p99_9, first.decode_degradation_reasons) == (13.0, "10", 25, 0.5, ["crop", "half"])
    assert got["a.json", "b"].total_ms == 8.0 and got["a.json", "b"].render is None
    problems = sorted((r.report[-6:], r.file, r.reason, r.field) for r in manifests.report_problems(spark, str(tmp_path)).collect())
    assert problems == [
        ("b.json", None, "unknown field", "novel"), ("c.json", None, "unknown version", "9"), ("d.json", None, "not a report", None),
        ("e.json", None, "no files", None), ("f.json", 0, "unknown field", "extra_ms"),
    ]
    counts, summary = metrics.run_summary(rows.filter("report LIKE '%a.json' OR report LIKE '%b.json'"))
    assert tuple(counts.first()) == (2, 1)
    s = {r.metric: r for r in summary.collect()}
    assert (s["total_ms"].n, s["total_ms"].x_min, s["total_ms"].p50, s["total_ms"].x_max, s["total_ms"].x_mean) == (2, 13.0, 13.0, 16.0, 14.5)
    assert s["gain_max_stops"].x_mean == 1.75 and s["rendered_peak"].n == 2 and len(s) == 8
    short_rows = labels.degraded_decodes(rows).collect()
    assert [(r.input, r.degradation) for r in short_rows] == [("c", "short of target")]


def test_bad_tables_have_reasons(spark, tmp_path):
    for name, text in (("good", "3\n0 1 2"), ("count", "4 0 1 2"), ("word", "2 0 x"), ("one", "1 5"), ("note", "2 # two\n0.5 1.5")):
        (tmp_path / f"{name}.lut").write_text(text)
    numbers = manifests.read_numbers(spark, str(tmp_path))
    name = F.regexp_extract("path", r"(\w+)\.lut$", 1).alias("name")
    assert {r.name for r in manifests.lut_table(numbers).select(name).distinct().collect()} == {"good", "note"}
    assert {(r.name, r.reason) for r in manifests.lut_problems(numbers).select(name, "reason").collect()} == {("count", "count"), ("word", "not a number"), ("one", "fewer than two samples")}
    (tmp_path / "s").mkdir()
    for n, text in (("a", "2 1 1 1.0 2.0"), ("b", "2 2 1 1.0"), ("c", "0 1 1"), ("d", "2"), ("e", "1 1 1 z")):
        (tmp_path / "s" / f"{n}.lut").write_text(text)
    shades = manifests.read_numbers(spark, str(tmp_path / "s"))
    assert {(r.name, r.reason) for r in manifests.shading_problems(shades).select(name, "reason").collect()} == {("b", "count"), ("c", "size"), ("d", "size"), ("e", "not a number")}
    assert manifests.shading_table(shades).count() == 2


def test_own_outputs_have_a_marker(spark, tmp_path):
    for n in ("a.DNG", "a-hdr.heic", "b-mine.heic", "c.jpg"):
        (tmp_path / n).write_bytes(b"x")
    names = lambda **how: [r.path.rsplit("/", 1)[1] for r in manifests.discover(spark, str(tmp_path), output_dir=str(tmp_path), **how).collect()]
    assert names() == ["a.DNG", "b-mine.heic", "c.jpg"] and names(marker="-mine") == ["a-hdr.heic", "a.DNG", "c.jpg"]
    out = spark.range(1).select(manifests.output_path(F.lit("/in/x/a.dng"), "/in", "/out", ".avif", marker="-mine")).first()[0]
    assert out == "/out/x/a-mine.avif"


def test_the_throttle_forgets(spark, tmp_path):
    jobs.use_state_store(spark)
    schema = "client long, event_id long, at double"
    source, state = str(tmp_path / "in"), str(tmp_path / "cp")

    def arrive(*rows):
        """One restart of the stream from its checkpoint."""
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        found = []
        stream = jobs.failure_throttle(spark.readStream.schema(schema).parquet(source), lateness="10 seconds")
        q = stream.writeStream.foreachBatch(lambda df, _: found.extend(map(tuple, df.collect()))).option("checkpointLocation", state).outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(found), q.lastProgress["stateOperators"][0]["numRowsTotal"]

    got, held = arrive(*[(1, k, 100.0 + k) for k in range(9)])
    assert [r[2:] for r in got] == [(k + 1, 60.0 if k >= 7 else 0.0) for k in range(9)] and held > 0
    assert arrive((1, 20, 120.0))[0] == [(1, 20, 10, 60.0)]  # the state survives a restart
    arrive((2, 30, 5000.0))
    got, held = arrive((2, 31, 9000.0))
    assert got == [(2, 31, 1, 0.0)]
    got, held = arrive((2, 32, 99000.0))
    again, last = arrive((3, 33, 999000.0))
    assert last <= held  # of silent clients nothing is left
    assert arrive((1, 40, 999001.0))[0] == [(1, 40, 1, 0.0)]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
