"""Boundaries, properties and golden values that the given tables do not show."""

import datetime
import hashlib
import json
import math
import random
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import expr as E
from lumenfold.operators import audit, bookkeeping, corpus, gain, labels, metrics, ranking, raster
from lumenfold.sources import f32grid, manifests, sinks, versions
from lumenfold.streaming import jobs


def test_session_gap_is_inclusive(spark):
    t = datetime.datetime(2024, 1, 1)
    half = datetime.timedelta(minutes=30)
    rows = [(1, "m", t), (2, "m", t + half), (3, "m", t + 2 * half + datetime.timedelta(microseconds=1)), (4, "m", None)]
    df = spark.createDataFrame(rows, "sample_id long, model string, capture_datetime timestamp_ntz")
    assert [tuple(r) for r in corpus.session_edges(df).collect()] == [(1, 2)]
    assert {r.sample_id: r.session for r in corpus.capture_sessions(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_near_pairs_at_the_limits(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        p, d = rng.getrandbits(63), rng.getrandbits(63)
        for flips in (0, 5, 6):
            q, e = p, d
            for b in rng.sample(range(63), flips):
                q ^= 1 << b
            for b in rng.sample(range(63), rng.choice([0, 6, 7])):
                e ^= 1 << b
            rows.append((len(rows), q, e))
    df = spark.createDataFrame(rows, "sample_id long, phash long, dhash long")
    got = {tuple(r) for r in corpus.near_pairs(df).collect()}
    bits = lambda a, b: bin(a ^ b).count("1")
    expected = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and bits(a[1], b[1]) <= 5 and bits(a[2], b[2]) <= 6}
    assert got == expected


def test_components_of_chains_and_cycles(spark):
    edges = [(k, k + 1) for k in range(1, 70)] + [(100, 101), (101, 102), (102, 100)] + [(200, 150)]
    nodes = spark.createDataFrame([(k,) for k in [*range(1, 71), 100, 101, 102, 150, 200, 999]], "sample_id long")
    got = {r.sample_id: r.root for r in corpus.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 1 for k in range(1, 71)) and got[102] == 100 and got[200] == 150 and got[999] == 999


def test_group_bridging_two_frozen_splits_conflicts(spark):
    members = spark.createDataFrame([(1, "g"), (2, "g"), (3, "h"), (4, "i")], "sample_id long, group_id string")
    frozen = spark.createDataFrame([(1, "train"), (2, "test"), (3, "test")], "sample_id long, split string")
    got = {r.group_id: (r.split, r.conflict) for r in corpus.assign_groups(members, frozen).collect()}
    assert got == {"g": (None, True), "h": ("test", False), "i": ("train", False)}


def test_negative_gain_is_in_the_lowest_band(spark):
    df = spark.createDataFrame([(-3.0,), (0.5,), (2.0,), (9.0,), (float("nan"),), (None,)], "v double")
    assert {r.band: r.n for r in audit.band_counts(df, "v").collect()} == {"0-1": 2, "1-2": 0, "2-3": 1, "3+": 1, "missing": 2}


def test_retention_keeps_the_newest(spark):
    df = spark.createDataFrame([(k, k, 1024) for k in range(8)], "entry long, modified long, size long")
    assert {r.entry for r in bookkeeping.retention(df, 4096).filter("delete").collect()} == {0, 1, 2, 3}


def test_transfer_round_trips(spark):
    df = spark.range(0, 101).select((F.col("id") / 100.0).alias("v"))
    pairs = [(E.srgb_to_linear, E.linear_to_srgb), (E.bt709_to_linear, E.linear_to_bt709), (E.hlg_to_linear, E.linear_to_hlg)]
    for there, back in pairs:
        assert df.select(F.max(F.abs(back(there(F.col("v"))) - F.col("v")))).first()[0] < 1e-3
    assert df.select(F.max(F.abs(E.linear_to_pq(E.pq_to_linear(F.col("v"))) - F.col("v")))).first()[0] < 1e-6


def test_hash_matches_plain_arithmetic(spark):
    def reference(v):
        v ^= v >> 16
        v = v * 0x7FEB352D & 0xFFFFFFFF
        v ^= v >> 15
        v = v * 0x846CA68B & 0xFFFFFFFF
        return v ^ v >> 16

    values = [random.Random(k).getrandbits(32) for k in range(200)]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", raster.hash32(F.col("v")).alias("h")).collect()
    assert all(r.h == reference(r.v) for r in got)


def test_tone_curve_is_monotone_and_inverts(spark):
    p = raster.tone_parameters(1.17, 0.08, 2 / 3, 0.48)
    rows = spark.range(0, 129).select((F.col("id") / 128.0 * 0.99).alias("t"))
    back = rows.select("t", raster.tone_curve(raster.inverse_tone(F.col("t"), p), 1.0, p).alias("b")).collect()
    assert max(abs(r.t - r.b) for r in back) < 2e-5
    ys = [r[0] for r in spark.range(0, 400).select(raster.tone_curve(F.col("id") / 50.0, 4.0, p)).collect()]
    assert all(b >= a for a, b in zip(ys, ys[1:]))


def test_golden_scene(spark):
    """The 192 x 128 test scene: a ten-stop ramp, a hue sweep and a bright disc; digest within the published tolerances."""
    w, h = 192, 128
    rows = []
    for y in range(h):
        v = y / (h - 1)
        for x in range(w):
            level = 0.002 * 2 ** (10 * x / (w - 1))
            rgb = [level * (0.55 + 0.45 * math.cos(6.2831853 * (v + k))) for k in (0, 0.333, 0.667)]
            if (x - w * 0.7) ** 2 + (y - h * 0.35) ** 2 <= (min(w, h) * 0.08) ** 2:
                rgb = [24.0] * 3
            rows.append((0, y, x, *rgb))
    pixels = spark.createDataFrame(pd.DataFrame(rows, columns=["image_id", "y", "x", "r", "g", "b"])).cache()
    images = spark.createDataFrame([(0, 1.0, 3.0, None)], "image_id long, exposure_ev double, headroom double, iso double")
    cells = gain.photographic_gain(pixels, images).checkpoint()
    stats = cells.select(F.avg("code"), F.max("gain_max"), F.max("code")).first()
    p95 = audit.floor_rank(cells, "code", (0.95,)).first().v
    assert stats[0] == pytest.approx(0.050364, abs=0.004) and stats[1] == pytest.approx(2.993880, abs=0.02) and stats[2] == pytest.approx(1.0, abs=0.004)
    assert p95 == pytest.approx(0.274510, abs=0.008)
    base = gain.render_base(pixels, images.drop("iso"), cells).select("r", "g", "b").toPandas().to_numpy().ravel()
    base.sort()
    assert base.mean() == pytest.approx(0.242810, abs=0.004)
    assert base[int(0.5 * (len(base) - 1))] == pytest.approx(0.032887, abs=0.003)


def test_box_mean_against_direct_sums(spark):
    rng = random.Random(5)
    grid = {(y, x): rng.random() for y in range(9) for x in range(7)}
    df = spark.createDataFrame([(0, y, x, v) for (y, x), v in grid.items()], "image_id long, gy int, gx int, v double")
    for r in raster.box_mean(df, "v", 2, "m").collect():
        near = [v for (y, x), v in grid.items() if abs(y - r.gy) <= 2 and abs(x - r.gx) <= 2]
        assert r.m == pytest.approx(sum(near) / len(near))


def test_spearman_uses_ordinal_ranks(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 1.0), (0, 1, 1.0, 2.0), (0, 2, 2.0, 3.0), (1, 0, 1.0, 1.0), (1, 1, 1.0, 2.0), (1, 2, 1.0, 3.0)], "g int, k int, x double, y double")
    got = {r.g: r for r in metrics.correlations(df, "x", "y", "k", ["g"]).collect()}
    assert got[0].spearman == pytest.approx(1.0) and got[1].pearson is None and got[1].spearman is None


def test_grid_source(spark, tmp_path):
    good = struct.pack("<6f", *[0.5 * k for k in range(6)])
    (tmp_path / "a.f32").write_bytes(good)
    (tmp_path / "a.json").write_text(json.dumps({"width": 3, "height": 2, "sha256": hashlib.sha256(good).hexdigest()}))
    (tmp_path / "b.f32").write_bytes(good[:-4])
    (tmp_path / "b.json").write_text(json.dumps({"width": 3, "height": 2}))
    (tmp_path / "c.f32").write_bytes(struct.pack("<f", float("nan")))
    (tmp_path / "c.json").write_text(json.dumps({"width": 1, "height": 1}))
    (tmp_path / "d.f32").write_bytes(good)
    f32grid.register(spark)
    rows = spark.read.format("f32grid").option("path", str(tmp_path)).load().collect()
    assert [(r.gy, r.v) for r in rows if r.image_id == "a"] == [(0, [0.0, 0.5, 1.0]), (1, [1.5, 2.0, 2.5])]
    (tmp_path / "e.f32").write_bytes(good)
    (tmp_path / "e.json").write_text('{"height": 2}')
    (tmp_path / "f.f32").write_bytes(good)
    (tmp_path / "f.json").write_text("{")
    errors = {"b": "byte length", "c": "not finite", "d": "no sidecar", "e": "bad sidecar", "f": "bad sidecar"}
    for df in (spark.read.format("f32grid").option("path", str(tmp_path)).load(), f32grid.read_grids(spark, str(tmp_path))):
        got = df.collect()
        assert sorted((r.gy, r.v) for r in got if r.image_id == "a") == [(0, [0.0, 0.5, 1.0]), (1, [1.5, 2.0, 2.5])]
        assert {r.image_id: r.error for r in got if r.error} == errors


def test_readers(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"sample_id": "a", "gain_map_present": true}\n\n{"sample_id": "b", "gain_map_present": false}\n')
    assert [r.sample_id for r in manifests.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()] == ["a"]
    (tmp_path / "m2.jsonl").write_text('{"sample_id": "a", "gain_map_present": true}\n' * 2)
    with pytest.raises(ValueError, match="2 times: a"):
        manifests.read_manifest(spark, str(tmp_path / "m2.jsonl"))
    (tmp_path / "lut.txt").write_text("3 # count\n0 0.5\n1.0\n")
    numbers = manifests.read_numbers(spark, str(tmp_path / "lut.txt"))
    assert [(r.k, r.v) for r in manifests.lut_table(numbers).orderBy("k").collect()] == [(0, 0.0), (1, 0.5), (2, 1.0)]
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a.DNG", "b.txt", "c-hdr.avif", "d.jpg"):
        (folder / name).write_bytes(b"x")
    names = lambda df: [r.path.rsplit("/", 1)[1] for r in df.collect()]
    assert names(manifests.discover(spark, str(folder))) == ["a.DNG", "c-hdr.avif", "d.jpg"]
    assert names(manifests.discover(spark, str(folder), output_dir=str(folder))) == ["a.DNG", "d.jpg"]
    runs = tmp_path / "runs" / "r1"
    runs.mkdir(parents=True)
    (runs / "config.json").write_text('{"architecture": "x", "seed": 3}')
    (runs / "history.jsonl").write_text('{"epoch": 1, "validation": {"mae": 0.5}}\n')
    got = manifests.read_histories(spark, str(tmp_path / "runs")).first()
    assert (got.run_dir, got.architecture, got.validation.mae) == ("r1", "x", 0.5)
    (tmp_path / "report.json").write_text(json.dumps({"schema": 8, "tool": "t", "files": [{"input": "a", "success": True, "decode_ms": 2.0}, {"input": "b", "success": False, "message": "no"}]}))
    assert [(r.input, r.success, r.message) for r in manifests.read_reports(spark, str(tmp_path / "report.json")).collect()] == [("a", True, None), ("b", False, "no")]


def test_publish_all_or_nothing(spark, tmp_path):
    one, none = spark.range(3), spark.range(0)
    assert sinks.publish(spark, {"t": one}, [("bad", one)], str(tmp_path)) == ["bad"] and not list(tmp_path.iterdir())
    assert sinks.publish(spark, {"t": one, "u": one}, [("fine", none)], str(tmp_path)) == []
    assert versions.read_table(spark, str(tmp_path), "u").count() == 3
    sinks.freeze(one, str(tmp_path / "f"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.freeze(one, str(tmp_path / "f"))


def test_streaming_sessions_and_ingest(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [("m", t), ("m", t + datetime.timedelta(minutes=30)), ("m", t + datetime.timedelta(minutes=90)), ("m", t + datetime.timedelta(days=2))]
    spark.createDataFrame(rows, "model string, capture_datetime timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("model string, capture_datetime timestamp").parquet(str(tmp_path / "in"))
    q = jobs.capture_sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.captures for r in spark.table("sessions").collect()) == [1, 2]
    batch = spark.createDataFrame([("a", 1), ("b", 2)], "input string, size long")
    seen = []
    run = lambda df: seen.extend(sorted(r.input for r in df.collect()))
    state = str(tmp_path / "state")
    assert jobs.ingest_batch(batch, state, "input", ["size"], run) == 2
    again = spark.createDataFrame([("a", 1), ("b", 3)], "input string, size long")
    assert jobs.ingest_batch(again, state, "input", ["size"], run) == 1 and seen == ["a", "b", "b"]


def test_batch_throttle(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [("c", k, t + datetime.timedelta(seconds=10 * k)) for k in range(9)] + [("c", 9, t + datetime.timedelta(seconds=380))]
    df = spark.createDataFrame(rows, "client string, event_id int, at timestamp")
    got = {r.event_id: r.locked_seconds for r in bookkeeping.failure_throttle(df).collect()}
    assert got[6] == 0 and got[7] == 60 and got[8] == 60 and got[9] == 0


def test_more_readers(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"split": "train", "sample_ids": ["a", "b"]}, indent=1))
    (tmp_path / "t.json").write_text(json.dumps({"split": "test", "sample_ids": ["c"]}))
    assert sorted(map(tuple, manifests.read_splits(spark, str(tmp_path)).collect())) == [("a", "train"), ("b", "train"), ("c", "test")]
    (tmp_path / "u.json").write_text(json.dumps({"split": "test", "sample_ids": ["a"]}))
    with pytest.raises(ValueError, match="several splits: a"):
        manifests.read_splits(spark, str(tmp_path))
    groups = {"groups": [{"group_id": "g", "split": "train", "size": 2, "members": ["a", "b"]}, {"group_id": "h", "split": "test", "size": 1, "members": ["c"]}]}
    (tmp_path / "groups").mkdir()
    (tmp_path / "groups" / "g.json").write_text(json.dumps(groups, indent=2))
    assert sorted(map(tuple, manifests.read_groups(spark, str(tmp_path / "groups")).collect())) == [("g", "train", "a"), ("g", "train", "b"), ("h", "test", "c")]
    (tmp_path / "p.tsv").write_text("a\tnative\t00ff\nb\tlegacy\tzz\n")
    assert [(r.sample_id, r.corpus, r.payload and bytes(r.payload)) for r in manifests.read_payloads(spark, str(tmp_path / "p.tsv")).collect()] == [("a", "native", b"\x00\xff"), ("b", "legacy", None)]
    (tmp_path / "shade.txt").write_text("2 1 2 # w h c\n1.0 1.5\n2.0 2.5\n")
    table = manifests.shading_table(manifests.read_numbers(spark, str(tmp_path / "shade.txt")))
    assert sorted((r.channel, r.y, r.x, r.gain) for r in table.collect()) == [(0, 0, 0, 1.0), (0, 0, 1, 2.0), (1, 0, 0, 1.5), (1, 0, 1, 2.5)]
    for name in ("raw/a.png", "raw/b.png", "labels/a.f32", "labels/a.json"):
        (tmp_path / "assets" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "assets" / name).write_bytes(b"x")
    inventory = manifests.asset_inventory(spark, str(tmp_path / "assets"), {"gain": ("raw", ".png"), "label": ("labels", ".f32")})
    assert sorted(map(tuple, inventory.collect())) == [("gain", "a"), ("gain", "b"), ("label", "a")]


def test_failure_and_audit_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("b", "bad")], "sample_id string, reason string")
    good, bad = rows.filter("reason IS NULL"), rows.filter("reason IS NOT NULL")
    assert sinks.publish(spark, {"m": good}, [("failures", bad)], str(tmp_path)) == ["failures"] and not list(tmp_path.iterdir())
    assert sinks.publish(spark, {"headline": good, "findings": bad}, [], str(tmp_path)) == []
    assert versions.read_table(spark, str(tmp_path), "findings").count() == 1


def test_ranks_over_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", "b"]), rng.randrange(40), k) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    expected, last = {}, {}
    for g, v, k in ordered:
        expected[k] = (sum(1 for r in ordered if r[0] == g and (r[1], r[2]) <= (v, k)), last.get(g))
        last[g] = k
    assert {r.k: r["rank"] for r in ranking.with_rank(df, ["g"], ["v", "k"]).collect()} == {k: r for k, (r, _) in expected.items()}
    got = {r.k: r.previous and r.previous.k for r in ranking.with_previous(df, ["g"], ["v", "k"], ["k"]).collect()}
    assert got == {k: p for k, (_, p) in expected.items()}
    whole = {r.k: r["rank"] for r in ranking.with_rank(df, [], ["v", "k"]).collect()}
    assert whole == {k: n for n, (_, k) in enumerate(sorted((r[1], r[2]) for r in rows), 1)}


def test_floor_rank_of_a_whole_table(spark):
    values = [random.Random(k).randrange(500) / 7 for k in range(1001)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    got = {r.p: r.v for r in audit.floor_rank(df, "v", (0.0, 0.5, 0.95, 1.0)).collect()}
    assert got == {p: sorted(values)[int(p * 1000)] for p in (0.0, 0.5, 0.95, 1.0)}


def test_gamma_choice_samples_large_images(spark):
    """Over 65536 cells only evenly spaced ones count; the choice is that of the same formula over those cells."""
    n = 90_000
    cells = spark.range(n).selectExpr("0 AS image_id", "cast(id DIV 300 AS int) AS gy", "cast(id % 300 AS int) AS gx", "pow((id * 7919 % 90001) / 90001, 3) AS v")
    v = [pow((k * 7919 % 90001) / 90001, 3) for k in ((2 * i + 1) * n // (2 * 65536) for i in range(65536))]

    def error(g):
        return sum((1 + 0.15 / (q + 0.05)) * (pow(math.floor(pow(q, g) * 255 + 0.5) / 255, 1 / g) - q) ** 2 for q in v)

    errors = {g: error(g) for g in raster.GAMMAS}
    best = min(errors, key=errors.get)
    assert raster.choose_gamma(cells).first().gamma == (1.0 if errors[1.0] <= errors[best] * 1.01 else best)


def test_scene_statistics_step_over_large_images(spark):
    w, h = 700, 601  # 420,700 pixels: every second one counts
    px = spark.range(w * h).selectExpr("'a' AS image_id", f"cast(id DIV {w} AS int) AS y", f"cast(id % {w} AS int) AS x", "(id % 997 + 1) / 100 AS v").selectExpr("image_id", "y", "x", "v AS r", "v AS g", "v AS b")
    got = raster.scene_statistics(px).first()
    s = sorted((k % 997 + 1) / 100 for k in range(0, w * h, 2))
    at = lambda p: s[int(p * (len(s) - 1))]
    low, high = at(0.001), at(0.999)
    assert got.samples == len(s) and got.p995 == pytest.approx(at(0.995))
    assert got.log_average == pytest.approx(math.exp(sum(math.log(min(max(v, low), high)) for v in s) / len(s)))


def test_leaked_columns_and_subsets(spark):
    df = spark.createDataFrame([("a", 1.0)], "sample_id string, GPS double")
    assert labels.leaked_columns(df) == ["GPS"]
    with pytest.raises(ValueError, match="unknown label subset"):
        labels.label_subset(df, "other")
    sizes = spark.createDataFrame([(4000, 3000), (10, 3000), (513, 257)], "w int, h int")
    even, away = labels.aligned_size(F.col("w"), F.col("h"), 512), labels.aligned_size(F.col("w"), F.col("h"), 512, half_even=False)
    assert [tuple(r) for r in sizes.select(*even).collect()] == [(512, 384), (16, 512), (512, 256 + 16 * (round(257 * 512 / 513) > 256))]
    assert sizes.select(*away).count() == 3


def streamed(spark, tmp_path, rows, schema, make, name):
    """The rows as one file each, in order, through a stream."""
    for k, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(str(tmp_path / f"in{k:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).option("recursiveFileLookup", True).parquet(str(tmp_path))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_streaming_idle_expiry_and_statistics(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    hours = datetime.timedelta(hours=1)
    rows = [("a", t), ("b", t + 2 * hours), ("a", t + 3 * hours), ("p", t + 4 * hours), ("c", t + 90 * hours), ("d", t + 200 * hours)]
    protected = spark.createDataFrame([("p",)], "session string")
    got = streamed(spark, tmp_path / "idle", rows, "session string, at timestamp", lambda s: jobs.idle_expiry(s, protected), "idle")
    assert {(r.session, r["last"]) for r in got} >= {("a", t + 3 * hours), ("b", t + 2 * hours)} and "p" not in {r.session for r in got}
    values = [(t + k * hours / 4, "decode", float(k)) for k in range(12)] + [(t + 50 * hours, "decode", 0.0)]
    stats = streamed(spark, tmp_path / "stats", values, "at timestamp, kind string, ms double", lambda s: jobs.running_statistics(s, "at", "kind", "ms"), "stats")
    by_hour = {r.start: r for r in stats}
    assert [(by_hour[t + k * hours].n, by_hour[t + k * hours].worst, by_hour[t + k * hours]["q"][0]) for k in range(3)] == [(4, 3.0, 1.0), (4, 7.0, 5.0), (4, 11.0, 9.0)]


def test_streaming_throttle_agrees_with_its_batch_twin(spark, tmp_path):
    rng = random.Random(2)
    at, rows = 1000, []  # the epoch itself is behind any watermark
    for k in range(40):
        at += rng.choice([0, 0, 5, 40])
        rows.append((rng.choice([1, 1, 2]), k, float(at)))
    jobs.use_state_store(spark)
    got = streamed(spark, tmp_path, rows, "client long, event_id long, at double", jobs.failure_throttle, "throttle")
    batch = bookkeeping.failure_throttle(spark.createDataFrame(rows, "client long, event_id long, at double").withColumn("at", F.timestamp_seconds("at")))
    assert {(r.client, r.event_id, r.recent, float(r.locked_seconds)) for r in got} == {(r.client, r.event_id, r.recent, float(r.locked_seconds)) for r in batch.collect()}
