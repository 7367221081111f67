"""Raster jobs that SQL does not express, against numpy written from their formulas."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenfold.operators import gain, hashes, raster

P3 = np.array([0.2289746, 0.6917385, 0.0792869])


def frame(spark, images, names):
    parts = []
    for k, planes in images.items():
        y, x = np.indices(planes[0].shape)
        parts.append(pd.DataFrame({"image_id": k, "y": y.ravel(), "x": x.ravel(), **{n: p.ravel() for n, p in zip(names, planes, strict=True)}}))
    return spark.createDataFrame(pd.concat(parts)).repartition(3)


def area(g, out_h, out_w):
    def shares(n, out):
        m = np.zeros((out, n))
        for i in range(n):
            low, high = i * out / n, (i + 1) * out / n
            for k in range(int(low), min(out, math.ceil(high))):
                m[k, i] = max(0, min(high, k + 1) - max(low, k))
        return m / m.sum(axis=1, keepdims=True)

    return shares(g.shape[0], out_h) @ g @ shares(g.shape[1], out_w).T


def signed(bits):
    v = int("".join("1" if b else "0" for b in bits), 2)
    return v - (1 << 64) if v >> 63 else v


def test_perceptual_hashes(spark):
    rng = np.random.default_rng(7)
    images = {k: [rng.random(size) + np.linspace(0, k, size[1])] for k, size in enumerate([(64, 64), (37, 23), (32, 32), (100, 41), (8, 9)])}
    got = {r.image_id: (r.phash, r.dhash) for r in raster.area_hashes(frame(spark, images, ["luma"])).collect()}
    n = np.arange(32)
    dct = np.array([np.sqrt((1 if u == 0 else 2) / 32) * np.cos(np.pi * (2 * n + 1) * u / 64) for u in range(32)])
    assert np.allclose(dct @ dct.T, np.eye(32))
    for k, (g,) in images.items():
        low = (dct @ area(g, 32, 32) @ dct.T)[:8, :8]
        wide = area(g, 8, 9)
        assert got[k] == (signed((low >= np.median(low.ravel()[1:])).ravel()), signed((wide[:, 1:] >= wide[:, :-1]).ravel())), k


def shoulder(u, knee, ceiling):
    span = ceiling - knee
    return np.where(u <= knee, u, ceiling - span * np.exp(np.maximum(-(u - knee) / span, -80)))


def ceiling_for(target, peak, knee):
    low, high = knee + 1e-4, knee + 1
    while shoulder(peak, knee, high) < target:
        high = knee + 2 * (high - knee)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if shoulder(peak, knee, mid) < target else (low, mid)
    return (low + high) / 2


def smooth(a, b, x):
    t = np.clip((x - a) / (b - a), 0, 1)
    return t * t * (3 - 2 * t)


def fitted(rgb):
    peak, y = rgb.max(axis=-1, keepdims=True), (rgb @ P3)[..., None]
    t = np.clip((1 - y) / np.where(peak == y, 1, peak - y), 0, 1)
    return np.where(peak <= 1, np.clip(rgb, 0, 1), np.where(y >= 1, 1.0, np.clip(y + t * (rgb - y), 0, 1)))


def test_display_hdr(spark):
    rng = np.random.default_rng(8)
    sizes = {0: (8, 8), 1: (10, 14), 2: (6, 20)}
    images = {k: [2.0 ** rng.uniform(-6, 2, size) for _ in range(3)] for k, size in sizes.items()}
    meta = {0: (2.0, 1.0), 1: (2.0, 2.0), 2: (0.0, 0.0)}
    df = spark.createDataFrame([(k, *v) for k, v in meta.items()], "image_id long, available double, output double")
    base, cells = (d.toPandas() for d in gain.display_hdr(frame(spark, images, "rgb"), df))
    level = 0.48
    knee = math.log2(level)
    for k, planes in images.items():
        rgb = np.stack(planes, axis=-1)
        available, output = meta[k]
        y = rgb @ P3
        log = np.log2(np.maximum(y, 1e-12))
        sdr, hdr = np.minimum(1, y), y
        if available > 1e-6:
            sdr = np.minimum(1, 2 ** shoulder(log, knee, ceiling_for(0.0, available, knee)))
            if output < available - 1e-6:
                hdr = 2 ** shoulder(log, knee, ceiling_for(output, available, knee))
        own = base[base.image_id == k].sort_values(["y", "x"])
        assert np.allclose(own[["r", "g", "b"]].to_numpy().reshape(rgb.shape), fitted(rgb * (sdr / y)[..., None]), atol=1e-7)
        raised = np.minimum(np.maximum(0, np.log2((hdr + 1e-6) / (sdr + 1e-6))), output) * smooth(level * 0.45, level * 1.05, sdr)
        field = np.where(sdr <= level, 0, raised)
        h, w = field.shape
        got = cells[cells.image_id == k].sort_values(["gy", "gx"])
        gh, gw = got.gy.max() + 1, got.gx.max() + 1
        assert len(got) == gh * gw
        edge = lambda i, n, out: i * n // out
        expected = [field[edge(i, h, gh) : edge(i + 1, h, gh), edge(j, w, gw) : edge(j + 1, w, gw)].mean() for i in range(gh) for j in range(gw)]
        assert np.allclose(got.gain, expected, atol=1e-7)


def test_display_sdr_brightened(spark):
    rng = np.random.default_rng(9)
    images = {k: [rng.random((7, 9)) * 1.3 for _ in range(3)] for k in range(3)}
    stops = {0: 0.0, 1: 0.5, 2: 1.25}
    df = spark.createDataFrame(list(stops.items()), "image_id long, exposure_ev double")
    got = gain.display_sdr(frame(spark, images, "rgb"), df).toPandas()
    knee = math.log2(0.48)
    for k, planes in images.items():
        rgb = np.stack(planes, axis=-1) * 2 ** stops[k]
        y = rgb @ P3
        scale = np.ones_like(y)
        if stops[k] > 1e-6:
            scale = np.minimum(1, 2 ** shoulder(np.log2(np.maximum(y, 1e-12)), knee, ceiling_for(0.0, stops[k], knee))) / y
        own = got[got.image_id == k].sort_values(["y", "x"])[["r", "g", "b"]].to_numpy().reshape(rgb.shape)
        assert np.allclose(own, fitted(rgb * scale[..., None]), atol=1e-7)


def test_tiled_filters_leave_no_trace_of_tiles(spark):
    """Local contrast and means of one wide image do not change at tile borders."""
    g = np.random.default_rng(10).random((3, 600))
    cells = frame(spark, {0: [g]}, ["v"]).selectExpr("image_id", "y AS gy", "x AS gx", "v")
    got = raster.box_mean(cells, "v", 3, "m").filter(F.col("gx").between(250, 262)).toPandas()
    for r in got.itertuples():
        assert abs(r.m - g[:, max(0, r.gx - 3) : r.gx + 4].mean()) < 1e-9


def test_perceptual_hashes_stream(spark):
    """Cells of an image are never rows, and an image in parts has the hashes that it has as a whole."""
    rng = np.random.default_rng(8)
    images = {f"i{k}": [rng.random(size)] for k, size in enumerate([(8, 8), (61, 40), (1, 1), (3, 70), (300, 5)])}
    pixels = frame(spark, images, ["luma"]).withColumn("luma", F.when(F.col("x") * 7 + F.col("y") != 12, F.col("luma"))).filter("NOT (x = 2 AND y = 1)")
    sizes = raster.image_sizes(pixels)
    whole = {r.image_id: (r.phash, r.dhash) for r in raster.area_hashes(pixels).collect()}
    assert len(whole) == 5
    for part in (1, 64, 500):
        assert {r.image_id: (r.phash, r.dhash) for r in hashes.area_hashes(pixels, sizes, "luma", part).collect()} == whole
    plan = raster.area_hashes(pixels)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
