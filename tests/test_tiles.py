"""Filters over tiles against direct sums, for images of mixed sizes, sparse grids and radii of their own."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import gain, raster, tiles

SIZES = {"small": (8, 8, 1), "odd": (5, 13, 3), "large": (500, 700, 20)}


def made(seed=0):
    rng = np.random.default_rng(seed)
    return {k: rng.normal(0, 1, (h, w)) for k, (h, w, _) in SIZES.items()}


def frame(spark, grids, **extra):
    parts = []
    for k, g in grids.items():
        y, x = np.indices(g.shape)
        parts.append(pd.DataFrame({"image_id": k, "gy": y.ravel(), "gx": x.ravel(), "v": g.ravel(), **extra}))
    return spark.createDataFrame(pd.concat(parts)).repartition(5)


def direct(g, r):
    h, w = g.shape
    table = np.zeros((h + 1, w + 1))
    table[1:, 1:] = g.cumsum(0).cumsum(1)
    y, x = np.indices(g.shape)
    y0, y1, x0, x1 = np.maximum(y - r, 0), np.minimum(y + r + 1, h), np.maximum(x - r, 0), np.minimum(x + r + 1, w)
    return (table[y1, x1] - table[y0, x1] - table[y1, x0] + table[y0, x0]) / ((y1 - y0) * (x1 - x0))


@pytest.mark.parametrize("tile", [256, 7])
def test_box_means_of_mixed_sizes(spark, tile):
    grids = made()
    if tile == 7:
        grids.pop("large")
    df = frame(spark, grids).withColumn("w", F.col("v") * 2)
    radius = F.coalesce(*[F.when(F.col("image_id") == k, F.lit(r)) for k, (_, _, r) in SIZES.items()])
    got = tiles.by_tile(df, radius, ["v", "w"], ["a", "b"], tiles.box_kernel(), tile=tile).toPandas()
    assert len(got) == sum(g.size for g in grids.values())
    for k, g in grids.items():
        own = got[got.image_id == k]
        means = direct(np.clip(g, -64, 64), SIZES[k][2])[own.gy, own.gx]
        assert np.allclose(own.a, means, atol=1e-9) and np.allclose(own.b, 2 * means, atol=1e-9)


def test_sparse_and_unusable_values(spark):
    rng = random.Random(1)
    cells = {(y, x): rng.choice([rng.random(), 1e9, float("inf"), None]) for y in range(-3, 20) for x in range(15) if rng.random() < 0.6}
    df = spark.createDataFrame([(7, y, x, v, "kept") for (y, x), v in cells.items()], "image_id long, gy int, gx int, v double, note string")
    clean = {k: 0.0 if v is None or v == float("inf") else min(v, 64.0) for k, v in cells.items()}
    for r in tiles.by_tile(df, F.lit(2), ["v"], ["m"], tiles.box_kernel(), tile=4).collect():
        near = [v for (y, x), v in clean.items() if abs(y - r.gy) <= 2 and abs(x - r.gx) <= 2]
        assert r.m == pytest.approx(sum(near) / len(near)) and r.note == "kept"


def test_guided_filter_has_each_images_radius(spark):
    rng = np.random.default_rng(2)
    grids = {"a": rng.random((30, 40)), "b": rng.random((600, 8)), "c": rng.random((6, 6))}
    df = frame(spark, grids).withColumnRenamed("v", "guide").withColumn("gain", F.col("guide") * 0.5 + 0.1).withColumn("global_gain", F.lit(0.4))
    got = raster.guided_filter(df).toPandas()
    for k, g in grids.items():
        r = min(8, max(4, min(g.shape) // 96))
        p = g * 0.5 + 0.1
        mi, mp, mii, mip = direct(g, r), direct(p, r), direct(g * g, r), direct(g * p, r)
        a = (mip - mi * mp) / (np.maximum(0, mii - mi * mi) + 5e-3)
        b = mp - a * mi
        expected = np.clip(direct(a, r) * g + direct(b, r), 0, 0.4)
        own = got[got.image_id == k]
        assert np.allclose(own.filtered, expected[own.gy, own.gx], atol=1e-9)


def test_lookup_needs_adjacent_cells(spark):
    grid = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 2, 3.0), ("a", 0, 3, 4.0)], "image_id string, gy int, gx int, v double")
    at = spark.createDataFrame([("a", 0, x) for x in range(4)], "image_id string, y int, x int")
    got = {r.x: r.v for r in raster.bilinear_lookup(at, grid, "v", tuple(F.lit(k) for k in (4, 1, 4, 1))).collect()}
    assert got == {0: 1.0, 1: None, 2: 3.0, 3: 4.0}
    between = {r.x: r.v for r in raster.bilinear_lookup(spark.createDataFrame([("a", 0, x) for x in range(8)], "image_id string, y int, x int"), grid, "v", tuple(F.lit(k) for k in (4, 1, 8, 1))).collect()}
    assert between[0] == 1.0 and between[1] is None and between[3] is None and between[5] == pytest.approx(3.25) and between[7] == 4.0


def test_render_all_of_mixed_sizes(spark):
    """Images of three sizes in one call give what each gives alone."""
    rng = np.random.default_rng(3)
    parts, rows = [], []
    for k, (h, w) in enumerate([(16, 16), (26, 10), (40, 70)] * 3):
        domain = ("scene", "display_sdr", "display_hdr")[k // 3]
        y, x = np.indices((h, w))
        parts.append(pd.DataFrame({"image_id": k, "y": y.ravel(), "x": x.ravel(), **{c: rng.random(h * w) * 3 for c in "rgb"}}))
        rows.append((k, domain, 0.5, 2.0, 1.5, 200.0))
    pixels = spark.createDataFrame(pd.concat(parts)).repartition(4)
    images = spark.createDataFrame(rows, "image_id long, domain string, exposure_ev double, headroom double, available double, iso double")
    base, gains = (df.toPandas().set_index(["image_id", *places]).sort_index() for df, places in zip(gain.render_all(pixels, images), (["y", "x"], ["gy", "gx"]), strict=True))
    assert len(base) == sum(len(p) for p in parts)
    for k in (1, 2, 8):
        one = gain.render_all(pixels.filter(F.col("image_id") == k), images.filter(F.col("image_id") == k))
        alone_base, alone_gains = (df.toPandas().set_index(["image_id", *places]).sort_index() for df, places in zip(one, (["y", "x"], ["gy", "gx"]), strict=True))
        assert np.allclose(base.loc[[k]][["r", "g", "b"]], alone_base[["r", "g", "b"]]) and np.allclose(gains.loc[[k]].gain, alone_gains.gain)


def test_small_tiles_are_worked_on_together(spark):
    """A task's small tiles of several shapes and radii are one call of the kernel, with each tile's own result."""
    rows = [(k, y, x, float((k * 7 + y * 3 + x) % 11)) for k in range(60) for y in range(2 + k % 3) for x in range(3 + k % 2)]
    df = spark.createDataFrame(rows, "image_id long, gy long, gx long, v double").repartition(1)
    calls = df.sparkSession.sparkContext.accumulator(0)
    box = tiles.box_kernel()

    def counted(*args):
        calls.add(1)
        return box(*args)

    got = tiles.by_tile(df, F.col("image_id") % 3, ["v"], ["m"], counted).collect()
    assert len(got) == len(rows) and calls.value <= 4  # partitions, not 60
    by = {r[:3]: r[3] for r in rows}
    for r in got:
        near = [v for (k, y, x), v in by.items() if k == r.image_id and abs(y - r.gy) <= k % 3 and abs(x - r.gx) <= k % 3]
        assert abs(r.m - sum(near) / len(near)) < 1e-9
