"""Windows over cells of images of any size and of mixed sizes: tiles with a halo, and summed-area tables inside them.

An image is cut in tiles of TILE x TILE cells.  A cell goes to its own tile and, as halo, to the tiles that its window
reaches into, so a tile has all that its cells' windows hold; results of halo cells are dropped.  A task holds one tile
with its halo at a time, whatever the size of the image, and small tiles together up to HELD rows: tiles of one
shape are one array.  Inside a tile, sums over a window are four reads of a
table of running sums, so they cost the same for any radius, and each image may have its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

TILE = 256
#: Rows of whole tiles that a task works on together; one tile may be more.
HELD = 1 << 16


def by_tile(
    cells: DataFrame, radius: Column, values: Sequence[str], outs: Sequence[str], kernel: Callable, y: str = "gy", x: str = "gx", tile: int = TILE
) -> DataFrame:
    """The rows of cells with the columns outs: kernel(y, x, radius, values, tile) of whole tiles with their halos, as double arrays.

    radius is one number for an image; values are read as doubles, null as not a number.
    """
    names = cells.columns
    inner = {c: f"_tile_{c}" for c in ("group", "y", "x", "radius", "own")}
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col(inner["radius"])) / tile), F.floor((F.col(c) + F.col(inner["radius"])) / tile)))
    dealt = cells.withColumn(inner["radius"], radius.cast("long")).withColumn(inner["y"], span(y)).withColumn(inner["x"], span(x))
    own = (F.floor(F.col(y) / tile) == F.col(inner["y"])) & (F.floor(F.col(x) / tile) == F.col(inner["x"]))
    dealt = dealt.withColumn(inner["own"], own).withColumn(inner["group"], F.xxhash64("image_id", inner["y"], inner["x"]))
    dealt = dealt.repartition("image_id", inner["y"], inner["x"]).sortWithinPartitions(inner["group"], inner["y"], inner["x"])
    schema = StructType([*cells.schema.fields, *[StructField(o, DoubleType()) for o in outs]])
    keys = [inner[c] for c in ("group", "y", "x")]

    def finish(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        read = lambda c, kind: t.column(c).to_numpy().astype(kind)
        number = [t.column(v).cast(pa.float64()).fill_null(float("nan")).to_numpy() for v in values]
        k = np.stack([read(c, np.int64) for c in keys])
        which = np.cumsum(np.concatenate([[False], (k[:, 1:] != k[:, :-1]).any(axis=0)]))
        got = kernel(read(y, np.int64), read(x, np.int64), read(inner["radius"], np.int64), number, which)
        mask = t.column(inner["own"])
        out = t.select(names)
        for name, g in zip(outs, got, strict=True):
            out = out.append_column(name, pa.array(g, pa.float64(), from_pandas=True))
        yield from out.filter(mask).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        last, rows = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys])
            # where a tile begins; what is held is given out there once it is enough
            cuts = np.flatnonzero(np.concatenate([[last is None or tuple(k[:, 0].tolist()) != last], (k[:, 1:] != k[:, :-1]).any(axis=0)]))
            at = 0
            for cut in cuts.tolist():
                if rows + cut - at >= HELD:
                    if cut > at:
                        parts.append(b.slice(at, cut - at))
                    yield from finish(parts)
                    parts, rows, at = [], 0, cut
            parts.append(b.slice(at))
            rows += b.num_rows - at
            last = tuple(k[:, -1].tolist())
        if parts:
            yield from finish(parts)

    return dealt.mapInArrow(run, schema)


def window_sums(
    y: np.ndarray, x: np.ndarray, radius: int | np.ndarray, values: list[np.ndarray], tile: np.ndarray | None = None
) -> tuple[np.ndarray, list[np.ndarray]]:
    """(cells, sums of each value) of the square window around each cell, of the cells of its tile that are there.

    tile: 0, 1, .. in order; without it all cells are one tile's.
    """
    tile = np.zeros(len(y), np.int64) if tile is None else tile
    radius = np.broadcast_to(radius, y.shape)
    heads = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
    y, x = y - np.minimum.reduceat(y, heads)[tile], x - np.minimum.reduceat(x, heads)[tile]
    h, w = np.maximum.reduceat(y, heads) + 1, np.maximum.reduceat(x, heads) + 1
    values = [np.ones(len(y)), *values]
    out = [np.empty(len(y)) for _ in values]
    # tiles of one shape are one array
    shapes, shape = np.unique(np.stack([h, w], axis=1), axis=0, return_inverse=True)
    shape = shape.ravel()
    for k, (rows, columns) in enumerate(shapes.tolist()):
        alike = np.flatnonzero(shape == k)
        place = np.empty(len(heads), np.int64)
        place[alike] = np.arange(len(alike))
        use = np.flatnonzero(shape[tile] == k) if len(shapes) > 1 else np.arange(len(y))
        g, yy, xx, r = place[tile[use]], y[use], x[use], radius[use]
        y0, y1 = np.maximum(yy - r, 0), np.minimum(yy + r + 1, rows)
        x0, x1 = np.maximum(xx - r, 0), np.minimum(xx + r + 1, columns)
        for v, sums in zip(values, out, strict=True):
            table = np.zeros((len(alike), rows + 1, columns + 1))
            np.add.at(table, (g, yy + 1, xx + 1), v[use])
            table = table.cumsum(axis=1).cumsum(axis=2)
            sums[use] = table[g, y1, x1] - table[g, y0, x1] - table[g, y1, x0] + table[g, y0, x0]
    return out[0], out[1:]


def box_kernel(limit: float = 64.0):
    """Means of the window; values are clamped to +-limit, and what is not finite counts as 0."""

    def kernel(y: np.ndarray, x: np.ndarray, radius: np.ndarray, values: list[np.ndarray], tile: np.ndarray) -> list[np.ndarray]:
        area, sums = window_sums(y, x, radius, [np.where(np.isfinite(v), np.clip(v, -limit, limit), 0.0) for v in values], tile)
        return [s / area for s in sums]

    return kernel
