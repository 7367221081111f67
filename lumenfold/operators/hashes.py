"""Perceptual hashes of many grey images: cells summed while sorted pixels stream past.

Pixels are dealt by image and, where an image has over PART pixels, by parts of it.  A task keeps the cell sums of one
image, a few thousand numbers whatever its size, so cells are never rows.  An image of one part is hashed there; of larger
ones the parts' sums travel, and are added up and hashed in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

#: Pixels of an image that one task sums; cells and images that it holds at a time, at most.
PART, HELD = 1 << 16, 1 << 19
SIDE, LOW = 32, 8
WIDE, HIGH = 9, 8
#: A state's numbers: sums and weights of SIDE x SIDE cells, sums, weights and counts of HIGH x WIDE cells.
_CUTS = np.cumsum([0, SIDE * SIDE, SIDE * SIDE, HIGH * WIDE, HIGH * WIDE, HIGH * WIDE])


def _shares(at: np.ndarray, extent: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each place's range on n divisions of its extent: low, high, first division, divisions."""
    low, high = at * n / extent, (at + 1) * n / extent
    first = np.floor(low).astype(np.int64)
    return low, high, first, np.maximum(first, np.ceil(high).astype(np.int64) - 1) - first + 1


def _cell_sums(group: np.ndarray, groups: int, y, x, h, w, v: np.ndarray, known: np.ndarray, rows: int, columns: int, counted: bool) -> list[np.ndarray]:
    """By group and cell of a grid: sums of value times share, of shares and, if counted, how many values there are."""
    ylow, yhigh, yfirst, yn = _shares(y, h, rows)
    xlow, xhigh, xfirst, xn = _shares(x, w, columns)
    n = yn * xn
    i = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    gy, gx = yfirst[i] + k // xn[i], xfirst[i] + k % xn[i]
    share = (np.minimum(yhigh[i], gy + 1) - np.maximum(ylow[i], gy)) * (np.minimum(xhigh[i], gx + 1) - np.maximum(xlow[i], gx))
    cell = (group[i] * rows + gy) * columns + gx
    count = lambda weight: np.bincount(cell, weight, groups * rows * columns).reshape(groups, -1)
    return [count(v[i] * share), count(share), *([count(known[i].astype(float))] if counted else [])]


def states(group: np.ndarray, y, x, h, w, v: np.ndarray, known: np.ndarray) -> np.ndarray:
    """One row of sums for each group 0, 1, .. of pixels."""
    groups = int(group[-1]) + 1
    at = [a.astype(float) for a in (y, x, h, w)]
    return np.concatenate([*_cell_sums(group, groups, *at, v, known, SIDE, SIDE, False), *_cell_sums(group, groups, *at, v, known, HIGH, WIDE, True)], axis=1)


def _at_least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a >= b in Spark's order, where what is not a number comes last."""
    return (a >= b) | np.isnan(a)


def hashes_of(state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phash, dhash) of each row of sums."""
    s, d, few_s, few_d, few_n = (state[:, i:j] for i, j in zip(_CUTS[:-1], _CUTS[1:], strict=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        cell = np.where(d > 0, s / d, 0.0).reshape(-1, SIDE, SIDE)
        wide = (few_s / few_d).reshape(-1, HIGH, WIDE)
    # the orthonormal transform: its constant row has another weight, which decides about bits near the median
    u, k = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    basis = np.where(u == 0, math.sqrt(1 / SIDE), math.sqrt(2 / SIDE)) * np.cos(math.pi * (2 * k + 1) * u / (2 * SIDE))
    f = (basis @ cell @ basis.T).reshape(-1, LOW * LOW)
    median = np.sort(f[:, 1:], axis=1)[:, (LOW * LOW - 2) // 2]
    known = few_n.reshape(-1, HIGH, WIDE)
    on = _at_least(f, median[:, None]) & (known.sum(axis=(1, 2)) > 0)[:, None]
    there = few_d.reshape(-1, HIGH, WIDE) > 0
    step = np.zeros((len(state), HIGH, WIDE - 1), bool)
    last, told = wide[:, :, 0], there[:, :, 0] & (known[:, :, 0] > 0)
    for c in range(1, WIDE):
        valued = there[:, :, c] & (known[:, :, c] > 0)
        step[:, :, c - 1] = valued & told & _at_least(wide[:, :, c], last)
        # a cell without pixels is passed over
        last, told = np.where(there[:, :, c], wide[:, :, c], last), np.where(there[:, :, c], valued, told)
    bits = lambda b: np.packbits(b.reshape(len(b), 64), axis=1).view(">i8").ravel().astype(np.int64)
    return bits(on), bits(step)


def _pieces(b: pa.RecordBatch, weight: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold HELD cells and states together, a row at least."""
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    total, at = np.cumsum(weight + fresh * SIDE * SIDE), 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HELD, "right")))
        yield b.slice(at, to - at)
        at = to


class Runs:
    """Sums of the runs of equal _key of sorted batches; read(slice, group) gives the states of a slice's groups.

    add() and end() give (image_id, parts, state) of the runs that are whole.
    """

    def __init__(self, read):
        self.read, self.held = read, None

    def add(self, whole: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        if not whole.num_rows:
            return
        for b in _pieces(whole, whole.column("_weight").to_numpy(), whole.column("_key").to_numpy()):
            key = b.column("_key").to_numpy()
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
            ids, parts, state = b.column("image_id").take(pa.array(start)), b.column("_parts").to_numpy()[start], self.read(b, group)
            if self.held is not None:
                if self.held[0] == key[0]:
                    state[0] += self.held[3][0]
                else:
                    yield self.held[1:]
            if len(start) > 1:
                yield ids[:-1], parts[:-1], state[:-1]
            self.held = key[-1], ids[-1:], parts[-1:], state[-1:].copy()

    def end(self) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        if self.held is not None:
            yield self.held[1:]


def area_hashes(pixels: DataFrame, sizes: DataFrame, value: str, part: int = PART) -> DataFrame:
    """(image_id, phash, dhash) of pixels(image_id, y, x, value) by sizes(image_id, w, h)."""
    rows = F.greatest(F.lit(1), F.floor(F.lit(part) / F.col("w"))).cast("long")
    x = pixels.join(sizes, "image_id").select(
        "image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("h").cast("long").alias("h"), F.col("w").cast("long").alias("w"),
        F.col(value).cast("double").alias("v"), F.ceil(F.col("h") / rows).cast("long").alias("_parts"), F.xxhash64("image_id", F.floor(F.col("y") / rows)).alias("_key"),
        ((F.ceil(F.lit(SIDE) / F.col("h")) + 1) * (F.ceil(F.lit(SIDE) / F.col("w")) + 1)).cast("long").alias("_weight"),
    )
    dealt = x.repartition("_key").sortWithinPartitions("_key", "y", "x")
    key = pixels.schema["image_id"]
    out = StructType([key, StructField("phash", LongType()), StructField("dhash", LongType())])
    partly = StructType([*out.fields, StructField("_parts", LongType()), StructField("_state", BinaryType())])

    def pixel_states(b: pa.RecordBatch, group: np.ndarray) -> np.ndarray:
        v = b.column("v")
        known = v.is_valid().to_numpy(zero_copy_only=False)
        return states(group, *(b.column(c).to_numpy() for c in ("y", "x", "h", "w")), v.fill_null(0.0).to_numpy(), known)

    def hashed(ids: pa.Array, parts: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
        body = [s.tobytes() if n > 1 else None for s, n in zip(state, parts.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(h) for h in hashes_of(state)), pa.array(parts), pa.array(body, pa.binary())], partly.names)

    def sum_pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(pixel_states)
        for b in batches:
            for run in runs.add(b):
                yield hashed(*run)
        for run in runs.end():
            yield hashed(*run)

    def part_states(b: pa.RecordBatch, group: np.ndarray) -> np.ndarray:
        total = np.zeros((int(group[-1]) + 1, int(_CUTS[-1])))
        for g, body in zip(group.tolist(), b.column("_state").to_pylist(), strict=True):
            total[g] += np.frombuffer(body)
        return total

    def sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(part_states)
        for b in batches:
            whole = b.column("_parts").to_numpy() == 1
            yield b.filter(pa.array(whole)).select(out.names)
            for run in runs.add(b.filter(pa.array(~whole))):
                yield hashed(*run).select(out.names)
        for run in runs.end():
            yield hashed(*run).select(out.names)

    summed = dealt.mapInArrow(sum_pixels, partly)
    by_image = summed.withColumn("_key", F.xxhash64("image_id")).withColumn("_weight", F.lit(SIDE * SIDE).cast("long"))
    return by_image.repartition("_key").sortWithinPartitions("_key").mapInArrow(sum_parts, out)
