"""Quality scores: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration.

Every whole text becomes a few statistics (shares of letters, capitals, digits, signs; word and line lengths;
repeated lines and words).  Random cosine features of the standardised statistics approximate a Gaussian kernel;
each partition of the training rows sums its own normal equations and Spark adds them up; the ridge solution's
raw score is made monotone and calibrated on training rows by pooling adjacent violators.

Defined cases: null and empty texts have all-zero statistics and are scored like any; ties and repeated rows
score alike; without labels of both kinds every score is the share of label 1, or 0.5; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import groups_of, segment_hash, text_buffer, words_of
from .common import fold, id_and_text
from .components import ensure_checkpoint_dir

HELD_OUT_FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
FEATURES = 256
WIDTH = 4.0
RIDGE = 3.0
SEED = 20240
#: Bins of the raw score between which calibration pools: a bounded table whatever the number of rows.
BINS = 1000
STATS = 18


def statistics(column) -> np.ndarray:
    """STATS numbers for each whole text."""
    buf, offsets = text_buffer(column)
    docs, n = len(offsets) - 1, int(offsets[-1])
    kind = np.zeros(256, np.int64)  # 0 other sign, 1 lower, 2 upper, 3 digit, 4 space, 5 stop, 6 high byte, 7 newline
    kind[97:123], kind[65:91], kind[48:58], kind[[32, 9, 11, 12, 13]], kind[128:], kind[10] = 1, 2, 3, 4, 6, 7
    kind[[46, 44, 59, 58, 63, 39, 45]] = 5
    size = np.diff(offsets)
    owner = np.repeat(np.arange(docs, dtype=np.int64), size)
    share = np.bincount(owner * 8 + kind[buf[:n]], minlength=docs * 8).reshape(docs, 8) / np.maximum(size, 1)[:, None]
    start, end, doc = words_of(buf, offsets)
    words = np.bincount(doc, minlength=docs)
    length = (end - start).astype(float)
    per = np.maximum(words, 1)
    mean = np.bincount(doc, length, docs) / per
    square = np.bincount(doc, length * length, docs) / per
    name = segment_hash(buf, start, end - start)
    order = np.lexsort((name, doc))
    d, w = doc[order], name[order]
    fresh = np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])]) if len(d) else np.empty(0, bool)
    distinct = np.bincount(d[fresh], minlength=docs)
    heads = np.flatnonzero(fresh)
    times = np.diff(np.append(heads, len(d)))
    top = np.zeros(docs)
    np.maximum.at(top, d[heads], times)
    # lines
    line = np.zeros(n, bool)
    line[np.flatnonzero(buf[:n] == 10)] = True
    cut = np.union1d(np.flatnonzero(line) + 1, offsets[:-1][size > 0])
    cut = cut[cut < n]
    stop = np.append(cut[1:], n)
    line_doc = np.searchsorted(offsets, cut, "right") - 1
    h = segment_hash(buf, cut, np.maximum(stop - cut - line[stop - 1], 0)) if len(cut) else np.empty(0, np.uint64)
    lines = np.bincount(line_doc, minlength=docs)
    order = np.lexsort((h, line_doc))
    same = (h[order][1:] == h[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1]) if len(h) else np.empty(0, bool)
    again = np.bincount(line_doc[order][1:][same], minlength=docs) if len(h) else np.zeros(docs)
    last = buf[np.maximum(end - 1, 0)] if len(end) else np.empty(0, np.uint8)
    odd_end = np.bincount(doc, (kind[last] == 0).astype(float), docs) / per
    lone = np.bincount(doc, ((end - start == 1) & (kind[buf[start]] == 0)).astype(float), docs) / per if len(start) else np.zeros(docs)
    shout = np.bincount(doc, ((kind[buf[start]] == 2) & (kind[buf[np.maximum(end - 2, start)]] == 2) & (end - start > 2)).astype(float), docs) / per if len(start) else np.zeros(docs)
    out = np.column_stack([
        share, np.log1p(words), mean / 10, np.sqrt(np.maximum(square - mean * mean, 0)) / 10, distinct / per, top / per,
        again / np.maximum(lines, 1), odd_end, lone, shout, np.log1p(lines) - np.log1p(words),
    ])
    return np.nan_to_num(out[:, :STATS])


def with_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "stats"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, stats array<double>")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    edges: np.ndarray
    levels: np.ndarray
    prior: float

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.normal(0, 1 / WIDTH, (STATS, FEATURES))
        shift = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.sqrt(2 / FEATURES) * np.cos(np.clip((stats - self.mean) / self.scale, -8, 8) @ w + shift)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.prior)
        return np.interp(self.raw(stats), self.edges, self.levels)


def _matrix(column) -> np.ndarray:
    flat = column.flatten() if hasattr(column, "flatten") else column
    return np.asarray(flat, dtype=float).reshape(-1, STATS)


def pool_adjacent(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit: block centres and levels, ascending."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x.tolist(), y.tolist(), weight.tolist(), strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> QualityModel:
    """Learn from all labelled rows outside the held-out fold; what reaches the driver is sums of fixed size."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label"))
        .filter(F.col("label").isin(0.0, 1.0))
        .filter(fold(F.col("doc_id"), HELD_OUT_FOLDS) != HELD_OUT)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    train = stats.join(known, "doc_id")
    moments = train.agg(
        F.count("*").alias("n"), F.avg("label").alias("prior"),
        *[F.avg(F.col("stats")[k]).alias(f"m{k}") for k in range(STATS)],
        *[F.stddev_pop(F.col("stats")[k]).alias(f"s{k}") for k in range(STATS)],
    ).first()
    zero = np.zeros(STATS)
    if not moments["n"] or moments["prior"] in (0.0, 1.0):
        prior = 0.5 if moments["prior"] is None else float(moments["prior"])
        return QualityModel(zero, zero + 1, None, np.empty(0), np.empty(0), prior)
    mean = np.array([moments[f"m{k}"] for k in range(STATS)])
    scale = np.array([max(moments[f"s{k}"], 1e-6) for k in range(STATS)])
    model = QualityModel(mean, scale, None, np.empty(0), np.empty(0), float(moments["prior"]))
    width = FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((width, width + 1))
        for b in batches:
            if b.num_rows:
                z = model.fourier(_matrix(b.column("stats")))
                a += z.T @ np.hstack([z, np.asarray(b.column("label"), dtype=float)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array([r.tobytes() for r in a], pa.binary())], ["row", "sums"])

    def add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, float) for x in t.column("sums").to_pylist()], axis=0)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["row", "sums"])

    rows = train.select("stats", "label").mapInArrow(equations, "row int, sums binary").groupBy("row").applyInArrow(add, "row int, sums binary").collect()
    a = np.array([np.frombuffer(r["sums"], float) for r in sorted(rows, key=lambda r: r["row"])])
    penalty = np.diag([RIDGE] * FEATURES + [1e-6])
    model.weights = np.linalg.solve(a[:, :width] + penalty, a[:, width])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = model.raw(_matrix(b.column("stats")))
                k = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(raw), b.column("label")], ["bin", "raw", "label"])

    bins = (
        train.select("stats", "label").mapInArrow(binned, "bin int, raw double, label double")
        .groupBy("bin").agg(F.avg("raw").alias("x"), F.avg("label").alias("y"), F.count("*").alias("w")).orderBy("bin").collect()
    )
    x, y, w = (np.array([r[c] for r in bins], float) for c in "xyw")
    # One pseudo row at the prior in each bin keeps the ends from being certain.
    model.edges, model.levels = pool_adjacent(x, (y * w + model.prior) / (w + 1), w)
    return model


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    ensure_checkpoint_dir(df.sparkSession)
    stats = with_statistics(df, id_col, text_col).checkpoint()
    model = fit(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.clip(model.score(_matrix(b.column("stats"))), 0, 1))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (fold(F.col("doc_id"), HELD_OUT_FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
