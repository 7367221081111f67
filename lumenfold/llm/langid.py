"""Language identification: multinomial logistic regression on TF-IDF character n-grams, FTRL with elastic net, temperature.

Texts become hashed n-grams of one to three lower-cased letters of any script (runs of other characters count as one space); inverse
document frequencies come from all training rows.  The weights are learned on a bounded sample: its shards each
run follow-the-regularised-leader with L1 and L2 penalties, which keeps most weights at zero, and the shards'
weights are averaged.  A temperature fitted on a part of the sample that the weights have not seen makes the
scores probabilities.

Defined cases: null texts and texts without a letter give `und` with score 0; ties go to the first language in
alphabetical order; repeated rows are predicted alike; without training rows every text is `und`; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import characters_of, text_buffer
from .common import fold, id_and_text

HELD_OUT_FOLDS = 5
DIM = 4096
ORDERS = (1, 2, 3)
#: The model is fitted on so many documents at most.
MAX_FIT = 12_000
SHARDS = 8
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
BATCH = 256


@cache
def letters() -> np.ndarray:
    """By code point: its lower-case letter, a space for whatever is no letter; marks stay with their letters."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for k in range(sys.maxunicode + 1):
        c = chr(k)
        if unicodedata.category(c)[0] in "LM":
            table[k] = ord(c.lower()[0])
    return table


def counts_of(column) -> np.ndarray:
    """n-gram counts, one row of DIM for each text."""
    buf, offsets = characters_of(column)
    docs, n = len(offsets) - 1, int(offsets[-1])
    out = np.zeros(docs * DIM, np.int64)
    if not n:
        return out.reshape(docs, DIM)
    b = letters()[buf[:n]]
    owner = np.repeat(np.arange(docs), np.diff(offsets))
    keep = np.ones(n, bool)
    keep[1:] = ~((b[1:] == 32) & (b[:-1] == 32) & (owner[1:] == owner[:-1]))
    b, owner = b[keep], owner[keep]
    h = np.zeros(len(b), np.uint32)
    for k in range(max(ORDERS)):
        if k >= len(b):
            break
        h = (h[: len(b) - k] * np.uint32(16777619) + b[k:]) if k else b
        if k + 1 in ORDERS:
            x = (h + np.uint32(k * 7919)) * np.uint32(2654435761)
            x ^= x >> np.uint32(15)
            whole = owner[: len(x)] == owner[k:]
            out += np.bincount(owner[: len(x)][whole] * DIM + (x[whole] % np.uint32(DIM)), minlength=docs * DIM)
    return out.reshape(docs, DIM)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf.astype(np.float32)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-9)


def ftrl(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal over the rows in their order, a small batch a step; (DIM + 1) x classes weights."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    z = np.zeros((x.shape[1], classes))
    n = np.zeros_like(z)
    l1 = np.full((x.shape[1], 1), L1)
    l1[-1] = 0

    def weights() -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for at in range(0, len(x), 16):
            part, w = x[at : at + 16], weights()
            p = softmax(part @ w)
            p[np.arange(len(part)), y[at : at + 16]] -= 1
            g = part.T @ p
            root = np.sqrt(n)
            n = n + g * g
            z = z + g - (np.sqrt(n) - root) / ALPHA * w
    return weights()


def softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]


def _frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and in how many each n-gram occurs: every task sends one vector in pieces of fixed size."""
    width = 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIM + width, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                total[:DIM] += (counts_of(part.column("text")) > 0).sum(axis=0)
                total[DIM] += part.num_rows
        rows = total.reshape(-1, width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], ["row", "sums"])

    def add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.int64) for x in t.column("sums").to_pylist()], axis=0)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["row", "sums"])

    rows = texts.select("text").mapInArrow(run, "row int, sums binary").groupBy("row").applyInArrow(add, "row int, sums binary").collect()
    total = np.zeros((DIM // width + 1, width), np.int64)
    for r in rows:
        total[r["row"]] = np.frombuffer(r["sums"], np.int64)
    return int(total[-1, 0]), total[:-1].ravel()


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from the rows outside fold 0 of 5 with a language: idf from all of them, weights from MAX_FIT at most."""
    known = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), HELD_OUT_FOLDS) != 0))
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([], np.zeros(DIM), np.zeros((DIM + 1, 0)))
    texts, often = _frequencies(known)
    idf = np.log((1 + texts) / (1 + often)) + 1
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(MAX_FIT)
    sample = (
        known.join(F.broadcast(chosen), "doc_id")
        .withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(SHARDS + 2)).cast("int"))
        .select("doc_id", "part", "lang", "text")
    )
    classes = len(languages)
    index = {v: k for k, v in enumerate(languages)}

    def learn(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        part = key[0].as_py()
        t = t.sort_by("doc_id")
        y = np.array([index[v] for v in t.column("lang").to_pylist()])
        x = np.vstack([tfidf(counts_of(t.slice(at, BATCH).column("text").combine_chunks()), idf) for at in range(0, t.num_rows, BATCH)])
        # the parts behind the shards are for calibration: they only send their rows' features on
        body = ftrl(x, y, classes).tobytes() if part < SHARDS else x.astype(np.float32).tobytes()
        return pa.table([pa.array([part], pa.int32()), pa.array([t.num_rows]), pa.array([body], pa.binary()), pa.array([y.astype(np.int64).tobytes()], pa.binary())], names=["part", "n", "body", "y"])

    weights, seen, held = np.zeros((DIM + 1, classes)), 0, []
    for r in sample.filter(F.col("part") < SHARDS).groupBy("part").applyInArrow(learn, "part int, n long, body binary, y binary").collect():
        weights += r["n"] * np.frombuffer(r["body"]).reshape(DIM + 1, classes)
        seen += r["n"]
    model = LanguageModel(languages, idf, weights / max(seen, 1))

    def logits(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        y = np.array([index[v] for v in t.column("lang").to_pylist()], np.int64)
        a = np.vstack([model.logits(tfidf(counts_of(t.slice(at, BATCH).column("text").combine_chunks()), idf)) for at in range(0, t.num_rows, BATCH)])
        return pa.table([pa.array([a.astype(float).tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["a", "y"])

    for r in sample.filter(F.col("part") >= SHARDS).groupBy("part").applyInArrow(logits, "a binary, y binary").collect():
        held.append((np.frombuffer(r["a"]).reshape(-1, classes), np.frombuffer(r["y"], np.int64)))
    if held:
        a, y = np.vstack([h[0] for h in held]), np.concatenate([h[1] for h in held])
        grid = np.exp(np.linspace(np.log(0.02), np.log(5), 80))
        loss = [-np.log(np.maximum(softmax(a / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def has_letter(column) -> np.ndarray:
    """Whether each text has a letter; bytes settle nearly all, Python's own table the rest."""
    buf, offsets = text_buffer(column)
    n = int(offsets[-1])
    plain = np.concatenate([[0], np.cumsum(((buf[:n] | 32) >= 97) & ((buf[:n] | 32) <= 122))])
    high = np.concatenate([[0], np.cumsum(buf[:n] >= 128)])
    out = plain[offsets[1:]] > plain[offsets[:-1]]
    for k in np.flatnonzero(~out & (high[offsets[1:]] > high[offsets[:-1]])).tolist():
        out[k] = any(c.isalpha() for c in buf[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "ignore"))
    return out


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], object)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                ok = has_letter(part.column("text")) & bool(model.languages)
                best, p = np.full(part.num_rows, len(names) - 1), np.zeros(part.num_rows)
                if ok.any():
                    q = softmax(model.logits(tfidf(counts_of(part.column("text")), model.idf)) / model.temperature)
                    best, p = np.where(ok, q.argmax(axis=1), best), np.where(ok, q.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(p.astype(float))], ["doc_id", "lang_pred", "score"])

    found = id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (fold(F.col("doc_id"), HELD_OUT_FOLDS) == 0).alias("held_out"), "lang_pred", "score")


def language_id(df: DataFrame, **columns) -> DataFrame:
    return predict(df, fit(df, **columns), **{k: v for k, v in columns.items() if k != "lang_col"})
