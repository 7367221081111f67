"""Removal of long byte strings that a document with a smaller id has too.

A byte goes when some `length`-byte string over it also starts in a document with a smaller doc_id.  Anchors
(the least-hashed 16-byte gram of each window, so equal windows have equal anchors) bring possible copies
together, see repeats.py; there a run-length index of the distinct surroundings, see run_index.py, streams
matching statistics and marks the windows with an earlier copy.  Every window is decided, whatever its content.

Defined cases: a null text is empty; texts under `length` bytes keep everything; repeats inside one document or
among rows with one doc_id are no reason to remove; a row without doc_id counts as after all others; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, groups_of, ids_of, loads8, mix, segment_hash, text_buffer
from .common import free_name
from .repeats import SHARD_BYTES, FREQUENT, Meeting, Windows, code_of, covered, ids_out, run_meeting

LENGTH = 50
GRAM = 16
CHUNK = 1 << 14
#: Low bits of a key, which hold a gram's place in its chunk.
PLACE = U((1 << 20) - 1)
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SCHEMA_TEXT = SCHEMA + ", kept_text string"


class State:
    def __init__(self, t: pa.Table):
        self.raw_ids = t.column("doc_id")
        self.ids = ids_of(self.raw_ids)
        self.buf, self.offsets = text_buffer(t.column("text"))

    def unit(self, rank: np.ndarray) -> np.ndarray:
        return rank

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1


def anchored_runs(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (first window, number of windows, anchor's place in the first, gram hash, document)."""
    n, span = int(offsets[-1]), length - GRAM + 1
    view = loads8(buf)
    index = np.arange(CHUNK + span, dtype=U)
    # one set of arrays for all chunks, small enough to stay in a core's cache
    words, keys, least = (np.empty(CHUNK + span + 8, U) for _ in range(3))
    starts, anchors, hashes = [], [], []
    for at in range(0, n - length + 1, CHUNK):
        grams = min(CHUNK, n - length + 1 - at) + span - 1
        w, h, x = words[: grams + 8], keys[:grams], least[:grams]
        np.copyto(w, view[at : at + grams + 8])
        np.multiply(w[:grams], U(0x9E3779B97F4A7C15), out=h)
        np.right_shift(h, U(29), out=x)
        h ^= x
        h += w[8:]
        h *= U(0xC2B2AE3D27D4EB4F)
        # The position stands in place of the hash's low bits, so the minimum tells where it is; of equal hashes the first.
        np.bitwise_and(h, ~PLACE, out=x)
        x |= index[:grams]
        done = 1
        while done < span:
            step = min(done, span - done)
            np.minimum(x[:-step], x[step:], out=x[:-step])
            x = x[:-step]
            done += step
        new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        place = (x[new] & PLACE).astype(np.int64)
        starts.append(new + at)
        anchors.append(place + at)
        hashes.append(h[place])
    if not starts:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, U), np.empty(0, np.int64))
    start, anchor, h = np.concatenate(starts), np.concatenate(anchors), np.concatenate(hashes)
    size = np.diff(offsets)
    first = offsets[:-1][size >= length]
    both = np.sort(np.concatenate([start, first]))
    both = both[groups_of(both)]
    k = np.searchsorted(start, both, "right") - 1
    doc = np.searchsorted(offsets, both, "right") - 1
    end = np.minimum(np.append(both[1:], n), offsets[doc + 1] - length + 1)
    real = (end > both) & (k >= 0)
    # A run that a chunk's border cuts in two stays two runs, so the border must not depend on the neighbours: join them.
    both, end, k, doc = both[real], end[real], k[real], doc[real]
    join = np.concatenate([[True], (anchor[k[1:]] != anchor[k[:-1]]) | (doc[1:] != doc[:-1])])
    head = np.flatnonzero(join)
    last = np.append(head[1:], len(both)) - 1
    return both[head], end[last] - both[head], anchor[k[head]] - both[head], h[k[head]], doc[head]


def _look(t: pa.Table, buckets: int, length: int):
    s = State(t)
    start, n, place, h, doc = anchored_runs(s.buf, s.offsets, length)

    def snippet(runs: np.ndarray):
        return start[runs], n[runs], place[runs]

    def windows(runs: np.ndarray):
        count = n[runs]
        at = np.repeat(start[runs] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        by_id = np.lexsort((at, s.ids[s.doc_of(at)]))
        at = at[by_id]
        return segment_hash(s.buf, at, np.full(len(at), length), 9), at

    return s, Windows(code_of(mix(h.copy()), buckets), snippet, windows, doc, s.doc_of)


class SuffixMeeting(Meeting):
    def _windows(self, state, w, runs):
        h, at = w.windows(runs)
        code = code_of(h, self.buckets)
        order = np.lexsort((state.ids[state.doc_of(at)], h, code))
        return h, at, code, order, np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]])) if len(h) else order


def _finish(with_text: bool):
    def run(s: State, lows: np.ndarray, highs: np.ndarray, length: int) -> pa.Table:
        n = int(s.offsets[-1])
        gone = covered(lows, highs, length, n)
        total = np.concatenate([[0], np.cumsum(gone, dtype=np.int32)]).astype(np.int64)
        removed = total[s.offsets[1:]] - total[s.offsets[:-1]]
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        starts = s.offsets[:-1][s.offsets[:-1] < n]
        rise[starts] = gone[starts]
        spans = np.diff(np.searchsorted(np.flatnonzero(rise), s.offsets))
        hashes, texts = [], []
        for a, b, r in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), removed.tolist(), strict=True):
            kept = s.buf[a:b] if not r else s.buf[a:b][~gone[a:b]]
            hashes.append(hashlib.sha256(kept.data).hexdigest())
            if with_text:
                texts.append(kept.tobytes().decode("utf-8", "ignore"))
        columns = [ids_out(s.ids), pa.array(np.diff(s.offsets)), pa.array(removed), pa.array(spans), pa.array(hashes, pa.string())]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        if with_text:
            columns.append(pa.array(texts, pa.string()))
            names.append("kept_text")
        return pa.table(columns, names=names)

    return run


def suffix_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False,
    shard_bytes: int = SHARD_BYTES, frequent: int = FREQUENT, carry: bool = False,
) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds kept_text, carry the other columns.

    kept_text drops the bytes of characters that a removed string cut in two, so that it is text again.
    """
    if not GRAM + 1 <= length <= GRAM + 60:
        raise ValueError("length: 17 to 76 bytes")

    def look(t: pa.Table, buckets: int):
        return _look(t, buckets, length)

    def meeting(buckets: int) -> Meeting:
        return SuffixMeeting(look, _finish(with_text), buckets, length, False, frequent, GRAM)

    return run_meeting(df, meeting, SCHEMA_TEXT if with_text else SCHEMA, id_col, text_col, shard_bytes, carry)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The input's rows and columns with the repeated strings taken out of the texts; a null text stays null."""
    mark = free_name(df, "had_text")
    found = suffix_dedup(df.withColumn(mark, F.col(text_col).isNotNull()), id_col, text_col, with_text=True, carry=True, **how)
    columns = {id_col: F.col("doc_id"), text_col: F.when(F.col(f"carried.{mark}"), F.col("kept_text"))}
    return found.select(*[columns.get(c, F.col(f"carried.`{c}`")).cast(df.schema[c].dataType).alias(c) for c in df.columns])
