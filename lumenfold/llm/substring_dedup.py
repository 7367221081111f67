"""Removal of long word sequences that occur earlier in the corpus, found by recompression.

A word goes when some window of `window` consecutive words over it has the same words as a window that starts
earlier: in a document with a smaller doc_id, or before it in the same document.  recompression.py names runs
and pairs of words in rounds, alike everywhere, and gives each window the symbol that every copy of the window
has inside; windows whose symbol occurs elsewhere meet by the hash of their words, see repeats.py.

Defined cases: a null text has no words; documents under `window` words keep everything; equal windows of rows
with one doc_id at one place do not remove each other; a row without doc_id counts as after all others; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import U, groups_of, ids_of, mix, segment_hash, text_buffer, words_of
from .recompression import window_symbols
from .repeats import SHARD_BYTES, Meeting, Windows, code_of, covered, ids_out, run_meeting

WINDOW = 20
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
SCHEMA_TEXT = SCHEMA + ", kept_text string"
_BASE = U(0x9E3779B97F4A7C15)


class State:
    def __init__(self, t: pa.Table):
        self.ids = ids_of(t.column("doc_id"))
        self.buf, self.offsets = text_buffer(t.column("text"))
        self.start, self.end, self.doc = words_of(self.buf, self.offsets)
        self.name = segment_hash(self.buf, self.start, self.end - self.start)

    def unit(self, rank: np.ndarray) -> np.ndarray:
        return rank

    def doc_of(self, word: np.ndarray) -> np.ndarray:
        return self.doc[word]

    def inside(self, word: np.ndarray) -> np.ndarray:
        """Place of a word in its document."""
        return word - np.searchsorted(self.doc, self.doc[word])


def window_hashes(name: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """64-bit hash of `window` word names from each place: a polynomial over prefix sums, finally mixed."""
    power = np.concatenate([np.ones(1, U), np.cumprod(np.full(len(name), _BASE))])
    inverse = pow(int(_BASE), -1, 1 << 64)
    back = np.concatenate([np.ones(1, U), np.cumprod(np.full(len(name), U(inverse)))])
    total = np.concatenate([np.zeros(1, U), np.cumsum(name * power[:-1])])
    return mix((total[first + window] - total[first]) * back[first])


def _look(t: pa.Table, buckets: int, window: int):
    s = State(t)
    first, key, place = window_symbols(s.name, s.doc, window)
    cut = np.concatenate([[True], (place[1:] != place[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.empty(0, bool)
    head = np.flatnonzero(cut)
    count = np.diff(np.append(head, len(key)))

    def windows(runs: np.ndarray):
        n = count[runs]
        k = np.repeat(head[runs] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        at = first[k]
        return window_hashes(s.name, at, window), at

    return s, Windows(code_of(mix(key[head]), buckets), None, windows, s.doc[first[head]], s.doc_of)


class WordMeeting(Meeting):
    def _windows(self, state, w, runs):
        h, at = w.windows(runs)
        code = code_of(h, self.buckets)
        order = np.lexsort((state.inside(at), state.ids[state.doc_of(at)], h, code))
        return h, at, code, order, groups_of(h[order])


def _finish(with_text: bool):
    def run(s: State, lows: np.ndarray, highs: np.ndarray, window: int) -> pa.Table:
        docs = len(s.ids)
        gone = covered(lows, highs, window, len(s.start))
        words = np.bincount(s.doc, minlength=docs)
        removed = np.bincount(s.doc[gone], minlength=docs)
        kept = np.flatnonzero(~gone)
        start, end, doc = s.start[kept], s.end[kept], s.doc[kept]
        # Each kept word but a document's last is followed by one byte of space, the first of those behind it.
        follow = np.append(doc[1:] == doc[:-1], False) if len(doc) else np.empty(0, bool)
        n = int(s.offsets[-1])
        buf = s.buf[:n].copy()
        buf[end[follow]] = 32
        change = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(end + follow, minlength=n + 1)[: n + 1]
        mask = np.cumsum(change)[:n] > 0
        out = buf[mask]
        cut = np.concatenate([[0], np.cumsum(mask)])[s.offsets]
        parts = [out[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        columns = [ids_out(s.ids), pa.array(words), pa.array(removed), pa.array([hashlib.sha256(p.data).hexdigest() for p in parts], pa.string())]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        if with_text:
            columns.append(pa.array([p.tobytes().decode("utf-8") for p in parts], pa.string()))
            names.append("kept_text")
        return pa.table(columns, names=names)

    return run


def substring_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """One row per row: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space; with_text adds kept_text."""

    def look(t: pa.Table, buckets: int):
        return _look(t, buckets, window)

    def meeting(buckets: int) -> Meeting:
        return WordMeeting(look, _finish(with_text), buckets, window, True)

    return run_meeting(df, meeting, SCHEMA_TEXT if with_text else SCHEMA, id_col, text_col, shard_bytes)
