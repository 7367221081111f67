"""Numpy helpers over the texts of an Arrow table: one byte buffer with offsets, words, hashes, packed columns."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa

U = np.uint64
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
NO_ID = np.iinfo(np.int64).max


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; h is changed in place."""
    h ^= h >> U(33)
    h *= _M2
    h ^= h >> U(29)
    h *= _M3
    h ^= h >> U(32)
    return h


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with 16 zero bytes behind, offsets) of a string column without nulls."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    bufs, ends = [], [np.zeros(1, np.int64)]
    at = 0
    for a in parts:
        if not len(a):
            continue
        kind = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
        off = np.frombuffer(a.buffers()[1], kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)
        data = a.buffers()[2]
        bufs.append(np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.empty(0, np.uint8))
        ends.append(off[1:] - off[0] + at)
        at = ends[-1][-1]
    return np.concatenate([*bufs, np.zeros(16, np.uint8)]), np.concatenate(ends)


def ids_of(column) -> np.ndarray:
    """int64 ids; a null id counts as the largest."""
    return column.combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64) if len(column) else np.empty(0, np.int64)


def loads8(buf: np.ndarray) -> np.ndarray:
    """An unaligned view: the 8 bytes from each position as a little-endian integer."""
    return np.ndarray((len(buf) - 7,), "<u8", buf.data, 0, (1,))


def segment_hash(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each buf[start : start + length]; buf has 8 spare bytes behind."""
    view = loads8(buf)
    h = length.astype(U) * _M1 + U(seed)
    live = np.flatnonzero(length > 0)
    at, left = start[live], length[live]
    while len(live):
        w = view[at]
        short = left < 8
        if short.any():
            w = np.where(short, w & ((U(1) << (np.minimum(left, 7).astype(U) * U(8))) - U(1)), w)
        x = (h[live] ^ w) * _M2
        x ^= x >> U(32)
        h[live] = x * _M3
        more = left > 8
        if more.all():
            at, left = at + 8, left - 8
        else:
            live, at, left = live[more], at[more] + 8, left[more] - 8
    return mix(h)


def fold_case(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    return out


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document index) of every run of bytes other than space and \\t..\\r; words end with their document."""
    n = int(offsets[-1])
    if not n:
        return (np.empty(0, np.int64),) * 3
    b = buf[:n]
    solid = (b != 32) & ((b < 9) | (b > 13))
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first = first[:n]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | first))
    last = np.zeros(n, bool)
    ends = offsets[1:] - 1
    last[ends[ends >= 0]] = True
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | last)) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def planes(a: np.ndarray, width: int | None = None) -> bytes:
    """The low `width` bytes of each value, byte plane after byte plane, so that a block compressor sees the zeros."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)
    return np.ascontiguousarray(raw[:, : width or a.itemsize].T).tobytes()


def from_planes(body: bytes, kind, width: int | None = None) -> np.ndarray:
    kind = np.dtype(kind)
    width = width or kind.itemsize
    raw = np.frombuffer(body, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], kind.itemsize), np.uint8)
    out[:, :width] = raw.T
    return out.view(kind).ravel()


def groups_of(key: np.ndarray) -> np.ndarray:
    """Start of each run of equal values of a sorted array."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)


def characters_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(code points with one zero behind, offsets) of a string column without nulls."""
    buf, offsets = text_buffer(column)
    n = int(offsets[-1])
    b = buf[:n]
    if not (b & 128).any():
        return buf, offsets
    lead = (b & 0xC0) != 0x80
    lead[offsets[:-1][offsets[:-1] < n]] = True
    at = np.flatnonzero(lead)
    wide = buf.astype(np.int32)
    b0, b1, b2, b3 = wide[at], wide[at + 1] & 63, wide[at + 2] & 63, wide[at + 3] & 63
    point = np.select(
        [b0 < 0xC0, b0 < 0xE0, b0 < 0xF0],
        [b0, (b0 & 31) << 6 | b1, (b0 & 15) << 12 | b1 << 6 | b2],
        np.minimum((b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3, sys.maxunicode),
    )
    return np.append(point, 0), np.concatenate([[0], np.cumsum(lead)])[offsets]
