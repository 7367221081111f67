"""A run-length index over many short texts: run-compressed Burrows-Wheeler transform with sampled run ends.

build() sorts the suffixes, keeps their transform as runs of one letter and, for each run, the text positions of the
suffixes at its first and last row; the suffix array goes.  matching_statistics() streams other texts through the
runs from their last letter to their first.  A text's state is a row, the text position of that row's suffix, and how
many letters of the text it matches.  Where the row's letter is the next one, one mapping step goes on; where it is
not, the nearest runs of that letter above and below are the only candidates, their sampled ends tell where their
suffixes lie, and the longer common extension with the present suffix decides.  All texts take a step side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .arrays import groups_of, loads8

#: Bytes and the end mark.
LETTERS = 257


@dataclass
class RunIndex:
    run_start: np.ndarray
    run_letter: np.ndarray
    run_base: np.ndarray  # row of the run's first letter after one mapping step
    start_at: np.ndarray  # text position of the suffix at the run's first row
    end_at: np.ndarray  # and at its last row
    by_letter: np.ndarray  # letter * runs + run, sorted
    text: np.ndarray  # the texts, a spare byte after each, and 64 at the end
    left: np.ndarray  # letters from each position to its text's end


def build(letters: np.ndarray, sizes: np.ndarray, tags: np.ndarray | None = None) -> RunIndex:
    """letters: the texts' bytes one after another; sizes: of each text.

    Texts with different tags have no letter in common: a letter is a tag and a byte, so one index serves many
    collections at once.
    """
    tags = np.zeros(len(sizes), np.int64) if tags is None else tags
    stops = np.cumsum(sizes + 1)
    total = int(stops[-1])
    text = np.zeros(total, np.int64)
    body = np.ones(total, bool)
    body[stops - 1] = False
    text[body] = letters.astype(np.int64) + 1  # 0 ends a text
    end = np.repeat(stops, sizes + 1)
    at = np.arange(total)
    wide = total + 258

    word = np.zeros(total, np.uint64)  # the first eight letters
    for k in range(8):
        word = word << np.uint64(8) | np.where(at + k < end, text[np.minimum(at + k, total - 1)] & 255, 0).astype(np.uint64)
    # a letter 255 does not occur in UTF-8, so the low byte of letter + 1 tells all letters and the end apart
    tag = np.repeat(tags, sizes + 1)
    order = np.lexsort((word, tag))
    fresh = np.zeros(total, np.int64)
    fresh[1:] = (word[order][1:] != word[order][:-1]) | (tag[order][1:] != tag[order][:-1])
    rank = np.empty(total, np.int64)
    rank[order] = np.cumsum(fresh)
    depth = 8
    while depth <= sizes.max(initial=0):
        key = rank * wide + np.where(at + depth < end, rank[np.minimum(at + depth, total - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        fresh = np.zeros(total, np.int64)
        fresh[groups_of(key[order])[1:]] = 1
        new = np.empty(total, np.int64)
        new[order] = np.cumsum(fresh)
        done = new[order[-1]] == rank.max()
        rank, depth = new, 2 * depth
        if done:
            break
    before = tag[order] * LETTERS + np.where(order > 0, text[order - 1], 0)
    run = groups_of(before)
    letter = before[run]
    by = np.argsort(letter, kind="stable")
    size = np.diff(np.append(run, total))
    base = np.empty(len(run), np.int64)
    base[by] = np.concatenate([[0], np.cumsum(size[by])[:-1]])
    raw = np.zeros(total + 64, np.uint8)
    raw[:total] = (text & 255).astype(np.uint8)
    left = end - 1 - at
    return RunIndex(run, letter, base, order[run], order[np.append(run[1:], total) - 1], letter[by] * len(run) + by, raw, left)


def extension(index: RunIndex, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many letters the suffixes at a and b have in common, each up to its `most`."""
    words = loads8(index.text)
    x = words[a] ^ words[b]
    got = _same_bytes(x)
    live = np.flatnonzero((x == 0) & (most > 8))
    k = 8
    while len(live):
        x = words[a[live] + k] ^ words[b[live] + k]
        got[live] = k + _same_bytes(x)
        k += 8
        live = live[(x == 0) & (most[live] > k)]
    return np.minimum(np.minimum(got, most), np.minimum(index.left[a], index.left[b]))


def _same_bytes(x: np.ndarray) -> np.ndarray:
    """Zero bytes from the low end of each word, 8 for a zero word."""
    low = (x & (~x + np.uint64(1))).astype(float)  # the lowest bit that differs, a power of two
    return np.where(x == 0, 8, (np.frexp(low)[1] - 1) >> 3).astype(np.int64)


def matching_statistics(index: RunIndex, letters: np.ndarray, sizes: np.ndarray, most: int, tags: np.ndarray | None = None) -> np.ndarray:
    """For each letter of the texts, how long the longest string from there is that some indexed text has, up to `most`."""
    shift = LETTERS * (np.zeros(len(sizes), np.int64) if tags is None else tags)
    out = np.zeros(len(letters), np.int64)
    ends = np.cumsum(sizes)
    order = np.argsort(-sizes, kind="stable")
    reach = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max(initial=0)) + 1), "right")
    ends, shift = ends[order], shift[order]
    runs = len(index.run_start)
    row, length = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    place = np.full(len(sizes), index.start_at[0])
    for k, n in enumerate(reach.tolist(), 1):
        q, size, p = row[:n], length[:n], place[:n]
        c = shift[:n] + letters[ends[:n] - k].astype(np.int64) + 1
        run = np.searchsorted(index.run_start, q, "right") - 1
        size, p = size + 1, p - 1
        jump = np.flatnonzero(index.run_letter[run] != c)
        if len(jump):
            key = c[jump] * runs + run[jump]
            j = np.searchsorted(index.by_letter, key)
            up, down = index.by_letter[np.maximum(j - 1, 0)], index.by_letter[np.minimum(j, runs - 1)]
            has_up, has_down = (j > 0) & (up // runs == c[jump]), (j < runs) & (down // runs == c[jump])
            up, down = up % runs, down % runs
            now, need = p[jump] + 1, size[jump] - 1  # what is longer than the match so far makes no difference
            far_up = np.where(has_up, extension(index, now, index.end_at[up], need), -1)
            far_down = np.where(has_down, extension(index, now, index.start_at[down], need), -1)
            above = far_up >= far_down
            to = np.where(above, up, down)
            best = np.maximum(far_up, far_down)
            known = best >= 0
            size[jump] = np.where(known, np.minimum(size[jump] - 1, best) + 1, 0)
            p[jump] = np.where(known, np.where(above, index.end_at[to], index.start_at[to]) - 1, index.start_at[0])
            last = np.where(to + 1 < runs, index.run_start[np.minimum(to + 1, runs - 1)], len(index.left)) - 1
            q = q.copy()
            q[jump] = np.where(above, last, index.run_start[to])
            run[jump] = to
            lost = jump[~known]
        else:
            lost = jump
        q = index.run_base[run] + q - index.run_start[run]
        q[lost] = 0
        row[:n], length[:n], place[:n] = q, np.minimum(size, most), p
        out[ends[:n] - k] = length[:n]
    return out
