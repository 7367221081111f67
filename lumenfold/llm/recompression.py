"""Locally consistent parsing of word sequences by recompression.

A round renames symbols in place.  The first round names every run of one repeated word; each later round splits
the alphabet in two by a bit of the symbols' own names and joins every pair whose left symbol is in the first
half and right symbol in the second.  A name is a hash of what it stands for, so all tasks give equal runs and
pairs equal names without talking to each other.

Whether two symbols join depends on these two alone.  So, inside a window, only the outermost symbol on each
side can be parsed otherwise in another copy of the window, and only if its half lets it join outwards.  What is
left after taking those off round by round is the window's interior: every copy of the window has the same
symbols there.  window_symbols() picks one of them for each window.
Runs are named in the first round only: symbols of several words hardly ever repeat at once.
"""

from __future__ import annotations

import numpy as np

from .arrays import U, groups_of, mix

ROUNDS = 3
CHUNK_WORDS = 16_000
_A, _B = U(0x9DDFEA08EB382D69), U(0xD6E8FEB86659FD93)


def window_symbols(name: np.ndarray, doc: np.ndarray, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window inside one document, name and first word of the symbol that stands for the window).

    name: a 64-bit name of each word; doc: its document, ascending.  A window's symbol is the longest interior
    one of the last round that leaves it an interior, the one with the greater name among equally long ones,
    then the first.
    Documents are parsed in chunks that fit the processor's cache; a chunk ends with a document.
    """
    heads = groups_of(doc)
    cuts = [0]
    while cuts[-1] < len(name):
        k = np.searchsorted(heads, cuts[-1] + CHUNK_WORDS)
        cuts.append(int(heads[k]) if k < len(heads) else len(name))
    firsts, keys, places = [np.empty(0, np.int64)], [np.empty(0, U)], [np.empty(0, np.int64)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a >= window:
            first, key, place = _parse(name[a:b], doc[a:b], window, rounds)
            firsts.append(first + a)
            keys.append(key)
            places.append(place + a)
    return np.concatenate(firsts), np.concatenate(keys), np.concatenate(places)


def _parse(name: np.ndarray, doc: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(name)
    first = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    # A window of one repeated word has no interior: its first word stands for it.
    out, at = mix(name[first]), first.copy()
    # Runs: the outermost run on each side may go on outside the window.
    cut = np.concatenate([[True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])])
    of = (np.cumsum(cut) - 1).astype(np.int32)
    head = np.flatnonzero(cut)
    words = np.diff(np.append(head, n))
    sym = name[head]
    many = words > 1
    sym[many] = mix(sym[many] * _A + words[many].astype(U))
    same = doc[head[1:]] == doc[head[:-1]]
    low, high = of[first] + np.int32(1), of[first + window - 1]
    live = low < high
    for k in range(1, rounds + 1):
        right = (mix(sym + U(k * int(_B) & (1 << 64) - 1)) & U(1)).astype(np.int32)
        join = np.flatnonzero((right[:-1] < right[1:]) & same)
        stay = np.ones(len(sym), bool)
        stay[join + 1] = False
        new = np.append(np.cumsum(stay) - 1, np.count_nonzero(stay)).astype(np.int32)
        # A right half at the low border may join outwards, as may a left half at the high border.
        right = np.append(right, np.int32(0))
        low_to = new[np.minimum(np.arange(len(new)) + right, len(new) - 1)]
        high_to = np.concatenate([[0], new[:-1] + right[:-1]]).astype(np.int32)
        low2, high2 = low_to[low], high_to[high]
        over = live & (low2 >= high2)
        if over.any():
            out[over], at[over] = _longest(sym, words, head, low[over], high[over])
            live &= ~over
        sym[join] = mix((sym[join] * _A) ^ ((sym[join + 1] + U(k)) * _B))
        words[join] += words[join + 1]
        keep = np.flatnonzero(stay)
        sym, words = sym[keep], words[keep]
        same = doc[head[keep[1:]]] == doc[head[keep[:-1]]]
        head = head[keep]
        low, high = low2, high2
    if live.all():
        return first, *_longest(sym, words, head, low, high)
    out[live], at[live] = _longest(sym, words, head, low[live], high[live])
    return first, out, at


def _longest(sym: np.ndarray, words: np.ndarray, head: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest symbol in each low..high-1: a key with its size above 58 bits of its name, and its first word."""
    key = (np.minimum(words, 63).astype(U) << U(58)) | (sym >> U(6))
    best, at = key[low], low
    for k in range(1, int((high - low).max(initial=0))):
        i = np.minimum(low + np.int32(k), high - np.int32(1))
        other = key[i]
        better = other > best
        best, at = np.where(better, other, best), np.where(better, i, at)
    return best, head[at]
