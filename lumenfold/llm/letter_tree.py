"""K-d trees over letter counts of Latin words, and the pairs of words that differ by one letter.

Code points are those below 256, one byte each.  A word's vector counts the letters a-z and those from U+00C0 to
U+00FF.  A word with one letter more than another is one step up from it on one axis; a word with one letter replaced
is one step up on one axis and one down on another.  reach() prunes boxes by these steps: a query enters a box only if
at most one step up and one down brings it there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LETTERS = 26 + 64
_CODE = np.zeros(256, np.int16)
_CODE[97:123] = np.arange(26)
_CODE[192:256] = 26 + np.arange(64)
_FREE, _NEVER = -1, -2
_LOW = np.uint64(0x0101010101010101)


def matrix(words: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def counts(letters: np.ndarray) -> np.ndarray:
    """Letter counts of each row, at most 255: beyond, a count says no more than that, and no box parts such words."""
    rows, length = letters.shape
    cell = (np.arange(rows)[:, None] * LETTERS + _CODE[letters]).ravel()
    return np.minimum(np.bincount(cell, minlength=rows * LETTERS), 255).astype(np.uint8).reshape(rows, LETTERS)


class Tree:
    """Splits (letter, limit): counts up to the limit lie on the low side.  A child below 0 is leaf number -1 - child."""

    def __init__(self, vectors: np.ndarray, leaf: int, deepest: int = 64):
        self.letter: list[int] = []
        self.limit: list[int] = []
        self.child: list[list[int]] = []
        self.leaves = 0
        self.order: list[np.ndarray] = []  # rows of each leaf
        self.root = self._grow(vectors, np.arange(len(vectors)), leaf, deepest)

    def _grow(self, vectors: np.ndarray, rows: np.ndarray, leaf: int, deeper: int) -> int:
        split = self._split(vectors[rows]) if len(rows) > leaf and deeper else None
        if split is None:
            self.leaves += 1
            self.order.append(rows)
            return -self.leaves
        letter, limit = split
        node = len(self.letter)
        self.letter.append(letter)
        self.limit.append(limit)
        self.child.append([0, 0])
        low = vectors[rows, letter] <= limit
        self.child[node] = [self._grow(vectors, rows[side], leaf, deeper - 1) for side in (low, ~low)]
        return node

    @staticmethod
    def _split(v: np.ndarray) -> tuple[int, int] | None:
        """The axis and limit that part the rows most evenly."""
        best, found = 0, None
        for limit in range(4):
            low = (v <= limit).sum(axis=0)
            part = np.minimum(low, len(v) - low)
            k = int(part.argmax())
            if part[k] > best:
                best, found = int(part[k]), (k, limit)
        if found is None:  # only words of many equal letters differ above
            spread = v.max(axis=0).astype(int) - v.min(axis=0)
            k = int(spread.argmax())
            if spread[k]:
                found = (k, int(v[:, k].min()))
        return found

    def home(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int64)
        for leaf, rows in self.reach(vectors, False, False):
            out[rows] = leaf
        return out

    def reach(self, vectors: np.ndarray, up: bool, down: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of the vectors that may have a neighbour in it), each leaf once.

        up and down say whether a neighbour may have a letter more, and one fewer; with both, only neighbours whose
        letter more comes before the letter that they lack, so that a pair is met from one side.
        """
        n = len(vectors)
        free = [np.full(n, _FREE if ok else _NEVER, np.int16) for ok in (up, down)]
        stack = [(self.root, np.arange(n), *free)]
        while stack:
            node, rows, more, less = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows
                continue
            a, limit = self.letter[node], self.limit[node]
            c = vectors[rows, a].astype(np.int16) + (more == a) - (less == a)
            low = c <= limit
            rise = (c == limit) & (more == _FREE) & ((less < 0) | (less > a))
            fall = (c == limit + 1) & (less == _FREE) & ((more < 0) | (more < a))
            for child, stay, move, is_up in ((self.child[node][0], low, fall, False), (self.child[node][1], ~low, rise, True)):
                s, m = np.flatnonzero(stay), np.flatnonzero(move)
                step = np.full(len(m), a, np.int16)
                stack.append((
                    child, np.concatenate([rows[s], rows[m]]),
                    np.concatenate([more[s], step if is_up else more[m]]), np.concatenate([less[s], less[m] if is_up else step]),
                ))


def lanes(letters: np.ndarray) -> np.ndarray:
    """Rows as 64-bit integers, eight letters each, (lanes, rows)."""
    rows, length = letters.shape
    wide = np.zeros((rows, -(-length // 8) * 8), np.uint8)
    wide[:, :length] = letters
    return np.ascontiguousarray(wide.view("<u8").T)


class Bucketed:
    """Words of one length in a k-d tree, and the searches of other words in it."""

    def __init__(self, words: list[bytes], length: int, bucket: int):
        letters = matrix(words, length)
        self.tree = Tree(counts(letters), bucket)
        self.order = np.concatenate(self.tree.order)
        self.ends = np.concatenate([[0], np.cumsum([len(r) for r in self.tree.order])])
        self.letters = letters[self.order]
        self.lanes = lanes(self.letters)
        self.sums = _sums(self.letters)

    def replaced(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word): the word is the query with one letter replaced by a smaller one."""
        own = lanes(letters)
        found = []
        for leaf, rows in self.tree.reach(counts(letters), True, True):
            a, b = self.ends[leaf], self.ends[leaf + 1]
            differ = np.zeros((len(rows), b - a), np.uint8)
            less = np.zeros((len(rows), b - a), bool)
            for q, t in zip(own, self.lanes, strict=True):
                q, t = q[rows, None], t[None, a:b]
                x = q ^ t
                x |= x >> np.uint64(4)
                x |= x >> np.uint64(2)
                x |= x >> np.uint64(1)
                x &= _LOW
                differ += np.bitwise_count(x)
                less |= t < q
            i, j = np.nonzero((differ == 1) & less)
            found.append((rows[i], a + j))
        return self._pairs(found)

    def longer(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word): the word is the query with one letter more."""
        s1, s2 = _sums(letters)
        t1, t2 = self.sums
        found = []
        for leaf, rows in self.tree.reach(counts(letters), True, False):
            a, b = self.ends[leaf], self.ends[leaf + 1]
            d = t1[None, a:b] - s1[rows, None]
            # one letter more changes the sum of codes by it and the sum of their squares by its square
            i, j = np.nonzero(t2[None, a:b] - s2[rows, None] == d * d)
            if not len(i):
                continue
            short, long = letters[rows[i]], self.letters[a + j]
            head, tail = short == long[:, :-1], (short == long[:, 1:])[:, ::-1]
            n = short.shape[1]
            same = np.where(head.all(axis=1), n, head.argmin(axis=1)) + np.where(tail.all(axis=1), n, tail.argmin(axis=1))
            ok = same >= n
            found.append((rows[i[ok]], a + j[ok]))
        return self._pairs(found)

    def _pairs(self, found: list) -> tuple[np.ndarray, np.ndarray]:
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([f[0] for f in found]), self.order[np.concatenate([f[1] for f in found])]


def _sums(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = letters.astype(np.int64)
    return wide.sum(axis=1), (wide * wide).sum(axis=1)
