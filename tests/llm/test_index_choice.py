"""Which surroundings of an anchor the run-length index of op1 is built over, and the runs and stretches around it."""

import numpy as np
import pytest

from lumenfold.llm import suffix_dedup as S
from lumenfold.llm.arrays import U, loads8
from lumenfold.llm.repeats import covered

LENGTH, GRAM = S.LENGTH, S.GRAM


def chosen(left: int, right: int) -> list[bool]:
    """Two snippets of one anchor that have so many letters before it and behind it in common, and a third with no more than the anchor."""
    rng = np.random.default_rng(left)
    side = LENGTH - GRAM
    middle = rng.integers(1, 60, left + GRAM + right)
    make = lambda low: np.concatenate([rng.integers(low, low + 9, side - left), middle, rng.integers(low, low + 9, side - right)])
    alone = np.concatenate([rng.integers(90, 99, side), middle[left : left + GRAM], rng.integers(90, 99, side)])
    texts = [make(60), make(70), alone]
    buf = np.concatenate([*texts, np.zeros(16)]).astype(np.uint8)
    size = np.array([len(x) for x in texts])
    start = np.cumsum(size) - size
    m = S.SuffixMeeting(None, None, 1, LENGTH, False, 10, GRAM)
    return m._may_match(buf, start, size, np.full(3, side), np.zeros(3, U)).tolist()


def test_snippets_that_share_a_window_are_indexed():
    for left in range(LENGTH - GRAM + 1):
        assert chosen(left, LENGTH - GRAM - left) == [True, True, False]


@pytest.mark.parametrize("left, right", [(0, 20), (20, 0), (17, 4), (6, 22), (25, 2)])
def test_snippets_that_share_one_side_only_are_not(left, right):
    """Half of a window beside the anchor was enough before, so the index was built over many snippets that share no window."""
    assert chosen(left, right) == [False, False, False]


def test_anchored_runs_are_the_least_grams_of_their_windows():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 49, 50, 3 * S.CHUNK + 7, 51, 400])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    buf = np.concatenate([rng.integers(97, 100, int(offsets[-1])), np.zeros(16)]).astype(np.uint8)
    view = loads8(buf)
    h = view[: len(buf) - 15].astype(U) * U(0x9E3779B97F4A7C15)
    h = ((h ^ (h >> U(29))) + view[8:]) * U(0xC2B2AE3D27D4EB4F)
    start, n, place, key, doc = S.anchored_runs(buf, offsets, LENGTH)
    seen = []
    for s, k, p, x, d in zip(start.tolist(), n.tolist(), place.tolist(), key.tolist(), doc.tolist(), strict=True):
        assert h[s + p] == x
        for w in range(s, s + k):
            top = (h[w : w + LENGTH - GRAM + 1] >> U(20)).tolist()
            assert top[s + p - w] == min(top) and offsets[d] <= w and w + LENGTH <= offsets[d + 1]
            seen.append(w)
    assert sorted(seen) == [w for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for w in range(a, b - LENGTH + 1)]


def test_covered_stretches():
    rng = np.random.default_rng(2)
    for k in (0, 1, 5, 300):
        low = rng.integers(0, 900, k)
        high = low + rng.integers(1, 40, k)
        expect = np.zeros(1000, bool)
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            expect[a : b - 1 + 20] = True
        assert covered(low, high, 20, 1000).tolist() == expect.tolist()
