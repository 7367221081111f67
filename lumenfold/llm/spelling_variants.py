"""Words of a corpus grouped with the spelling that they vary: one letter inserted, deleted or replaced.

Words are counted over all texts.  For each length a k-d tree over letter-count vectors (letter_tree.py) is grown on at
most SAMPLE words and parts that length into leaves of about LEAF words.  A word goes to its leaf, and as a query to the
leaves that the letter steps of one edit reach: among words of its own length, and of one letter more.  A task grows
each leaf's tree on to buckets, searches it box by box, and verifies the order of letters.  Each pair of near words is
found once and counted for both.  A word's form is the near word that occurs most; roots follow forms to the end by
joins that double their reach.

A leaf's words are the most that a task holds (words with one multiset of letters cannot be parted: their number is
bounded by the orders of their letters that occur); queries pass in blocks.

Defined cases: a null text has no words; a null doc_id counts as an empty one; repeated rows count each; near words of
equal n are told apart by code points; words of any length are searched; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import characters_of, segment_hash
from .common import id_and_text, parts_of
from .components import ensure_checkpoint_dir
from .letter_tree import Bucketed, Tree, counts, matrix

MIN_LENGTH = 5
MIN_COUNT = 3
#: Words of a leaf, of a bucket inside it, of the sample for one length's tree, and queries of a block.
LEAF = 16_000
BUCKET = 48
SAMPLE = 16_384
BLOCK = 1 << 15
PART = 4 << 20
WHOLE, SAME, LONGER = 0, 1, 2
ROUTED = "length int, leaf int, role int, word binary, n long"
NEAR = "word binary, n_near long, best_n long, best binary"


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


CRC = _crc_table()


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def run_hashes(points: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each run's UTF-8 bytes behind a prefix with the given crc32, all runs side by side."""
    state = state ^ np.uint32(0xFFFFFFFF)
    short = length <= 256
    live = np.flatnonzero(short)
    j = 0
    while len(live):
        c = points[start[live] + j].astype(np.uint32)
        wide = c >= 192
        s = state[live]
        if wide.any():
            s[wide] = _step(s[wide], np.uint32(0xC3))
            c[wide] -= np.uint32(0x40)
        state[live] = _step(s, c)
        j += 1
        live = live[length[live] > j]
    out = state ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(~short).tolist():
        text = points[start[k] : start[k] + length[k]].astype(np.uint8).tobytes().decode("latin-1").encode()
        out[k] = zlib.crc32(text, int(out[k]))
    return out


def part_counts(ids: list, texts, slip: int | None, min_length: int) -> Iterator[tuple[list[bytes], list[int]]]:
    """Distinct words (Latin-1) and their numbers; words with a slipped letter come apart, so a word may come twice."""
    points, offsets = characters_of(texts)
    n = int(offsets[-1])
    if not n:
        return
    p = points[:n].astype(np.int32)
    p = np.where((p >= 65) & (p <= 90), p + 32, p)
    letter = ((p >= 97) & (p <= 122)) | ((p >= 192) & (p <= 255))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(letter & (edge[:n] | ~np.concatenate([[False], letter[:-1]])))
    end = np.flatnonzero(letter & (edge[1:] | ~np.concatenate([letter[1:], [False]]))) + 1
    length = end - start
    buf = np.concatenate([np.where(letter, p, 0).astype(np.uint8), np.zeros(16, np.uint8)])
    usable = length >= min_length
    if slip:
        prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        doc = np.searchsorted(offsets, start, "right") - 1
        h = run_hashes(buf, start, length, prefix[doc]).astype(np.int64)
        hit = h % slip == 0
        slipped: Counter = Counter()
        for k in np.flatnonzero(hit & (length > min_length)).tolist():
            w = buf[start[k] : end[k]].tobytes()
            at = int(h[k] % length[k])
            slipped[w[:at] + w[at + 1 :]] += 1
        if slipped:
            yield list(slipped), list(slipped.values())
        usable &= ~hit
    start, length = start[usable], length[usable]
    if len(start):
        _, first, number = np.unique(segment_hash(buf, start, length), return_index=True, return_counts=True)
        data, a, m = buf.tobytes(), start[first].tolist(), length[first].tolist()
        yield [data[i : i + k] for i, k in zip(a, m, strict=True)], number.tolist()


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = None, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n) of the letter runs with min_length code points; A-Z count as a-z.

    With `slip`, a run whose crc32 of `<doc_id>:<run>` is a multiple of it loses the code point at that number modulo its
    length, as a typist might.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(b.column("size"))
            for part in parts_of(b, sizes, PART):
                for words, number in part_counts(part.column("doc_id").to_pylist(), part.column("text"), slip, min_length):
                    text = pa.array([w.decode("latin-1") for w in words], pa.string())
                    yield pa.RecordBatch.from_arrays([text, pa.array(number, pa.int64())], ["word", "n"])

    texts = id_and_text(df, id_col, text_col).withColumn("size", F.octet_length("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _trees(words: DataFrame, leaf: int, sample: int) -> dict[int, Tree]:
    """A tree for each length with more than `leaf` words, grown on at most about `sample` of them."""
    lengths = {r.length: r.n for r in words.groupBy("length").agg(F.count("*").alias("n")).filter(F.col("n") > leaf).collect()}
    if not lengths:
        return {}
    share = F.create_map(*[F.lit(x) for length, n in lengths.items() for x in (length, max(1, -(-n // sample)))])
    taken = words.filter(F.col("length").isin(list(lengths))).filter(F.pmod(F.xxhash64("word"), share[F.col("length")]) == 0)
    found: dict[int, list[bytes]] = {k: [] for k in lengths}
    for r in taken.select("word", "length").collect():
        found[r.length].append(bytes(r.word))
    out = {}
    for length, some in found.items():
        if some:
            t = Tree(counts(matrix(some, length)), max(1, len(some) * leaf // lengths[length]))
            t.order = []
            out[length] = t
    return out


def _routes(trees: dict[int, Tree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, n = b.column("length").to_numpy(), b.column("n").to_numpy()
            words = b.column("word").to_pylist()
            for size in np.unique(length).tolist():
                rows = np.flatnonzero(length == size)
                own, longer = trees.get(size), trees.get(size + 1)
                v = counts(matrix([words[k] for k in rows.tolist()], size)) if own or longer else None
                zero = np.zeros(len(rows), np.int64)
                everyone = np.arange(len(rows))
                parts = [(size, WHOLE, own.home(v) if own else zero, everyone)]
                parts += [(size, SAME, leaf, r) for leaf, r in (own.reach(v, True, True) if own else [(0, everyone)])]
                parts += [(size + 1, LONGER, leaf, r) for leaf, r in (longer.reach(v, True, False) if longer else [(0, everyone)])]
                for to, role, leaf, r in parts:
                    at = pa.array(rows[r])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(r), to, np.int32)), pa.array(np.broadcast_to(leaf, len(r)).astype(np.int32)),
                            pa.array(np.full(len(r), role, np.int32)), b.column("word").take(at), pa.array(n[rows[r]]),
                        ],
                        ["length", "leaf", "role", "word", "n"],
                    )

    return run


def _best(words: list[bytes], n: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Of pairs (x, y) of word numbers, both ways: near words of each, and the best of them."""
    a, b = np.concatenate([x, y]), np.concatenate([y, x])
    used = np.unique(a)
    order_of = np.empty(len(words), np.int64)
    order_of[used] = np.argsort(np.argsort(np.array([words[k] for k in used.tolist()], object)))
    k = np.lexsort((order_of[b], -n[b], a))
    first = np.searchsorted(a[k], used)
    near = np.diff(np.append(first, len(a)))
    best = b[k][first]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([words[i] for i in used.tolist()], pa.binary()), pa.array(near, pa.int64()),
            pa.array(n[best], pa.int64()), pa.array([words[i] for i in best.tolist()], pa.binary()),
        ],
        ["word", "n_near", "best_n", "best"],
    )


def _search(bucket: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, there, words, numbers, waiting = None, None, [], [], {SAME: ([], []), LONGER: ([], [])}

        def ask(role: int) -> Iterator[pa.RecordBatch]:
            queries, n = waiting[role]
            if queries and words:
                letters = matrix(queries, key[0] - (role == LONGER))
                q, t = there.replaced(letters) if role == SAME else there.longer(letters)
                if len(q):
                    yield _best(words + queries, np.array(numbers + n, np.int64), t, q + len(words))
            waiting[role] = ([], [])

        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for length, leaf, role, word, n in zip(*columns, strict=True):
                if key != (length, leaf):
                    for r in (SAME, LONGER):
                        yield from ask(r)
                    key, there, words, numbers = (length, leaf), None, [], []
                if role == WHOLE:
                    words.append(word)
                    numbers.append(n)
                    continue
                if not words:
                    continue  # no word of this length in the leaf
                if there is None:
                    there = Bucketed(words, length, bucket)
                waiting[role][0].append(word)
                waiting[role][1].append(n)
                if len(waiting[role][0]) >= block:
                    yield from ask(role)
        for r in (SAME, LONGER):
            yield from ask(r)

    return run


def near_words(vocabulary: DataFrame, leaf: int = LEAF, bucket: int = BUCKET, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) with a word one edit away; words are Latin letters.

    The vocabulary is read twice, so it should be at hand.
    """
    words = vocabulary.select(F.encode("word", "ISO-8859-1").alias("word"), "n").withColumn("length", F.octet_length("word"))
    routed = words.mapInArrow(_routes(_trees(words, leaf, sample)), ROUTED)
    found = routed.repartition("length", "leaf").sortWithinPartitions("length", "leaf", "role").mapInArrow(_search(bucket, block), NEAR)
    text = [F.decode(c, "ISO-8859-1").alias(c) for c in ("word", "best")]
    found = found.select("n_near", "best_n", *text).groupBy("word")
    return found.agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")).select(
        "word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best")
    )


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of (word, form); a form's n is at least twice its word's, so chains are short as log2(most)."""
    state = forms.select("word", F.col("form").alias("root")).checkpoint()
    for _ in range(max(1, math.ceil(math.log2(max(2.0, math.log2(max(2, most))))))):
        next_ = state.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        state = state.join(next_, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")).checkpoint()
    return state


def spelling_variants(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = None, min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT, **how,
) -> DataFrame:
    """One row per word with min_count occurrences: n, its near words' number, its form (null if none) and root."""
    ensure_checkpoint_dir(df.sparkSession)
    vocabulary = word_counts(df, id_col, text_col, slip, min_length).filter(F.col("n") >= min_count).checkpoint()
    near = near_words(vocabulary, **how)
    is_form = F.col("best_n") >= 2 * F.col("n")
    words = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
    ).checkpoint()
    most = words.agg(F.max("n")).first()[0] or 0
    followed = roots(words.filter("form is not null"), most)
    return words.join(followed, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
