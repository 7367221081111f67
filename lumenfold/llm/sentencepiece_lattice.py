"""SentencePiece encoding and decoding over a relational lattice with a Viterbi fold.

A text is its words (spaces and what follows them); a word's lattice has one edge for each of its substrings
that is a piece, and byte edges for characters that no piece covers.  What is folded over the lattice follows from
the vocabulary: for one with log probabilities it is Viterbi, the path with the greatest score sum (of equal paths
the one whose last piece is longest).  A vocabulary trained by merges has merge ranks for scores; the greatest sum
of ranks is not its encoding, so there the fold joins, as long as it can, the neighbours whose edge has the best
rank, the leftmost of equal ones.

encode_words() is the lattice in Spark's own operations: explode bounded-length substrings, join them to the
broadcast piece table (its size is the vocabulary's), group the edges by word, fold with `aggregate`.
encode_lattice() sends it the distinct words of the corpus, each shard of documents every word once, and puts the ids
back by shard; it serves corpora whose words repeat.  encode() does the same steps as arrays on the distinct words of
a few MB of text, without a shuffle, and serves corpora in which most words are new.  Both give the same ids.

The vocabulary file is a parameter.

Defined cases: null and empty texts have no ids; every text decodes to itself exactly, byte for byte, so a written
space sign is encoded as bytes and not as a space; repeated
rows are encoded alike; words over LONG bytes are folded one by one; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import U, segment_hash, text_buffer
from .common import id_and_text, parts_of, shard_of, shards_for, text_bytes
from .components import ensure_checkpoint_dir
from .repeats import SHARD_BYTES

SPACE = "▁"
LONG = 200
#: Texts are taken so many bytes at a time.
PART_BYTES = 4 << 20
_BASE = U(0x9E3779B97F4A7C15)
#: Bytes of a UTF-8 character by its first byte; 9 for bytes inside one.
CHARACTER = np.select([np.arange(256) < 0x80, np.arange(256) < 0xC0, np.arange(256) < 0xE0, np.arange(256) < 0xF0], [1, 9, 2, 3], 4)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    pieces: list[bytes]  # by id; b"" where an id is no text; the space sign is a space
    scores: list[float]
    bytes_at: np.ndarray  # id of each byte's piece
    byte_score: float
    merges: bool  # scores are merge ranks

    def table(self) -> dict[bytes, tuple[float, int]]:
        return {p: (s, k) for k, (p, s) in enumerate(zip(self.pieces, self.scores, strict=True)) if p and k not in set(self.bytes_at.tolist())}


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, byte_ids = [], [], np.zeros(256, np.int32)
    for k in range(m.get_piece_size()):
        name = m.id_to_piece(k)
        if m.is_byte(k):
            byte_ids[int(name[3:5], 16)] = k
            pieces.append(bytes([int(name[3:5], 16)]))
        elif m.is_control(k) or m.is_unknown(k) or m.is_unused(k):
            pieces.append(b"")
        else:
            pieces.append(name.replace(SPACE, " ").encode())
        scores.append(float(m.get_score(k)))
    byte_set = set(byte_ids.tolist())
    least = min(s for k, (p, s) in enumerate(zip(pieces, scores, strict=True)) if p and k not in byte_set and s > -1e8)
    ranks = all(x == int(x) for p, x in zip(pieces, scores, strict=True) if p)
    return Vocabulary(pieces, scores, byte_ids, least - 10.0, ranks)


class Words:
    """The distinct words of some texts, a word being spaces and what follows them, and where each occurs."""

    def __init__(self, column):
        raw, offsets = text_buffer(column)
        size = np.diff(offsets)
        full = size > 0
        # a space in front of every text that is not empty
        self.off = np.concatenate([[0], np.cumsum(size + full)])
        n = int(self.off[-1])
        self.buf = np.full(n + 16, 32, np.uint8)
        head = np.zeros(n, bool)
        head[self.off[:-1][full]] = True
        self.buf[:n][~head] = raw[: int(offsets[-1])]
        self.buf[n:] = 0
        gap = self.buf[:n] == 32
        cut = head.copy()
        cut[1:] |= gap[1:] & ~gap[:-1]
        self.every = np.flatnonzero(cut)
        length = np.diff(np.append(self.every, n))
        self.name, first, self.of = np.unique(segment_hash(self.buf, self.every, length), return_index=True, return_inverse=True)
        self.start, self.size = self.every[first], length[first]

    def spread(self, count: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids) from where each distinct word's ids are."""
        n = count[self.of]
        into = np.cumsum(n) - n
        out = ids[np.repeat(at[self.of] - into, n) + np.arange(int(n.sum()))].astype(np.int32)
        doc = np.searchsorted(self.off, self.every, "right") - 1
        return np.bincount(doc, n, len(self.off) - 1).astype(np.int64), out


class Lattice:
    """Viterbi over many short words at once, for one vocabulary."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.by_text = v.table()
        items = list(self.by_text.items())
        self.longest = max(len(p) for p, _ in items)
        buf = np.frombuffer(b"".join(p for p, _ in items) + b"\0" * 16, np.uint8)
        size = np.array([len(p) for p, _ in items])
        self.power = np.concatenate([np.ones(1, U), np.cumprod(np.full(self.longest, _BASE))])
        h = self._hash(buf, np.cumsum(size) - size, size)
        order = np.argsort(h)
        self.key = h[order]
        self.score = np.array([s for _, (s, _) in items])[order]
        self.id = np.array([k for _, (_, k) in items], np.int32)[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.key >> U(42)] = True
        self.sizes = sorted(set(size.tolist()))
        if v.merges:
            self._merge_table()

    def _merge_table(self) -> None:
        """Pairs of symbols that make a piece; characters that only occur inside pieces are symbols too."""
        self.symbol = {p: k for p, (_, k) in self.by_text.items()}
        for p in list(self.by_text):
            for c in p.decode():
                self.symbol.setdefault(c.encode(), len(self.v.pieces) + len(self.symbol))
        pairs = []
        for p, (score, k) in self.by_text.items():
            text = p.decode()
            for cut in range(1, len(text)):
                left, right = self.symbol.get(text[:cut].encode()), self.symbol.get(text[cut:].encode())
                if left is not None and right is not None:
                    pairs.append((left << 20 | right, score, k))
        pairs.sort()
        self.pair_key = np.array([x[0] for x in pairs], np.int64)
        self.pair_score = np.array([x[1] for x in pairs])
        self.pair_id = np.array([x[2] for x in pairs], np.int64)
        self.pair_of = {x[0]: x[1:] for x in pairs}
        singles = [(p, k) for p, k in self.symbol.items() if len(p.decode()) == 1]
        buf = np.frombuffer(b"".join(p for p, _ in singles) + b"\0" * 16, np.uint8)
        size = np.array([len(p) for p, _ in singles])
        h = self._hash(buf, np.cumsum(size) - size, size)
        order = np.argsort(h)
        self.char_key, self.char_id = h[order], np.array([k for _, k in singles], np.int64)[order]

    def _ids_of(self, sid: np.ndarray, at: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each symbol, all ids): its own, or its bytes' where it is no piece."""
        piece = (sid >= 0) & (sid < len(self.v.pieces))
        n = np.where(piece, 1, CHARACTER[buf[at]])
        out = np.repeat(sid, n)
        bare = np.repeat(~piece, n)
        place = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
        out[bare] = self.v.bytes_at[buf[(np.repeat(at, n) + place)[bare]]]
        return n, out.astype(np.int32)

    def merged(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids): every word makes its best join, all words side by side."""
        total = int(size.sum())
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)
        word = np.repeat(np.arange(len(size)), size)
        head = CHARACTER[buf[at]] < 9
        at, word = at[head], word[head]
        h = self._hash(buf, at, CHARACTER[buf[at]])
        j = np.minimum(np.searchsorted(self.char_key, h), len(self.char_key) - 1)
        sid = np.where(self.char_key[j] == h, self.char_id[j], -1)
        done: list[tuple[np.ndarray, ...]] = []
        while len(word):
            score, made = np.full(len(word), -np.inf), np.zeros(len(word), np.int64)
            near = np.flatnonzero((word[1:] == word[:-1]) & (sid[1:] >= 0) & (sid[:-1] >= 0))
            key = sid[near] << 20 | sid[near + 1]
            j = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            hit = self.pair_key[j] == key
            score[near[hit]], made[near[hit]] = self.pair_score[j[hit]], self.pair_id[j[hit]]
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.repeat(np.maximum.reduceat(score, heads), np.diff(np.append(heads, len(word))))
            over = np.isneginf(best)
            if over.any():
                done.append((word[over], sid[over], at[over]))
            pick = np.flatnonzero((score == best) & ~over)
            pick = pick[np.concatenate([[True], word[pick[1:]] != word[pick[:-1]]])] if len(pick) else pick
            sid[pick] = made[pick]
            keep = ~over
            keep[pick + 1] = False
            word, sid, at = word[keep], sid[keep], at[keep]
        if not done:
            return np.zeros(len(size), np.int64), np.empty(0, np.int32)
        word, sid, at = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        n, ids = self._ids_of(sid[order], at[order], buf)
        return np.bincount(word[order], n, len(size)).astype(np.int64), ids

    def merged_one(self, word: bytes) -> list[int]:
        """One word of any length, with a queue of joins."""
        import heapq

        parts = [c.encode() for c in word.decode()]
        sid = [self.symbol.get(p, -1) for p in parts]
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        queue: list[tuple[float, int, int, int, int]] = []

        def offer(i: int) -> None:
            k = right[i]
            if i >= 0 and k >= 0 and sid[i] >= 0 and sid[k] >= 0 and (found := self.pair_of.get(sid[i] << 20 | sid[k])):
                heapq.heappush(queue, (-found[0], i, sid[i], sid[k], found[1]))

        for i in range(len(parts)):
            offer(i)
        alive = [True] * len(parts)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            k = right[i]
            if not alive[i] or k < 0 or sid[i] != a or sid[k] != b:
                continue
            sid[i], alive[k] = made, False
            right[i] = right[k]
            if right[i] >= 0:
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        ids: list[int] = []
        for i, p in enumerate(parts):
            if alive[i]:
                ids += [sid[i]] if 0 <= sid[i] < len(self.v.pieces) else self.v.bytes_at[np.frombuffer(p, np.uint8)].tolist()
        return ids

    def words(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.merged(buf, start, size) if self.v.merges else self.short(buf, start, size)

    def long_word(self, word: bytes) -> list[int]:
        return self.merged_one(word) if self.v.merges else self.one(word)

    def _hash(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = np.zeros(len(start), U)
        for k in range(int(size.max(initial=0))):
            live = size > k
            h[live] = h[live] * _BASE + buf[start[live] + k] + U(1)
        return h * U(0xC2B2AE3D27D4EB4F)

    def short(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids)."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        base = np.cumsum(size + 1) - size - 1
        total = int((size + 1).sum())
        best = np.full(total, -np.inf)
        best[base] = 0.0
        length = np.ones(total, np.int16)
        token = np.zeros(total, np.int32)
        prefix = np.zeros(total, U)  # hash of the word up to here, so a substring's hash is a difference
        reach = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), "right")
        for t in range(1, int(size.max(initial=0)) + 1):
            k = int(reach[t - 1])
            at = base[:k] + t
            letter = buf[start[:k] + t - 1]
            prefix[at] = prefix[at - 1] * _BASE + letter + U(1)
            top = best[at - 1] + self.v.byte_score
            step, tok = np.ones(k, np.int16), self.v.bytes_at[letter]
            found = []
            for n in reversed(self.sizes):
                if n > t:
                    continue
                h = (prefix[at] - prefix[at - n] * self.power[n]) * U(0xC2B2AE3D27D4EB4F)
                hit = np.flatnonzero(self.seen[h >> U(42)])
                if not len(hit):
                    continue
                j = np.minimum(np.searchsorted(self.key, h[hit]), len(self.key) - 1)
                real = self.key[j] == h[hit]
                hit, j = hit[real], j[real]
                found.append((n, hit, j))
                if n <= 4:  # a character with a piece of its own has no byte edges
                    whole = hit[CHARACTER[buf[start[hit] + t - n]] == n]
                    top[whole] = -np.inf
                    for back in range(1, n):
                        best[at[whole] - back] = -np.inf
            for n, hit, j in found:
                s = best[at[hit] - n] + self.score[j]
                # longer pieces come first and win ties
                better = (s > top[hit]) | ((s == top[hit]) & np.isfinite(s) & (step[hit] < n))
                hit, j = hit[better], j[better]
                top[hit], step[hit], tok[hit] = s[better], n, self.id[j]
            best[at], length[at], token[at] = top, step, tok
        count = np.zeros(len(size), np.int64)
        live, at = np.arange(len(size)), base + size
        trail: list[tuple[np.ndarray, np.ndarray]] = []
        left = size.copy()
        while len(live):
            trail.append((live, token[at]))
            count[live] += 1
            n = length[at]
            left, at = left - n, at - n
            go = left > 0
            live, at, left = live[go], at[go], left[go]
        out_count = np.empty_like(count)
        out_count[order] = count
        end = np.cumsum(out_count)[order]
        ids = np.empty(int(count.sum()), np.int32)
        for k, (words, tokens) in enumerate(trail):
            ids[end[words] - 1 - k] = tokens
        return out_count, ids

    def one(self, word: bytes) -> list[int]:
        """One word of any length."""
        n = len(word)
        best, back = [0.0] + [float("-inf")] * n, [(0, 0)] * (n + 1)
        bare = [True] * n  # bytes of characters without a piece
        at = 0
        while at < n:
            size = int(CHARACTER[word[at]])
            if word[at : at + size] in self.by_text:
                bare[at : at + size] = [False] * size
            at += size
        for t in range(1, n + 1):
            top, step, tok = best[t - 1] + self.v.byte_score if bare[t - 1] else float("-inf"), 1, int(self.v.bytes_at[word[t - 1]])
            for size in range(min(t, self.longest), 0, -1):
                found = self.by_text.get(word[t - size : t])
                if found is not None:
                    s = best[t - size] + found[0]
                    if s > top or (s == top > float("-inf") and step < size):
                        top, step, tok = s, size, found[1]
            best[t], back[t] = top, (step, tok)
        ids, t = [], n
        while t:
            step, tok = back[t]
            ids.append(tok)
            t -= step
        return ids[::-1]

    def texts(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids)."""
        w = Words(column)
        short = w.size <= LONG
        count = np.zeros(len(w.size), np.int64)
        count[short], ids = self.words(w.buf, w.start[short], w.size[short])
        at = np.zeros(len(w.size), np.int64)
        at[short] = np.cumsum(count[short]) - count[short]
        return w.spread(*self.with_long_words(w, count, at, ids))

    def with_long_words(self, w: Words, count: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words over LONG bytes, one by one, behind the others' ids."""
        parts, end = [ids], len(ids)
        for k in np.flatnonzero(w.size > LONG).tolist():
            more = self.long_word(w.buf[w.start[k] : w.start[k] + w.size[k]].tobytes())
            parts.append(np.array(more, np.int32))
            at[k], count[k] = end, len(more)
            end += len(more)
        return count, at, np.concatenate(parts)


ENCODED = "doc_id long, text string, ids array<int>"


def _encoded(ids: pa.Array, texts: pa.Array, count: np.ndarray, flat: np.ndarray) -> list[pa.Array]:
    offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
    return [ids, texts, pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))]


def encode_lattice(
    df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """The same rows over the relational lattice.

    Documents lie in shards by a hash of their id.  A shard sends each of its words once; the distinct words of all
    shards go through encode_words(), Spark's own explode, join, group and fold; their ids come back to the shards
    that have them by a join, and a shard puts them in place of its words.
    """
    path = vocabulary or default_vocabulary()
    ensure_checkpoint_dir(df.sparkSession)
    base = id_and_text(df, id_col, text_col)
    n = shards_for(text_bytes(base), shard_bytes)
    # rows without an id are dealt by their text
    shards = base.withColumn("shard", shard_of(F.coalesce("doc_id", F.xxhash64("text")), n)).groupBy("shard")

    def send(t: pa.Table) -> pa.Table:
        w = Words(t.column("text"))
        short = np.flatnonzero(w.size <= LONG)
        size = w.size[short]
        cut = np.concatenate([[0], np.cumsum(size)])
        letters = w.buf[np.repeat(w.start[short] - cut[:-1], size) + np.arange(int(cut[-1]))]
        words = pa.StringArray.from_buffers(len(short), pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(letters.tobytes()))
        return pa.table([pa.array(np.full(len(short), t.column("shard")[0].as_py(), np.int32)), words], names=["shard", "word"])

    def place(t: pa.Table, told: pa.Table) -> pa.Table:
        w = Words(t.column("text"))
        buf, offsets = text_buffer(told.column("word"))
        name = segment_hash(buf, offsets[:-1], np.diff(offsets))
        order = np.argsort(name)
        lists = told.column("ids").combine_chunks()
        ids = lists.values.to_numpy(zero_copy_only=False).astype(np.int32) if len(lists) else np.empty(0, np.int32)
        ends = lists.offsets.to_numpy() if len(lists) else np.zeros(1, np.int32)
        known = np.flatnonzero(w.size <= LONG)
        hit = order[np.searchsorted(name[order], w.name[known])] if len(known) else known
        count, at = np.zeros(len(w.size), np.int64), np.zeros(len(w.size), np.int64)
        at[known], count[known] = ends[:-1][hit], np.diff(ends)[hit]
        if (w.size > LONG).any():
            count, at, ids = Lattice(load(path)).with_long_words(w, count, at, ids)
        return pa.table(_encoded(t.column("doc_id").combine_chunks(), t.column("text").combine_chunks(), *w.spread(count, at, ids)), names=["doc_id", "text", "ids"])

    words = shards.applyInArrow(send, "shard int, word string").checkpoint()
    told = words.join(encode_words(words, path), "word")
    return shards.cogroup(told.groupBy("shard")).applyInArrow(place, ENCODED)


def encode(df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, ids) of every row: the lattice of the distinct words of a few MB at a time, folded on arrays."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(load(path))
        for b in batches:
            for part in parts_of(b, np.diff(text_buffer(b.column("text"))[1]), PART_BYTES):
                yield pa.RecordBatch.from_arrays(_encoded(part.column("doc_id"), part.column("text"), *lattice.texts(part.column("text"))), ["doc_id", "text", "ids"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, ENCODED)


def decode_ids(ids: np.ndarray, v: Vocabulary, flat: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all ids, size of each)."""
    letters, at, size = flat
    n = size[ids]
    into = np.cumsum(n) - n
    return letters[np.repeat(at[ids] - into, n) + np.arange(int(n.sum()))], n


def flat_pieces(v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in v.pieces])
    return np.frombuffer(b"".join(v.pieces), np.uint8), np.cumsum(size) - size, size


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Adds decoded: the text of the ids, without the space that encoding puts in front; null ids give null."""
    path = vocabulary or default_vocabulary()
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(path)
        flat = flat_pieces(v)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                column = part.column(part.schema.get_field_index("ids"))
                ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                count = np.array([0 if k is None else k for k in column.value_lengths().to_pylist()], np.int64)
                letters, size = decode_ids(ids, v, flat)
                cut = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
                texts = [
                    None if null else letters[a + 1 : z].tobytes().decode("utf-8", "replace") if z > a else ""
                    for a, z, null in zip(cut[:-1].tolist(), cut[1:].tolist(), column.is_null().to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def encoding_digest(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document: n_tokens, n_byte_tokens, ids_sha256 (little-endian 32-bit ids), round_trip, from the ids themselves."""
    path = vocabulary or default_vocabulary()
    schema = "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(path)
        flat = flat_pieces(v)
        is_byte = np.zeros(len(v.pieces), bool)
        is_byte[v.bytes_at] = True
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                column = part.column("ids")
                ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                cut = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                letters, size = decode_ids(ids.astype(np.int64), v, flat)
                byte = np.concatenate([[0], np.cumsum(is_byte[ids])])
                ends = np.concatenate([[0], np.cumsum(size)])[cut]
                raw, offsets = text_buffer(part.column("text"))
                same = [
                    np.array_equal(letters[a + 1 : z] if z > a else letters[a:z], raw[s:e])
                    for a, z, s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
                ]
                sums = [hashlib.sha256(ids[a:z].data).hexdigest() for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                columns = [part.column("doc_id"), pa.array(np.diff(cut)), pa.array(byte[cut[1:]] - byte[cut[:-1]]), pa.array(sums, pa.string()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return df.mapInArrow(run, schema)


def encode_words(words: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(word, ids) of each distinct word, in Spark's own operations; a word is spaces and what follows them."""
    v = load(vocabulary or default_vocabulary())
    spark = words.sparkSession
    pieces = spark.createDataFrame([(p.decode(), s, k) for p, (s, k) in v.table().items()], "piece string, score double, id int")
    longest = max(len(p.decode()) for p in v.table())
    byte_ids = F.array(*[F.lit(int(k)) for k in v.bytes_at])
    as_bytes = F.transform(
        F.sequence(F.lit(0), F.octet_length("piece") - 1),
        lambda k: F.element_at(byte_ids, F.conv(F.substring(F.hex(F.encode(F.col("piece"), "UTF-8")), k * 2 + 1, F.lit(2)), 16, 10).cast("int") + 1),
    )
    spots = words.select("word").distinct().select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("from"))
    cuts = spots.select("word", "from", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("from")))).alias("size"))
    parts = cuts.withColumn("piece", F.substring("word", F.col("from") + 1, F.col("size")))
    joined = parts.join(F.broadcast(pieces), "piece", "left").filter(F.col("id").isNotNull() | (F.col("size") == 1))
    edges = joined.select(
        "word", "from", (F.col("from") + F.col("size")).alias("to"),
        F.coalesce("score", F.octet_length("piece") * F.lit(v.byte_score)).alias("score"),
        F.when(F.col("id").isNotNull(), F.array("id")).otherwise(as_bytes).alias("ids"),
    )
    if v.merges:
        return _fold_merges(joined.select("word", "size", "piece", F.col("score"), F.when(F.col("id").isNotNull(), F.array("id")).otherwise(as_bytes).alias("ids")))
    lattice = edges.groupBy("word").agg(F.collect_list(F.struct("to", "from", "score", "ids")).alias("edges"))
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("from"), F.array().cast("array<int>").alias("ids")))

    def extend(best, to):
        ways = F.transform(
            F.filter("edges", lambda e: e["to"] == to),
            lambda e: F.struct(
                (F.element_at(best, e["from"] + 1)["score"] + e["score"]).alias("score"),
                (-e["from"]).alias("from"),
                F.concat(F.element_at(best, e["from"] + 1)["ids"], e["ids"]).alias("ids"),
            ),
        )
        return F.concat(best, F.array(F.array_max(ways)))

    folded = F.aggregate(F.sequence(F.lit(1), F.length("word")), start, extend)
    return lattice.select("word", F.element_at(folded, -1)["ids"].alias("ids"))


def _fold_merges(edges: DataFrame) -> DataFrame:
    """Joins neighbours by rank: the state is the word's symbols, the lattice a map from pieces to ranks and ids."""
    lattice = edges.groupBy("word").agg(
        F.map_from_entries(F.collect_set(F.when(F.col("size") > 1, F.struct("piece", "score")))).alias("ranks"),
        F.map_from_entries(F.collect_set(F.struct("piece", "ids"))).alias("ids"),
    )

    def join(s, _):
        ways = F.transform(
            F.sequence(F.lit(0), F.size(s) - 2),
            lambda i: F.struct(F.try_element_at("ranks", F.concat(F.get(s, i), F.get(s, i + 1))).alias("rank"), (-i).alias("from")),
        )
        best = F.array_max(F.filter(ways, lambda w: w["rank"].isNotNull()))
        i = -best["from"]
        joined = F.concat(F.slice(s, F.lit(1), i), F.array(F.concat(F.get(s, i), F.get(s, i + 1))), F.slice(s, i + 3, F.size(s)))
        return F.when(F.size(s) < 2, s).otherwise(F.coalesce(joined, s))

    letters = F.regexp_extract_all("word", F.lit("(?s)(.)"))
    folded = F.aggregate(F.sequence(F.lit(1), F.length("word")), letters, join)
    return lattice.select("word", F.flatten(F.transform(folded, lambda p: F.element_at("ids", p))).alias("ids"))
