"""Repeats across a corpus in two meetings, shared by the byte-level and the word-level operator.

Documents live in shards (a hash of their id; a few MB of text).  A shard and a bucket (a range of content
hashes) exchange packed columns through Spark's shuffle:

1. ask: a shard sends the hashes of the anchors that stand for its windows, once each, with their counts.
   tell: a bucket answers one bit per hash: it occurs elsewhere too; and one: it is frequent.
2. ask: a shard sends what lies around the anchors that occur elsewhere, once each, with its smallest doc_id.
   tell: a bucket answers which windows have a copy in a smaller document; a run-length index finds them.

Then a shard puts both answers on its texts.  A shard sends equal content once, so what a bucket holds of one
passage grows with the number of shards and not with the number of its copies.  The windows of frequent anchors
are sent one by one and meet by their own hash, so a frequent passage with ever other surroundings is dealt
over all buckets.  A shard's answers are bits in the order in which it asked, and that order follows from the
content alone; a task that is run again asks and reads the same.

The texts are shuffled once: all three readers of the shards use one exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import run_index
from .arrays import NO_ID, U, from_planes, groups_of, mix, planes, segment_hash
from .common import id_and_text, shard_of, shards_for, text_bytes

SHARD_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
#: Anchors with so many occurrences have their windows dealt one by one.
FREQUENT = 20_000
#: Letters indexed at once, a few dozen arrays of so many numbers; a batch ends with an anchor.
INDEX_LETTERS = 1 << 20
#: How far apart the strings begin by which snippets are chosen for the index.
STRIDE = 4

ASK = "bucket int, shard int, kind int, body binary, docs binary, data binary"
TELL = "shard int, bucket int, kind int, body binary"
ANCHORS, SNIPPETS, WINDOWS = 1, 2, 3
LOW40 = U((1 << 40) - 1)


def code_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket number above 40 bits of the hash."""
    return (((h >> U(40)) * U(buckets)) >> U(24)) << U(40) | (h & LOW40)


def slices(codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted codes."""
    if len(codes):
        b = (codes >> U(40)).astype(np.int64)
        heads = groups_of(b)
        yield from zip(b[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(b)], strict=True)


#: Up to here a count is its own byte; above, bytes are eighths of a power of two.
EXACT_COUNT = 192


def packed_counts(n: np.ndarray) -> np.ndarray:
    """Counts as one byte each, exact or rounded down by a twelfth at most; 255 stands for 45,000 and more, past FREQUENT."""
    big = EXACT_COUNT + np.floor(8 * np.log2(np.maximum(n, EXACT_COUNT) / EXACT_COUNT))
    return np.where(n < EXACT_COUNT, n, np.minimum(big, 255)).astype(np.uint8)


def unpacked_counts(b: np.ndarray) -> np.ndarray:
    wide = b.astype(np.int64)
    return np.where(wide < EXACT_COUNT, wide, np.ceil(EXACT_COUNT * 2.0 ** ((wide - EXACT_COUNT) / 8)).astype(np.int64))


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


@dataclass
class Windows:
    """What an operator finds in a shard.

    Anchored runs for the first meeting: code of each run's anchor.  Then, for the chosen runs, either snippets
    (start, number of windows, anchor's place) or single windows (hash, order among the shard's documents).
    """

    code: np.ndarray
    snippet: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]] | None
    windows: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
    run_doc: np.ndarray
    window_doc: Callable[[np.ndarray], np.ndarray]


@dataclass
class Meeting:
    """Runs the exchange for one operator.

    look(table) -> (state, Windows) reads a shard; finish(state, hits) makes its output table, hits being a list
    of (first unit of a window, last window + 1) intervals of windows to remove, in the shard's own units.
    """

    look: Callable
    finish: Callable
    buckets: int
    length: int
    same_document: bool
    frequent: int = FREQUENT
    gram: int = 16  # letters of an anchor

    def ask1(self, t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        _, w = self.look(t, self.buckets)
        codes, counts = np.unique(w.code, return_counts=True)
        counts = packed_counts(counts)
        return table_of(
            [(b, shard, ANCHORS, planes(codes[i:j], 5), None, counts[i:j].tobytes()) for b, i, j in slices(codes)], ASK
        )

    def tell1(self, t: pa.Table) -> pa.Table:
        rows = list(zip(*(t.column(c).to_pylist() for c in ("shard", "bucket", "body", "data")), strict=True))
        code = np.concatenate([from_planes(r[2], U, 5) for r in rows])
        count = np.concatenate([unpacked_counts(np.frombuffer(r[3], np.uint8)) for r in rows])
        order = np.argsort(code, kind="stable")
        heads = groups_of(code[order])
        total = np.add.reduceat(count[order], heads)
        size = np.diff(np.append(heads, len(code)))
        n = np.empty(len(code), np.int64)
        n[order] = np.repeat(total, size)
        out, at = [], 0
        for shard, bucket, body, _ in rows:
            mine = n[at : at + len(body) // 5]
            at += len(mine)
            if (mine > 1).any():
                often = mine >= self.frequent
                bits = np.packbits(mine > 1).tobytes()
                out.append((shard, bucket, ANCHORS, bits + (np.packbits(often).tobytes() if often.any() else b"")))
        return table_of(out, TELL)

    def _sent(self, t: pa.Table, told: pa.Table):
        """State, and the entries of the second meeting in the order in which they are sent."""
        state, w = self.look(t, self.buckets)
        codes, inverse = np.unique(w.code, return_inverse=True)
        shared, often = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        where = {b: (i, j) for b, i, j in slices(codes)}
        for b, kind, body in zip(*(told.column(c).to_pylist() for c in ("bucket", "kind", "body")), strict=True):
            if kind == ANCHORS:
                i, j = where[b]
                raw = np.frombuffer(body, np.uint8)
                half = (j - i + 7) // 8
                shared[i:j] = np.unpackbits(raw[:half], count=j - i)
                if len(raw) > half:
                    often[i:j] = np.unpackbits(raw[half:], count=j - i)
        pick, hot = shared[inverse], often[inverse]
        if w.snippet is None:
            hot = pick
        return state, w, np.flatnonzero(pick & ~hot), np.flatnonzero(pick & hot)

    def _snippets(self, state, w: Windows, runs: np.ndarray):
        """Distinct snippets of the runs: order and heads of equal ones, smallest document first, and their codes."""
        start, n, place = w.snippet(runs)
        key = mix(segment_hash(state.buf, start, n + self.length - 1, 5) + place.astype(U) * U(0x9E3779B97F4A7C15))
        doc = state.ids[w.run_doc[runs]]
        order = np.lexsort((doc, key, w.code[runs]))
        return start, n, place, doc, order, groups_of(key[order])

    def _windows(self, state, w: Windows, runs: np.ndarray):
        h, rank = w.windows(runs)
        code = code_of(h, self.buckets)
        order = np.lexsort((rank, h, code))
        return h, rank, code, order, groups_of(h[order])

    def ask2(self, t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table_of([], ASK)
        shard = t.column("shard")[0].as_py()
        state, w, runs, single = self._sent(t, told)
        rows = []
        if len(runs):
            start, n, place, doc, order, heads = self._snippets(state, w, runs)
            one = order[heads]
            start, n, place, doc, code = start[one], n[one], place[one], doc[one], w.code[runs][one]
            size = n + self.length - 1
            data = state.buf[np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
            cut = np.concatenate([[0], np.cumsum(size)])
            for b, i, j in slices(code):
                body = planes(code[i:j], 5) + n[i:j].astype(np.uint8).tobytes() + place[i:j].astype(np.uint8).tobytes()
                rows.append((b, shard, SNIPPETS, body, planes(doc[i:j]), data[cut[i] : cut[j]].tobytes()))
        if len(single):
            h, rank, code, order, heads = self._windows(state, w, single)
            one = order[heads]
            doc = state.ids[w.window_doc(rank[one])]
            for b, i, j in slices(code[one]):
                rows.append((b, shard, WINDOWS, None, planes(doc[i:j]), planes(h[one[i:j]])))
        return table_of(rows, ASK)

    def tell2(self, t: pa.Table) -> pa.Table:
        rows = list(zip(*(t.column(c).to_pylist() for c in ("shard", "bucket", "kind", "body", "docs", "data")), strict=True))
        out = []
        for kind, answer in ((SNIPPETS, self._snippet_answers), (WINDOWS, self._window_answers)):
            mine = [r for r in rows if r[2] == kind]
            if mine:
                doc = np.concatenate([from_planes(r[4], np.int64) for r in mine])
                out += answer(mine, doc)
        return table_of(out, TELL)

    def _window_answers(self, rows: list[tuple], doc: np.ndarray) -> list[tuple]:
        h = np.concatenate([from_planes(r[5], U) for r in rows])
        order = np.lexsort((doc, h))
        heads = groups_of(h[order])
        first = np.empty(len(h), np.int64)
        first[order] = np.repeat(doc[order][heads], np.diff(np.append(heads, len(h))))
        lost, at, out = doc > first, 0, []
        for r in rows:
            mine = lost[at : at + len(r[5]) // 8]
            at += len(mine)
            if mine.any():
                out.append((r[0], r[1], WINDOWS, np.packbits(mine).tobytes()))
        return out

    def _snippet_answers(self, rows: list[tuple], doc: np.ndarray) -> list[tuple]:
        count = [len(r[4]) // 8 for r in rows]
        code = np.concatenate([from_planes(r[3][: 5 * n], U, 5) for r, n in zip(rows, count, strict=True)])
        n = np.concatenate([np.frombuffer(r[3], np.uint8, k, 5 * k) for r, k in zip(rows, count, strict=True)]).astype(np.int64)
        place = np.concatenate([np.frombuffer(r[3], np.uint8, k, 6 * k) for r, k in zip(rows, count, strict=True)]).astype(np.int64)
        buf = np.concatenate([*(np.frombuffer(r[5], np.uint8) for r in rows), np.zeros(16, np.uint8)])
        size = n + self.length - 1
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        key = mix(segment_hash(buf, start, size, 5) + place.astype(U) * U(0x9E3779B97F4A7C15))
        order = np.lexsort((doc, key, code))
        heads = groups_of(key[order])
        width = np.diff(np.append(heads, len(key)))
        first = np.empty(len(key), np.int64)
        first[order] = np.repeat(doc[order][heads], width)
        # A copy of a snippet of a smaller document loses all its windows; of the rest the index decides.
        mask = np.where(doc > first, (U(1) << n.astype(U)) - U(1), U(0))
        one = order[heads]
        by_code = groups_of(code[one])
        kinds = np.diff(np.append(by_code, len(one)))
        mixed = np.repeat(kinds > 1, kinds)
        mixed[mixed] = self._may_match(buf, start[one[mixed]], size[one[mixed]], place[one[mixed]], code[one[mixed]])
        chosen = one[mixed]
        lost = np.zeros(len(chosen), U)
        ends = np.cumsum(size[chosen])
        anchor_ends = np.append(groups_of(code[chosen])[1:], len(chosen))
        at = 0
        while at < len(chosen):
            k = np.searchsorted(ends[anchor_ends - 1], (ends[at - 1] if at else 0) + INDEX_LETTERS, "right")
            to = int(anchor_ends[min(max(k - 1, np.searchsorted(anchor_ends, at, "right")), len(anchor_ends) - 1)])
            lost[at:to] = self._indexed(buf, start[chosen[at:to]], n[chosen[at:to]], first[chosen[at:to]], code[chosen[at:to]])
            at = to
        # Each distinct snippet's mask holds for its entries of the smallest document.
        per = np.zeros(len(one), U)
        per[mixed] = lost
        every = np.empty(len(key), U)
        every[order] = np.repeat(per, width)
        mask |= np.where(doc == first, every, U(0))
        out, at = [], 0
        for r, k in zip(rows, count, strict=True):
            mine = mask[at : at + k]
            at += k
            if mine.any():
                out.append((r[0], r[1], SNIPPETS, planes(mine)))
        return out

    def _may_match(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Which snippets can share a window with another of their anchor.

        A shared window has the anchor at one place, so what two snippets share around their anchors is as long as
        a window less the anchor, and half of that lies on one side: its hash must occur twice.  Of what is left by
        that, some string around the anchor that is up to STRIDE - 1 letters shorter than a window must, too.
        """
        around = self.length - self.gram
        half = -(-around // 2)
        out = np.zeros(len(start), bool)
        anchor = start + place

        def mark(of: np.ndarray, before: int, after: int, out: np.ndarray) -> None:
            """Those of them whose string from `before` letters before the anchor's start to `after` behind it occurs twice."""
            whole = of[(place[of] >= before) & (size[of] - place[of] >= after)]
            string = segment_hash(buf, anchor[whole] - before, np.full(len(whole), before + after), 3) ^ mix(code[whole].copy())
            _, inverse, count = np.unique(string, return_inverse=True, return_counts=True)
            out[whole] |= count[inverse] > 1

        every = np.arange(len(start))
        mark(every, half, 0, out)
        mark(every, 0, self.gram + half, out)
        left, out = np.flatnonzero(out), np.zeros(len(start), bool)
        for before in range(0, around + 1, STRIDE):
            mark(left, before, self.gram + max(0, around - before - STRIDE + 1), out)
        return out

    def _indexed(self, buf: np.ndarray, start: np.ndarray, n: np.ndarray, doc: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Bit mask of the windows of each snippet that a snippet of a smaller document has too.

        Only snippets of one anchor can share a window.  By their order among the anchor's documents they form
        blocks, doubling in width: the even blocks of a width are indexed, the odd ones stream through that index
        with the tag of their pair of blocks, so each snippet meets the snippets of every smaller document of its
        anchor once and no other.
        """
        order = np.lexsort((doc, code))
        start, n, doc, code = start[order], n[order], doc[order], code[order]
        heads = groups_of(code)
        group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(code))))
        step = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (code[1:] != code[:-1]))])
        rank = step - step[heads][group]  # of the document within its anchor
        most = np.maximum.reduceat(rank, heads)[group]
        size = n + self.length - 1
        mask, full = np.zeros(len(order), U), (U(1) << n.astype(U)) - U(1)

        def letters(which: np.ndarray) -> np.ndarray:
            k = size[which]
            return buf[np.repeat(start[which] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]

        for level in range(int(most.max(initial=0)).bit_length()):
            block = rank >> level
            # what an earlier document of the same block covers wholly is neither asked about nor needed to answer
            open_ = mask != full
            known = np.flatnonzero((block % 2 == 0) & (most >> level > block) & open_)
            asked = np.flatnonzero((block % 2 == 1) & open_)
            if not len(known) or not len(asked):
                continue
            pair = group * (int(most.max()) + 1) + (block >> 1)
            index = run_index.build(letters(known), size[known], pair[known])
            longest = run_index.matching_statistics(index, letters(asked), size[asked], self.length, pair[asked])
            text = np.repeat(np.arange(len(asked)), size[asked])
            at = np.arange(len(text)) - (np.cumsum(size[asked]) - size[asked])[text]
            hit = longest >= self.length
            np.bitwise_or.at(mask, asked[text[hit]], U(1) << at[hit].astype(U))
        back = np.empty(len(order), U)
        back[order] = mask
        return back

    def finish2(self, t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            raise ValueError("an answer without its shard")
        state, w, runs, single = self._sent(t, told)
        answers = {(k, b): body for b, k, body in zip(*(told.column(c).to_pylist() for c in ("bucket", "kind", "body")), strict=True)}
        lows, highs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(runs):
            start, n, _, doc, order, heads = self._snippets(state, w, runs)
            mask = np.zeros(len(heads), U)
            for b, i, j in slices(w.code[runs][order[heads]]):
                if (SNIPPETS, b) in answers:
                    mask[i:j] = from_planes(answers[SNIPPETS, b], U)
            width = np.diff(np.append(heads, len(order)))
            first, mask = np.repeat(doc[order[heads]], width), np.repeat(mask, width)
            start, n, doc = start[order], n[order], doc[order]
            full = (U(1) << n.astype(U)) - U(1)
            mask = np.where(doc > first, full, mask)
            whole = mask == full
            lows.append(start[whole])
            highs.append(start[whole] + n[whole])
            part = np.flatnonzero((mask != 0) & ~whole)
            for k in range(int(n[part].max(initial=0))):
                bit = part[(mask[part] >> U(k) & U(1)).astype(bool)]
                lows.append(start[bit] + k)
                highs.append(start[bit] + k + 1)
        if len(single):
            _, rank, code, order, heads = self._windows(state, w, single)
            lost = np.zeros(len(heads), bool)
            for b, i, j in slices(code[order[heads]]):
                if (WINDOWS, b) in answers:
                    lost[i:j] = np.unpackbits(np.frombuffer(answers[WINDOWS, b], np.uint8), count=j - i)
            width = np.diff(np.append(heads, len(order)))
            rank, least = rank[order], np.repeat(rank[order[heads]], width)
            doc, least_doc = w.window_doc(rank), w.window_doc(least)
            later = rank_after(state, rank, least) if self.same_document else state.ids[doc] > state.ids[least_doc]
            at = state.unit(rank[np.repeat(lost, width) | later])
            lows.append(at)
            highs.append(at + 1)
        return self.finish(state, np.concatenate(lows), np.concatenate(highs), self.length)


def rank_after(state, rank: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether a window starts after another: in a larger document, or later in the same one."""
    a, b = state.ids[state.doc_of(rank)], state.ids[state.doc_of(least)]
    return (a > b) | ((a == b) & (state.inside(rank) > state.inside(least)))


def covered(lows: np.ndarray, highs: np.ndarray, length: int, n: int) -> np.ndarray:
    """Units under the windows that start in low..high-1."""
    order = np.argsort(lows)
    low, end = lows[order], np.maximum.accumulate(np.minimum(highs[order] - 1 + length, n))
    # stretches that do not touch, so that each border is the place of one change
    head = np.flatnonzero(np.concatenate([[True], low[1:] > end[:-1]])) if len(low) else order
    change = np.zeros(n + 1, np.int8)
    change[low[head]] = 1
    change[end[np.append(head[1:], len(low)) - 1] if len(low) else head] = -1
    return np.cumsum(change[:n], dtype=np.int8) > 0


def run_meeting(
    df: DataFrame, meeting_of: Callable[[int], Meeting], schema: str, id_col: str, text_col: str, shard_bytes: int = SHARD_BYTES, carry: bool = False
) -> DataFrame:
    """The operator's output; with carry, a struct column `carried` holds each row's other columns."""
    base = id_and_text(df, id_col, text_col)
    total = text_bytes(base)
    if carry:
        others = [f"`{c}`" for c in df.columns if c not in (id_col, text_col)]
        carried = F.struct(*others) if others else F.struct(F.lit(0).alias("nothing"))
        base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), carried.alias("carried"))
        kept = T.StructField("carried", base.schema["carried"].dataType)
        schema = T.StructType([*T._parse_datatype_string(schema).fields, kept])
    meeting = meeting_of(shards_for(total, BUCKET_BYTES))
    docs = base.withColumn("shard", shard_of(F.col("doc_id"), shards_for(total, shard_bytes)))
    ask1, tell1, ask2, tell2, finish = meeting.ask1, meeting.tell1, meeting.ask2, meeting.tell2, meeting.finish2

    def f1(t: pa.Table) -> pa.Table:
        return ask1(t)

    def f2(t: pa.Table) -> pa.Table:
        return tell1(t)

    def f3(t: pa.Table, told: pa.Table) -> pa.Table:
        return ask2(t, told)

    def f4(t: pa.Table) -> pa.Table:
        return tell2(t)

    def f5(t: pa.Table, told: pa.Table) -> pa.Table:
        out = finish(t, told)
        return out.append_column("carried", t.column("carried")) if carry else out

    shards = docs.groupBy("shard")
    told1 = shards.applyInArrow(f1, ASK).groupBy("bucket").applyInArrow(f2, TELL)
    told2 = shards.cogroup(told1.groupBy("shard")).applyInArrow(f3, ASK).groupBy("bucket").applyInArrow(f4, TELL)
    return shards.cogroup(told1.unionByName(told2).groupBy("shard")).applyInArrow(f5, schema)


def ids_out(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)
