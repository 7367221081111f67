"""Cost-balanced packing of documents' tokens into training sequences of one length.

A piece of n tokens costs n + n * n / ATTENTION: what its layers cost, and what attention inside it costs.  Each
document is tokenised once and cut where a whole sequence is full; such pieces are sequences of their own.  What is
left of a document, less than one sequence, is dealt to tasks by a hash of id and text, and a task packs CHUNK tokens
at a time.  A chunk opens as many sequences as its tokens fill, and the rest of them in sequences of powers of two, so
nothing is padded.  Pieces go in descending order, each to the sequence of the lowest cost that has room for it; where
none has, the sequence of the lowest cost that has any room is filled, and what is left of the piece waits its turn.

A task holds one chunk, whatever the sizes of its rows; rows with one id and one text may fill many chunks.
sequence_id is the task's number and a counter; rows are sorted before they are packed, so a task that runs again
gives the same sequences.

Defined cases: a null or empty text is its end token alone; a text of any length is tokenised whole; repeated rows
are packed each on its own; a null doc_id stays null; ties of length go by their place in the sorted rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from base64 import b64decode
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

CAPACITY = 2048
ATTENTION = 16_384
CHUNK = 1 << 21
END = 1
#: The one special token of the vocabulary: the text of it is the token.
SPECIAL = {"<|endoftext|>": 50256}
PIECES = "h long, doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoding(path: str):
    """The byte-level vocabulary of a ranks file; its ids are those of the same vocabulary's JSON file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {b64decode(piece): int(rank) for piece, rank in (line.split() for line in f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def tokens(text: str, path: str, end: int) -> np.ndarray:
    return np.append(encoding(path).encode_to_numpy(text, allowed_special="all"), end).astype("<u4")


def cost(n: int, attention: int = ATTENTION) -> float:
    return n + n * n / attention


def capacities(total: int, capacity: int) -> list[int]:
    """Lengths of the sequences that `total` tokens fill: whole ones, and powers of two for the rest."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def balance(lengths: Sequence[int], capacity: int = CAPACITY, attention: int = ATTENTION) -> list[tuple[int, int, int, int, int]]:
    """(item, tokens of the item before, tokens, sequence, tokens of the sequence before) of each piece; all sequences end full."""
    sizes = np.array(capacities(sum(lengths), capacity), np.int64)
    room, costs = sizes.copy(), np.zeros(len(sizes))
    waiting = [(-n, k, 0) for k, n in enumerate(lengths) if n]
    heapq.heapify(waiting)
    out = []
    while waiting:
        left, k, start = heapq.heappop(waiting)
        n = -left
        fits = room >= n
        if not fits.any():
            fits = room > 0
        b = int(np.where(fits, costs, np.inf).argmin())
        take = min(n, int(room[b]))
        out.append((k, start, take, b, int(sizes[b] - room[b])))
        room[b] -= take
        costs[b] += cost(take, attention)
        if take < n:
            heapq.heappush(waiting, (take - n, k, start + take))
    return out


def _pieces(path: str, capacity: int, end: int, keep: bool):
    """Tokens of each text: whole sequences by their checksum, what is left by its ids, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h, doc_id, text in zip(b.column("h").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = tokens(text.as_py(), path, end)
                body = ids.tobytes()
                for start in range(0, len(ids), capacity):
                    n = min(capacity, len(ids) - start)
                    part = body[4 * start : 4 * (start + n)]
                    whole = n == capacity
                    sent = None if whole and not keep else ids[start : start + n].astype("<u2").tobytes()
                    rows.append((h, doc_id, start, n, len(ids), zlib.crc32(part) if whole else None, sent))
                if len(rows) >= 4096:
                    yield _batch(rows, PIECES_ARROW)
                    rows = []
            if rows:
                yield _batch(rows, PIECES_ARROW)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


PIECES_ARROW = _arrow(PIECES)


def _packed(capacity: int, attention: int, chunk: int, keep: bool):
    schema = _arrow(SCHEMA + ", ids binary" * keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        used = total = 0
        waiting: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal used
            sizes = capacities(total, capacity)
            rows = []
            for k, start, n, b, offset in balance([r[2] for r in waiting], capacity, attention):
                doc_id, at, _, doc_tokens, ids = waiting[k]
                part = np.frombuffer(ids, "<u2", n, 2 * start)
                row = (doc_id, at + start, n, zlib.crc32(part.astype("<u4").tobytes()), doc_tokens, base + used + b, offset, sizes[b])
                rows.append((*row, part.astype("<u4").tobytes()) if keep else row)
            used += len(sizes)
            yield _batch(rows, schema)

        for b in batches:
            rows = []
            for _, doc_id, start, n, doc_tokens, crc, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if n == capacity:
                    row = (doc_id, start, n, crc, doc_tokens, base + used, 0, capacity)
                    rows.append((*row, np.frombuffer(ids, "<u2").astype("<u4").tobytes()) if keep else row)
                    used += 1
                    continue
                waiting.append((doc_id, start, n, doc_tokens, ids))
                total += n
                if total >= chunk:
                    yield from flush()
                    waiting, total = [], 0
            if rows:
                yield _batch(rows, schema)
        if waiting:
            yield from flush()

    return run


def pack_by_cost(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, attention: int = ATTENTION,
    end: int = END, path: str | None = None, chunk: int = CHUNK, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: its place in the document (start, length) and in a sequence (sequence_id, offset).

    with_ids adds `ids`, the piece's tokens as little-endian 32-bit integers; ids_crc32 is their checksum.  A sequence
    has sequence_tokens tokens: `capacity`, or a power of two for what a chunk leaves.
    """
    path = path or ranks_path()
    if encoding(path).n_vocab > 1 << 16 or end >= 1 << 16:
        raise ValueError("token ids over 65535")
    texts = id_and_text(df, id_col, text_col)
    dealt = texts.select(F.xxhash64("doc_id", "text").alias("h"), "doc_id", "text")
    pieces = dealt.mapInArrow(_pieces(path, capacity, end, with_ids), PIECES)
    sorted_pieces = pieces.repartition("h", "start").sortWithinPartitions("h", "start", "doc_id")
    return sorted_pieces.mapInArrow(_packed(capacity, attention, chunk, with_ids), SCHEMA + ", ids binary" * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences' tokens, (sequence_id, tokens: little-endian 32-bit integers), of pieces packed with_ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("tokens"))
