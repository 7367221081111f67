"""Variable-capacity best-fit packing of token runs into training sequences.

Documents are cut into pieces of at most the largest permitted length.  Pieces are dealt to shards by a hash
of the document, a shard being about SHARD_PIECES documents, and each shard packs on its own: longest first,
every piece into the open bin that it fills best.  Where none fits, a new bin is opened, and all permitted lengths
compete for it: a length costs what a sequence of it costs to train (attention grows with its square), and what it
can hold is the piece and, of its room, only as much as shorter pieces are still to come for and open bins do not
take; the least cost per token wins.  At the end each bin shrinks to the shortest permitted length that holds its
contents, and the shrunken bin's cost is what counts.  Single-length packings of the same shard are compared by the
same cost, and the cheapest packing stays, so mixing lengths never costs more than one length.

The only waste that sharding adds is one partly filled bin of each length per shard.  A shard's state is one
integer bitset of free lengths, so memory is bounded by the shard, which the number of rows sets and no key.

Defined cases: null and empty texts have no tokens and give one row without a bin; a long document gives
several pieces in order; repeated rows are packed each on its own; equal lengths go by (doc_id, piece); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, id_and_text, shard_of
from .components import ensure_checkpoint_dir

#: Permitted sequence lengths in tokens; what a sequence costs besides its tokens, and the length at which attention
#: costs as much as the tokens.
CAPACITIES = (512, 1024, 2048, 4096)
BIN_COST = 16
ATTENTION = 16_384
SHARD_PIECES = 20_000
SCHEMA = (
    "doc_id long, piece int, n_tokens int, bin_id string, bin_capacity int, bin_used int, bin_offset int, piece_from long, text_hash long"
)


def cost(capacity: int, bin_cost: int = BIN_COST, attention: int = ATTENTION) -> float:
    return capacity + capacity * capacity / attention + bin_cost


def _fill(lengths: Sequence[int], capacities: Sequence[int], bin_cost: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length, and each bin's final capacity.  lengths: descending, each 1..max capacity."""
    capacities = sorted(capacities)
    price = {c: cost(c, bin_cost) for c in capacities}
    down = [-n for n in lengths]
    rest = [0] * (len(lengths) + 1)  # tokens of the pieces from here on
    for k in range(len(lengths) - 1, -1, -1):
        rest[k] = rest[k + 1] + lengths[k]
    free = 0  # room of all open bins
    open_bins: dict[int, list[int]] = {}
    free_bits = 0
    used: list[int] = []
    bins: list[int] = []
    offsets: list[int] = []
    for k, n in enumerate(lengths):
        fit = free_bits >> n
        if fit:
            room = n + ((fit & -fit).bit_length() - 1)
            b = open_bins[room].pop()
            if not open_bins[room]:
                free_bits &= ~(1 << room)
            free -= n
        else:
            best, least = 0, float("inf")
            for c in capacities:
                if c >= n:
                    # pieces to come that are short enough for the bin's room, less what open bins take
                    fitting = rest[max(k + 1, bisect_left(down, n - c))]
                    per_token = price[c] / (n + min(c - n, max(0, fitting - free)))
                    if per_token < least:
                        best, least = c, per_token
            b, room = len(used), best
            used.append(0)
            free += best - n
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        room -= n
        if room:
            open_bins.setdefault(room, []).append(b)
            free_bits |= 1 << room
    return bins, offsets, [next(c for c in capacities if c >= u) for u in used]


def pack(lengths: Sequence[int], capacities: Sequence[int], bin_cost: int = BIN_COST) -> tuple[list[int], list[int], list[int]]:
    """The cheapest of the mixed packing and the single-length ones, all downsized to the permitted lengths."""
    choices = [_fill(lengths, capacities, bin_cost)]
    ordered = sorted(capacities)
    for c in ordered:
        if not lengths or c >= lengths[0]:
            bins, offsets, _ = _fill(lengths, [c], bin_cost)
            used = [0] * (max(bins, default=-1) + 1)
            for b, n in zip(bins, lengths, strict=True):
                used[b] += n
            choices.append((bins, offsets, [next(s for s in ordered if s >= u) for u in used]))
    return min(choices, key=lambda x: sum(cost(c, bin_cost) for c in x[2]))


def _pack_shard(pdf: pd.DataFrame, capacities: Sequence[int], bin_cost: int) -> pd.DataFrame:
    shard = int(pdf["shard"].iloc[0])
    longest = max(capacities)
    rows = []
    for doc_id, n, h in zip(pdf["doc_id"].tolist(), pdf["n_tokens"].tolist(), pdf["text_hash"].tolist(), strict=True):
        known = doc_id is not None and doc_id == doc_id
        rows.extend((not known, int(doc_id) if known else 0, k, min(longest, n - k * longest), h) for k in range(-(-n // longest)))
    rows.sort(key=lambda r: (-r[3], *r[:3]))
    bins, offsets, final = pack([r[3] for r in rows], capacities, bin_cost)
    used = [0] * len(final)
    for b, r in zip(bins, rows, strict=True):
        used[b] += r[3]
    return pd.DataFrame(
        {
            "doc_id": pd.array([None if r[0] else r[1] for r in rows], dtype="Int64"),
            "piece": [r[2] for r in rows],
            "n_tokens": [r[3] for r in rows],
            "bin_id": [f"{shard}-{b}" for b in bins],
            "bin_capacity": [final[b] for b in bins],
            "bin_used": [used[b] for b in bins],
            "bin_offset": offsets,
            "piece_from": [r[2] * longest for r in rows],
            "text_hash": [r[4] for r in rows],
        }
    )


def pack_lengths(
    lengths: DataFrame, capacities: Sequence[int] = CAPACITIES, bin_cost: int = BIN_COST, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """Pack (doc_id, n_tokens, text_hash) rows; the rows are read three times."""
    rows = lengths.filter("n_tokens > 0").count()
    shards = max(1, -(-rows // shard_pieces))
    # rows without an id are dealt by their text, so none of them makes a shard large
    dealt = lengths.withColumn("shard", shard_of(F.coalesce("doc_id", "text_hash"), shards))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack_shard(pdf, capacities, bin_cost)

    empty = lengths.filter("n_tokens = 0").selectExpr(
        "doc_id", "0 piece", "0 n_tokens", "cast(null as string) bin_id", "cast(null as int) bin_capacity",
        "cast(null as int) bin_used", "cast(null as int) bin_offset", "0L piece_from", "text_hash",
    )
    return dealt.filter("n_tokens > 0").groupBy("shard").applyInPandas(packed, SCHEMA).unionByName(empty)


def best_fit_packing(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per piece: where it lies (bin_id, bin_offset), and the bin's downsized capacity and fill."""
    ensure_checkpoint_dir(df.sparkSession)
    lengths = id_and_text(df, id_col, text_col).select(
        "doc_id", F.regexp_count("text", F.lit(WORD_PATTERN)).cast("long").alias("n_tokens"), F.xxhash64("text").alias("text_hash")
    )
    # three numbers a document: counted once, since the counting is nearly all of the work
    return pack_lengths(lengths.checkpoint(), **how)


def bins_of(packed: DataFrame) -> DataFrame:
    """One row per bin: capacity, fill and number of pieces."""
    return (
        packed.filter("bin_id is not null")
        .groupBy("bin_id")
        .agg(F.first("bin_capacity").alias("bin_capacity"), F.sum("n_tokens").alias("bin_used"), F.count("*").alias("pieces"))
    )


def sequences(df: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed token arrays: (bin_id, bin_capacity, tokens), pieces in offset order, a bin at most one capacity long.

    A piece finds its text by id and text hash, so repeated rows give each of their pieces once.
    """
    texts = id_and_text(df, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text").dropDuplicates(["doc_id", "text_hash"])
    words = texts.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("h"), F.regexp_extract_all("text", F.lit(f"({WORD_PATTERN})"), 1).alias("words"))
    pieces = packed.filter("bin_id is not null")
    placed = pieces.join(words, (pieces["text_hash"] == words["h"]) & pieces["doc_id"].eqNullSafe(words["of"])).select(
        "bin_id", "bin_capacity", "bin_offset", F.slice("words", (F.col("piece_from") + 1).cast("int"), F.col("n_tokens")).alias("part"),
    )
    return placed.groupBy("bin_id", "bin_capacity").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("bin_offset", "part"))), lambda p: p["part"])).alias("tokens")
    )
