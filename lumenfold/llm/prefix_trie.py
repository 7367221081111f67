"""The trie of conversation prefixes, with totals of each subtree by time-forward processing.

Turns are numbered by ranges of (conversation, turn), so that a conversation of any length spreads over tasks, and a
prefix is named by the sum of 95-bit hashes of (place, role, text) up to its end; a prefix's parent is its name less
the last hash.  One aggregate gives the nodes with their members; the smallest member owns a node.

Totals go from the leaves up.  A node's tier is the least t with at most WIDTH ** (t + 1) members, and nodes of one tier
that hang together are a shard: no level of a shard has more than WIDTH nodes with over WIDTH ** t members, or
more leaves' worth of members in the lowest tier.  A task sorts its shards' nodes in reverse level order (Spark's external
sort) and passes each node's totals to its parent through a priority queue that spills sorted runs.  What the shards'
roots have is summed by parent and goes into the tiers above, shard by shard, up to the one root.  So no task ever
holds more than one level of one shard, whatever share of all conversations has one first turn.

The hash over a node's ending members is one long text by definition: ids are ranged and joined in blocks first, and a
node's blocks stream through one digest.

Defined cases: turns are ordered by turn, null first, equal ones by a hash of their content; a null role or text is
empty; repeated rows are turns of their own; rows without a conversation id are turns of no conversation; a conversation
without turns is a member of the root; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import ranking

from .components import ensure_checkpoint_dir

WIDTH = 256
SPILL = 200_000
IDS_A_BLOCK = 4096
ROOT = "0"


def ordered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, i, mark, points): each turn's number from 1, a digest of role and text, and the text's code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = df.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("mark"), F.length(text).cast("long").alias("points"),
    )
    return ranking.with_rank(rows, ["conv_id"], ["turn", "mark"], "i").select("conv_id", F.col("i").cast("long").alias("i"), "mark", "points")


def conversations_of(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id").distinct()


def with_shared_heads(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c begins with the first h turns of c - c % group instead of its own first h; h = crc32(c) % most.

    Where that conversation has fewer turns, all of them; h is at most a handful, so heads are small whatever their source.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = turns.filter((F.col("i") < most) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), "i", "mark", "points")
    sizes = heads.groupBy("base").agg(F.count("*").alias("size"))
    begun = conversations_of(turns).select("conv_id", base.alias("base"), h.alias("h")).join(heads, "base").filter("i <= h")
    rest = turns.filter(F.col("i") > h).withColumns({"base": base, "h": h}).join(sizes, "base", "left")
    place = F.col("i") - F.col("h") + F.least("h", F.coalesce("size", F.lit(0)))
    return begun.select("conv_id", "i", "mark", "points").unionByName(rest.select("conv_id", place.cast("long").alias("i"), "mark", "points"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent, points) of each turn; key names the sequence up to it, parent the one before it."""
    high = F.xxhash64(F.lit(7), "i", "mark").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)")
    value = (high + F.pmod(F.xxhash64(F.lit(11), "mark", "i"), F.lit(1 << 32)).cast("decimal(10,0)")).cast("decimal(38,0)")
    rows = ranking.ranged(turns.withColumn("value", value), ["conv_id"], ["i"])
    summed = ranking.running(rows, ["conv_id"], ["i"], F.col("value"), "key")
    return summed.select(
        "conv_id", F.col("i").alias("depth"), F.col("key").cast("string").alias("key"), (F.col("key") - F.col("value")).cast("string").alias("parent"), "points"
    )


class SpillingQueue:
    """A priority queue of tuples; beyond `limit` of them in memory it writes sorted runs to unnamed files of the task."""

    def __init__(self, limit: int = SPILL):
        self.limit, self.heap, self.heads = limit, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            run = tempfile.TemporaryFile()
            for x in sorted(self.heap):
                pickle.dump(x, run)
            run.seek(0)
            self.heap = []
            self._next(run, len(self.heads))

    def _next(self, run, number: int) -> None:
        try:
            heapq.heappush(self.heads, (pickle.load(run), number, run))
        except EOFError:
            run.close()

    def take(self, key: tuple) -> Iterator[tuple]:
        """Removes and gives the items that begin with key, the least of the queue."""
        n = len(key)
        while self.heap and self.heap[0][:n] == key:
            yield heapq.heappop(self.heap)
        while self.heads and self.heads[0][0][:n] == key:
            item, number, run = heapq.heappop(self.heads)
            yield item
            self._next(run, number)

    def __bool__(self) -> bool:
        return bool(self.heap or self.heads)


TOTALS = "key string, n_children long, n_leaves long, saved_tokens long"


def _forward(spill: int):
    """Rows sorted by shard, depth from the deepest, key: totals of each node, passed on to parents inside the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, queue = None, SpillingQueue(spill)
        for b in batches:
            out = []
            for of, depth, key, parent, own, children, leaves, saved in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if of != shard:
                    if queue:
                        raise ValueError(f"a parent is missing in shard {shard}")
                    shard = of
                saved += own
                for _, _, more_leaves, more_saved in queue.take((-depth, key)):
                    children += 1
                    leaves += more_leaves
                    saved += more_saved
                leaves = max(1, leaves)
                out.append((key, children, leaves, saved))
                if key != shard:
                    queue.push((1 - depth, parent, leaves, saved))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), *[pa.int64()] * 3), strict=True)],
                    [x.split()[0] for x in TOTALS.split(", ")],
                )

    return run


def _tier(n: Column, tiers: int, width: int) -> Column:
    out = F.lit(tiers)
    for t in range(tiers - 1, -1, -1):
        out = F.when(n <= width ** (t + 1), t).otherwise(out)
    return out


def _sharded(nodes: DataFrame, rows: DataFrame, tiers: int, width: int) -> DataFrame:
    """Nodes with tier and shard, the key of the shard's root: on the owner's path, the first node of that tier or below."""
    placed = nodes.withColumn("tier", _tier(F.col("n_convs"), tiers, width))
    if not tiers:
        return placed.withColumn("shard", F.lit(ROOT))
    wide = nodes.filter(F.col("n_convs") > width).select("key", "n_convs")
    seen = rows.join(wide, "key", "left").select("conv_id", F.struct("depth", "key").alias("at"), F.coalesce("n_convs", F.lit(1)).alias("n"))
    first = [F.min(F.when(F.col("n") <= width ** (t + 1), F.col("at"))).alias(f"first{t}") for t in range(tiers)]
    paths = seen.groupBy("conv_id").agg(*first).select(F.col("conv_id").alias("owner"), *[F.col(f"first{t}.key").alias(f"first{t}") for t in range(tiers)])
    shard = F.lit(ROOT)
    for t in range(tiers):
        shard = F.when(F.col("tier") == t, F.col(f"first{t}")).otherwise(shard)
    return placed.join(paths, "owner", "left").withColumn("shard", shard).drop(*[f"first{t}" for t in range(tiers)])


def _ends(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest of each key's conversation ids, ascending and joined by commas."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []
        for b in batches:
            for k, c in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if ids and (k != key or len(ids) >= IDS_A_BLOCK):
                    out.append((key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = k
                ids.append(c)
            if out:
                yield _strings(out)
                out = []
        if ids:
            yield _strings([(key, ids[0], ",".join(map(str, ids)))])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        for b in batches:
            for k, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                if k == key:
                    sha.update(b"," + text.encode())
                    continue
                if sha:
                    out.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["key", "ends_sha256"])
                out = []
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])

    joined = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(blocks, "key string, first long, text string")
    return joined.repartition("key").sortWithinPartitions("key", "first").select("key", "text").mapInArrow(digests, "key string, ends_sha256 string")


def _strings(rows: list[tuple]) -> pa.RecordBatch:
    key, first, text = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(first, pa.int64()), pa.array(text, pa.string())], ["key", "first", "text"])


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None, width: int = WIDTH, spill: int = SPILL) -> DataFrame:
    """One row per distinct prefix of the turns (conv_id, i from 1 without gaps, mark, points).

    conversations names those that may have no turns.  conv_id is a node's smallest member, so (conv_id, depth) is a key;
    saved_tokens counts the code points that sharing the subtree's turns saves.
    """
    ensure_checkpoint_dir(turns.sparkSession)
    rows = prefixes(turns).checkpoint()
    members = (turns if conversations is None else conversations).select("conv_id").distinct()
    n, least = members.agg(F.count("*"), F.min("conv_id")).first()
    tiers = 0
    while width ** (tiers + 1) < n:
        tiers += 1
    found = rows.groupBy("key").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.min("depth").alias("depth"),
        F.min("parent").alias("parent"), F.min("points").alias("points"),
    )
    root = turns.sparkSession.range(1 if n else 0).select(
        F.lit(ROOT).alias("key"), F.lit(n).cast("long").alias("n_convs"), F.lit(least).cast("long").alias("owner"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("points"),
    )
    nodes = _sharded(found.unionByName(root).checkpoint(), rows, tiers, width).checkpoint()
    columns = "shard", "depth", "key", "parent", "own", "children", "leaves", "saved"
    passed, totals = [], []
    for t in range(tiers + 1):
        here = nodes.filter(F.col("tier") == t).withColumn("own", (F.col("n_convs") - 1) * F.col("points"))
        if passed:
            below = reduce(DataFrame.unionByName, passed).groupBy(F.col("above").alias("key")).agg(
                F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
            )
            here = here.join(below, "key", "left").fillna(0, ["children", "leaves", "saved"])
        else:
            here = here.withColumns({c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")})
        order = F.asc("shard"), F.desc("depth"), F.asc("key")
        done = here.select(*columns).repartition("shard").sortWithinPartitions(*order).mapInArrow(_forward(spill), TOTALS).checkpoint()
        totals.append(done)
        tops = here.filter("key = shard and parent is not null").select("key", F.col("parent").alias("above"))
        passed.append(done.join(tops, "key"))
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "key")).alias("at"))
    ends = members.join(last, "conv_id", "left").select(F.coalesce("at.key", F.lit(ROOT)).alias("key"), "conv_id").checkpoint()
    whole = nodes.join(reduce(DataFrame.unionByName, totals), "key").join(_ends(ends), "key", "left")
    owners = nodes.filter(F.col("depth") > 0).select(F.col("key").alias("parent"), F.col("owner").alias("parent_conv_id"))
    # the root's children are many and its owner is known, so they need no join
    near = whole.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least).cast("long")))
    far = whole.filter("depth > 1").join(owners, "parent", "left")
    return near.unionByName(far).select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", **how) -> DataFrame:
    """The prefix trie of a table of turns, one conversation a conv_id."""
    ensure_checkpoint_dir(df.sparkSession)
    return prefix_trie(ordered_turns(df, conv_col, turn_col, role_col, text_col), **how)


def shared_head_trie(df: DataFrame, **how) -> DataFrame:
    """The prefix trie of the conversations that with_shared_heads() rebuilds; those left without turns count at the root."""
    ensure_checkpoint_dir(df.sparkSession)
    own = ordered_turns(df).checkpoint()
    return prefix_trie(with_shared_heads(own), conversations_of(own), **how)


def last_turns(nodes: DataFrame, df: DataFrame) -> DataFrame:
    """Nodes of conversation_trie with the role and text of their last turn, from the table of turns; null for the root."""
    rows = df.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    mark = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    ranked = ranking.with_rank(rows.withColumn("mark", mark), ["conv_id"], ["turn", "mark"], "depth")
    return nodes.join(ranked.select("conv_id", F.col("depth").cast("long").alias("depth"), "role", "text"), ["conv_id", "depth"], "left")
