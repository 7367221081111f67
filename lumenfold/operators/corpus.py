"""Capture groups and frozen splits: edges, components, group ids, assignments, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.expr import hamming
from lumenfold.functions.session import ensure_checkpoint_dir

from .labels import ISO_TYPE, LEGACY_TYPE
from .ranking import running, with_previous, with_rank

SESSION_GAP_SECONDS = 30 * 60
PHASH_LIMIT, DHASH_LIMIT = 5, 6


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once: empty for a valid manifest."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def with_private(samples: DataFrame, private: DataFrame, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Samples with their private capture row, and the samples that have none."""
    return samples.join(private, key), samples.join(private, key, "left_anti")


def _dated(captures: DataFrame) -> DataFrame:
    us = F.unix_micros(F.col("capture_datetime").cast("timestamp"))
    return captures.filter("capture_datetime is not null").select("sample_id", "model", us.alias("us"))


def session_edges(captures: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """Neighbours in time of one model at most the gap apart, both ends included; undated rows have none.

    A model's captures are dealt by ranges of time, so a popular model is many tasks.
    """
    near = with_previous(_dated(captures), ["model"], ["us", "sample_id"], ["us", "sample_id"])
    near = near.filter(F.col("us") - F.col("previous.us") <= gap_seconds * 1_000_000)
    return near.select(F.least("previous.sample_id", "sample_id").alias("a"), F.greatest("previous.sample_id", "sample_id").alias("b"))


def capture_sessions(captures: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """Each dated capture's session as the smallest sample of it, without walking the chain of edges."""
    near = with_previous(_dated(captures), ["model"], ["us", "sample_id"], ["us"])
    new = F.coalesce((F.col("us") - F.col("previous.us") > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    runs = running(near, ["model"], ["us", "sample_id"], new, "run").select("sample_id", "model", "run")
    least = runs.groupBy("model", "run").agg(F.min("sample_id").alias("session"))
    return runs.join(least, ["model", "run"]).select("sample_id", "session")


def _bands(column: Column, bands: int, bits: int = 64) -> list[Column]:
    cuts = [bits * k // bands for k in range(bands + 1)]
    return [F.shiftrightunsigned(column, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _split_bits(taken: range, parts: int, bits: int = 64) -> list[int]:
    """Masks of so many parts of the bits outside a band."""
    rest = [k for k in range(bits) if k not in taken]
    cuts = [len(rest) * k // parts for k in range(parts + 1)]
    return [sum(1 << k for k in rest[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _refined(rows: DataFrame, hash_col: str, band_col: str, limit: int, out: str) -> DataFrame:
    """Rows once for each part of the hash's bits outside its band: limit + 1 parts, so two near hashes agree in one."""
    cuts = [64 * k // (limit + 1) for k in range(limit + 2)]
    masks = [_split_bits(range(cuts[k], cuts[k + 1]), limit + 1) for k in range(limit + 1)]
    value = lambda s: F.coalesce(*[F.when(F.col(band_col) == k, F.col(hash_col).bitwiseAND(F.lit(_signed(m[s])))) for k, m in enumerate(masks)])
    parts = F.explode(F.array(*[F.struct(F.lit(s).alias("part"), value(s).alias("value")) for s in range(limit + 1)])).alias(out)
    return rows.select("*", parts)


def near_pairs(hashes: DataFrame, p_limit: int = PHASH_LIMIT, d_limit: int = DHASH_LIMIT, crowd: int = 2000) -> DataFrame:
    """All pairs of distinct hash values within both limits, exactly, without comparing all with all.

    With one band more than differing bits are allowed, two hashes within the limit agree in some band.  Equal
    hash values are joined to one representative first, so a flood of identical images is a star and not a clique.
    Where over `crowd` hashes share their bands, the bits outside them are cut in bands again, first of phash and then of
    dhash, and only hashes that agree there too are compared: two within the limits still do, since their bands are equal.
    """
    ensure_checkpoint_dir(hashes.sparkSession)
    reps = hashes.groupBy("phash", "dhash").agg(F.min("sample_id").alias("rep")).checkpoint()
    p = F.posexplode(F.array(*_bands(F.col("phash"), p_limit + 1))).alias("pb", "pv")
    banded = reps.select("rep", "phash", "dhash", p)
    d = F.posexplode(F.array(*_bands(F.col("dhash"), d_limit + 1))).alias("db", "dv")
    rows, key = banded.select("rep", "phash", "dhash", "pb", "pv", d), ["pb", "pv", "db", "dv"]
    found = []
    for side in (("phash", "pb", p_limit, "pr"), ("dhash", "db", d_limit, "dr"), None):
        if side is None:
            found.append(_within(rows, key, p_limit, d_limit))
            break
        crowded = rows.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select(*key).checkpoint()
        found.append(_within(rows.join(crowded, key, "left_anti"), key, p_limit, d_limit))
        if crowded.isEmpty():
            break
        rows = _refined(rows.join(crowded, key, "left_semi"), *side)
        key = [*key, side[3]]
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    same = hashes.join(reps, ["phash", "dhash"]).filter("sample_id <> rep").select(F.col("rep").alias("a"), F.col("sample_id").alias("b"))
    return pairs.distinct().unionByName(same)


def _within(rows: DataFrame, key: Sequence[str], p_limit: int, d_limit: int) -> DataFrame:
    left = rows.select(*key, F.col("rep").alias("a"), F.col("phash").alias("pa"), F.col("dhash").alias("da"))
    right = rows.select(*key, F.col("rep").alias("b"), F.col("phash").alias("pb2"), F.col("dhash").alias("db2"))
    pairs = left.join(right, list(key)).filter(
        (F.col("a") < F.col("b")) & (hamming(F.col("pa"), F.col("pb2")) <= p_limit) & (hamming(F.col("da"), F.col("db2")) <= d_limit)
    )
    return pairs.select("a", "b")


def components(nodes: DataFrame, edges: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, root): the smallest key of each connected component, single nodes included.

    Labels are lowered along edges and through their own labels at once, so the rounds grow with the logarithm
    of a chain's length.  Each round is checkpointed.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")).checkpoint()
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("label").alias("m")).withColumnRenamed("a", "node")
        lowered = label.join(near, "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        # what a node's old label learned holds for the node too
        hook = lowered.groupBy(F.col("was").alias("node")).agg(F.min("label").alias("h"))
        hooked = lowered.join(hook, "node", "left").select("node", F.least("label", F.coalesce("h", "label")).alias("label"), "was")
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("j"))
        new = hooked.join(jump, "label", "left").select("node", F.least("label", F.coalesce("j", "label")).alias("label"), "was").checkpoint()
        if new.filter("label <> was").isEmpty():
            break
        label = new.select("node", "label")
    return nodes.select(key).join(label.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("label", key).alias("root"))


def group_ids(members: DataFrame, root: str = "root", key: str = "sample_id") -> DataFrame:
    """(root, group_id, size): grp_ and 16 hex digits of the SHA-256 over the sorted member ids, one a line."""
    return members.groupBy(root).agg(F.array_sort(F.collect_list(F.col(key).cast("string"))).alias("m")).select(
        root, F.concat(F.lit("grp_"), F.substring(F.sha2(F.array_join("m", "\n"), 256), 1, 16)).alias("group_id"), F.size("m").alias("size")
    )


def build_groups(samples: DataFrame, captures: DataFrame, hashes: DataFrame, frozen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Capture groups of a corpus: (members, groups).

    samples(sample_id, model), captures(sample_id, capture_datetime), hashes(sample_id, phash, dhash), frozen(sample_id,
    split).  Samples of one session, and near duplicates, belong together.  Each session becomes one node first, so
    chains in time cost no rounds and only visual links between sessions enter the components.  members: sample_id,
    model, session, root, group_id, split; groups: group_id, size, models, split, conflict, new_members (not frozen).
    A sample without a capture row or hashes is an error, and so is an id that occurs twice.
    """
    for name, rows in (
        ("repeated in the manifest", require_unique(samples, "sample_id")),
        ("without a private capture row", samples.join(captures, "sample_id", "left_anti")),
        ("without perceptual hashes", samples.join(hashes, "sample_id", "left_anti")),
    ):
        bad = [r["sample_id"] for r in rows.select("sample_id").orderBy("sample_id").limit(5).collect()]
        if bad:
            raise ValueError(f"samples {name}, the first: {bad}")
    ensure_checkpoint_dir(samples.sparkSession)
    named = samples.select("sample_id", F.coalesce("model", F.lit("unknown")).alias("model"))
    dated = named.join(captures.select("sample_id", "capture_datetime"), "sample_id")
    sessions = named.join(capture_sessions(dated), "sample_id", "left").withColumn("session", F.coalesce("session", "sample_id")).checkpoint()
    own = hashes.join(named.select("sample_id"), "sample_id", "left_semi").select("sample_id", "phash", "dhash")
    roots = extend_components(sessions.select("sample_id", F.col("session").alias("root")), near_pairs(own))
    members = sessions.join(roots, "sample_id").checkpoint()
    named_groups = group_ids(members)
    splits = assign_groups(members.select("sample_id", F.col("root").alias("group_id")), frozen if frozen is not None else members.selectExpr("sample_id", "'' AS split").limit(0))
    fresh = members.join(frozen.select("sample_id"), "sample_id", "left_anti") if frozen is not None else members
    counted = members.groupBy("root", "model").agg(F.count("*").alias("n")).groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "n")))).alias("models"))
    groups = (
        named_groups.join(counted, "root").join(splits.withColumnRenamed("group_id", "root"), "root")
        .join(fresh.groupBy("root").agg(F.count("*").alias("new_members")), "root", "left").fillna(0, ["new_members"])
    ).checkpoint()
    out = members.join(groups.select("root", "group_id", "split"), "root").select("sample_id", "model", "session", "root", "group_id", "split")
    return out, groups.select("group_id", "size", "models", "split", "conflict", "new_members")


def extend_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (sample_id, root) after new edges (a, b): labels(sample_id, root) has every node, new ones as their own root.

    Each old component is one node, so the rounds follow the new edges alone; roots stay the smallest members.
    """
    root = lambda side: labels.select(F.col("sample_id").alias(side), F.col("root").alias(f"_{side}"))
    between = edges.join(root("a"), "a").join(root("b"), "b").filter("_a <> _b")
    links = between.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct().checkpoint()
    ends = links.select(F.col("a").alias("old")).union(links.select(F.col("b").alias("old"))).distinct()
    moved = components(ends, links, "old").withColumnRenamed("root", "_new")
    joined = labels.withColumnRenamed("root", "old").join(moved, "old", "left")
    return joined.select("sample_id", F.coalesce("_new", "old").alias("root"))


def group_edges(captures: DataFrame, hashes: DataFrame) -> DataFrame:
    """One row: links in time, and pairs of samples within the hash limits; equal hashes count by their numbers."""
    pairs = near_pairs(hashes)
    sizes = hashes.groupBy("phash", "dhash").agg(F.min("sample_id").alias("rep"), F.count("*").alias("n"))
    size = lambda side: sizes.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"))
    across = pairs.join(size("a"), "a").join(size("b"), "b").agg(F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).alias("across"))
    inside = sizes.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("inside"))
    times = session_edges(captures).agg(F.count("*").alias("temporal_adjacency_edges"))
    return times.crossJoin(across).crossJoin(inside).select("temporal_adjacency_edges", (F.col("across") + F.col("inside")).cast("long").alias("visual_near_duplicate_pairs"))


def assign_groups(members: DataFrame, frozen: DataFrame, group: str = "group_id", key: str = "sample_id") -> DataFrame:
    """(group, split, conflict): one frozen split is inherited, none goes to train, several conflict."""
    j = members.join(frozen.select(key, F.col("split").alias("frozen_split")), key, "left")
    g = j.groupBy(group).agg(F.count_distinct("frozen_split").alias("n"), F.min("frozen_split").alias("s"))
    return g.select(group, F.when(F.col("n") > 1, F.lit(None)).when(F.col("n") == 1, F.col("s")).otherwise("train").alias("split"), (F.col("n") > 1).alias("conflict"))


def group_consistency(members: DataFrame, group: str = "group_id", key: str = "sample_id") -> DataFrame:
    """Groups that cross splits and members that sit in two groups, counted."""
    crossing = members.groupBy(group).agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("crossing"))
    twice = members.groupBy(key).agg(F.count_distinct(group).alias("n")).agg(F.count_if(F.col("n") > 1).alias("overlapping"))
    empty = members.groupBy(group).agg(F.count(key).alias("n")).agg(F.count_if(F.col("n") == 0).alias("empty"))
    return crossing.crossJoin(twice).crossJoin(empty)


def set_gate(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: only_left, only_right, duplicates and whether the two key sets are the same."""
    a, b = left.select(key), right.select(key)
    return (
        a.exceptAll(b).agg(F.count("*").alias("only_left"))
        .crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_right")))
        .crossJoin(require_unique(a.unionByName(b.limit(0)), key).agg(F.count("*").alias("duplicates")))
        .withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.col("duplicates") == 0))
    )


def golden_samples(df: DataFrame, fields: Sequence[str], known: Sequence[int], size: int = 8, key: str = "sample_id") -> DataFrame:
    """Known ids, then the least and the greatest of each field, then fill by id; the first reason of an id counts."""
    picks = [df.filter(F.col(key).isin(list(known))).select(F.lit(0).alias("priority"), key)]
    for k, f in enumerate(fields):
        for j, order in enumerate((F.asc(f), F.desc(f))):
            picks.append(df.orderBy(order, key).limit(1).select(F.lit(1 + 2 * k + j).alias("priority"), key))
    fill = df.orderBy(key).limit(size + 2 * len(fields) + len(known)).select(F.lit(100).alias("priority"), key)
    every = fill
    for p in picks:
        every = every.unionByName(p)
    return every.groupBy(key).agg(F.min("priority").alias("priority")).orderBy("priority", key).limit(size)


def spread_samples(df: DataFrame, value: str, picks: int = 4, key: str = "sample_id") -> DataFrame:
    """(key, priority) of samples at evenly spaced ranks by value, the first and the last included; each sample once.

    Rank k of m is the whole part of k (n - 1) / (m - 1); equal values go by key.
    """
    ranked = with_rank(df.select(key, value), [], [value, key])
    n = df.agg(F.count("*").alias("n"))
    places = F.transform(F.sequence(F.lit(0), F.least(F.lit(picks), F.col("n").cast("int")) - 1), lambda k: F.struct(
        k.alias("k"), F.floor(k * (F.col("n") - 1) / F.greatest(F.least(F.lit(picks), F.col("n").cast("int")) - 1, F.lit(1))).alias("place")))
    spots = n.filter("n > 0").select(F.explode(places).alias("p")).groupBy("p.place").agg(F.min("p.k").alias("priority"))
    return ranked.join(F.broadcast(spots), F.col("rank") - 1 == F.col("place")).select(key, (F.col("priority") + 200).alias("priority"))


def golden_list(labels: DataFrame, known: Sequence[str], fields: Sequence[str], value: str, native: int = 8, legacy: int = 4, key: str = "sample_id") -> DataFrame:
    """(position, key, source_type): the golden samples in order, each once.

    Native ones first: the known ids as listed, the least and the greatest of each field, then by id up to `native`; then
    legacy ones at evenly spaced ranks of value.
    """
    of = lambda kind: labels.filter(F.col("source_type") == kind)
    picks = golden_samples(of(ISO_TYPE), fields, known, native, key)
    listed = F.coalesce(*[F.when(F.col(key) == k, F.lit(i)) for i, k in enumerate(known)], F.lit(len(known)))
    first = picks.select(key, F.lit(ISO_TYPE).alias("source_type"), F.struct(F.lit(0).alias("a"), F.col("priority").alias("b"), listed.alias("c"), F.col(key).alias("d")).alias("_o"))
    second = spread_samples(of(LEGACY_TYPE), value, legacy, key)
    second = second.select(key, F.lit(LEGACY_TYPE).alias("source_type"), F.struct(F.lit(1).alias("a"), F.col("priority").alias("b"), F.lit(0).alias("c"), F.col(key).alias("d")).alias("_o"))
    # a dozen rows at most
    place = F.row_number().over(Window.orderBy("_o"))
    return first.unionByName(second).select(place.alias("position"), key, "source_type")
