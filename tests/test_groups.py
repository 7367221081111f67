"""Capture groups against union-find, near hashes in crowded bands against brute force."""

import datetime
import random

import pytest

from lumenfold.operators import corpus


def union_find(ids, edges):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_build_groups(spark):
    rng = random.Random(6)
    t0 = datetime.datetime(2024, 1, 1)
    rows = []
    for k in range(300):
        near = rng.getrandbits(63) if rng.random() < 0.6 else rows[rng.randrange(len(rows))][3] ^ (1 << rng.randrange(63)) if rows else 1
        when = None if rng.random() < 0.2 else t0 + datetime.timedelta(minutes=rng.randrange(6000))
        rows.append((k, rng.choice(["m", "n", None]), when, near, 0))
    # a chain of a thousand links in time is one session
    rows += [(1000 + k, "chain", t0 + datetime.timedelta(minutes=30 * k), rng.getrandbits(63), 0) for k in range(200)]
    df = spark.createDataFrame(rows, "sample_id long, model string, capture_datetime timestamp, phash long, dhash long")
    frozen = spark.createDataFrame([(k, rng.choice(["train", "test"])) for k in range(0, 300, 7)], "sample_id long, split string")
    members, groups = corpus.build_groups(df.select("sample_id", "model"), df.select("sample_id", "capture_datetime"), df.select("sample_id", "phash", "dhash"), frozen)
    edges = []
    by_model = {}
    for i, m, when, _, _ in rows:
        if when:
            by_model.setdefault(m or "unknown", []).append((when, i))
    for v in by_model.values():
        v.sort()
        edges += [(a[1], b[1]) for a, b in zip(v, v[1:], strict=False) if b[0] - a[0] <= datetime.timedelta(minutes=30)]
    temporal = len(edges)
    visual = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and bin(a[3] ^ b[3]).count("1") <= 5]
    expected = union_find([r[0] for r in rows], edges + visual)
    got = {r.sample_id: r for r in members.collect()}
    assert {i: r.root for i, r in got.items()} == expected
    splits = {r.sample_id: r.split for r in frozen.collect()}
    for g in groups.collect():
        own = [i for i, r in got.items() if r.group_id == g.group_id]
        have = {splits[i] for i in own if i in splits}
        assert g.size == len(own) == sum(g.models.values()) and g.conflict == (len(have) > 1)
        assert g.split == (None if len(have) > 1 else next(iter(have)) if have else "train") and g.new_members == sum(i not in splits for i in own)
    counts = corpus.group_edges(df.fillna("unknown", ["model"]), df.select("sample_id", "phash", "dhash")).first()
    assert (counts.temporal_adjacency_edges, counts.visual_near_duplicate_pairs) == (temporal, len(visual))
    # new edges on old labels give what all edges give at once
    cut = len(edges) // 2
    first = union_find([r[0] for r in rows], edges[:cut])
    labels = spark.createDataFrame(list(first.items()), "sample_id long, root long")
    later = spark.createDataFrame(edges[cut:] + visual, "a long, b long")
    assert {r.sample_id: r.root for r in corpus.extend_components(labels, later).collect()} == expected


def test_missing_rows_are_errors(spark):
    samples = spark.createDataFrame([(1, "m"), (2, "m")], "sample_id long, model string")
    captures = spark.createDataFrame([(1, None)], "sample_id long, capture_datetime timestamp")
    hashes = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "sample_id long, phash long, dhash long")
    with pytest.raises(ValueError, match="capture row.*2"):
        corpus.build_groups(samples, captures, hashes)
    with pytest.raises(ValueError, match="hashes.*2"):
        corpus.build_groups(samples, captures.union(captures.selectExpr("2L", "capture_datetime")), hashes.filter("sample_id = 1"))
    with pytest.raises(ValueError, match="repeated.*1"):
        corpus.build_groups(samples.union(samples.limit(1)), captures, hashes)


@pytest.mark.parametrize("crowd", [3, 40])
def test_crowded_bands(spark, crowd):
    """A third of the hashes share a band of each hash, and all others lie near some of them."""
    rng = random.Random(8)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = []
    for _ in range(120):
        p, d = rng.getrandbits(64), rng.getrandbits(64)
        if rng.random() < 0.5:
            p, d = p >> 10 << 10 | 5, d >> 9 << 9 | 3
        rows.append((p, d))
    for _ in range(150):
        p, d = rng.choice(rows)
        for b in rng.sample(range(64), rng.choice([0, 3, 5, 6])):
            p ^= 1 << b
        for b in rng.sample(range(64), rng.choice([0, 4, 6, 7])):
            d ^= 1 << b
        rows.append((p, d))
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame([(k, signed(p), signed(d)) for k, (p, d) in enumerate(rows)], "sample_id long, phash long, dhash long")
    got = {tuple(r) for r in corpus.near_pairs(df, crowd=crowd).collect()}
    bits = lambda a, b: bin(a ^ b).count("1")
    assert got == {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and bits(a[0], b[0]) <= 5 and bits(a[1], b[1]) <= 6}
