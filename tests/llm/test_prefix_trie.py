"""The prefix trie against a dictionary of tuples."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import prefix_trie, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    """conv_id -> its turns in order."""
    own = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv_id].append(((turn is not None, turn or 0), mark, (role, text)))
    return {c: [x[2] for x in sorted(t)] for c, t in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - c % 100 if c >= 0 else c + -c % 100
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def expect(conversations):
    members, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        gain = (len(m) - 1) * len(k[-1][1]) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += gain
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted(
        ((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(k)) for k, m in members.items()), key=str
    )


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_registered_query(spark, duck):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = queries.QUERIES["op13_prefix_trie"](spark, DATA)
    assert got(df) == expect(rebuilt(ordered(rows)))
    sql = duck.execute(queries.ORACLE_SQL["op13_prefix_trie"])
    assert [c[0] for c in sql.description] == df.columns
    assert got(df) == sorted(sql.fetchall(), key=str)


def made(n, seed):
    """Conversations with one hot first turn, copies, repeated rows, nulls, ties, a long one and ids of every kind."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -7, -100, 10**15, 10**15 + 3]:
        for t in range(rng.choice([1, 2, 2, 3, 4, 7])):
            text = "hello" if t == 0 and rng.random() < 0.5 else rng.choice(["a", "bé", None, "", "long " * 50])
            rows.append((c, t, rng.choice(["user", None]) if t else "user", text))
    rows += rows[:9] + [(5, None, "system", "no turn"), (5, None, "system", "no turn"), (None, 1, "user", "nobody's"), (6, 1, "a", "bc"), (6, 1, "ab", "c")]
    rows += [(n + 1, t, "user", "again") for t in range(300)] + [(n + 2, t, "user", "again") for t in range(299)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "spill"), [(2, 1), (5, 3), (256, 200_000)])
def test_made(spark, width, spill):
    rows = made(150, 1)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", depth int, key string").repartition(3)
    own = ordered(rows)
    assert got(prefix_trie.shared_head_trie(df, width=width, spill=spill)) == expect(rebuilt(own))
    if width == 5:
        nodes = prefix_trie.conversation_trie(df, width=width, spill=spill).checkpoint()
        assert got(nodes) == expect(own)
        for r in prefix_trie.last_turns(nodes, df).filter("depth > 0").collect():
            assert (r.role, r.text) == own[r.conv_id][r.depth - 1]


def test_empty(spark):
    assert prefix_trie.shared_head_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    only = spark.createDataFrame([(101, 0, "user", "x")], SCHEMA)
    assert got(prefix_trie.shared_head_trie(only)) == expect(rebuilt({101: [("user", "x")]}))


def test_queue_spills():
    queue = prefix_trie.SpillingQueue(4)
    rng = random.Random(2)
    items = [(rng.randint(0, 5), rng.choice("ab"), k) for k in range(200)]
    for x in items:
        queue.push(x)
    assert len(queue.heads) > 10
    for key in sorted({x[:2] for x in items}):
        assert sorted(queue.take(key)) == sorted(x for x in items if x[:2] == key)
    assert not queue


def test_many_blocks(spark, monkeypatch):
    df = spark.range(30_000).select(F.col("id").alias("conv_id"), F.lit("0").alias("key"))
    rows = prefix_trie._ends(df).collect()
    assert [r.ends_sha256 for r in rows] == [hashlib.sha256(",".join(map(str, range(30_000))).encode()).hexdigest()]
