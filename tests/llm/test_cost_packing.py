"""Cost-balanced packing against the public library's ids, and its sequences' sizes and costs."""

import collections
import zlib

import numpy as np
import pytest

from lumenfold.llm import cost_packing, queries

from .test_text_operators import SCHEMA, odd_rows

DATA = "/root/testdata/sf0.001"


def expected_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, pieces, capacity):
    """Each id lies in one piece, and sequences have no gap and no padding."""
    left = collections.Counter()
    ids_of = {}
    for (doc_id, *_), ids in zip(rows, expected_ids([r[1] for r in rows]), strict=True):
        left[doc_id, len(ids)] += 1
        ids_of.setdefault((doc_id, len(ids)), []).append(ids)
    covered = collections.Counter()
    inside = collections.defaultdict(list)
    for p in pieces:
        covered[p.doc_id, p.doc_tokens] += p.length
        crcs = {zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) for x in ids_of[p.doc_id, p.doc_tokens]}
        assert p.ids_crc32 in crcs and 0 < p.length <= capacity
        inside[p.sequence_id].append((p.offset, p.length))
    assert covered == {k: n * k[1] for k, n in left.items()}
    for parts in inside.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == capacity or at < capacity and at & (at - 1) == 0
    return inside


def test_registered_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    pieces = queries.QUERIES["op11_cost_packing"](spark, DATA).collect()
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(rows, pieces, 2048)


@pytest.mark.parametrize(("capacity", "chunk"), [(2048, 1 << 21), (64, 5000), (7, 100)])
def test_odd_rows(spark, capacity, chunk):
    extra = [(9000, "x" * 60_000 + " " * 3000 + "é" * 500, None, None, None), (9001, "before <|endoftext|> after", None, None, None)]
    rows = odd_rows() + extra
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], SCHEMA + ", start long, h string").repartition(3)
    packed = cost_packing.pack_by_cost(df, capacity=capacity, chunk=chunk)
    pieces = packed.collect()
    check(rows, pieces, capacity)
    assert sorted(map(tuple, pieces), key=str) == sorted(map(tuple, packed.collect()), key=str)


def test_ids_and_empty(spark):
    rows = odd_rows()
    packed = cost_packing.pack_by_cost(spark.createDataFrame(rows, SCHEMA), with_ids=True)
    for p in packed.collect():
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
    total = sum(map(len, expected_ids([r[1] for r in rows])))
    assert sum(len(s.tokens) // 4 for s in cost_packing.sequences(packed).collect()) == total
    assert cost_packing.pack_by_cost(spark.createDataFrame([], SCHEMA)).collect() == []


def test_costs_are_balanced():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 700, 4000).tolist()
    pieces = cost_packing.balance(lengths)
    costs = collections.Counter()
    for _, _, n, b, _ in pieces:
        costs[b] += cost_packing.cost(n)
    whole = [c for b, c in costs.items() if b < sum(lengths) // 2048]
    in_order = collections.Counter()
    at = 0
    for n in sorted(lengths, reverse=True):
        while n:
            take = min(n, 2048 - at % 2048)
            in_order[at // 2048] += cost_packing.cost(take)
            at += take
            n -= take
    assert np.std(whole) < 0.5 * np.std(list(in_order.values()))
    assert len(pieces) - len(lengths) <= len(costs)
