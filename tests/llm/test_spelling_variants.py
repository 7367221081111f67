"""Spelling variants against plain counting and all one-letter edits."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from lumenfold.llm import letter_tree, queries, spelling_variants

from .test_text_operators import SCHEMA, odd_rows

DATA = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_counts(rows, slip, min_length=5):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if slip:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
                if h % slip == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= min_length:
                n[w] += 1
    return n


def expect(rows, slip, min_count=3):
    n = {w: k for w, k in plain_counts(rows, slip).items() if k >= min_count}
    masked, cut = collections.defaultdict(list), collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            masked[w[:i], w[i + 1 :]].append(w)
            cut[w[:i] + w[i + 1 :]].add(w)
    near = collections.defaultdict(set)
    for group in masked.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    for a in n:
        for b in cut.get(a, ()):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda b: (-n[b], b), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near.get(w, ())), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def test_registered_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = queries.QUERIES["op12_spelling_variants"](spark, DATA)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=str) == expect([tuple(r) for r in docs.collect()], 97)


@pytest.mark.parametrize("how", [{}, {"leaf": 60, "bucket": 4, "sample": 500, "block": 50}, {"leaf": 5, "bucket": 1, "sample": 40, "block": 7}])
def test_all_edits(spark, how):
    rng = random.Random(3)
    base = ["".join(rng.choice("abéÿ") for _ in range(rng.randint(4, 9))) for _ in range(500)]
    long = ["z" * 300, "z" * 301, "z" * 150 + "y" + "z" * 149, "q" * 5000]
    rows = [(k, " ".join(rng.choice(base) for _ in range(60)) + "-" + rng.choice(long) + "×÷" + rng.choice(base).upper()) for k in range(60)]
    rows += [(r[0], r[1]) for r in odd_rows()] + [(None, "Wörter wörter WÖRTER word2word 语言word")] * 4
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string").repartition(3)
    got = spelling_variants.spelling_variants(df, slip=97, **how)
    assert sorted(map(tuple, got.collect()), key=str) == expect(rows, 97)


def test_chains_without_slips(spark):
    words = ["aaaaaa"] * 3 + ["aaaaab"] * 6 + ["aaaabb"] * 12 + ["aaabbb"] * 24 + ["aabbbb"] * 48 + ["aabbb"] * 48
    df = spark.createDataFrame([(1, " ".join(words), "en", "s", 3)], SCHEMA)
    rows = {r.word: r for r in spelling_variants.spelling_variants(df).collect()}
    assert {w: r.root for w, r in rows.items() if w.startswith("aaa")} == dict.fromkeys(["aaaaaa", "aaaaab", "aaaabb", "aaabbb"], "aabbb")
    assert rows["aaabbb"].form == "aabbb" and rows["aabbbb"].form is None and rows["aabbbb"].n_near == 2


def test_empty(spark):
    assert spelling_variants.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_letter_counts_saturate():
    long = [b"z" * 300, b"z" * 299 + b"y"]
    there = letter_tree.Bucketed(long, 300, 1)
    q, t = there.replaced(letter_tree.matrix(long, 300))
    assert list(zip(q.tolist(), t.tolist(), strict=True)) == [(0, 1)]
    q, t = there.longer(np.full((1, 299), ord("z"), np.uint8))
    assert sorted(t.tolist()) == [0, 1]
