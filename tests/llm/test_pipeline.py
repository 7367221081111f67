"""The pipeline's stages against brute force on the smallest tables."""

import re

import corpus_pipeline
import pytest

from lumenfold.llm import toxicity
from lumenfold.llm.common import labels

from .test_text_operators import expect_jaccard, expect_suffix

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "exact_dedup", "ngram_jaccard_join", "suffix_array_dedup", "bestfit_packing"]
    rejected = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels(spark, DATA))).filter("predicted = 1").collect()}
    clean = steps["toxicity"](spark, docs, DATA)
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - rejected

    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    last = {}
    for r in clean.collect():
        last[lower(r.text)] = max(last.get(lower(r.text), -1), r.doc_id)
    single = steps["exact_dedup"](spark, clean, DATA)
    assert single.columns == columns and {r.doc_id for r in single.collect()} == set(last.values())

    expected = {d for d, _, c in expect_jaccard([tuple(r) for r in single.collect()]) if d == c}
    far = steps["ngram_jaccard_join"](spark, single, DATA)
    assert far.columns == columns and {r.doc_id for r in far.collect()} == expected

    sizes = {d: n - gone for d, n, gone, _, _ in expect_suffix([tuple(r) for r in far.collect()], 50)}
    rest = steps["suffix_array_dedup"](spark, far, DATA)
    assert rest.columns == columns
    for r in rest.collect():
        assert sizes[r.doc_id] - 6 * 40 <= len(r.text.encode()) <= sizes[r.doc_id] and r.n_chars == len(r.text)

    packed = steps["bestfit_packing"](spark, rest, DATA).collect()
    assert {r.doc_id for r in packed} == expected


def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.count() > 0 and "bin_id" in rows.columns


@pytest.mark.parametrize("names", [("op1_suffix_dedup", "op10_media_columns", "pipeline")])
def test_registered(names):
    import __spark_entry__

    assert set(names) <= set(__spark_entry__.queries())


def test_a_failed_run_leaves_nothing(spark, monkeypatch):
    import pathlib

    def broken(spark, docs, sf_dir):
        raise ValueError("broken")

    stages = [corpus_pipeline.STAGES[1], ("broken", broken)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    with pytest.raises(ValueError, match="broken"):
        corpus_pipeline.run(spark, DATA)
    folder = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    rows = [p for p in folder.glob("pipeline-*") if (p / "0-exact_dedup").exists()]
    assert not rows
