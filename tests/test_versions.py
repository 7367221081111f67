"""Commits over several tables, replaced manifests and the keyed ingest state, with failures between their steps."""

import json

import pytest

from lumenfold.sources import manifests, sinks, versions
from lumenfold.streaming import jobs


class Broken(Exception):
    pass


def fail(*_, **__):
    raise Broken


def values(df):
    return sorted(r.v for r in df.collect())


def frame(spark, *v):
    return spark.createDataFrame([(x,) for x in v], "v long")


@pytest.mark.parametrize("step", ["second write", "draft", "rename"])
def test_a_failure_leaves_the_old_set(spark, tmp_path, monkeypatch, step):
    folder = str(tmp_path)
    sinks.publish(spark, {"a": frame(spark, 1), "b": frame(spark, 1)}, [], folder)
    new = {"a": frame(spark, 2), "b": frame(spark, 2)}
    if step == "second write":
        new["b"] = new["b"].selectExpr("assert_true(v > 2) IS NULL AS x", "v")
    with monkeypatch.context() as m:
        if step == "draft":
            m.setattr(versions, "_put_commit", fail)
        if step == "rename":
            # the draft is there, and its place is taken
            real = versions._put_commit

            def taken(spark, folder, commit):
                real(spark, folder, dict(commit, tables=versions.latest(spark, folder)["tables"]))
                real(spark, folder, commit)

            m.setattr(versions, "_put_commit", taken)
        with pytest.raises(Exception):  # noqa: B017
            sinks.publish(spark, new, [], folder)
    assert [values(versions.read_table(spark, folder, t)) for t in ("a", "b")] == [[1], [1]]
    sinks.publish(spark, {"b": frame(spark, 3)}, [], folder)
    assert [values(versions.read_table(spark, folder, t)) for t in ("a", "b")] == [[1], [3]]


def test_two_writers_and_vacuum(spark, tmp_path):
    folder = str(tmp_path)
    assert versions.commit_tables(spark, folder, {"a": frame(spark, 1)}) == 1
    old = versions.latest(spark, folder)
    versions.commit_tables(spark, folder, {"a": frame(spark, 2), "b": frame(spark, 9)})
    with pytest.raises(FileExistsError):
        versions.commit_tables(spark, folder, {"a": frame(spark, 3)}, base=old)
    versions.commit_tables(spark, folder, {"a": frame(spark, 4)})
    assert values(versions.read_table(spark, folder, "a", old)) == [1]
    assert versions.vacuum(spark, folder, keep=1) == 1  # the second version still holds b
    assert values(versions.read_table(spark, folder, "a")) == [4] and values(versions.read_table(spark, folder, "b")) == [9]
    with pytest.raises(FileNotFoundError):
        versions.read_table(spark, folder, "c")


def test_a_manifest_replaces_the_one_that_it_was_made_from(spark, tmp_path):
    folder = str(tmp_path / "m")
    (tmp_path / "m").mkdir()
    rows = [{"sample_id": i, "gain_map_present": True, "model": "x"} for i in ("a", "b")]
    (tmp_path / "m" / "samples.json").write_text("\n".join(map(json.dumps, rows)))
    before = manifests.read_manifest(spark, folder)
    better = before.selectExpr("* EXCEPT (model)", "concat(model, '!') AS model")
    none, some = spark.createDataFrame([], "sample_id string"), spark.createDataFrame([("c",)], "sample_id string")
    assert sinks.replace_manifest(better, none, folder)
    read = lambda: sorted((r.sample_id, r.model) for r in manifests.read_manifest(spark, folder).collect())
    assert read() == [("a", "x!"), ("b", "x!")]
    again = manifests.read_manifest(spark, folder).selectExpr("* EXCEPT (model)", "concat(model, '?') AS model")
    assert not sinks.replace_manifest(again, some, folder)
    assert read() == [("a", "x!"), ("b", "x!")] and versions.read_table(spark, folder, "failures").count() == 1
    assert sinks.replace_manifest(again, none, folder)
    assert read() == [("a", "x!?"), ("b", "x!?")] and versions.read_table(spark, folder, "failures").count() == 0


def test_ingest_state(spark, tmp_path, monkeypatch):
    state, seen = str(tmp_path), []
    batch = lambda *r: spark.createDataFrame(r, "input string, size long, at long")

    def run(*rows, compact_every=3):
        return jobs.ingest_batch(batch(*rows), state, "input", ["size", "at"], lambda df: seen.extend((r.input, r.size) for r in df.collect()), compact_every)

    assert run(("a", 1, 1), ("b", 7, None)) == 2
    assert run(("a", 2, 1), ("b", 7, None)) == 1
    assert run(("a", 1, 1)) == 1 and seen[-3:] == [("b", 7), ("a", 2), ("a", 1)] or seen[-1] == ("a", 1)
    assert run(("a", 1, 1)) == 0  # the batch again, its state being there
    with monkeypatch.context() as m:
        m.setattr(versions, "_put_commit", fail)
        with pytest.raises(Broken):
            run(("a", 5, 5))
    assert run(("a", 5, 5)) == 1 and seen[-2:] == [("a", 5), ("a", 5)]
    assert run(("c", 1, 1), ("c", 3, 1), ("c", 2, 9)) == 1 and seen[-1] == ("c", 3)
    for k in range(5):
        assert run(("d", k, 0)) == 1
    rows = sorted(map(tuple, jobs.ingest_state(spark, state, "input").collect()))
    assert rows == [("a", 5, 5), ("b", 7, None), ("c", 3, 1), ("d", 4, 0)]
    assert len(versions.latest(spark, state)["tables"]["state"]["parts"]) < 3


def test_ingest_of_a_stream(spark, tmp_path):
    seen = []
    for k, size in enumerate((1, 2, 1)):
        spark.createDataFrame([("a", size)], "input string, size long").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("input string, size long").parquet(str(tmp_path / "in"))
        q = jobs.start_ingest(stream, str(tmp_path / "state"), "input", ["size"], lambda df: seen.extend(r.size for r in df.collect()), str(tmp_path / "cp"))
        q.awaitTermination(60)
        assert len(seen) == k + 1
    assert seen == [1, 2, 1]


def test_sorted_tables(spark, tmp_path):
    rows = spark.range(5000).selectExpr("pmod(xxhash64(id), 1000) AS g", "id AS v").repartition(7)
    sinks.publish(spark, {"a": rows}, [], str(tmp_path), order={"a": ["g", "v"]})
    part = versions.latest(spark, str(tmp_path))["tables"]["a"]["parts"][0]
    files = sorted(p for p in (tmp_path / part).iterdir() if p.name.startswith("part-"))
    written = [(r.g, r.v) for f in files for r in spark.read.parquet(str(f)).coalesce(1).collect()]
    assert len(written) == 5000 and written == sorted(written)
