"""Several tables as one committed set: versioned folders, and a commit file that names them, renamed into place last.

A set is a folder with `data/<version>/<table>` and `commits/<number>.json`.  The commit with the highest number is the
set; it names the folders of every table, those that it did not change included.  Until its file is there, readers see
the commit before it, so a failure anywhere leaves the old set whole.  Old folders stay until vacuum() removes them, so
a job that reads the set may write its next version.  A commit number that another writer has taken is an error.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, path = _fs(spark, folder)
    commits = path(f"{folder}/commits")
    if not fs.exists(commits):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(commits)]
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d{12})\.json", n)))


def _load(spark: SparkSession, folder: str, number: int) -> dict:
    fs, path = _fs(spark, folder)
    stream = fs.open(path(f"{folder}/commits/{number:012d}.json"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def latest(spark: SparkSession, folder: str) -> dict | None:
    """The current commit: {"number", "tables": {name: {"parts": [folder, ...], "format"}}}; None where there is none."""
    numbers = _numbers(spark, folder)
    return _load(spark, folder, numbers[-1]) if numbers else None


def _put_commit(spark: SparkSession, folder: str, commit: dict) -> None:
    fs, path = _fs(spark, folder)
    number = commit["number"]
    draft, final = path(f"{folder}/commits/.{uuid.uuid4().hex}"), path(f"{folder}/commits/{number:012d}.json")
    stream = fs.create(draft, False)
    stream.write(json.dumps(commit).encode())
    stream.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise FileExistsError(f"another writer made commit {number} of {folder}")


def commit_tables(
    spark: SparkSession, folder: str, tables: dict[str, DataFrame], formats: dict[str, str] | None = None, add_to: tuple[str, ...] = (), base: dict | None = None,
    order: dict[str, list[str]] | None = None,
) -> int:
    """Write the tables as a new version and make it current; tables in add_to keep their parts and get one more.

    order: columns that a table's files, by their names, and the rows in them are sorted by.  base: the commit that the tables were made from; another one since then is an error.
    """
    before = latest(spark, folder)
    if base is not None and (before or {}).get("number") != base.get("number"):
        raise FileExistsError(f"{folder} has changed since commit {base.get('number')}")
    number, version = (before["number"] + 1 if before else 1), uuid.uuid4().hex
    found = dict(before["tables"]) if before else {}
    for name, df in tables.items():
        kind = (formats or {}).get(name, "parquet")
        part = f"data/{version}/{name}"
        if order and name in order:
            df = df.repartitionByRange(*order[name]).sortWithinPartitions(*order[name])
        df.write.format(kind).save(f"{folder}/{part}")
        parts = found[name]["parts"] if name in add_to and name in found else []
        schema = df.schema.json()
        found[name] = {"parts": [*parts, part], "format": kind, "schema": schema}
    _put_commit(spark, folder, {"number": number, "tables": found})
    return number


def read_table(spark: SparkSession, folder: str, name: str, commit: dict | None = None) -> DataFrame:
    """A table of the current commit, or of the given one."""
    from pyspark.sql.types import StructType

    commit = commit or latest(spark, folder)
    if commit is None or name not in commit["tables"]:
        raise FileNotFoundError(f"{folder} has no table {name}")
    t = commit["tables"][name]
    schema = StructType.fromJson(json.loads(t["schema"]))
    return spark.read.schema(schema).format(t["format"]).load([f"{folder}/{p}" for p in t["parts"]])


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Delete commits but the last `keep`, and the folders that none of those names; returns how many folders went.

    Readers of deleted commits and writers that have not committed yet lose their files: run it when there are none.
    """
    fs, path = _fs(spark, folder)
    numbers = _numbers(spark, folder)
    kept = [_load(spark, folder, n) for n in numbers[-keep:]]
    used = {p for c in kept for t in c["tables"].values() for p in t["parts"]}
    for n in numbers[:-keep]:
        fs.delete(path(f"{folder}/commits/{n:012d}.json"), False)
    gone = 0
    data = path(f"{folder}/data")
    for version in fs.listStatus(data) if fs.exists(data) else []:
        name = version.getPath().getName()
        if not any(p.startswith(f"data/{name}/") for p in used):
            fs.delete(version.getPath(), True)
            gone += 1
    return gone


def upsert(spark: SparkSession, folder: str, name: str, rows: DataFrame, key: list[str], compact_every: int = 16) -> int:
    """Put rows in a table of one row a key: a new part of the table, or all parts merged once there are compact_every.

    rows have one row a key.  Each part's rows carry the commit that wrote them, and the latest of a key counts.
    """
    before = latest(spark, folder)
    number = before["number"] + 1 if before else 1
    stamped = rows.withColumn("_commit", F.lit(number).cast("long"))
    parts = before["tables"].get(name, {"parts": []})["parts"] if before else []
    if len(parts) + 1 < compact_every:
        return commit_tables(spark, folder, {name: stamped}, add_to=(name,), base=before or {})
    old = read_table(spark, folder, name, before)
    return commit_tables(spark, folder, {name: _newest(old.unionByName(stamped), key)}, base=before)


def _newest(rows: DataFrame, key: list[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*others), "_commit").alias("_row"))
    return best.select(*key, *[F.col(f"_row.`{c}`").alias(c) for c in others])


def read_upserted(spark: SparkSession, folder: str, name: str, key: list[str]) -> DataFrame | None:
    """The table with the latest row of each key; None before the first upsert."""
    commit = latest(spark, folder)
    if commit is None or name not in commit["tables"]:
        return None
    return _newest(read_table(spark, folder, name, commit), key).drop("_commit")

