"""Guarded writes: all tables or none, write-once freezes, failure tables, run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions


def publish(spark: SparkSession, tables: dict[str, DataFrame], guards: Sequence[tuple[str, DataFrame]], folder: str, dry_run: bool = False, order: dict[str, list[str]] | None = None) -> list[str]:
    """Write all tables as one commit of the folder, once every guard is empty; returns the broken guards.

    order: columns that a table is sorted by, over all its files; a table of ids, groups or paths should name its key.
    Readers see all of the tables (versions.read_table) or none: what went before stays whole until the commit is there.
    """
    broken = [name for name, rows in guards if not rows.isEmpty()]
    if broken or dry_run:
        return broken
    versions.commit_tables(spark, folder, tables, order=order)
    return []


def freeze(assignments: DataFrame, path: str) -> None:
    """Write-once: an existing freeze is an error."""
    assignments.write.mode("errorifexists").parquet(path)


def split_failures(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(reason).isNull()).drop(reason), df.filter(F.col(reason).isNotNull())


def replace_manifest(valid: DataFrame, failures: DataFrame, folder: str) -> bool:
    """Replace the manifest of a folder only if nothing failed; the failures are committed for reading in any case.

    Manifest and failures are one commit (versions.py).  The rows may come from the manifest that they replace.
    """
    spark = valid.sparkSession
    ok = failures.isEmpty()
    tables = {"failures": failures, **({"manifest": valid} if ok else {})}
    versions.commit_tables(spark, folder, tables, {"manifest": "json"})
    return ok


def run_report(results: DataFrame, settings: DataFrame, key: str = "file") -> DataFrame:
    """One row per run: its settings and its file results as an array ordered by key, for write.json."""
    others = [c for c in results.columns if c not in ("run", key)]
    return results.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(key, *others))).alias("files")).join(settings, "run", "left")


def write_audit(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which driver and executors share."""
    import uuid

    from lumenfold.functions.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def taken(df: DataFrame, folder: str) -> DataFrame:
    """The rows in a checkpoint, after which the scratch folder that they were read from goes."""
    spark = df.sparkSession
    out = df.checkpoint()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out
