"""A Spark data source of little-endian float32 grids with JSON sidecars: spark.read.format("f32grid").

Each grid file NAME.f32 has NAME.json with width, height and sha256; the options are `path`, a folder, and
`version` 1 (values 0..1) or 2 (values -64..64).  Files are dealt to partitions; a row is one grid row, or one
error of a file, so that a bad file does not stop a read.  The data source reads folders that every executor has
mounted; read_grids() gives the same rows from any store that Spark reads.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "image_id string, gy int, v array<double>, error string"
FILES_PER_PARTITION = 64


class _Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


def check_grid(raw: bytes, sidecar: bytes | None, version: int) -> tuple[np.ndarray | None, str | None]:
    """(grid, error) of a file and its sidecar's bytes."""
    if sidecar is None:
        return None, "no sidecar"
    try:
        side = json.loads(sidecar)
        w, h = int(side["width"]), int(side["height"])
    except (ValueError, KeyError, TypeError):
        return None, "bad sidecar"
    if w < 1 or h < 1 or len(raw) != w * h * 4:
        return None, "byte length"
    if side.get("sha256") not in (None, hashlib.sha256(raw).hexdigest()):
        return None, "sha256"
    grid = np.frombuffer(raw, "<f4").reshape(h, w).astype(float)
    if not np.isfinite(grid).all():
        return None, "not finite"
    low, high = (0.0, 1.0) if version == 1 else (-64.0, 64.0)
    if grid.min() < low or grid.max() > high:
        return None, "out of range"
    return grid, None


def grid_rows(name: str, grid: np.ndarray | None, error: str | None) -> pa.RecordBatch:
    n = 1 if grid is None else len(grid)
    values = [None] if grid is None else list(grid)
    columns = [pa.array([name] * n), pa.array([None] if grid is None else range(n), pa.int32()), pa.array(values, pa.list_(pa.float64())), pa.array([error] * n, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["image_id", "gy", "v", "error"])


def read_grids(spark: SparkSession, path: str, version: int = 2) -> DataFrame:
    """The rows of the data source, listed and read by Spark: grid files meet their sidecars by a join of their paths."""
    def files(pattern: str) -> DataFrame:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
        return found.select(F.regexp_replace("path", r"\.[^.]*$", "").alias("stem"), "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stem, raw, side in zip(*(b.column(c).to_pylist() for c in ("stem", "content", "side")), strict=True):
                yield grid_rows(stem.rsplit("/", 1)[-1], *check_grid(raw, side, version))

    both = files("*.f32").join(files("*.json").withColumnRenamed("content", "side"), "stem", "left")
    return both.mapInArrow(decode, SCHEMA)


class GridReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.version = options["path"].removeprefix("file:"), int(options.get("version", 2))

    def partitions(self) -> list[InputPartition]:
        names = sorted(str(p) for p in Path(self.root).rglob("*.f32"))
        return [_Files(names[k : k + FILES_PER_PARTITION]) for k in range(0, len(names), FILES_PER_PARTITION)]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        for name in partition.names:
            path = Path(name)
            side = path.with_suffix(".json")
            yield grid_rows(path.stem, *check_grid(path.read_bytes(), side.read_bytes() if side.exists() else None, self.version))


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "f32grid"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GridReader:
        return GridReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GridSource)
