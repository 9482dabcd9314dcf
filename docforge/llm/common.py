"""What the operators of this subpackage share: shared storage, checkpoints, tables and Arrow slices."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

Model = TypeVar("Model")
CHECKPOINT_DIR = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. A fresh local one only where the session names none and all
    runs in this process (tests); elsewhere that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get(CHECKPOINT_DIR) or spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors of {sc.master} share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='docforge-')}")
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: later reads survive lost executors and don't repeat the work."""
    spark = df.sparkSession
    home = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(home)
    return df.checkpoint(eager=True)


_SCRATCH: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends, if its session still runs then."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(clear_scratch)
    _SCRATCH[path] = spark
    return path


def clear_scratch() -> None:
    """Removes what scratch named and nothing has removed since: results that read it can't be read any more."""
    for path, spark in list(_SCRATCH.items()):
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    _SCRATCH.clear()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path by the file system that its scheme names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _SCRATCH.pop(path, None)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_RESIDENT: dict[object, object] = {}


def _give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def resident(key: object, build: Callable[[], Model]) -> Model:
    """A worker keeps one large model or cache, the last one asked for: workers outlive the stages they serve, and what
    one stage remembers is of no use to the next. Ask once a task and hold on to it."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        gc.collect()  # models hold themselves in cycles
        _give_back()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that Python objects exist for few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores added until df has no such column (Spark tells names apart by letters alone)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
