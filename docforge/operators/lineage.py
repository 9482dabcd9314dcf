"""Work that is done once and read several times, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Spark's setting that removes the shuffle files of an action when it ends, not when the driver collects its garbage.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the folder that spark.checkpoint.dir names: later reads survive lost executors and
    don't repeat the work. Only a local master may do without that setting (a fresh local folder then)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get(CHECKPOINT_DIR) or spark.conf.get(CHECKPOINT_DIR, None)
        if not named and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors of {sc.master} share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='docforge-')}")
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder's path beside the checkpoints, for files that are written to be read again."""
    cut(spark.range(0))  # settles the folder, or says that it is missing
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Actions in here leave no shuffle files: only for frames that are computed in one action and read as files after."""
    before = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)


def kept(df: DataFrame, kind: str) -> DataFrame:
    """As cut, in compressed columns: readers of some columns read only these. Removed when the driver's Python ends."""
    spark = df.sparkSession
    path = scratch(spark, kind)
    atexit.register(remove, spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path by the file system that its scheme names, if the session still runs."""
    if spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
