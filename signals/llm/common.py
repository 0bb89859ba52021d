"""Helpers shared by the operators: table access, fold hashing, frames cut loose from their lineage."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def ship(module_name: str) -> None:
    """Send a module's functions with the tasks, so executors need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)


def worker_cache() -> dict:
    """What a Python worker process keeps from task to task; its users bound what they put there."""
    home = sys.modules.setdefault("_signals_llm_worker_cache", types.ModuleType("_signals_llm_worker_cache"))
    return home.__dict__.setdefault("kept", {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    k = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(k.cast("string"), F.lit("")).cast("binary")) % folds


def written(df: DataFrame, name: str, block_bytes: int | None = None) -> DataFrame:
    """The frame as a Parquet table in the shared folder: readers neither replay its plan nor depend on one
    executor's disk, and unlike a checkpoint it is stored compressed and by columns.

    A task holds a row group until it is full: ``block_bytes`` sets its size, for tables with large rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"
    (df.write.option("parquet.block.size", block_bytes) if block_bytes else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a frame from ``written`` through Spark's own file system layer."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for f in df.inputFiles()[:1]:
        folder = f.rsplit("/", 1)[0]
        if "/llm/" not in folder:
            raise ValueError(f"{folder} is not a table of this package below {root}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
