"""Session helpers: a local session for tests/bench and the shared folder for written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql.types import NullType


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "signals") -> SparkSession:
    """A local session configured like a small cluster (AQE on, UI off, UTC)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for written tables and checkpoints.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). When neither
    is set, a session on a ``local`` master gets a fresh folder, registered as the
    checkpoint dir; on any other master that is an error, because executors do
    not see a folder of the driver's machine.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="signals-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


#: rows of one task in the passes of an iterative fit: at most, and at least while there are fewer tasks than cores
MOST_FIT_ROWS, LEAST_FIT_ROWS = 65_536, 4_096


def fit_partitions(df, configured: int | None = None) -> int:
    """Partitions of the input of an iterative fit, unless configured: by its rows, so that a pass over few rows is few tasks.

    A fit makes hundreds of passes, each with all tasks of its input; the session's shuffle partitions are made for whole tables, and with
    a small portfolio most of such tasks would hold no work. Large portfolios get a task for each ``MOST_FIT_ROWS`` rows, without a limit.
    """
    if configured:
        return configured
    n = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n // MOST_FIT_ROWS), min(cores, -(-n // LEAST_FIT_ROWS)))


def checkpoint(df, partitions: int | None = None, key: str | None = None):
    """Reliable checkpoint into the shared folder (eager): cuts lineage so a lost
    executor reloads the frame instead of replaying the plan.

    With ``partitions`` the rows are first hash-partitioned by ``key`` (the inputs of
    iterative fits: see ``fit_partitions``), whatever the data.
    """
    from pyspark import StorageLevel
    shared_dir(df.sparkSession)
    # the checkpoint job re-runs the plan after the materialising job; keep one computation
    src = (df if partitions is None else df.repartition(partitions, key)).persist(StorageLevel.MEMORY_AND_DISK)
    out = src.checkpoint(eager=True)
    src.unpersist()
    return out


def stored(df, name: str):
    """The same rows, written once as Parquet into the shared folder: for frames whose plan is costly (joins) and read several times, and whose
    rows are many (compressed columns, of which a reader takes those that it needs). A column without a type cannot be written: such
    a frame is checkpointed."""
    if any(isinstance(f.dataType, NullType) for f in df.schema.fields):
        return checkpoint(df)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path below the shared folder for one written table."""
    return f"{shared_dir(spark)}/signals/{name}-{uuid.uuid4().hex[:12]}"
