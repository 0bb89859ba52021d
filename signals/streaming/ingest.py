"""Incremental (non-reset) loading of a signal table as a Structured Streaming job.

New CSV files landing in a folder are read as a stream, cleaned row by row
(range clipping and boolean coercion; imputation uses fill values fixed up
front, since a stream has no whole-column statistics), and appended to the
Parquet table. Each micro-batch is written to a folder of its own,
``run=<query id>/batch=<id>``, with overwrite, so a batch replayed after a failure
replaces its own output instead of appending twice. The query id comes from the
checkpoint, so a fresh checkpoint never overwrites what another one loaded. The
checkpoint location records which files were taken; by default it belongs to
the landing folder, the table and the sink together.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.clean import clip_to_range, coerce_boolean, without_nan
from ..session import shared_dir
from ..sources.tables import CSV_OPTIONS


def clean_stream(df: DataFrame, table: str, fills: dict | None = None) -> DataFrame:
    out = without_nan(df)
    if fills:
        out = out.select(*[F.coalesce(F.col(c), F.lit(fills[c])).alias(c) if c in fills else F.col(c)
                           for c in out.columns])
    out = clip_to_range(out, schemas.NUMERIC_RANGES.get(table, {}))
    decl = schemas.TABLES.get(table)
    bools = [c for c in (schemas.boolean_columns(decl) if decl is not None else []) if c in out.columns]
    return coerce_boolean(out, bools)


def incremental_load(spark: SparkSession, landing: str, table: str, schema: T.StructType, sink: str,
                     checkpoint: str | None = None, fills: dict | None = None, max_files: int = 1000):
    """Take every file now in ``landing`` (trigger availableNow) and append it to ``sink``.

    Returns the finished StreamingQuery (its ``recentProgress`` lists the batches).
    """
    of = hashlib.sha256("\n".join((landing, table, sink)).encode()).hexdigest()[:16]
    ckpt = checkpoint or f"{shared_dir(spark)}/signals/stream-{table}-{of}"
    stream = (spark.readStream.schema(schema).options(**CSV_OPTIONS).option("maxFilesPerTrigger", max_files)
              .csv(landing))
    cleaned = clean_stream(stream, table, fills)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        run = json.loads(spark.read.text(f"{ckpt}/metadata").first()[0])["id"]
        batch.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/run={run}/batch={batch_id}")

    q = (cleaned.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
