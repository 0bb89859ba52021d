"""Global shuffle into shards: a two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets by seeded hashes: a record's shard is the last j < shards whose own hash of
the key is a multiple of j + 1, which is uniform and, with one shard more, moves a record into the new shard or not
at all; within a shard, a second hash deals records over as many buckets as keep a bucket near ``bucket_bytes``. Pass 2
takes one bucket at a time, puts its rows into a fixed order, shuffles them by Fisher-Yates with a generator seeded by
(seed, shard, bucket) and hands them on; a bucket's first slot is the number of rows in the shard's buckets before it.

Law: ``key``. The key and the number of shards alone decide the shard; shards are near equal in rows and bytes only by
the uniformity of the hash.

Scale: one task holds one bucket, whatever the size of the corpus or of a shard, and there are as many tasks as buckets; texts are shuffled once.
Rows that are equal in all columns and very many are counted and dealt by (row, number) over their shard's buckets. The buckets'
counts (one row per bucket) are summed per shard and meet their bucket in a cogroup, so nothing is broadcast or sent
to the driver but the total number of bytes. A lost task repeats with the same result, as the order within a bucket does not depend on the order of arrival.

Defined results: null keys hash as one value; a null or empty text has 16 bytes and crc32 0; rows that repeat a key
share its shard, and their buckets differ as far as their texts do, or, where very many are equal, by their number; within a bucket equal keys and
texts are ordered by a hash of all columns (but maps); equal texts of different keys part freely; an
empty table gives no rows. Columns of the input named shard, slot or grown_shard are replaced, all others pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, written

ship(__name__)

SHARDS = 40
BUCKET_BYTES = 32 << 20  # of text in a bucket that one task holds
ROW_BYTES = 16  # what a record counts beside its text
ADDED = ("shard", "slot", "grown_shard")


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The key's shard among ``shards``; growing the number by one moves keys into the new shard only."""
    wins = [F.when(F.pmod(F.xxhash64(F.lit(seed), F.lit(j), key), F.lit(j + 1).cast("long")) == 0, F.lit(j))
            for j in range(1, shards)]
    return F.greatest(F.lit(0), F.lit(0), *wins)


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of range(n)."""
    order = np.arange(n)
    draws = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64)  # draws[i] is uniform in 0 … i
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return order


def repeated(own: DataFrame, text: Column, bucket_bytes: int) -> DataFrame | None:
    """(__row): hashes of rows that repeat so often that together they take over an eighth of a bucket; None without any."""
    bytes_, n = F.sum(size_of(text)), F.count(F.lit(1))
    often = own.groupBy("__row").agg(n.alias("__n"), bytes_.alias("__b")).where((F.col("__n") > 1) & (F.col("__b") > bucket_bytes // 8))
    often = written(often.select("__row"), "shards-repeated")
    return None if often.isEmpty() else often


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 7, bucket_bytes: int = BUCKET_BYTES,
                        key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with their shard, slot (0, 1, … within the shard, in shuffled order) and grown_shard."""
    docs = docs.drop(*ADDED)
    text = F.col(text_col).cast("string")
    total = docs.agg(F.sum(size_of(text)).alias("n")).first()["n"] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    buckets = F.lit(per_shard).cast("long")
    own = docs.withColumns({"shard": shard_of(F.col(key_col), shards, seed),
                            "__row": F.xxhash64(*[c for c, kind in docs.dtypes if not kind.startswith("map")])})
    rare, copies = own, None
    if per_shard > 1 and (often := repeated(own, text, bucket_bytes)) is not None:  # else all rows of a shard are in one bucket anyhow
        rare = own.join(often, "__row", "left_anti")
        equal = own.join(often, "__row", "left_semi").groupBy(*own.columns).agg(F.count(F.lit(1)).alias("__n"))
        copies = (equal.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
                  .withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "__row", "__i"), buckets).cast("int")).drop("__n", "__i"))
    dealt = rare.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key_col), text), buckets).cast("int"))
    dealt = dealt if copies is None else dealt.unionByName(copies)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards * per_shard)
    counts = dealt.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("shard").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select(F.col("shard").alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    new = F.pmod(F.xxhash64(F.lit(seed), F.lit(shards), F.col(key_col)), F.lit(shards + 1).cast("long")) == 0
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    names, by = docs.columns, [key_col, text_col, "__row"]

    def run(rows: pa.Table, offset: pa.Table) -> pa.Table:
        if rows.num_rows == 0:
            return schema_table(rows, names)
        shard, part = rows.column("shard")[0].as_py(), rows.column("__bucket")[0].as_py()
        fixed = pc.sort_indices(rows.select(by), sort_keys=[(c, "ascending") for c in by])
        rng = np.random.Generator(np.random.Philox(key=[seed, (shard << 32) + part]))
        rows = rows.take(fixed.take(pa.array(fisher_yates(rows.num_rows, rng))))
        slot = np.arange(rows.num_rows) + offset.column("__first")[0].as_py()
        return pa.table([*(rows.column(c) for c in names), rows.column("shard"), pa.array(slot, pa.int64())],
                        names=[*names, "shard", "slot"])

    keys = ["shard", "__bucket"]
    out = (dealt.repartition(tasks, *keys).groupBy(*keys)
           .cogroup(first.repartition(tasks, "__s", "__b").groupBy("__s", "__b")).applyInArrow(run, schema))
    return out.withColumn("grown_shard", F.when(new, F.lit(shards)).otherwise(F.col("shard")))


def schema_table(rows: pa.Table, names: list[str]) -> pa.Table:
    """No rows, with the result's columns."""
    return pa.table([*(rows.column(c) for c in names), pa.array([], pa.int32()), pa.array([], pa.int64())],
                    names=[*names, "shard", "slot"])


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; within a file rows keep the order of their slots."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = shuffle_into_shards(docs.select("doc_id", "text"))
    text = F.col("text")
    return out.select("doc_id", size_of(text).alias("size"),
                      F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
                      F.lit("key").alias("law"), "shard", "slot", "grown_shard")
