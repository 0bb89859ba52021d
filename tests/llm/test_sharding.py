import zlib
from collections import defaultdict

import numpy as np
from helpers import AWKWARD, docs, read
from signals.llm import sharding


def gapless(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    return all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_digests_slots_and_law(spark):
    df = read(spark, "documents")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    rows = sharding.query(spark, df).collect()
    assert len(rows) == len(texts) and gapless(rows)
    for r in rows:
        b = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(b) + 16, zlib.crc32(b), "key")
        assert 0 <= r["shard"] < 40
    grown = {r["doc_id"]: r["shard"] for r in sharding.shuffle_into_shards(df, shards=41).collect()}
    assert {r["doc_id"]: r["grown_shard"] for r in rows} == grown
    assert all(g in (r["shard"], 40) for r in rows for g in [r["grown_shard"]])
    assert any(r["grown_shard"] == 40 for r in rows)


def test_order_does_not_depend_on_partitions_or_buckets_lose_rows(spark):
    df = read(spark, "documents")
    a = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(df, shards=3).collect()}
    b = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(df.repartition(9), shards=3).collect()}
    assert a == b
    small = sharding.shuffle_into_shards(df, shards=3, bucket_bytes=20_000).collect()
    assert gapless(small) and {r["doc_id"]: r["shard"] for r in small} == {k: v[0] for k, v in a.items()}
    order = [i for i, _ in sorted(a.items(), key=lambda x: x[1]) if a[i][0] == 0]
    assert order != sorted(order)


def test_fisher_yates_is_uniform():
    seen = defaultdict(int)
    rng = np.random.default_rng(1)
    for _ in range(6000):
        seen[tuple(sharding.fisher_yates(3, rng))] += 1
    assert len(seen) == 6 and min(seen.values()) > 850


def test_awkward_rows_and_files(spark, tmp_path):
    ids = [None, None, 1, 1, *range(2, len(AWKWARD) - 2)]
    rows = sharding.query(spark, docs(spark, AWKWARD, ids=ids)).collect()
    assert len(rows) == len(AWKWARD) and gapless(rows)
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is None} == {(16, 0)}
    assert sharding.query(spark, docs(spark, [])).count() == 0
    clash = docs(spark, ["a", "b"]).selectExpr("*", "7 AS shard", "'s' AS slot", "1 AS grown_shard", "2 AS n")
    out = sharding.shuffle_into_shards(clash, shards=2)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n", "shard", "slot", "grown_shard"]
    path = str(tmp_path / "shards")
    sharding.write_shards(sharding.shuffle_into_shards(read(spark, "documents"), shards=4), path)
    assert spark.read.parquet(path).count() == 200


def test_repeated_rows_are_dealt_over_buckets(spark):
    """One key and text in most rows, some of them equal in all columns: tasks stay small, nothing is lost, equal keys share a shard."""
    from pyspark.sql import functions as F
    hot = spark.range(4000).select(F.lit(7).alias("doc_id"), F.lit("one text that repeats").alias("text"), (F.col("id") % 2).alias("extra"))
    df = hot.unionByName(spark.range(400).select(F.col("id").alias("doc_id"), F.lit("other").alias("text"), F.lit(0).alias("extra")))
    out = [sharding.shuffle_into_shards(x, shards=3, bucket_bytes=6000).withColumn("task", F.spark_partition_id()).collect()
           for x in (df, df.repartition(7))]
    assert all(len(r) == 4400 and gapless(r) for r in out)
    assert [(r["doc_id"], r["extra"], r["shard"], r["slot"]) for r in sorted(out[0], key=lambda r: (r["shard"], r["slot"]))] == \
           [(r["doc_id"], r["extra"], r["shard"], r["slot"]) for r in sorted(out[1], key=lambda r: (r["shard"], r["slot"]))]
    assert len({r["shard"] for r in out[0] if r["doc_id"] == 7}) == 1
    tasks = defaultdict(int)
    for r in out[0]:
        tasks[r["task"]] += 1
    assert len(tasks) > 10 and max(tasks.values()) < 1000
