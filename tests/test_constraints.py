"""Constraints enforced on append, and scores merged into a stored table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from signals.session import scratch_path
from signals.sources import constraints as con
from signals.sources import tables as tbl


def load(spark, path, rows, rules):
    return con.append_checked(spark.createDataFrame(rows, "id long, name string, concept_id long"), path, rules)


def test_rows_are_accepted_or_quarantined_by_rule(spark):
    parents = spark.createDataFrame([(1,), (2,), (2,), (None,)], "concept_id long")
    rules = con.Constraints(("id",), ("name",), (("concept_id", parents),))
    path = scratch_path(spark, "t-checked")
    first = [(1, "a", 1), (2, "b", 2), (3, "c", 3), (4, "d", None), (5, None, 1), (None, "e", 1), (6, "f", 1), (6, "g", 1)]
    assert load(spark, path, first, rules) == {"accepted": 3, "not_null": 2, "repeated_key": 2, "stored_key": 0, "foreign_key": 1}
    second = [(1, "again", 1), (3, "now", 2), (6, "h", 2), (7, "i", 9), (8, "j", 1)]
    assert load(spark, path, second, rules) == {"accepted": 3, "not_null": 0, "repeated_key": 0, "stored_key": 1, "foreign_key": 1}
    assert load(spark, path, [], rules) == dict.fromkeys(("accepted", *con.RULES), 0)
    assert Counter((r["id"], r["name"]) for r in spark.read.parquet(path).collect()) == Counter(
        [(1, "a"), (2, "b"), (4, "d"), (3, "now"), (6, "h"), (8, "j")])
    refused = Counter((r["id"], r["rule"]) for r in con.quarantined(spark, path).collect())
    assert refused == Counter([(5, "not_null"), (None, "not_null"), (6, "repeated_key"), (6, "repeated_key"), (3, "foreign_key"),
                               (1, "stored_key"), (7, "foreign_key")])


def test_filter_holds_every_key_and_few_others(spark, monkeypatch):
    monkeypatch.setattr(con, "FILTER_ROWS", 4)
    stored = spark.range(0, 4000, 2).withColumnRenamed("id", "k")
    path = scratch_path(spark, "t-filter")
    for part in (0, 1):  # two appends
        con.filter_rows(stored.where(F.col("k") % 4 == 2 * part), ("k",)).write.mode("append").parquet(path)
    known = con.read_filter(spark, path)
    assert known.count() <= 4
    hit = {r["k"] for r in con.hits(spark.range(4000).withColumnRenamed("id", "k"), ("k",), known).collect()}
    assert set(range(0, 4000, 2)) <= hit and len(hit) < 2000 + 100


def test_a_hot_key_is_one_row_of_the_judgement(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") < 20_000, 7).otherwise(F.col("id")).alias("id"))
    out = con.judged(rows, con.Constraints(("id",))).groupBy("rule").count().collect()
    assert {r["rule"]: r["count"] for r in out} == {"repeated_key": 20_000, None: 10_000}


def test_upsert_replaces_its_keys_only(spark):
    path = scratch_path(spark, "t-upsert")
    schema = "k long, at long, v string"
    tbl.upsert(spark.createDataFrame([(i, 0, f"a{i}") for i in range(50)], schema), path, "k", buckets=8)
    before = {f for f in spark.read.parquet(path).inputFiles()}
    n = tbl.upsert(spark.createDataFrame([(3, 1, "old"), (3, 2, "new"), (99, 1, "add")], schema), path, "k", latest="at", buckets=8)
    rows = {r["k"]: r["v"] for r in tbl.read_upserted(spark, path).collect()}
    assert rows == {**{i: f"a{i}" for i in range(50)}, 3: "new", 99: "add"} and n <= 2
    assert len(before - set(spark.read.parquet(path).inputFiles())) <= 2  # other buckets keep their files
    assert tbl.upsert(spark.createDataFrame([], schema), path, "k", buckets=8) == 0
    with pytest.raises(Exception, match="null k"):
        tbl.upsert(spark.createDataFrame([(None, 1, "x")], schema), path, "k", buckets=8)
