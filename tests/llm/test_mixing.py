from collections import Counter

from helpers import docs, read, same_as_sql
from pyspark.sql import functions as F
from signals.llm import mixing


def test_equals_sql(spark):
    assert same_as_sql(spark, "op1_poisson_mix")


def test_shares_follow_the_weights(spark):
    n = 6000
    df = docs(spark, ["t"] * n, sources=["big" if i % 3 else "small" for i in range(n)]).repartition(5)
    out = mixing.mix(df, {"big": 1.0, "small": 3.0}).collect()
    share = sum(r["source"] == "small" for r in out) / len(out)
    assert abs(share - 0.75) < 0.02 and abs(len(out) - n) < 0.05 * n
    copies = Counter(r["doc_id"] for r in out)
    assert all(copies[r["doc_id"]] == r["n_copies"] for r in out)
    # Poisson: the variance of the counts is near their mean (0.375 for the large source)
    x = [copies.get(i, 0) for i in range(n) if i % 3]
    mean = sum(x) / len(x)
    assert abs(sum((v - mean) ** 2 for v in x) / len(x) / mean - 1) < 0.1


def test_global_order_and_repartitioning(spark):
    df = read(spark, "documents")
    one = [(r["doc_id"], r["copy"]) for r in mixing.mix(df).collect()]
    key = [r["shuffle_key"] for r in mixing.mix(df.repartition(7)).collect()]
    assert key == sorted(key)
    assert sorted(one) == sorted((r["doc_id"], r["copy"]) for r in mixing.mix(df.repartition(7)).collect())


def test_large_rate(spark):
    df = docs(spark, ["t"], sources=["a"])
    n = mixing.mix(df, {"a": 1.0}, total=2000).count()
    assert 1700 < n < 2300


def test_without_broadcast_the_rows_are_the_same(spark, monkeypatch):
    df = read(spark, "documents")
    want = sorted((r["doc_id"], r["copy"]) for r in mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert sorted((r["doc_id"], r["copy"]) for r in mixing.mix(df).collect()) == want


def test_awkward_rows(spark):
    df = docs(spark, [None, "", "x", "x", "y"], ids=[1, 2, 3, 3, None], sources=[None, "a", "a", "a", None])
    out = mixing.mix(df, total=100).collect()
    assert {r["source"] for r in out} == {None, "a"}
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(df, {"a": 0.0}).count() == 0
    assert mixing.mix(df, {"b": 1.0}).count() == 0
    clash = df.selectExpr("*", "9 AS copy", "9 AS n_copies", "'z' AS shuffle_key", "8 AS place")
    assert mixing.mix(clash).columns == [*df.columns, "place", "n_copies", "copy", "shuffle_key"]


def test_no_python_in_the_plan(spark):
    plan = mixing.query(spark, read(spark, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_distribution_of_large_rates_in_linear_time(spark):
    import math
    import time
    rates = [0.3, 5.0, 700.0, 20_000.0, 1_000_000.0]
    begin = time.time()
    got = {r["source"]: r for r in mixing.poisson_cdf(
        spark.createDataFrame([(str(x), x) for x in rates], "source string, rate double"), "source").collect()}
    assert time.time() - begin < 60
    for x in rates:
        first, cdf = got[str(x)]["first"], got[str(x)]["cdf"]
        assert first == max(0, math.floor(x - 12 * math.sqrt(x) - 30)) and len(cdf) <= 24 * math.sqrt(x) + 63
        p = [math.exp(-x + k * math.log(x) - math.lgamma(k + 1)) for k in range(first, first + len(cdf))]
        total = 0.0
        for c, q in zip(cdf, p):
            total += q
            assert abs(c - total) < 1e-6


def test_a_source_of_one_row_and_internal_names(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "one").otherwise("many").alias("source"),
                                 F.lit(1).alias("__source"), F.lit(2).alias("rate"), F.lit(3).alias("first"), F.lit(4).alias("cdf"), F.lit(5).alias("u"))
    out = mixing.mix(df, weights={"one": 1.0, "many": 1.0}, total=40_000)
    assert out.columns == [*df.columns, "n_copies", "copy", "shuffle_key"]
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["one"] - 20_000) < 900 and abs(n["many"] - 20_000) < 900
