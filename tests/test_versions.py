"""Loads of several tables are atomic; ids go on over loads; statistics by batches equal a full run."""

import pytest
from pyspark.sql import functions as F

from signals.operators import aggregates as agg
from signals.operators import incremental as inc
from signals.session import scratch_path
from signals.sources import adapters as ad
from signals.sources import tables as tbl
from signals.sources import versions as ver

SF = "/root/testdata/sf0.001"


def frame(spark, n, tag):
    return spark.range(n).select("id", F.lit(tag).alias("tag"))


def test_a_load_that_dies_leaves_the_old_version(spark):
    d = scratch_path(spark, "t-versions")
    assert ver.versions(spark, d) == [] and ver.manifest(spark, d) == {}
    assert ver.load(spark, d, {"a": frame(spark, 5, "x"), "b": frame(spark, 3, "x")}) == 1
    assert ver.load(spark, d, {"a": frame(spark, 2, "y")}) == 2
    dies = frame(spark, 4, "z").withColumn("tag", F.when(F.col("id") > 2, F.raise_error(F.lit("lost"))).otherwise(F.col("tag")))
    for reset in (False, True):
        with pytest.raises(Exception, match="lost"):
            ver.load(spark, d, {"a": frame(spark, 9, "z"), "b": dies}, reset=reset)
        assert ver.versions(spark, d) == [1, 2]
        assert ver.read(spark, d, "a").count() == 7 and ver.read(spark, d, "b").count() == 3
    assert ver.load(spark, d, {"a": frame(spark, 1, "w")}, reset=True) == 3
    assert [ver.read(spark, d, "a", v).count() for v in (1, 2, 3)] == [5, 7, 1] and ver.read(spark, d, "b").count() == 3
    with pytest.raises(RuntimeError, match="another load"):
        ver.publish(spark, d, {}, 3)
    with pytest.raises(ValueError, match="no published table"):
        ver.read(spark, d, "c")


def test_ids_go_on_and_a_retry_gets_the_same(spark):
    path = scratch_path(spark, "t-ids")
    a, b = frame(spark, 7, "a"), frame(spark, 4, "b")
    assert tbl.load_with_ids(a, path, ["id"], "n", "first") == (1, 7)
    assert tbl.load_with_ids(b.limit(0), path, ["id"], "n", "none") == (8, 7)
    assert tbl.load_with_ids(b, path, ["id"], "n", "second") == (8, 11)
    assert tbl.load_with_ids(a, path, ["id"], "n", "first") == (1, 7)
    assert tbl.load_with_ids(b, path, ["id"], "n", "second") == (8, 11)
    rows = sorted((r["n"], r["tag"]) for r in spark.read.parquet(path).collect())
    assert rows == [(i, "a" if i < 8 else "b") for i in range(1, 12)]
    with pytest.raises(ValueError, match="now it ends"):
        tbl.load_with_ids(a.limit(3), path, ["id"], "n", "first")


def test_states_of_batches_equal_a_full_run(spark):
    """Uneven batches, concepts of one batch only, NULL measures, a replaced batch: all statistics agree."""
    m = ad.signal_model(spark, SF, dirty=True)
    path = scratch_path(spark, "t-states")
    part = F.pmod(F.xxhash64(F.col("customer_id")), F.lit(10))
    cuts = {"a": part < 1, "b": (part >= 1) & (part < 4), "c": part >= 4}
    inc.save_batch(path, "b", m)  # replaced below
    for b, cut in cuts.items():
        inc.save_batch(path, b, {t: m[t].where(cut) for t in inc.PARTS})
    got = inc.portfolio_stats(spark, path, m["concepts"])["all"]
    want = agg.portfolio_stats(m["concepts"], m["demo_signals"], m["usage_signals"], m["commercial_signals"])["all"]
    assert set(got.columns) == set(want.columns) and got.count() == want.count()
    rows = {r["concept_id"]: r for r in got.collect()}
    for r in want.collect():
        for c in want.columns:
            x, y = r[c], rows[r["concept_id"]][c]
            assert x == y or (isinstance(x, float) and y is not None and abs(x - y) <= 1e-9 * max(1, abs(x))), (r["concept_id"], c, x, y)


def test_sketches_unite_over_tables(spark):
    a = spark.range(20_000).select((F.col("id") % 3).alias("concept_id"), F.col("id").alias("customer_id"))
    b = spark.range(10_000, 30_000).select((F.col("id") % 3).alias("concept_id"), F.col("id").alias("customer_id"))
    out = inc.approximate_customers([inc.customer_sketches(a), inc.customer_sketches(b)]).collect()
    assert len(out) == 3 and all(abs(r["approx_customers"] - 10_000) < 10_000 * 5 * 0.8 / 64 for r in out)
