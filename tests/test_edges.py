"""Hand-made edge frames for the column and statistics helpers and the operators."""

import numpy as np
from pyspark.sql import functions as F

from signals.functions.stats import exact_medians, min_max, mode_values
from signals.operators import aggregates as agg
from signals.operators import clean as cln
from signals.operators import clusters as clu
from signals.operators import confidence as conf
from signals.operators import readiness as rdy
from signals.sources import adapters as ad
from signals.sources.tables import with_surrogate_id


def test_min_max_constant_and_null(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None)], "k int, x double")
    got = sorted(r["n"] for r in df.select(min_max(df, "x").alias("n")).collect())
    assert got == [0.5, 0.5, 0.5]
    allnull = spark.createDataFrame([(1, None), (2, None)], "k int, x double")
    assert [r["n"] for r in allnull.select(min_max(allnull, "x").alias("n")).collect()] == [None, None]


def test_medians_of_several_columns(spark):
    rng = np.random.default_rng(7)
    vals = rng.normal(size=401).round(2)
    rows = [(float(v), float(i % 2), 5, None) for i, v in enumerate(vals)] + [(None, float("nan"), 5, None), (float("nan"), 9.0, None, None)]
    df = spark.createDataFrame(rows, "x double, tied double, same int, none double").repartition(5)
    got = exact_medians(df, ["x", "tied", "same", "none"])
    tied = [i % 2 for i in range(401)] + [9.0]
    assert got == {"x": float(np.median(vals)), "tied": float(np.median(tied)), "same": 5.0, "none": None}
    even = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,)], "x double")
    assert exact_medians(even, ["x"]) == {"x": 6.0}
    assert exact_medians(even.limit(0), ["x"]) == {"x": None} and exact_medians(even, []) == {}


def test_modes_ties_and_all_null(spark):
    df = spark.createDataFrame([("b", True, None), ("a", None, None), ("b", False, None), ("a", False, None), (None, None, None)],
                               "s string, f boolean, n string")
    assert mode_values(df, ["s", "f", "n"]) == {"s": "a", "f": "false", "n": None}
    filled = cln.impute(df).collect()
    assert [r["f"] for r in filled] == [True, False, False, False, False] and {r["n"] for r in filled} == {"UNKNOWN"}


def test_nan_is_imputed_and_clipped_like_null(spark):
    df = spark.createDataFrame([(float("nan"),), (4.0,), (20.0,), (None,)], "feedback_score double")
    assert [r[0] for r in cln.clean_table("demo_signals", df).collect()] == [10.0, 4.0, 10.0, 10.0]  # median 12, clipped
    from signals.streaming.ingest import clean_stream
    assert [r[0] for r in clean_stream(df, "demo_signals", {"feedback_score": 3.0}).collect()] == [3.0, 4.0, 10.0, 3.0]


def test_checkpoint_folder_is_demanded_off_local_masters():
    import pytest
    from types import SimpleNamespace
    from signals.session import shared_dir
    conf = SimpleNamespace(get=lambda k, d=None: d)
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        ctx = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        with pytest.raises(RuntimeError):
            shared_dir(SimpleNamespace(conf=conf, sparkContext=ctx))


def test_all_null_segments_give_zero(spark):
    demo = spark.createDataFrame([(1, None), (1, None), (2, "A"), (2, None), (2, "B")], "concept_id int, segment string")
    got = {r[0]: r[1] for r in agg.segment_entropy(demo).select("concept_id", "segment_similarity_raw").collect()}
    assert got[1] == 0.0 and abs(got[2] - 1.0) < 1e-12


def test_evidence_is_sorted_inside_the_row(spark):
    from signals.operators import explain as xp
    df = spark.createDataFrame([(1, 0.5, 0.1, 0.2, -0.3, 0.3, None)], "concept_id int, a double, b double, c double, "
                                                                     "a_shap double, b_shap double, c_shap double")
    ev = xp.evidence(df, ["a", "b", "c"], 2)
    assert [(r["rank"], r["feature"], r["direction"]) for r in xp.top_features(ev).orderBy("rank").collect()] == [
        (1, "a", "negative"), (2, "b", "positive")]
    assert "Exchange" not in ev._jdf.queryExecution().executedPlan().toString()


def test_impute_rules(spark):
    df = spark.createDataFrame(
        [(1, None, None, None, 0), (2, 4.0, "x", None, 1), (3, 6.0, "y", None, None), (4, None, "y", None, 1)],
        "id int, num double, txt string, empty_txt string, flag int")
    out = cln.clean_table("demo_signals", df.withColumnRenamed("flag", "follow_up_requested"))
    rows = {r["id"]: r for r in out.collect()}
    assert rows[1]["num"] == 5.0 and rows[4]["num"] == 5.0          # median of 4, 6
    assert rows[1]["txt"] == "y"                                    # mode
    assert rows[1]["empty_txt"] == "UNKNOWN"                        # all-NULL text
    assert rows[3]["follow_up_requested"] is True                   # median 1 of (0, 1, 1)
    tied = spark.createDataFrame([(0,), (1,), (None,)], "follow_up_requested int")
    assert [r[0] for r in cln.clean_table("demo_signals", tied).collect()] == [False, True, True]  # 0.5 → True
    allnum = spark.createDataFrame([(None,), (None,)], "customer_id bigint")
    assert [r[0] for r in cln.impute(allnum).collect()] == [None, None]


def test_clip_keeps_null_and_type(spark):
    df = spark.createDataFrame([(15.0, 60), (None, None), (-1.0, 3)], "feedback_score double, objections_count int")
    out = cln.clip_to_range(df, {"feedback_score": (0.0, 10.0), "objections_count": (0.0, 50.0)})
    assert out.schema["objections_count"].dataType.simpleString() == "int"
    assert [tuple(r) for r in out.collect()] == [(10.0, 50), (None, None), (0.0, 3)]


def test_empty_table_cleans(spark):
    df = spark.createDataFrame([], "concept_id bigint, feedback_score double, segment string")
    assert cln.clean_table("demo_signals", df).count() == 0


def test_entropy_single_segment_and_uniform(spark):
    demo = spark.createDataFrame([(1, "A"), (1, "A"), (2, "A"), (2, "B"), (3, "A"), (3, "B"), (3, "C"), (3, "C")],
                                 "concept_id int, segment string")
    got = {r[0]: r[1] for r in agg.segment_entropy(demo).select("concept_id", "segment_similarity_raw").collect()}
    assert got[1] == 0.0 and abs(got[2] - 1.0) < 1e-12
    p = np.array([.25, .25, .5])
    assert abs(got[3] - float(-(p * np.log(p)).sum() / np.log(3))) < 1e-12


def test_single_row_variance_and_small_sample(spark):
    st = spark.createDataFrame([(1, 1, None, None, None, None)],
                               "concept_id int, demo_customers long, usage_customers long, commercial_customers long, "
                               "feedback_var double, pilot_var double")
    r = st.select(conf.sample_size_factor_expr().alias("s"), conf.variance_penalty_expr().alias("v")).first()
    assert abs(r["s"] - np.log1p(1) / np.log1p(30) * 0.3) < 1e-12
    assert r["v"] == 1.0


def test_singleton_cluster_tightness(spark):
    lab = spark.createDataFrame([(1, 0, .1, .2, .3, .5), (2, 1, .4, .5, .6, .5), (3, 1, .2, .1, .6, .5)],
                                "concept_id int, cluster_id int, demand_intensity double, repeatability double, "
                                "engagement_depth double, cluster_repeatability_score double")
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "concept_id int")
    got = {r[0]: r[1] for r in conf.cluster_tightness(lab, ids).collect()}
    assert got[1] == 0.5 and got[4] == 0.5
    sd = np.mean([np.std([.4, .2], ddof=1), np.std([.5, .1], ddof=1), 0.0])
    assert abs(got[2] - (1 - sd)) < 1e-12


def test_cluster_score_all_equal(spark):
    lab = spark.createDataFrame([(1, 0, .5), (2, 1, .5)], "concept_id int, cluster_id int, repeatability double")
    assert [r[0] for r in clu.cluster_repeatability_score(lab).select("cluster_repeatability_score").collect()] == [0.5, 0.5]


def test_constant_predictions_score_zero(spark):
    p = spark.createDataFrame([(1, .3), (2, .3)], "concept_id int, prediction double")
    assert [r[1] for r in rdy.readiness_score(p).collect()] == [0.0, 0.0]
    q = spark.createDataFrame([(1, .2), (2, .4), (3, .3)], "concept_id int, prediction double")
    assert sorted(r[1] for r in rdy.readiness_score(q).collect()) == [0.0, 50.0, 100.0]


def test_noise_is_repeatable_and_key_based(spark):
    f = spark.range(2000).withColumnRenamed("id", "concept_id").withColumn("demand_intensity", F.lit(0.5))
    a = rdy.readiness_label(f, noise=True).orderBy("concept_id").collect()
    b = rdy.readiness_label(f.repartition(7), noise=True).orderBy("concept_id").collect()
    assert a == b
    vals = np.array([r[1] for r in a]) - 0.125
    assert abs(vals.mean()) < 0.01 and 0.04 < vals.std() < 0.06


def test_surrogate_ids_consecutive(spark):
    df = spark.createDataFrame([(i % 7, f"r{i}") for i in range(100)], "g int, s string")
    out = with_surrogate_id(df, ["g", "s"], "id", num_partitions=5).collect()
    ids = sorted(r["id"] for r in out)
    assert ids == list(range(1, 101))
    ordered = sorted(out, key=lambda r: r["id"])
    assert [(r["g"], r["s"]) for r in ordered] == sorted((r["g"], r["s"]) for r in out)


def test_empty_portfolio_summary(spark):
    from signals.operators.narrate import executive_summary
    from signals.operators.reports import portfolio_kpis
    outcomes = spark.createDataFrame([], "concept_id bigint, readiness_score double, confidence_score double, "
                                         "recommended_outcome string")
    concepts = spark.createDataFrame([], "concept_id bigint, concept_name string")
    report = executive_summary(outcomes, concepts).first()["report"]
    assert report.startswith("# Executive Summary") and "0 concepts evaluated" in report
    k = portfolio_kpis(outcomes).first()
    assert k["total_concepts"] == 0 and k["mean_readiness"] is None


def test_medians_by_narrowing_brackets(spark, monkeypatch):
    """Several passes over the table, ties and few distinct values: always the exact median."""
    from signals.functions import stats
    monkeypatch.setattr(stats, "ACCURACY", 100)
    monkeypatch.setattr(stats, "FINAL_ROWS", 40)
    rng = np.random.default_rng(3)
    n = 5000
    cols = {"normal": rng.normal(size=n), "ties": rng.integers(0, 7, n).astype(float), "skew": np.exp(8 * rng.normal(size=n)),
            "two": np.repeat([1.0, 2.0], n // 2), "most": np.where(rng.random(n) < 0.9, 5.0, rng.normal(size=n)), "wide": rng.normal(size=n) * 1e300}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*cols.values())], ", ".join(f"{c} double" for c in cols)).repartition(6)
    passes = []
    whole = stats.narrow
    monkeypatch.setattr(stats, "narrow", lambda d, b: passes.append(len(b)) or whole(d, b))
    got = stats.exact_medians(df, list(cols))
    for c, v in cols.items():
        s = np.sort(v)
        assert got[c] == (s[(n - 1) // 2] + s[n // 2]) / 2.0, c
    assert passes  # at least one pass narrowed a bracket


def _signals(spark, n=4000):
    """Usage of 50 concepts, of which one (7) has half of the rows and some rows have none; customers may be null."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 2 == 0, F.lit(7)).when(i % 101 == 0, F.lit(None)).otherwise(i % 50).cast("long").alias("concept_id"),
        F.when(i % 13 != 0, i % 37).alias("customer_id"), *[(i % m).alias(c) for m, c in (
            (5, "repeat_usage_days"), (6, "trial_sessions"), (7, "feature_clicks"), (8, "time_spent"), (9, "active_users"), (10, "abandoned_features"))])


def test_gathered_statistics_equal_those_of_scattered_rows(spark):
    u = _signals(spark)
    want = sorted(agg.usage_stats(u).collect(), key=str)
    for frequent in ([], [7], [7, None], [None], [-1, 3, 7]):
        assert sorted(agg.gathered(agg.usage_stats, u, frequent).collect(), key=str) == want


def test_statistics_of_gathered_signals_move_the_rows_once_and_no_partial_aggregates(spark):
    plan = agg.gathered(agg.usage_stats, _signals(spark), [])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "customer_id" not in plan.split("Exchange hashpartitioning(")[1].split(")")[0]
    often = agg.gathered(agg.usage_stats, _signals(spark), [7])._jdf.queryExecution().executedPlan().toString()
    assert often.count("Exchange hashpartitioning(") == 3  # a frequent key's rows go by customer, then as partial rows


def test_frequent_concepts_are_neighbouring_quantiles(spark, tmp_path):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(42)).when(F.col("id") % 1000 != 1, F.col("id")).alias("l_partkey"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert ad.frequent_concepts(spark, str(tmp_path)) == [42, None]
    rows.where("l_partkey <> 42").write.parquet(f"{tmp_path}/even/lineitem.parquet")
    assert ad.frequent_concepts(spark, f"{tmp_path}/even") == []
    rows.limit(0).write.parquet(f"{tmp_path}/none/lineitem.parquet")
    assert ad.frequent_concepts(spark, f"{tmp_path}/none") == []
