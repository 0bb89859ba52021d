"""The eight concept features (all clipped to [0, 1]).

Normalisations are over the concepts present in the feature's own source
table; their min/max come from one scalar subquery per table (a one-row
aggregate Catalyst inlines), never from an un-partitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.columns import clip01
from ..functions.stats import scaled
from .aggregates import KEY, commercial_stats, demo_stats, materialize, portfolio_stats, segment_entropy, usage_stats

FEATURES = ["demand_intensity", "repeatability", "engagement_depth", "segment_similarity_raw",
            "revenue_potential", "feasibility", "strategic_fit", "confidence_proxy"]



def _demo_norms() -> dict[str, Column]:
    return {"fb10": F.col("mean_feedback") / 10.0}


def _usage_norms() -> dict[str, Column]:
    return {n: F.col(n) for n in ["mean_repeat_days", "mean_sessions", "mean_clicks", "mean_time", "mean_active"]}


def _comm_norms() -> dict[str, Column]:
    return {n: F.col(n) for n in ["mean_wtp", "mean_ev"]}


def bounds(df: DataFrame, exprs: dict[str, Column]) -> Column:
    """min and max of several expressions over ``df`` as one scalar-subquery struct."""
    parts = []
    for name, e in exprs.items():
        parts += [F.min(e).alias(f"{name}_min"), F.max(e).alias(f"{name}_max")]
    return df.select(F.struct(*parts).alias("b")).scalar()


def _mm(e: Column, b: Column, name: str, neutral: float = 0.5) -> Column:
    return scaled(e, b.getField(f"{name}_min"), b.getField(f"{name}_max"), neutral)


def _demand(b: Column, cfg: Config) -> Column:
    w = cfg.demand_weights
    fb = _mm(_demo_norms()["fb10"], b, "fb10")
    return clip01(F.lit(w["feedback_norm"]) * F.coalesce(fb, F.lit(0.0))
                  + F.lit(w["follow_up_rate"]) * F.coalesce(F.col("follow_up_rate"), F.lit(0.0))
                  + F.lit(w["urgency"]) * F.coalesce(F.col("mean_urgency"), F.lit(0.0)))


def _repeat(b: Column, cfg: Config) -> Column:
    w = cfg.repeatability_weights
    return clip01(F.lit(w["repeat_days"]) * _mm(F.col("mean_repeat_days"), b, "mean_repeat_days")
                  + F.lit(w["trial_sessions"]) * _mm(F.col("mean_sessions"), b, "mean_sessions"))


def _engage(b: Column, cfg: Config) -> Column:
    w = cfg.engagement_weights
    return clip01(F.lit(w["feature_clicks"]) * _mm(F.col("mean_clicks"), b, "mean_clicks")
                  + F.lit(w["time_spent"]) * _mm(F.col("mean_time"), b, "mean_time")
                  + F.lit(w["active_users"]) * _mm(F.col("mean_active"), b, "mean_active"))


def _revenue(b: Column, cfg: Config) -> Column:
    w = cfg.revenue_weights
    return clip01(F.lit(w["willingness_to_pay"]) * _mm(F.col("mean_wtp"), b, "mean_wtp")
                  + F.lit(w["expected_value"]) * _mm(F.col("mean_ev"), b, "mean_ev"))


def _feasibility() -> Column:
    dc = F.coalesce(F.col("delivery_complexity"), F.lit(0.5))
    risk = F.coalesce(F.col("mean_risk"), F.lit(0.5))
    return clip01((F.lit(1.0) - dc) * (F.lit(1.0) - risk))


def _confidence_proxy(cfg: Config) -> Column:
    n = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in
                     ["demo_customers", "usage_customers", "commercial_customers"]])
    return clip01(F.log1p(n.cast("double")) / F.log1p(F.lit(cfg.sample_saturation)))


# --- one feature at a time, over its own index (as the per-feature functions are used) ---

def demand_intensity(demo: DataFrame, commercial: DataFrame, key: str = KEY, cfg: Config = DEFAULT) -> DataFrame:
    d = materialize(demo_stats(demo, key))
    c = commercial_stats(commercial, key).select(key, "mean_urgency")
    j = d.join(c, key, "left").withColumn("_b", bounds(d, _demo_norms()))
    return j.select(key, _demand(F.col("_b"), cfg).alias("demand_intensity"))


def repeatability(usage: DataFrame, key: str = KEY, cfg: Config = DEFAULT) -> DataFrame:
    u = materialize(usage_stats(usage, key))
    return u.withColumn("_b", bounds(u, _usage_norms())).select(key, _repeat(F.col("_b"), cfg).alias("repeatability"))


def engagement_depth(usage: DataFrame, key: str = KEY, cfg: Config = DEFAULT) -> DataFrame:
    u = materialize(usage_stats(usage, key))
    return u.withColumn("_b", bounds(u, _usage_norms())).select(key, _engage(F.col("_b"), cfg).alias("engagement_depth"))


def segment_similarity_raw(demo: DataFrame, key: str = KEY) -> DataFrame:
    return segment_entropy(demo, key).select(key, "segment_similarity_raw")


def revenue_potential(commercial: DataFrame, key: str = KEY, cfg: Config = DEFAULT) -> DataFrame:
    c = materialize(commercial_stats(commercial, key))
    return c.withColumn("_b", bounds(c, _comm_norms())).select(key, _revenue(F.col("_b"), cfg).alias("revenue_potential"))


def feasibility(concepts: DataFrame, commercial: DataFrame, key: str = KEY) -> DataFrame:
    c = commercial_stats(commercial, key).select(key, "mean_risk")
    return concepts.select(key, "delivery_complexity").join(c, key, "left").select(
        key, _feasibility().alias("feasibility"))


def strategic_fit(concepts: DataFrame, key: str = KEY) -> DataFrame:
    return concepts.select(key, clip01("strategic_fit").alias("strategic_fit"))


def confidence_proxy(demo: DataFrame, usage: DataFrame, commercial: DataFrame, key: str = KEY,
                     cfg: Config = DEFAULT) -> DataFrame:
    d = demo.groupBy(key).agg(F.countDistinct("customer_id").alias("demo_customers"))
    u = usage.groupBy(key).agg(F.countDistinct("customer_id").alias("usage_customers"))
    c = commercial.groupBy(key).agg(F.countDistinct("customer_id").alias("commercial_customers"))
    return d.join(u, key, "left").join(c, key, "left").select(key, _confidence_proxy(cfg).alias("confidence_proxy"))


# --- the whole table ---

def features_from_stats(st: dict[str, DataFrame], key: str = KEY, cfg: Config = DEFAULT,
                        keep_stats: bool = False) -> DataFrame:
    """Feature table from ``portfolio_stats``: one row per key of the outer union.

    A feature is NULL for a key its source table does not have, as in an
    index-aligned union; normalisation domains are the per-table frames.
    """
    has_demo = F.col("demo_rows").isNotNull()
    has_usage = F.col("usage_rows").isNotNull()
    has_comm = F.col("commercial_rows").isNotNull()
    in_concepts = F.col("in_concepts").isNotNull()
    # each table's bounds are one scalar subquery, projected once and referenced by name
    a = st["all"]  # a table's columns are NULL outside its keys, so bounds over ``a`` = bounds over the table
    base = a.select("*", bounds(a, _demo_norms()).alias("_bd"), bounds(a, _usage_norms()).alias("_bu"),
                    bounds(a, _comm_norms()).alias("_bc"))
    cols = {
        "demand_intensity": F.when(has_demo, _demand(F.col("_bd"), cfg)),
        "repeatability": F.when(has_usage, _repeat(F.col("_bu"), cfg)),
        "engagement_depth": F.when(has_usage, _engage(F.col("_bu"), cfg)),
        "segment_similarity_raw": F.col("segment_similarity_raw"),
        "revenue_potential": F.when(has_comm, _revenue(F.col("_bc"), cfg)),
        "feasibility": F.when(in_concepts, _feasibility()),
        "strategic_fit": clip01("strategic_fit"),
        "confidence_proxy": F.when(has_demo, _confidence_proxy(cfg)),
    }
    out = [F.col(key)] + [c.alias(n) for n, c in cols.items()] + [F.col("delivery_complexity"), F.col("concept_name")]
    if keep_stats:
        extra = [c for c in st["all"].columns if c not in {key, "delivery_complexity", "concept_name",
                                                           "segment_similarity_raw", "strategic_fit"}]
        out += [F.col(c) for c in extra]
    return base.select(*out)


def feature_table(concepts: DataFrame, demo: DataFrame, usage: DataFrame, commercial: DataFrame,
                  key: str = KEY, cfg: Config = DEFAULT) -> DataFrame:
    return features_from_stats(portfolio_stats(concepts, demo, usage, commercial, key), key, cfg)
