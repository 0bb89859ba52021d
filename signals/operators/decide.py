"""Decision matrix: archive and pilot signals, the ordered rules, the outcome table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (DEFAULT, OUTCOME_ARCHIVE, OUTCOME_CUSTOMER_PILOT, OUTCOME_INCUBATE, OUTCOME_MVP_BUILD,
                      OUTCOME_REUSABLE_ASSET, Config)
from .aggregates import KEY


def archive_signals_expr() -> tuple[Column, Column]:
    """abandonment = Σ abandoned / max(Σ clicks, 1); mean objections (no demo rows → 0)."""
    clicks = F.coalesce(F.col("total_clicks"), F.lit(0)).cast("double")
    abandoned = F.coalesce(F.col("total_abandoned"), F.lit(0)).cast("double")
    rate = abandoned / F.greatest(clicks, F.lit(1.0))
    objections = F.when(F.col("demo_rows").isNull(), F.lit(0.0)).otherwise(F.col("mean_objections"))
    return rate, objections


def pilot_signals_expr() -> tuple[Column, Column]:
    """Largest urgency and largest budget (maybe from different customers); none → 0."""
    none = F.col("commercial_rows").isNull()
    return (F.when(none, F.lit(0.0)).otherwise(F.col("max_urgency")),
            F.when(none, F.lit(0.0)).otherwise(F.col("max_budget")))


def classify(readiness: Column, confidence: Column, cluster_rep: Column, complexity: Column, revenue: Column,
             abandonment: Column, objections: Column, urgency: Column, budget: Column,
             cfg: Config = DEFAULT) -> Column:
    """The ordered rule matrix; the first rule that holds wins. NULL inputs make a
    rule fail (SQL three-valued logic), like NaN comparisons in the original."""
    high = readiness >= cfg.readiness_high
    return (
        F.when(readiness < cfg.readiness_moderate, F.lit(OUTCOME_ARCHIVE))
        .when((revenue > 0) & (complexity / F.greatest(revenue, F.lit(0.01)) > cfg.archive_complexity_ratio),
              F.lit(OUTCOME_ARCHIVE))
        .when((abandonment > cfg.archive_abandonment) & (objections > cfg.archive_objections), F.lit(OUTCOME_ARCHIVE))
        .when(high & (confidence >= cfg.confidence_high) & (complexity <= cfg.complexity_low_to_moderate),
              F.lit(OUTCOME_MVP_BUILD))
        .when(high & (cluster_rep >= cfg.cluster_repeatability_high), F.lit(OUTCOME_REUSABLE_ASSET))
        .when(high & (confidence >= cfg.confidence_high), F.lit(OUTCOME_CUSTOMER_PILOT))
        .when((readiness >= cfg.readiness_moderate) & (urgency >= cfg.pilot_urgency) & (budget >= cfg.pilot_budget),
              F.lit(OUTCOME_CUSTOMER_PILOT))
        .otherwise(F.lit(OUTCOME_INCUBATE))
    )


CLASSIFY_INPUTS = ["readiness_score", "confidence_score", "cluster_repeatability", "delivery_complexity",
                   "revenue_potential", "abandonment_rate", "mean_objections", "max_urgency", "max_budget"]


def classify_frame(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds ``recommended_outcome`` to a frame holding the nine inputs by name."""
    return df.withColumn("recommended_outcome", classify(*[F.col(c) for c in CLASSIFY_INPUTS], cfg=cfg))


def decision_inputs(features: DataFrame, stats_all: DataFrame, readiness: DataFrame, confidence: DataFrame,
                    key: str = KEY) -> DataFrame:
    """One row per concept of ``features`` with the nine rule inputs.

    Missing readiness/confidence → 50; a missing cluster score column → 0.0,
    missing complexity/revenue columns → 0.5; NULL values stay NULL.
    """
    cols = features.columns
    cr = F.col("cluster_repeatability_score") if "cluster_repeatability_score" in cols else F.lit(0.0)
    dc = F.col("delivery_complexity") if "delivery_complexity" in cols else F.lit(0.5)
    rp = F.col("revenue_potential") if "revenue_potential" in cols else F.lit(0.5)
    sig = stats_all.select(key, "total_clicks", "total_abandoned", "demo_rows", "mean_objections",
                           "commercial_rows", "max_urgency", "max_budget")
    j = (features.select(key, cr.alias("cluster_repeatability"), dc.alias("delivery_complexity"),
                         rp.alias("revenue_potential"))
         .join(sig, key, "left").join(readiness, key, "left").join(confidence, key, "left"))
    return _rule_inputs(j, key)


def decision_inputs_wide(wide: DataFrame, key: str = KEY) -> DataFrame:
    """The same from one frame that holds features, statistics, cluster score, readiness and confidence: no join."""
    return _rule_inputs(wide.withColumn("cluster_repeatability", F.col("cluster_repeatability_score")), key)


def _rule_inputs(j: DataFrame, key: str) -> DataFrame:
    rate, objections = archive_signals_expr()
    urgency, budget = pilot_signals_expr()
    return j.select(
        key,
        F.coalesce(F.col("readiness_score"), F.lit(50.0)).alias("readiness_score"),
        F.coalesce(F.col("confidence_score"), F.lit(50.0)).alias("confidence_score"),
        "cluster_repeatability", "delivery_complexity", "revenue_potential",
        rate.alias("abandonment_rate"), objections.alias("mean_objections"),
        urgency.alias("max_urgency"), budget.alias("max_budget"),
    )


def decision_table(features: DataFrame, stats_all: DataFrame, readiness: DataFrame, confidence: DataFrame,
                   key: str = KEY, cfg: Config = DEFAULT) -> DataFrame:
    """concept_id, readiness_score, confidence_score, cluster_repeatability,
    delivery_complexity, recommended_outcome."""
    return outcomes(decision_inputs(features, stats_all, readiness, confidence, key), key, cfg)


def outcomes(inputs: DataFrame, key: str = KEY, cfg: Config = DEFAULT) -> DataFrame:
    """The outcome table from the nine rule inputs."""
    d = classify_frame(inputs, cfg)
    return d.select(key, "readiness_score", "confidence_score", "cluster_repeatability", "delivery_complexity",
                    "recommended_outcome")


def outcome_distribution(outcomes: DataFrame, col: str = "recommended_outcome") -> DataFrame:
    """Concepts per outcome, largest first."""
    return outcomes.groupBy(col).agg(F.count(F.lit(1)).alias("n_concepts")).orderBy(F.desc("n_concepts"), F.asc(col))
