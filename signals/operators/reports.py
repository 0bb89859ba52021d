"""Portfolio views: KPIs, ranked list, readiness × confidence matrix, concept detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, OUTCOME_CUSTOMER_PILOT, OUTCOME_MVP_BUILD, Config
from .aggregates import KEY


def portfolio_kpis(outcomes: DataFrame) -> DataFrame:
    """total concepts, actionable (MVP Build or Customer Pilot), mean readiness — one row."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("total_concepts"),
        F.count(F.when(F.col("recommended_outcome").isin(OUTCOME_MVP_BUILD, OUTCOME_CUSTOMER_PILOT), 1)).alias("actionable"),
        F.avg("readiness_score").alias("mean_readiness"))


def ranked_portfolio(outcomes: DataFrame, concepts: DataFrame, key: str = KEY) -> DataFrame:
    """Outcome rows with the concept name, readiness descending (ties by id)."""
    j = outcomes.join(concepts.select(key, "concept_name"), key, "left")
    return j.orderBy(F.desc("readiness_score"), F.asc(key)).select(
        "concept_name", "recommended_outcome", "readiness_score", "confidence_score", "delivery_complexity")


def portfolio_matrix(outcomes: DataFrame, concepts: DataFrame, key: str = KEY, cfg: Config = DEFAULT) -> DataFrame:
    """Confidence × readiness with the quadrant by the readiness 40 and confidence 60 lines."""
    j = outcomes.join(concepts.select(key, "concept_name"), key, "left")
    up = F.col("readiness_score") >= cfg.readiness_moderate
    right = F.col("confidence_score") >= cfg.confidence_high
    quadrant = (F.when(up & right, "upper right").when(up, "upper left").when(right, "lower right")
                .otherwise("lower left"))
    return j.select(key, "concept_name", "confidence_score", "readiness_score", "recommended_outcome",
                    quadrant.alias("quadrant"))


def concept_detail(outcomes: DataFrame, concepts: DataFrame, labeled: DataFrame, narratives: DataFrame, concept,
                   key: str = KEY) -> DataFrame:
    """One concept's scores, outcome, cluster and narrative (the filter reaches every input)."""
    pick = lambda df: df.where(F.col(key) == F.lit(concept))
    return (pick(outcomes).join(pick(concepts).select(key, "concept_name"), key, "left")
            .join(pick(labeled).select(key, "cluster_id"), key, "left")
            .join(pick(narratives), key, "left")
            .select(key, "concept_name", "readiness_score", "confidence_score", "recommended_outcome", "cluster_id",
                    "narrative"))


def top_importance(importance: DataFrame, n: int = 6, col: str = "importance") -> DataFrame:
    """The ``n`` most important features (a top-k)."""
    return importance.orderBy(F.desc(col), F.asc("feature")).limit(n)
