"""Statistical confidence (not a model): sample size, variance, cluster tightness.

Everything is read from the per-table aggregate frame (``portfolio_stats``)
plus one per-cluster aggregate of at most k rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.columns import clip, clip01, row_mean
from .aggregates import KEY


def sample_size_factor_expr(cfg: Config = DEFAULT) -> Column:
    n = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in
                     ["demo_customers", "usage_customers", "commercial_customers"]]).cast("double")
    f = clip01(F.log1p(n) / F.log1p(F.lit(cfg.sample_saturation)))
    return F.when(n < cfg.min_samples, f * cfg.small_sample_factor).otherwise(f)


def variance_penalty_expr(cfg: Config = DEFAULT) -> Column:
    fb = F.coalesce(F.col("feedback_var"), F.lit(0.0))
    pi = F.coalesce(F.col("pilot_var"), F.lit(0.0))
    normalised = (fb / 25.0 + pi / 0.25) / 2.0
    return clip01(F.lit(1.0) - clip01(normalised * cfg.variance_scale))


def cluster_spread(labeled: DataFrame, features: list[str], cluster: str = "cluster_id") -> DataFrame:
    """Mean over features of the sample std inside each cluster (≤ k rows)."""
    sd = labeled.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(
        *[F.stddev_samp(f).alias(f"{f}_sd") for f in features])
    return sd.select(cluster, row_mean([f"{f}_sd" for f in features]).alias("cluster_spread"))


def cluster_tightness(labeled: DataFrame, ids: DataFrame, key: str = KEY, cfg: Config = DEFAULT,
                      cluster: str = "cluster_id") -> DataFrame:
    """(key, cluster_tightness) for every id of ``ids``: 1 − clip(spread of its
    cluster); singleton clusters, unlabeled or unknown ids get 0.5; without
    cluster columns every id gets 0.5."""
    feats = [f for f in cfg.tightness_features if f in labeled.columns]
    if (cluster not in labeled.columns or "cluster_repeatability_score" not in labeled.columns or not feats):
        return ids.select(key, F.lit(0.5).alias("cluster_tightness"))
    spread = cluster_spread(labeled, feats, cluster)
    per_id = labeled.select(key, cluster).join(spread, cluster, "left")
    t = F.lit(1.0) - clip(F.coalesce(F.col("cluster_spread"), F.lit(0.5)), 0.0, 1.0)
    out = ids.select(key).join(per_id.select(key, t.alias("cluster_tightness")), key, "left")
    return out.select(key, F.coalesce(F.col("cluster_tightness"), F.lit(0.5)).alias("cluster_tightness"))


def confidence_scores(stats_all: DataFrame, labeled: DataFrame, ids: DataFrame, key: str = KEY,
                      cfg: Config = DEFAULT, keep_parts: bool = False) -> DataFrame:
    """(key, confidence_score) in [0, 100], 2 decimals half-even, for every id of ``ids``."""
    w = cfg.confidence_weights
    parts = ids.select(key).join(stats_all, key, "left").select(
        key, sample_size_factor_expr(cfg).alias("sample_size_factor"),
        variance_penalty_expr(cfg).alias("variance_penalty"))
    j = parts.join(cluster_tightness(labeled, ids, key, cfg), key, "left")
    raw = (F.lit(w["sample_size"]) * F.col("sample_size_factor") + F.lit(w["variance"]) * F.col("variance_penalty")
           + F.lit(w["tightness"]) * F.col("cluster_tightness"))
    score = F.bround(clip(raw * 100.0, 0.0, 100.0), 2).alias("confidence_score")
    if keep_parts:
        return j.select(key, "sample_size_factor", "variance_penalty", "cluster_tightness", score)
    return j.select(key, score)


def with_confidence(wide: DataFrame, cfg: Config = DEFAULT, cluster: str = "cluster_id") -> DataFrame:
    """The same on one frame that holds statistics, features and cluster: adds sample_size_factor, variance_penalty,
    cluster_tightness and confidence_score as columns; only the per-cluster spread is joined."""
    w = cfg.confidence_weights
    feats = [f for f in cfg.tightness_features if f in wide.columns]
    t = F.lit(0.5)
    if cluster in wide.columns and "cluster_repeatability_score" in wide.columns and feats:
        wide = wide.join(cluster_spread(wide, feats, cluster), cluster, "left")
        t = F.lit(1.0) - clip(F.coalesce(F.col("cluster_spread"), F.lit(0.5)), 0.0, 1.0)
    parts = wide.withColumns({"sample_size_factor": sample_size_factor_expr(cfg), "variance_penalty": variance_penalty_expr(cfg),
                              "cluster_tightness": t}).drop("cluster_spread")
    raw = (F.lit(w["sample_size"]) * F.col("sample_size_factor") + F.lit(w["variance"]) * F.col("variance_penalty")
           + F.lit(w["tightness"]) * F.col("cluster_tightness"))
    return parts.withColumn("confidence_score", F.bround(clip(raw * 100.0, 0.0, 100.0), 2))


def summary_columns(col: str, prefix: str) -> list[Column]:
    return [F.avg(col).alias(f"{prefix}_mean"), F.min(col).alias(f"{prefix}_min"), F.max(col).alias(f"{prefix}_max")]


def score_summary(scores: DataFrame, col: str) -> DataFrame:
    """mean / min / max of a score column (one row, partial + final aggregation)."""
    return scores.agg(F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max"))
