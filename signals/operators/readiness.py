"""Readiness: synthetic label, score scaling; the GBT model lives in ``readiness_model``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.columns import clip01, safe_div
from ..functions.noise import gaussian
from .aggregates import KEY


def label_expr(columns: list[str], cfg: Config = DEFAULT) -> Column:
    """Σ wᵢ·fᵢ over the label features; NULL counts as 0; an absent column is skipped."""
    acc = F.lit(0.0)
    for name, w in cfg.label_weights.items():
        if name in columns:
            acc = acc + F.lit(w) * F.coalesce(F.col(name), F.lit(0.0))
    return acc


def label_column(columns: list[str], key: str = KEY, cfg: Config = DEFAULT, noise: bool = False) -> Column:
    """The rule baseline, optionally with N(0, σ) noise, clipped to [0, 1].

    The noise is a function of (seed, key) only, so it does not depend on
    partitioning or row order and a recomputed task yields the same values.
    """
    base = label_expr(columns, cfg)
    if noise and cfg.label_noise_std > 0:
        base = base + F.lit(cfg.label_noise_std) * gaussian(F.col(key), cfg.seed)
    return clip01(base)


def readiness_label(features: DataFrame, key: str = KEY, cfg: Config = DEFAULT, noise: bool = False) -> DataFrame:
    """(key, readiness_label)."""
    return features.select(key, label_column(features.columns, key, cfg, noise).alias("readiness_label"))


def scale_scores(df: DataFrame, col: str, out: str = "readiness_score") -> Column:
    """min-max of ``col`` over the whole portfolio to [0, 100], 2 decimals (half-even);
    a constant column gives 0."""
    b = df.select(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
    lo, hi = b.getField("lo"), b.getField("hi")
    scaled = F.when(hi > lo, safe_div(F.col(col) - lo, hi - lo) * 100.0).otherwise(F.lit(0.0))
    return F.bround(scaled, 2).alias(out)


def readiness_score(predictions: DataFrame, col: str = "prediction", key: str = KEY) -> DataFrame:
    """(key, readiness_score) from model predictions (or any raw score column)."""
    p = predictions.select(key, col)
    return p.withColumn("_s", scale_scores(p, col)).select(key, F.col("_s").alias("readiness_score"))


def rule_readiness(features: DataFrame, key: str = KEY, cfg: Config = DEFAULT) -> DataFrame:
    """Readiness from the rule baseline (no noise, no model): R1 then R5."""
    return readiness_score(readiness_label(features, key, cfg), "readiness_label", key)
