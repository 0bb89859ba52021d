"""Per-concept feature contributions: evidence lists, global importance, waterfall.

Contributions come in wide form (one row per concept); evidence is picked inside the
row, and only what groups by feature uses the long form ``(key, feature,
feature_value, shap_value)``. ``tree_shap`` (exact Tree SHAP for the GBT model) lives
in ``operators.treeshap``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.columns import dround
from .aggregates import KEY

EVIDENCE_TYPE = "array<struct<feature:string,shap_value:double,feature_value:double,direction:string>>"


def to_long(wide: DataFrame, features: list[str], key: str = KEY, shap_suffix: str = "_shap") -> DataFrame:
    """Wide (key, f…, f_shap…) → long (key, feature, feature_value, shap_value)."""
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("feature_value"),
                      F.col(f + shap_suffix).cast("double").alias("shap_value")) for f in features]
    return wide.select(key, F.explode(F.array(*pairs)).alias("c")).select(key, "c.*")


def given_contributions(features: DataFrame, key: str = KEY, cfg: Config = DEFAULT) -> tuple[DataFrame, Column]:
    """Deterministic stand-in for model attributions, in wide form: w_f · (x_f − mean x_f), x = feature
    with NULL as 0, w = readiness-label weight (0 for unweighted features); the
    base value is the mean rule label, so base + Σ contributions = label."""
    feats = list(cfg.model_features)
    x = features.select(key, *[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in feats])
    means = x.select(F.struct(*[F.avg(f).alias(f) for f in feats])).scalar()
    wide = x.withColumn("_m", means).select(
        key, *feats, *[(F.lit(cfg.label_weights.get(f, 0.0)) * (F.col(f) - F.col("_m").getField(f))).alias(f + "_shap")
                       for f in feats])
    label = sum((F.lit(w) * F.col(f) for f, w in cfg.label_weights.items() if f in feats), F.lit(0.0))
    base = x.select(F.avg(label)).scalar()
    return wide, base


def evidence(wide: DataFrame, features: list[str], n: int = DEFAULT.top_n, key: str = KEY,
             shap_suffix: str = "_shap") -> DataFrame:
    """(key, evidence): the top ``n`` features of each row by |contribution| (ties: feature name) as an array of
    structs, values rounded to 4 places; direction 'positive' iff the contribution is > 0.

    The features of a key stand in one row, so they are sorted inside it: no explode, no shuffle.
    """
    items = F.array_sort(F.array(*[F.struct(
        F.col(f + shap_suffix).isNull().alias("absent"), (-F.abs(F.col(f + shap_suffix).cast("double"))).alias("order"),
        F.lit(f).alias("feature"), F.col(f + shap_suffix).cast("double").alias("shap_value"),
        F.col(f).cast("double").alias("feature_value")) for f in features]))
    return wide.select(key, F.transform(F.slice(items, 1, n), lambda e: F.struct(
        e["feature"].alias("feature"), dround(e["shap_value"], 4).alias("shap_value"),
        dround(e["feature_value"], 4).alias("feature_value"),
        F.when(e["shap_value"] > 0, "positive").otherwise("negative").alias("direction"))).alias("evidence"))


def top_features(ranked: DataFrame, key: str = KEY) -> DataFrame:
    """The evidence as rows: key, rank (from 1), feature, shap_value, feature_value, direction."""
    return ranked.select(key, F.posexplode("evidence").alias("pos", "e")).select(
        key, (F.col("pos") + 1).alias("rank"), "e.feature", "e.shap_value", "e.feature_value", "e.direction")


def global_importance(contrib: DataFrame) -> DataFrame:
    """Mean |contribution| per feature, largest first."""
    return contrib.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap")).orderBy(
        F.desc("mean_abs_shap"), F.asc("feature"))


def waterfall(contrib: DataFrame, base: Column, concept, key: str = KEY) -> DataFrame:
    """One concept's contributions from the smallest |value| up, with the running
    total starting at the base value (the last row's total is the prediction)."""
    w = Window.partitionBy(key).orderBy(F.abs("shap_value"), F.col("feature")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    one = contrib.where(F.col(key) == F.lit(concept))
    return one.select(key, "feature", "feature_value", "shap_value",
                      F.row_number().over(Window.partitionBy(key).orderBy(F.abs("shap_value"), F.col("feature"))).alias("step"),
                      (base + F.sum("shap_value").over(w)).alias("cumulative"))
