"""Shared plan pieces for the queries: the model tables, their aggregates and
the rule-based portfolio (deterministic stand-ins for the two models).

Stand-ins (so the result is checkable by plain SQL):
* cluster label = ``p_size % 4`` of the concept's part;
* readiness = the rule-baseline label without noise, rescaled to [0, 100].
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..operators import aggregates as agg
from ..operators import clusters as clu
from ..operators import confidence as conf
from ..operators import decide as dec
from ..operators import features as feat
from ..operators import readiness as rdy
from ..session import checkpoint
from ..sources import adapters as ad

K = agg.KEY


def given_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = ad.read_table(spark, sf_dir, "part")
    return clu.given_labels(part, "p_partkey", F.col("p_size") % 4)


class Portfolio:
    """The stages of the rule portfolio; each is made when it is first asked for.

    All of them are columns of one row per concept: the statistics, features, cluster, readiness and confidence stand
    in one frame, so after the statistics only the given labels and the per-cluster tables are joined.
    Frames with many readers are checkpointed: the lineage cut keeps every later plan
    small (a scan, not the whole aggregation tree).
    """

    def __init__(self, spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT, tables: dict | None = None):
        self.spark, self.sf_dir, self.cfg = spark, sf_dir, cfg
        # own tables: their signals are gathered by concept, so they are not partitioned by customer
        self.tables = tables or ad.signal_model(spark, sf_dir, by_customer=False)
        self.own_tables = not tables

    @cached_property
    def wide(self) -> DataFrame:
        """Features and the statistics that they and the rules come from."""
        t = self.tables
        frequent = ad.frequent_concepts(self.spark, self.sf_dir) if self.own_tables else None
        st = agg.portfolio_stats(t["concepts"], t["demo_signals"], t["usage_signals"], t["commercial_signals"], frequent=frequent)
        return checkpoint(feat.features_from_stats(st, K, self.cfg, keep_stats=True))

    @cached_property
    def features(self) -> DataFrame:
        return self.wide.select(K, *feat.FEATURES, "delivery_complexity", "concept_name")

    @cached_property
    def clustered(self) -> DataFrame:
        return clu.with_cluster_scores(self.wide, given_labels(self.spark, self.sf_dir))

    @cached_property
    def labeled(self) -> DataFrame:
        return self.clustered.select(*self.features.columns, "cluster_id", "cluster_repeatability_score")

    @cached_property
    def readiness(self) -> DataFrame:
        return rdy.rule_readiness(self.features, K, self.cfg)

    @cached_property
    def confidence_parts(self) -> DataFrame:
        return conf.with_confidence(self.clustered, self.cfg).select(
            K, "sample_size_factor", "variance_penalty", "cluster_tightness", "confidence_score")

    @cached_property
    def confidence(self) -> DataFrame:
        return self.confidence_parts.select(K, "confidence_score")

    @cached_property
    def rule_inputs(self) -> DataFrame:
        label = rdy.label_column(self.wide.columns, K, self.cfg)
        scale = rdy.scale_scores(self.wide.select(label.alias("readiness_label")), "readiness_label")
        scored = conf.with_confidence(self.clustered, self.cfg).withColumn("readiness_label", label)
        return dec.decision_inputs_wide(scored.withColumn("readiness_score", scale), K)

    @cached_property
    def decision(self) -> DataFrame:
        return checkpoint(dec.outcomes(self.rule_inputs, K, self.cfg))


def rule_portfolio(spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT, tables: dict | None = None) -> Portfolio:
    return Portfolio(spark, sf_dir, cfg, tables)


@dataclass
class Explained:
    contrib: DataFrame
    base: object
    top: DataFrame
    evidence: DataFrame
    narratives: DataFrame


def explain_rule_portfolio(p: Portfolio, cfg: Config = DEFAULT) -> Explained:
    from ..operators import explain as xp
    from ..operators import narrate as nar
    wide, base = xp.given_contributions(p.features, K, cfg)
    contrib = xp.to_long(wide, list(cfg.model_features), K)
    ev = xp.evidence(wide, list(cfg.model_features), cfg.top_n, K)
    top = xp.top_features(ev, K)
    narratives = nar.all_narratives(p.decision, ev, p.tables["concepts"], K, cfg)
    return Explained(contrib, base, top, ev, narratives)
