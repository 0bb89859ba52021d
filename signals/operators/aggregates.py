"""One aggregate frame per signal table.

Every later stage (features, confidence, decision) reads these frames instead
of re-scanning the signal tables. Each is a single ``groupBy(key)``: Spark
aggregates map-side first (partial aggregation), so a hot concept costs one
row per task before the shuffle; the single ``countDistinct`` is planned as a
two-level aggregation over (key, customer) and then key, which is skew-safe
for the same reason. The outputs are hash-partitioned by the key, which the
joins in ``portfolio_stats`` reuse.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "concept_id"
CUSTOMER = "customer_id"


def materialize(df: DataFrame) -> DataFrame:
    """Keep a concept-level aggregate for its several readers (the main plan and
    the scalar subqueries of its bounds): without it each reader would re-scan
    and re-shuffle the signal table, since column pruning makes their plans
    differ and exchange reuse cannot apply. Lost blocks are recomputed from
    lineage, so an executor loss only costs time."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def demo_stats(demo: DataFrame, key: str = KEY, customer: str = CUSTOMER) -> DataFrame:
    return demo.groupBy(key).agg(
        F.count(F.lit(1)).alias("demo_rows"),
        F.countDistinct(customer).alias("demo_customers"),
        F.avg("feedback_score").alias("mean_feedback"),
        F.avg(F.col("follow_up_requested").cast("double")).alias("follow_up_rate"),
        F.var_samp("feedback_score").alias("feedback_var"),
        F.avg("objections_count").alias("mean_objections"),
    )


def segment_entropy(demo: DataFrame, key: str = KEY, segment: str = "segment") -> DataFrame:
    """Shannon entropy of the segment shares per key, divided by ln(#segments seen).

    Two grouped aggregations, no per-group Python: H = ln N − Σ n·ln n / N.
    One segment gives 0, and so do rows without any segment.
    """
    return segment_entropy_of(demo.groupBy(key, segment).agg(F.count(segment).alias("n")), key, segment)


def segment_entropy_of(counts: DataFrame, key: str = KEY, segment: str = "segment") -> DataFrame:
    """``segment_entropy`` from the rows ``n`` per (key, segment)."""
    per = counts.groupBy(key).agg(
        F.sum("n").alias("n_total"),
        F.sum(F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n")))).alias("n_log_n"),
        F.count(segment).alias("n_segments"),
    )
    h = F.log(F.col("n_total")) - F.try_divide(F.col("n_log_n"), F.col("n_total"))
    norm = F.when(F.col("n_segments") > 1, F.try_divide(h, F.log(F.col("n_segments")))).otherwise(F.lit(0.0))
    return per.select(key, F.least(F.greatest(norm, F.lit(0.0)), F.lit(1.0)).alias("segment_similarity_raw"),
                      "n_segments")


def usage_stats(usage: DataFrame, key: str = KEY, customer: str = CUSTOMER) -> DataFrame:
    return usage.groupBy(key).agg(
        F.count(F.lit(1)).alias("usage_rows"),
        F.countDistinct(customer).alias("usage_customers"),
        F.avg("repeat_usage_days").alias("mean_repeat_days"),
        F.avg("trial_sessions").alias("mean_sessions"),
        F.avg("feature_clicks").alias("mean_clicks"),
        F.avg("time_spent").alias("mean_time"),
        F.avg("active_users").alias("mean_active"),
        F.sum("feature_clicks").alias("total_clicks"),
        F.sum("abandoned_features").alias("total_abandoned"),
    )


def commercial_stats(commercial: DataFrame, key: str = KEY, customer: str = CUSTOMER) -> DataFrame:
    return commercial.groupBy(key).agg(
        F.count(F.lit(1)).alias("commercial_rows"),
        F.countDistinct(customer).alias("commercial_customers"),
        F.avg("urgency_score").alias("mean_urgency"),
        F.avg("willingness_to_pay").alias("mean_wtp"),
        F.avg("expected_value").alias("mean_ev"),
        F.avg("implementation_risk").alias("mean_risk"),
        F.var_samp("pilot_interest").alias("pilot_var"),
        F.max("urgency_score").alias("max_urgency"),
        F.max("budget_signal").alias("max_budget"),
    )


def concept_meta(concepts: DataFrame, key: str = KEY) -> DataFrame:
    return concepts.select(
        key, "concept_name", "delivery_complexity", "strategic_fit", F.lit(True).alias("in_concepts"))


def outer_union(frames: list[DataFrame], key: str = KEY) -> DataFrame:
    """Align frames that each hold at most one row per key on the union of their keys.

    Written as ``unionByName`` + one ``groupBy(key)`` keeping the single non-null
    value per column (the largest, should a key have several): each input is computed once and the rows are shuffled
    once, where a chain of full outer joins would re-shuffle the growing rows
    after every join (a full outer join's output partitioning is unknown).
    """
    cols: list[str] = []
    for f in frames:
        cols += [c for c in f.columns if c != key and c not in cols]
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.groupBy(key).agg(*[F.max(c).alias(c) for c in cols])


def gathered(stats, signals: DataFrame, frequent: list, key: str = KEY, customer: str = CUSTOMER) -> DataFrame:
    """``stats`` of signals whose rows are first gathered by key: then nothing else moves, where partial aggregates of keys with few rows in a
    task are as many as the rows and wider. Rows of the ``frequent`` keys (None: the null key) stay where they are and are aggregated
    map-side, so that no task gets all of them. Every row is in one of the two, whatever is named as frequent."""
    if not frequent:
        return stats(signals.repartition(key), key, customer)
    often = F.when(F.col(key).isNull(), F.lit(None in frequent)).otherwise(F.col(key).isin([k for k in frequent if k is not None]))
    return stats(signals.where(~often).repartition(key), key, customer).unionByName(stats(signals.where(often), key, customer))


def portfolio_stats(concepts: DataFrame, demo: DataFrame, usage: DataFrame, commercial: DataFrame,
                    key: str = KEY, customer: str = CUSTOMER, persist: bool = True, frequent: list | None = None) -> dict[str, DataFrame]:
    """The per-table aggregate frames plus their outer union on the key.

    ``all`` holds one row per key seen in any table (orphans included); a
    table's columns are NULL for keys it does not have, so aggregates that skip
    NULLs (min, max, avg) over ``all`` equal those over the table's own frame.
    With ``frequent`` (keys with a large share of the signals) the signals are ``gathered``; without, they should come partitioned by customer.
    """
    def of(stats, signals):
        return stats(signals, key, customer) if frequent is None else gathered(stats, signals, frequent, key, customer)

    d = of(demo_stats, demo).join(segment_entropy(demo, key), key, "left")
    u = of(usage_stats, usage)
    c = of(commercial_stats, commercial)
    m = concept_meta(concepts, key)
    allk = outer_union([m, d, u, c], key)
    if persist:
        # one materialisation for all readers (features and their bounds, confidence,
        # decision): each signal table is aggregated once, and the checkpoint cuts the
        # lineage so later plans start from a scan of concept-level rows
        from ..session import checkpoint
        allk = checkpoint(allk)
    return {"demo": d, "usage": u, "commercial": c, "meta": m, "all": allk}
