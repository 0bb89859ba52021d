"""Signal statistics that grow by batches: each batch leaves mergeable states, and its rows are not read again.

Per concept and batch a state holds what its statistics can be put together from: counts, sums, maxima, and for a variance count, mean and M2 (the
sum of squared distances from the mean). What does not add up is kept by value: the distinct (concept, customer) pairs of a table and
the rows per (concept, segment). A batch is a folder of its own, so a repeated load of a batch replaces its states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint, stored
from .aggregates import CUSTOMER, KEY, concept_meta, outer_union, segment_entropy_of

#: per table: prefix, {statistic: column} of the means, variances, sums and maxima (the columns of ``aggregates``' frames)
PARTS = {
    "demo_signals": ("demo", {"mean_feedback": "feedback_score", "follow_up_rate": "follow_up_requested", "mean_objections": "objections_count"},
                     {"feedback_var": "feedback_score"}, {}, {}),
    "usage_signals": ("usage", {"mean_repeat_days": "repeat_usage_days", "mean_sessions": "trial_sessions", "mean_clicks": "feature_clicks",
                                "mean_time": "time_spent", "mean_active": "active_users"}, {},
                      {"total_clicks": "feature_clicks", "total_abandoned": "abandoned_features"}, {}),
    "commercial_signals": ("commercial", {"mean_urgency": "urgency_score", "mean_wtp": "willingness_to_pay", "mean_ev": "expected_value",
                                          "mean_risk": "implementation_risk"}, {"pilot_var": "pilot_interest"}, {},
                           {"max_urgency": "urgency_score", "max_budget": "budget_signal"}),
}


def batch_state(name: str, df: DataFrame, key: str = KEY) -> DataFrame:
    """One row per concept of a batch."""
    _, means, variances, sums, maxima = PARTS[name]
    parts = [F.count(F.lit(1)).alias("rows")]
    for out, c in means.items():
        parts += [F.sum(F.col(c).cast("double")).alias(f"{out}__sum"), F.count(c).alias(f"{out}__n")]
    for out, c in variances.items():
        parts += [F.count(c).alias(f"{out}__n"), F.avg(c).alias(f"{out}__mean"), (F.var_pop(c) * F.count(c)).alias(f"{out}__m2")]
    parts += [F.sum(c).alias(out) for out, c in sums.items()] + [F.max(c).alias(out) for out, c in maxima.items()]
    return df.groupBy(key).agg(*parts)


def merged(name: str, states: DataFrame, key: str = KEY) -> DataFrame:
    """One row per concept: the statistics of all batches (the distinct customers apart)."""
    prefix, means, variances, sums, maxima = PARTS[name]
    own = Window.partitionBy(key)
    for out in variances:  # distances between the batches' means and the common mean complete M2
        common = F.sum(F.col(f"{out}__n") * F.col(f"{out}__mean")).over(own) / F.sum(f"{out}__n").over(own)
        states = states.withColumn(f"{out}__all", F.coalesce(F.col(f"{out}__m2"), F.lit(0.0))
                                   + F.coalesce(F.col(f"{out}__n") * F.pow(F.col(f"{out}__mean") - common, F.lit(2.0)), F.lit(0.0)))
    n = {out: F.sum(f"{out}__n") for out in variances}
    return states.groupBy(key).agg(
        F.sum("rows").alias(f"{prefix}_rows"),
        *[F.try_divide(F.sum(f"{out}__sum"), F.sum(f"{out}__n")).alias(out) for out in means],
        *[F.when(n[out] > 1, F.sum(f"{out}__all") / (n[out] - 1)).alias(out) for out in variances],
        *[F.sum(out).alias(out) for out in sums], *[F.max(out).alias(out) for out in maxima])


def save_batch(path: str, batch: str, tables: dict[str, DataFrame], key: str = KEY, customer: str = CUSTOMER) -> None:
    """Write the states of a batch's signal tables; a batch of the same name is replaced. A batch's rows are stored first, so the plan that
    they come from runs once."""
    for name, (_, means, variances, sums, maxima) in PARTS.items():
        used = dict.fromkeys([key, customer, *means.values(), *variances.values(), *sums.values(), *maxima.values()])
        df = stored(tables[name].select(*used, *(["segment"] if name == "demo_signals" else [])), "batch")
        batch_state(name, df, key).write.mode("overwrite").parquet(f"{path}/{name}/states/batch={batch}")
        df.select(key, customer).where(F.col(customer).isNotNull()).distinct().write.mode("overwrite").parquet(f"{path}/{name}/customers/batch={batch}")
        if name == "demo_signals":
            segments = df.groupBy(key, "segment").agg(F.count("segment").alias("n"))
            segments.write.mode("overwrite").parquet(f"{path}/segments/batch={batch}")


def portfolio_stats(spark: SparkSession, path: str, concepts: DataFrame, key: str = KEY, customer: str = CUSTOMER) -> dict[str, DataFrame]:
    """The frames of ``aggregates.portfolio_stats`` over all batches saved at ``path``."""
    frames = {}
    for name, (prefix, *_) in PARTS.items():
        stats = merged(name, spark.read.parquet(f"{path}/{name}/states"), key)
        seen = spark.read.parquet(f"{path}/{name}/customers").select(key, customer).distinct()
        customers = seen.groupBy(key).agg(F.count(F.lit(1)).alias(f"{prefix}_customers"))
        frames[prefix] = stats.join(customers, key, "left").fillna(0, [f"{prefix}_customers"])
    counts = spark.read.parquet(f"{path}/segments").groupBy(key, "segment").agg(F.sum("n").alias("n"))
    frames["demo"] = frames["demo"].join(segment_entropy_of(counts, key), key, "left")
    meta = concept_meta(concepts, key)
    return {**frames, "meta": meta, "all": checkpoint(outer_union([meta, *(frames[p] for p in ("demo", "usage", "commercial"))], key))}


def customer_sketches(df: DataFrame, key: str = KEY, customer: str = CUSTOMER, lg_k: int = 12) -> DataFrame:
    """(key, sketch): a mergeable sketch of each concept's distinct customers (relative error about 0.8 / √2^lg_k)."""
    return df.groupBy(key).agg(F.hll_sketch_agg(customer, lg_k).alias("sketch"))


def approximate_customers(sketches: list[DataFrame], key: str = KEY) -> DataFrame:
    """(key, approx_customers): distinct customers over several tables or batches, from their sketches alone."""
    every = sketches[0]
    for s in sketches[1:]:
        every = every.unionByName(s)
    return every.groupBy(key).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx_customers"))
