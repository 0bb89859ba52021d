"""Declared constraints, enforced while a batch is appended to a stored table.

A batch is split into accepted and quarantined rows: primary key and NOT NULL columns hold a value, a key occurs once in the batch and not in
the stored table, a foreign key occurs in its parent. All rows of a key that the batch repeats are
quarantined, since none of them can be told to be the right one.

The stored table's keys are kept in a bitmap filter beside it: a key's hash is a bit, and ``BITS`` consecutive bits are one row of
the filter. A batch's keys whose bit is not set are new; only the hits are compared with the stored keys. An append adds the batch's own rows
to the filter and reads nothing of the table otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import checkpoint

BITS = 32_768  # of one filter row (what bitmap_construct_agg packs)
FILTER_ROWS = 1 << 15  # so a filter has 2^30 bits; a table of more than about 10^9 keys takes more

RULES = ("not_null", "repeated_key", "stored_key", "foreign_key")


@dataclass(frozen=True)
class Constraints:
    """Of one table: key columns, NOT NULL columns, and (column, parent's key frame) of the foreign key."""

    key: tuple[str, ...]
    not_null: tuple[str, ...] = ()
    foreign: tuple[tuple[str, DataFrame], ...] = ()


def declared(name: str, concepts: DataFrame | None = None) -> Constraints:
    """The model's constraints of a table; ``concepts`` is the parent of every signal table's concept_id."""
    key = schemas.PRIMARY_KEYS[name]
    parent = () if name == "concepts" or concepts is None else (("concept_id", concepts.select("concept_id")),)
    return Constraints((key,), tuple(schemas.NOT_NULL.get(name, ())), parent)


def _bit(key: tuple[str, ...]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BITS * FILTER_ROWS))


def filter_rows(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(bucket, bits): the filter of a frame's keys."""
    bit = _bit(key)
    return df.select(F.floor(bit / BITS).alias("bucket"), (bit % BITS).alias("at")).groupBy("bucket").agg(
        F.bitmap_construct_agg("at").alias("bits"))


def read_filter(spark: SparkSession, path: str) -> DataFrame:
    """The stored filter, its rows of all appends put together."""
    return spark.read.schema("bucket long, bits binary").parquet(path).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def hits(batch: DataFrame, key: tuple[str, ...], known: DataFrame) -> DataFrame:
    """The batch's distinct keys whose bit is set in the filter ``known``."""
    at = F.col("__bit") % BITS
    byte = F.conv(F.hex(F.expr(f"substring(bits, cast((__bit % {BITS}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    set_ = F.expr("shiftright(__byte, cast(__at % 8 as int))").bitwiseAND(F.lit(1)) == 1
    keys = batch.select(*key).distinct().withColumn("__bit", _bit(key)).withColumn("bucket", F.floor(F.col("__bit") / BITS))
    return (keys.join(known, "bucket").withColumn("__at", at).withColumn("__byte", byte).where(set_).select(*key))


def judged(batch: DataFrame, rules: Constraints, stored: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """The batch with ``rule``: the first constraint that a row breaks, NULL if it breaks none.

    ``stored``: the table's frame; ``known``: its key filter (without one all of the batch's keys are compared).
    """
    key = list(rules.key)
    missing = F.lit(False)
    for c in (*key, *rules.not_null):
        missing = missing | F.col(c).isNull()
    own = batch.where(~F.greatest(*[F.col(c).isNull() for c in key], F.lit(False))) if len(key) else batch
    repeated = own.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).select(*key, F.lit(True).alias("__repeated"))
    out = batch.join(repeated, key, "left")
    if stored is not None:
        candidates = hits(own, rules.key, known) if known is not None else own.select(*key).distinct()
        met = candidates.join(stored.select(*key), key, "left_semi").withColumn("__stored", F.lit(True))
        out = out.join(met, key, "left")
    else:
        out = out.withColumn("__stored", F.lit(None).cast("boolean"))
    orphan = F.lit(False)
    for i, (c, parent) in enumerate(rules.foreign):
        present = parent.select(F.col(parent.columns[0]).alias(c)).where(F.col(c).isNotNull()).distinct().withColumn(f"__fk{i}", F.lit(True))
        out = out.join(present, c, "left")
        orphan = orphan | (F.col(c).isNotNull() & F.col(f"__fk{i}").isNull())
    rule = (F.when(missing, "not_null").when(F.col("__repeated"), "repeated_key").when(F.col("__stored"), "stored_key")
            .when(orphan, "foreign_key"))
    return out.select(*batch.columns, rule.alias("rule"))


def append_checked(batch: DataFrame, path: str, rules: Constraints) -> dict[str, int]:
    """Append the rows of a batch that break no constraint to the Parquet table at ``path``; the others go to ``path``_quarantine with
    the rule they break. Returns the rows per rule (and ``accepted``).

    The judgement is checkpointed before anything is written, so both tables come from one reading of the batch and of the stored keys. The
    filter is written before the table: a load that dies in between leaves bits without keys, which only cost a comparison.
    """
    spark = batch.sparkSession
    exists = _exists(spark, path)
    stored = spark.read.parquet(path) if exists else None
    known = read_filter(spark, f"{path}_keys") if exists and _exists(spark, f"{path}_keys") else None
    out = checkpoint(judged(batch, rules, stored, known))
    counts = {r["rule"] or "accepted": r["n"] for r in out.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()}  # ≤ 5 rows
    accepted = out.where(F.col("rule").isNull()).drop("rule")
    if counts.get("accepted"):
        filter_rows(accepted, rules.key).write.mode("append").parquet(f"{path}_keys")
        accepted.write.mode("append").parquet(path)
    if len(counts) > ("accepted" in counts):
        out.where(F.col("rule").isNotNull()).write.mode("append").parquet(f"{path}_quarantine")
    return {r: counts.get(r, 0) for r in ("accepted", *RULES)}


def quarantined(spark: SparkSession, path: str) -> DataFrame | None:
    """The refused rows of a table with the rule that each breaks; None if no row was ever refused."""
    return spark.read.parquet(f"{path}_quarantine") if _exists(spark, f"{path}_quarantine") else None


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
