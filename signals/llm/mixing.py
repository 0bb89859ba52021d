"""Mixing sources to target weights by Poisson replication; DataFrame functions only.

A source with n rows and weight w gets the repetition rate λ = total · w / (Σ weights · n), so that its expected share of the output
is its weight. Every document draws its number of copies from a Poisson distribution of mean λ by inversion: u is a
uniform number in [0, 1) made from a seeded md5 of the document's id, and the copies are the number of k with
P(X ≤ k) ≤ u. The draw depends on the seed, the id and λ alone: retries and other partitionings give the same
copies. Rows are exploded by their count and dealt out globally by a seeded hash of (id, copy): the partition is the
hash's place in [0, 1), so partitions follow each other in hash order, and every partition is sorted.

Scale: the sources are counted with a map-side partial count, so a source holding a third of all rows is one row per
task there. A source's distribution function is made in time linear in its rate and kept around the rate only, in 24 √rate numbers.
The table of sources is broadcast only if it has been counted to hold at
most ``MAX_BROADCAST_SOURCES`` rows and ``MAX_BROADCAST_BYTES`` bytes; beyond that Spark joins it by a shuffle, where adaptive execution splits large
partitions. The documents' texts are shuffled once, by a uniform hash.

Defined results: a null source is a source of its own; a null id draws as the empty text; rows that repeat an id get the
same number of copies each; sources without a given weight get ``default_weight`` (0 leaves them out); an empty table
or weights that sum to 0 give an empty result. Texts are never looked at. Columns of the input named ``n_copies``, ``copy`` or
``shuffle_key`` are replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

MAX_BROADCAST_SOURCES = 10_000
MAX_BROADCAST_BYTES = 8 << 20  # of their distribution functions
HASH_STEPS = float(1 << 52)  # 13 hexadecimal digits
ADDED = ("n_copies", "copy", "shuffle_key")


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by '|'."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(HASH_STEPS)


def poisson_cdf(rates: DataFrame, key: str) -> DataFrame:
    """(key, first, cdf): P(X ≤ k) for k = first, first + 1, … by the recurrence of log P(X = k), one row for each (``key``, rate).

    Running sums over k, linear in the rate. Kept are the k within 12 √rate + 30 of the rate; P(X < first) is under 1e-30.
    """
    reach = 12 * F.sqrt("rate") + 30
    k = rates.select(key, "rate", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("rate") + reach).cast("long"))).alias("k"))
    up = W.partitionBy(key).orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.log(F.col("rate") / F.col("k")))
    cdf = k.withColumn("log_p", F.sum(step).over(up)).withColumn("cdf", F.sum(F.exp("log_p")).over(up))
    kept = cdf.where(F.col("k") >= F.floor(F.col("rate") - reach))
    each = kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k", "cdf"))).alias("all"))  # 24 √rate + 63 at most
    return each.select(key, F.get("all.k", F.lit(0)).alias("first"), F.col("all.cdf").alias("cdf"))


def rates(docs: DataFrame, weights: dict[str, float] | None, default_weight: float, source_col: str, total: int | None,
          temperature: float) -> DataFrame:
    """One row per source with a positive rate: its name (``source``), and the distribution function of its counts."""
    n = F.col("n").cast("double")
    if weights is None:
        weight = F.pow(n, F.lit(1.0 / temperature))
    else:
        weight = F.lit(float(default_weight))
        for name, w in sorted(weights.items()):
            weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    counts = written(docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n")),
                     "mix-sources").withColumn("weight", weight)
    sums = counts.select(F.struct(F.sum("weight").alias("w"), F.sum("n").alias("n"))).scalar()
    rows = F.lit(float(total)) if total is not None else sums.getField("n").cast("double")
    rated = counts.withColumn("rate", F.try_divide(rows * F.col("weight"), sums.getField("w") * n)).where(F.col("rate") > 0)
    size = rated.agg(F.count(F.lit(1)).alias("n"), F.sum((24 * F.sqrt("rate") + 63) * 8).alias("bytes")).first()
    out = written(poisson_cdf(rated.select("source", "rate"), "source"), "mix-distributions")
    return F.broadcast(out) if size["n"] <= MAX_BROADCAST_SOURCES and (size["bytes"] or 0) <= MAX_BROADCAST_BYTES else out


def mix(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 0.0, total: int | None = None,
        temperature: float = 2.0, seed: int = 20, id_col: str = "doc_id", source_col: str = "source",
        partitions: int | None = None) -> DataFrame:
    """Repeat or leave out documents so that sources reach their target weights, in a global random order.

    ``weights`` maps a source to its weight; None takes rows to the power 1 / ``temperature``. ``total`` is the
    expected number of output rows (None: as many as the input). Adds n_copies (how often the document is in the
    result), copy (1 … n_copies) and shuffle_key.
    """
    spark = docs.sparkSession
    docs = docs.drop(*ADDED)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = "_" * (1 + max(map(len, docs.columns)))  # names that no column has
    by_source = rates(docs, weights, default_weight, source_col, total, temperature).toDF(own + "source", own + "first", own + "cdf")
    source = F.col(source_col).cast("string")
    drawn = (docs.withColumn(own + "u", uniform("copies", seed, F.col(id_col)))
             .join(by_source, source.eqNullSafe(F.col(own + "source")))
             .withColumn("n_copies", (F.col(own + "first") + F.size(F.filter(own + "cdf", lambda c: c <= F.col(own + "u")))).cast("int"))
             .where(F.col("n_copies") > 0)
             .select(*docs.columns, "n_copies"))
    dealt = (drawn.select("*", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
             .withColumn("shuffle_key", uniform("order", seed, F.col(id_col), F.col("copy"))))
    place = F.floor(F.col("shuffle_key") * parts).cast("int")
    return dealt.repartitionById(parts, place).sortWithinPartitions("shuffle_key", id_col, "copy")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(docs)


SQL = """
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source),
rates AS (
  SELECT source, (SELECT sum(n) FROM counts)::DOUBLE * w / ((SELECT sum(w) FROM counts) * n::DOUBLE) AS rate FROM counts),
cdf AS (
  SELECT source, rate, 0 AS k, -rate AS log_p, exp(-rate) AS cdf FROM rates
  UNION ALL
  SELECT source, rate, k + 1, log_p + ln(rate / (k + 1)), cdf + exp(log_p + ln(rate / (k + 1))) FROM cdf
  WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
steps AS (SELECT source, list(cdf) AS cdf FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, len(list_filter(s.cdf, lambda c: c <= ('0x' || substr(md5('copies|20|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)) AS n_copies
  FROM documents d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, text, lang, source, n_chars, n_copies::INTEGER AS n_copies, copy::INTEGER AS copy,
       ('0x' || substr(md5('order|20|' || doc_id || '|' || copy), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS shuffle_key
FROM (SELECT *, unnest(generate_series(1, n_copies)) AS copy FROM drawn WHERE n_copies > 0)
"""
