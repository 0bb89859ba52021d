"""Bind the driver's TPC-H-like tables to the signal model.

Entity = part. Signal rows = lineitem ⋈ orders ⋈ customer, routed by
``l_returnflag``: R → demo, A → usage, N → commercial. ``documents`` become the
free-text feedback. The same binding is written once as Spark DataFrames and
once as SQL (``model_sql``) for the DuckDB oracle.

``dirty=True`` injects deterministic defects without dropping a row: NULL
measures, NULL segments and flags, out-of-range values, integer 0/1 flags, and
signal rows re-keyed to orphan concepts (negative ids) so that some concepts
have no demo / usage / commercial rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _signal_rows(spark: SparkSession, sf_dir: str, flag: str, by_customer: bool) -> DataFrame:
    """Line items of one return flag with their order and customer attributes.

    The flag filter reaches the lineitem scan; orders/customer are joined on
    their keys (Catalyst/AQE choose shuffle or broadcast from the real sizes). With ``by_customer`` the line items meet the customers last, so
    they come partitioned by customer, which a count of distinct customers uses; else orders meet their customers first and
    the line items, several to an order, are moved once less.
    """
    li = read_table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    if by_customer:
        rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    else:
        rows = li.join(o.join(c, o.o_custkey == c.c_custkey), li.l_orderkey == o.o_orderkey)
    return rows.withColumn("pri", F.substring("o_orderpriority", 1, 1).cast("int"))


def _null_if(cond, value):
    return F.when(cond, F.lit(None)).otherwise(value)


def concepts(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    name = F.col("p_name")
    dc = F.col("p_size") / 50.0
    fit = F.least(F.greatest((F.col("p_retailprice") - 900.0) / 100.0, F.lit(0.0)), F.lit(1.0))
    if dirty:
        name = _null_if(F.col("p_partkey") % 17 == 0, name)
        dc = _null_if(F.col("p_partkey") % 19 == 0, dc)
    return p.select(
        F.col("p_partkey").alias("concept_id"),
        name.alias("concept_name"),
        F.col("p_type").alias("industry"),
        F.col("p_brand").alias("problem_area"),
        F.lit(None).cast("string").alias("target_user"),
        dc.alias("delivery_complexity"),
        fit.alias("strategic_fit"),
    )


def _concept_key(dirty: bool, orphan_residue: int):
    k = F.col("l_partkey")
    if dirty:
        return F.when(k % 10 == orphan_residue, -k - 1).otherwise(k)
    return k


def demo_signals(spark: SparkSession, sf_dir: str, dirty: bool = False, by_customer: bool = True) -> DataFrame:
    r = _signal_rows(spark, sf_dir, "R", by_customer)
    miss = F.col("l_linenumber") % 7 == 0
    feedback = F.col("l_discount") * 100.0
    follow = F.col("l_linestatus") == "O"
    maker = F.col("o_orderstatus") == "F"
    objections = F.col("pri")
    segment = F.col("c_mktsegment")
    if dirty:
        feedback = _null_if(miss, feedback * 3.0)
        objections = _null_if(miss, objections)
        segment = _null_if(F.col("o_custkey") % 11 == 0, segment)
        flag_miss = F.col("o_custkey") % 13 == 0
        follow = _null_if(flag_miss, follow.cast("int"))
        maker = _null_if(flag_miss, maker.cast("int"))
    return r.select(
        _concept_key(dirty, 3).alias("concept_id"),
        F.col("o_custkey").alias("customer_id"),
        segment.alias("segment"),
        F.to_date("o_orderdate").alias("demo_date"),
        feedback.alias("feedback_score"),
        follow.alias("follow_up_requested"),
        maker.alias("decision_maker_present"),
        objections.alias("objections_count"),
    )


def usage_signals(spark: SparkSession, sf_dir: str, dirty: bool = False, by_customer: bool = True) -> DataFrame:
    r = _signal_rows(spark, sf_dir, "A", by_customer)
    miss = F.col("l_linenumber") % 7 == 0
    cols = {
        "trial_sessions": F.col("l_linenumber"),
        "feature_clicks": F.col("l_quantity").cast("int"),
        "repeat_usage_days": F.round(F.col("l_tax") * 100.0).cast("int"),
        "active_users": F.col("pri"),
        "time_spent": F.col("l_quantity") * F.col("l_linenumber"),
        "abandoned_features": F.round(F.col("l_discount") * 100.0).cast("int") * F.col("l_linenumber"),
    }
    if dirty:
        cols["active_users"] = cols["active_users"] - 3
        cols = {k: (v if k == "trial_sessions" else _null_if(miss, v)) for k, v in cols.items()}
    return r.select(
        _concept_key(dirty, 4).alias("concept_id"),
        F.col("o_custkey").alias("customer_id"),
        *[v.alias(k) for k, v in cols.items()],
    )


def commercial_signals(spark: SparkSession, sf_dir: str, dirty: bool = False, by_customer: bool = True) -> DataFrame:
    r = _signal_rows(spark, sf_dir, "N", by_customer)
    miss = F.col("l_linenumber") % 7 == 0
    cols = {
        "pilot_interest": F.col("l_tax") / 0.08,
        "urgency_score": (6 - F.col("pri")) / 5.0,
        "budget_signal": F.col("l_quantity") / 50.0,
        "willingness_to_pay": F.col("l_extendedprice"),
        "expected_value": F.col("o_totalprice"),
        "implementation_risk": F.col("l_discount") / 0.1,
    }
    if dirty:
        cols["urgency_score"] = cols["urgency_score"] - 0.5
        cols = {k: _null_if(miss, v) for k, v in cols.items()}
    return r.select(
        _concept_key(dirty, 5).alias("concept_id"),
        F.col("o_custkey").alias("customer_id"),
        *[v.alias(k) for k, v in cols.items()],
    )


def text_feedback(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    n_parts = read_table(spark, sf_dir, "part").select(F.count("*")).scalar()
    return d.select(
        F.col("doc_id").alias("feedback_id"),
        (F.col("doc_id") % n_parts).alias("concept_id"),
        F.lit(None).cast("bigint").alias("customer_id"),
        F.col("text").alias("customer_comments"),
        F.lit(None).cast("string").alias("pain_point_statements"),
        F.lit(None).cast("string").alias("objection_themes"),
        F.lit(None).cast("string").alias("requested_capabilities"),
    )


def signal_model(spark: SparkSession, sf_dir: str, dirty: bool = False, by_customer: bool | None = None) -> dict[str, DataFrame]:
    """All five input tables of the model, keyed by table name. Signals come partitioned by customer unless ``by_customer`` is false (as with
    dirty tables, which are stored while they are cleaned)."""
    by_customer = not dirty if by_customer is None else by_customer
    return {
        "concepts": concepts(spark, sf_dir, dirty),
        "demo_signals": demo_signals(spark, sf_dir, dirty, by_customer),
        "usage_signals": usage_signals(spark, sf_dir, dirty, by_customer),
        "commercial_signals": commercial_signals(spark, sf_dir, dirty, by_customer),
        "text_feedback": text_feedback(spark, sf_dir, dirty),
    }


def frequent_concepts(spark: SparkSession, sf_dir: str, shares: int = 400) -> list:
    """Concepts that may have more than a ``shares``-th of all line items, for their placement: those that are two neighbouring quantiles. None is
    among them if there are line items without a concept. One pass over the key column; only the quantiles reach the driver."""
    k = F.col("l_partkey")
    q, null = read_table(spark, sf_dir, "lineitem").agg(
        F.percentile_approx(k, [i / shares for i in range(shares + 1)]), F.max(k.isNull())).first()
    return sorted({a for a, b in zip(q or [], (q or [])[1:]) if a == b}) + [None] * bool(null)


#: column of each table's key in the deliveries below
DELIVERED = ("concepts", "demo_signals", "usage_signals", "commercial_signals", "text_feedback", "concept_scores")


def deliveries(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Two loads of every table, with ids and with rows that break the declared constraints.

    Columns: ``batch`` (0, 1), the table's key, concept_id, and for concepts concept_name. Signals of one order share ids within
    the first load (line items 1 and 4) and with it (5, 6, 7), some have none, some name an orphan concept; concepts may lack a name;
    scores of a third of the concepts come twice.
    """
    out = {"concepts": concepts(spark, sf_dir, dirty=True).select((F.col("concept_id") % 2).cast("int").alias("batch"), "concept_id", "concept_name")}
    for name, flag, residue in (("demo_signals", "R", 3), ("usage_signals", "A", 4), ("commercial_signals", "N", 5)):
        key = F.when(F.col("l_suppkey") % 31 != 0, F.col("l_orderkey") * 8 + F.col("l_linenumber") % 3)
        out[name] = read_table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select(
            (F.col("l_linenumber") > 4).cast("int").alias("batch"), key.cast("long").alias(name.split("_")[0] + "_id"),
            _concept_key(True, residue).alias("concept_id"))
    out["text_feedback"] = text_feedback(spark, sf_dir).select((F.col("feedback_id") % 2).cast("int").alias("batch"), "feedback_id", "concept_id")
    parts = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"))
    third = F.col("concept_id") % 3
    out["concept_scores"] = parts.where(third < 2).select(F.lit(0).alias("batch"), "concept_id").unionByName(
        parts.where(third > 0).select(F.lit(1).alias("batch"), "concept_id"))
    return out


def deliveries_sql() -> list[tuple[str, str]]:
    """CTEs ``d_<table>`` (batch, id, named, concept_id) of the same loads."""
    out = [("d_concepts", "SELECT p_partkey % 2 AS batch, p_partkey AS id, p_partkey % 17 <> 0 AS named, p_partkey AS concept_id FROM part")]
    for name, flag, residue in (("demo_signals", "R", 3), ("usage_signals", "A", 4), ("commercial_signals", "N", 5)):
        out.append((f"d_{name}", f"""
SELECT CASE WHEN l_linenumber > 4 THEN 1 ELSE 0 END AS batch, CASE WHEN l_suppkey % 31 <> 0 THEN l_orderkey * 8 + l_linenumber % 3 END AS id,
       true AS named, CASE WHEN l_partkey % 10 = {residue} THEN -l_partkey - 1 ELSE l_partkey END AS concept_id
FROM lineitem WHERE l_returnflag = '{flag}'"""))
    out.append(("d_text_feedback", "SELECT doc_id % 2 AS batch, doc_id AS id, true AS named, doc_id % (SELECT count(*) FROM part) AS concept_id FROM documents"))
    out.append(("d_concept_scores", """
SELECT 0 AS batch, p_partkey AS id, true AS named, p_partkey AS concept_id FROM part WHERE p_partkey % 3 < 2
UNION ALL SELECT 1, p_partkey, true, p_partkey FROM part WHERE p_partkey % 3 > 0"""))
    return out


# ---------------------------------------------------------------------------
# The same binding in SQL (DuckDB dialect), for the oracle queries.
# ---------------------------------------------------------------------------

def model_sql(dirty: bool = False, prefix: str = "") -> list[tuple[str, str]]:
    """CTEs (name, body) defining concepts, demo/usage/commercial signals, text_feedback
    (names optionally prefixed, e.g. ``raw_`` when cleaned tables take the plain names)."""

    def key(res: int) -> str:
        return (f"CASE WHEN l_partkey % 10 = {res} THEN -l_partkey - 1 ELSE l_partkey END"
                if dirty else "l_partkey")

    def nul(cond: str, expr: str) -> str:
        return f"CASE WHEN {cond} THEN NULL ELSE {expr} END" if dirty else expr

    miss = "l_linenumber % 7 = 0"
    rows = ("SELECT l.*, o.*, c.c_mktsegment, CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS pri "
            "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
            "JOIN customer c ON o.o_custkey = c.c_custkey")
    fb = "l_discount * 100.0 * 3.0" if dirty else "l_discount * 100.0"
    follow = "CAST(l_linestatus = 'O' AS INTEGER)" if dirty else "l_linestatus = 'O'"
    maker = "CAST(o_orderstatus = 'F' AS INTEGER)" if dirty else "o_orderstatus = 'F'"
    active = "pri - 3" if dirty else "pri"
    urgency = "(6 - pri) / 5.0 - 0.5" if dirty else "(6 - pri) / 5.0"
    ctes = [
        (f"{prefix}sig_rows", rows),
        (f"{prefix}concepts", f"""
SELECT p_partkey AS concept_id,
       {nul('p_partkey % 17 = 0', 'p_name')} AS concept_name,
       p_type AS industry, p_brand AS problem_area, CAST(NULL AS VARCHAR) AS target_user,
       {nul('p_partkey % 19 = 0', 'p_size / 50.0')} AS delivery_complexity,
       least(greatest((p_retailprice - 900.0) / 100.0, 0.0), 1.0) AS strategic_fit
FROM part"""),
        (f"{prefix}demo_signals", f"""
SELECT {key(3)} AS concept_id, o_custkey AS customer_id,
       {nul('o_custkey % 11 = 0', 'c_mktsegment')} AS segment,
       CAST(o_orderdate AS DATE) AS demo_date,
       {nul(miss, fb)} AS feedback_score,
       {nul('o_custkey % 13 = 0', follow)} AS follow_up_requested,
       {nul('o_custkey % 13 = 0', maker)} AS decision_maker_present,
       {nul(miss, 'pri')} AS objections_count
FROM {prefix}sig_rows WHERE l_returnflag = 'R'"""),
        (f"{prefix}usage_signals", f"""
SELECT {key(4)} AS concept_id, o_custkey AS customer_id,
       l_linenumber AS trial_sessions,
       {nul(miss, 'CAST(trunc(l_quantity) AS INTEGER)')} AS feature_clicks,
       {nul(miss, 'CAST(round(l_tax * 100.0) AS INTEGER)')} AS repeat_usage_days,
       {nul(miss, active)} AS active_users,
       {nul(miss, 'l_quantity * l_linenumber')} AS time_spent,
       {nul(miss, 'CAST(round(l_discount * 100.0) AS INTEGER) * l_linenumber')} AS abandoned_features
FROM {prefix}sig_rows WHERE l_returnflag = 'A'"""),
        (f"{prefix}commercial_signals", f"""
SELECT {key(5)} AS concept_id, o_custkey AS customer_id,
       {nul(miss, 'l_tax / 0.08')} AS pilot_interest,
       {nul(miss, urgency)} AS urgency_score,
       {nul(miss, 'l_quantity / 50.0')} AS budget_signal,
       {nul(miss, 'l_extendedprice')} AS willingness_to_pay,
       {nul(miss, 'o_totalprice')} AS expected_value,
       {nul(miss, 'l_discount / 0.1')} AS implementation_risk
FROM {prefix}sig_rows WHERE l_returnflag = 'N'"""),
        (f"{prefix}text_feedback", """
SELECT doc_id AS feedback_id, doc_id % (SELECT count(*) FROM part) AS concept_id,
       CAST(NULL AS BIGINT) AS customer_id, text AS customer_comments,
       CAST(NULL AS VARCHAR) AS pain_point_statements, CAST(NULL AS VARCHAR) AS objection_themes,
       CAST(NULL AS VARCHAR) AS requested_capabilities
FROM documents"""),
    ]
    return ctes


def with_ctes(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{n} AS ({b.strip()})" for n, b in ctes)
    return f"WITH {body}\n{final.strip()}"
