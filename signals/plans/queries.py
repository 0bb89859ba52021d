"""The registered queries (one per operator of the inventory) and their SQL oracles.

Each query reads the driver tables of ``sf_dir`` through the adapter, runs one
operator over the whole tables and rounds doubles to 6 places (``finish``).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import features as feat
from ..sources import adapters as ad
from . import sql as S
from .registry import finish, query

K = "concept_id"


def model(spark: SparkSession, sf_dir: str, dirty: bool = False, by_customer: bool | None = None):
    return ad.signal_model(spark, sf_dir, dirty, by_customer)


# ---------------------------------------------------------------- features

@query("min_max_normalize", S.q(S.stats_ctes(), f"""
SELECT concept_id, {S.r6('mean_wtp')} AS mean_wtp, {S.r6(S.mm('mean_wtp', 'comm_st'))} AS wtp_norm FROM comm_st"""))
def q_min_max(spark, sf_dir):
    from ..functions.stats import min_max
    c = agg.materialize(agg.commercial_stats(model(spark, sf_dir)["commercial_signals"]))
    return finish(c.select(K, "mean_wtp", min_max(c, "mean_wtp").alias("wtp_norm")))


@query("demand_intensity", S.q(S.stats_ctes(), f"""
SELECT d.concept_id, {S.r6(S.demand_sql())} AS demand_intensity
FROM demo_st d LEFT JOIN comm_st c ON c.concept_id = d.concept_id"""))
def q_demand(spark, sf_dir):
    m = model(spark, sf_dir)
    return finish(feat.demand_intensity(m["demo_signals"], m["commercial_signals"]))


@query("repeatability", S.q(S.stats_ctes(), f"SELECT concept_id, {S.r6(S.repeat_sql())} AS repeatability FROM usage_st"))
def q_repeat(spark, sf_dir):
    return finish(feat.repeatability(model(spark, sf_dir)["usage_signals"]))


@query("engagement_depth", S.q(S.stats_ctes(), f"SELECT concept_id, {S.r6(S.engage_sql())} AS engagement_depth FROM usage_st"))
def q_engage(spark, sf_dir):
    return finish(feat.engagement_depth(model(spark, sf_dir)["usage_signals"]))


@query("segment_similarity_raw", S.q(S.stats_ctes(), f"""
SELECT concept_id, {S.r6('segment_similarity_raw')} AS segment_similarity_raw FROM seg_st"""))
def q_segment(spark, sf_dir):
    return finish(feat.segment_similarity_raw(model(spark, sf_dir)["demo_signals"]))


@query("revenue_potential", S.q(S.stats_ctes(), f"SELECT concept_id, {S.r6(S.revenue_sql())} AS revenue_potential FROM comm_st"))
def q_revenue(spark, sf_dir):
    return finish(feat.revenue_potential(model(spark, sf_dir)["commercial_signals"]))


@query("feasibility", S.q(S.stats_ctes(), f"""
SELECT m.concept_id, {S.r6(S.feasibility_sql())} AS feasibility
FROM concepts m LEFT JOIN comm_st c ON c.concept_id = m.concept_id"""))
def q_feasibility(spark, sf_dir):
    m = model(spark, sf_dir)
    return finish(feat.feasibility(m["concepts"], m["commercial_signals"]))


@query("strategic_fit", S.q([], f"SELECT concept_id, {S.r6(S.clip01('strategic_fit'))} AS strategic_fit FROM concepts"))
def q_fit(spark, sf_dir):
    return finish(feat.strategic_fit(model(spark, sf_dir)["concepts"]))


@query("confidence_proxy", S.q(S.stats_ctes(), f"""
SELECT d.concept_id, {S.r6(S.conf_proxy_sql())} AS confidence_proxy
FROM demo_st d LEFT JOIN usage_st u ON u.concept_id = d.concept_id
LEFT JOIN comm_st c ON c.concept_id = d.concept_id"""))
def q_conf_proxy(spark, sf_dir):
    m = model(spark, sf_dir)
    return finish(feat.confidence_proxy(m["demo_signals"], m["usage_signals"], m["commercial_signals"]))


_FEAT_SELECT = ", ".join([f"{S.r6(c)} AS {c}" for c in S.FEATURE_COLS] + [f"{S.r6('delivery_complexity')} AS delivery_complexity", "concept_name"])


@query("feature_table", S.q(S.feature_ctes(), f"SELECT concept_id, {_FEAT_SELECT} FROM feat"))
def q_feature_table(spark, sf_dir):
    m = model(spark, sf_dir)
    return finish(feat.feature_table(m["concepts"], m["demo_signals"], m["usage_signals"], m["commercial_signals"]))


# ---------------------------------------------------------------- clusters, readiness, confidence, decision
# (rule portfolio: given labels p_size % 4, rule-baseline readiness; see plans/portfolio.py)

from ..config import DEFAULT as CFG  # noqa: E402
from ..operators import clusters as clu  # noqa: E402
from ..operators import confidence as conf  # noqa: E402
from ..operators import decide as dec  # noqa: E402
from ..operators import readiness as rdy  # noqa: E402
from .portfolio import rule_portfolio  # noqa: E402

_CF = list(CFG.cluster_features)
_Z_SQL = ", ".join(
    f"{S.r6(f'CASE WHEN stddev_pop(coalesce({c}, 0.0)) OVER () = 0 THEN 0.0 ELSE (coalesce({c}, 0.0) - avg(coalesce({c}, 0.0)) OVER ()) / stddev_pop(coalesce({c}, 0.0)) OVER () END')} AS {c}_z"
    for c in _CF)


@query("standardize", S.q(S.feature_ctes(), f"SELECT concept_id, {_Z_SQL} FROM feat"))
def q_standardize(spark, sf_dir):
    p = rule_portfolio(spark, sf_dir)
    return finish(clu.standardize(p.features, _CF))


@query("cluster_repeatability_score", S.q(S.portfolio_ctes(), f"""
SELECT concept_id, cluster_id, {S.r6('cluster_repeatability_score')} AS cluster_repeatability_score FROM labeled"""))
def q_cluster_rep(spark, sf_dir):
    p = rule_portfolio(spark, sf_dir)
    return finish(p.labeled.select(K, "cluster_id", "cluster_repeatability_score"))


@query("cluster_distribution", S.q(S.portfolio_ctes(), """
SELECT cluster_id, count(*) AS n_concepts FROM labeled GROUP BY cluster_id"""))
def q_cluster_dist(spark, sf_dir):
    return clu.cluster_distribution(rule_portfolio(spark, sf_dir).labeled)


@query("readiness_label", S.q(S.portfolio_ctes(), f"SELECT concept_id, {S.r6('readiness_label')} AS readiness_label FROM rlabel"))
def q_label(spark, sf_dir):
    return finish(rdy.readiness_label(rule_portfolio(spark, sf_dir).features))


@query("readiness_score", S.q(S.portfolio_ctes(), f"SELECT concept_id, {S.r6('readiness_score')} AS readiness_score FROM readiness"))
def q_readiness(spark, sf_dir):
    return finish(rule_portfolio(spark, sf_dir).readiness)


def _conf_parts(spark, sf_dir):
    return rule_portfolio(spark, sf_dir).confidence_parts


@query("sample_size_factor", S.q(S.portfolio_ctes(), f"SELECT concept_id, {S.r6('sample_size_factor')} AS sample_size_factor FROM conf_parts"))
def q_ssf(spark, sf_dir):
    return finish(_conf_parts(spark, sf_dir).select(K, "sample_size_factor"))


@query("variance_penalty", S.q(S.portfolio_ctes(), f"SELECT concept_id, {S.r6('variance_penalty')} AS variance_penalty FROM conf_parts"))
def q_vp(spark, sf_dir):
    return finish(_conf_parts(spark, sf_dir).select(K, "variance_penalty"))


@query("cluster_tightness", S.q(S.portfolio_ctes(), f"SELECT concept_id, {S.r6('cluster_tightness')} AS cluster_tightness FROM tight"))
def q_tight(spark, sf_dir):
    p = rule_portfolio(spark, sf_dir)
    return finish(conf.cluster_tightness(p.labeled, p.features.select(K)))


@query("confidence_score", S.q(S.portfolio_ctes(), f"SELECT concept_id, {S.r6('confidence_score')} AS confidence_score FROM confidence"))
def q_conf(spark, sf_dir):
    return finish(rule_portfolio(spark, sf_dir).confidence)


@query("score_summary", S.q(S.portfolio_ctes(), f"""
SELECT {S.r6('avg(r.readiness_score)')} AS readiness_mean, {S.r6('min(r.readiness_score)')} AS readiness_min,
       {S.r6('max(r.readiness_score)')} AS readiness_max, {S.r6('avg(c.confidence_score)')} AS confidence_mean,
       {S.r6('min(c.confidence_score)')} AS confidence_min, {S.r6('max(c.confidence_score)')} AS confidence_max
FROM readiness r JOIN confidence c ON c.concept_id = r.concept_id"""))
def q_summary(spark, sf_dir):
    p = rule_portfolio(spark, sf_dir)
    both = p.readiness.join(p.confidence, K)
    return finish(both.agg(*conf.summary_columns("readiness_score", "readiness"),
                           *conf.summary_columns("confidence_score", "confidence")))


def _dec_inputs(spark, sf_dir):
    return rule_portfolio(spark, sf_dir).rule_inputs


@query("archive_signals", S.q(S.portfolio_ctes(), f"""
SELECT concept_id, {S.r6('abandonment_rate')} AS abandonment_rate, {S.r6('mean_objections')} AS mean_objections FROM dec_in"""))
def q_archive(spark, sf_dir):
    return finish(_dec_inputs(spark, sf_dir).select(K, "abandonment_rate", "mean_objections"))


@query("pilot_signals", S.q(S.portfolio_ctes(), f"""
SELECT concept_id, {S.r6('max_urgency')} AS max_urgency, {S.r6('max_budget')} AS max_budget FROM dec_in"""))
def q_pilot(spark, sf_dir):
    return finish(_dec_inputs(spark, sf_dir).select(K, "max_urgency", "max_budget"))


_DEC_IN_SQL = ", ".join(f"{S.r6(c)} AS {c}" for c in dec.CLASSIFY_INPUTS)


@query("classify_outcome", S.q(S.portfolio_ctes(), f"SELECT concept_id, {_DEC_IN_SQL}, recommended_outcome FROM decision"))
def q_classify(spark, sf_dir):
    return finish(dec.classify_frame(_dec_inputs(spark, sf_dir)))


_DEC_SQL = """SELECT concept_id, {r} AS readiness_score, {c} AS confidence_score, {cr} AS cluster_repeatability,
{dc} AS delivery_complexity, recommended_outcome FROM decision""".format(
    r=S.r6("readiness_score"), c=S.r6("confidence_score"), cr=S.r6("cluster_repeatability"), dc=S.r6("delivery_complexity"))


@query("decision_table", S.q(S.portfolio_ctes(), _DEC_SQL))
def q_decision(spark, sf_dir):
    return finish(rule_portfolio(spark, sf_dir).decision)


@query("outcome_distribution", S.q(S.portfolio_ctes(), """
SELECT recommended_outcome, count(*) AS n_concepts FROM decision GROUP BY recommended_outcome"""))
def q_outcomes(spark, sf_dir):
    return dec.outcome_distribution(rule_portfolio(spark, sf_dir).decision)


# ---------------------------------------------------------------- cleaning, quality, tables (dirty binding)

from .. import schemas as SC  # noqa: E402
from ..operators import clean as cln  # noqa: E402
from ..operators import quality as qual  # noqa: E402
from ..session import scratch_path, stored  # noqa: E402
from ..sources import tables as tbl  # noqa: E402


def dirty(spark, sf_dir):
    return model(spark, sf_dir, dirty=True)


_USAGE_NUM = ["trial_sessions", "feature_clicks", "repeat_usage_days", "active_users", "time_spent", "abandoned_features"]


@query("impute_median", S.qd([], "SELECT " + ", ".join(
    ["concept_id", "customer_id"] + [f"{S.r6(S.imputed(c, 'usage_signals', S.DIRTY_NULLS['usage_signals']))} AS {c}"
                                     if c in S.DIRTY_NULLS['usage_signals'] else c for c in _USAGE_NUM])
    + " FROM usage_signals"))
def q_impute_median(spark, sf_dir):
    return finish(cln.impute_median(dirty(spark, sf_dir)["usage_signals"], _USAGE_NUM))


@query("impute_mode", S.qd([], f"""
SELECT concept_id, customer_id, {S.imputed('segment', 'demo_signals', ['segment'])} AS segment FROM demo_signals"""))
def q_impute_mode(spark, sf_dir):
    return cln.impute_mode(dirty(spark, sf_dir)["demo_signals"], ["segment"]).select(K, "customer_id", "segment")


@query("clip_to_range", S.qd([], f"""
SELECT concept_id, customer_id, {S.r6(S.clip('feedback_score', 0.0, 10.0))} AS feedback_score,
       CAST({S.clip('objections_count', 0.0, 50.0)} AS INTEGER) AS objections_count FROM demo_signals"""))
def q_clip(spark, sf_dir):
    d = dirty(spark, sf_dir)["demo_signals"].select(K, "customer_id", "feedback_score", "objections_count")
    return finish(cln.clip_to_range(d, SC.NUMERIC_RANGES["demo_signals"]))


def _clip_report_sql() -> str:
    parts = []
    for t in ["concepts", "demo_signals", "usage_signals", "commercial_signals"]:
        for c, (lo, hi) in SC.NUMERIC_RANGES[t].items():
            e = S.imputed(c, t, S.DIRTY_NULLS[t])
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
                         f"count(CASE WHEN ({e}) < {lo} OR ({e}) > {hi} THEN 1 END) AS n_clipped FROM {t}")
    return " UNION ALL ".join(parts)


@query("clip_report", S.qd([], _clip_report_sql()))
def q_clip_report(spark, sf_dir):
    m = dirty(spark, sf_dir)
    reps = [cln.clip_report(cln.impute(m[t]), SC.NUMERIC_RANGES[t], t)
            for t in ["concepts", "demo_signals", "usage_signals", "commercial_signals"]]
    return qual.union_all(reps)


@query("coerce_boolean", S.qd([], "SELECT concept_id, customer_id, " + ", ".join(
    f"{S.cleaned(c, 'demo_signals', S.DIRTY_NULLS['demo_signals'], ('impute', 'coerce'))} AS {c}"
    for c in ["follow_up_requested", "decision_maker_present"]) + " FROM demo_signals"))
def q_coerce(spark, sf_dir):
    d = dirty(spark, sf_dir)["demo_signals"].select(K, "customer_id", "follow_up_requested", "decision_maker_present")
    return cln.coerce_boolean(cln.impute(d), ["follow_up_requested", "decision_maker_present"])


def _clean_sql_rounded(t: str) -> str:
    out = []
    for c in S.TABLE_COLS[t]:
        e = S.cleaned(c, t, S.DIRTY_NULLS[t])
        dbl = (c in S.DIRTY_NULLS[t] and c not in S.TEXT_COLS and c not in S.BOOL_COLS) or c in {
            "feedback_score", "time_spent", "pilot_interest", "urgency_score", "budget_signal", "willingness_to_pay",
            "expected_value", "implementation_risk", "delivery_complexity", "strategic_fit"}
        out.append(f"{S.r6(e)} AS {c}" if dbl else f"{e} AS {c}")
    return ", ".join(out)


@query("clean_table", S.qd([], f"SELECT {_clean_sql_rounded('demo_signals')} FROM demo_signals"))
def q_clean_table(spark, sf_dir):
    return finish(cln.clean_table("demo_signals", dirty(spark, sf_dir)["demo_signals"]))


def _measures(t: str) -> list[str]:
    """Numeric columns of a table that are not ids."""
    return [c for c in S.TABLE_COLS[t] if c in SC.NUMERIC_RANGES.get(t, {})]


def _load_clean_sql() -> str:
    parts = []
    for t, cols in S.TABLE_COLS.items():
        nn = " + ".join(f"CASE WHEN ({S.cleaned(c, t, S.DIRTY_NULLS[t])}) IS NULL THEN 1 ELSE 0 END" for c in cols)
        means = " + ".join(f"coalesce(avg(CAST(({S.cleaned(c, t, S.DIRTY_NULLS[t])}) AS DOUBLE)), 0.0)" for c in _measures(t)) or "0.0"
        parts.append(f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST(sum({nn}) AS BIGINT) AS n_null_values, "
                     f"round(CAST({means} AS DOUBLE), 3) AS sum_of_means FROM {t}")
    return " UNION ALL ".join(parts)


@query("load_and_clean_all", S.qd([], _load_clean_sql()))
def q_load_clean(spark, sf_dir):
    cleaned = cln.load_and_clean(dirty(spark, sf_dir))
    frames = []
    for t, df in cleaned.items():
        nn = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
        means = sum((F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)) for c in _measures(t)), F.lit(0.0))
        frames.append(df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(nn).cast("bigint").alias("n_null_values"),
                             F.round(means, 3).alias("sum_of_means"))
                      .select(F.lit(t).alias("table_name"), "n_rows", "n_null_values", "sum_of_means"))
    return qual.union_all(frames)


@query("check_primary_key", """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def q_pk(spark, sf_dir):
    return qual.duplicate_keys(ad.read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("check_foreign_key", S.qd([], " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, s.concept_id, count(*) AS n_rows FROM {t} s "
    f"WHERE NOT EXISTS (SELECT 1 FROM concepts c WHERE c.concept_id = s.concept_id) GROUP BY s.concept_id"
    for t in ["demo_signals", "usage_signals", "commercial_signals", "text_feedback"])))
def q_fk(spark, sf_dir):
    m = dirty(spark, sf_dir)
    return qual.union_all([qual.orphans(m[t], m["concepts"], K, t)
                           for t in ["demo_signals", "usage_signals", "commercial_signals", "text_feedback"]])


@query("check_not_null", S.qd([], " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS n_null FROM {t}"
    for t, cols in S.TABLE_COLS.items() for c in cols)))
def q_not_null(spark, sf_dir):
    m = dirty(spark, sf_dir)
    return qual.union_all([qual.null_counts(m[t], t, S.TABLE_COLS[t]) for t in S.TABLE_COLS])


_DEMO_ORDER = S.TABLE_COLS["demo_signals"]


@query("surrogate_id", S.q([], "SELECT row_number() OVER (ORDER BY " + ", ".join(f"{c} ASC NULLS FIRST" for c in _DEMO_ORDER)
                           + ") AS demo_id, " + ", ".join(f"{S.r6(c)} AS {c}" if c == "feedback_score" else c for c in _DEMO_ORDER)
                           + " FROM demo_signals"))
def q_surrogate(spark, sf_dir):
    d = model(spark, sf_dir)["demo_signals"]
    return finish(tbl.with_surrogate_id(d, _DEMO_ORDER, "demo_id"))


def _round_trip(spark, sf_dir):
    m = model(spark, sf_dir, by_customer=False)
    path = scratch_path(spark, "csv")
    tbl.write_csv_tables(m, path)
    back = tbl.read_csv_tables(spark, path)
    return m, back


@query("read_csv_tables", S.q([], " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in S.TABLE_COLS)))
def q_read_csv(spark, sf_dir):
    _, back = _round_trip(spark, sf_dir)
    return qual.union_all([df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
                           for t, df in back.items()])


@query("write_csv_tables", S.q([], " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_extra FROM {t}"
    for t in S.TABLE_COLS)))
def q_write_csv(spark, sf_dir):
    m, back = _round_trip(spark, sf_dir)
    frames = []
    for t, df in m.items():
        orig = df.select(*[F.col(f.name).cast("int").alias(f.name) if f.name in S.BOOL_COLS else F.col(f.name)
                           for f in df.schema.fields])
        diff = qual.row_differences(orig, back[t].select(*orig.columns))
        frames.append(diff.select(F.lit(t).alias("table_name"), "n_rows", "n_missing", "n_extra"))
    return qual.union_all(frames)


@query("append_table", S.q([], "SELECT 2 * count(*) AS n_rows, true AS empty_skipped FROM demo_signals"))
def q_append(spark, sf_dir):
    d = model(spark, sf_dir)["demo_signals"]
    path = scratch_path(spark, "append")
    tbl.append_table(d, path)
    skipped = not tbl.append_table(d.limit(0), path)
    tbl.append_table(d, path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("empty_skipped", F.lit(skipped))


@query("reset_tables", S.q([], "SELECT 2 * count(*) AS n_after_incremental, count(*) AS n_after_reset FROM usage_signals"))
def q_reset(spark, sf_dir):
    u = model(spark, sf_dir)["usage_signals"]
    path = scratch_path(spark, "reset")
    tbl.write_table(u, path, reset=True)
    tbl.write_table(u, path, reset=False)
    n_inc = spark.read.parquet(path).count()
    tbl.write_table(u, path, reset=True)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_after_reset")).select(
        F.lit(n_inc).cast("bigint").alias("n_after_incremental"), "n_after_reset")


# ---------------------------------------------------------------- explanation, narratives, reports

from ..operators import explain as xp  # noqa: E402
from ..operators import narrate as nar  # noqa: E402
from ..operators import reports as rep  # noqa: E402
from .portfolio import explain_rule_portfolio  # noqa: E402

DETAIL_CONCEPT = 0  # the concept shown by the single-concept views (waterfall, detail)


def _explained(spark, sf_dir):
    p = rule_portfolio(spark, sf_dir)
    return p, explain_rule_portfolio(p)


@query("top_features", S.q(S.explain_ctes(), "SELECT concept_id, rank, feature, shap_value, feature_value, direction FROM top"))
def q_top(spark, sf_dir):
    return _explained(spark, sf_dir)[1].top.withColumn("rank", F.col("rank").cast("bigint"))


@query("global_importance", S.q(S.explain_ctes(), f"""
SELECT feature, {S.r6('avg(abs(shap_value))')} AS mean_abs_shap FROM contrib GROUP BY feature"""))
def q_global_imp(spark, sf_dir):
    return finish(xp.global_importance(_explained(spark, sf_dir)[1].contrib))


@query("waterfall", S.q(S.explain_ctes(), f"""
SELECT concept_id, feature, {S.r6('feature_value')} AS feature_value, {S.r6('shap_value')} AS shap_value,
       row_number() OVER (ORDER BY abs(shap_value), feature) AS step,
       {S.r6('(SELECT base FROM base_value) + sum(shap_value) OVER (ORDER BY abs(shap_value), feature ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS cumulative
FROM contrib WHERE concept_id = {DETAIL_CONCEPT}"""))
def q_waterfall(spark, sf_dir):
    _, e = _explained(spark, sf_dir)
    return finish(xp.waterfall(e.contrib, e.base, DETAIL_CONCEPT).withColumn("step", F.col("step").cast("bigint")))


_TEMPLATE = "{concept_name} addresses {problem_area} for {target_user} in {industry}."


@query("fill_template", S.q([], f"""
SELECT concept_id, replace(replace(replace(replace({S.sql_str(_TEMPLATE)}, '{{concept_name}}', concept_name),
       '{{problem_area}}', problem_area), '{{target_user}}', coalesce(target_user, 'UNKNOWN')), '{{industry}}', industry) AS text
FROM concepts"""))
def q_fill_template(spark, sf_dir):
    c = cln.clean_table("concepts", model(spark, sf_dir)["concepts"])
    vals = {n: F.col(n) for n in ["concept_name", "problem_area", "target_user", "industry"]}
    return c.select(K, nar.fill_template(F.lit(_TEMPLATE), vals).alias("text"))


@query("feature_sentence", S.q(S.explain_ctes(), "SELECT concept_id, rank, sentence FROM top_s"))
def q_sentence(spark, sf_dir):
    t = _explained(spark, sf_dir)[1].top
    return t.select(K, F.col("rank").cast("bigint").alias("rank"),
                    nar.feature_sentence(F.col("feature"), F.col("shap_value"), F.col("feature_value"),
                                         F.col("direction")).alias("sentence"))


@query("concept_narrative", S.q(S.explain_ctes(), f"SELECT concept_id, narrative FROM narr WHERE concept_id = {DETAIL_CONCEPT}"))
def q_narrative(spark, sf_dir):
    return _explained(spark, sf_dir)[1].narratives.where(F.col(K) == DETAIL_CONCEPT)


@query("all_narratives", S.q(S.explain_ctes(), "SELECT concept_id, narrative FROM narr"))
def q_all_narratives(spark, sf_dir):
    return _explained(spark, sf_dir)[1].narratives


@query("executive_summary", S.q(S.summary_ctes(), "SELECT section, CAST(line_no AS BIGINT) AS line_no, line FROM lines"))
def q_exec_summary(spark, sf_dir):
    p = rule_portfolio(spark, sf_dir)
    lines = nar.summary_lines(p.decision, p.tables["concepts"])
    return lines.select("section", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query("portfolio_kpis", S.q(S.portfolio_ctes(), f"""
SELECT count(*) AS total_concepts, count(CASE WHEN recommended_outcome IN ('MVP Build', 'Customer Pilot') THEN 1 END) AS actionable,
       {S.r6('avg(readiness_score)')} AS mean_readiness FROM decision"""))
def q_kpis(spark, sf_dir):
    return finish(rep.portfolio_kpis(rule_portfolio(spark, sf_dir).decision))


@query("ranked_portfolio", S.q(S.portfolio_ctes(), f"""
SELECT m.concept_name, d.recommended_outcome, {S.r6('d.readiness_score')} AS readiness_score,
       {S.r6('d.confidence_score')} AS confidence_score, {S.r6('d.delivery_complexity')} AS delivery_complexity
FROM decision d LEFT JOIN concepts m ON m.concept_id = d.concept_id"""))
def q_ranked(spark, sf_dir):
    p = rule_portfolio(spark, sf_dir)
    return finish(rep.ranked_portfolio(p.decision, p.tables["concepts"]))


@query("portfolio_matrix", S.q(S.portfolio_ctes(), f"""
SELECT d.concept_id, m.concept_name, {S.r6('d.confidence_score')} AS confidence_score, {S.r6('d.readiness_score')} AS readiness_score,
       d.recommended_outcome,
       CASE WHEN d.readiness_score >= 40 AND d.confidence_score >= 60 THEN 'upper right'
            WHEN d.readiness_score >= 40 THEN 'upper left' WHEN d.confidence_score >= 60 THEN 'lower right'
            ELSE 'lower left' END AS quadrant
FROM decision d LEFT JOIN concepts m ON m.concept_id = d.concept_id"""))
def q_matrix(spark, sf_dir):
    p = rule_portfolio(spark, sf_dir)
    return finish(rep.portfolio_matrix(p.decision, p.tables["concepts"]))


@query("concept_detail", S.q(S.explain_ctes(), f"""
SELECT d.concept_id, m.concept_name, {S.r6('d.readiness_score')} AS readiness_score, {S.r6('d.confidence_score')} AS confidence_score,
       d.recommended_outcome, l.cluster_id, n.narrative
FROM decision d LEFT JOIN concepts m ON m.concept_id = d.concept_id LEFT JOIN labeled l ON l.concept_id = d.concept_id
LEFT JOIN narr n ON n.concept_id = d.concept_id WHERE d.concept_id = {DETAIL_CONCEPT}"""))
def q_detail(spark, sf_dir):
    p, e = _explained(spark, sf_dir)
    return finish(rep.concept_detail(p.decision, p.tables["concepts"], p.labeled, e.narratives, DETAIL_CONCEPT))


@query("write_scores", S.q(S.explain_ctes(), f"""
SELECT d.concept_id, {S.r6('d.readiness_score')} AS readiness_score, {S.r6('d.confidence_score')} AS confidence_score,
       l.cluster_id, d.recommended_outcome, CAST(coalesce(ev.n, 0) AS INTEGER) AS n_evidence, true AS has_timestamp
FROM decision d LEFT JOIN labeled l ON l.concept_id = d.concept_id LEFT JOIN ev ON ev.concept_id = d.concept_id"""))
def q_write_scores(spark, sf_dir):
    p, e = _explained(spark, sf_dir)
    path = scratch_path(spark, "concept_scores")
    tbl.write_scores(tbl.scores_frame(p.decision, p.labeled, e.evidence), path)
    back = spark.read.parquet(path)
    return finish(back.select(K, "readiness_score", "confidence_score", "cluster_id", "recommended_outcome",
                              F.json_array_length("evidence_json").alias("n_evidence"),
                              F.col("generated_at").isNotNull().alias("has_timestamp")))


@query("write_report", S.q(S.summary_ctes(), "SELECT string_agg(line, '' ORDER BY section, line_no) AS report FROM lines"))
def q_write_report(spark, sf_dir):
    p = rule_portfolio(spark, sf_dir)
    path = scratch_path(spark, "executive_summary")
    tbl.write_report(nar.executive_summary(p.decision, p.tables["concepts"]), path)
    txt = spark.read.text(path, wholetext=True)
    return txt.select(F.expr("substring(value, 1, length(value) - 1)").alias("report"))


# ---------------------------------------------------------------- models (k-means, GBT, Tree SHAP) and the full run

from ..config import OUTCOME_ARCHIVE as _OA  # noqa: E402
from ..operators import readiness_model as rm  # noqa: E402
from ..operators import treeshap as ts  # noqa: E402
from .pipeline import outputs, scored_driver_tables  # noqa: E402

_N_FEAT = "SELECT count(*) FROM feat"


@query("readiness_label_noisy", S.q(S.feature_ctes(), f"""
SELECT ({_N_FEAT}) AS n_rows, true AS in_range, true AS repeatable, true AS noise_ok"""))
def q_noisy(spark, sf_dir):
    f = rule_portfolio(spark, sf_dir).features
    a = rdy.readiness_label(f, noise=True).withColumnRenamed("readiness_label", "a")
    b = rdy.readiness_label(f, noise=True).withColumnRenamed("readiness_label", "b")
    c = rdy.readiness_label(f, noise=False).withColumnRenamed("readiness_label", "c")
    j = a.join(b, K).join(c, K)
    inner = (F.col("a") > 0) & (F.col("a") < 1) & (F.col("c") > 0) & (F.col("c") < 1)
    d = F.when(inner, F.col("a") - F.col("c"))
    s = j.agg(F.count(F.lit(1)).alias("n_rows"), F.min("a").alias("lo"), F.max("a").alias("hi"),
              F.count(F.when(F.col("a") != F.col("b"), 1)).alias("n_diff"), F.avg(d).alias("mu"), F.stddev_samp(d).alias("sd"))
    return s.select("n_rows", ((F.col("lo") >= 0) & (F.col("hi") <= 1)).alias("in_range"),
                    (F.col("n_diff") == 0).alias("repeatable"),
                    ((F.abs("mu") < 0.01) & F.col("sd").between(0.04, 0.06)).alias("noise_ok"))


def _rule_matrix(spark, sf_dir):
    f = rule_portfolio(spark, sf_dir).features
    return clu.cluster_matrix(f, list(CFG.cluster_features))


@query("kmeans_fit", S.q(S.feature_ctes(), f"SELECT ({_N_FEAT}) AS n_rows, CAST(3 AS BIGINT) AS n_clusters, true AS all_nearest"))
def q_kmeans(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    m = _rule_matrix(spark, sf_dir)
    model = clu.kmeans_fit(m, 3)
    centers = [list(map(float, c)) for c in model.clusterCenters()]  # k vectors: bounded
    pred = model.transform(m)
    arr = F.array(*[F.array(*[F.lit(v) for v in c]) for c in centers])
    va = vector_to_array(F.col(clu.VEC))
    dist = F.transform(arr, lambda c: F.aggregate(F.zip_with(c, va, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, x: acc + x))
    nearest = F.array_position(dist, F.array_min(dist)) - 1
    return pred.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("cluster_id").alias("n_clusters"),
                    F.min((nearest == F.col("cluster_id")).cast("int")).cast("boolean").alias("all_nearest"))


def _silhouette_sql() -> str:
    cf = list(CFG.cluster_features)
    z = ", ".join(f"CASE WHEN stddev_pop(coalesce({c}, 0.0)) OVER () = 0 THEN 0.0 ELSE (coalesce({c}, 0.0) - avg(coalesce({c}, 0.0)) OVER ()) / stddev_pop(coalesce({c}, 0.0)) OVER () END AS z{i}"
                  for i, c in enumerate(cf))
    sq = " + ".join(f"z{i} * z{i}" for i in range(len(cf)))
    dot = " + ".join(f"p.z{i} * c.s{i}" for i in range(len(cf)))
    sums = ", ".join(f"sum(z{i}) AS s{i}" for i in range(len(cf)))
    return S.q(S.portfolio_ctes() + [
        ("pts", f"SELECT f.concept_id, l.cluster_id, {z} FROM feat f JOIN labels l ON l.concept_id = f.concept_id"),
        ("pts2", f"SELECT *, {sq} AS nrm FROM pts"),
        ("cst", f"SELECT cluster_id, count(*) AS n, sum(nrm) AS psi, {sums} FROM pts2 GROUP BY cluster_id"),
        ("dd", f"""SELECT p.concept_id, p.cluster_id AS own, c.cluster_id AS other, c.n,
                   p.nrm + c.psi / c.n - 2 * ({dot}) / c.n AS d FROM pts2 p, cst c"""),
        ("ab", """SELECT concept_id, max(CASE WHEN own = other THEN n END) AS n_own,
                  max(CASE WHEN own = other THEN d * n / (n - 1) END) AS a, min(CASE WHEN own <> other THEN d END) AS b
                  FROM dd GROUP BY concept_id"""),
    ], f"""SELECT {S.r6("avg(CASE WHEN n_own = 1 THEN 0.0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END)")} AS silhouette FROM ab""")


@query("silhouette", _silhouette_sql())
def q_silhouette(spark, sf_dir):
    p = rule_portfolio(spark, sf_dir)
    m = clu.cluster_matrix(p.features, list(CFG.cluster_features))
    lab = m.join(p.labeled.select(K, "cluster_id"), K)
    s = clu.silhouette(lab)
    return finish(spark.range(1).select(F.lit(s).alias("silhouette")))


@query("select_optimal_k", S.q(S.feature_ctes(), "SELECT true AS k_in_range, true AS is_best"))
def q_select_k(spark, sf_dir):
    k, scores = clu.select_optimal_k(_rule_matrix(spark, sf_dir))
    rows = [(int(kk), float(v)) for kk, v in scores.items()]
    df = spark.createDataFrame(rows, "k int, silhouette double")
    return df.agg(F.lit(CFG.k_min <= k <= CFG.k_max).alias("k_in_range"),
                  (F.max("silhouette") == F.max(F.when(F.col("k") == k, F.col("silhouette")))).alias("is_best"))


@query("fit_clusters", S.q(S.feature_ctes(), f"SELECT ({_N_FEAT}) AS n_rows, true AS all_labeled, true AS score_range_ok"))
def q_fit_clusters(spark, sf_dir):
    s = scored_driver_tables(spark, sf_dir)
    k = s.cluster_info["k"]
    return s.labeled.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count(F.when(F.col("cluster_id").between(0, k - 1), 1)) == F.count(F.lit(1))).alias("all_labeled"),
        ((F.min("cluster_repeatability_score") >= 0) & (F.max("cluster_repeatability_score") <= 1)).alias("score_range_ok"))


@query("train_readiness", S.q(S.feature_ctes(), f"SELECT CAST({CFG.gbt_trees} AS BIGINT) AS n_trees, true AS fits_train"))
def q_train(spark, sf_dir):
    from pyspark.ml.evaluation import RegressionEvaluator
    s = scored_driver_tables(spark, sf_dir)
    r2 = RegressionEvaluator(labelCol="readiness_label", predictionCol="prediction", metricName="r2").evaluate(
        s.model.transform(s.train))
    return spark.range(1).select(F.lit(len(s.model.trees)).cast("bigint").alias("n_trees"), F.lit(r2 > 0.5).alias("fits_train"))


_K = CFG.cv_folds


@query("cross_validate_r2", S.q(S.feature_ctes(), f"""
SELECT {_K} AS n_folds, ({_N_FEAT}) AS n_rows, ({_N_FEAT}) // {_K} AS smallest_fold, (({_N_FEAT}) + {_K - 1}) // {_K} AS largest_fold,
       true AS contiguous, true AS r2_ok"""))
def q_cv(spark, sf_dir):
    s = scored_driver_tables(spark, sf_dir)
    mean, std, scores = rm.cross_validate_r2(s.train)
    folds = rm.with_folds(s.train).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min(K).alias("lo"), F.max(K).alias("hi"))
    before = F.lag("hi").over(Window.orderBy("fold"))  # one row per fold
    r2_ok = max(scores) <= 1.0 and mean > 0.2 and std >= 0.0
    return folds.withColumn("apart", F.coalesce(F.col("lo") > before, F.lit(True))).agg(
        F.count(F.lit(1)).cast("int").alias("n_folds"), F.sum("n").alias("n_rows"), F.min("n").alias("smallest_fold"),
        F.max("n").alias("largest_fold"), F.min("apart").alias("contiguous"), F.lit(r2_ok).alias("r2_ok"))


@query("feature_importance", "SELECT CAST(8 AS BIGINT) AS n_features, true AS sums_to_one")
def q_importance(spark, sf_dir):
    s = scored_driver_tables(spark, sf_dir)
    imp = rm.importance_frame(spark, s.model)
    return imp.agg(F.count(F.lit(1)).alias("n_features"), (F.abs(F.sum("importance") - 1.0) < 1e-9).alias("sums_to_one"))


@query("top_importance", """
SELECT CAST(range AS INTEGER) AS rank, true AS is_model_feature, true AS descending, true AS same_as_importance FROM range(1, 7)""")
def q_top_importance(spark, sf_dir):
    s = scored_driver_tables(spark, sf_dir)
    imp = rm.importance_frame(spark, s.model)
    down = Window.orderBy(F.desc("importance"), "feature")  # 8 rows
    whole = imp.select("feature", F.col("importance").alias("full"), F.row_number().over(down).alias("full_rank"))
    top = rep.top_importance(imp, 6)
    return top.withColumn("rank", F.row_number().over(down)).join(whole, "feature", "left").select(
        "rank", F.col("feature").isin(*CFG.model_features).alias("is_model_feature"),
        F.coalesce(F.lag("importance").over(Window.orderBy("rank")) >= F.col("importance"), F.lit(True)).alias("descending"),
        ((F.col("rank") == F.col("full_rank")) & (F.col("importance") == F.col("full"))).alias("same_as_importance"))


@query("shap_values", S.q(S.feature_ctes(), f"SELECT ({_N_FEAT}) AS n_rows, true AS additive_ok, true AS unused_zero"))
def q_shap(spark, sf_dir):
    s = scored_driver_tables(spark, sf_dir)
    unused = [f for f, v in s.importance if v == 0.0]
    j = s.shap.join(s.model.transform(s.train).select(K, "prediction"), K)
    unused_ok = F.lit(True)
    for f in unused:
        unused_ok = unused_ok & (F.max(F.abs(F.col(f + "_shap"))) == 0)
    return j.agg(F.count(F.lit(1)).alias("n_rows"),
                 (F.max(F.abs(F.col("shap_prediction") - F.col("prediction"))) < 1e-6).alias("additive_ok"),
                 unused_ok.alias("unused_zero"))


@query("score_portfolio")
def q_score_portfolio(spark, sf_dir):
    return finish(outputs(scored_driver_tables(spark, sf_dir, fresh=True)))


@query("score_portfolio_invariants", S.q(S.feature_ctes(), f"""
SELECT ({_N_FEAT}) AS n_rows, true AS readiness_spans, true AS outcomes_valid, true AS low_is_archive"""))
def q_score_inv(spark, sf_dir):
    from ..config import ALL_OUTCOMES
    d = scored_driver_tables(spark, sf_dir).decision
    return d.agg(F.count(F.lit(1)).alias("n_rows"),
                 ((F.min("readiness_score") == 0) & (F.max("readiness_score") == 100)).alias("readiness_spans"),
                 (F.count(F.when(F.col("recommended_outcome").isin(*ALL_OUTCOMES), 1)) == F.count(F.lit(1))).alias("outcomes_valid"),
                 (F.count(F.when((F.col("readiness_score") < 40) & (F.col("recommended_outcome") != _OA), 1)) == 0).alias("low_is_archive"))


# ---------------------------------------------------------------- incremental load (Structured Streaming)

from ..streaming.ingest import incremental_load  # noqa: E402


@query("incremental_load", S.q([], "SELECT count(*) AS n_rows, CAST(count(*) - count(segment) AS BIGINT) AS n_null_segment FROM demo_signals"))
def q_incremental(spark, sf_dir):
    d = model(spark, sf_dir)["demo_signals"]
    csv_cols = d.select(*[F.col(c).cast("int").alias(c) if c in S.BOOL_COLS else F.col(c) for c in d.columns])
    landing, sink = scratch_path(spark, "landing"), scratch_path(spark, "demo-table")
    # the whole table arrives as two deliveries (split by the parity of the demo day; every row lands once)
    parity = F.coalesce(F.dayofmonth("demo_date") % 2, F.lit(0))
    for p in (0, 1):
        csv_cols.where(parity == p).write.options(**tbl.CSV_OPTIONS).csv(f"{landing}/part{p}")
    schema = csv_cols.schema
    incremental_load(spark, f"{landing}/*", "demo_signals", schema, sink, checkpoint=scratch_path(spark, "ckpt"))
    back = spark.read.parquet(sink)
    return back.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("segment").isNull(), 1)).alias("n_null_segment"))


# ---------------------------------------------------------------- the rule portfolio over the cleaned dirty binding
# (orphan concepts, concepts without demo / usage / commercial rows, imputed and clipped values)


def _dirty_portfolio(spark, sf_dir):
    return rule_portfolio(spark, sf_dir, tables=cln.load_and_clean(dirty(spark, sf_dir)))


@query("feature_table_dirty", S.q_cleaned_dirty(S.feature_ctes(), f"SELECT concept_id, {_FEAT_SELECT} FROM feat"))
def q_feature_table_dirty(spark, sf_dir):
    return finish(_dirty_portfolio(spark, sf_dir).features)


@query("decision_table_dirty", S.q_cleaned_dirty(S.portfolio_ctes(), _DEC_SQL))
def q_decision_dirty(spark, sf_dir):
    return finish(_dirty_portfolio(spark, sf_dir).decision)


# ---------------------------------------------------------------- constraints on load, merged scores, k-means on given centres

from .. import schemas as _schemas  # noqa: E402
from ..operators import kmeans as km  # noqa: E402
from ..sources import constraints as con  # noqa: E402


def _keys_sql() -> str:
    return S.with_ctes(ad.deliveries_sql(), " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, id, count(*) AS n_rows FROM d_{t} GROUP BY id HAVING count(*) > 1 OR id IS NULL" for t in ad.DELIVERED))


@query("check_primary_keys", _keys_sql())
def q_pks(spark, sf_dir):
    frames = []
    for t, d in ad.deliveries(spark, sf_dir).items():
        key = _schemas.PRIMARY_KEYS[t]
        frames.append(qual.key_violations(d, [key]).select(F.lit(t).alias("table_name"), F.col(key).alias("id"), "n_rows"))
    return qual.union_all(frames)


def _enforced_sql() -> str:
    ctes = ad.deliveries_sql()
    for t in ad.DELIVERED:
        orphan = "false" if t == "concepts" else "concept_id IS NOT NULL AND concept_id NOT IN (SELECT id FROM a_concepts)"
        bad = "WHEN id IS NULL OR NOT named THEN 'not_null' WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'repeated_key'"
        ctes.append((f"j0_{t}", f"SELECT *, CASE {bad} WHEN {orphan} THEN 'foreign_key' ELSE 'accepted' END AS outcome FROM d_{t} WHERE batch = 0"))
        ctes.append((f"j1_{t}", f"SELECT *, CASE {bad} WHEN id IN (SELECT id FROM j0_{t} WHERE outcome = 'accepted') THEN 'stored_key' "
                                f"WHEN {orphan} THEN 'foreign_key' ELSE 'accepted' END AS outcome FROM d_{t} WHERE batch = 1"))
        ctes.append((f"a_{t}", f"SELECT id FROM j0_{t} WHERE outcome = 'accepted' UNION ALL SELECT id FROM j1_{t} WHERE outcome = 'accepted'"))
    rows = " UNION ALL ".join(f"SELECT '{t}' AS table_name, outcome, id FROM j{b}_{t}" for t in ad.DELIVERED for b in (0, 1))
    return S.with_ctes(ctes, "SELECT table_name, outcome, count(*) AS n_rows, CAST(sum(coalesce(id, 0)) AS BIGINT) AS sum_of_ids "
                             f"FROM ({rows}) GROUP BY table_name, outcome")


@query("append_enforced", _enforced_sql())
def q_append_enforced(spark, sf_dir):
    """Both loads of all six tables; what was accepted and what is in quarantine is read back from the written tables."""
    loads = ad.deliveries(spark, sf_dir)

    def load(t, concepts=None):
        d, path, key = loads[t], scratch_path(spark, f"enforced-{t}"), _schemas.PRIMARY_KEYS[t]
        for b in (0, 1):
            con.append_checked(d.where(F.col("batch") == b).drop("batch"), path, con.declared(t, concepts))
        accepted = spark.read.parquet(path).select(F.lit("accepted").alias("outcome"), F.col(key).alias("id"))
        refused = con.quarantined(spark, path)
        if refused is not None:
            accepted = accepted.unionByName(refused.select(F.col("rule").alias("outcome"), F.col(key).alias("id")))
        return path, (accepted.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.coalesce("id", F.lit(0))).alias("sum_of_ids"))
                      .select(F.lit(t).alias("table_name"), "outcome", "n_rows", "sum_of_ids"))

    path, parents = load("concepts")
    concepts = spark.read.parquet(path)
    children = [t for t in loads if t != "concepts"]
    with ThreadPoolExecutor(max_workers=len(children)) as pool:  # they only depend on the concepts
        frames = [f for _, f in pool.map(lambda t: load(t, concepts), children)]
    return qual.union_all([parents, *frames])


@query("upsert_scores", S.q(S.portfolio_ctes(), f"""
SELECT concept_id, {S.r6('CASE WHEN concept_id % 3 = 0 THEN readiness_score / 2.0 ELSE readiness_score END')} AS readiness_score, recommended_outcome,
       concept_id % 3 = 0 AS second_load FROM decision
UNION ALL SELECT -concept_id - 1, {S.r6('readiness_score')}, recommended_outcome, true FROM decision WHERE concept_id % 5 = 0"""))
def q_upsert_scores(spark, sf_dir):
    d = rule_portfolio(spark, sf_dir).decision.select(K, "readiness_score", "recommended_outcome")
    path = scratch_path(spark, "scores-merged")
    tbl.upsert(d.withColumn("second_load", F.lit(False)), path, K)
    again = d.where(F.col(K) % 3 == 0).withColumn("readiness_score", F.col("readiness_score") / 2.0)
    new = d.where(F.col(K) % 5 == 0).withColumn(K, -F.col(K) - 1)
    tbl.upsert(again.unionByName(new).withColumn("second_load", F.lit(True)), path, K)
    return finish(tbl.read_upserted(spark, path))


def _z_ctes() -> list[tuple[str, str]]:
    cf = list(CFG.cluster_features)
    z = ", ".join(f"CASE WHEN stddev_pop(coalesce({c}, 0.0)) OVER () = 0 THEN 0.0 ELSE (coalesce({c}, 0.0) - avg(coalesce({c}, 0.0)) OVER ()) / stddev_pop(coalesce({c}, 0.0)) OVER () END AS z{i}"
                  for i, c in enumerate(cf))
    return S.portfolio_ctes() + [("z", f"SELECT concept_id, row_number() OVER (ORDER BY concept_id) AS pos, {z} FROM feat")]


_DIST = " + ".join(f"(p.z{i} - c.z{i}) * (p.z{i} - c.z{i})" for i in range(len(CFG.cluster_features)))


def _given_centers(matrix, sets: list[list[int]]) -> list:
    """Centre sets made of the rows at the given positions (from 1, by concept id)."""
    from pyspark.ml.functions import vector_to_array
    import numpy as np
    rows = matrix.orderBy(K).limit(max(map(max, sets))).select(vector_to_array(clu.VEC).alias("x")).collect()
    return [np.array([rows[i - 1]["x"] for i in s]) for s in sets]


@query("kmeans_best_of_ten", S.q(_z_ctes() + [
    ("near", f"""SELECT s.range AS run, p.concept_id, min({_DIST}) AS d FROM range(10) s, z p, z c
                 WHERE c.pos BETWEEN 3 * s.range + 1 AND 3 * s.range + 3 GROUP BY s.range, p.concept_id"""),
    ("cost", "SELECT run, sum(d) AS cost FROM near GROUP BY run")],
    f"SELECT CAST(run AS INTEGER) AS run, {S.r6('cost')} AS cost, cost = (SELECT min(cost) FROM cost) AS is_best FROM cost"))
def q_best_of_ten(spark, sf_dir):
    """Ten given sets of three centres, assigned in one pass over the rows; the cheapest is the one that a search keeps."""
    m = _rule_matrix(spark, sf_dir)
    centers = _given_centers(m, [[3 * i + j for j in (1, 2, 3)] for i in range(10)])
    costs = [a.cost for a in km.assigned(km.points(m, clu.VEC, K), centers)]
    rows = [(i, float(c), c == min(costs)) for i, c in enumerate(costs)]
    return finish(spark.createDataFrame(rows, "run int, cost double, is_best boolean"))


def _silhouettes_sql() -> str:
    cf = range(len(CFG.cluster_features))
    sums, dot = ", ".join(f"sum(z{i}) AS s{i}" for i in cf), " + ".join(f"p.z{i} * c.s{i}" for i in cf)
    sq = " + ".join(f"p.z{i} * p.z{i}" for i in cf)
    return S.q(_z_ctes() + [
        ("pts", f"""SELECT k.range AS k, p.*, {sq} AS nrm, arg_min(c.pos, {_DIST}) AS own FROM range(2, 7) k, z p, z c
                    WHERE c.pos <= k.range GROUP BY ALL"""),
        ("cst", f"SELECT k, own AS cluster, count(*) AS n, sum(nrm) AS psi, {sums} FROM pts GROUP BY k, own"),
        ("dd", f"""SELECT p.k, p.concept_id, p.own, c.cluster, c.n, p.nrm + c.psi / c.n - 2 * ({dot}) / c.n AS d
                   FROM pts p JOIN cst c ON c.k = p.k"""),
        ("ab", """SELECT k, concept_id, max(CASE WHEN own = cluster THEN n END) AS n_own,
                  max(CASE WHEN own = cluster THEN d * n / (n - 1) END) AS a, min(CASE WHEN own <> cluster THEN d END) AS b
                  FROM dd GROUP BY k, concept_id"""),
        ("sil", "SELECT k, avg(CASE WHEN n_own = 1 THEN 0.0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END) AS s FROM ab GROUP BY k")],
        f"SELECT CAST(k AS INTEGER) AS k, {S.r6('s')} AS silhouette, s = (SELECT max(s) FROM sil) AS is_best FROM sil")


@query("silhouette_by_k", _silhouettes_sql())
def q_silhouette_by_k(spark, sf_dir):
    """Silhouettes of five given clusterings (k = 2…6: the first k rows are the centres), in two passes over the rows."""
    m = _rule_matrix(spark, sf_dir)
    ks = range(2, 7)
    means = km.silhouettes(km.points(m, clu.VEC, K), _given_centers(m, [list(range(1, k + 1)) for k in ks]))
    return finish(spark.createDataFrame([(k, s, s == max(means)) for k, s in zip(ks, means)], "k int, silhouette double, is_best boolean"))


# ---------------------------------------------------------------- batch by batch: statistics, distinct counts, ids

from ..operators import incremental as inc  # noqa: E402

_BATCHES = ("even", "odd")


def _in_batches(df):
    """The rows of even and of odd customers (those without one with the even)."""
    odd = F.coalesce(F.col("customer_id") % 2, F.lit(0))
    return {b: df.where(odd == i) for i, b in enumerate(_BATCHES)}


@query("features_by_batches", S.q(S.feature_ctes(), f"SELECT concept_id, {_FEAT_SELECT} FROM feat"))
def q_features_by_batches(spark, sf_dir):
    """Two batches, the second loaded twice; the features come from the stored states alone."""
    m = model(spark, sf_dir, by_customer=False)
    path = scratch_path(spark, "states")
    split = {t: _in_batches(m[t]) for t in inc.PARTS}
    for b in (*_BATCHES, _BATCHES[1]):
        inc.save_batch(path, b, {t: split[t][b] for t in inc.PARTS})
    return finish(feat.features_from_stats(inc.portfolio_stats(spark, path, m["concepts"]), K))


_SIGNALS = ["demo_signals", "usage_signals", "commercial_signals"]


@query("approximate_customers", S.q([("c", " UNION ALL ".join(f"SELECT concept_id, customer_id FROM {t}" for t in _SIGNALS))], """
SELECT concept_id, count(DISTINCT customer_id) AS n_customers, true AS within_bound FROM c GROUP BY concept_id"""))
def q_approx_customers(spark, sf_dir):
    """Sketches of the three signal tables, put together without reading them again, against the exact count."""
    m = model(spark, sf_dir)
    approx = inc.approximate_customers([inc.customer_sketches(m[t]) for t in _SIGNALS])
    every = qual.union_all([m[t].select(K, "customer_id") for t in _SIGNALS])
    exact = every.groupBy(K).agg(F.countDistinct("customer_id").alias("n_customers"))
    bound = F.greatest(F.lit(1.0), F.col("n_customers") * 5 * 0.8 / 64)  # five standard errors at lg_k = 12
    return exact.join(approx, K).select(K, "n_customers", (F.abs(F.col("approx_customers") - F.col("n_customers")) <= bound).alias("within_bound"))


@query("ids_over_loads", S.q([], "SELECT row_number() OVER (ORDER BY coalesce(customer_id % 2, 0), " + ", ".join(f"{c} ASC NULLS FIRST" for c in _DEMO_ORDER)
                             + ") AS demo_id, " + ", ".join(f"{S.r6(c)} AS {c}" if c == "feedback_score" else c for c in _DEMO_ORDER)
                             + ", CASE WHEN coalesce(customer_id % 2, 0) = 0 THEN 'even' ELSE 'odd' END AS batch FROM demo_signals"))
def q_ids_over_loads(spark, sf_dir):
    """Two loads and a retry of each: one row of ids from 1, without gaps."""
    path = scratch_path(spark, "numbered")
    split = _in_batches(model(spark, sf_dir)["demo_signals"])
    for b in ("even", "even", "odd", "even", "odd"):
        tbl.load_with_ids(split[b], path, _DEMO_ORDER, "demo_id", b)
    return finish(spark.read.parquet(path).select("demo_id", *_DEMO_ORDER, "batch"))


# ---------------------------------------------------------------- importances from the trees, loads that appear as a whole

from ..sources import versions as ver  # noqa: E402

_FEATURES_SQL = " UNION ALL ".join(f"SELECT '{f}' AS feature, true AS equals_split_gains, true AS within_one" for f in CFG.model_features)


@query("importance_from_splits", _FEATURES_SQL)
def q_importance_from_splits(spark, sf_dir):
    """The model's importances against the gains read from its saved trees, feature by feature."""
    s = scored_driver_tables(spark, sf_dir)
    told = rm.importance_frame(spark, s.model)
    gains = rm.split_gains(spark, s.model).withColumnRenamed("importance", "from_splits")
    return gains.join(told, "feature").select("feature", (F.abs(F.col("importance") - F.col("from_splits")) < 1e-9).alias("equals_split_gains"),
                                              F.col("importance").between(0.0, 1.0).alias("within_one"))


_LOADED = ["concepts", "demo_signals", "usage_signals", "commercial_signals", "text_feedback"]


@query("atomic_load", S.q([], " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS after_first, count(*) AS after_failed, 2 * count(*) AS after_second, count(*) AS after_reset FROM {t}"
    for t in _LOADED)))
def q_atomic_load(spark, sf_dir):
    """A load, one that dies in its last table, one that appends, and a reset: rows per table after each."""
    m = {t: stored(df, t) if t in _SIGNALS else df for t, df in model(spark, sf_dir, by_customer=False).items()}  # four loads of the same rows: joined once
    d = scratch_path(spark, "versions")

    def rows():
        return [ver.read(spark, d, t).agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.lit(t)) for t in _LOADED]

    ver.load(spark, d, m)
    after = [rows()]
    dies = m["text_feedback"].withColumn("customer_comments", F.raise_error(F.lit("this load dies")).cast("string"))
    try:
        ver.load(spark, d, {**m, "text_feedback": dies}, reset=True)
        raise AssertionError("the load was to die")
    except Exception as e:  # noqa: BLE001 — Spark wraps the task's error
        if "this load dies" not in str(e):
            raise
    after.append(rows())
    ver.load(spark, d, m)
    after.append(rows())
    ver.load(spark, d, m, reset=True)
    after.append(rows())
    names = ["after_first", "after_failed", "after_second", "after_reset"]
    every = qual.union_all([f.withColumn("step", F.lit(n)) for n, frames in zip(names, after) for f in frames])
    return every.groupBy(F.col("t").alias("table_name")).pivot("step", names).agg(F.max("n"))
