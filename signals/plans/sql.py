"""SQL (DuckDB dialect) building blocks for the oracle queries.

The oracle re-derives every result from the driver tables with plain SQL:
the adapter, the per-table aggregates and the features are written again
here, independently of the DataFrame code.
"""

from __future__ import annotations

from ..config import DEFAULT as C
from ..sources.adapters import model_sql, with_ctes


def r6(e: str) -> str:
    """Round like Spark's round(double, 6): half-up on the decimal value."""
    return f"CAST(round(CAST(({e}) AS DECIMAL(38,12)), 6) AS DOUBLE)"


def clip(e: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN ({e}) IS NULL THEN NULL ELSE least(greatest(({e}), {lo}), {hi}) END)"


def clip01(e: str) -> str:
    return clip(e, 0.0, 1.0)


def mm(e: str, table: str, neutral: float = 0.5) -> str:
    lo, hi = f"(SELECT min({e}) FROM {table})", f"(SELECT max({e}) FROM {table})"
    return f"(CASE WHEN {hi} = {lo} THEN {neutral} ELSE (({e}) - {lo}) / ({hi} - {lo}) END)"


def stats_ctes() -> list[tuple[str, str]]:
    return [
        ("demo_st", """
SELECT concept_id, count(*) AS demo_rows, count(DISTINCT customer_id) AS demo_customers,
       avg(feedback_score) AS mean_feedback, avg(CAST(follow_up_requested AS DOUBLE)) AS follow_up_rate,
       var_samp(feedback_score) AS feedback_var, avg(objections_count) AS mean_objections
FROM demo_signals GROUP BY concept_id"""),
        ("seg_st", """
SELECT concept_id,
       CASE WHEN count(DISTINCT segment) > 1
            THEN least(greatest(entropy(segment) * ln(2) / ln(count(DISTINCT segment)), 0.0), 1.0)
            ELSE 0.0 END AS segment_similarity_raw
FROM demo_signals WHERE segment IS NOT NULL GROUP BY concept_id"""),
        ("usage_st", """
SELECT concept_id, count(*) AS usage_rows, count(DISTINCT customer_id) AS usage_customers,
       avg(repeat_usage_days) AS mean_repeat_days, avg(trial_sessions) AS mean_sessions,
       avg(feature_clicks) AS mean_clicks, avg(time_spent) AS mean_time, avg(active_users) AS mean_active,
       sum(feature_clicks) AS total_clicks, sum(abandoned_features) AS total_abandoned
FROM usage_signals GROUP BY concept_id"""),
        ("comm_st", """
SELECT concept_id, count(*) AS commercial_rows, count(DISTINCT customer_id) AS commercial_customers,
       avg(urgency_score) AS mean_urgency, avg(willingness_to_pay) AS mean_wtp, avg(expected_value) AS mean_ev,
       avg(implementation_risk) AS mean_risk, var_samp(pilot_interest) AS pilot_var,
       max(urgency_score) AS max_urgency, max(budget_signal) AS max_budget
FROM commercial_signals GROUP BY concept_id"""),
        ("all_keys", """
SELECT concept_id FROM concepts UNION SELECT concept_id FROM demo_st
UNION SELECT concept_id FROM usage_st UNION SELECT concept_id FROM comm_st"""),
        ("all_st", """
SELECT k.concept_id, m.concept_name, m.delivery_complexity, m.strategic_fit,
       m.concept_id IS NOT NULL AS in_concepts,
       d.* EXCLUDE (concept_id), s.segment_similarity_raw, u.* EXCLUDE (concept_id), c.* EXCLUDE (concept_id)
FROM all_keys k LEFT JOIN concepts m ON m.concept_id = k.concept_id
LEFT JOIN demo_st d ON d.concept_id = k.concept_id LEFT JOIN seg_st s ON s.concept_id = k.concept_id
LEFT JOIN usage_st u ON u.concept_id = k.concept_id LEFT JOIN comm_st c ON c.concept_id = k.concept_id"""),
    ]


def demand_sql() -> str:
    w = C.demand_weights
    fb = mm("mean_feedback / 10.0", "demo_st")
    return clip01(f"{w['feedback_norm']} * coalesce({fb}, 0.0) + {w['follow_up_rate']} * coalesce(follow_up_rate, 0.0)"
                  f" + {w['urgency']} * coalesce(mean_urgency, 0.0)")


def repeat_sql() -> str:
    w = C.repeatability_weights
    return clip01(f"{w['repeat_days']} * {mm('mean_repeat_days', 'usage_st')}"
                  f" + {w['trial_sessions']} * {mm('mean_sessions', 'usage_st')}")


def engage_sql() -> str:
    w = C.engagement_weights
    return clip01(f"{w['feature_clicks']} * {mm('mean_clicks', 'usage_st')} + {w['time_spent']} * {mm('mean_time', 'usage_st')}"
                  f" + {w['active_users']} * {mm('mean_active', 'usage_st')}")


def revenue_sql() -> str:
    w = C.revenue_weights
    return clip01(f"{w['willingness_to_pay']} * {mm('mean_wtp', 'comm_st')}"
                  f" + {w['expected_value']} * {mm('mean_ev', 'comm_st')}")


def feasibility_sql() -> str:
    return clip01("(1.0 - coalesce(delivery_complexity, 0.5)) * (1.0 - coalesce(mean_risk, 0.5))")


def conf_proxy_sql() -> str:
    n = "greatest(coalesce(demo_customers, 0), coalesce(usage_customers, 0), coalesce(commercial_customers, 0))"
    return clip01(f"ln(1 + {n}) / ln(1 + {C.sample_saturation})")


def feature_ctes() -> list[tuple[str, str]]:
    return stats_ctes() + [("feat", f"""
SELECT concept_id,
  CASE WHEN demo_rows IS NOT NULL THEN {demand_sql()} END AS demand_intensity,
  CASE WHEN usage_rows IS NOT NULL THEN {repeat_sql()} END AS repeatability,
  CASE WHEN usage_rows IS NOT NULL THEN {engage_sql()} END AS engagement_depth,
  segment_similarity_raw,
  CASE WHEN commercial_rows IS NOT NULL THEN {revenue_sql()} END AS revenue_potential,
  CASE WHEN in_concepts THEN {feasibility_sql()} END AS feasibility,
  {clip01('strategic_fit')} AS strategic_fit,
  CASE WHEN demo_rows IS NOT NULL THEN {conf_proxy_sql()} END AS confidence_proxy,
  delivery_complexity, concept_name
FROM all_st""")]


FEATURE_COLS = ["demand_intensity", "repeatability", "engagement_depth", "segment_similarity_raw",
                "revenue_potential", "feasibility", "strategic_fit", "confidence_proxy"]


def q(ctes: list[tuple[str, str]], final: str, dirty: bool = False) -> str:
    return with_ctes(model_sql(dirty) + ctes, final)


def bround2(e: str) -> str:
    """Half-even to 2 places on the decimal value (Spark's bround)."""
    return f"CAST(round_even(CAST(({e}) AS DECIMAL(38,12)), 2) AS DOUBLE)"


def label_sql() -> str:
    terms = " + ".join(f"{w} * coalesce({n}, 0.0)" for n, w in C.label_weights.items())
    return clip01(terms)


def portfolio_ctes() -> list[tuple[str, str]]:
    """Rule portfolio: given labels (p_size % 4), rule readiness, confidence, decision."""
    w = C.confidence_weights
    n = "greatest(coalesce(demo_customers, 0), coalesce(usage_customers, 0), coalesce(commercial_customers, 0))"
    ssf = clip01(f"ln(1 + {n}) / ln(1 + {C.sample_saturation})")
    nv = "(coalesce(feedback_var, 0.0) / 25.0 + coalesce(pilot_var, 0.0) / 0.25) / 2.0"
    vp = clip01(f"1.0 - {clip01(f'{nv} * {C.variance_scale}')}")
    sd = [f"stddev_samp({f})" for f in C.tightness_features]
    nn = " + ".join(f"CASE WHEN {s} IS NULL THEN 0 ELSE 1 END" for s in sd)
    sm = " + ".join(f"coalesce({s}, 0.0)" for s in sd)
    return feature_ctes() + [
        ("labels", "SELECT p_partkey AS concept_id, CAST(p_size % 4 AS INTEGER) AS cluster_id FROM part"),
        ("labeled0", "SELECT f.*, l.cluster_id FROM feat f LEFT JOIN labels l ON l.concept_id = f.concept_id"),
        ("cmeans", "SELECT cluster_id, avg(repeatability) AS cm FROM labeled0 WHERE cluster_id IS NOT NULL GROUP BY cluster_id"),
        ("labeled", """
SELECT l.*, CASE WHEN (SELECT max(cm) FROM cmeans) > (SELECT min(cm) FROM cmeans)
                 THEN (c.cm - (SELECT min(cm) FROM cmeans)) / ((SELECT max(cm) FROM cmeans) - (SELECT min(cm) FROM cmeans))
                 ELSE 0.5 END AS cluster_repeatability_score
FROM labeled0 l LEFT JOIN cmeans c ON c.cluster_id = l.cluster_id"""),
        ("rlabel", f"SELECT concept_id, {label_sql()} AS readiness_label FROM feat"),
        ("readiness", f"""
SELECT concept_id, {bround2('CASE WHEN (SELECT max(readiness_label) FROM rlabel) > (SELECT min(readiness_label) FROM rlabel) THEN (readiness_label - (SELECT min(readiness_label) FROM rlabel)) / ((SELECT max(readiness_label) FROM rlabel) - (SELECT min(readiness_label) FROM rlabel)) * 100.0 ELSE 0.0 END')} AS readiness_score
FROM rlabel"""),
        ("spread", f"""
SELECT cluster_id, CASE WHEN ({nn}) > 0 THEN ({sm}) / ({nn}) END AS cluster_spread
FROM labeled WHERE cluster_id IS NOT NULL GROUP BY cluster_id"""),
        ("tight", f"""
SELECT f.concept_id, coalesce(1.0 - {clip01('coalesce(s.cluster_spread, 0.5)')}, 0.5) AS cluster_tightness
FROM feat f LEFT JOIN labeled l ON l.concept_id = f.concept_id LEFT JOIN spread s ON s.cluster_id = l.cluster_id"""),
        ("conf_parts", f"""
SELECT f.concept_id,
       CASE WHEN {n} < {C.min_samples} THEN {ssf} * {C.small_sample_factor} ELSE {ssf} END AS sample_size_factor,
       {vp} AS variance_penalty, t.cluster_tightness
FROM feat f LEFT JOIN all_st a ON a.concept_id = f.concept_id LEFT JOIN tight t ON t.concept_id = f.concept_id"""),
        ("confidence", f"""
SELECT concept_id, {bround2(clip(f"({w['sample_size']} * sample_size_factor + {w['variance']} * variance_penalty + {w['tightness']} * cluster_tightness) * 100.0", 0.0, 100.0))} AS confidence_score
FROM conf_parts"""),
        ("dec_in", """
SELECT f.concept_id, coalesce(r.readiness_score, 50.0) AS readiness_score,
       coalesce(c.confidence_score, 50.0) AS confidence_score,
       l.cluster_repeatability_score AS cluster_repeatability, f.delivery_complexity, f.revenue_potential,
       CAST(coalesce(a.total_abandoned, 0) AS DOUBLE) / greatest(CAST(coalesce(a.total_clicks, 0) AS DOUBLE), 1.0) AS abandonment_rate,
       CASE WHEN a.demo_rows IS NULL THEN 0.0 ELSE a.mean_objections END AS mean_objections,
       CASE WHEN a.commercial_rows IS NULL THEN 0.0 ELSE a.max_urgency END AS max_urgency,
       CASE WHEN a.commercial_rows IS NULL THEN 0.0 ELSE a.max_budget END AS max_budget
FROM feat f LEFT JOIN labeled l ON l.concept_id = f.concept_id LEFT JOIN all_st a ON a.concept_id = f.concept_id
LEFT JOIN readiness r ON r.concept_id = f.concept_id LEFT JOIN confidence c ON c.concept_id = f.concept_id"""),
        ("decision", f"SELECT *, {outcome_sql()} AS recommended_outcome FROM dec_in"),
    ]


def outcome_sql() -> str:
    return f"""CASE
  WHEN readiness_score < {C.readiness_moderate} THEN 'Archive'
  WHEN revenue_potential > 0 AND delivery_complexity / greatest(revenue_potential, 0.01) > {C.archive_complexity_ratio} THEN 'Archive'
  WHEN abandonment_rate > {C.archive_abandonment} AND mean_objections > {C.archive_objections} THEN 'Archive'
  WHEN readiness_score >= {C.readiness_high} AND confidence_score >= {C.confidence_high} AND delivery_complexity <= {C.complexity_low_to_moderate} THEN 'MVP Build'
  WHEN readiness_score >= {C.readiness_high} AND cluster_repeatability >= {C.cluster_repeatability_high} THEN 'Reusable Asset'
  WHEN readiness_score >= {C.readiness_high} AND confidence_score >= {C.confidence_high} THEN 'Customer Pilot'
  WHEN readiness_score >= {C.readiness_moderate} AND max_urgency >= {C.pilot_urgency} AND max_budget >= {C.pilot_budget} THEN 'Customer Pilot'
  ELSE 'Incubate' END"""


# ---------------------------------------------------------------- cleaning (dirty binding)

# columns the dirty binding can leave NULL (the SQL imputes exactly these)
DIRTY_NULLS = {
    "concepts": ["concept_name", "target_user", "delivery_complexity"],
    "demo_signals": ["segment", "feedback_score", "follow_up_requested", "decision_maker_present", "objections_count"],
    "usage_signals": ["feature_clicks", "repeat_usage_days", "active_users", "time_spent", "abandoned_features"],
    "commercial_signals": ["pilot_interest", "urgency_score", "budget_signal", "willingness_to_pay", "expected_value",
                           "implementation_risk"],
    "text_feedback": ["pain_point_statements", "objection_themes", "requested_capabilities"],
}
TEXT_COLS = {"segment", "concept_name", "target_user", "pain_point_statements", "objection_themes",
             "requested_capabilities", "customer_comments", "industry", "problem_area"}
INT_COLS = {"trial_sessions", "feature_clicks", "repeat_usage_days", "active_users", "abandoned_features",
            "objections_count"}
BOOL_COLS = {"follow_up_requested", "decision_maker_present"}
TABLE_COLS = {
    "concepts": ["concept_id", "concept_name", "industry", "problem_area", "target_user", "delivery_complexity",
                 "strategic_fit"],
    "demo_signals": ["concept_id", "customer_id", "segment", "demo_date", "feedback_score", "follow_up_requested",
                     "decision_maker_present", "objections_count"],
    "usage_signals": ["concept_id", "customer_id", "trial_sessions", "feature_clicks", "repeat_usage_days",
                      "active_users", "time_spent", "abandoned_features"],
    "commercial_signals": ["concept_id", "customer_id", "pilot_interest", "urgency_score", "budget_signal",
                           "willingness_to_pay", "expected_value", "implementation_risk"],
    "text_feedback": ["feedback_id", "concept_id", "customer_id", "customer_comments", "pain_point_statements",
                      "objection_themes", "requested_capabilities"],
}


def median_of(c: str, t: str) -> str:
    return f"(SELECT median(CAST({c} AS DOUBLE)) FROM {t})"


def mode_of(c: str, t: str) -> str:
    return (f"(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}) "
            f"ORDER BY n DESC, v LIMIT 1)")


def imputed(c: str, t: str, null_cols: list[str], src: str | None = None) -> str:
    if c not in null_cols:
        return c
    if c in TEXT_COLS:
        return f"coalesce({c}, {mode_of(c, src or t)}, 'UNKNOWN')"
    return f"coalesce({c}, {median_of(c, src or t)})"


def cleaned(c: str, t: str, null_cols: list[str], stages: tuple = ("impute", "clip", "coerce"),
            src: str | None = None) -> str:
    from .. import schemas
    e = imputed(c, t, null_cols, src) if "impute" in stages else c
    rng = schemas.NUMERIC_RANGES.get(t, {}).get(c)
    if "clip" in stages and rng is not None:
        e = clip(e, rng[0], rng[1])
        if c in INT_COLS and c not in null_cols:
            e = f"CAST({e} AS INTEGER)"
        elif c in INT_COLS and "impute" not in stages:
            e = f"CAST({e} AS INTEGER)"
    if "coerce" in stages and c in BOOL_COLS:
        e = f"(CAST({e} AS DOUBLE) <> 0)"
    return e


def clean_select(t: str, null_cols: list[str] | None = None, stages: tuple = ("impute", "clip", "coerce"),
                 cols: list[str] | None = None, src: str | None = None) -> str:
    nc = DIRTY_NULLS[t] if null_cols is None else null_cols
    return ", ".join(f"{cleaned(c, t, nc, stages, src)} AS {c}" for c in (cols or TABLE_COLS[t]))


def q_cleaned_dirty(ctes: list[tuple[str, str]], final: str) -> str:
    """A query over the cleaned dirty binding: raw tables are ``raw_*``, cleaned ones take the plain names."""
    clean = [(t, f"SELECT {clean_select(t, src='raw_' + t)} FROM raw_{t}") for t in TABLE_COLS]
    return with_ctes(model_sql(True, prefix="raw_") + clean + ctes, final)


def clean_ctes() -> list[tuple[str, str]]:
    return [(f"{t}_clean", f"SELECT {clean_select(t)} FROM {t}") for t in TABLE_COLS]


def qd(ctes: list[tuple[str, str]], final: str) -> str:
    """A query over the dirty binding."""
    return q(ctes, final, dirty=True)


# ---------------------------------------------------------------- contributions, narratives, summary

def r4(e: str) -> str:
    return f"CAST(round(CAST(({e}) AS DECIMAL(38,12)), 4) AS DOUBLE)"


def fmt(e: str, d: int) -> str:
    return f"CAST(round(CAST(({e}) AS DECIMAL(38,9)), {d}) AS VARCHAR)"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def display_sql(f: str) -> str:
    from ..config import FEATURE_DISPLAY_NAMES
    whens = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in FEATURE_DISPLAY_NAMES.items())
    return f"(CASE {f} {whens} ELSE replace({f}, '_', ' ') END)"


def sentence_sql(f: str, sv: str, fv: str, d: str) -> str:
    mag = (f"(CASE WHEN abs({sv}) >= {C.narrative_high} THEN 'strongly' WHEN abs({sv}) >= {C.narrative_low} "
           f"THEN 'moderately' ELSE 'marginally' END)")
    return (f"({display_sql(f)} || ' (' || {fmt(fv, 2)} || ') ' || {mag} || CASE WHEN {d} = 'positive' "
            f"THEN ' supports commercialisation readiness' ELSE ' weakens the readiness case' END)")


def frame_sql(o: str) -> str:
    from ..config import OUTCOME_FRAMES
    whens = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in OUTCOME_FRAMES.items())
    return f"(CASE {o} {whens} ELSE 'This concept is classified as **' || {o} || '**. ' END)"


def explain_ctes() -> list[tuple[str, str]]:
    from ..config import NO_EVIDENCE_SENTENCE
    feats = list(C.model_features)
    xf = ", ".join(f"coalesce({f}, 0.0) AS {f}" for f in feats)
    contrib = " UNION ALL ".join(
        f"SELECT concept_id, '{f}' AS feature, {f} AS feature_value, "
        f"{C.label_weights.get(f, 0.0)} * ({f} - (SELECT avg({f}) FROM xf)) AS shap_value FROM xf" for f in feats)
    base = " + ".join(f"{w} * {f}" for f, w in C.label_weights.items())
    return portfolio_ctes() + [
        ("xf", f"SELECT concept_id, {xf} FROM feat"),
        ("contrib", contrib),
        ("base_value", f"SELECT avg({base}) AS base FROM xf"),
        ("top", f"""
SELECT concept_id, rank, feature, {r4('shap_value')} AS shap_value, {r4('feature_value')} AS feature_value,
       CASE WHEN shap_value > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY abs(shap_value) DESC, feature) AS rank FROM contrib)
WHERE rank <= {C.top_n}"""),
        ("top_s", f"SELECT *, {sentence_sql('feature', 'shap_value', 'feature_value', 'direction')} AS sentence FROM top"),
        ("ev", """
SELECT concept_id, count(*) AS n,
       string_agg(sentence, '; ' ORDER BY rank) FILTER (WHERE direction = 'positive') AS pos,
       string_agg(sentence, '; ' ORDER BY rank) FILTER (WHERE direction = 'negative') AS neg
FROM top_s GROUP BY concept_id"""),
        ("narr", f"""
SELECT d.concept_id,
  {frame_sql('d.recommended_outcome')} || '**' || coalesce(m.concept_name, CAST(d.concept_id AS VARCHAR)) || '** ('
  || CAST(d.concept_id AS VARCHAR) || ') scores **' || {fmt('d.readiness_score', 1)}
  || '/100** on commercialisation readiness with a confidence level of **' || {fmt('d.confidence_score', 1)} || '/100**. '
  || CASE WHEN coalesce(ev.n, 0) > 0 THEN concat_ws(' ', 'Key strengths: ' || ev.pos || '.', 'Key risks: ' || ev.neg || '.')
          ELSE {sql_str(NO_EVIDENCE_SENTENCE)} END AS narrative
FROM decision d LEFT JOIN concepts m ON m.concept_id = d.concept_id LEFT JOIN ev ON ev.concept_id = d.concept_id"""),
    ]


def summary_ctes() -> list[tuple[str, str]]:
    line = lambda n, r, c: f"'- **' || {n} || '** — Readiness: ' || {fmt(r, 1)} || ', Confidence: ' || {fmt(c, 1)} || chr(10)"
    return explain_ctes() + [
        ("named", "SELECT d.*, coalesce(m.concept_name, CAST(d.concept_id AS VARCHAR)) AS name FROM decision d "
                  "LEFT JOIN concepts m ON m.concept_id = d.concept_id"),
        ("tot", """SELECT count(*) AS total, avg(readiness_score) AS mean_r,
  count(CASE WHEN recommended_outcome IN ('MVP Build', 'Customer Pilot') THEN 1 END) AS n_act,
  count(CASE WHEN recommended_outcome = 'Incubate' THEN 1 END) AS n_inc FROM decision"""),
        ("dist", "SELECT recommended_outcome, count(*) AS n FROM decision GROUP BY recommended_outcome"),
        ("mvp", "SELECT * FROM named WHERE recommended_outcome = 'MVP Build' ORDER BY readiness_score DESC, concept_id LIMIT 5"),
        ("arc", "SELECT * FROM named WHERE recommended_outcome = 'Archive' ORDER BY readiness_score ASC, concept_id LIMIT 5"),
        ("lines", f"""
SELECT 1 AS section, 1 AS line_no, '# Executive Summary — AI/ML Commercialisation Portfolio' || chr(10) AS line
UNION ALL SELECT 1, 2, '**Portfolio Size:** ' || CAST(total AS VARCHAR) || ' concepts evaluated' || chr(10) FROM tot
UNION ALL SELECT 1, 3, '**Mean Readiness Score:** ' || {fmt('mean_r', 1)} || '/100' || chr(10) || chr(10) FROM tot
UNION ALL SELECT 1, 4, '## Outcome Distribution' || chr(10)
UNION ALL SELECT 2, row_number() OVER (ORDER BY n DESC, recommended_outcome), '- **' || recommended_outcome || '**: '
  || CAST(n AS VARCHAR) || ' concepts (' || {fmt('n * 100.0 / (SELECT total FROM tot)', 0)} || '%)' || chr(10) FROM dist
UNION ALL SELECT 3, 1, chr(10) || '## Recommended for Immediate Investment (MVP Build)' || chr(10) WHERE EXISTS (SELECT 1 FROM mvp)
UNION ALL SELECT 3, 1 + row_number() OVER (ORDER BY readiness_score DESC, concept_id), {line('name', 'readiness_score', 'confidence_score')} FROM mvp
UNION ALL SELECT 4, 1, chr(10) || '## Recommended for Archive (Redirect Resources)' || chr(10) WHERE EXISTS (SELECT 1 FROM arc)
UNION ALL SELECT 4, 1 + row_number() OVER (ORDER BY readiness_score ASC, concept_id), {line('name', 'readiness_score', 'confidence_score')} FROM arc
UNION ALL SELECT 5, 1, chr(10) || '## Strategic Recommendation' || chr(10) || 'The portfolio shows a mean readiness of ' || {fmt('mean_r', 1)} || '/100. ' FROM tot
UNION ALL SELECT 5, 2, CAST(n_act AS VARCHAR) || ' concepts (' || {fmt('n_act * 100.0 / total', 0)} || '%) are actionable for immediate build or pilot engagement. ' FROM tot
UNION ALL SELECT 5, 3, CAST(n_inc AS VARCHAR) || ' concepts require further incubation with additional customer validation before committing resources.' FROM tot WHERE n_inc > 0"""),
    ]
