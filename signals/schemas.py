"""Table schemas of the signal model, valid ranges and declared boolean columns."""

from __future__ import annotations

from pyspark.sql import types as T

CONCEPTS = T.StructType([
    T.StructField("concept_id", T.LongType()),
    T.StructField("concept_name", T.StringType()),
    T.StructField("industry", T.StringType()),
    T.StructField("problem_area", T.StringType()),
    T.StructField("target_user", T.StringType()),
    T.StructField("delivery_complexity", T.DoubleType()),
    T.StructField("strategic_fit", T.DoubleType()),
])

DEMO_SIGNALS = T.StructType([
    T.StructField("demo_id", T.LongType()),
    T.StructField("concept_id", T.LongType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("segment", T.StringType()),
    T.StructField("demo_date", T.DateType()),
    T.StructField("feedback_score", T.DoubleType()),
    T.StructField("follow_up_requested", T.BooleanType()),
    T.StructField("decision_maker_present", T.BooleanType()),
    T.StructField("objections_count", T.IntegerType()),
])

USAGE_SIGNALS = T.StructType([
    T.StructField("usage_id", T.LongType()),
    T.StructField("concept_id", T.LongType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("trial_sessions", T.IntegerType()),
    T.StructField("feature_clicks", T.IntegerType()),
    T.StructField("repeat_usage_days", T.IntegerType()),
    T.StructField("active_users", T.IntegerType()),
    T.StructField("time_spent", T.DoubleType()),
    T.StructField("abandoned_features", T.IntegerType()),
])

COMMERCIAL_SIGNALS = T.StructType([
    T.StructField("commercial_id", T.LongType()),
    T.StructField("concept_id", T.LongType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("pilot_interest", T.DoubleType()),
    T.StructField("urgency_score", T.DoubleType()),
    T.StructField("budget_signal", T.DoubleType()),
    T.StructField("willingness_to_pay", T.DoubleType()),
    T.StructField("expected_value", T.DoubleType()),
    T.StructField("implementation_risk", T.DoubleType()),
])

TEXT_FEEDBACK = T.StructType([
    T.StructField("feedback_id", T.LongType()),
    T.StructField("concept_id", T.LongType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("customer_comments", T.StringType()),
    T.StructField("pain_point_statements", T.StringType()),
    T.StructField("objection_themes", T.StringType()),
    T.StructField("requested_capabilities", T.StringType()),
])

CONCEPT_SCORES = T.StructType([
    T.StructField("concept_id", T.LongType()),
    T.StructField("readiness_score", T.DoubleType()),
    T.StructField("confidence_score", T.DoubleType()),
    T.StructField("cluster_id", T.IntegerType()),
    T.StructField("recommended_outcome", T.StringType()),
    T.StructField("evidence_json", T.StringType()),
    T.StructField("generated_at", T.TimestampType()),
])

TABLES = {
    "concepts": CONCEPTS,
    "demo_signals": DEMO_SIGNALS,
    "usage_signals": USAGE_SIGNALS,
    "commercial_signals": COMMERCIAL_SIGNALS,
    "text_feedback": TEXT_FEEDBACK,
}
TABLE_ORDER = ["concepts", "demo_signals", "usage_signals", "commercial_signals", "text_feedback"]

PRIMARY_KEYS = {
    "concepts": "concept_id",
    "demo_signals": "demo_id",
    "usage_signals": "usage_id",
    "commercial_signals": "commercial_id",
    "text_feedback": "feedback_id",
    "concept_scores": "concept_id",
}
NOT_NULL = {"concepts": ["concept_name"]}

# --- fixed values: valid range per column (values outside are clipped) ---
NUMERIC_RANGES = {
    "demo_signals": {
        "feedback_score": (0.0, 10.0),
        "objections_count": (0.0, 50.0),
    },
    "commercial_signals": {
        "pilot_interest": (0.0, 1.0),
        "urgency_score": (0.0, 1.0),
        "budget_signal": (0.0, 1.0),
        "implementation_risk": (0.0, 1.0),
        "willingness_to_pay": (0.0, 1_000_000.0),
        "expected_value": (0.0, 10_000_000.0),
    },
    "usage_signals": {
        "trial_sessions": (0.0, 500.0),
        "feature_clicks": (0.0, 10_000.0),
        "repeat_usage_days": (0.0, 365.0),
        "active_users": (1.0, 1_000.0),
        "time_spent": (0.0, 10_000.0),
        "abandoned_features": (0.0, 100.0),
    },
    "concepts": {
        "delivery_complexity": (0.0, 1.0),
        "strategic_fit": (0.0, 1.0),
    },
}
# --- end of fixed values ---


def boolean_columns(schema: T.StructType) -> list[str]:
    """Columns declared BOOLEAN (the only ones coerced from 0/1)."""
    return [f.name for f in schema.fields if isinstance(f.dataType, T.BooleanType)]
