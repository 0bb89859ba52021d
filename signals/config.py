"""Weights, thresholds and labels of the scoring model.

Every function reads its parameters from a ``Config`` (a frozen dataclass) so a
caller can change them per run; the defaults below are the model's fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values (must stay equal to the original model for identical results) ---
RANDOM_SEED = 42

DEMAND_WEIGHTS = {"feedback_norm": 0.40, "follow_up_rate": 0.35, "urgency": 0.25}
REPEATABILITY_WEIGHTS = {"repeat_days": 0.60, "trial_sessions": 0.40}
ENGAGEMENT_WEIGHTS = {"feature_clicks": 0.35, "time_spent": 0.40, "active_users": 0.25}
REVENUE_WEIGHTS = {"willingness_to_pay": 0.50, "expected_value": 0.50}
READINESS_LABEL_WEIGHTS = {
    "demand_intensity": 0.25,
    "repeatability": 0.15,
    "engagement_depth": 0.15,
    "revenue_potential": 0.20,
    "feasibility": 0.15,
    "strategic_fit": 0.10,
}
READINESS_LABEL_NOISE_STD = 0.05

CLUSTER_K_MIN = 2
CLUSTER_K_MAX = 6
CLUSTER_N_INIT = 10
CLUSTER_FEATURES = ["demand_intensity", "repeatability", "engagement_depth", "segment_similarity_raw"]
TIGHTNESS_FEATURES = ["demand_intensity", "repeatability", "engagement_depth"]

MODEL_FEATURES = [
    "demand_intensity",
    "repeatability",
    "engagement_depth",
    "segment_similarity_raw",
    "revenue_potential",
    "feasibility",
    "strategic_fit",
    "confidence_proxy",
]

READINESS_HIGH = 65.0
READINESS_MODERATE = 40.0
CONFIDENCE_HIGH = 60.0
DELIVERY_COMPLEXITY_LOW_TO_MODERATE = 0.55
CLUSTER_REPEATABILITY_HIGH = 0.55
PILOT_URGENCY_THRESHOLD = 0.65
PILOT_BUDGET_THRESHOLD = 0.55
ARCHIVE_ABANDONMENT_RATE = 0.40
ARCHIVE_OBJECTION_COUNT = 3.5
ARCHIVE_COMPLEXITY_VALUE_RATIO = 1.5

CONFIDENCE_MIN_SAMPLES = 3
CONFIDENCE_VARIANCE_SCALE = 4.0
CONFIDENCE_WEIGHTS = {"sample_size": 0.40, "variance": 0.35, "tightness": 0.25}
SAMPLE_SATURATION = 30.0
SMALL_SAMPLE_FACTOR = 0.3

SHAP_TOP_N_FEATURES = 4
NARRATIVE_HIGH_THRESHOLD = 0.60
NARRATIVE_LOW_THRESHOLD = 0.20

GBT_PARAMS = {"n_estimators": 200, "learning_rate": 0.05, "max_depth": 3, "subsample": 0.8}
CV_FOLDS = 3

OUTCOME_MVP_BUILD = "MVP Build"
OUTCOME_CUSTOMER_PILOT = "Customer Pilot"
OUTCOME_REUSABLE_ASSET = "Reusable Asset"
OUTCOME_INCUBATE = "Incubate"
OUTCOME_ARCHIVE = "Archive"
ALL_OUTCOMES = [OUTCOME_MVP_BUILD, OUTCOME_CUSTOMER_PILOT, OUTCOME_REUSABLE_ASSET, OUTCOME_INCUBATE, OUTCOME_ARCHIVE]

FEATURE_DISPLAY_NAMES = {
    "demand_intensity": "customer demand intensity",
    "repeatability": "repeat usage patterns",
    "engagement_depth": "feature engagement depth",
    "segment_similarity_raw": "cross-segment appeal",
    "revenue_potential": "revenue potential",
    "feasibility": "delivery feasibility",
    "strategic_fit": "strategic alignment",
    "confidence_proxy": "data confidence level",
}

OUTCOME_FRAMES = {
    OUTCOME_MVP_BUILD: (
        "This concept is recommended for **MVP Build**. It shows strong commercial "
        "readiness with high confidence and manageable delivery complexity. "
    ),
    OUTCOME_CUSTOMER_PILOT: (
        "This concept is recommended for **Customer Pilot**. There is sufficient "
        "readiness signal, and at least one named customer shows strong urgency "
        "and budget alignment to support a targeted pilot engagement. "
    ),
    OUTCOME_REUSABLE_ASSET: (
        "This concept is recommended as a **Reusable Asset**. It demonstrates "
        "strong readiness and consistent demand patterns across multiple market "
        "segments, making it suitable for a platform-level investment. "
    ),
    OUTCOME_INCUBATE: (
        "This concept is recommended for **Incubation**. While showing moderate "
        "promise, the current evidence base is insufficient for a full build "
        "decision. More customer validation and signal collection is advised. "
    ),
    OUTCOME_ARCHIVE: (
        "This concept is recommended for **Archive**. Current signals indicate "
        "low commercial readiness, negative engagement trends, or unfavourable "
        "complexity-to-value economics. Resources should be redirected elsewhere. "
    ),
}
NO_EVIDENCE_SENTENCE = "Insufficient SHAP data to detail feature contributions."
# --- end of fixed values ---


@dataclass(frozen=True)
class Config:
    """Per-run parameters; defaults are the fixed values above."""

    seed: int = RANDOM_SEED
    demand_weights: dict = field(default_factory=lambda: dict(DEMAND_WEIGHTS))
    repeatability_weights: dict = field(default_factory=lambda: dict(REPEATABILITY_WEIGHTS))
    engagement_weights: dict = field(default_factory=lambda: dict(ENGAGEMENT_WEIGHTS))
    revenue_weights: dict = field(default_factory=lambda: dict(REVENUE_WEIGHTS))
    label_weights: dict = field(default_factory=lambda: dict(READINESS_LABEL_WEIGHTS))
    label_noise_std: float = READINESS_LABEL_NOISE_STD
    k_min: int = CLUSTER_K_MIN
    k_max: int = CLUSTER_K_MAX
    n_init: int = CLUSTER_N_INIT
    cluster_features: tuple = tuple(CLUSTER_FEATURES)
    tightness_features: tuple = tuple(TIGHTNESS_FEATURES)
    model_features: tuple = tuple(MODEL_FEATURES)
    readiness_high: float = READINESS_HIGH
    readiness_moderate: float = READINESS_MODERATE
    confidence_high: float = CONFIDENCE_HIGH
    complexity_low_to_moderate: float = DELIVERY_COMPLEXITY_LOW_TO_MODERATE
    cluster_repeatability_high: float = CLUSTER_REPEATABILITY_HIGH
    pilot_urgency: float = PILOT_URGENCY_THRESHOLD
    pilot_budget: float = PILOT_BUDGET_THRESHOLD
    archive_abandonment: float = ARCHIVE_ABANDONMENT_RATE
    archive_objections: float = ARCHIVE_OBJECTION_COUNT
    archive_complexity_ratio: float = ARCHIVE_COMPLEXITY_VALUE_RATIO
    min_samples: int = CONFIDENCE_MIN_SAMPLES
    variance_scale: float = CONFIDENCE_VARIANCE_SCALE
    confidence_weights: dict = field(default_factory=lambda: dict(CONFIDENCE_WEIGHTS))
    sample_saturation: float = SAMPLE_SATURATION
    small_sample_factor: float = SMALL_SAMPLE_FACTOR
    top_n: int = SHAP_TOP_N_FEATURES
    narrative_high: float = NARRATIVE_HIGH_THRESHOLD
    narrative_low: float = NARRATIVE_LOW_THRESHOLD
    gbt_trees: int = GBT_PARAMS["n_estimators"]
    gbt_step: float = GBT_PARAMS["learning_rate"]
    gbt_depth: int = GBT_PARAMS["max_depth"]
    gbt_subsample: float = GBT_PARAMS["subsample"]
    cv_folds: int = CV_FOLDS
    #: partitions of the inputs of the iterative fits (k-means matrix, GBT training frame); None: by their rows
    fit_partitions: int | None = None


DEFAULT = Config()
