"""The decision matrix: the original's seven cases, every threshold, NULL inputs."""

import pytest
from pyspark.sql import functions as F

from signals.config import DEFAULT as C
from signals.operators.decide import CLASSIFY_INPUTS, classify_frame

COLS = CLASSIFY_INPUTS  # readiness, confidence, cluster_rep, complexity, revenue, abandon, objections, urgency, budget

CASES = [
    ((30, 90, .8, .2, .5, .1, 1, 0, 0), "Archive"),
    ((80, 90, .8, .2, .5, .6, 5, 0, 0), "Archive"),
    ((80, 80, .4, .3, .5, .1, 1, 0, 0), "MVP Build"),
    ((80, 80, .8, .7, .5, .1, 1, 0, 0), "Reusable Asset"),
    ((80, 80, .4, .9, .9, .1, 1, 0, 0), "Customer Pilot"),
    ((50, 80, .4, .4, .5, .1, 1, .9, .8), "Customer Pilot"),
    ((50, 30, .4, .4, .5, .1, 1, 0, 0), "Incubate"),
]


def run(spark, rows):
    schema = ", ".join(f"{c} double" for c in COLS) + ", expected string"
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in r) + (e,) for r, e in rows], schema)
    return [(r["recommended_outcome"], r["expected"]) for r in classify_frame(df).collect()]


def test_reference_cases(spark):
    for got, want in run(spark, CASES):
        assert got == want


def _base(**kw):
    row = dict(readiness_score=50.0, confidence_score=50.0, cluster_repeatability=0.0, delivery_complexity=0.5,
               revenue_potential=0.5, abandonment_rate=0.0, mean_objections=0.0, max_urgency=0.0, max_budget=0.0)
    row.update(kw)
    return tuple(row[c] for c in COLS)


EPS = 1e-9
THRESHOLD_CASES = [
    # readiness 40: archive below, not at
    (_base(readiness_score=40 - EPS), "Archive"), (_base(readiness_score=40.0), "Incubate"),
    # complexity/revenue ratio 1.5 (rp > 0 required)
    (_base(delivery_complexity=0.75 + EPS, revenue_potential=0.5), "Archive"),
    (_base(delivery_complexity=0.75, revenue_potential=0.5), "Incubate"),
    (_base(delivery_complexity=0.9, revenue_potential=0.0), "Incubate"),
    (_base(delivery_complexity=0.9, revenue_potential=None), "Incubate"),
    (_base(delivery_complexity=0.011, revenue_potential=0.005), "Incubate"),  # max(rp, 0.01): 1.1 ≤ 1.5
    (_base(delivery_complexity=0.016, revenue_potential=0.005), "Archive"),
    # abandonment 0.40 and objections 3.5 (both strict)
    (_base(abandonment_rate=0.4 + EPS, mean_objections=3.5 + EPS), "Archive"),
    (_base(abandonment_rate=0.4, mean_objections=3.6), "Incubate"),
    (_base(abandonment_rate=0.5, mean_objections=3.5), "Incubate"),
    # MVP: readiness 65, confidence 60, complexity 0.55
    (_base(readiness_score=65.0, confidence_score=60.0, delivery_complexity=0.55), "MVP Build"),
    (_base(readiness_score=65 - EPS, confidence_score=60.0, delivery_complexity=0.55), "Incubate"),
    (_base(readiness_score=65.0, confidence_score=60 - EPS, delivery_complexity=0.55), "Incubate"),
    (_base(readiness_score=65.0, confidence_score=60.0, delivery_complexity=0.55 + EPS), "Customer Pilot"),
    (_base(readiness_score=65.0, confidence_score=60.0, delivery_complexity=None), "Customer Pilot"),
    # Reusable: cluster repeatability 0.55
    (_base(readiness_score=70.0, cluster_repeatability=0.55), "Reusable Asset"),
    (_base(readiness_score=70.0, cluster_repeatability=0.55 - EPS), "Incubate"),
    (_base(readiness_score=70.0, cluster_repeatability=None), "Incubate"),
    # named-customer pilot: urgency 0.65, budget 0.55
    (_base(max_urgency=0.65, max_budget=0.55), "Customer Pilot"),
    (_base(max_urgency=0.65 - EPS, max_budget=0.55), "Incubate"),
    (_base(max_urgency=0.65, max_budget=0.55 - EPS), "Incubate"),
    (_base(readiness_score=40 - EPS, max_urgency=1.0, max_budget=1.0), "Archive"),
]


@pytest.mark.parametrize("i", range(len(THRESHOLD_CASES)))
def test_thresholds(spark, i):
    (got, want), = run(spark, [THRESHOLD_CASES[i]])
    assert got == want, THRESHOLD_CASES[i]


def test_priority_reusable_before_pilot(spark):
    # high readiness + high confidence + high complexity + high cluster score → Reusable, not Pilot
    (got, _), = run(spark, [(_base(readiness_score=80.0, confidence_score=80.0, delivery_complexity=0.7,
                                   cluster_repeatability=0.8), "")])
    assert got == "Reusable Asset"


def test_thresholds_come_from_config():
    assert (C.readiness_moderate, C.readiness_high, C.confidence_high) == (40.0, 65.0, 60.0)
    assert F is not None
