"""Template narratives and the executive summary, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (DEFAULT, FEATURE_DISPLAY_NAMES, NO_EVIDENCE_SENTENCE, OUTCOME_ARCHIVE, OUTCOME_CUSTOMER_PILOT,
                      OUTCOME_FRAMES, OUTCOME_INCUBATE, OUTCOME_MVP_BUILD, Config)
from ..functions.columns import fixed, safe_div
from .aggregates import KEY


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace each ``{name}`` in the template with its column value."""
    out = template
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), v.cast("string"))
    return out


def display_name(feature: Column) -> Column:
    return F.coalesce(F.element_at(_map(FEATURE_DISPLAY_NAMES), feature), F.regexp_replace(feature, "_", " "))


def feature_sentence(feature: Column, shap_value: Column, feature_value: Column, direction: Column,
                     cfg: Config = DEFAULT) -> Column:
    strength = F.abs(shap_value)
    magnitude = (F.when(strength >= cfg.narrative_high, "strongly")
                 .when(strength >= cfg.narrative_low, "moderately").otherwise("marginally"))
    head = F.concat(display_name(feature), F.lit(" ("), fixed(feature_value, 2), F.lit(") "), magnitude)
    return F.when(direction == "positive", F.concat(head, F.lit(" supports commercialisation readiness"))) \
        .otherwise(F.concat(head, F.lit(" weakens the readiness case")))


def _sentences(ev: Column, direction: str, cfg: Config) -> Column:
    chosen = F.filter(ev, lambda e: e["direction"] == direction)
    return F.array_join(F.transform(chosen, lambda e: feature_sentence(
        e["feature"], e["shap_value"], e["feature_value"], e["direction"], cfg)), "; ")


def evidence_text(ev: Column, cfg: Config = DEFAULT) -> Column:
    n_pos = F.size(F.filter(ev, lambda e: e["direction"] == "positive"))
    n_neg = F.size(F.filter(ev, lambda e: e["direction"] == "negative"))
    pos = F.when(n_pos > 0, F.concat(F.lit("Key strengths: "), _sentences(ev, "positive", cfg), F.lit(".")))
    neg = F.when(n_neg > 0, F.concat(F.lit("Key risks: "), _sentences(ev, "negative", cfg), F.lit(".")))
    both = F.concat_ws(" ", pos, neg)
    return F.when(F.coalesce(F.size(ev), F.lit(0)) > 0, both).otherwise(F.lit(NO_EVIDENCE_SENTENCE))


def concept_narrative(concept_id: Column, name: Column, outcome: Column, readiness: Column, confidence: Column,
                      ev: Column, cfg: Config = DEFAULT) -> Column:
    frame = F.coalesce(F.element_at(_map(OUTCOME_FRAMES), outcome),
                       F.concat(F.lit("This concept is classified as **"), outcome, F.lit("**. ")))
    summary = F.concat(F.lit("**"), name, F.lit("** ("), concept_id.cast("string"), F.lit(") scores **"),
                       fixed(readiness, 1), F.lit("/100** on commercialisation readiness with a confidence level of **"),
                       fixed(confidence, 1), F.lit("/100**. "))
    return F.concat(frame, summary, evidence_text(ev, cfg))


def all_narratives(outcomes: DataFrame, evidence: DataFrame, concepts: DataFrame, key: str = KEY,
                   cfg: Config = DEFAULT) -> DataFrame:
    """(key, narrative) for every outcome row; the name falls back to the id."""
    j = outcomes.join(concepts.select(key, "concept_name"), key, "left").join(evidence, key, "left")
    name = F.coalesce(F.col("concept_name"), F.col(key).cast("string"))
    ev = F.coalesce(F.col("evidence"), F.array().cast(evidence.schema["evidence"].dataType))
    return j.select(key, concept_narrative(F.col(key), name, F.col("recommended_outcome"), F.col("readiness_score"),
                                           F.col("confidence_score"), ev, cfg).alias("narrative"))


def _line(no: int, text: Column) -> Column:
    return F.struct(F.lit(no).alias("line_no"), text.cast("string").alias("line"))


def _top5(named: DataFrame, outcome: str, ascending: bool, key: str) -> DataFrame:
    """Top-5 rows of one outcome by readiness (a top-k, not a full sort)."""
    order = [F.asc("readiness_score") if ascending else F.desc("readiness_score"), F.asc(key)]
    return named.where(F.col("recommended_outcome") == outcome).orderBy(*order).limit(5)


def summary_lines(outcomes: DataFrame, concepts: DataFrame, key: str = KEY) -> DataFrame:
    """The executive summary as ordered lines (section, line_no, line).

    Only bounded frames meet here: one aggregate row, ≤ 5 outcome counts and two
    top-5 lists.
    """
    named = outcomes.join(concepts.select(key, "concept_name"), key, "left").withColumn(
        "name", F.coalesce(F.col("concept_name"), F.col(key).cast("string")))
    totals = outcomes.agg(
        F.count(F.lit(1)).alias("total"), F.avg("readiness_score").alias("mean_r"),
        F.count(F.when(F.col("recommended_outcome").isin(OUTCOME_MVP_BUILD, OUTCOME_CUSTOMER_PILOT), 1)).alias("n_act"),
        F.count(F.when(F.col("recommended_outcome") == OUTCOME_INCUBATE, 1)).alias("n_inc"))
    mean_s = fixed("mean_r", 1)
    pct = lambda n: fixed(safe_div(F.col(n) * 100.0, F.col("total")), 0)
    head = totals.select(F.explode(F.array(
        F.struct(F.lit(1).alias("line_no"), F.lit("# Executive Summary — AI/ML Commercialisation Portfolio\n").alias("line")),
        _line(2, F.concat(F.lit("**Portfolio Size:** "), F.col("total").cast("string"), F.lit(" concepts evaluated\n"))),
        _line(3, F.concat(F.lit("**Mean Readiness Score:** "), mean_s, F.lit("/100\n\n"))),
        _line(4, F.lit("## Outcome Distribution\n")),
    )).alias("l")).select(F.lit(1).alias("section"), "l.line_no", "l.line")
    dist = outcomes.groupBy("recommended_outcome").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "total", F.lit(None).cast("long"))
    tot = totals.select("total").scalar()
    dist_lines = dist.select(
        F.lit(2).alias("section"),
        F.row_number().over(Window.orderBy(F.desc("n"), F.asc("recommended_outcome"))).alias("line_no"),
        F.concat(F.lit("- **"), F.col("recommended_outcome"), F.lit("**: "), F.col("n").cast("string"),
                 F.lit(" concepts ("), fixed(safe_div(F.col("n") * 100.0, tot), 0), F.lit("%)\n")).alias("line"))

    def top_lines(outcome, ascending, section, title):
        top = _top5(named, outcome, ascending, key)
        rows = top.select(
            F.lit(section).alias("section"),
            (F.row_number().over(Window.orderBy(
                F.asc("readiness_score") if ascending else F.desc("readiness_score"), F.asc(key))) + 1).alias("line_no"),
            F.concat(F.lit("- **"), F.col("name"), F.lit("** — Readiness: "), fixed("readiness_score", 1),
                     F.lit(", Confidence: "), fixed("confidence_score", 1), F.lit("\n")).alias("line"))
        title_row = top.limit(1).select(F.lit(section).alias("section"), F.lit(1).alias("line_no"), F.lit(title).alias("line"))
        return title_row.unionByName(rows)

    mvp = top_lines(OUTCOME_MVP_BUILD, False, 3, "\n## Recommended for Immediate Investment (MVP Build)\n")
    arc = top_lines(OUTCOME_ARCHIVE, True, 4, "\n## Recommended for Archive (Redirect Resources)\n")
    closing = totals.select(F.explode(F.array(
        F.struct(F.lit(1).alias("line_no"), F.concat(F.lit("\n## Strategic Recommendation\nThe portfolio shows a mean readiness of "),
                                                     mean_s, F.lit("/100. ")).alias("line")),
        _line(2, F.concat(F.col("n_act").cast("string"), F.lit(" concepts ("), pct("n_act"),
                          F.lit("%) are actionable for immediate build or pilot engagement. "))),
        _line(3, F.when(F.col("n_inc") > 0, F.concat(
            F.col("n_inc").cast("string"),
            F.lit(" concepts require further incubation with additional customer validation before committing resources.")))),
    )).alias("l")).select(F.lit(5).alias("section"), "l.line_no", "l.line").where(F.col("line").isNotNull())
    return head.unionByName(dist_lines).unionByName(mvp).unionByName(arc).unionByName(closing)


def executive_summary(outcomes: DataFrame, concepts: DataFrame, key: str = KEY) -> DataFrame:
    """One row, one column ``report``: the summary lines joined in order."""
    lines = summary_lines(outcomes, concepts, key)
    ordered = F.sort_array(F.collect_list(F.struct("section", "line_no", "line")))
    return lines.agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("report"))
