"""The verification pass: all derived state of cells from their values, as one plan.

Derived columns are a pure function of the others and are computed anew each time, so the pass is
idempotent.  One exchange by sheet serves the neighbourhood and the counterpart; a sheet is bounded
by its form.  Texts of reasons and names of statuses and categories are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import readings as R
from . import consensus, context


def _distinct(*parts: Column) -> Column:
    return F.array_distinct(F.array_compact(F.concat(*parts)))


def _one(condition: Column, text: Column) -> Column:
    return F.array(F.when(condition, text))


def verify(cells: DataFrame) -> DataFrame:
    """`cells` (the columns of cell results) with final_value settled and the derived columns."""
    blank = F.col("is_blank")
    rows = cells.withColumn("_v", R.validate(F.when(blank, "").otherwise(F.col("final_value")), F.col("reading_type"), blank))
    rows = rows.withColumn("_value", F.when(F.col("_v.error").isNull(), F.col("_v.numeric_value")))
    rows = context.anomalies(rows, "_value")
    other = Window.partitionBy("sheet_id", "day", "point")
    rows = rows.withColumns({"_blank_min": F.min(blank.cast("int")).over(other), "_blank_max": F.max(blank.cast("int")).over(other)})
    doubts = [F.col(c) for c in ("ocr_uncertainty_reasons", "agreement_count", "average_consensus_confidence", "variants")]
    rows = rows.withColumns({
        "has_blank_mismatch": F.col("_blank_min") != F.col("_blank_max"),
        "_minor": ~blank & consensus.minor_disagreement(*doubts, F.col("_v.numeric_value"), F.col("_v.error")),
        "_material": F.when(blank, F.expr("cast(array() as array<string>)")).otherwise(consensus.material_reasons(*doubts)),
        "operational_severity": F.when(F.col("reading_type") == "temperature", R.severity(F.col("_v.numeric_value"))).otherwise("not applicable"),
    })
    missing = ~blank & F.col("_v.is_blank")
    malformed = ~missing & ~F.col("_v.format_is_valid")
    outside = ~missing & F.col("_v.format_is_valid") & ~F.col("_v.within_absolute_limits")
    warned = F.col("operational_severity").isin("alert", "alarming", "critical")
    material = F.when(F.col("_minor"), F.expr("cast(array() as array<string>)")).otherwise(F.col("_material"))
    rows = rows.withColumns({
        "blocking_errors": _distinct(
            _one(missing, F.lit("The cell has no value and is not marked blank.")),
            _one(malformed, F.concat(F.lit("Malformed final value '"), F.col("_v.text"), F.lit("': "), F.col("_v.error"))),
            _one(outside, F.concat(F.lit("Value outside absolute limits: "), F.col("_v.error"))),
            _one(F.col("has_blank_mismatch"), F.lit("Temperature and humidity blank states do not match for this row."))),
        "required_confirmation_reasons": _distinct(material, _one(F.col("is_anomaly"), F.concat(
            F.lit("Statistical anomaly: "), R.shown(F.col("_value")), F.lit(" differs from the local median "), R.shown(F.col("context_median")),
            F.lit(" by "), R.shown(F.abs(F.col("_value") - F.col("context_median"))), F.lit(".")))),
        "operational_warnings": _distinct(_one(warned, F.concat(
            F.lit("Operational temperature status is "), F.col("operational_severity"), F.lit(" at "), R.shown(F.col("_v.numeric_value")), F.lit(" degrees C.")))),
        "informational_notices": _distinct(_one(F.col("_minor"), F.concat(
            F.lit("Minor high-confidence OCR disagreement; two variants support the accepted value "), F.col("_v.normalized_value"), F.lit(".")))),
        "ocr_uncertain": F.col("_minor") | (F.size(F.col("_material")) > 0),
        "review_categories": _distinct(
            _one(missing | malformed, F.lit("format")), _one(outside, F.lit("absolute_range")), _one(F.col("_minor") | (F.size(F.col("_material")) > 0), F.lit("ocr_uncertainty")),
            _one(warned, F.lit("operational_warning")), _one(F.col("is_anomaly"), F.lit("anomaly")), _one(F.col("has_blank_mismatch"), F.lit("blank_mismatch"))),
    })
    blocked = (F.size("blocking_errors") > 0) | ((F.size("required_confirmation_reasons") > 0) & ~F.col("human_verified"))
    reasons = F.array_distinct(F.concat("blocking_errors", "required_confirmation_reasons", "operational_warnings", "informational_notices"))
    rows = rows.withColumns({
        "verification_reasons": reasons, "blocks_export": blocked, "needs_review": blocked,
        "review_reason": F.when(F.size(reasons) > 0, F.array_join(reasons, " ")).when(F.col("human_verified"), "Human verified; no outstanding verification issues.")
        .when(blank, "Cell classified as blank.").otherwise("No verification issues detected."),
        "format_is_valid": F.col("_v.format_is_valid"), "within_absolute_limits": F.col("_v.within_absolute_limits"),
        "is_statistical_anomaly": F.col("is_anomaly"),
        "final_value": F.when(blank, "").otherwise(F.coalesce(F.col("_v.normalized_value"), F.col("final_value"))),
    })
    return rows.drop("_v", "_value", "_blank_min", "_blank_max", "_minor", "_material", "is_anomaly", "context_size", "context_median", "context_mad", "threshold")


def likely_blank(cells: DataFrame) -> DataFrame:
    """`cells` where faint single strokes read as 1 or nothing become blanks that a person confirms."""
    texts = F.transform("variants", lambda v: R.clean(v["raw_text"]))
    stroke = (
        ~F.col("is_blank") & (F.col("blank_ink_ratio") <= 0.012) & (F.col("blank_component_count") == 1) & (F.col("blank_largest_ratio") <= 0.012)
        & (F.col("blank_largest_width_ratio") <= 0.08) & (F.col("blank_largest_aspect_ratio") <= 0.5)
        & F.exists(texts, lambda t: t != "") & F.forall(texts, lambda t: t.isin("", "1", "I", "l", "|")) & (F.size("candidate_interpretations") == 0))
    if "serious_geometry" in cells.columns:
        stroke = stroke & ~F.col("serious_geometry")
    stroke = F.coalesce(stroke, F.lit(False))
    reason = F.array(F.lit("Likely blank: one faint stroke was read as a digit or not at all."))
    return cells.withColumn("_s", stroke).withColumns({
        "is_blank": F.col("is_blank") | F.col("_s"), "final_value": F.when(F.col("_s"), "").otherwise(F.col("final_value")),
        "human_verified": F.col("human_verified") & ~F.col("_s"), "postprocessing_status": F.when(F.col("_s"), "likely_blank").otherwise(F.col("postprocessing_status")),
        "ocr_uncertainty_reasons": F.when(F.col("_s"), F.array_distinct(F.concat("ocr_uncertainty_reasons", reason))).otherwise(F.col("ocr_uncertainty_reasons")),
        "candidate_interpretations": F.when(F.col("_s"), F.expr("cast(array() as array<string>)")).otherwise(F.col("candidate_interpretations")),
    }).drop("_s")


def display_status(cells: DataFrame) -> Column:
    """The label of a verified cell, the most pressing first."""
    reasons = F.size("verification_reasons") > 0
    serious = F.col("serious_geometry") if "serious_geometry" in cells.columns else F.lit(False)
    return (
        F.when(F.array_contains("review_categories", "format") & (F.size("blocking_errors") > 0), "Blocking format error")
        .when(F.size("blocking_errors") > 0, "Blocking error").when(F.col("postprocessing_status") == "likely_blank", "Likely blank")
        .when(F.col("is_blank"), "Blank").when((F.col("postprocessing_status") == "decimal_inferred") & ~F.col("human_verified"), "Decimal inferred")
        .when(F.col("postprocessing_status") == "manually_corrected", "Manually corrected")
        .when(((F.size("required_confirmation_reasons") > 0) & ~F.col("human_verified")) | serious, "Needs attention")
        .when(F.size("operational_warnings") > 0, "Operational warning").when(F.col("human_verified") | ~reasons, "Confirmed").otherwise("Needs attention"))


# Filters of the review table by name.
def table_filter(name: str) -> Column:
    some = lambda c: F.size(c) > 0
    of = lambda c: F.array_contains("review_categories", c)
    return {
        # the quick review's filters
        "All unresolved": F.lit(True), "Blocking errors": some("blocking_errors"), "Required confirmations": some("required_confirmation_reasons") & ~F.col("human_verified"),
        "OCR uncertainty": of("ocr_uncertainty"), "Anomalies": of("anomaly"), "Blank mismatch": of("blank_mismatch"),
        # the table's
        "All": F.lit(True), "Unresolved": F.col("blocks_export"), "Blocking": some("blocking_errors"), "Confirmations": some("required_confirmation_reasons"),
        "Warnings": some("operational_warnings"), "Notices": some("informational_notices"), "Blank mismatches": F.col("has_blank_mismatch"),
        "Detailed": F.col("blocks_export") | some("review_categories"),
    }[name]


def category_counts(cells: DataFrame) -> DataFrame:
    """category, n for all categories; a cell counts once in each of its categories."""
    from ..schema import CATEGORIES

    counts = cells.select(F.explode(F.array_distinct("review_categories")).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    names = cells.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return names.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))
