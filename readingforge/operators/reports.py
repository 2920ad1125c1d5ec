"""Reports over cells, rows and sheets: evaluations, gates, preflight, audits and guards as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import readings as R
from ..functions.readings import safe_ratio
from ..schema import DAYS, KINDS, POINTS, grid
from .pairing import KEYS, guard

CELLS = DAYS * POINTS * len(KINDS)

# The timed stages of a sheet, which don't overlap.
STAGES = (
    "upload_decoding_seconds", "document_table_detection_seconds", "perspective_warp_seconds", "measurement_cell_extraction_seconds", "blank_detection_seconds", "ocr_preprocessing_seconds",
    "ocr_prediction_seconds", "postprocessing_seconds", "verification_seconds", "monitoring_record_construction_seconds", "ui_thumbnail_preparation_seconds", "model_construction_seconds",
)


def stage_totals(timings: DataFrame) -> DataFrame:
    """Per sheet: the seconds of each stage and their total, to six places.  `timings` has sheet_id,
    stage and seconds; a stage that isn't known is an error."""
    known = F.col("stage").isin(*STAGES)
    seconds = F.when(known, F.col("seconds")).otherwise(F.raise_error(F.concat(F.lit("unknown stage: "), F.coalesce("stage", F.lit("null")))).cast("double"))
    own = [F.coalesce(F.round(F.sum(F.when(F.col("stage") == s, F.col("_s"))), 6), F.lit(0.0)).alias(s) for s in STAGES]
    return timings.withColumn("_s", seconds).groupBy("sheet_id").agg(*own, F.round(F.sum("_s"), 6).alias("total_sheet_processing_seconds"))


# ---- evaluations


def corrections(rows: DataFrame) -> DataFrame:
    """`rows` (filename, reading_type, expected_value, consensus_prediction) with what the correction makes
    of the consensus: corrected_prediction, correction_changed, needs_review, correction_status,
    consensus_correct, corrected_is_exact."""
    rows = rows.withColumn("_c", R.correct(F.col("consensus_prediction"), F.col("reading_type")))
    return rows.withColumns({
        "corrected_prediction": F.col("_c.corrected_text"), "correction_changed": F.col("_c.changed"), "needs_review": F.col("_c.needs_review"), "correction_status": F.col("_c.status"),
        "consensus_correct": F.col("consensus_prediction") == F.col("expected_value"), "corrected_is_exact": F.col("_c.corrected_text") == F.col("expected_value")}).drop("_c")


def correction_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Accuracy before and after the correction, and what was accepted without a person."""
    accepted, exact = ~F.col("needs_review"), F.col("corrected_is_exact")
    n = F.count(F.lit(1))
    return corrections(rows).groupBy(*by).agg(
        n.alias("total"), F.count_if("consensus_correct").alias("consensus_correct"), F.count_if(exact).alias("corrected_correct"), F.count_if("correction_changed").alias("changed"),
        F.count_if("needs_review").alias("review"), F.count_if(accepted).alias("accepted"), F.count_if(accepted & exact).alias("correct_accepts"), F.count_if(accepted & ~exact).alias("unsafe_accepts"),
        safe_ratio(F.count_if(accepted & exact), F.count_if(accepted)).alias("accept_accuracy"))


def production_summary(rows: DataFrame, *by: str) -> DataFrame:
    """How final values (final_value_correct, needs_review) did: right, accepted, unsafe, for review."""
    accepted, right = ~F.col("needs_review"), F.col("final_value_correct")
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(
        n.alias("total"), F.count_if(right).alias("correct"), safe_ratio(F.count_if(right), n).alias("accuracy"), F.count_if(accepted).alias("accepted"), F.count_if(accepted & right).alias("correct_accepts"),
        safe_ratio(F.count_if(accepted & right), F.count_if(accepted)).alias("accept_accuracy"), F.count_if(accepted & ~right).alias("unsafe_accepts"), F.count_if("needs_review").alias("review"))


def _wide(summaries: dict[str, DataFrame], sheets: tuple[str, ...]) -> DataFrame:
    """One row with <mode>_<sheet or overall>_<metric> of summaries by sheet (dimension, value, metrics)."""
    metrics = ("final_correct", "unsafe_automatic_acceptances", "crop_alignment_failures", "blank_precision", "blank_recall", "expected_blank_count", "predicted_blank_count")
    out = None
    for mode, df in summaries.items():
        of = lambda test, m: F.max(F.when(test, F.col(m)))
        columns = [of(F.col("dimension") == "overall", m).alias(f"{mode}_overall_{m}") for m in metrics]
        columns += [of((F.col("dimension") != "overall") & (F.col("value") == s), m).alias(f"{mode}_{k}_{m}") for k, s in enumerate(sheets) for m in metrics]
        one = df.agg(*columns)
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def _checked(row: DataFrame, checks: dict[str, str]) -> DataFrame:
    flags = [F.coalesce(F.expr(c), F.lit(False)).alias(n) for n, c in checks.items()]
    return row.select("*", *flags).withColumn("passed", F.forall(F.array(*[F.col(n) for n in checks]), lambda x: x))


def calibrated_gates(fixed: DataFrame, calibrated: DataFrame, sheets: tuple[str, str, str]) -> DataFrame:
    """Whether the calibrated method may be used: six checks and passed, in one row.  The summaries are
    `grouped_metrics` by sheet; `sheets` are the sample and the two months that have to improve."""
    checks = {
        "accuracy_kept": "c_overall_final_correct >= f_overall_final_correct", "unsafe_not_increased": "c_overall_unsafe_automatic_acceptances <= f_overall_unsafe_automatic_acceptances",
        "sample_kept": "c_0_final_correct >= f_0_final_correct AND c_0_unsafe_automatic_acceptances <= f_0_unsafe_automatic_acceptances",
        "alignment_failures_fewer": "c_overall_crop_alignment_failures < f_overall_crop_alignment_failures", "first_month_better": "c_1_final_correct > f_1_final_correct", "second_month_better": "c_2_final_correct > f_2_final_correct"}
    return _checked(_wide({"f": fixed, "c": calibrated}, sheets), checks).select(*checks, "passed")


# Thresholds of the hybrid method's checks.
SAMPLE_RIGHT, BLANKS, BLANKS_FOUND, GAIN_KEPT = 14, 16, 7, 0.80


def hybrid_gates(fixed: DataFrame, calibrated: DataFrame, hybrid: DataFrame, sheets: tuple[str, str, str]) -> DataFrame:
    """Whether the hybrid method may be used: seven checks, gain_kept (the share of the calibrated
    method's gain in the first month that it keeps) and passed, in one row."""
    row = _wide({"f": fixed, "c": calibrated, "h": hybrid}, sheets)
    possible, kept = (F.greatest(F.lit(0), F.col(f"{m}_1_final_correct") - F.col("f_1_final_correct")) for m in ("c", "h"))
    row = row.withColumn("gain_kept", F.round(F.when(possible > 0, kept / possible).otherwise(1.0), 6))
    checks = {
        "no_new_unsafe": "h_overall_unsafe_automatic_acceptances <= f_overall_unsafe_automatic_acceptances", "sample_right": f"h_0_final_correct >= {SAMPLE_RIGHT}", "blank_precision_whole": "h_overall_blank_precision = 1.0",
        "blank_recall_better": f"h_overall_expected_blank_count = {BLANKS} AND h_overall_predicted_blank_count > {BLANKS_FOUND} AND h_overall_blank_recall > {BLANKS_FOUND} / {BLANKS}",
        "gain_retained": f"gain_kept >= {GAIN_KEPT}", "second_month_safe": "h_2_unsafe_automatic_acceptances <= f_2_unsafe_automatic_acceptances",
        "alignment_failures_not_more": "h_overall_crop_alignment_failures <= f_overall_crop_alignment_failures"}
    return _checked(row, checks).select(*checks, "gain_kept", "passed")


# ---- geometry before recognition


def geometry_warning(found: Column, reason: Column, fallback: Column) -> Column:
    """What is wrong with a cell's cut, or nothing."""
    own = F.trim(F.coalesce(reason, F.lit("")))
    return (
        F.when(~found, "Extracted crop is missing for this reading.").when(own != "", F.concat(F.lit("Calibrated crop rejected: "), own))
        .when(F.coalesce(fallback, F.lit(False)), "Calibrated extraction uses one or more fixed fallback boundaries.").otherwise(""))


def geometry_warnings(identities: DataFrame, cells: DataFrame) -> DataFrame:
    """`identities` (sheet_id, filename) with the warning of their cut."""
    own = cells.select("sheet_id", "filename", F.lit(True).alias("_there"), "geometry_rejection_reason", "uses_fallback_geometry")
    rows = identities.join(own, ["sheet_id", "filename"], "left")
    return rows.select(*identities.columns, geometry_warning(F.coalesce("_there", F.lit(False)), F.col("geometry_rejection_reason"), F.col("uses_fallback_geometry")).alias("geometry_warning"))


def preflight(facts: DataFrame) -> DataFrame:
    """Per sheet: recommended (the method to begin with), warnings and notices in order.  `facts` has
    sheet_id, row_sequence_used, strong_bounds, row_sequence_reason, fixed_cells, calibrated_cells,
    invalid_cells, fallback_boundaries and low_confidence_boundaries."""
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    c = F.col
    warnings = F.array_compact(F.array(
        F.when(~c("row_sequence_used") & (F.coalesce("row_sequence_reason", F.lit("")) != ""), text("The printed rows were not clear enough, so the form's row span was kept: ", c("row_sequence_reason"))),
        F.when(c("invalid_cells") > 0, text(c("invalid_cells"), " calibrated cell(s) failed the geometry checks and use fixed crops.")),
        F.when(c("fallback_boundaries") > 0, text(c("fallback_boundaries"), " boundary estimate(s) use the fixed position.")),
        F.when(c("low_confidence_boundaries") > 0, text(c("low_confidence_boundaries"), " boundary estimate(s) have low confidence."))))
    notices = F.array_compact(F.array(
        F.when(c("row_sequence_used"), text("The grid follows the printed rows of all days (", c("strong_bounds"), f"/{DAYS + 1} strong bounds).")),
        F.when(F.size("warnings") == 0, F.lit("No rejected, fixed or uncertain cell was found; a look at the crops is still needed."))))
    fit = c("row_sequence_used") & (c("fixed_cells") == CELLS) & (c("calibrated_cells") == CELLS) & (c("invalid_cells") == 0)
    return facts.withColumn("warnings", warnings).withColumn("notices", notices).withColumn("recommended", F.when(fit, "calibrated").otherwise("fixed"))


def representative_pairs(fixed: DataFrame, calibrated: DataFrame, value: str) -> DataFrame:
    """The crops (column `value`) of both methods at the top, middle and bottom of the form; one that is
    missing is an error."""
    wanted = grid(fixed.sparkSession).filter(F.col("day").isin(1, 16, DAYS) & (F.col("point") == 4))
    rows = fixed.select("sheet_id").distinct().crossJoin(F.broadcast(wanted))
    for name, df in (("fixed", fixed), ("calibrated", calibrated)):
        rows = rows.join(df.select("sheet_id", "filename", F.col(value).alias(name), F.lit(True).alias(f"_{name}")), ["sheet_id", "filename"], "left")
        lost = F.raise_error(F.concat(F.lit("no crop of "), F.col("sheet_id"), F.lit(" "), F.col("filename")))
        rows = rows.withColumn(name, F.when(F.col(f"_{name}"), F.col(name)).otherwise(lost.cast(dict(df.dtypes)[value]))).drop(f"_{name}")
    place = F.when(F.col("day") == 1, "Top").when(F.col("day") == 16, "Middle").otherwise("Bottom")
    return rows.select("sheet_id", "day", place.alias("position"), "reading_type", "filename", "fixed", "calibrated")


def structure_violations(cells: DataFrame) -> DataFrame:
    """Sheets that don't have 496 cells, 248 of either type, all named differently."""
    counts = cells.groupBy("sheet_id").agg(
        F.count(F.lit(1)).alias("cells"), *[F.count_if(F.col("reading_type") == k).alias(k) for k in KINDS], F.count_distinct("filename").alias("names"))
    return counts.filter((F.col("cells") != CELLS) | (F.col("temperature") != CELLS // 2) | (F.col("humidity") != CELLS // 2) | (F.col("names") != CELLS))


# ---- rows for people


def attach_crops(rows: DataFrame, crops: DataFrame) -> DataFrame:
    """`rows` (with temperature_filename and humidity_filename) with temperature_crop and humidity_crop.
    `crops` has sheet_id, filename, crop; a crop that is missing is an error."""
    for k in KINDS:
        own = crops.select("sheet_id", F.col("filename").alias(f"{k}_filename"), F.col("crop").alias(f"{k}_crop"))
        rows = rows.join(own, ["sheet_id", f"{k}_filename"], "left")
        lost = F.raise_error(F.concat(F.lit("no crop of "), F.coalesce(f"{k}_filename", F.lit("a missing cell")))).cast("string")
        rows = rows.withColumn(f"{k}_crop", F.coalesce(f"{k}_crop", lost))
    return rows


def editor_frame(rows: DataFrame) -> DataFrame:
    """The columns of the review table, with their headings."""
    reason = F.array_join(F.concat("blocking_errors", "required_confirmation_reasons", "operational_warnings", "informational_notices"), " ")
    return rows.select(
        "sheet_id", F.col("day").alias("Day"), F.col("point").alias("Point"), F.col("temperature_crop").alias("Temperature Crop"), F.col("temperature_final_value").alias("Temperature"),
        F.col("temperature_is_blank").alias("Temperature Blank"), F.col("humidity_crop").alias("Humidity Crop"), F.col("humidity_final_value").alias("Humidity"), F.col("humidity_is_blank").alias("Humidity Blank"),
        F.col("row_status").alias("Status"), reason.alias("Reason"))


def _mapping(column: str) -> Column:
    """A field of the variants as compact JSON by variant, keys in order."""
    from ..sources.tables import canonical_json

    return canonical_json(F.map_from_entries(F.transform("variants", lambda v: F.struct(v["variant"], v[column]))))


def diagnostic_rows(cells: DataFrame) -> DataFrame:
    """Cell results as flat rows with fixed columns: lists as JSON arrays, variants as JSON objects.
    Columns that `cells` lacks are null."""
    json = lambda c: F.to_json(F.coalesce(c, F.expr("cast(array() as array<string>)")))
    has = lambda c, kind: F.col(c) if c in cells.columns else F.lit(None).cast(kind)
    plain = ["sheet_id", "filename", "day", "point", "reading_type", "is_blank"]
    blank = [("blank_ink_ratio", "blank_ink_ratio", "double"), ("blank_component_count", "blank_component_count", "int")]
    blank += [(f"blank_largest_component_{k}ratio", f"blank_largest_{k}ratio", "double") for k in ("", "width_", "height_", "aspect_")]
    lists = ["verification_reasons", "blocking_errors", "required_confirmation_reasons", "operational_warnings", "informational_notices", "review_categories"]
    last = ["human_verified", "blocks_export", "needs_review", "review_reason", "format_is_valid", "within_absolute_limits", "operational_severity", "is_statistical_anomaly", "has_blank_mismatch", "ocr_uncertain"]
    return cells.select(
        *plain, *[has(old, kind).alias(new) for new, old, kind in blank], _mapping("raw_text").alias("raw_predictions_json"), _mapping("text").alias("normalized_predictions_json"), _mapping("confidence").alias("confidences_json"),
        "agreement_count", "average_consensus_confidence", "consensus_prediction", F.col("final_value").alias("proposed_final_value"), "postprocessing_status",
        json("candidate_interpretations").alias("candidate_interpretations_json"), json("ocr_uncertainty_reasons").alias("ocr_uncertainty_reasons_json"), *[json(c).alias(f"{c}_json") for c in lists], *last)


def verification_audit(verified: DataFrame, confirmed: DataFrame, readiness: DataFrame, geometry_mode: str) -> DataFrame:
    """sheet_id, audit: what was checked of each sheet, as one JSON object."""
    warned = verified.groupBy("sheet_id").agg(F.count_if(F.size("operational_warnings") > 0).alias("_warned"))
    done = confirmed.filter(F.col("day").between(1, DAYS)).groupBy("sheet_id").agg(F.array_sort(F.collect_set("day")).alias("_done"))
    rows = readiness.join(warned, "sheet_id").join(done, "sheet_id", "left").withColumn("_done", F.coalesce("_done", F.expr("cast(array() as array<int>)")))
    left = F.array_except(F.sequence(F.lit(1), F.lit(DAYS)), F.col("_done"))
    return rows.select("sheet_id", F.to_json(F.struct(
        F.lit(1).alias("schema_version"), F.col("sheet_id").alias("sheet_fingerprint"), F.lit(geometry_mode).alias("geometry_mode"), F.col("_done").alias("confirmed_days"), left.alias("unconfirmed_days"),
        F.col("blocking_cells").alias("blocking_cell_count"), F.col("unverified_confirmations").alias("attention_item_count"), F.col("mismatch_rows").alias("blank_mismatch_count"),
        F.col("_warned").alias("operational_warning_count"), F.col("invalid_values").alias("invalid_final_value_count"), F.col("ready").alias("export_ready"))).alias("audit"))


def export_violations(rows: DataFrame) -> DataFrame:
    """sheet_id, violation: the first of what stands against writing a sheet's rows into the form."""
    form = F.broadcast(grid(rows.sparkSession).select("day", "point").distinct())
    here = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.coalesce("blocks_export", F.lit(False))).alias("_blocked"), F.bool_or(F.col("blocks_export").isNull()).alias("_unknown"))
    every = rows.select("sheet_id").distinct().crossJoin(form).withColumn("_form", F.lit(True)).join(here, KEYS, "full")
    facts = every.groupBy("sheet_id").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.sum(F.when(F.col("_blocked"), F.col("_n")).otherwise(0)).alias("blocked"), F.bool_or(F.coalesce("_unknown", F.lit(False))).alias("unknown"),
        F.min(F.when(F.col("_form").isNull(), F.struct("day", "point"))).alias("off"), F.min(F.when(F.col("_n") > 1, F.struct("day", "point"))).alias("twice"),
        F.min(F.when(F.col("_n").isNull(), F.struct("day", "point"))).alias("missing"))
    at = lambda c, what: F.format_string(f"{what} Day %d, Point %d", F.col(f"{c}.day"), F.col(f"{c}.point"))
    first = F.coalesce(
        F.when(F.col("n") != DAYS * POINTS, F.format_string(f"%d rows instead of {DAYS * POINTS}", "n")), F.when(F.col("unknown"), F.lit("rows without an export state")),
        F.when(F.col("blocked") > 0, F.format_string("%d blocked rows", "blocked")), F.when(F.col("off").isNotNull(), at("off", "not on the form:")),
        F.when(F.col("twice").isNotNull(), at("twice", "repeated:")), F.when(F.col("missing").isNotNull(), at("missing", "missing:")))
    return facts.select("sheet_id", first.alias("violation")).filter("violation IS NOT NULL")


def exportable(rows: DataFrame) -> DataFrame:
    """`rows`, if nothing stands against writing any of their sheets."""
    guard(export_violations(rows), "rows can't be exported")
    return rows


# ---- state


def state_for_sheet(state: DataFrame, sheet_id: str) -> DataFrame:
    """What a table of state holds for one sheet; a sheet that it doesn't know starts with nothing."""
    return state.filter(F.col("sheet_id") == sheet_id)


def overlay(base: DataFrame, top: DataFrame, key: list[str]) -> DataFrame:
    """The rows of `base`, of which those that `top` has too are replaced by its rows."""
    return base.join(top.select(*key), key, "left_anti").select(top.columns).unionByName(top)


def boundary_source(source: Column) -> Column:
    """Where a boundary's position comes from, in three kinds."""
    return F.when(source.isin("detected", "fixed_fallback"), source).otherwise("interpolated")


def position_at(coordinates: Column, positions: Column, at: Column) -> Column:
    """The position of a sampled curve at a coordinate: by a straight line between samples, flat beyond."""
    samples = F.arrays_zip(coordinates.alias("x"), positions.alias("y"))
    low = F.try_element_at(F.filter(samples, lambda s: s["x"] <= at), F.lit(-1))
    high = F.get(F.filter(samples, lambda s: s["x"] >= at), F.lit(0))
    line = low["y"] + (high["y"] - low["y"]) * (at - low["x"]) / F.nullif(high["x"] - low["x"], F.lit(0.0))
    return F.when(low.isNull(), high["y"]).when(high.isNull(), low["y"]).otherwise(F.coalesce(line, low["y"]))


def grid_index(day: Column, point: Column, kind: Column) -> Column:
    """struct(row, column) of a cell on the form, from 0."""
    return F.struct((day - 1).alias("row"), ((point - 1) * 2 + F.when(kind == "humidity", 1).otherwise(0)).alias("column"))


def balanced_difference(a: Column, b: Column) -> Column:
    """The difference of two amounts as a share of both."""
    return (a - b) / F.greatest(a + b, F.lit(1e-6))


def payload(text: Column) -> Column:
    """struct(text, score) of a recogniser's JSON, which may be wrapped in `res`."""
    kind = "rec_text string, rec_score double"
    read = F.from_json(text, f"{kind}, res struct<rec_text:string,rec_score:double>")
    return F.struct(F.coalesce(read["res"]["rec_text"], read["rec_text"], F.lit("")).alias("text"), F.coalesce(read["res"]["rec_score"], read["rec_score"], F.lit(0.0)).alias("score"))
