"""The registered queries over the general tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import readings as R
from ..operators import consensus, context, days, metrics, pairing, patches, recognition, reports, series, verify
from ..schema import filename
from ..streaming import jobs
from . import projections as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CELL = ["sheet_id", "day", "point", "reading_type"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def reading_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = context.anomalies(P.readings(spark, sf_dir))
    return out.select(*CELL, "value", "context_size", "context_median", "context_mad", "threshold", "is_anomaly")


@query
def reading_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = R.validate(F.col("text"), F.col("reading_type"), F.col("mark") % 2 == 0)
    return P.spelled(spark, sf_dir).select(*CELL, v.alias("v")).select(*CELL, "v.normalized_value", "v.numeric_value", "v.format_is_valid", "v.within_absolute_limits", "v.error")


@query
def reading_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.table(spark, sf_dir, "documents")
    return t.select("doc_id", R.normalise(F.coalesce("text", F.lit(""))).alias("head"), R.normalise(F.concat(F.lit("-"), F.col("doc_id").cast("string"), F.lit(",5.2-"))).alias("number"))


@query
def reading_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    spelling = F.when(k % 6 == 0, k.cast("string")).when(k % 6 == 1, (k % 900 + 100).cast("string")).when(k % 6 == 2, F.concat((k % 70).cast("string"), F.lit("."), (k % 10).cast("string")))
    spelling = spelling.when(k % 6 == 3, F.concat((k % 70).cast("string"), F.lit("."), (k % 100 + 100).cast("string"))).when(k % 6 == 4, F.concat((k % 100).cast("string"), F.lit("."))).otherwise(F.concat((k % 10).cast("string"), F.lit("-")))
    rows = P.table(spark, sf_dir, "part").select("p_partkey", F.when(k % 2 == 0, "temperature").otherwise("humidity").alias("reading_type"), spelling.alias("text"))
    c = R.correct(F.col("text"), F.col("reading_type"))
    return rows.withColumn("c", c).select("p_partkey", "text", "c.corrected_text", "c.changed", "c.needs_review", "c.status", F.array_join("c.candidates", "|").alias("candidates"))


@query
def severity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 10 != 0, F.col("value") / 10)
    return P.table(spark, sf_dir, "events").groupBy(R.severity(value).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query
def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = consensus.vote(P.votes(spark, sf_dir), ["user_id", "day"])
    return out.withColumn("average_confidence", F.round(F.col("average_confidence").cast("double"), 6))


@query
def variant_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.table(spark, sf_dir, "events")
    rows = t.select(F.col("event_type").alias("variant"), F.format_string("%d.%d", F.col("event_id") % 3, F.col("user_id") % 2).alias("text"), F.when(F.col("event_id") % 5 == 0, F.format_string("%d%d", F.col("event_id") % 3, F.col("user_id") % 2)).otherwise(F.format_string("%d.0", F.col("event_id") % 2)).alias("expected"), (F.col("event_id") % 100 / 100).alias("confidence"))
    out = consensus.variant_accuracy(rows)
    return out.select("variant", "n", "correct", "accuracy", "decimal_errors", *[F.round(c, 6).alias(c) for c in ("mean_confidence", "mean_confidence_correct", "mean_confidence_wrong")])


@query
def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.pairs(P.readings(spark, sf_dir), ["value", "filename"])


@query
def pair_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.pair_violations(P.readings(spark, sf_dir))


@query
def missing_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.missing_cells(P.readings(spark, sf_dir))


@query
def blank_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pairing.blank_mismatch(P.cell_results(spark, sf_dir))
    return out.groupBy("sheet_id").agg(F.count_if("has_blank_mismatch").alias("cells"), F.count_distinct(F.when(F.col("has_blank_mismatch"), F.struct("day", "point"))).alias("rows"))


@query
def verify_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verify.verify(P.cell_results(spark, sf_dir))
    size = lambda c: F.size(c).cast("int").alias(f"n_{c}")
    return out.select(
        *CELL, "final_value", "format_is_valid", "within_absolute_limits", "operational_severity", "is_statistical_anomaly", "has_blank_mismatch", "ocr_uncertain", "blocks_export", "needs_review",
        F.array_join("review_categories", ",").alias("categories"), *[size(c) for c in ("blocking_errors", "required_confirmation_reasons", "operational_warnings", "informational_notices", "verification_reasons")])


@query
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.category_counts(verify.verify(P.cell_results(spark, sf_dir)))


@query
def table_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["All", "Unresolved", "Blocking", "Confirmations", "Warnings", "Notices", "Blank mismatches", "Detailed"]
    out = verify.verify(P.cell_results(spark, sf_dir))
    counts = out.agg(*[F.count_if(verify.table_filter(n)).alias(n) for n in names])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"`{n}`") for n in names]))).alias("filter", "n"))


@query
def row_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pairing.monitoring_rows(verify.verify(P.cell_results(spark, sf_dir)))
    return out.select("sheet_id", "day", "point", "temperature_final_value", "humidity_final_value", "row_status", "has_operational_warning", F.array_join("review_categories", ",").alias("categories"))


@query
def display_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verify.verify(P.cell_results(spark, sf_dir))
    return out.groupBy("reading_type", verify.display_status(out).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query
def readiness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days.readiness(verify.verify(P.cell_results(spark, sf_dir)), P.confirmations(spark, sf_dir))


@query
def day_confirmable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days.confirmable(verify.verify(P.cell_results(spark, sf_dir).withColumn("human_verified", F.lit(True))))


@query
def next_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = P.confirmations(spark, sf_dir)
    return days.next_day(done, done)


@query
def apply_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = patches.patched(P.cell_results(spark, sf_dir), P.patch_rows(spark, sf_dir))
    return out.select(*CELL, "final_value", "is_blank", "human_verified", "postprocessing_status", "touched")


@query
def patch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, errors, _ = patches.apply_patches(P.cell_results(spark, sf_dir), P.patch_rows(spark, sf_dir))
    return errors


@query
def invalidated_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = patches.patched(P.cell_results(spark, sf_dir), P.patch_rows(spark, sf_dir))
    return days.without(P.confirmations(spark, sf_dir), out.filter("touched"))


@query
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quality_metrics(P.judged(spark, sf_dir), "source")


@query
def quality_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.grouped_metrics(P.judged(spark, sf_dir), ["source", "lang"])


@query
def blank_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.judged(spark, sf_dir).select(F.col("lang").alias("mode"), "filename", "expected_blank", F.col("predicted_blank").alias("blank_before"), (F.col("predicted_blank") & F.col("final_value_correct")).alias("blank_after"))
    out = metrics.blank_confusion(rows)
    return out.withColumns({c: F.array_join(c, ",") for c in ("false_blanks", "missed_blanks")})


@query
def ab_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, _ = P.methods(spark, sf_dir)
    return metrics.compare(a, b).groupBy("outcome", "disposition").agg(F.count(F.lit(1)).alias("n"), F.count_if("value_changed").alias("changed"))


@query
def hybrid_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hybrid(*P.methods(spark, sf_dir))


@query
def hybrid_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hybrid_counters(metrics.hybrid(*P.methods(spark, sf_dir)))


@query
def release_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.quality_metrics(P.judged(spark, sf_dir), "lang")
    conditions = {"accurate": "final_accuracy >= 0.5", "safe": "unsafe_automatic_acceptances <= 60", "reviews": "review_rate < 0.3", "blanks": "blank_recall > 0.05"}
    return metrics.gates(out, conditions).select("lang", *conditions, "passed")


@query
def label_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = F.col("source").alias("sheet_id")
    name = F.col("doc_id").cast("string").alias("filename")
    d, lab, bench = (P.table(spark, sf_dir, n) for n in ("documents", "labels", "benchmark"))
    docs = d.select("doc_id", sheet, name)
    own = docs.join(lab, "doc_id").select("sheet_id", "filename", F.when(F.col("quality") == 1, "22.0").alias("expected_value"), (F.col("toxic") == 1).alias("expected_blank"))
    trusted = docs.join(bench.select(F.col("item_id").alias("doc_id")), "doc_id").select("sheet_id", "filename", F.lit("30.5").alias("expected_value"), F.lit(False).alias("expected_blank"))
    return metrics.label_template(docs.select("sheet_id", "filename"), own, trusted)


@query
def label_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("__", "sheet_id", "filename").alias("filename")
    rows = P.spelled(spark, sf_dir)
    labels = rows.select(name, "reading_type", F.col("text").alias("expected_value"), (F.col("mark") % 11 == 0).alias("expected_blank"))
    sheets = rows.select("sheet_id").distinct()
    return metrics.label_errors(labels, sheets.crossJoin(F.broadcast(pairing.grid(spark).select("filename"))).select(name))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.table(spark, sf_dir, "events")
    return t.select("user_id", "event_id", F.round("value", 2).alias("value"))


@query
def percentile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.percentiles(_series(spark, sf_dir), ["user_id"], "value")


@query
def spacing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.spacing(_series(spark, sf_dir), ["user_id"], "event_id")


@query
def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.drift(_series(spark, sf_dir), ["user_id"], "event_id", "value")


@query
def boundary_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.table(spark, sf_dir, "events")
    rows = t.select(
        (F.col("user_id") % 50).cast("string").alias("sheet_id"), "event_type", F.col("event_id").alias("index"), F.lit(50.0).alias("expected_position"),
        F.when(F.col("event_id") % 7 != 0, F.round("value", 2)).alias("detected_position"), F.lit(37.0).alias("spacing"), (F.col("event_id") % 8 / 8).alias("continuity")).withColumnRenamed("event_type", "axis")
    out = series.boundary_summary(rows)
    return out.withColumn("score", series.alignment_score(F.col("detected") / F.col("boundaries"), F.col("continuity"), F.col("normalised_p50"), F.lit(0.1)))


@query
def nearest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _series(spark, sf_dir)
    targets = rows.filter("event_id % 10 = 3").select("user_id", F.col("event_id").alias("target"))
    return series.nearest(targets, rows.filter("event_id % 10 <> 3"), ["user_id"], "target", "event_id", "value")


@query
def interpolate_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _series(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return series.interpolate(rows, ["user_id"], "event_id", "value").select("user_id", "event_id", F.round("filled", 6).alias("filled"))


@query
def isolated_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.isolated_peaks(_series(spark, sf_dir), ["user_id"], "event_id", "value", F.lit(400.0))
    return out.select("user_id", "event_id", "is_peak")


@query
def curve_bends(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.bends(_series(spark, sf_dir), ["user_id"], "event_id", "value", F.lit(400.0))
    return out.select("user_id", F.round("bend", 6).alias("bend"), "too_curved")


@query
def mapping_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.mapping_audit(pairing.monitoring_rows(verify.verify(P.cell_results(spark, sf_dir))))


@query
def stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in reports.STAGES])
    rows = P.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sheet_id"), F.element_at(names, (F.col("event_id") % 12 + 1).cast("int")).alias("stage"), F.round("value", 2).cast("decimal(18,2)").alias("seconds"))
    out = reports.stage_totals(rows.withColumn("seconds", F.col("seconds").cast("double")))
    return out.select("sheet_id", *[F.round(c, 4).alias(c) for c in (*reports.STAGES, "total_sheet_processing_seconds")])


@query
def drift_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    drifts = series.drift(_series(spark, sf_dir), ["user_id"], "event_id", "value")
    return series.drift_distribution(drifts.withColumn("sheet_id", F.col("user_id") % 50), "sheet_id")


@query
def correction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = reading_correct(spark, sf_dir).select(
        k.cast("string").alias("filename"), F.when(k % 2 == 0, "temperature").otherwise("humidity").alias("reading_type"), F.col("text").alias("consensus_prediction"),
        F.concat((k % 70).cast("string"), F.lit("."), (k % 10).cast("string")).alias("expected_value"))
    return reports.correction_summary(rows, "reading_type")


@query
def production_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.production_summary(P.judged(spark, sf_dir), "source")


def _modes(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Summaries by source of three methods over the same rows."""
    rows = P.judged(spark, sf_dir)
    out = []
    for right, failed in (("final_value_correct", "crop_alignment_failure"), ("postprocessing_correct", "crop_alignment_failure AND needs_review"), ("consensus_correct", "crop_alignment_failure AND NOT needs_review")):
        own = rows.withColumns({"final_value_correct": F.col(right), "crop_alignment_failure": F.expr(failed), "unsafe_automatic_acceptance": ~F.col("needs_review") & ~F.col(right), "correct_automatic_acceptance": ~F.col("needs_review") & F.col(right)})
        out.append(metrics.grouped_metrics(own, ["source"]))
    return out


_SHEETS = ("src0", "src1", "src2")


@query
def calibrated_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed, calibrated, _ = _modes(spark, sf_dir)
    return reports.calibrated_gates(fixed, calibrated, _SHEETS)


@query
def hybrid_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hybrid_gates(*_modes(spark, sf_dir), _SHEETS)


@query
def variant_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.cell_results(spark, sf_dir).withColumn("variants", F.when(F.col("is_blank"), F.slice("variants", 1, 0)).otherwise(F.col("variants")))
    return metrics.variant_rates(rows.withColumn("expected_value", F.get("variants", F.lit(2))["text"]), "sheet_id", "reading_type")


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as they were cut: some rejected, some with fixed bounds."""
    m = F.col("mark")
    return P.spelled(spark, sf_dir).withColumns({"geometry_rejection_reason": F.when(m % 7 == 0, F.concat(F.lit("reason "), (m % 3).cast("string"))), "uses_fallback_geometry": m % 5 == 0})


@query
def geometry_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cut(spark, sf_dir)
    identities = cells.select("sheet_id").distinct().crossJoin(F.broadcast(pairing.grid(spark).select("filename")))
    return reports.geometry_warnings(identities, cells).groupBy("sheet_id", "geometry_warning").agg(F.count(F.lit(1)).alias("n"))


@query
def preflight_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    facts = _cut(spark, sf_dir).groupBy("sheet_id").agg(
        (n % 3 != 0).alias("row_sequence_used"), (n % 33).alias("strong_bounds"), F.when(n % 2 == 0, "too few lines").alias("row_sequence_reason"), n.alias("fixed_cells"), n.alias("calibrated_cells"),
        F.count_if(F.col("mark") % 97 == 0).alias("invalid_cells"), F.count_if(F.col("mark") % 89 == 0).alias("fallback_boundaries"), F.count_if(F.col("mark") % 83 == 0).alias("low_confidence_boundaries"))
    return reports.preflight(facts).select("sheet_id", "recommended", F.array_join("warnings", "|").alias("warnings"), F.array_join("notices", "|").alias("notices"))


@query
def representative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sheets that have all six cells."""
    cells = P.readings(spark, sf_dir)
    six = cells.filter("day IN (1, 16, 31) AND point = 4").groupBy("sheet_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 6").select("sheet_id")
    whole = cells.join(six, "sheet_id", "left_semi")
    return reports.representative_pairs(whole, whole.withColumn("value", -F.col("value")), "value")


@query
def structure_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.structure_violations(P.readings(spark, sf_dir))


@query
def review_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["All unresolved", "Blocking errors", "Required confirmations", "OCR uncertainty", "Anomalies", "Blank mismatch"]
    out = verify.verify(P.cell_results(spark, sf_dir)).filter("blocks_export")
    counts = out.agg(*[F.count_if(verify.table_filter(n)).alias(n) for n in names])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"`{n}`") for n in names]))).alias("filter", "n"))


@query
def editor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rows that have both cells."""
    cells = P.cell_results(spark, sf_dir)
    rows = pairing.monitoring_rows(verify.verify(cells)).filter("temperature_filename IS NOT NULL AND humidity_filename IS NOT NULL")
    crops = cells.select("sheet_id", "filename", F.concat(F.lit("crop of "), "filename").alias("crop"))
    out = reports.editor_frame(reports.attach_crops(rows, crops)).drop("Reason")
    return out.toDF(*[c.lower().replace(" ", "_") for c in out.columns])


@query
def diagnostic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.diagnostic_rows(verify.verify(P.cell_results(spark, sf_dir)))
    return out.select("sheet_id", "filename", "is_blank", "raw_predictions_json", "normalized_predictions_json", "confidences_json", "agreement_count", "proposed_final_value", "candidate_interpretations_json", "review_categories_json", "human_verified", "needs_review")


@query
def verification_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    verified, done = verify.verify(P.cell_results(spark, sf_dir)), P.confirmations(spark, sf_dir)
    return reports.verification_audit(verified, done, days.readiness(verified, done), "fixed")


@query
def export_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a sheet's days by their number of events; some sheets are whole, some rows blocked."""
    form = pairing.grid(spark).select("day", "point").distinct()
    users = P.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 200).cast("string").alias("sheet_id")).agg(F.count(F.lit(1)).alias("k"))
    rows = users.crossJoin(F.broadcast(form)).filter("k % 5 <> 0 OR day * 8 + point <> 100")
    twice = rows.filter("k % 7 = 0 AND day = 3 AND point = 2")
    off = rows.filter("k % 11 = 0 AND day = 4 AND point = 1").withColumn("day", F.lit(40))
    moved = rows.filter("NOT (k % 11 = 0 AND day = 4 AND point = 1) AND NOT (k % 7 = 0 AND day = 9 AND point = 9 - 1)")
    every = moved.unionByName(twice).unionByName(off)
    state = F.when((F.col("k") % 13 == 0) & (F.col("day") == 5), F.lit(None).cast("boolean")).otherwise((F.col("k") % 3 == 0) & (F.col("day") == 6))
    return reports.export_violations(every.withColumn("blocks_export", state))


@query
def boundary_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves sampled at four places, asked between them."""
    k = F.col("p_partkey")
    xs, ys = F.array(*[F.lit(float(x)) for x in (0, 10, 20, 40)]), F.array(*[(k % m).cast("double") for m in (7, 11, 13, 17)])
    at = ((k % 60) - 10).cast("double")
    source = F.element_at(F.array(F.lit("detected"), F.lit("fixed_fallback"), F.lit("neighbours"), F.lit("mean")), (k % 4 + 1).cast("int"))
    return P.table(spark, sf_dir, "part").select("p_partkey", F.round(reports.position_at(xs, ys, at), 6).alias("position"), reports.boundary_source(source).alias("source"), F.round(reports.balanced_difference((k % 5).cast("double"), (k % 3).cast("double")), 6).alias("difference"))


@query
def queue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' event types as sheets: a job has a result for each event, and those of errors break."""
    t = P.table(spark, sf_dir, "events")
    own = t.select(F.col("user_id").cast("string").alias("owner_id"), F.col("event_type").alias("sheet_id"), "event_id")

    def work(jobs: DataFrame) -> DataFrame:
        rows = own.join(jobs.select("job_id", "owner_id", "sheet_id"), ["owner_id", "sheet_id"])
        broken = F.col("sheet_id") == "error"
        return rows.filter(~broken).select("job_id", "event_id", F.lit(None).cast("string").alias("error")).unionByName(
            jobs.filter(broken).select("job_id", F.lit(None).cast("bigint").alias("event_id"), F.lit("broken").alias("error")))

    queue = jobs.JobQueue(spark, P.folder(spark, "queue"), work)
    queue.submit_all(own.select("owner_id", "sheet_id"))
    queue.run()
    return queue.snapshots().select("owner_id", "sheet_id", "state", F.when(F.col("state") == "failed", 0).otherwise(F.col("processed_count")).alias("processed_count"))


class _ByInk:
    """Reads the share of ink as a number; images with little contrast as one without a dot."""

    def predict(self, images):
        share = [float((i < 128).mean()) for i in images]
        return [(f"{10 + 80 * s:.1f}" if s > 0.1 else f"{int(1000 * s) + 100}", 0.8 + s / 5) for s in share]


def by_ink() -> _ByInk:
    return _ByInk()


@query
def recognizer_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as cell images, in which a page's length is the ink; read by a stand-in for a recogniser."""
    k, n = F.col("page_id"), F.octet_length("html")
    h, w = 20, 40
    place = F.struct((k % 31 + 1).cast("int").alias("day"), (k % 8 + 1).cast("int").alias("point"))
    kind = F.when(k % 2 == 0, "temperature").otherwise("humidity")
    line = F.concat(F.lit("F" * 2 * 4), F.repeat(F.lit("00"), (n % 24).cast("int")), F.repeat(F.lit("FF"), (32 - n % 24).cast("int")), F.lit("F" * 2 * 4))
    image = F.struct(F.lit(h).alias("height"), F.lit(w).alias("width"), F.lit(1).alias("channels"), F.unhex(F.concat(F.repeat(F.lit("F" * 2 * w), 4), F.repeat(line, 12), F.repeat(F.lit("F" * 2 * w), 4))).alias("data"))
    pages = P.table(spark, sf_dir, "pages").select(k.cast("string").alias("sheet_id"), place.alias("p"), kind.alias("reading_type"), image.alias("image"))
    cells = pages.select("sheet_id", filename(F.col("p.day"), F.col("p.point"), F.col("reading_type")).alias("filename"), "p.day", "p.point", "reading_type", "image")
    out = recognition.process(cells, by_ink, "adaptive")
    return out.select("sheet_id", "filename", "is_blank", F.size("variants").alias("variants"), "consensus_prediction", "final_value", "postprocessing_status", "blocks_export")


@query
def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.readings(spark, sf_dir).filter("sheet_id = '1995-03'")
    out, _, _ = pairing.page(cells, ["day", "point", pairing.kind_order(F.col("reading_type"))], 3, 40)
    return out.select(*CELL, "value")


@query
def context_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.context_view(P.readings(spark, sf_dir), "1995-03", 10, 4, "humidity").select(*CELL, "value")
