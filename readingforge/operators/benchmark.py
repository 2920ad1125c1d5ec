"""Two geometries over the same labelled cells: predictions first, truth joined only afterwards.

Every mode is run in both orders after a warm-up; runs of a mode must agree, and their times are
averaged."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables
from . import metrics, recognition, reports
from .pairing import Violation, guard

ORDERS = (("fixed", "calibrated"), ("calibrated", "fixed"))
HYBRID_GATES = {"accurate": "final_correct >= 14", "blank_precision_kept": "blank_precision = 1.0", "blank_recall_better": "blank_recall > 7.0 / 16"}


def signature(results: DataFrame) -> tuple[int, int]:
    """The number of results and a sum of hashes that doesn't depend on their order."""
    columns = ["sheet_id", "filename", "final_value", "is_blank", "needs_review", "agreement_count"]
    h = F.sum(F.xxhash64(*columns).cast("decimal(20,0)"))
    r = results.agg(F.count(F.lit(1)).alias("n"), h.alias("h")).first()
    return r.n, int(r.h or 0)


def predict(cells: dict[str, DataFrame], factory: Callable[[], recognition.Recogniser], strategy: str = "consensus") -> tuple[dict[str, DataFrame], DataFrame]:
    """Results of both modes and the trials' times (geometry_mode, ocr_input_count, seconds)."""
    spark = cells["fixed"].sparkSession
    recognition.process(cells["fixed"].limit(1), factory, strategy).count()  # warm-up, not timed
    results: dict[str, DataFrame] = {}
    seen: dict[str, tuple[int, int]] = {}
    trials = []
    for order in ORDERS:
        for mode in order:
            start = time.perf_counter()
            out = recognition.process(cells[mode], factory, strategy).persist()
            inputs = out.agg(F.sum(F.size("variants"))).first()[0] or 0
            trials.append((mode, int(inputs), time.perf_counter() - start))
            own = signature(out)
            if seen.setdefault(mode, own) != own:
                raise Violation(f"two runs of {mode} differ")
            if mode in results:
                out.unpersist()
            else:
                results[mode] = out
    return results, spark.createDataFrame(trials, "geometry_mode string, ocr_input_count int, processing_time_seconds double")


def run(labels: DataFrame, cells: dict[str, DataFrame], drift: DataFrame, factory: Callable[[], recognition.Recogniser], strategy: str = "consensus") -> dict[str, DataFrame]:
    """rows of both modes, hybrid rows, summary by mode, comparison, times."""
    for mode in ("fixed", "calibrated"):
        guard(metrics.unmatched(labels, cells[mode]), f"labels and {mode} cells differ")
    results, trials = predict(cells, factory, strategy)
    rows = {m: metrics.evaluate(labels, r) for m, r in results.items()}
    hybrid = metrics.hybrid(rows["fixed"], rows["calibrated"], drift)
    chosen = hybrid_rows(hybrid, rows)
    every = rows["fixed"].withColumn("geometry_mode", F.lit("fixed")).unionByName(rows["calibrated"].withColumn("geometry_mode", F.lit("calibrated"))).unionByName(chosen.withColumn("geometry_mode", F.lit("hybrid")))
    times = trials.withColumn("ocr_time_seconds", F.col("processing_time_seconds"))
    return {
        "rows": every, "hybrid": hybrid, "summary": metrics.quality_metrics(every, "geometry_mode"), "variants": metrics.variant_rates(every, "geometry_mode"), "comparison": metrics.compare(rows["fixed"], rows["calibrated"]),
        "times": metrics.timing(times), "blanks": blank_rows(every)}


def hybrid_rows(hybrid: DataFrame, rows: dict[str, DataFrame], key: str = "filename") -> DataFrame:
    """The evaluated rows of the method that was chosen for each, with what the hybrid policy decides:
    a confirmation asks for a review and takes the acceptance away."""
    out = None
    for mode, df in rows.items():
        own = hybrid.filter(F.col("selected_geometry") == mode).select(key, F.col("blocks_export").alias("_blocks"), F.col("automatic_acceptance").alias("_automatic"), F.col("needs_confirmation").alias("_ask"))
        part = df.join(own, key).withColumns({
            "blocks_export": F.col("_blocks"), "needs_review": F.col("needs_review") | F.col("_ask"), "automatic_acceptance": F.col("_automatic"),
            "correct_automatic_acceptance": F.col("_automatic") & F.col("final_value_correct"), "unsafe_automatic_acceptance": F.col("_automatic") & ~F.col("final_value_correct")}).drop("_blocks", "_automatic", "_ask")
        out = part if out is None else out.unionByName(part)
    return out


def blank_rows(rows: DataFrame) -> DataFrame:
    """Blanks by ink alone and after everything, for `metrics.blank_confusion`: mode, filename,
    expected_blank, blank_before, blank_after."""
    before = F.col("is_blank") & (F.col("postprocessing_status") != "likely_blank")
    return rows.select(F.col("geometry_mode").alias("mode"), "filename", "expected_blank", before.alias("blank_before"), F.col("is_blank").alias("blank_after"))


def gates(rows: DataFrame, sheets: tuple[str, str, str]) -> dict[str, DataFrame]:
    """The checks of both methods that may replace the fixed one; `sheets` are the sample and the two months."""
    by_mode = {m: metrics.grouped_metrics(rows.filter(F.col("geometry_mode") == m), ["sheet_id"]) for m in ("fixed", "calibrated", "hybrid")}
    return {"calibrated": reports.calibrated_gates(by_mode["fixed"], by_mode["calibrated"], sheets), "hybrid": reports.hybrid_gates(by_mode["fixed"], by_mode["calibrated"], by_mode["hybrid"], sheets)}


ROW_COLUMNS = ["geometry_mode", "item_number", "sheet_id", "filename", "day", "point", "reading_type", "expected_value", "expected_blank", "consensus_prediction", "final_value", "is_blank", "needs_review", "blocks_export", "postprocessing_status", *metrics.FLAGS]


def write_bundle(out: dict[str, DataFrame], folder: str, mode: str = "error") -> None:
    """The results of `run` as files: rows, comparison and hybrid decisions as CSV, summaries and times as JSON."""
    columns = list(dict.fromkeys(c for c in ROW_COLUMNS if c in out["rows"].columns))
    tables.write_csv(out["rows"].orderBy("geometry_mode", "item_number"), f"{folder}/rows.csv", columns, mode)
    for name in ("comparison", "hybrid"):
        tables.write_csv(out[name], f"{folder}/{name}.csv", out[name].columns, mode)
    for name in ("summary", "variants", "times"):
        tables.write_json(out[name], f"{folder}/{name}.json", mode)


def variant_benchmark(cells: DataFrame, labels: DataFrame, factory: Callable[[], recognition.Recogniser], variants: tuple[str, ...] = ("original", "grayscale", "contrast", "binary")) -> DataFrame:
    """Every variant of every labelled cell, read and compared: filename, variant, text, confidence, expected,
    right, decimal_error.  `consensus.variant_accuracy` sums it up."""
    from ..functions import readings as R

    read = recognition.recognise(cells, factory, variants).withColumn("text", R.normalise(R.clean(F.col("raw_text"))))
    rows = read.join(labels.filter("NOT expected_blank").select("filename", F.col("expected_value").alias("expected")), "filename")
    return rows.select("filename", "variant", "text", "confidence", "expected", (F.col("text") == F.col("expected")).alias("right"), R.decimal_only_error(F.col("text"), F.col("expected")).alias("decimal_error"))
