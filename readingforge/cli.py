"""Entries for spark-submit: python -m readingforge.cli COMMAND ..."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import benchmark, consensus, days, metrics, pairing, recognition, reports, series, sheets
from .functions import readings as R
from .sources import images, tables, workbook

def loaded(spark: SparkSession, path: str):
    """The pages of a folder of uploads as sheets (sheet_id, image); uploads that can't be read are an error."""
    pages = images.decoded_pages(spark, path)
    pairing.guard(pages.filter("error IS NOT NULL").select("source_filename", "error"), "uploads that can't be read")
    return images.sheet_ids(pages).select("sheet_id", "image")


def factory(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readingforge")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [sub.choices[name].add_argument(a) for a in args] if sub.add_parser(name) else None
    add("process", "images", "recogniser", "output")
    sub.choices["process"].add_argument("--geometry", default="fixed", choices=["fixed", "calibrated"])
    sub.choices["process"].add_argument("--strategy", default="consensus", choices=["consensus", "adaptive"])
    add("align", "images", "output")
    add("readiness", "results", "confirmations", "output")
    add("evaluate", "labels", "results", "output")
    add("export", "results", "template", "month", "output")
    add("preflight", "images", "output")
    add("telemetry", "images", "output")
    add("diagnose", "images", "output")
    add("corrections", "predictions", "output")
    add("variants", "labels", "crops", "recogniser", "output")
    add("audit", "results", "confirmations", "output")
    add("benchmark", "labels", "fixed", "calibrated", "drift", "recogniser", "output")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"readingforge {a.command}").getOrCreate()
    if a.command == "process":
        cells = sheets.cells(sheets.oriented(loaded(spark, a.images)), a.geometry)
        out = recognition.process(cells, factory(a.recogniser), a.strategy)
        out.write.mode("overwrite").parquet(a.output)
        rows = reports.diagnostic_rows(spark.read.parquet(a.output))
        tables.write_csv(rows, f"{a.output}.csv", rows.columns, "overwrite")
    elif a.command == "align":
        report = series.boundary_summary(sheets.boundaries(loaded(spark, a.images)))
        tables.write_json(report, a.output, "overwrite")
    elif a.command == "readiness":
        tables.write_json(days.readiness(spark.read.parquet(a.results), spark.read.parquet(a.confirmations)), a.output, "overwrite")
    elif a.command == "evaluate":
        labels, results = tables.read_labels(spark, a.labels), spark.read.parquet(a.results)
        pairing.guard(metrics.unmatched(labels, results), "labels and results differ")
        tables.write_json(metrics.grouped_metrics(metrics.evaluate(labels, results), ["sheet_id", "reading_type"]), a.output, "overwrite")
    elif a.command == "export":
        audit = pairing.mapping_audit(reports.exportable(pairing.monitoring_rows(spark.read.parquet(a.results))))
        with open(a.template, "rb") as f:
            data = workbook.export(f.read(), audit, a.month)
        with open(a.output, "wb") as f:
            f.write(data)
    elif a.command == "preflight":
        tables.write_json(reports.preflight(sheets.preflight_facts(loaded(spark, a.images))), a.output, "overwrite")
    elif a.command == "telemetry":
        tables.write_json(sheets.manifest(sheets.telemetry(loaded(spark, a.images))), a.output, "overwrite")
    elif a.command == "diagnose":
        own = loaded(spark, a.images)
        images.save_pngs(sheets.pictures(own), a.output)
        tables.write_json(series.boundary_summary(sheets.boundaries(own)), f"{a.output}/alignment.json", "overwrite")
    elif a.command == "corrections":
        rows = tables.read_csv(spark, a.predictions, ["filename", "expected_value", "consensus_prediction"]).withColumn("reading_type", R.kind_of(F.col("filename")))
        tables.write_json(reports.correction_summary(rows), a.output, "overwrite")
    elif a.command == "variants":
        labels = tables.read_labels(spark, a.labels)
        rows = benchmark.variant_benchmark(images.label_cells(spark, labels, a.crops), labels, factory(a.recogniser))
        tables.write_json(consensus.variant_accuracy(rows), a.output, "overwrite")
    elif a.command == "audit":
        results, done = spark.read.parquet(a.results), spark.read.parquet(a.confirmations)
        tables.write_json(reports.verification_audit(results, done, days.readiness(results, done), "fixed"), a.output, "overwrite")
    elif a.command == "benchmark":
        labels = tables.read_labels(spark, a.labels)
        cells = {m: images.label_cells(spark, labels, getattr(a, m)) for m in ("fixed", "calibrated")}
        drift = spark.read.json(a.drift, schema="sheet_id string, drift double")
        benchmark.write_bundle(benchmark.run(labels, cells, drift, factory(a.recogniser)), a.output, "overwrite")
    return 0


if __name__ == "__main__":
    sys.exit(main())
