"""What the registered queries don't reach: errors, guards, state, and the shape of plans."""

import json
import os

import pytest
from pyspark.sql import functions as F

from readingforge.functions import readings as R
from readingforge.operators import days, pairing, reports, series, verify
from readingforge.plans import queries

from .fixtures import cells, day


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_unknown_stages_and_sample_places_are_errors(spark):
    rows = spark.createDataFrame([("s", "verification_seconds", 1.5), ("s", "verification_seconds", 0.25), ("s", "ocr_prediction_seconds", 2.0)], "sheet_id string, stage string, seconds double")
    got = reports.stage_totals(rows).first()
    assert (got.verification_seconds, got.ocr_prediction_seconds, got.upload_decoding_seconds, got.total_sheet_processing_seconds) == (1.75, 2.0, 0.0, 3.75)
    with pytest.raises(Exception, match="unknown stage: lunch"):
        reports.stage_totals(rows.unionByName(spark.createDataFrame([("s", "lunch", 1.0)], rows.schema))).collect()
    assert [one(spark, R.day_group(F.lit(d))) for d in (1, 16, 31)] == ["first", "middle", "last"] and [one(spark, R.point_group(F.lit(p))) for p in (1, 4, 8)] == ["left", "center", "right"]
    for bad in (R.day_group(F.lit(2)), R.point_group(F.lit(5))):
        with pytest.raises(Exception, match="of the sample"):
            one(spark, bad)


def test_readings_for_the_form(spark):
    place = (F.lit(3), F.lit(2))
    assert one(spark, pairing.validated_reading(F.lit("22.5"), F.lit("temperature"), *place)) == 22.5 and one(spark, pairing.validated_reading(F.lit(""), F.lit("humidity"), *place)) is None
    with pytest.raises(Exception, match="Day 3, Point 2, Temperature"):
        one(spark, pairing.validated_reading(F.lit("225"), F.lit("temperature"), *place))


def test_queue_neighbours_by_owner(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "owner string, k int, sheet string")
    assert {(r.sheet, r.previous, r.next) for r in pairing.neighbours_in_queue(rows, "k", "sheet", "owner").collect()} == {("x", "x", "y"), ("y", "x", "y"), ("z", "z", "z")}
    assert [r.item_number for r in pairing.item_order(spark.createDataFrame([(2,), (1,)], "item_number int")).collect()] == [1, 2]


def test_repairs_of_gaps(spark):
    rows = [("s", "h", k, p, 10.0 * k, c) for k, (p, c) in enumerate([(0.0, 0.9), (11.0, 0.9), (14.0, 0.5), (30.0, 0.9), (58.0, 0.7)])]
    df = spark.createDataFrame(rows, "sheet_id string, axis string, index int, position double, expected double, confidence double")
    got = sorted((r["index"], r.position, r.confidence) for r in series.monotonic(df, 5.0, 15.0).collect())
    assert got == [(0, 0.0, 0.9), (1, 11.0, 0.9), (2, 20.0, 0.0), (3, 30.0, 0.9), (4, 40.0, 0.0)]


def test_state_and_payloads(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, reports.overlay(base, spark.createDataFrame([("b", 3), ("c", 4)], base.schema), ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert reports.state_for_sheet(base.withColumnRenamed("k", "sheet_id"), "z").count() == 0
    texts = ['{"rec_text": "22.0", "rec_score": 0.5}', '{"res": {"rec_text": "1.0", "rec_score": 0.25}}', "{}", "no json"]
    assert [tuple(one(spark, reports.payload(F.lit(t)))) for t in texts] == [("22.0", 0.5), ("1.0", 0.25), ("", 0.0), ("", 0.0)]
    assert tuple(one(spark, reports.grid_index(F.lit(31), F.lit(8), F.lit("humidity")))) == (30, 15)


def test_lost_crops_are_errors(spark):
    verified = verify.verify(cells(spark, day(1)))
    rows = pairing.monitoring_rows(verified)
    crops = verified.select("sheet_id", "filename", F.lit("c").alias("crop"))
    assert reports.editor_frame(reports.attach_crops(rows, crops)).count() == 8
    with pytest.raises(Exception, match="no crop of day_01_point_03_humidity.png"):
        reports.attach_crops(rows, crops.filter("filename <> 'day_01_point_03_humidity.png'")).collect()
    with pytest.raises(Exception, match="no crop of s"):
        reports.representative_pairs(crops, crops, "crop").collect()


def test_whole_sheets_are_exportable(spark):
    whole = pairing.monitoring_rows(verify.verify(cells(spark, [c for d in range(1, 32) for c in day(d)])))
    assert reports.export_violations(whole).count() == 0 and reports.exportable(whole) is whole
    assert reports.structure_violations(verify.verify(cells(spark, [c for d in range(1, 32) for c in day(d)]))).count() == 0
    with pytest.raises(pairing.Violation, match="247 rows"):
        reports.exportable(whole.filter("NOT (day = 31 AND point = 8)"))


def test_audits_are_json(spark):
    verified = verify.verify(cells(spark, day(1) + day(2, t1={"value": "99.0"})))
    done = spark.createDataFrame([("s", 1), ("s", 40)], "sheet_id string, day int")
    audit = json.loads(reports.verification_audit(verified, done, days.readiness(verified, done), "hybrid").first().audit)
    assert audit["confirmed_days"] == [1] and len(audit["unconfirmed_days"]) == 30 and audit["blocking_cell_count"] == 1 and not audit["export_ready"] and audit["geometry_mode"] == "hybrid"
    row = reports.diagnostic_rows(verified).first().asDict()
    assert len(row) == 38 and json.loads(row["raw_predictions_json"]).keys() == {"original", "grayscale", "contrast"} and row["blocking_errors_json"] == "[]"


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_plans_scan_and_shuffle_once(spark):
    def plan(name):
        text = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        return text.count("Exchange hash"), text.count("FileScan parquet")

    assert plan("verify_cells") == (2, 1)  # cells by sum, then one exchange by sheet
    exchanges, scans = plan("apply_patches")
    assert scans == 2 and exchanges <= 4
