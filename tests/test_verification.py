import pytest
from pyspark.sql import functions as F

from readingforge.operators import consensus, context, days, metrics, pairing, patches, series, verify
from readingforge.schema import PATCHES, benchmark_cells, grid

from .fixtures import cell, cells, day


def verified(spark, rows):
    return {(r.day, r.point, r.reading_type): r for r in verify.verify(cells(spark, rows)).collect()}


def one(spark, **kw):
    return next(iter(verified(spark, [cell(**kw)]).values()))


def test_grid(spark):
    assert grid(spark).count() == 496 and grid(spark).select("filename").distinct().count() == 496
    b = benchmark_cells(spark, ["x", "y", "z"]).collect()
    assert len(b) == 54 and b[0].filename == "x__day_01_point_01_temperature.png" and [r.item_number for r in b] == list(range(1, 55))


def test_low_confidence_asks_for_confirmation(spark):
    r = one(spark, confidence=0.5)
    assert r.needs_review and "ocr_uncertainty" in r.review_categories and not r.blocking_errors


def test_alarming_temperature_warns_only(spark):
    r = one(spark, value="30.0")
    assert r.operational_severity == "alarming" and r.operational_warnings and not r.blocks_export


def test_minor_disagreement_is_a_notice(spark):
    r = one(spark, kind="humidity", value="60.8", texts=["60.87", "60.8", "60.8"], agreement=2)
    assert r.informational_notices and not r.blocks_export and r.ocr_uncertain
    r = one(spark, kind="humidity", value="60.8", texts=["69.8", "60.8", "60.8"], agreement=2)
    assert r.required_confirmation_reasons == ["OCR variants disagree (2/3 agreement)."] and r.blocks_export


@pytest.mark.parametrize("value", ["22.", "51.0"])
def test_a_person_does_not_clear_errors(spark, value):
    assert one(spark, value=value, verified=True).blocks_export


def test_normalisation_is_reported(spark):
    r = one(spark, raw=["22,0", "22.0", "22.0"])
    assert r.required_confirmation_reasons == ["The original OCR text '22,0' required character normalization."]


def test_outlier_of_a_day(spark):
    got = verified(spark, [cell(1, p, value=v) for p, v in enumerate(["40.0", "22.0", "22.0", "22.0", "22.0"], 1)])
    assert got[1, 1, "temperature"].is_statistical_anomaly and sum(r.is_statistical_anomaly for r in got.values()) == 1
    few = verified(spark, [cell(1, p, value=v) for p, v in enumerate(["40.0", "22.0", "22.0", "22.0"], 1)])
    assert not any(r.is_statistical_anomaly for r in few.values())


def test_neighbourhood_is_same_day_or_point_within_two_days(spark):
    rows = [(f"{d}-{p}", "s", d, p, "humidity", float(100 * d + p)) for d in range(1, 8) for p in range(1, 9)]
    df = spark.createDataFrame(rows, "filename string, sheet_id string, day int, point int, reading_type string, value double")
    got = {r.filename: sorted(r.context) for r in context.neighbours(df).collect()}
    for f, _, d, p, _, _ in rows:
        assert got[f] == sorted(x[5] for x in rows if x[0] != f and (x[2] == d or (x[3] == p and abs(x[2] - d) <= 2)))


def test_blank_mismatch_blocks_both(spark):
    got = verified(spark, [cell(value="", blank=True), cell(kind="humidity", value="50.0")])
    assert all(r.has_blank_mismatch and r.blocks_export and "blank_mismatch" in r.review_categories for r in got.values())


def test_verification_is_idempotent(spark):
    rows = day(1, t1={"value": "022.0"}, h2={"value": "5x"}, t3={"value": "", "blank": True})
    first = verify.verify(cells(spark, rows))
    again = verify.verify(first.select(cells(spark, rows).columns))
    assert sorted(map(str, first.collect())) == sorted(map(str, again.select(first.columns).collect()))


def test_likely_blank(spark):
    base = cell(value="1", texts=["1", "1", ""], raw=["1", "I", ""])
    faint = lambda **kw: cells(spark, [base]).withColumns({"blank_ink_ratio": F.lit(kw.get("ink", 0.006)), "blank_largest_width_ratio": F.lit(0.05)})
    r = verify.likely_blank(faint()).first()
    assert r.is_blank and r.final_value == "" and r.postprocessing_status == "likely_blank" and r.ocr_uncertainty_reasons
    assert not verify.likely_blank(faint(ink=0.04)).first().is_blank
    assert not verify.likely_blank(faint().withColumn("serious_geometry", F.lit(True))).first().is_blank
    seven = cells(spark, [cell(value="7", texts=["7", "1", ""])]).withColumn("blank_ink_ratio", F.lit(0.006))
    assert not verify.likely_blank(seven).first().is_blank


def test_vote(spark):
    rows = [(1, "a", "0.5", 0), (1, "b", "0.9", 1), (1, "a", "0.5", 2), (2, "x", "0.5", 1), (2, "y", "0.7", 0), (3, "p", "0.5", 1), (3, "q", "0.5", 0)]
    df = spark.createDataFrame(rows, "k int, text string, c string, ord int").withColumn("confidence", F.col("c").cast("decimal(6,4)"))
    got = {r.k: (r.consensus, r.agreement_count, r.ambiguous) for r in consensus.vote(df, ["k"]).collect()}
    assert got == {1: ("a", 2, False), 2: ("y", 1, True), 3: ("q", 1, True)}


def test_assemble(spark):
    rows = [("f", "temperature", n, k, t, 0.9) for k, (n, t) in enumerate([("original", "22,0"), ("grayscale", "22.O"), ("contrast", "23.0")])]
    r = consensus.assemble(spark.createDataFrame(rows, "filename string, reading_type string, variant string, ord int, raw_text string, confidence double"), ["filename"]).first()
    assert (r.consensus_prediction, r.agreement_count, r.final_value, r.postprocessing_status) == ("22.0", 2, "22.0", "valid_unchanged") and [v.text for v in r.variants] == ["22.0", "22.0", "23.0"]


# ---- patches and days


def patch(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], PATCHES)


def test_patches(spark):
    base = cells(spark, day(1, t4={"value": "", "blank": True}))
    name = lambda p, k="temperature": f"day_01_point_{p:02d}_{k}.png"
    rows = [
        (1, name(1), True, "23.0", None, True), (2, name(1, "humidity"), True, "50.", None, True), (3, name(2), False, None, True, True), (4, name(2, "humidity"), False, None, True, None),
        (5, "nope.png", True, "1.0", None, None), (6, name(4), False, None, False, True), (7, name(3), True, "30.0", None, None), (8, name(3), True, "31.5", False, True), (9, name(5), True, "22.0", None, None),
    ]
    out, errors, changed = patches.apply_patches(base, patch(spark, rows))
    got = {r.filename: r for r in out.collect()}
    assert (got[name(1)].final_value, got[name(1)].human_verified, got[name(1)].postprocessing_status) == ("23.0", True, "manually_corrected")
    assert got[name(1, "humidity")].final_value == "50.0" and not got[name(1, "humidity")].human_verified
    assert got[name(2)].is_blank and got[name(2)].final_value == "" and got[name(3)].final_value == "31.5" and got[name(4)].is_blank
    assert got[name(5)].postprocessing_status == "valid_unchanged"
    assert {(r.seq, r.filename) for r in errors.collect()} == {(2, name(1, "humidity")), (5, "nope.png"), (6, name(4))}
    assert {r.filename for r in changed.collect()} == {name(1), name(2), name(2, "humidity"), name(3)}
    again = {r.point: r for r in verify.verify(out).collect() if r.reading_type == "temperature"}
    assert not again[2].has_blank_mismatch and again[4].has_blank_mismatch


def test_quick_controls_exclude_each_other(spark):
    df = spark.createDataFrame([("s", 1, "a", "22.0", True, False), ("s", 2, "b", "", True, False), ("s", 3, "c", "", False, True), ("s", 4, "d", " ", False, False)], "sheet_id string, seq int, filename string, corrected_value string, confirm_current boolean, mark_blank boolean")
    out, errors = patches.from_quick_controls(df)
    assert {r.filename: (r.has_value, r.is_blank) for r in out.collect()} == {"b": (False, None), "c": (False, True)}
    assert [(r.filename, "Choose only one" in r.error) for r in errors.collect()] == [("a", True)]


def test_table_edits_and_actions(spark):
    base = cells(spark, day(1))
    df = spark.createDataFrame(
        [("s", 1, 1, 2, True, "23.5", False, None, False, None, True, True), ("s", 2, 9, 1, True, "1.0", False, None, False, None, False, None)],
        "sheet_id string, seq int, day int, point int, has_temperature boolean, temperature string, has_temperature_blank boolean, temperature_blank boolean, has_humidity boolean, humidity string, has_humidity_blank boolean, humidity_blank boolean")
    out, lost = patches.from_table_edits(df, base)
    assert {(r.filename, r.final_value, r.is_blank) for r in out.collect()} == {("day_01_point_02_temperature.png", "23.5", None), ("day_01_point_02_humidity.png", None, True)}
    assert [r.error for r in lost.collect()] == ["Day 9, Point 1, Temperature is not on the form."]
    acts = spark.createDataFrame([("s", 1, "a", "confirm", None), ("s", 2, "b", "correct", "1.0"), ("s", 3, "c", "blank", None), ("s", 4, "d", "pending", None), ("s", 5, "e", "what", None)], "sheet_id string, seq int, filename string, action string, corrected_value string")
    out, errors = patches.from_actions(acts)
    assert {r.filename for r in out.collect()} == {"a", "b", "c"} and [r.filename for r in errors.collect()] == ["e"]


def state(spark, *numbers):
    return spark.createDataFrame([("s", n) for n in numbers], "sheet_id string, day int")


def controls(spark, number, **changes):
    rows = [("s", c[2], c[1], changes.get(f"{c[4][0]}{c[3]}", c[9]), False) for c in day(number)]
    return spark.createDataFrame(rows, "sheet_id string, day int, filename string, value string, is_blank boolean")


def test_day_submission(spark):
    base = cells(spark, day(1) + day(2))
    out, left, errors = days.submit_day(base, state(spark, 2, 3), controls(spark, 1, t1="24.0"), confirm=True)
    assert {r.day for r in left.collect()} == {1, 2, 3} and errors.count() == 0
    assert {r.final_value for r in out.filter("filename = 'day_01_point_01_temperature.png'").collect()} == {"24.0"}
    _, left, errors = days.submit_day(base, state(spark, 1, 2), controls(spark, 1, t1="2x"), confirm=True)
    assert errors.count() == 1 and {r.day for r in left.collect()} == {2}
    _, left, _ = days.submit_day(base, state(spark, 1, 2), controls(spark, 1, t1="24.0"), confirm=False)
    assert {r.day for r in left.collect()} == {2}


def test_next_day_wraps(spark):
    nxt = lambda done, cur: days.next_day(state(spark, *done), state(spark, cur)).first().next
    assert nxt([1, 2, 3], 1) == 4 and nxt([30, 31], 31) == 1 and nxt(range(1, 32), 7) == 7


def test_readiness(spark):
    rows = [c for d in range(1, 32) for c in day(d)]
    out = verify.verify(cells(spark, rows))
    r = days.readiness(out, state(spark, *range(1, 31))).first()
    assert not r.ready and r.unconfirmed_days == 1
    assert days.readiness(out, state(spark, *range(1, 32))).first().ready
    wide = pairing.monitoring_rows(out)
    assert wide.count() == 248 and pairing.audit_violations(pairing.mapping_audit(wide)).count() == 0
    assert pairing.pair_violations(out).count() == 0 and pairing.missing_cells(out).count() == 0
    assert [r.point for r in pairing.one_day(out, "s", 3).collect()] == [p for p in range(1, 9) for _ in range(2)]
    with pytest.raises(pairing.Violation):
        pairing.one_day(out.filter("point < 8"), "s", 3)
    with pytest.raises(pairing.Violation):
        pairing.guard(out.limit(1).select("filename"), "found")


def test_page(spark):
    df = spark.createDataFrame([(f"cell_{k:02d}.png",) for k in range(16)], "filename string")
    out, number, selected = pairing.page(df, ["filename"], 9, 15, "gone.png")
    assert (out.count(), number, selected) == (1, 2, "cell_15.png")


# ---- metrics


def test_quality_metrics(spark):
    schema = "filename string, " + ", ".join(f"{f} boolean" for f in metrics.FLAGS)
    rows = [("a", True, True, True, False, False, False, True, False, False), ("b", False, False, False, False, False, False, False, True, False), ("c", True, True, True, True, True, True, False, False, False)]
    m = metrics.quality_metrics(spark.createDataFrame(rows, schema)).first()
    assert (m.unsafe_automatic_acceptances, m.correct_automatic_acceptances, m.review_count, m.false_review_count, m.review_precision, m.blank_precision, m.blank_recall) == (1, 1, 1, 1, 0.0, 1.0, 1.0)


def test_evaluate_and_compare(spark):
    labels = spark.createDataFrame([("a", 1, "22.0", False), ("b", 2, "", True)], "filename string, item_number int, expected_value string, expected_blank boolean")
    row = lambda f, v, blank, review: (f, v, v, blank, review, review, [("original", 0, v, v, 0.9)])
    schema = "filename string, final_value string, consensus_prediction string, is_blank boolean, needs_review boolean, blocks_export boolean, variants array<struct<variant:string,ord:int,raw_text:string,text:string,confidence:double>>"
    a = metrics.evaluate(labels, spark.createDataFrame([row("a", "23.0", False, True), row("b", "", True, False)], schema))
    b = metrics.evaluate(labels, spark.createDataFrame([row("a", "22.0", False, False), row("b", "", True, False)], schema))
    got = {r.filename: (r.outcome, r.disposition) for r in metrics.compare(a, b).collect()}
    assert got == {"a": ("improved", "review_to_automatic"), "b": ("both_correct", "automatic")}
    assert metrics.unmatched(labels, a).count() == 0 and metrics.unmatched(labels, a.limit(1)).count() == 1


def test_timing_gates_and_recommendation(spark):
    t = spark.createDataFrame([("x", 10, 2.0, 3.0), ("x", 10, 4.0, 5.0)], "geometry_mode string, ocr_input_count int, ocr_time_seconds double, processing_time_seconds double")
    r = metrics.timing(t).first()
    assert (r.same_inputs, r.ocr_time_seconds, r.processing_time_seconds) == (True, 3.0, 4.0)
    g = metrics.gates(spark.createDataFrame([(14, None)], "right int, p double"), {"a": "right >= 14", "b": "p = 1.0"}).first()
    assert (g.a, g.b, g.passed) == (True, False, False)
    pick = lambda *x: spark.range(1).select(metrics.recommend([F.lit(v) for v in x])).first()[0]
    assert pick(True, True, True, True) == "calibrated" and all(pick(*[k != j for k in range(4)]) == "fixed" for j in range(4))


def test_label_template(spark):
    ids = benchmark_cells(spark, ["sample", "other"]).select("sheet_id", "filename")
    none = spark.createDataFrame([], "sheet_id string, filename string, expected_value string, expected_blank boolean")
    one = spark.createDataFrame([("sample", "sample__day_01_point_01_temperature.png", "22.0", False)], none.schema)
    got = metrics.label_template(ids, none, one).groupBy("label_source").count().collect()
    assert {r[0]: r[1] for r in got} == {"missing": 35, "trusted": 1}


# ---- series


def test_monotonic_repair(spark):
    rows = [("s", "x", k, p, 10.0 * k, c) for k, (p, c) in enumerate([(0.0, 1.0), (10.5, 0.9), (9.0, 0.2), (31.0, 0.9), (40.0, 0.9)])]
    out = series.monotonic(spark.createDataFrame(rows, "sheet_id string, axis string, index int, position double, expected double, confidence double"), 3.0).orderBy("index").collect()
    assert [r.position for r in out] == [0.0, 10.5, 20.0, 31.0, 40.0]


def test_missing_curves_take_their_neighbours(spark):
    rows = [("s", "x", k, o, o is not None) for k, o in enumerate([1.0, None, 3.0, None, None, None, None])]
    got = series.fill_missing_curves(spark.createDataFrame(rows, "sheet_id string, axis string, index int, offset double, reliable boolean")).orderBy("index").collect()
    assert [r.offset for r in got] == [1.0, 2.0, 3.0, 3.0, 3.0, None, None]
