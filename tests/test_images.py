import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from readingforge.functions import kernels as K
from readingforge.operators import consensus, metrics, pairing, recognition, verify
from readingforge.sources import images, tables, workbook
from readingforge.streaming import jobs

from .fixtures import cells, day

GLYPHS = {"2": ["111", "001", "111", "100", "111"], "3": ["111", "001", "111", "001", "111"], "4": ["101", "101", "111", "001", "001"], ".": ["000", "000", "000", "000", "010"]}


def drawn(text, h=40, w=80, scale=4):
    image = np.full((h, w), 255, np.uint8)
    x = 12
    for c in text:
        g = np.kron(np.array([[int(v) for v in r] for r in GLYPHS[c]]), np.ones((scale, scale))).astype(bool)
        image[10 : 10 + g.shape[0], x : x + g.shape[1]][g] = 20
        x += g.shape[1] + 3
    return image


def form(w=1200, h=640, rows=33, columns=18):
    image = np.full((h, w), 250, np.uint8)
    for k in range(rows):
        image[min(h - 2, 60 + k * (h - 70) // (rows - 1)) :][:2, 20 : w - 20] = 30
    for k in range(columns):
        image[60 : h - 10, 20 + k * (w - 42) // (columns - 1)][:, ] = 30
    return image


def test_png_round_trip():
    r = np.random.default_rng(1)
    for image in (r.integers(0, 256, (13, 7), dtype=np.uint8), r.integers(0, 256, (5, 9, 3), dtype=np.uint8)):
        assert (images.decode_png(images.encode_png(image)) == image).all()


def test_spark_reads_the_pngs(spark, tmp_path):
    image = np.random.default_rng(2).integers(0, 256, (6, 4, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(images.encode_png(image))
    row = images.load_images(spark, str(tmp_path)).first()
    assert (np.frombuffer(bytes(row.data), np.uint8).reshape(6, 4, 3) == image).all()


def test_routing_and_identity(spark, tmp_path):
    png = images.encode_png(np.zeros((2, 2), np.uint8))
    for name, data in {"a.png": png, "b.bin": png, "c.png": b"%PDF-1.7 x", "d.pdf": b"??", "e.txt": b"x", "g.jpg": b"\xff\xd8\xff\xe0"}.items():
        (tmp_path / name).write_bytes(data)
    up = images.uploads(spark, str(tmp_path))
    got = {r.source_filename: r.kind for r in up.collect()}
    assert got == {"a.png": "png", "b.bin": "png", "c.png": "pdf", "d.pdf": "pdf", "e.txt": "unknown", "g.jpg": "jpeg"}
    ids = {r.source_filename: r.sheet_id for r in images.sheet_ids(up.withColumn("page", F.lit(1))).collect()}
    assert ids["a.png"] == ids["b.bin"] != ids["c.png"]


def test_blankness():
    empty, full = K.blankness(np.full((40, 80), 240, np.uint8)), K.blankness(drawn("23.2"))
    assert empty["is_blank"] and empty["component_count"] == 0
    assert not full["is_blank"] and full["component_count"] >= 3 and full["ink_ratio"] > 0.02
    lined = np.full((40, 80), 255, np.uint8)
    lined[20] = 0
    assert K.blankness(lined)["is_blank"]


def test_components_are_eight_connected():
    m = np.zeros((5, 6), bool)
    m[0, 0] = m[1, 1] = m[2, 0] = m[4, 3:6] = True
    assert sorted(K.components(m)) == [(3, 0, 0, 3, 2), (3, 4, 3, 1, 3)]


def test_otsu_and_masks():
    assert 20 <= K.otsu(drawn("42.4")) < 255
    rows, columns = K.line_masks(form(), 17, 65)
    assert rows.any(axis=1).sum() >= 33 and columns.any(axis=0).sum() >= 16
    m = np.zeros((7, 7), bool)
    m[3, 3] = True
    assert K.dilate(m, 3, 3).sum() == 9 and (K.erode(K.dilate(m, 3, 3), 3, 3) == m).all()


def test_warp_takes_a_quadrilateral_to_a_rectangle():
    image = np.tile(np.arange(200, dtype=np.uint8), (100, 1))
    out = K.warp(image, np.array([[150, 80], [20, 10], [150, 10], [20, 80]]), 131, 71)
    assert np.abs(out.astype(int) - image[10:81, 20:151]).max() <= 1


def test_resizing():
    flat = np.full((10, 12, 3), 90, np.uint8)
    assert (K.resize_cubic(flat, 4) == 90).all() and K.prepared(flat).shape == (72, 80, 3) and (K.resize_area(flat, 5, 4) == 90).all()
    assert K.bounded(np.zeros((50, 100), np.uint8), 40).shape == (20, 40)
    assert set(K.variants(drawn("23.2"))) == {"original", "grayscale", "contrast", "binary"}


def test_peaks():
    strength = np.zeros(700)
    strength[(40 + 20.5 * np.arange(32)).round().astype(int)] = 1
    assert K.peak_near(strength, 43, 5, 0.5) == (40, 1.0) and K.peak_near(strength, 50, 5, 0.5) is None


def test_edges():
    image = np.full((30, 40), 200, np.uint8)
    image[10:20, 12:30] = 40
    found = K.edges(image)
    rows, columns = np.nonzero(found)
    assert found.any() and rows.min() in (9, 10) and rows.max() in (19, 20) and columns.min() in (11, 12) and columns.max() in (29, 30)
    assert not found[13:17, 15:27].any() and found.sum() < 2 * 2 * (10 + 18) and not K.edges(np.full((9, 9), 7, np.uint8)).any()
    ramp = np.tile(np.linspace(0, 30, 40).astype(np.uint8), (20, 1))
    assert not K.edges(ramp).any()


def test_queue_items_are_turned(spark):
    turned = K.rotated(form(), "counterclockwise")
    rows = [("a", images.encode_png(turned), "auto"), ("b", images.encode_png(turned), None), ("c", images.encode_png(turned), "none")]
    from readingforge.operators import sheets as S

    got = {r.sheet_id: r for r in S.restored(spark.createDataFrame(rows, "sheet_id string, png binary, orientation_choice string")).collect()}
    assert [got[k].rotation for k in "abc"] == ["clockwise", "clockwise", "none"]
    assert (images.unpack(got["a"].image) == form()).all() and (images.unpack(got["c"].image) == turned).all()


def test_orientation():
    assert K.orientation(form())["rotation"] == "none"
    turned = K.rotated(form(), "counterclockwise")
    got = K.orientation(turned)
    assert got["rotation"] == "clockwise" and (K.rotated(turned, got["rotation"]) == form()).all()


class Fake:
    """Tells the drawn text by the amount of ink; the contrast variant of 4s reads a comma."""

    made = 0

    def predict(self, batch):
        return [self.one(i) for i in batch]

    def one(self, image):
        n = (image[..., 0] < 128).mean()
        return ("22.0", 0.95) if n < 0.085 else ("2,4", 0.9)


def fake():
    return Fake()


def cell_images(spark):
    rows = [("s", f"day_01_point_{p:02d}_temperature.png", 1, p, "temperature", images.pack(x)) for p, x in enumerate([drawn("2"), drawn("2323"), np.full((40, 80), 245, np.uint8)], 1)]
    return spark.createDataFrame(rows, f"sheet_id string, filename string, day int, point int, reading_type string, image {images.IMAGE}")


@pytest.mark.parametrize("strategy", ["consensus", "adaptive"])
def test_cascade(spark, strategy):
    out = recognition.process(cell_images(spark), fake, strategy)
    got = {r.point: r for r in out.collect()}
    assert (got[1].final_value, got[1].is_blank, len(got[1].variants)) == ("22.0", False, 3 if strategy == "consensus" else 1)
    assert got[2].blocks_export and len(got[2].variants) == 3
    assert got[3].is_blank and got[3].final_value == "" and not got[3].variants
    n = recognition.counts(cell_images(spark), out).first()
    assert (n.cells, n.filled, n.inputs, n.saved) == ((3, 2, 6, 0) if strategy == "consensus" else (3, 2, 4, 2))


def test_likely_blanks_need_a_good_cut(spark):
    """A faint single stroke that reads as 1 is a likely blank, but not in a cell that was badly cut."""
    stroke = np.full((40, 80), 255, np.uint8)
    stroke[12:24, 40:42] = 20
    kinds = [("a", None, False, 0.9), ("b", "outside", True, 0.9), ("c", None, False, 0.1), ("d", None, True, 0.9)]
    rows = [(s, "day_01_point_01_temperature.png", 1, 1, "temperature", why, fixed, sure, images.pack(stroke)) for s, why, fixed, sure in kinds]
    df = spark.createDataFrame(rows, f"sheet_id string, filename string, day int, point int, reading_type string, geometry_rejection_reason string, uses_fallback_geometry boolean, local_geometry_confidence double, image {images.IMAGE}")
    assert not K.blankness(stroke)["is_blank"] and K.blankness(stroke)["component_count"] == 1
    got = {r.sheet_id: r.postprocessing_status for r in recognition.process(df, ones).collect()}
    assert got["a"] == "likely_blank" and "likely_blank" not in (got["b"], got["c"], got["d"])


class Ones:
    def predict(self, batch):
        return [("1", 0.9)] * len(batch)


def ones():
    return Ones()


def test_a_lost_recognition_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(recognition, "by_consensus", lambda cells, factory: recognition.consensus.assemble(recognition.recognise(cells.filter("point = 1"), factory, recognition.CONSENSUS_ORDER), recognition.KEYS))
    with pytest.raises(Exception, match="no recognition of day_01_point_02"):
        recognition.process(cell_images(spark), fake).collect()


def test_job_queue(spark, tmp_path):
    def work(rows):
        if rows.filter("sheet_id = 'crash'").count():
            raise RuntimeError("crashed")
        return rows.select("job_id", "sheet_id", F.when(F.col("sheet_id") == "bad", "broken").alias("error"))

    queue = jobs.JobQueue(spark, str(tmp_path / "store"), work)
    x, again = queue.submit("a", "x", source_filename="f"), queue.submit("a", "x")
    assert x == again and queue.submit("b", "x") != x
    assert queue.snapshot(x, "a").state == "queued" and queue.snapshot(x, "b") is None
    ids = {(r.owner_id, r.sheet_id): r.job_id for r in queue.submit_all(spark.createDataFrame([("a", "bad"), ("a", "x"), ("a", "crash"), ("a", "y"), ("a", "y")], "owner_id string, sheet_id string")).collect()}
    assert len(ids) == 4 and ids["a", "x"] == x
    queue.run()
    assert [(r.sheet_id, r.state, r.processed_count) for r in queue.snapshots("a").collect()] == [("x", "completed", 1), ("bad", "failed", 1), ("crash", "failed", 0), ("y", "completed", 1)]
    assert "crashed" in queue.snapshot(ids["a", "crash"], "a").error and queue.snapshot(ids["a", "bad"], "a").error == "broken"
    assert sorted(r.sheet_id for r in queue.results("a").collect()) == ["x", "y"] and queue.results("b").count() == 1
    # What has ended may be submitted again, as a new job.
    new = queue.submit("a", "x")
    assert new != x
    queue.run()
    assert queue.snapshot(new, "a").state == "completed"
    assert queue.consume_result(x, "b") is None and queue.consume_result(x, "a").count() == 1 and queue.consume_result(x, "a") is None
    assert queue.consume_result(ids["a", "bad"], "a") is None
    assert not queue.discard_terminal_job(x, "b") and queue.discard_terminal_job(x, "a") and queue.snapshot(x, "a") is None
    left = spark.createDataFrame([("y",)], "sheet_id string")
    assert [r.sheet_id for r in jobs.attach(queue.results("a"), left).collect()] == ["y"]


def test_job_queue_runs_until_it_is_shut_down(spark, tmp_path):
    queue = jobs.JobQueue(spark, str(tmp_path / "store"), lambda rows: rows.select("job_id", "sheet_id"))
    queue.start("0 seconds")
    job = queue.submit("a", "x")
    queue.shutdown()
    assert queue.query is None and queue.snapshot(job, "a").state == "completed"


def test_stages(spark):
    rows = [("a", "failed", None, None), ("b", "queued", None, None), ("c", "completed", True, 0), ("d", "completed", False, 30), ("e", "completed", False, 31)]
    df = spark.createDataFrame(rows, "sheet_id string, state string, ready boolean, unconfirmed_days int")
    got = {r.sheet_id: r.stage for r in jobs.stage_label(df.select("sheet_id", "state"), df.filter("ready IS NOT NULL")).collect()}
    assert got == {"a": "Failed", "b": "Processing", "c": "Ready to export", "d": "In review", "e": "Awaiting review"}


def template():
    cells_xml = "".join(f'<row r="{d + 6}">' + "".join(f'<c r="{c}{d + 6}" s="4"/>' for c in "BCDEFGHIJKLMNOPQ") + "</row>" for d in range(1, 32))
    sheet = f'<worksheet><sheetData><row r="3"><c r="C3" s="2"><v>1</v></c></row>{cells_xml}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/workbook.xml", '<workbook><calcPr calcId="1"/></workbook>')
    return out.getvalue()


def test_workbook(spark):
    rows = [c for d in range(1, 32) for c in day(d, t1={"value": f"{10 + d / 10:.1f}"}, **({"t2": {"value": "", "blank": True}, "h2": {"value": "", "blank": True}} if d == 1 else {}))]
    audit = pairing.mapping_audit(pairing.monitoring_rows(verify.verify(cells(spark, rows))))
    data = workbook.export(template(), audit, "May & June")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheet, book = z.read("xl/worksheets/sheet1.xml").decode(), z.read("xl/workbook.xml").decode()
    assert '<c r="B8" s="4"><v>10.2</v></c>' in sheet and '<c r="D7" s="4"/>' in sheet and '<c r="Q37" s="4"><v>50.0</v></c>' in sheet
    assert '<c r="C3" s="2" t="inlineStr"><is><t>May &amp; June</t></is></c>' in sheet and sheet.count("<v>") == 494 and 'fullCalcOnLoad="1"' in book
    with pytest.raises(pairing.Violation):
        workbook.export(template(), audit.limit(495), "x")
    with pytest.raises(pairing.Violation):
        workbook.patch_sheet('<c r="B7"/><c r="B7"/>', {"B7": 1.0}, {})


def test_tables(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("﻿item_number,sheet_id,filename,day,point,reading_type,expected_value,expected_blank\n1,s,f,1,2,humidity,50.0,False\n2,s,g,1,2,temperature,,True\n".encode())
    got = tables.read_labels(spark, str(tmp_path / "l.csv")).collect()
    assert [(r.item_number, r.expected_value, r.expected_blank) for r in got] == [(1, "50.0", False), (2, "", True)]
    (tmp_path / "e.csv").write_text("filename\n")
    with pytest.raises(pairing.Violation):
        tables.read_csv(spark, str(tmp_path / "e.csv"), ["filename"])
    trusted = spark.createDataFrame([("a.png", "22.0", ""), ("x__b.png", "", "TRUE"), ("c.png", "", ""), ("d.png", "1.0", "true")], "filename string, expected_value string, expected_blank string")
    ok, both = tables.trusted_labels(trusted)
    assert {r.filename for r in ok.collect()} == {"sample__a.png", "x__b.png"} and [r.filename for r in both.collect()] == ["sample__d.png"]
    edits = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y")], "filename string, line int, v string")
    assert {(r.filename, r.v) for r in tables.last_edits(edits).collect()} == {("a", "z"), ("b", "y")}
    (tmp_path / "m.json").write_text('{"items": [{"filename": "f", "fixed_alignment_failure": true}]}')
    assert {(r.mode, r.alignment_failure) for r in tables.read_manifest(spark, str(tmp_path / "m.json")).collect()} == {("fixed", True), ("calibrated", False)}
    df = spark.createDataFrame([(1, ["é", "b"], {"b": 1, "a": 2})], "k int, l array<string>, m map<string,int>")
    assert df.select(tables.canonical_json(F.col("m"))).first()[0] == '{"a":2,"b":1}'
    tables.write_csv(df, str(tmp_path / "out"), ["k", "l"])
    assert spark.read.csv(str(tmp_path / "out"), header=True, escape='"', quote='"').columns == ["k", "l"]
    with pytest.raises(pairing.Violation):
        tables.write_csv(df.limit(0), str(tmp_path / "out2"), ["k"])


# ---- whole sheets


def sheet(shift=0.0, bend=0.0):
    """A drawn form that fills its image, its rows pushed down by `shift` pixels, perhaps bent."""
    from readingforge.operators import sheets as S

    w, h = S.TABLE
    image = np.full((h, w), 250, np.uint8)
    x, y = S.bounds()
    xs = np.arange(w)
    for k, v in enumerate(np.linspace(y[0] + shift, h - 3, len(y))):
        line = np.rint(v + bend * np.sin(xs / w * np.pi) * (k < len(y) - 1)).astype(int).clip(0, h - 3)
        for t in range(3):
            image[line + t, xs] = 30
    for v in [*x, 2, w - 5]:
        image[:, v : v + 3] = 30
    image[:3] = image[-3:] = 30
    return image


def test_table_is_found_and_rows_are_fitted():
    from readingforge.operators import sheets as S

    page = np.full((1500, 2800), 255, np.uint8)
    page[120:1380, 200:2600] = sheet()
    found = S.corners(page)
    assert np.abs(found - np.array([[200, 120], [2599, 120], [2599, 1379], [200, 1379]])).max() < 8
    assert S.corners(np.full((400, 800), 255, np.uint8)) is None
    x, y = S.bounds()
    got, facts = S.fitted_rows(sheet(shift=-40), x, y)
    want = np.linspace(y[0] - 40, S.TABLE[1] - 3, 32)
    assert facts["reason"] is None and np.abs(got - want).max() < 5
    same, facts = S.fitted_rows(np.full((S.TABLE[1], S.TABLE[0]), 255, np.uint8), x, y)
    assert (same == y).all() and facts["reason"]


def test_rows_without_some_lines():
    """Lines that are missing don't move the others; too few are a reason."""
    from readingforge.operators import sheets as S

    x, y = S.bounds()
    for gone, fine in (((0,), True), ((31, 15), True), ((0, 7), True), ((3, 9, 20), False)):
        image = sheet(shift=-20)
        for k in gone:
            place = int(np.rint(np.linspace(y[0] - 20, S.TABLE[1] - 3, 32)[k]))
            image[place - 2 : place + 6, 4 : S.TABLE[0] - 6] = 250
        got, facts = S.fitted_rows(image, x, y)
        assert (facts["reason"] is None) == fine, (gone, facts)
        if fine:
            assert np.abs(got - np.linspace(y[0] - 20, S.TABLE[1] - 3, 32)).max() < 5
    far = np.full((S.TABLE[1], S.TABLE[0]), 250, np.uint8)
    for k in range(32):
        far[100 + 31 * k : 103 + 31 * k] = 30
    same, facts = S.fitted_rows(far, x, y)
    assert (same == y).all() and "edge" in facts["reason"]


def test_curves_are_repaired():
    from readingforge.operators import sheets as S

    at = np.arange(4.0)
    curve = lambda expected, position, confidence: {"expected": float(expected), "at": at, "position": np.asarray(position, float) * np.ones(4), "confidence": confidence, "direct": 4, "reliable": True, "fixed": False}
    curves = [curve(0, 0, 0.9), curve(10, 12, 0.9), curve(20, [20, 16, 20, 20], 0.4), curve(30, 30, 0.9), curve(40, 47, 0.8)]
    got = S.ascending(curves)
    assert [c["fixed"] for c in got] == [False, False, True, False, True] and (got[2]["position"] == 20).all() and got[4]["confidence"] == 0.0
    assert [c["fixed"] for c in curves] == [False] * 5
    quad = np.array([[10, 10], [60, 10], [60, 30], [10, 30]], float)
    assert S.rejected(quad, 50, 20, (100, 100)) is None
    assert S.rejected(quad * [1, 0] + [0, 200], 50, 20, (100, 100)) == "outside the table"
    assert S.rejected(quad + [0.5, 0.0], 50, 45, (100, 100)) == "unlikely height" and S.rejected(quad, 120, 20, (100, 100)) == "unlikely width"
    assert S.rejected(np.array([[10, 10], [60, 10], [78, 18.7], [28, 18.7]]), 50, 20, (100, 100)) == "too small"  # sheared: its sides are long enough


def test_curves_are_fitted():
    """Offsets too large, lone peaks and bends that are too strong are no lines."""
    from readingforge.operators import sheets as S

    def mask(rows):
        m = np.zeros((100, 80), bool)
        for k, r in enumerate(rows):
            m[r, 10 * k : 10 * k + 10] = True
        return m

    one = lambda rows: S.measured(mask(rows), np.array([20, 50, 80]), (0, 80), 8, 4)[1]
    straight = one([50, 51, 51, 52, 52, 53, 53, 54])
    assert straight["reliable"] and straight["direct"] == 8 and straight["position"][0] == 50 and straight["position"][-1] == 54
    lone = one([50, 50, 50, 60, 50, 50, 50, 50])
    assert lone["reliable"] and not (lone["position"] > 52).any() and lone["direct"] < 8
    assert not one([40, 40, 61, 61, 40, 40, 61, 61])["reliable"] and not one([0] * 8)["reliable"]


def test_cells_of_a_sheet(spark):
    from readingforge.operators import series
    from readingforge.operators import sheets as S

    df = spark.createDataFrame([("s", images.pack(sheet(bend=6.0)))], f"sheet_id string, image {images.IMAGE}")
    fixed = S.cells(df).select("filename", "image.height", "uses_fallback_geometry").collect()
    assert len({r.filename for r in fixed}) == 496
    cut = S.cells(df, "calibrated").select("filename", "uses_fallback_geometry", "local_geometry_confidence").collect()
    assert len(cut) == 496 and sum(r.uses_fallback_geometry for r in cut) < 50 and np.median([r.local_geometry_confidence for r in cut]) > 0.4
    report = series.boundary_summary(S.boundaries(df)).collect()
    assert {r.axis: r.boundaries for r in report} == {"horizontal": 32, "vertical": 17}
    up = S.oriented(df).first()
    assert up.rotation == "none" and up.confident


def test_two_method_benchmark(spark, tmp_path):
    from readingforge.operators import benchmark

    own = cell_images(spark)
    labels = spark.createDataFrame([(f"day_01_point_{p:02d}_temperature.png", p, v, b) for p, v, b in [(1, "22.0", False), (2, "2.4", False), (3, "", True)]], "filename string, item_number int, expected_value string, expected_blank boolean")
    out = benchmark.run(labels, {"fixed": own, "calibrated": own}, spark.createDataFrame([("s", 0.1)], "sheet_id string, drift double"), fake)
    summary = {r.geometry_mode: r for r in out["summary"].collect()}
    assert summary["fixed"].final_correct == summary["calibrated"].final_correct == 3 and summary["fixed"].blank_recall == 1.0
    assert {r.outcome for r in out["comparison"].collect()} == {"both_correct"} and all(r.same_inputs for r in out["times"].collect())
    assert {r.selected_geometry for r in out["hybrid"].collect()} == {"fixed"}
    assert summary["hybrid"].final_correct == 3 and summary["hybrid"].review_count == summary["fixed"].review_count
    rates = {r.geometry_mode: r for r in out["variants"].collect()}
    assert rates["fixed"].ocr_input_count == 6 and rates["fixed"].ocr_inputs_saved == 0 and rates["hybrid"].cell_count == 3
    blanks = {(r.mode, r.stage): r for r in metrics.blank_confusion(out["blanks"]).collect()}
    assert len(blanks) == 6 and blanks["hybrid", "after"].true_blanks == 1
    gates = {m: df.first() for m, df in benchmark.gates(out["rows"], ("s", "t", "u")).items()}
    assert not gates["calibrated"].passed and gates["calibrated"].accuracy_kept and gates["hybrid"].no_new_unsafe and not gates["hybrid"].sample_right and gates["hybrid"].gain_kept == 1.0
    benchmark.write_bundle(out, str(tmp_path / "bundle"))
    assert {x.name for x in (tmp_path / "bundle").iterdir()} == {"rows.csv", "comparison.csv", "hybrid.csv", "summary.json", "variants.json", "times.json"}
    assert spark.read.csv(str(tmp_path / "bundle" / "rows.csv"), header=True).count() == 9
    read = benchmark.variant_benchmark(own, labels, fake)
    assert read.count() == 8 and {r.variant: r.correct for r in consensus.variant_accuracy(read).collect()} == {"original": 2, "grayscale": 2, "contrast": 2, "binary": 2}
    with pytest.raises(pairing.Violation):
        benchmark.run(labels.limit(2), {"fixed": own, "calibrated": own}, spark.createDataFrame([("s", 0.1)], "sheet_id string, drift double"), fake)


def test_command_line(spark, tmp_path):
    from readingforge import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(images.encode_png(sheet()))
    assert cli.main(["align", str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    assert {r.axis for r in spark.read.json(str(tmp_path / "out")).collect()} == {"horizontal", "vertical"}
    assert cli.main(["preflight", str(tmp_path / "in"), str(tmp_path / "pre")]) == 0
    found = spark.read.json(str(tmp_path / "pre")).first()
    assert found.row_sequence_used and found.strong_bounds == 32 and found.fixed_cells == 496 and found.recommended == ("fixed" if found.invalid_cells else "calibrated")
    assert cli.main(["telemetry", str(tmp_path / "in"), str(tmp_path / "tel")]) == 0
    items = json.loads(spark.read.json(str(tmp_path / "tel")).first()["items"])
    assert len(items) == 496 and items[1]["filename"] == "day_01_point_01_humidity.png" and len(items[0]["boundary_sources"]) == 4 and items[0]["maximum_corner_displacement"] < 60
    assert cli.main(["diagnose", str(tmp_path / "in"), str(tmp_path / "pictures")]) == 0
    drawn_files = {x.name.split("_")[-1]: x for x in (tmp_path / "pictures").iterdir() if x.suffix == ".png"}
    assert set(drawn_files) == {"table.png", "rows.png", "columns.png", "bounds.png"}
    shown = images.decode_png(drawn_files["bounds.png"].read_bytes())
    assert ((shown == (0, 160, 0)).all(-1).sum() > 20_000) and spark.read.json(str(tmp_path / "pictures" / "alignment.json")).count() == 2
    (tmp_path / "p.csv").write_text("filename,expected_value,consensus_prediction\na_temperature.png,22.7,227\nb_humidity.png,50.0,50.0\nc_humidity.png,50.0,51.0\n")
    assert cli.main(["corrections", str(tmp_path / "p.csv"), str(tmp_path / "cor")]) == 0
    got = spark.read.json(str(tmp_path / "cor")).first()
    assert (got.total, got.consensus_correct, got.corrected_correct, got.changed, got.accepted, got.unsafe_accepts) == (3, 1, 2, 1, 2, 1)
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
    (tmp_path / "in" / "b.png").write_bytes(b"broken")
    with pytest.raises(pairing.Violation):
        cli.main(["align", str(tmp_path / "in"), str(tmp_path / "out")])
