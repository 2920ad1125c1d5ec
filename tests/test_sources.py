import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readingforge.operators import pairing
from readingforge.sources import images, pdf


def document(pictures, text=b"", packed=False, extra=b"", box=(0, 0, 400, 200), place=None):
    """A PDF file of one page for each picture."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /MediaBox [%d %d %d %d] /Kids [%s] /Count %d >>" % (*box, b" ".join(b"%d 0 R" % (10 * k + 10) for k in range(len(pictures))), len(pictures))}
    streams = {}
    for k, (image, coding) in enumerate(pictures):
        n = 10 * k + 10
        a, d, e, f = place or (box[2] - box[0], box[3] - box[1], box[0], box[1])
        content = b"q %s 0 0 %s %s %s cm /Im0 Do Q " % tuple(str(v).encode() for v in (a, d, e, f)) + text
        data, name = (image, b"DCTDecode") if coding == "jpeg" else (zlib.compress(np.ascontiguousarray(image if image.ndim == 2 else image[..., ::-1]).tobytes()), b"FlateDecode")
        shape = (8, 16) if coding == "jpeg" else image.shape
        colour = b"DeviceGray" if len(shape) == 2 else b"DeviceRGB"
        objects[n] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /XObject << /Im0 %d 0 R >> >> %s >>" % (n + 1, n + 2, extra)
        streams[n + 1] = (b"<< /Length %d >>" % len(content), content)
        streams[n + 2] = (b"<< /Subtype /Image /Width %d /Height %d /ColorSpace /%s /BitsPerComponent 8 /Filter /%s /Length %d >>" % (shape[1], shape[0], colour, name, len(data)), data)
    out = b"%PDF-1.7\n"
    if packed:
        bodies = list(objects.items())
        starts = np.cumsum([0] + [len(b) + 1 for _, b in bodies])
        head = b" ".join(b"%d %d" % (k, s) for (k, _), s in zip(bodies, starts)) + b" "
        data = zlib.compress(head + b" ".join(b for _, b in bodies))
        streams[900] = (b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>" % (len(bodies), len(head), len(data)), data)
        objects = {}
    for k, body in objects.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    for k, (head, data) in streams.items():
        out += b"%d 0 obj\n%s\nstream\n%s\nendstream\nendobj\n" % (k, head, data)
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


R = np.random.default_rng(5)
GREY, COLOUR = R.integers(0, 256, (20, 40), dtype=np.uint8), R.integers(0, 256, (10, 20, 3), dtype=np.uint8)


@pytest.mark.parametrize("packed", [False, True])
def test_scans_are_the_pages(packed):
    got = pdf.decode(document([(GREY, ""), (COLOUR, "")], packed=packed))
    assert [(p["page"], p["method"], p["dpi"]) for p in got] == [(1, "embedded", 7.2), (2, "embedded", 3.6)]
    assert (images.unpack(got[0]["image"]) == GREY).all() and (images.unpack(got[1]["image"]) == COLOUR).all()
    jpeg = pdf.decode(document([(b"\xff\xd8\xff\xe0 endstream data", "jpeg")], packed=packed))
    assert jpeg[0]["jpeg"] == b"\xff\xd8\xff\xe0 endstream data" and jpeg[0]["image"] is None


@pytest.mark.parametrize("other", [{"text": b"BT (x) Tj ET"}, {"extra": b"/Rotate 90"}, {"place": (300, 200, 0, 0)}, {"place": (400, 200, 20, 0)}, {"place": (-400, 200, 400, 0)}, {"text": b"0 0 10 10 re f"}])
def test_other_pages_need_a_renderer(other):
    data = document([(GREY, "")], **other)
    with pytest.raises(ValueError, match="needs a renderer"):
        pdf.decode(data)
    got = pdf.decode(data, lambda content, page, dpi: np.full((4, 5), page + dpi % 7, np.uint8))
    assert got[0]["method"] == "rendered" and got[0]["dpi"] == 300 and images.unpack(got[0]["image"]).shape == (4, 5)


def test_files_that_cannot_be_read():
    for data, why in ((document([(GREY, "")]) + b"/Encrypt 3 0 R", "encrypted"), (b"%PDF-1.4 nothing", "catalog"), (document([(GREY, "")], box=(0, 0, 40000, 40000), place=(1, 1, 0, 0)), "too large"), (document([]), "no pages")):
        with pytest.raises(ValueError, match=why):
            pdf.decode(data)


def test_uploads_become_queue_items(spark, tmp_path):
    png = images.encode_png(COLOUR)
    for name, data in {"a.png": png, "b.pdf": document([(GREY, ""), (COLOUR, "")]), "c.pdf": b"%PDF-1.4 broken", "d.txt": b"text", "e.png": png[:20]}.items():
        (tmp_path / name).write_bytes(data)
    pages = images.decoded_pages(spark, str(tmp_path))
    got = {(r.source_filename, r.page): r for r in pages.collect()}
    assert {k for k, r in got.items() if r.error is None} == {("a.png", 1), ("b.pdf", 1), ("b.pdf", 2)}
    assert {k[0] for k, r in got.items() if r.error} == {"c.pdf", "d.txt", "e.png"}
    items = {r.display_name: r for r in images.queue_items(pages).collect()}
    assert set(items) == {"a.png", "b.pdf - page 1", "b.pdf - page 2"} and len({r.sheet_id for r in items.values()}) == 3
    assert (images.decode_png(bytes(items["b.pdf - page 1"].png)) == GREY).all()
    back = images.from_png(images.queue_items(pages)).filter("page = 2").first()
    assert (images.unpack(back.image) == COLOUR).all()
    fine = pages.filter("error IS NULL")
    with pytest.raises(pairing.Violation):
        images.only_page(fine)
    assert images.only_page(fine.filter("source_filename = 'a.png'")).count() == 1


def test_folders_of_crops(spark, tmp_path):
    folder = tmp_path / "crops"
    names = ["day_01_point_02_humidity.png", "day_03_point_04_temperature.png", "notes.png"]
    rows = [("s", n, images.pack(np.full((6, 9), 10 * k, np.uint8)), k != 1) for k, n in enumerate(names)]
    df = spark.createDataFrame(rows, f"sheet_id string, filename string, image {images.IMAGE}, needs_review boolean")
    images.save_pngs(df, str(folder))
    cells, others = images.sample_cells(spark, str(folder))
    assert {(r.filename, r.day, r.point, r.reading_type) for r in cells.collect()} == {(names[0], 1, 2, "humidity"), (names[1], 3, 4, "temperature")} and [r.filename for r in others.collect()] == ["notes.png"]
    labels = spark.createDataFrame([("s", names[0], 1, 2, "humidity", "50.0")], "sheet_id string, filename string, day int, point int, reading_type string, expected_value string")
    own = images.label_cells(spark, labels, str(folder))
    assert "expected_value" not in own.columns and own.first().image.width == 9
    with pytest.raises(Exception, match="no crop of gone.png"):
        images.label_cells(spark, labels.withColumn("filename", F.lit("gone.png")), str(folder)).collect()
    images.save_review_crops(df, df, str(tmp_path / "review"))
    assert sorted(p.name for p in (tmp_path / "review").iterdir()) == [names[0], "notes.png"]
