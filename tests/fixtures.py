"""Small sheets for the tests."""

from readingforge.schema import CELL_RESULTS


def cell(day=1, point=1, kind="temperature", value="22.0", texts=None, raw=None, agreement=3, confidence=0.95, blank=False, verified=False, sheet="s", status="valid_unchanged", reasons=()):
    texts = texts or [value] * 3
    raw = raw or texts
    variants = [(n, k, r, t, confidence) for k, (n, r, t) in enumerate(zip(("original", "grayscale", "contrast"), raw, texts))]
    return (sheet, f"day_{day:02d}_point_{point:02d}_{kind}.png", day, point, kind, variants, value, agreement, confidence, value, blank, verified, list(reasons), status, [], 0.02, 1, 0.01, 0.05, 0.3, 0.2)


def cells(spark, rows):
    return spark.createDataFrame(rows, CELL_RESULTS)


def day(number, **changes):
    """The 16 cells of a day; changes by (point, kind)."""
    return [cell(number, p, k, **({"value": "22.0" if k == "temperature" else "50.0"} | changes.get(f"{k[0]}{p}", {}))) for p in range(1, 9) for k in ("temperature", "humidity")]
