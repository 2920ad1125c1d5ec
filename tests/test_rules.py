import itertools

import pytest
from pyspark.sql import functions as F

from readingforge.functions import readings as R


def run(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def one_decimal(t):
    """The shape of a reading, one character at a time: perhaps a minus, digits, a dot, one digit."""
    t = t.removeprefix("-")
    head, dot, tail = t.partition(".")
    return bool(dot) and head.isdecimal() and tail.isdecimal() and len(tail) == 1


def test_only_one_decimal_is_a_reading(spark):
    """All texts of up to four of these signs, and some longer ones."""
    every = ["".join(x) for n in range(1, 5) for x in itertools.product("7.- ,a", repeat=n)] + ["3\n1", "12.5\n", "1e1.0", "+12.0", "12.0.", "0012.3", "-012.3", "12345", "1.23456", "１２.５", "1２.5", "٣.٤"]
    clean = [t.strip() for t in every]
    got = run(spark, [(t,) for t in every], "t string", R.validate(F.col("t"), F.lit("humidity"), False))
    for t, v in zip(clean, got, strict=True):
        assert v.format_is_valid == one_decimal(t) and (v.error is None) == (one_decimal(t) and 0 <= float(t) <= 100), t
        assert v.normalized_value == (None if v.error else ("-" if t[0] == "-" else "") + f"{abs(float(t)):.1f}"), t
        long = t.isascii() and (t.isdecimal() and len(t) > 3 or t.count(".") == 1 and all(x.isdecimal() for x in t.split(".")) and len(t.split(".")[1]) > 1)
        assert not v.error or one_decimal(t) or (v.error == R.TOO_LONG) == long or not t, t


@pytest.mark.parametrize(
    ("text", "kind", "normalized", "shaped", "inside"),
    [("51.0", "temperature", None, True, False), ("022.0", "temperature", "22.0", True, True), ("-0.0", "humidity", "-0.0", True, True), (" 50.0\t", "temperature", "50.0", True, True), ("100.0", "humidity", "100.0", True, True), ("9.9", "temperature", None, True, False), (None, "humidity", None, True, True), ("nan", "humidity", None, True, True)],
)
def test_validate(spark, text, kind, normalized, shaped, inside):
    v = run(spark, [(text,)], "t string", R.validate(F.col("t"), F.lit(kind)))[0]
    assert (v.normalized_value, v.format_is_valid, v.within_absolute_limits) == (normalized, shaped, inside)


@pytest.mark.parametrize(
    ("text", "kind", "out", "status", "candidates"),
    [
        ("493", "temperature", "49.3", "decimal_inferred", ["49.3"]), ("227", "temperature", "22.7", "decimal_inferred", ["22.7"]), ("568", "temperature", "568", "three_digit_inference_invalid", []),
        ("568", "humidity", "56.8", "decimal_inferred", ["56.8"]), ("4114", "temperature", "4114", "too_many_digits", ["11.4", "41.1"]), ("41.14", "temperature", "41.14", "extra_decimal_digits", ["41.1"]),
        ("４９３", "temperature", "４９３", "no_safe_correction", []), ("２２.０", "temperature", "２２.０", "valid_unchanged", []), ("22.0", "temperature", "22.0", "valid_unchanged", []), ("", "humidity", "", "empty_prediction", []), ("51.0", "temperature", "51.0", "malformed_with_decimal", []),
        ("22.", "temperature", "22.", "malformed_with_decimal", []), ("55", "humidity", "5.5", "proposed_correction", ["5.5"]),
    ],
)
def test_correct(spark, text, kind, out, status, candidates):
    c = run(spark, [(text,)], "t string", R.correct(F.col("t"), F.lit(kind)))[0]
    assert (c.corrected_text, c.status, c.candidates) == (out, status, candidates)
    assert c.needs_review == (status != "valid_unchanged") and c.changed == (out != text)


@pytest.mark.parametrize(("text", "out"), [("2O.I", "20.1"), ("-2-2,5", "-22.5"), ("1.2.3", "1.23"), ("a-5", "-5"), ("5-", "5"), ("|l·Q", "11.0"), ("", "")])
def test_normalise(spark, text, out):
    assert run(spark, [(text,)], "t string", R.normalise(F.col("t"))) == [out]


def test_severity_bands(spark):
    got = run(spark, [(24.9,), (25.0,), (30.0,), (35.0,), (35.1,), (None,)], "v double", R.severity(F.col("v")))
    assert got == ["normal", "alert", "alarming", "alarming", "critical", "not applicable"]


def test_names_and_addresses(spark):
    rows = [("day_03_point_08_humidity.png",), ("sheet__day_31_point_01_temperature.png",), ("x.png",)]
    got = run(spark, rows, "f string", R.place_of(F.col("f")))
    assert [tuple(g) for g in got] == [(3, 8, "humidity"), (31, 1, "temperature"), (None, None, None)]
    got = run(spark, [(1, 1, "temperature"), (1, 1, "humidity"), (1, 2, "temperature"), (2, 1, "humidity"), (31, 8, "humidity")], "d int, p int, k string", R.cell_address(F.col("d"), F.col("p"), F.col("k")))
    assert got == ["B7", "C7", "D7", "C8", "Q37"]
    assert run(spark, [("217", "21.7"), ("21.7", "21.7"), ("218", "21.7")], "a string, b string", R.decimal_only_error(F.col("a"), F.col("b"))) == [True, False, False]
