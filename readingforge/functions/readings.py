"""Rules for the text of one reading, as column expressions.  Texts are kept as text: whether a
reading is valid depends on its spelling.  The decimal digits of all scripts are digits of a value;
what counts digits, and what corrects recognised texts, means ASCII digits."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ALARMING_TOP, LIMITS, LOW_GEOMETRY_CONFIDENCE, SEVERITIES

# Messages of the value rules.
EMPTY = "Enter a value or mark the cell as blank."
TOO_LONG = "Too many digits or decimal places; verify the handwritten value."
SPELLING = "Use exactly one decimal place, such as 22.0 or 53.3."

# Characters that recognition confuses.
CONFUSED, MEANT = "OoQIl|,·•_", "000111...."

#: The decimal digits of other scripts, each in the order of its value.
DIGITS = "".join(c for c in map(chr, range(128, 0x110000)) if unicodedata.category(c) == "Nd")
VALUES = "".join(str(unicodedata.decimal(c)) for c in DIGITS)


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once."""
    return F.transform(F.array(value), body)[0]


def clean(text: Column) -> Column:
    """Stable text: null and nan are empty, white space around goes."""
    t = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"(?U)\A\s+|\s+\z", "")
    return F.when(F.lower(t) == "nan", "").otherwise(t)


def low_limit(kind: Column) -> Column:
    return F.when(kind == "temperature", LIMITS["temperature"][0]).when(kind == "humidity", LIMITS["humidity"][0])


def high_limit(kind: Column) -> Column:
    return F.when(kind == "temperature", LIMITS["temperature"][1]).when(kind == "humidity", LIMITS["humidity"][1])


def shown(number: Column) -> Column:
    """A number as text with one decimal, halves to even."""
    return F.call_function("format_number", number, F.lit("0.0"))


def one_decimal(text: Column) -> Column:
    return text.rlike(r"\A-?\p{Nd}+\.\p{Nd}\z")


def ascii_digits(text: Column) -> Column:
    """The text with ASCII digits.  Few texts have others, so few are gone through."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, DIGITS, VALUES)).otherwise(text)


def numeric(text: Column) -> Column:
    """The number of a one-decimal text, else null."""
    return F.when(one_decimal(text), ascii_digits(text).try_cast("double"))


def is_valid(text: Column, kind: Column) -> Column:
    """Whether a non-empty clean text has one decimal and lies within the limits of its type."""
    return F.coalesce(numeric(text).between(low_limit(kind), high_limit(kind)), F.lit(False))


def validate(text: Column, kind: Column, allow_blank: Column | bool = True) -> Column:
    """struct(text, normalized_value, numeric_value, is_blank, format_is_valid,
    within_absolute_limits, error) of a value by its spelling and limits."""
    allowed = F.lit(allow_blank) if isinstance(allow_blank, bool) else allow_blank
    return let(F.struct(clean(text).alias("t"), low_limit(kind).alias("low"), high_limit(kind).alias("high"), allowed.alias("allowed")), _validated)


def _validated(x: Column) -> Column:
    t, allowed = x["t"], x["allowed"]
    blank, shaped, n = t == "", one_decimal(t), numeric(t)
    inside = n.between(x["low"], x["high"])
    bounds = F.concat(F.lit("The value must be within "), shown(x["low"]), F.lit(" to "), shown(x["high"]), F.lit("."))
    error = (
        F.when(blank & allowed, F.lit(None).cast("string")).when(blank, EMPTY)
        .when(~shaped & t.rlike(r"\A(?:[0-9]{4,}|[0-9]+\.[0-9]{2,})\z"), TOO_LONG).when(~shaped, SPELLING)
        .when(~inside, bounds)
    )
    return F.struct(
        t.alias("text"),
        F.when(~blank & shaped & inside, F.regexp_replace(ascii_digits(t), r"\A(-?)0+(?=[0-9])", "$1")).alias("normalized_value"),
        F.when(~blank & shaped, n).alias("numeric_value"), blank.alias("is_blank"),
        F.when(blank, allowed).otherwise(shaped).alias("format_is_valid"),
        F.when(blank, allowed).otherwise(F.coalesce(shaped & inside, F.lit(False))).alias("within_absolute_limits"),
        error.alias("error"),
    )


def normalise(text: Column) -> Column:
    """Recognised text as digits with one dot and perhaps a leading minus."""
    return let(F.regexp_replace(F.translate(text, CONFUSED, MEANT), r"[^0-9.\-]", ""), _normalised)


def _normalised(t: Column) -> Column:
    digits = F.replace(t, F.lit("-"), F.lit(""))
    head = F.substring_index(digits, ".", 1)
    one_dot = F.when(
        F.contains(digits, F.lit(".")),
        F.concat(head, F.lit("."), F.replace(F.substr(digits, F.length(head) + 2), F.lit("."), F.lit("")))).otherwise(digits)
    return F.when(F.startswith(t, F.lit("-")), F.concat(F.lit("-"), one_dot)).otherwise(one_dot)


def with_point(digits: Column) -> Column:
    """A dot before the last of two or more digits, else null."""
    return F.when(digits.rlike(r"\A[0-9]{2,}\z"), F.regexp_replace(digits, r"([0-9])\z", r".$1"))


def correct(text: Column, kind: Column) -> Column:
    """struct(corrected_text, changed, needs_review, status, candidates) of a prediction.  Only a
    valid prediction needs no review; nothing else is accepted in silence."""
    return let(F.struct(clean(text).alias("t"), kind.alias("kind")), lambda x: _corrected(x["t"], x["kind"]))


def _corrected(t: Column, kind: Column) -> Column:
    none = F.expr("cast(array() as array<string>)")

    def outcome(value: Column, status: str, candidates: Column = none, changed: bool = False, review: bool = True) -> Column:
        return F.struct(
            value.alias("corrected_text"), F.lit(changed).alias("changed"), F.lit(review).alias("needs_review"),
            F.lit(status).alias("status"), candidates.alias("candidates"))

    three = with_point(t)
    first, last = F.substr(t, F.lit(2)), F.substr(t, F.lit(1), F.length(t) - 1)
    proposals = F.array(first, with_point(t), with_point(first), with_point(last))
    allowed = F.filter(proposals, lambda c: c.isNotNull() & is_valid(c, kind))
    found = F.sort_array(F.array_distinct(allowed))
    cut = F.regexp_extract(t, r"\A([^.]*\.[0-9])", 1)
    return (
        F.when(t == "", outcome(F.lit(""), "empty_prediction"))
        .when(t.rlike(r"\A-?[0-9]*\.[0-9]{2,}\z"), outcome(t, "extra_decimal_digits", F.when(is_valid(cut, kind), F.array(cut)).otherwise(none)))
        .when(is_valid(t, kind), outcome(t, "valid_unchanged", review=False))
        .when(t.rlike(r"\A[0-9]{3}\z") & is_valid(three, kind), outcome(three, "decimal_inferred", F.array(three), changed=True))
        .when(t.rlike(r"\A[0-9]{3}\z"), outcome(t, "three_digit_inference_invalid"))
        .when(F.contains(t, F.lit(".")), outcome(t, "malformed_with_decimal"))
        .when(t.rlike(r"\A[0-9]{4,}\z"), outcome(t, "too_many_digits", found))
        .when(F.size(found) == 1, outcome(found[0], "proposed_correction", found, changed=True))
        .when(F.size(found) > 1, outcome(t, "multiple_interpretations", found))
        .otherwise(outcome(t, "no_safe_correction"))
    )


def severity(value: Column) -> Column:
    """The band of a valid temperature."""
    out = F.when(value.isNull(), "not applicable")
    for top, name in SEVERITIES:
        out = out.when(value < top, name)
    return out.when(value <= ALARMING_TOP, "alarming").otherwise("critical")


def kind_of(filename: Column) -> Column:
    """The reading type that a file name tells, else null."""
    low = F.lower(filename)
    return F.when(F.contains(low, F.lit("temperature")), "temperature").when(F.contains(low, F.lit("humidity")), "humidity")


def place_of(filename: Column) -> Column:
    """struct(day, point, reading_type) of a crop's file name; nulls where it isn't one."""
    pattern = r"\A(?:.*__)?day_([0-9]{2})_point_([0-9]{2})_(temperature|humidity)\.png\z"
    part = lambda k: F.regexp_extract(filename, pattern, k)
    ok = filename.rlike(pattern)
    return F.struct(F.when(ok, part(1)).cast("int").alias("day"), F.when(ok, part(2)).cast("int").alias("point"), F.when(ok, part(3)).alias("reading_type"))


def decimal_only_error(predicted: Column, expected: Column) -> Column:
    """Whether two texts differ in their dots alone."""
    bare = lambda c: F.replace(c, F.lit("."), F.lit(""))
    return (predicted != expected) & (bare(predicted) == bare(expected))


def truth(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)) == "true", F.lit(False))


def day_group(day: Column) -> Column:
    """Days that aren't in the sample are an error."""
    other = F.raise_error(F.concat(F.lit("no day of the sample: "), day.cast("string"))).cast("string")
    return F.when(day == 1, "first").when(day == 16, "middle").when(day == 31, "last").when(day.isNotNull(), other)


def point_group(point: Column) -> Column:
    """Points that aren't in the sample are an error."""
    other = F.raise_error(F.concat(F.lit("no point of the sample: "), point.cast("string"))).cast("string")
    return F.when(point == 1, "left").when(point == 4, "center").when(point == 8, "right").when(point.isNotNull(), other)


def serious_geometry(rejection: Column, fallback: Column, confidence: Column) -> Column:
    """Whether a cell's local geometry can't be trusted."""
    return (F.coalesce(rejection, F.lit("")) != "") | F.coalesce(fallback, F.lit(False)) | (F.coalesce(confidence, F.lit(1.0)) < LOW_GEOMETRY_CONFIDENCE)


def cell_label(day: Column, point: Column, kind: Column) -> Column:
    return F.format_string("Day %d, Point %d, %s", day, point, F.initcap(kind))


def cell_address(day: Column, point: Column, kind: Column) -> Column:
    """The workbook cell: two columns a point from B on, a row a day from 7 on."""
    place = 2 * (point - 1) + F.when(kind == "humidity", 1).otherwise(0)
    return F.concat(F.char(F.lit(66) + place), (day + 6).cast("string"))


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.round(part / whole, 6))


def box_edges(x1: Column, y1: Column, x2: Column, y2: Column, margin_x: float, margin_y: float, pad_top: float, pad_bottom: float, width: int, height: int) -> Column:
    """The crop of a box: inner margins and outer paddings as shares of its size, within the image."""
    w, h = x2 - x1, y2 - y1
    inside = lambda c, top: F.greatest(F.lit(0), F.least(F.lit(top), c)).cast("int")
    return F.struct(
        inside(x1 + F.floor(w * margin_x), width).alias("left"), inside(y1 + F.floor(h * margin_y) - F.floor(h * pad_top), height).alias("top"),
        inside(x2 - F.floor(w * margin_x), width).alias("right"), inside(y2 - F.floor(h * margin_y) + F.floor(h * pad_bottom), height).alias("bottom"))
