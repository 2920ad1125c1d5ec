"""Format-preserving pseudonyms for validated numbers and dates, in DataFrame expressions only.

A keyed Feistel network permutes each value within its own format: digits stay digits, letters
stay letters of their case, separators stay, a card number stays valid by its check digit, an
address keeps four bytes, a date stays a date of 1900 to 2099, a phone number keeps its country.
The same value has the same pseudonym everywhere, so records stay linked, and two values of a format
never share one.  Spellings of one value stay linked too: phone numbers are permuted by their digits,
however they are spaced, and dates by their day, however it is written.  Dates written with slashes
are read with the day first; those that have only the other reading are permuted among themselves,
by walking the cycle of the same permutation to the next such date, so that no text comes up twice.

Characters: the string is halved, and in each round one half's characters are shifted in their
alphabets by a keyed hash of the other half.  Numbers with odd ranges: the range is a product of
two moduli, and in each round one residue is shifted by a keyed hash of the other.  Who knows the key
can invert this, so the caller has to give one and to keep it secret.

Defined results: a null text stays null and has no values, an empty one stays empty; candidates
that are not valid (check digit, ranges, calendar, an e-mail name without letters and digits) stay
as they are and have no kind; names of more than 64 characters and domains with parts of more than
63, which the mail standard doesn't allow, are no addresses; repeated rows are rows of their own;
other columns of the input are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.readings import let

ROUNDS = 8
#: Steps of a walk along a cycle, at most.  Three days in five end it, so none needs so many.
WALK = 96
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")

#: Candidates by kind; the first that matches at a place counts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "iso_date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "date": r"(?<![\d./])\d{2}([./])\d{2}\1\d{4}(?!\d|[./]\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# The country codes of one and of two digits; all others have three.
ONE_DIGIT = "17"
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Days from 1900-01-01 to 2099-12-31, as a product.
DAY_MODULI = (17, 4297)


def keyed(key: str, kind: str, step: Column, *parts: Column) -> Column:
    """64 hexadecimal digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), *[p.cast("string") for p in parts]), 256)


def permuted_text(value: Column, key: str, kind: str) -> Column:
    """Characters of the alphabets, permuted within them; at least two characters."""

    def moved(half: Column, digits: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            n = F.conv(F.substr(digits, (i * 4) % 60 + 1, F.lit(4)), 16, 10).cast("int")
            out = F.when(c == "", c)
            for a in ALPHABETS:
                out = out.when(c.between(a[0], a[-1]), F.substr(F.lit(a), (F.ascii(c) - ord(a[0]) + n) % len(a) + 1, F.lit(1)))
            return out.otherwise(c)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    def network(v: Column) -> Column:
        cut = F.floor(F.length(v) / 2).cast("int")
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(F.substr(v, F.lit(1), cut).alias("a"), F.substr(v, cut + 1).alias("b")),
            lambda s, k: F.struct(s["b"].alias("a"), let(keyed(key, kind, k, F.length(v), s["b"]), lambda d: moved(s["a"], d)).alias("b")),
            lambda s: F.concat(s["a"], s["b"]),
        )

    return let(value, network)


def permuted_pair(a: Column, b: Column, moduli: tuple[int, int], key: str, kind: str) -> Column:
    """struct(a, b) of residues, permuted within the moduli."""

    def shift(x: Column, other: Column, modulus: int, k: Column) -> Column:
        return (x + F.conv(F.substr(keyed(key, kind, k, other), F.lit(1), F.lit(12)), 16, 10).cast("long")) % modulus

    def step(s: Column, k: Column) -> Column:
        return F.when(k % 2 == 0, F.struct(shift(s["a"], s["b"], moduli[0], k).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), shift(s["b"], s["a"], moduli[1], k).alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def luhn(digits: Column) -> Column:
    """The check digit that belongs after `digits`."""

    def check(d: Column) -> Column:
        twice = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == 1, c.try_cast("int")).otherwise(F.when(c.try_cast("int") > 4, c.try_cast("int") * 2 - 9).otherwise(c.try_cast("int") * 2)))
        total = F.aggregate(twice, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
        return ((10 - total % 10) % 10).cast("string")

    return let(digits, check)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refilled(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced by `digits` in order."""
    return let(digits, lambda d: F.aggregate(
        F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["out"], F.substr(d, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        lambda s: s["out"]))


def _shifted(c: Column, key: str, kind: str) -> Column:
    """One letter or digit, moved within its alphabet by a keyed number of places that is never none."""
    n = F.conv(F.substr(keyed(key, kind, F.lit(0)), F.lit(1), F.lit(12)), 16, 10).cast("long")
    out = F.lit(None).cast("string")
    for a in ALPHABETS:
        out = F.when(c.between(a[0], a[-1]), F.substr(F.lit(a), ((F.ascii(c) - ord(a[0]) + 1 + n % (len(a) - 1)) % len(a) + 1).cast("int"), F.lit(1))).otherwise(out)
    return out


def _email(m: Column, key: str) -> Column:
    name, rest = F.substring_index(m, "@", 1), F.concat(F.lit("@"), F.substring_index(m, "@", -1))
    new = F.when(F.length(name) > 1, permuted_text(name, key, "email")).otherwise(_shifted(name, key, "email"))
    return F.when(name.rlike("[A-Za-z0-9]"), F.concat(new, rest))


def _ip(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    show = lambda p: F.concat_ws(".", F.floor(p["a"] / 256).cast("int").cast("string"), (p["a"] % 256).cast("string"), F.floor(p["b"] / 256).cast("int").cast("string"), (p["b"] % 256).cast("string"))
    out = let(permuted_pair(part[0] * 256 + part[1], part[2] * 256 + part[3], (65536, 65536), key, "ip"), show)
    return F.when(F.forall(part, lambda x: x <= 255), out)


def _day(m: Column, f: str) -> Column:
    """The number of days since 1900 of a date of the range in format `f`, else null."""
    day = F.try_to_timestamp(m, F.lit(f)).cast("date")
    return F.when(F.year(day).between(1900, 2099), F.datediff(day, F.lit("1900-01-01").cast("date")))


def _date_at(n: Column) -> Column:
    return F.date_add(F.lit("1900-01-01").cast("date"), n)


def _moved_day(n: Column, key: str) -> Column:
    return let(permuted_pair(F.floor(n / DAY_MODULI[1]), n % DAY_MODULI[1], DAY_MODULI, key, "date"), lambda p: (p["a"] * DAY_MODULI[1] + p["b"]).cast("int"))


def _date(m: Column, f: str, key: str) -> Column:
    return let(_day(m, f), lambda n: F.when(n.isNotNull(), F.date_format(_date_at(_moved_day(n, key)), f)))


def _slash_date(m: Column, key: str) -> Column:
    def step(n: Column, _: Column) -> Column:
        return F.when((n["k"] > 0) & (F.dayofmonth(_date_at(n["n"])) > 12), n).otherwise(F.struct((n["k"] + 1).alias("k"), _moved_day(n["n"], key).alias("n")))

    def walked(n: Column) -> Column:
        end = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(F.lit(0).alias("k"), n.alias("n")), step, lambda s: s["n"])
        return F.when(n.isNotNull(), F.date_format(_date_at(end), "MM/dd/yyyy"))

    return F.coalesce(_date(m, "dd/MM/yyyy", key), let(_day(m, "MM/dd/yyyy"), walked))


def _ssn(m: Column, key: str) -> Column:
    a, g, s = (F.split(m, "-")[k].cast("int") for k in range(3))
    area = F.when(a < 666, a - 1).otherwise(a - 2)

    def show(p: Column) -> Column:
        new = F.floor(p["a"] / 99).cast("int")
        return F.format_string("%03d-%02d-%04d", F.when(new < 665, new + 1).otherwise(new + 2), (p["a"] % 99 + 1).cast("int"), (p["b"] + 1).cast("int"))

    out = let(permuted_pair(area * 99 + g - 1, s - 1, (898 * 99, 9999), key, "ssn"), show)
    return F.when(a.between(1, 899) & (a != 666) & (g > 0) & (s > 0), out)


def _phone(m: Column, key: str) -> Column:
    """The country code stays."""

    def moved(digits: Column) -> Column:
        n = F.when(F.substr(digits, F.lit(1), F.lit(1)).isin(*ONE_DIGIT), 1).when(F.substr(digits, F.lit(1), F.lit(2)).isin(*TWO_DIGITS), 2).otherwise(3)
        return F.when(F.length(digits).between(8, 15), refilled(m, F.concat(F.substr(digits, F.lit(1), n), permuted_text(F.substr(digits, n + 1), key, "phone"))))

    return let(digits_of(m), moved)


def _card(m: Column, key: str) -> Column:
    digits = digits_of(m)
    payload = F.substr(digits, F.lit(1), F.length(digits) - 1)
    new = let(permuted_text(payload, key, "card"), lambda d: F.concat(d, luhn(d)))
    return F.when(luhn(payload) == F.substr(digits, F.length(digits)), refilled(m, new))


def replaced(m: Column, key: str) -> Column:
    """struct(kind, value): the pseudonym of one candidate; kind is null where it isn't valid."""

    def as_is(kind: str) -> Column:
        return m.rlike(f"^(?:{PATTERNS[kind]})$")

    def found(kind: str, value: Column) -> Column:
        return let(value, lambda v: F.struct(F.when(v.isNotNull(), F.lit(kind)).alias("kind"), F.coalesce(v, m).alias("value")))

    return (
        F.when(F.contains(m, F.lit("@")), found("email", _email(m, key)))
        .when(as_is("ip"), found("ip", _ip(m, key)))
        .when(as_is("iso_date"), found("date", _date(m, "yyyy-MM-dd", key)))
        .when(m.rlike(r"^\d{2}/\d{2}/\d{4}$"), found("date", _slash_date(m, key)))
        .when(m.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), found("date", _date(m, "dd.MM.yyyy", key)))
        .when(as_is("ssn"), found("ssn", _ssn(m, key)))
        .when(F.startswith(m, F.lit("+")), found("phone", _phone(m, key)))
        .otherwise(found("card", _card(m, key)))
    )


KINDS = ("email", "ip", "date", "ssn", "phone", "card")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, text with pseudonyms, values (kind and pseudonym in order).  `key` is a secret; under
    the same key the same values have the same pseudonyms, in every run."""
    if not key:
        raise ValueError("a secret key is needed")
    text = F.col(text_col).cast("string")
    kinds = "array<struct<kind:string,value:string>>"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    rows = rows.withColumn("found", F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    rows = rows.withColumn("new", F.when(F.size("found") > 0, F.transform("found", lambda m: replaced(m, key))))
    gaps = F.split("text", ANY, -1)
    whole = F.array_join(F.flatten(F.zip_with(gaps, F.transform("new", lambda x: x["value"]), lambda g, v: F.array(g, F.coalesce(v, F.lit(""))))), "")
    return rows.select(
        "id", F.when(F.size("new") > 0, whole).otherwise(F.col("text")).alias("text"),
        F.coalesce(F.filter("new", lambda x: x["kind"].isNotNull()), F.expr(f"cast(array() as {kinds})")).alias("values"),
    )
