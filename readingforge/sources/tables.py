"""Scans and sinks of small tables: CSV with fixed columns, JSON, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import readings as R
from ..operators.pairing import Violation

LABEL_COLUMNS = ["item_number", "sheet_id", "filename", "day", "point", "reading_type", "expected_value", "expected_blank"]


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header (a byte order mark is fine) as text columns; nulls are empty texts.
    A file without rows is an error."""
    df = spark.read.csv(path, header=True, encoding="UTF-8")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise Violation(f"{path}: no column {', '.join(missing)}")
    if df.isEmpty():
        raise Violation(f"{path}: no rows")
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path, LABEL_COLUMNS)
    number = lambda c: F.col(c).try_cast("int").alias(c)
    return df.select(number("item_number"), "sheet_id", "filename", number("day"), number("point"), "reading_type", "expected_value", R.truth(F.col("expected_blank")).alias("expected_blank"))


def trusted_labels(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trusted labels (filename, expected_value, and perhaps sheet_id and expected_blank) with the
    sheet in place, those without a label left out, and the rows that have a value and a blank."""
    has = lambda c: c in df.columns
    value = R.clean(F.col("expected_value"))
    blank = R.truth(F.col("expected_blank")) if has("expected_blank") else F.lit(False)
    own = F.nullif(F.trim("sheet_id"), F.lit("")) if has("sheet_id") else F.lit(None).cast("string")
    prefixed = F.when(F.contains("filename", F.lit("__")), F.substring_index("filename", "__", 1))
    sheet = F.coalesce(own, prefixed, F.lit("sample"))
    rows = df.select(sheet.alias("sheet_id"), F.substring_index("filename", "__", -1).alias("name"), value.alias("expected_value"), blank.alias("expected_blank"))
    rows = rows.withColumn("filename", F.concat("sheet_id", F.lit("__"), "name")).drop("name")
    both = rows.filter(F.col("expected_blank") & (F.col("expected_value") != ""))
    return rows.filter(F.col("expected_blank") != (F.col("expected_value") != "")), both


def last_edits(df: DataFrame, line: str = "line") -> DataFrame:
    """Prior edits, the last of each file name."""
    place = Window.partitionBy("filename").orderBy(F.col(line).desc())
    return df.withColumn("_k", F.row_number().over(place)).filter("_k = 1").drop("_k")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """mode, filename, alignment_failure of a benchmark manifest (items with both modes)."""
    df = spark.read.json(path, multiLine=True, schema="items array<struct<filename:string,fixed_alignment_failure:boolean,calibrated_alignment_failure:boolean>>")
    rows = df.select(F.explode("items").alias("i")).select("i.*")
    return rows.select("filename", F.expr("stack(2, 'fixed', fixed_alignment_failure, 'calibrated', calibrated_alignment_failure) as (mode, alignment_failure)")).select("mode", "filename", F.coalesce("alignment_failure", F.lit(False)).alias("alignment_failure"))


def canonical_json(pairs: Column) -> Column:
    """A map as compact JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def flat(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only `columns`, nested ones as JSON, for a CSV with a fixed header."""
    kinds = dict(df.dtypes)
    nested = lambda c: kinds[c].startswith(("array", "map", "struct"))
    return df.select(*[F.to_json(c, {"ignoreNullFields": "false"}).alias(c) if nested(c) else F.col(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "error") -> None:
    """`df` must have rows."""
    if df.isEmpty():
        raise Violation("there are no rows to write")
    flat(df, columns).write.mode(mode).csv(path, header=True, emptyValue="")


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
