"""Canonical schemas and constants of monitoring sheets.

A sheet is a grid of 31 days by 8 points by 2 reading types: 496 cells, paired to 248 rows.  All
tables carry sheet_id, and nothing ever crosses sheets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the forms and rules.
DAYS, POINTS, KINDS = 31, 8, ("temperature", "humidity")
LIMITS = {"temperature": (10.0, 50.0), "humidity": (0.0, 100.0)}
SEVERITIES = ((25.0, "normal"), (30.0, "alert"))
ALARMING_TOP = 35.0
MIN_CONFIDENCE, VARIANTS, MINOR_DELTA = 0.85, 3, 0.1
ANOMALY_DELTA = {"temperature": 4.0, "humidity": 12.0}
MAD_FACTOR, MAD_SCALE, MIN_CONTEXT, DAY_REACH = 3.5, 1.4826, 4, 2
CATEGORIES = ("format", "absolute_range", "ocr_uncertainty", "operational_warning", "anomaly", "blank_mismatch")
DRIFT_THRESHOLD = 0.30
LOW_GEOMETRY_CONFIDENCE = 0.35

VARIANT = "struct<variant:string,ord:int,raw_text:string,text:string,confidence:double>"
CELL_RESULTS = f"""sheet_id string, filename string, day int, point int, reading_type string, variants array<{VARIANT}>,
consensus_prediction string, agreement_count int, average_consensus_confidence double, final_value string, is_blank boolean,
human_verified boolean, ocr_uncertainty_reasons array<string>, postprocessing_status string, candidate_interpretations array<string>,
blank_ink_ratio double, blank_component_count int, blank_largest_ratio double, blank_largest_width_ratio double,
blank_largest_height_ratio double, blank_largest_aspect_ratio double"""
PATCHES = "sheet_id string, seq int, filename string, has_value boolean, final_value string, is_blank boolean, human_verified boolean"
LABELS = "item_number int, sheet_id string, filename string, day int, point int, reading_type string, expected_value string, expected_blank boolean"
DAY_CONFIRMATIONS = "sheet_id string, day int"


def kind_order(kind: Column) -> Column:
    """Form order puts temperature before humidity."""
    return F.when(kind == "temperature", 0).otherwise(1)


def filename(day: Column, point: Column, kind: Column) -> Column:
    return F.format_string("day_%02d_point_%02d_%s.png", day, point, kind)


def form_order(df: DataFrame) -> DataFrame:
    return df.orderBy("sheet_id", "day", "point", kind_order(F.col("reading_type")))


def grid(spark: SparkSession) -> DataFrame:
    """The 496 cells of a sheet: day, point, reading_type, filename."""
    days = spark.range(1, DAYS + 1, 1, 1).select(F.col("id").cast("int").alias("day"))
    cells = days.withColumn("point", F.explode(F.sequence(F.lit(1), F.lit(POINTS)))).withColumn(
        "reading_type", F.explode(F.array(*[F.lit(k) for k in KINDS])))
    return cells.withColumn("filename", filename(F.col("day"), F.col("point"), F.col("reading_type")))


def benchmark_cells(spark: SparkSession, sheets: list[str]) -> DataFrame:
    """The labelled sample: three days by three points by two types of each sheet, numbered."""
    from pyspark.sql import Window

    chosen = grid(spark).filter(F.col("day").isin(1, 16, 31) & F.col("point").isin(1, 4, 8))
    rows = chosen.crossJoin(F.broadcast(spark.createDataFrame([(k, s) for k, s in enumerate(sheets)], "sheet_no int, sheet_id string")))
    place = Window.orderBy("sheet_no", "day", "point", kind_order(F.col("reading_type")))
    return rows.select(
        F.row_number().over(place).alias("item_number"), "sheet_id", F.concat("sheet_id", F.lit("__"), "filename").alias("filename"), "day", "point", "reading_type")
