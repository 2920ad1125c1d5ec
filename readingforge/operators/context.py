"""Local outliers: a reading against its neighbourhood on the form.

The neighbourhood of a reading is the readings of its type and sheet on the same day, and those at
its point within two days.  Both are window frames over one partitioning by sheet, so there is no
self-join, and what a row gathers is bounded by the form (eleven readings)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ANOMALY_DELTA, DAY_REACH, MAD_FACTOR, MAD_SCALE, MIN_CONTEXT

GROUP = ["sheet_id", "reading_type"]


def array_median(values: Column) -> Column:
    """The exact median of a sorted array."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2


def neighbours(cells: DataFrame, value: str = "value") -> DataFrame:
    """`cells` (sheet_id, filename, day, point, reading_type) with `context`, the values around.
    Cells without a value neither have a context nor are in one."""
    cell = F.struct("filename", "day", F.col(value).alias("v"))
    known = F.when(F.col(value).isNotNull(), cell)
    day = Window.partitionBy(*GROUP, "day")
    point = Window.partitionBy(*GROUP, "point").orderBy("day").rangeBetween(-DAY_REACH, DAY_REACH)
    # One exchange serves both windows, and those by the rows of a sheet that follow; a sheet has 496 cells.
    rows = cells.repartition("sheet_id").withColumns({"_day": F.collect_list(known).over(day), "_point": F.collect_list(known).over(point)})
    around = F.concat(
        F.filter("_day", lambda c: c["filename"] != F.col("filename")), F.filter("_point", lambda c: c["day"] != F.col("day")))
    out = F.when(F.col(value).isNotNull(), F.sort_array(F.transform(around, lambda c: c["v"])))
    return rows.withColumn("context", out).drop("_day", "_point")


def anomalies(cells: DataFrame, value: str = "value") -> DataFrame:
    """`cells` with context_size, context_median, context_mad, threshold and is_anomaly: the value
    is further from the median than the threshold, among at least four others."""
    rows = neighbours(cells, value)
    rows = rows.withColumn("context_size", F.coalesce(F.size("context"), F.lit(0)).cast("int")).withColumn(
        "context_size", F.when(F.col(value).isNull(), 0).otherwise(F.col("context_size")))
    enough = F.col("context_size") >= MIN_CONTEXT
    rows = rows.withColumn("context_median", F.when(enough, array_median(F.col("context"))))
    away = F.sort_array(F.transform("context", lambda v: F.abs(v - F.col("context_median"))))
    least = F.when(F.col("reading_type") == "temperature", ANOMALY_DELTA["temperature"]).otherwise(ANOMALY_DELTA["humidity"])
    rows = rows.withColumn("context_mad", F.when(enough, array_median(away)))
    rows = rows.withColumn("threshold", F.when(enough, F.greatest(least, MAD_FACTOR * MAD_SCALE * F.col("context_mad"))))
    return rows.withColumn(
        "is_anomaly", F.coalesce(F.abs(F.col(value) - F.col("context_median")) > F.col("threshold"), F.lit(False))).drop("context")


def context_view(cells: DataFrame, sheet_id: str, day: int, point: int, kind: str) -> DataFrame:
    """The cells around one cell, itself included."""
    near = (F.col("day") == day) | ((F.col("point") == point) & F.col("day").between(day - DAY_REACH, day + DAY_REACH))
    return cells.filter((F.col("sheet_id") == sheet_id) & (F.col("reading_type") == kind) & near)
