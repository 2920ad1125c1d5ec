"""Day confirmations and export readiness.  Confirmed days are rows (sheet_id, day)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import readings as R
from ..schema import DAYS, POINTS
from . import patches, verify

DAY = ["sheet_id", "day"]


def confirmable(verified: DataFrame) -> DataFrame:
    """Per sheet and day: whether all 16 cells are valid, unblocked, matched and seen by a person."""
    fine = F.col("format_is_valid") & F.col("within_absolute_limits") & ~F.col("blocks_export") & ~F.col("has_blank_mismatch") & F.col("human_verified")
    return verified.groupBy(*DAY).agg(((F.count(F.lit(1)) == 2 * POINTS) & F.bool_and(fine)).alias("confirmable"))


def without(confirmed: DataFrame, touched: DataFrame) -> DataFrame:
    """The confirmed days without those of `touched` cells."""
    return confirmed.join(touched.select(*DAY).distinct(), DAY, "left_anti")


def invalidate(confirmed: DataFrame, cells: DataFrame, changed: DataFrame) -> DataFrame:
    """The confirmed days without those of changed cells."""
    return without(confirmed, cells.join(changed, ["sheet_id", "filename"], "left_semi"))


def next_day(confirmed: DataFrame, current: DataFrame) -> DataFrame:
    """Per row of `current` (sheet_id, day): next, the first unconfirmed day after it, round the
    month (itself if there is none), and previous, the day before but not below 1."""
    days = F.sequence(F.lit(1), F.lit(DAYS))
    done = confirmed.groupBy("sheet_id").agg(F.collect_set("day").alias("_done"))
    rows = current.join(done, "sheet_id", "left")
    open_days = F.array_except(days, F.coalesce("_done", F.expr("cast(array() as array<int>)")))
    ahead = F.array_min(F.transform(F.filter(open_days, lambda d: d != F.col("day")), lambda d: F.struct(((d - F.col("day") - 1 + DAYS) % DAYS).alias("gap"), d.alias("d"))))
    return rows.select(*DAY, F.coalesce(ahead["d"], F.col("day")).alias("next"), F.greatest(F.col("day") - 1, F.lit(1)).alias("previous"))


def submit_day(cells: DataFrame, confirmed: DataFrame, controls: DataFrame, confirm: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Submits day controls (sheet_id, day, filename, value, is_blank) for the sheets and days they
    name: verified cells, confirmed days, errors.  A control is a patch where it changes its
    cell, and a confirmation where the day is confirmed; changed days lose their confirmation; a
    day is confirmed if that is asked, nothing was wrong, and it is confirmable."""
    days = controls.select(*DAY).distinct()
    here = cells.join(days, DAY, "left_semi").select("sheet_id", "day", "filename", F.col("final_value").alias("_old"), F.col("is_blank").alias("_was"))
    joined = here.join(controls.withColumnRenamed("is_blank", "_blank"), ["sheet_id", "day", "filename"], "left")
    given = F.col("_blank").isNotNull() | F.col("value").isNotNull()
    changes = (F.coalesce("_blank", F.lit(False)) != F.col("_was")) | (R.clean(F.col("value")) != F.col("_old"))
    wanted = F.lit(confirm) | (given & changes)
    own = joined.filter(F.coalesce(wanted, F.lit(False))).select(
        "sheet_id", F.lit(1).alias("seq"), "filename", (given & ~F.coalesce("_blank", F.lit(False))).alias("has_value"), F.col("value").alias("final_value"),
        F.when(given, F.coalesce("_blank", F.lit(False))).alias("is_blank"), F.lit(True).alias("human_verified"))
    unknown = controls.join(cells.select("sheet_id", "day", "filename"), ["sheet_id", "day", "filename"], "left_anti").select(
        "sheet_id", "filename", F.lit(0).alias("seq"), F.lit("Unknown cell.").alias("error"))
    out, errors, changed = patches.apply_patches(cells, own)
    errors = errors.unionByName(unknown)
    checked = verify.verify(out)
    left = invalidate(confirmed, cells, changed)
    if confirm:
        fine = confirmable(checked).filter("confirmable").join(days, DAY, "left_semi").join(errors.select("sheet_id").distinct(), "sheet_id", "left_anti").select(*DAY)
        left = left.unionByName(fine).distinct()
    return checked, left, errors


def readiness(verified: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Per sheet: what still stands against an export, and whether it is ready."""
    count = lambda c: F.count_if(c)
    facts = verified.groupBy("sheet_id").agg(
        count(F.size("blocking_errors") > 0).alias("blocking_cells"),
        count((F.size("required_confirmation_reasons") > 0) & ~F.col("human_verified")).alias("unverified_confirmations"),
        count(~F.col("format_is_valid") | ~F.col("within_absolute_limits")).alias("invalid_values"), count(F.col("blocks_export")).alias("blocked_cells"),
        F.count_distinct(F.when(F.col("has_blank_mismatch"), F.struct("day", "point"))).alias("mismatch_rows"))
    done = confirmed.filter(F.col("day").between(1, DAYS)).groupBy("sheet_id").agg(F.count_distinct("day").alias("_done"))
    out = facts.join(done, "sheet_id", "left").withColumn("unconfirmed_days", F.lit(DAYS) - F.coalesce("_done", F.lit(0)))
    parts: list[Column] = [F.col(c) for c in ("unconfirmed_days", "blocking_cells", "unverified_confirmations", "mismatch_rows", "invalid_values", "blocked_cells")]
    return out.drop("_done").withColumn("ready", sum(parts[1:], parts[0]) == 0)
