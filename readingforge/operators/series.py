"""Ordered samples along an axis: nearest sample, interpolation, peaks, gaps, repair, spacing, drift."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.readings import safe_ratio

PEAK_REACH, MAX_OFFSET, MAX_BEND = 0.25, 0.42, 0.30


def nearest(targets: DataFrame, samples: DataFrame, keys: list[str], at: str, sample_at: str, value: str) -> DataFrame:
    """`targets` with the value of the sample nearest to `at` (the first of two as near).

    A merge of both sides in one window each way, so no row meets more than two samples."""
    t = targets.withColumns({"_at": F.col(at).cast("double"), "_s": F.lit(None).cast("struct<p:double,v:double>"), "_t": F.struct(*targets.columns)})
    s = samples.select(*keys, F.col(sample_at).cast("double").alias("_at"), F.struct(F.col(sample_at).cast("double").alias("p"), F.col(value).cast("double").alias("v")).alias("_s"), F.lit(None).cast(t.schema["_t"].dataType).alias("_t"))
    rows = t.select(*keys, "_at", "_s", "_t").unionByName(s)
    before = Window.partitionBy(*keys).orderBy("_at", F.col("_s").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.col("_at").desc(), F.col("_s").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_low": F.last("_s", True).over(before), "_high": F.last("_s", True).over(after)}).filter(F.col("_t").isNotNull())
    low_gap, high_gap = F.col("_at") - F.col("_low.p"), F.col("_high.p") - F.col("_at")
    pick = F.when(F.col("_high").isNull() | (low_gap <= high_gap), F.col("_low")).otherwise(F.col("_high"))
    return rows.select("_t.*", pick["p"].alias("nearest_at"), pick["v"].alias("nearest_value"))


def interpolate(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """`rows` with `filled`: gaps of `value` by a straight line between the samples around, flat at
    the ends; null where a series has no sample."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).cast("double").alias("p"), F.col(value).cast("double").alias("v")))
    order = Window.partitionBy(*keys).orderBy(at)
    rows = rows.withColumn("_k", known).withColumns({
        "_low": F.last("_k", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_high": F.first("_k", True).over(order.rowsBetween(0, Window.unboundedFollowing))})
    line = F.col("_low.v") + (F.col("_high.v") - F.col("_low.v")) * (F.col(at) - F.col("_low.p")) / F.nullif(F.col("_high.p") - F.col("_low.p"), F.lit(0.0))
    return rows.withColumn("filled", F.coalesce(F.col(value).cast("double"), line, F.col("_low.v"), F.col("_high.v"))).drop("_k", "_low", "_high")


def isolated_peaks(rows: DataFrame, keys: list[str], at: str, value: str, spacing: Column) -> DataFrame:
    """`rows` with is_peak: the value is further than a quarter of the spacing from the mean of its
    two neighbours.  All are judged by the original series, so one rejection causes no other."""
    order = Window.partitionBy(*keys).orderBy(at)
    low, high = F.lag(value).over(order), F.lead(value).over(order)
    return rows.withColumn("is_peak", F.coalesce(F.abs(F.col(value) - (low + high) / 2) > PEAK_REACH * spacing, F.lit(False)))


def bends(rows: DataFrame, keys: list[str], at: str, value: str, spacing: Column) -> DataFrame:
    """Per series: the largest second difference as a share of the spacing, and whether it is too much."""
    order = Window.partitionBy(*keys).orderBy(at)
    bend = F.abs(F.lag(value).over(order) - 2 * F.col(value) + F.lead(value).over(order)) / spacing
    return rows.withColumn("_b", bend).groupBy(*keys).agg(F.max("_b").alias("bend")).withColumn("too_curved", F.coalesce(F.col("bend") > MAX_BEND, F.lit(False)))


def spacing(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Per series: n, mean, population deviation and variation of the gaps between neighbours."""
    order = Window.partitionBy(*keys).orderBy(at)
    gaps = rows.withColumn("_g", F.col(at) - F.lag(at).over(order))
    mean, deviation = F.avg("_g"), F.stddev_pop("_g")
    return gaps.groupBy(*keys).agg(F.count("_g").alias("n"), F.round(mean, 6).alias("mean_gap"), F.round(deviation, 6).alias("gap_deviation"), safe_ratio(deviation, mean).alias("gap_variation"))


def percentiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group: n, p50, p95 (by linear interpolation) and max, to six places."""
    p = lambda q: F.round(F.percentile(value, F.lit(q)), 6)
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.round(F.max(value), 6).alias("max"))


def drift(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Per series: the last value less the first."""
    return rows.groupBy(*keys).agg(F.round(F.max_by(value, at) - F.min_by(value, at), 6).alias("drift"))


def drift_distribution(drifts: DataFrame, *by: str) -> DataFrame:
    """p50, p95 and max of the absolute drift of series (see `drift`)."""
    size = F.abs(F.col("drift"))
    p = lambda q: F.round(F.percentile(size, F.lit(q)), 6)
    return drifts.groupBy(*by).agg(p(0.5).alias("drift_p50"), p(0.95).alias("drift_p95"), F.round(F.max(size), 6).alias("drift_max"))


def boundary_summary(rows: DataFrame) -> DataFrame:
    """Per sheet and axis: counts, p50, p95 and max of absolute and normalised errors, continuity.
    `rows` has sheet_id, axis, index, expected_position, detected_position, spacing, continuity."""
    error = F.abs(F.col("detected_position") - F.col("expected_position"))
    rows = rows.withColumns({"_e": error, "_n": error / F.col("spacing")})
    p = lambda c, q: F.round(F.percentile(c, F.lit(q)), 6)
    return rows.groupBy("sheet_id", "axis").agg(
        F.count(F.lit(1)).alias("boundaries"), F.count("detected_position").alias("detected"), p("_e", 0.5).alias("error_p50"), p("_e", 0.95).alias("error_p95"),
        F.round(F.max("_e"), 6).alias("error_max"), p("_n", 0.5).alias("normalised_p50"), p("_n", 0.95).alias("normalised_p95"), F.round(F.max("_n"), 6).alias("normalised_max"),
        F.round(F.avg("continuity"), 6).alias("continuity"))


# The normalised error and the spacing variation at which nothing is left of a score.
WORST_ERROR, WORST_VARIATION = 0.35, 0.20


def alignment_score(coverage: Column, continuity: Column, error: Column, variation: Column) -> Column:
    """0 to 100 from coverage, continuity, the median normalised error (1 if unknown) and the variation of
    the spacing (nothing if unknown)."""
    share = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    even = F.when(variation.isNull(), 0.0).otherwise(1 - share(variation / WORST_VARIATION))
    return F.round(100 * (0.35 * share(coverage) + 0.25 * share(continuity) + 0.25 * (1 - share(F.coalesce(error, F.lit(1.0)) / WORST_ERROR)) + 0.15 * even), 2)


def sheet_drift(summary: DataFrame) -> DataFrame:
    """Per sheet: the larger p95 of the normalised errors of both axes (1 if unknown)."""
    return summary.groupBy("sheet_id").agg(F.coalesce(F.max("normalised_p95"), F.lit(1.0)).alias("drift"))


def fill_missing_curves(rows: DataFrame, reach: int = 2) -> DataFrame:
    """Curves (sheet_id, axis, index, offset, reliable): an unreliable curve takes the mean offset of
    the nearest reliable ones within `reach` on either side."""
    order = Window.partitionBy("sheet_id", "axis").orderBy("index")
    sample = F.when(F.col("reliable"), F.struct(F.col("index").alias("i"), F.col("offset").alias("o")))
    rows = rows.withColumns({
        "_low": F.last(sample, True).over(order.rangeBetween(-reach, -1)), "_high": F.first(sample, True).over(order.rangeBetween(1, reach))})
    mean = F.when(F.col("_low").isNotNull() & F.col("_high").isNotNull(), (F.col("_low.o") + F.col("_high.o")) / 2).otherwise(F.coalesce("_low.o", "_high.o"))
    return rows.withColumn("offset", F.when(F.col("reliable"), F.col("offset")).otherwise(mean)).drop("_low", "_high")


def monotonic(rows: DataFrame, least_gap: float, largest_gap: float = float("inf")) -> DataFrame:
    """Boundaries (sheet_id, axis, index, position, expected, confidence) made ascending: of the first
    two neighbours that are too close or too far apart the less confident goes back to where it was
    expected, again and again, at most twice for each boundary.

    Each round depends on the one before, so it runs in Python, over one axis of one sheet (32
    boundaries) at a time."""

    def repair(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("index").reset_index(drop=True)
        position, confidence = group["position"].to_numpy(float).copy(), group["confidence"].to_numpy(float).copy()
        moved = np.zeros(len(group), bool)
        for _ in range(2 * len(group)):
            gaps = np.diff(position)
            wrong = np.flatnonzero((gaps < least_gap) | (gaps > largest_gap))
            free = [k for k in (wrong[0], wrong[0] + 1) if not moved[k]] if len(wrong) else []
            if not free:
                break
            weak = min(free, key=lambda k: confidence[k])
            position[weak], confidence[weak], moved[weak] = group["expected"][weak], 0.0, True
        return group.assign(position=position, confidence=confidence)

    return rows.groupBy("sheet_id", "axis").applyInPandas(repair, rows.schema)


def stages_total(seconds: list[Column]) -> Column:
    """The sum of stage timings, those that are missing as nothing."""
    out = F.lit(0.0)
    for s in seconds:
        out = out + F.coalesce(s, F.lit(0.0))
    return out


def grid_edges(boxes: DataFrame) -> DataFrame:
    """Per sheet: the sorted distinct edges of its boxes (x1, y1, x2, y2)."""
    edges = lambda a, b: F.array_sort(F.array_union(F.collect_set(a), F.collect_set(b)))
    return boxes.groupBy("sheet_id").agg(edges("x1", "x2").alias("x_edges"), edges("y1", "y2").alias("y_edges"))


