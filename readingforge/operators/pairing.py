"""Temperature and humidity side by side, grids, guards, pages and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import readings as R
from ..schema import DAYS, POINTS, grid, kind_order

KEYS = ["sheet_id", "day", "point"]


class Violation(ValueError):
    """A guard found rows that must not be."""


def guard(violations: DataFrame, message: str, shown: int = 5) -> None:
    """Raises if there are violation rows, naming a few."""
    rows = violations.limit(shown).collect()
    if rows:
        raise Violation(f"{message}: " + "; ".join(str(r.asDict()) for r in rows))


def pairs(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Per sheet, day and point: temperature_* and humidity_* of `columns`, and n_temperature and
    n_humidity, by which duplicates and missing sides show."""
    side = lambda kind: F.col("reading_type") == kind
    first = [F.min(F.when(side(k), F.col(c))).alias(f"{k}_{c}") for k in ("temperature", "humidity") for c in columns]
    count = [F.count_if(side(k)).alias(f"n_{k}") for k in ("temperature", "humidity")]
    return cells.groupBy(*KEYS).agg(*first, *count)


def pair_violations(cells: DataFrame) -> DataFrame:
    """The rows of the form that don't have exactly one cell of either type."""
    sheets = cells.select("sheet_id").distinct()
    form = F.broadcast(grid(cells.sparkSession).select("day", "point").distinct())
    counts = pairs(cells, [])
    return sheets.crossJoin(form).join(counts, KEYS, "full").select(
        *KEYS, F.coalesce("n_temperature", F.lit(0)).alias("n_temperature"), F.coalesce("n_humidity", F.lit(0)).alias("n_humidity")).filter(
        "n_temperature <> 1 OR n_humidity <> 1 OR day NOT BETWEEN 1 AND 31 OR point NOT BETWEEN 1 AND 8")


def missing_cells(cells: DataFrame) -> DataFrame:
    """The cells of the form that a sheet lacks."""
    form = F.broadcast(grid(cells.sparkSession).select("day", "point", "reading_type"))
    return cells.select("sheet_id").distinct().crossJoin(form).join(cells.select(*KEYS, "reading_type"), [*KEYS, "reading_type"], "left_anti")


def blank_mismatch(cells: DataFrame) -> DataFrame:
    """`cells` with has_blank_mismatch: the other reading of the row exists and is blank where
    this one isn't, or the reverse."""
    row = Window.partitionBy(*KEYS)
    return cells.withColumn("has_blank_mismatch", F.min("is_blank").over(row) != F.max("is_blank").over(row))


def monitoring_rows(verified: DataFrame) -> DataFrame:
    """The 248 rows of a sheet: both values, merged reasons, status."""
    fields = ["final_value", "is_blank", "human_verified", "blocks_export", "operational_severity", "filename"]
    lists = ["blocking_errors", "required_confirmation_reasons", "operational_warnings", "informational_notices", "review_categories"]
    wide = verified.groupBy(*KEYS).agg(
        *[F.min(F.when(F.col("reading_type") == k, F.col(c))).alias(f"{k}_{c}") for k in ("temperature", "humidity") for c in fields],
        *[F.min(F.when(F.col("reading_type") == k, F.col(c))).alias(f"{k}_{c}") for k in ("temperature", "humidity") for c in lists],
        F.bool_or("has_blank_mismatch").alias("has_blank_mismatch"), F.bool_or("blocks_export").alias("blocks_export"),
    )
    none = F.expr("cast(array() as array<string>)")

    def merged(c: str, unless_verified: bool = False) -> Column:
        side = lambda k: F.when(F.lit(unless_verified) & F.col(f"{k}_human_verified"), none).otherwise(F.coalesce(F.col(f"{k}_{c}"), none))
        return F.array_union(side("temperature"), side("humidity"))

    wide = wide.withColumns({
        "blocking_errors": merged("blocking_errors"), "required_confirmation_reasons": merged("required_confirmation_reasons", True),
        "operational_warnings": merged("operational_warnings"), "informational_notices": merged("informational_notices"), "review_categories": merged("review_categories"),
    })
    status = (
        F.when(F.col("blocks_export"), "Blocked").when(F.size("temperature_operational_warnings") > 0, "Operational warning")
        .when(F.size("informational_notices") > 0, "Ready with notice").otherwise("Ready"))
    return wide.withColumns({
        "row_status": status, "needs_review": F.col("blocks_export"), "has_operational_warning": F.coalesce(F.size("temperature_operational_warnings") > 0, F.lit(False)),
    }).drop(*[f"{k}_{c}" for k in ("temperature", "humidity") for c in lists])


def mapping_audit(rows: DataFrame) -> DataFrame:
    """Every reading with its workbook address: two lines a row."""
    sides = F.expr("stack(2, 'temperature', temperature_final_value, temperature_is_blank, 'humidity', humidity_final_value, humidity_is_blank) as (reading_type, value, is_blank)")
    lines = rows.select(*KEYS, sides)
    return lines.withColumn("address", R.cell_address(F.col("day"), F.col("point"), F.col("reading_type")))


def audit_violations(audit: DataFrame) -> DataFrame:
    """Sheets whose audit isn't complete, and addresses that repeat."""
    want = DAYS * POINTS * 2
    return audit.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("address").alias("addresses")).filter((F.col("n") != want) | (F.col("addresses") != want))


def one_day(cells: DataFrame, sheet_id: str, day: int) -> DataFrame:
    """The 16 cells of one day in form order."""
    own = cells.filter((F.col("sheet_id") == sheet_id) & (F.col("day") == day))
    n = own.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("point", "reading_type").alias("d")).first()
    if (n.n, n.d) != (2 * POINTS, 2 * POINTS):
        raise Violation(f"day {day} must have exactly {2 * POINTS} cells, not {n.n} ({n.d} distinct)")
    return own.orderBy("point", kind_order(F.col("reading_type")))


def page(rows: DataFrame, order: list, number: int, size: int, selected: str | None = None, key: str = "filename") -> tuple[DataFrame, int, str | None]:
    """One page of ordered rows, the page number within what exists, and the selection, which goes
    to the page's first row where it isn't on the page."""
    total = rows.count()
    number = max(1, min(number, max(1, -(-total // size))))
    out = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    keys = [r[0] for r in out.select(key).collect()]
    return out, number, selected if selected in keys else (keys[0] if keys else None)


def neighbours_in_queue(rows: DataFrame, order: str, key: str, owner: str | None = None) -> DataFrame:
    """key, previous, next in the order of an owner's queue; the ends are their own neighbours."""
    place = (Window.partitionBy(owner) if owner else Window.partitionBy(F.lit(0))).orderBy(order, key)
    return rows.select(*([owner] if owner else []), key, F.coalesce(F.lag(key).over(place), F.col(key)).alias("previous"), F.coalesce(F.lead(key).over(place), F.col(key)).alias("next"))


def item_order(rows: DataFrame) -> DataFrame:
    """By number of the item, then by method where there are several."""
    return rows.orderBy(*(["geometry_mode"] if "geometry_mode" in rows.columns else []), "item_number")


def validated_reading(value: Column, kind: Column, day: Column, point: Column) -> Column:
    """The number of a reading that goes into the form, null for a blank; anything else is an error that
    names the cell."""
    def checked(v: Column) -> Column:
        wrong = F.raise_error(F.concat(R.cell_label(day, point, kind), F.lit(": "), v["error"])).cast("double")
        return F.when(v["error"].isNotNull(), wrong).otherwise(v["numeric_value"])

    return R.let(R.validate(value, kind, True), checked)
