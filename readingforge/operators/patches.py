"""Keyed corrections: sparse patches, review actions, table edits.

A patch may set the value (has_value tells a given null from none), the blank mark and the human
verification of one cell.  The patches of a cell are folded in order within one row, each seeing
the one before; a patch that breaks a rule is rejected whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import readings as R

CELL = ["sheet_id", "filename"]
# Messages of rejected patches.
UNBLANK = "A value is needed to unmark a blank cell."
UNKNOWN = "Unknown cell."


def _applied(state: Column, patch: Column, kind: Column) -> Column:
    """The state (value, blank, verified, changed, touched, errors) after one patch."""
    blank = F.coalesce(patch["is_blank"], state["blank"])
    checked = R.validate(patch["final_value"], kind, False)
    rejected = (
        F.when(blank, F.lit(None).cast("string")).when(patch["has_value"], checked["error"])
        .when(state["blank"] & ~blank, F.lit(UNBLANK)))
    value = F.when(blank, "").when(patch["has_value"], checked["normalized_value"]).otherwise(state["value"])
    verified = F.coalesce(patch["human_verified"], state["verified"])
    edited = (value != state["value"]) | (blank != state["blank"])
    touched = edited | (verified != state["verified"])
    keep = rejected.isNotNull()
    pick = lambda new, old: F.when(keep, old).otherwise(new)
    return F.struct(
        pick(value, state["value"]).alias("value"), pick(blank, state["blank"]).alias("blank"), pick(verified, state["verified"]).alias("verified"),
        (state["changed"] | F.coalesce(~keep & edited, F.lit(False))).alias("changed"), (state["touched"] | F.coalesce(~keep & touched, F.lit(False))).alias("touched"),
        F.concat(state["errors"], F.array_compact(F.array(F.when(keep, F.struct(patch["seq"].alias("seq"), rejected.alias("error")))))).alias("errors"))


def patched(cells: DataFrame, patches: DataFrame) -> DataFrame:
    """`cells` after their patches in order of seq, with touched (whether a patch changed the value, the
    blank mark or the verification) and patch_errors (seq, error).  One join."""
    patch = F.struct("seq", "has_value", F.col("final_value").alias("final_value"), "is_blank", "human_verified")
    listed = patches.groupBy(*CELL).agg(F.array_sort(F.collect_list(patch)).alias("_patches"))
    none = F.expr("cast(array() as array<struct<seq:int,error:string>>)")
    start = F.struct(
        F.coalesce("final_value", F.lit("")).alias("value"), F.col("is_blank").alias("blank"), F.col("human_verified").alias("verified"), F.lit(False).alias("changed"),
        F.lit(False).alias("touched"), none.alias("errors"))
    folded = cells.join(listed, CELL, "left").withColumn(
        "_s", F.when(F.col("_patches").isNotNull(), F.aggregate("_patches", start, lambda s, p: _applied(s, p, F.col("reading_type")))))
    done = F.col("_s").isNotNull()
    new = {
        "final_value": F.when(done, F.col("_s.value")).otherwise(F.col("final_value")), "is_blank": F.when(done, F.col("_s.blank")).otherwise(F.col("is_blank")),
        "human_verified": F.when(done, F.col("_s.verified")).otherwise(F.col("human_verified")),
        "postprocessing_status": F.when(done & F.col("_s.changed"), "manually_corrected").otherwise(F.col("postprocessing_status")),
    }
    return folded.select(
        *[new.get(c, F.col(c)).alias(c) for c in cells.columns], F.coalesce("_s.touched", F.lit(False)).alias("touched"), F.coalesce("_s.errors", none).alias("patch_errors"))


def apply_patches(cells: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells after their patches, errors (sheet_id, filename, seq, error), and the changed cells
    (sheet_id, filename).  The caller verifies the cells once, afterwards."""
    out = patched(cells, patches)
    wrong = out.select(*CELL, F.explode("patch_errors").alias("e")).select(*CELL, "e.seq", "e.error")
    unknown = patches.join(cells.select(*CELL), CELL, "left_anti").select(*CELL, "seq", F.lit(UNKNOWN).alias("error"))
    return out.select(cells.columns), wrong.unionByName(unknown), out.filter("touched").select(*CELL)


def from_actions(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Review actions (sheet_id, seq, filename, action, corrected_value) as patches and errors.
    Actions: confirm, correct, blank, pending (none)."""
    known = F.col("action").isin("confirm", "correct", "blank")
    value = F.when(F.col("action") == "correct", F.col("corrected_value"))
    out = actions.filter(known).select(
        "sheet_id", "seq", "filename", (F.col("action") == "correct").alias("has_value"), value.alias("final_value"),
        F.when(F.col("action") == "blank", True).when(F.col("action") == "correct", False).alias("is_blank"), F.lit(True).alias("human_verified"))
    errors = actions.filter(~known & (F.col("action") != "pending")).select(*CELL, "seq", F.concat(F.lit("Unknown review action: "), "action").alias("error"))
    return out, errors


def from_quick_controls(controls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quick controls (sheet_id, seq, filename, corrected_value, confirm_current, mark_blank), of
    which at most one may be used, as patches and errors."""
    corrected = R.clean(F.col("corrected_value")) != ""
    used = corrected.cast("int") + F.col("confirm_current").cast("int") + F.col("mark_blank").cast("int")
    rows = controls.withColumn("_n", used)
    out = rows.filter("_n = 1").select(
        "sheet_id", "seq", "filename", corrected.alias("has_value"), F.when(corrected, F.col("corrected_value")).alias("final_value"),
        F.when(F.col("mark_blank"), True).when(corrected, False).alias("is_blank"), F.lit(True).alias("human_verified"))
    return out, rows.filter("_n > 1").select(*CELL, "seq", F.lit("Choose only one: a correction, a confirmation or blank.").alias("error"))


def from_table_edits(edits: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edited rows (sheet_id, seq, day, point, and for either type a value and a blank mark, each
    with a has_ flag) as patches and errors; only fields that were given count."""
    sides = ", ".join(f"'{k}', has_{k}, {k}, has_{k}_blank, {k}_blank" for k in ("temperature", "humidity"))
    lines = edits.select("sheet_id", "seq", "day", "point", F.expr(f"stack(2, {sides}) as (reading_type, has_value, final_value, has_blank, blank)")).filter("has_value OR has_blank")
    joined = lines.join(cells.select("sheet_id", "day", "point", "reading_type", "filename"), ["sheet_id", "day", "point", "reading_type"], "left")
    out = joined.filter("filename IS NOT NULL").select(
        "sheet_id", "seq", "filename", "has_value", "final_value", F.when(F.col("has_blank"), F.col("blank")).alias("is_blank"), F.lit(True).alias("human_verified"))
    lost = joined.filter("filename IS NULL").select("sheet_id", F.lit(None).cast("string").alias("filename"), "seq", F.concat(R.cell_label(F.col("day"), F.col("point"), F.col("reading_type")), F.lit(" is not on the form.")).alias("error"))
    return out, lost
