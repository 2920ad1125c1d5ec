"""Quality metrics, comparisons of two methods, policies and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.readings import safe_ratio
from ..schema import DRIFT_THRESHOLD

FLAGS = ["final_value_correct", "consensus_correct", "postprocessing_correct", "needs_review", "expected_blank", "predicted_blank", "correct_automatic_acceptance", "unsafe_automatic_acceptance", "crop_alignment_failure"]


def right(text: Column, blank: Column, expected: Column, expected_blank: Column) -> Column:
    """A blank is right if it is predicted so and has no text; a value if its text is equal."""
    return F.when(expected_blank, blank & (text == "")).otherwise(~blank & (text == expected))


def evaluate(labels: DataFrame, results: DataFrame, key: str = "filename") -> DataFrame:
    """Results with the truth, joined only now: correctness, acceptance and alignment flags.
    Both sides must have the same keys; see `unmatched`."""
    truth = labels.select(key, "item_number", "expected_value", "expected_blank")
    rows = results.join(truth, key)
    is_right = lambda c: right(F.col(c), F.col("is_blank"), F.col("expected_value"), F.col("expected_blank"))
    automatic = ~F.col("needs_review") & ~F.col("blocks_export")
    nothing = ~F.col("expected_blank") & (F.col("consensus_prediction") == "") & (F.col("final_value") == "") & F.forall("variants", lambda v: F.coalesce(v["text"], F.lit("")) == "")
    failed = F.col("alignment_failure") if "alignment_failure" in results.columns else F.lit(False)
    return rows.withColumns({
        "predicted_blank": F.col("is_blank"), "final_value_correct": is_right("final_value"), "consensus_correct": is_right("consensus_prediction"),
        "postprocessing_correct": is_right("proposed_final_value" if "proposed_final_value" in results.columns else "final_value"),
        "automatic_acceptance": automatic, "crop_alignment_failure": failed | nothing,
    }).withColumns({"correct_automatic_acceptance": automatic & F.col("final_value_correct"), "unsafe_automatic_acceptance": automatic & ~F.col("final_value_correct")})


def unmatched(a: DataFrame, b: DataFrame, key: str = "filename") -> DataFrame:
    """Keys that aren't exactly once on either side, for a guard before a strict join."""
    count = lambda df, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    both = count(a, "a").join(count(b, "b"), key, "full")
    return both.filter("a IS NULL OR b IS NULL OR a <> 1 OR b <> 1")


def _metrics(inputs: Column | None = None) -> list[Column]:
    n, of = F.count(F.lit(1)), lambda c: F.count_if(F.col(c))
    both = F.count_if(F.col("expected_blank") & F.col("predicted_blank"))
    false_reviews = F.count_if(F.col("needs_review") & F.col("final_value_correct"))
    return [
        n.alias("cell_count"), of("final_value_correct").alias("final_correct"), safe_ratio(of("final_value_correct"), n).alias("final_accuracy"),
        safe_ratio(of("consensus_correct"), n).alias("consensus_accuracy"), safe_ratio(of("postprocessing_correct"), n).alias("postprocessing_accuracy"),
        of("correct_automatic_acceptance").alias("correct_automatic_acceptances"), of("unsafe_automatic_acceptance").alias("unsafe_automatic_acceptances"),
        of("needs_review").alias("review_count"), safe_ratio(of("needs_review"), n).alias("review_rate"),
        safe_ratio(of("needs_review") - false_reviews, of("needs_review")).alias("review_precision"), false_reviews.alias("false_review_count"),
        of("expected_blank").alias("expected_blank_count"), of("predicted_blank").alias("predicted_blank_count"),
        safe_ratio(both, of("predicted_blank")).alias("blank_precision"), safe_ratio(both, of("expected_blank")).alias("blank_recall"),
        of("crop_alignment_failure").alias("crop_alignment_failures"),
    ]


VARIANT_NAMES = ("original", "grayscale", "contrast")


def variant_rates(rows: DataFrame, *by: str) -> DataFrame:
    """How often each variant alone was right, how many inputs the recogniser got, how many a cell, and
    how many were saved against all variants of each filled cell.  `rows` has expected_value and variants
    (variant, text)."""
    n, inputs = F.count(F.lit(1)), F.coalesce(F.sum(F.size("variants")), F.lit(0))
    right = lambda v: F.count_if(F.exists("variants", lambda x: (x["variant"] == v) & (x["text"] == F.col("expected_value"))))
    filled = F.count_if(F.size("variants") > 0)
    return rows.groupBy(*by).agg(
        n.alias("cell_count"), *[safe_ratio(right(v), n).alias(f"{v}_accuracy") for v in VARIANT_NAMES], inputs.alias("ocr_input_count"), safe_ratio(inputs, n).alias("average_ocr_inputs_per_cell"),
        F.greatest(len(VARIANT_NAMES) * filled - inputs, F.lit(0)).alias("ocr_inputs_saved"))


def quality_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Accuracy, acceptance, review and blank metrics, overall or by columns; ratios to six
    places, null where there is nothing to divide by."""
    return rows.groupBy(*by).agg(*_metrics())


def grouped_metrics(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """The metrics overall and by each dimension alone, from one pass: dimension, value, metrics."""
    sets = [[], *[[F.col(d)] for d in dimensions]]
    out = rows.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(F.grouping_id().alias("_g"), *_metrics())
    dimension, value = F.lit("overall"), F.lit(None).cast("string")
    for k, d in enumerate(dimensions):
        own = (2 ** len(dimensions) - 1) ^ (1 << (len(dimensions) - 1 - k))
        dimension = F.when(F.col("_g") == own, d).otherwise(dimension)
        value = F.when(F.col("_g") == own, F.col(d).cast("string")).otherwise(value)
    return out.select(dimension.alias("dimension"), value.alias("value"), *[c for c in out.columns if c not in (*dimensions, "_g")])


def compare(a: DataFrame, b: DataFrame, key: str = "filename") -> DataFrame:
    """Per item: how method b differs from a in correctness and in disposition."""
    side = lambda df, p: df.select(key, F.col("final_value_correct").alias(f"{p}_ok"), F.col("needs_review").alias(f"{p}_review"), F.col("final_value").alias(f"{p}_value"))
    rows = side(a, "a").join(side(b, "b"), key)
    kind = F.when(F.col("a_ok") & F.col("b_ok"), "both_correct").when(F.col("b_ok"), "improved").when(F.col("a_ok"), "regressed").otherwise("both_wrong")
    move = (
        F.when(F.col("a_review") & ~F.col("b_review"), "review_to_automatic").when(~F.col("a_review") & F.col("b_review"), "automatic_to_review")
        .when(F.col("a_review"), "review").otherwise("automatic"))
    return rows.withColumns({"outcome": kind, "disposition": move, "value_changed": F.col("a_value") != F.col("b_value")})


def choose(drift: Column) -> Column:
    """The method for a sheet by its drift alone."""
    return F.when(F.coalesce(drift, F.lit(1.0)) >= DRIFT_THRESHOLD, "calibrated").otherwise("fixed")


def hybrid(fixed: DataFrame, calibrated: DataFrame, drift: DataFrame, key: str = "filename") -> DataFrame:
    """The rows of the method chosen per sheet; disagreement between the methods, and choosing the
    calibrated one, ask for a confirmation, which blocks and clears acceptance.  Truth isn't read."""
    used = ["final_value", "predicted_blank", "blocks_export", "automatic_acceptance"]
    other = calibrated.select(key, *[F.col(c).alias(f"c_{c}") for c in used])
    rows = fixed.join(other, key).join(drift.select("sheet_id", "drift"), "sheet_id", "left")
    rows = rows.withColumn("selected_geometry", choose(F.col("drift")))
    rows = rows.withColumns({
        "value_disagreement": F.col("final_value") != F.col("c_final_value"), "blank_disagreement": F.col("predicted_blank") != F.col("c_predicted_blank"),
        "blocking_disagreement": (F.col("blocks_export") & F.col("c_automatic_acceptance")) | (F.col("c_blocks_export") & F.col("automatic_acceptance")),
        "geometry_confirmation": F.col("selected_geometry") == "calibrated",
    })
    ask = F.col("value_disagreement") | F.col("blank_disagreement") | F.col("blocking_disagreement") | F.col("geometry_confirmation")
    pick = lambda c: F.when(F.col("geometry_confirmation"), F.col(f"c_{c}")).otherwise(F.col(c))
    return rows.select(
        key, "sheet_id", "selected_geometry", pick("final_value").alias("final_value"), pick("predicted_blank").alias("predicted_blank"),
        (ask | pick("blocks_export")).alias("blocks_export"), (~ask & pick("automatic_acceptance")).alias("automatic_acceptance"),
        "value_disagreement", "blank_disagreement", "blocking_disagreement", "geometry_confirmation", ask.alias("needs_confirmation"))


def hybrid_counters(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_if(F.col("selected_geometry") == "fixed").alias("fixed_selected"), F.count_if(F.col("selected_geometry") == "calibrated").alias("calibrated_selected"),
        *[F.count_if(F.col(c)).alias(c) for c in ("value_disagreement", "blank_disagreement", "blocking_disagreement", "geometry_confirmation")])


def blank_confusion(rows: DataFrame) -> DataFrame:
    """Per mode and stage: precision and recall of blanks and the names of what went wrong.  `rows`
    has mode, filename, expected_blank, blank_before, blank_after."""
    long = rows.select("mode", "filename", "expected_blank", F.expr("stack(2, 'before', blank_before, 'after', blank_after) as (stage, blank)"))
    both = F.count_if(F.col("expected_blank") & F.col("blank"))
    names = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("filename"))))
    return long.groupBy("mode", "stage").agg(
        both.alias("true_blanks"), safe_ratio(both, F.count_if("blank")).alias("blank_precision"), safe_ratio(both, F.count_if("expected_blank")).alias("blank_recall"),
        names(F.col("blank") & ~F.col("expected_blank")).alias("false_blanks"), names(~F.col("blank") & F.col("expected_blank")).alias("missed_blanks"))


def timing(trials: DataFrame) -> DataFrame:
    """Mean times of repeated trials; same_inputs tells that all trials had as many inputs."""
    return trials.groupBy("geometry_mode").agg(
        (F.count_distinct("ocr_input_count") == 1).alias("same_inputs"), F.max("ocr_input_count").alias("ocr_input_count"),
        F.avg("ocr_time_seconds").alias("ocr_time_seconds"), F.avg("processing_time_seconds").alias("processing_time_seconds"))


def gates(summary: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """`summary` with one flag for each named SQL condition, and passed if all hold."""
    flags = {n: F.coalesce(F.expr(c), F.lit(False)) for n, c in conditions.items()}
    out = summary.withColumns(flags)
    return out.withColumn("passed", F.forall(F.array(*[F.col(n) for n in conditions]), lambda x: x))


def recommend(guards: list[Column]) -> Column:
    """The calibrated method only if every guard holds."""
    return F.when(F.forall(F.array(*[F.coalesce(g, F.lit(False)) for g in guards]), lambda x: x), "calibrated").otherwise("fixed")


def label_template(identities: DataFrame, existing: DataFrame, trusted: DataFrame) -> DataFrame:
    """Identities with labels: an existing label wins, then a trusted one of the same cell and
    sheet, else empty."""
    own = lambda df, p: df.select("sheet_id", F.col("filename"), F.col("expected_value").alias(f"{p}_value"), F.col("expected_blank").alias(f"{p}_blank"))
    rows = identities.join(own(existing, "e"), ["sheet_id", "filename"], "left").join(own(trusted, "t"), ["sheet_id", "filename"], "left")
    has = lambda p: F.coalesce(F.col(f"{p}_blank"), F.lit(False)) | (F.coalesce(F.col(f"{p}_value"), F.lit("")) != "")
    source = F.when(has("e"), "existing").when(has("t"), "trusted").otherwise("missing")
    pick = lambda c: F.when(has("e"), F.col(f"e_{c}")).when(has("t"), F.col(f"t_{c}"))
    return rows.withColumns({"expected_value": pick("value"), "expected_blank": pick("blank"), "label_source": source}).drop("e_value", "e_blank", "t_value", "t_blank")


def label_errors(rows: DataFrame, identities: DataFrame) -> DataFrame:
    """All that is wrong with a set of labels: filename, error.  Labels of several sheets are named sheet__filename."""
    from ..functions import readings as R

    error = lambda df, text: df.select("filename", F.lit(text).alias("error"))
    value, blank = R.clean(F.col("expected_value")), F.coalesce("expected_blank", F.lit(False))
    bad = R.validate(value, F.col("reading_type"), False)["error"]
    return (
        error(identities.join(rows, "filename", "left_anti"), "missing").unionByName(error(rows.join(identities, "filename", "left_anti"), "unknown"))
        .unionByName(error(rows.groupBy("filename").count().filter("count > 1"), "repeated"))
        .unionByName(error(rows.filter(blank & (value != "")), "value and blank")).unionByName(error(rows.filter(~blank & (value == "")), "no label"))
        .unionByName(error(rows.filter(~blank & (value != "") & bad.isNotNull()), "invalid value")))
