"""Consensus among recognition variants and doubts about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import readings as R
from ..schema import MIN_CONFIDENCE, MINOR_DELTA, VARIANTS


def vote(variants: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: consensus, agreement_count, average_confidence, ambiguous.  `variants` has text,
    confidence (a decimal, so that means tie exactly) and ord.  Most votes win, then the higher
    mean confidence, then the text seen first; ambiguous tells that votes tied."""
    texts = variants.groupBy(*keys, "text").agg(F.count(F.lit(1)).alias("votes"), F.avg("confidence").alias("mean"), F.min("ord").alias("first"))
    best = F.struct(F.col("votes"), F.col("mean"), (-F.col("first")).alias("early"), F.col("text"))
    # The best is a maximum, so it needs no sort; ties are counted beside it.
    tops = texts.groupBy(*keys).agg(F.max(best).alias("best"), F.max("votes").alias("most"), F.sort_array(F.collect_list("votes"), asc=False).alias("all"))
    return tops.select(
        *keys, F.col("best.text").alias("consensus"), F.col("most").cast("int").alias("agreement_count"), F.col("best.mean").alias("average_confidence"),
        F.coalesce(F.get("all", F.lit(1)) == F.col("most"), F.lit(False)).alias("ambiguous"))


def material_reasons(reasons: Column, agreement: Column, confidence: Column, variants: Column) -> Column:
    """Concerns about recognition that a person has to confirm, in order, without repeats."""
    changed = F.filter(variants, lambda v: (R.clean(v["raw_text"]) != "") & (R.clean(v["raw_text"]) != F.coalesce(v["text"], F.lit(""))))
    first = F.get(F.array_sort(changed, lambda a, b: a["ord"] - b["ord"]), F.lit(0))
    raised = F.array(
        F.when(agreement < VARIANTS, F.concat(F.lit("OCR variants disagree ("), agreement.cast("string"), F.lit(f"/{VARIANTS} agreement)."))),
        F.when(confidence < MIN_CONFIDENCE, F.concat(F.lit("OCR confidence is low ("), R.shown(confidence * 100), F.lit("%)."))),
        F.when(F.size(changed) > 0, F.concat(F.lit("The "), first["variant"], F.lit(" OCR text '"), R.clean(first["raw_text"]), F.lit("' required character normalization."))),
    )
    own = F.coalesce(reasons, F.expr("cast(array() as array<string>)"))
    return F.array_distinct(F.filter(F.concat(own, F.array_compact(raised)), lambda x: x != ""))


def minor_disagreement(reasons: Column, agreement: Column, confidence: Column, variants: Column, numeric: Column, error: Column) -> Column:
    """Whether two of three variants support the value and the third is within a tenth of it, all
    without repair and with confidence."""
    value = lambda v: v["text"].try_cast("double")
    near = lambda v, d: F.coalesce(F.abs(value(v) - numeric) <= d, F.lit(False))
    return F.coalesce(
        (agreement == VARIANTS - 1) & (confidence >= MIN_CONFIDENCE) & error.isNull() & numeric.isNotNull()
        & (F.size(F.coalesce(reasons, F.expr("cast(array() as array<string>)"))) == 0) & (F.size(variants) == VARIANTS)
        & F.forall(variants, lambda v: (R.clean(v["raw_text"]) == F.coalesce(v["text"], F.lit(""))) & near(v, MINOR_DELTA + 1e-9))
        & (F.size(F.filter(variants, lambda v: near(v, 1e-9))) == VARIANTS - 1), F.lit(False))


def assemble(recognised: DataFrame, keys: list[str]) -> DataFrame:
    """Cells from recognised variants (keys, reading_type, variant, ord, raw_text, confidence): the
    variants in order, the consensus of their normalised texts, and its correction."""
    rows = recognised.withColumn("text", R.normalise(R.clean(F.col("raw_text")))).withColumn("confidence", F.col("confidence").cast("decimal(8,4)"))
    best = vote(rows, keys)
    variant = F.struct("variant", "ord", "raw_text", "text", F.col("confidence").cast("double").alias("confidence"))
    lists = rows.groupBy(*keys, "reading_type").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("o"), variant.alias("v")))).alias("all"))
    out = lists.join(best, keys).withColumn("variants", F.transform("all", lambda x: x["v"])).withColumn("c", R.correct(F.col("consensus"), F.col("reading_type")))
    doubts = F.array_compact(F.array(
        F.when(F.col("ambiguous"), "OCR consensus is tied."), F.when(F.col("c.needs_review"), F.concat(F.lit("Correction status: "), F.col("c.status"), F.lit(".")))))
    return out.select(
        *keys, "reading_type", "variants", F.col("consensus").alias("consensus_prediction"), "agreement_count",
        F.round("average_confidence", 4).cast("double").alias("average_consensus_confidence"), "ambiguous", F.col("c.corrected_text").alias("final_value"),
        F.col("c.status").alias("postprocessing_status"), F.col("c.candidates").alias("candidate_interpretations"), doubts.alias("ocr_uncertainty_reasons"))


def variant_pivot(rows: DataFrame, keys: list[str], variants: list[str]) -> DataFrame:
    """Per cell: the text of each variant, whether any is right, and whether the consensus is.
    `rows` has variant, text, expected and consensus."""
    right = F.col("text") == F.col("expected")
    return rows.groupBy(*keys).pivot("variant", variants).agg(F.max("text")).join(
        rows.groupBy(*keys).agg(F.bool_or(right).alias("any_correct"), F.bool_or(F.col("consensus") == F.col("expected")).alias("consensus_correct")), keys)


def variant_accuracy(rows: DataFrame) -> DataFrame:
    """Per variant: n, correct, accuracy, decimal_errors, mean confidence, and that of right and
    wrong texts (0 where there are none)."""
    right = F.col("text") == F.col("expected")
    mean = lambda cond: F.coalesce(F.avg(F.when(cond, F.col("confidence"))), F.lit(0.0))
    return rows.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(right).alias("correct"), R.safe_ratio(F.count_if(right), F.count(F.lit(1))).alias("accuracy"),
        F.count_if(R.decimal_only_error(F.col("text"), F.col("expected"))).alias("decimal_errors"), F.avg("confidence").alias("mean_confidence"),
        mean(right).alias("mean_confidence_correct"), mean(~right).alias("mean_confidence_wrong"))
