"""Canonical tables made from the general tables, so that every rule can run on them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import filename


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, in spark.checkpoint.dir.  A local session that names
    none gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        base = "file://" + tempfile.mkdtemp(prefix="readingforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/readingforge/{name}-{uuid.uuid4().hex}"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as readings: a sheet a month, a point by supplier, a type by line, and the sum of
    quantities as value."""
    t = table(spark, sf_dir, "lineitem")
    rows = t.select(
        F.date_format("l_shipdate", "yyyy-MM").alias("sheet_id"), F.dayofmonth("l_shipdate").alias("day"), (F.col("l_suppkey") % 8 + 1).cast("int").alias("point"),
        F.when(F.col("l_linenumber") % 2 == 0, "temperature").otherwise("humidity").alias("reading_type"), F.col("l_quantity").cast("decimal(18,2)").alias("q"))
    cells = rows.groupBy("sheet_id", "day", "point", "reading_type").agg(F.sum("q").cast("double").alias("value"))
    return cells.withColumn("filename", filename(F.col("day"), F.col("point"), F.col("reading_type")))


def mark() -> Column:
    """A number of a cell, by which spellings and flags vary."""
    return F.col("day") * 7 + F.col("point") * 3 + F.substring("sheet_id", 6, 2).cast("int") + F.when(F.col("reading_type") == "temperature", 1).otherwise(0)


def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with `text`: most have one decimal, some lack the dot, have two decimals, nothing,
    or a leading zero."""
    plain = F.concat(F.col("value").cast("bigint").cast("string"), F.lit("."), (F.col("mark") % 10).cast("string"))
    kind = F.col("mark") % 13
    text = (
        F.when(kind == 0, F.replace(plain, F.lit("."), F.lit(""))).when(kind == 1, F.concat(plain, F.lit("5"))).when(kind == 2, "")
        .when(kind == 3, F.concat(F.lit("0"), plain)).otherwise(plain))
    return readings(spark, sf_dir).withColumn("mark", mark()).withColumn("text", text)


def cell_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell results: every eleventh is blank, every fifth seen by a person, every fourth has one
    variant that disagrees by a tenth, and confidences vary."""
    m = F.col("mark")
    off = F.when(m % 4 == 3, F.concat(F.regexp_replace("text", r"[0-9]\z", ""), ((m + 1) % 10).cast("string"))).otherwise(F.col("text"))
    variant = lambda name, k, t: F.struct(F.lit(name).alias("variant"), F.lit(k).alias("ord"), t.alias("raw_text"), t.alias("text"), F.lit(0.9).alias("confidence"))
    none = F.expr("cast(array() as array<string>)")
    return spelled(spark, sf_dir).select(
        "sheet_id", "filename", "day", "point", "reading_type", F.array(variant("original", 0, F.col("text")), variant("grayscale", 1, F.col("text")), variant("contrast", 2, off)).alias("variants"),
        F.col("text").alias("consensus_prediction"), F.when(m % 4 == 3, 2).otherwise(3).alias("agreement_count"), ((F.lit(80) + m % 20) / 100).alias("average_consensus_confidence"),
        F.col("text").alias("final_value"), (m % 11 == 0).alias("is_blank"), (m % 5 == 0).alias("human_verified"), none.alias("ocr_uncertainty_reasons"),
        F.lit("valid_unchanged").alias("postprocessing_status"), none.alias("candidate_interpretations"))


def confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days confirmed: those of which the order dates of a month have no order of priority 1."""
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("sheet_id"), F.dayofmonth("o_orderdate").alias("day"), "o_orderkey")
    return o.groupBy("sheet_id", "day").agg(F.min("o_orderkey").alias("k")).filter("k % 3 <> 0").select("sheet_id", "day")


def patch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as patches: the cell by date and customer, the content by order key."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    day, point = F.dayofmonth("o_orderdate"), (F.col("o_custkey") % 8 + 1).cast("int")
    value = F.when(k % 4 == 0, F.concat((k % 60).cast("string"), F.lit("."), (k % 10).cast("string"))).when(k % 4 == 1, (k % 600).cast("string"))
    return o.select(
        F.date_format("o_orderdate", "yyyy-MM").alias("sheet_id"), k.cast("int").alias("seq"), filename(day, point, F.when(k % 2 == 0, "temperature").otherwise("humidity")).alias("filename"),
        (k % 4 < 2).alias("has_value"), value.alias("final_value"), F.when(k % 7 == 0, True).when(k % 7 == 1, False).alias("is_blank"), F.when(k % 3 == 0, True).alias("human_verified"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as variants: a cell is a user's day, the first event of a type its text."""
    t = table(spark, sf_dir, "events").withColumn("day", F.dayofmonth("ts"))
    first = t.groupBy("user_id", "day", "event_type").agg(F.min_by("value", "event_id").alias("value"))
    names = ["view", "click", "purchase", "signup", "error"]
    return first.select(
        "user_id", "day", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("event_type")).cast("int").alias("ord"),
        (F.floor("value") % 4).cast("string").alias("text"), (F.col("value") / 500).cast("decimal(6,4)").alias("confidence"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as benchmark rows: quality is the truth, length the prediction."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = d.join(table(spark, sf_dir, "labels"), "doc_id")
    good, guess = F.col("quality") == 1, F.col("n_chars") > 800
    review = F.col("n_chars") % 5 == 0
    return rows.select(
        F.col("doc_id").cast("string").alias("filename"), "lang", "source", (good == guess).alias("final_value_correct"), (good == (F.col("n_chars") > 400)).alias("consensus_correct"),
        (good == (F.col("n_chars") > 1600)).alias("postprocessing_correct"), review.alias("needs_review"), (F.col("toxic") == 1).alias("expected_blank"), (F.col("n_chars") % 9 == 0).alias("predicted_blank"),
        (~review & (good == guess)).alias("correct_automatic_acceptance"), (~review & (good != guess)).alias("unsafe_automatic_acceptance"), (F.col("n_chars") % 17 == 0).alias("crop_alignment_failure"),
        guess.cast("string").alias("final_value"))


def methods(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two methods over the same cells, by return flag, and a drift for each sheet."""
    t = table(spark, sf_dir, "lineitem")
    rows = t.select(
        F.date_format("l_shipdate", "yyyy-MM").alias("sheet_id"), F.concat_ws("_", F.date_format("l_shipdate", "yyyy-MM"), F.dayofmonth("l_shipdate"), F.col("l_suppkey") % 8).alias("filename"),
        F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("bigint").alias("q"), F.col("l_orderkey").alias("k"))
    cells = rows.groupBy("sheet_id", "filename").agg(
        F.sum(F.when(F.col("flag") == "N", F.col("q"))).alias("n"), F.sum(F.when(F.col("flag") != "N", F.col("q"))).alias("r"), F.min("k").alias("k"))

    def method(v: str) -> DataFrame:
        x = F.coalesce(F.col(v), F.lit(0))
        review = x % 4 == 0
        return cells.select(
            "sheet_id", "filename", x.cast("string").alias("final_value"), (x == 0).alias("predicted_blank"), (x % 6 == 0).alias("blocks_export"), review.alias("needs_review"),
            (~review & (x % 6 != 0)).alias("automatic_acceptance"), ((x + F.col("k")) % 3 != 0).alias("final_value_correct"))

    drift = cells.groupBy("sheet_id").agg((F.sum(F.coalesce("r", F.lit(0))) / F.sum(F.coalesce("n", F.lit(0)) + F.coalesce("r", F.lit(0)))).alias("drift"))
    return method("n"), method("r"), drift
