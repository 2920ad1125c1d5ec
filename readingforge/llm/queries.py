"""The registered queries: each operator over the whole of its tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact_dedup, langid, licenses, mixing, neardup, oracle, pii, quality, secrets, tokens
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs)).withColumnRenamed("id", "doc_id")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.concat_ws(",", "sentences").alias("sentences"), F.concat_ws(",", "licenses").alias("licenses"), "n_unknown")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: The setting that names the folder of stored token counts.  Without it every run starts an empty one.
TOKEN_CACHE = "spark.readingforge.tokenCache"


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]
    out = tokens.token_counts(table(spark, sf_dir, "documents"), *files, spark.conf.get(TOKEN_CACHE, None))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


#: The setting that holds the secret key of pseudonyms.  A session without one gets a key of its own.
PSEUDONYM_KEY = "spark.readingforge.pseudonymKey"


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    if not spark.conf.get(PSEUDONYM_KEY, None):
        spark.conf.set(PSEUDONYM_KEY, uuid.uuid4().hex + uuid.uuid4().hex)
    out = pii.pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get(PSEUDONYM_KEY))
    count = lambda kind: F.size(F.filter("values", lambda x: x["kind"] == kind)).cast("long")
    return out.select(F.col("id").alias("doc_id"), "text", *[count(k).alias(f"n_{k}") for k in pii.KINDS])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"), secrets.train(secrets.sample_findings(spark)))
    return out.select(F.col("id").alias("doc_id"), "n", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").cast("long").alias("length"), "before", "score", "is_secret")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_quality": op3_quality,
    "op4_token_counts": op4_token_counts,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_secret_scan": op7_secret_scan,
    "op8_decontamination": op8_decontamination,
    "op9_source_mix": op9_source_mix,
    "op10_near_dedup": op10_near_dedup,
}
ORACLE_SQL: dict[str, str] = oracle.SQL
