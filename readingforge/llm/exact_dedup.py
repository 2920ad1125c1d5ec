"""Exact dedup by a stateful stream.

Every row lands as (id, SHA-256 digest of the normalised text, variant, content locator).  A Structured
Streaming query groups the landed rows by digest and variant; its keyed state is held on disk by the
RocksDB state store, has no expiry, and retains for each key the stable identifier and the locator
of the row that stays, and the number of rows.  A digest that the state holds already, or that rows of
a call share, is a hit: before its rows land their full bytes are compared, with each other and with
those that the held locators point to.  Equal bytes have one variant of the digest, other bytes
another, so rows that share a digest but not the bytes are told apart, in one call or over many.

A call's rows are a batch, named by the caller or by a sum of hashes of their ids and digests; what has
landed under a name doesn't land again, so a call that is repeated, or was cut off, counts once.

Defined results: a null text counts as empty; a null id is lower than any other; rows that repeat
an id within a group are told apart by their locator, so exactly one row of a group stays; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filed, join_checked, keep_rows, kept, located, picked, scratch, settings, shared_path, tracked, written

#: Settings of the state store while a stream runs.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's logs take disk ahead
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


HELD = "digest binary, variant int, stays struct<id:bigint,rf_file:string,rf_row:bigint>, group_size bigint"
LANDED = "id bigint, digest binary, variant int, rf_file string, rf_row bigint"


class StreamDedup:
    """Keyed dedup state in `state_dir`.  `ingest` streams what landed since the last call through
    the state, so that a corpus can grow; a call that was cut off goes on where it stopped."""

    def __init__(self, spark: SparkSession, state_dir: str, files_per_batch: int | None = None):
        self.spark, self.dir, self.files = spark, state_dir, files_per_batch
        self.landing, self.updates = f"{state_dir}/landing", f"{state_dir}/updates"

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _there(self, path: str) -> bool:
        fs, p = self._path(path)
        return fs.exists(p)

    def landed(self, batch: str) -> DataFrame | None:
        """The rows that landed under a name."""
        path = f"{self.landing}/{batch}"
        return self.spark.read.schema(LANDED).parquet(path) if self._there(path) else None

    def land(self, rows: DataFrame, batch: str) -> DataFrame:
        """Lands `rows` (the columns of LANDED) under a name that wasn't used, whole or not at all."""
        whole, fs = f"{self.landing}/{batch}", self._path(self.dir)[0]
        if not self._there(whole):
            rows.select(*[x.split(" ")[0] for x in LANDED.split(", ")]).write.mode("overwrite").parquet(f"{self.dir}/incoming/{batch}")
            fs.mkdirs(self._path(self.landing)[1])
            if not fs.rename(self._path(f"{self.dir}/incoming/{batch}")[1], self._path(whole)[1]):
                raise OSError(f"{whole} could not be put in place")
        return self.landed(batch)

    def ingest(self) -> None:
        reader = self.spark.readStream.schema(LANDED).option("recursiveFileLookup", "true")
        if self.files:
            reader = reader.option("maxFilesPerTrigger", self.files)
        held = reader.parquet(self.landing).groupBy("digest", "variant").agg(
            F.max(F.struct("id", "rf_file", "rf_row")).alias("stays"), F.count(F.lit(1)).alias("group_size")
        )

        def emit(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.updates}/batch={n}")  # a repeated batch replaces itself

        with settings(self.spark, STATE):
            held.writeStream.outputMode("update").foreachBatch(emit).option(
                "checkpointLocation", f"{self.dir}/checkpoint"
            ).trigger(availableNow=True).start().awaitTermination()

    def held(self) -> DataFrame:
        """digest, variant, stays, group_size: both only grow from batch to batch, so the largest is the last."""
        if not self._there(self.updates):
            return self.spark.createDataFrame([], HELD)
        return self.spark.read.schema(HELD + ", batch int").parquet(self.updates).groupBy("digest", "variant").agg(
            F.max("stays").alias("stays"), F.max("group_size").alias("group_size")
        )


def _bytes_at(held: DataFrame, content: Column) -> DataFrame:
    """digest, variant, content of held rows, read where their locators point to.  `held` is written."""
    files = [r[0] for r in held.select("stays.rf_file").distinct().collect()]  # names of files, not of rows
    if not files:
        return held.select("digest", "variant", F.lit("").alias("content"))
    spark = held.sparkSession
    rows = located(spark.read.parquet(*files), "_file", "_row")
    rows = rows.select(content.alias("content"), F.col("_file").alias("rf_file"), F.col("_row").alias("rf_row"))
    keys = held.select("digest", "variant", "stays.rf_file", "stays.rf_row")
    keys.rf_path = held.rf_path
    return join_checked(rows, keys, ["rf_file", "rf_row"], "inner").select("digest", "variant", "content")


def _told_apart(slim: DataFrame, rows: DataFrame, before: DataFrame | None, digest, content: Column) -> DataFrame:
    """`slim` (id, digest, rf_file, rf_row) with the variant of each row's bytes.  `before` is what
    the state held."""
    counts = slim.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    if before is None:
        hits = written(counts.filter("n > 1").select("digest"), "hits")
    else:
        own = before.select("digest", F.lit(1).alias("known")).distinct()
        hits = written(counts.join(own, "digest", "left").filter("n > 1 OR known = 1").select("digest"), "hits")
    # Equal rows meet in a partial aggregate before anything is shuffled.
    near = join_checked(rows.withColumn("digest", digest(F.col("content"))), hits, ["digest"], "left_semi")
    texts = near.groupBy("digest", "content").agg(F.lit(None).cast("int").alias("variant"))
    if before is not None:
        met = written(before.join(hits, "digest", "left_semi"), "held-hits")
        texts = texts.unionByName(_bytes_at(met, content)).groupBy("digest", "content").agg(F.max("variant").alias("variant"))
    clashes = written(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), "clashes")
    if not clashes.count():
        return slim.withColumn("variant", F.lit(0))
    same, new = Window.partitionBy("digest"), Window.partitionBy("digest", F.col("variant").isNull()).orderBy("content")
    top = F.coalesce(F.max("variant").over(same), F.lit(-1))
    texts = join_checked(texts, clashes, ["digest"], "left_semi").withColumn("variant", F.coalesce("variant", top + F.row_number().over(new)))
    apart = join_checked(near, clashes, ["digest"], "left_semi").join(texts, ["digest", "content"]).select("rf_file", "rf_row", "variant")
    return slim.join(apart, ["rf_file", "rf_row"], "left").withColumn("variant", F.coalesce("variant", F.lit(0)))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, digest=sha256, state_dir: str | None = None, files_per_batch: int | None = None,
    batch: str | None = None,
) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, digest, rf_file, rf_row.  Of equal normalised texts
    the row with the largest id stays, among all that `state_dir` has seen.  The files of earlier
    calls have to be where they were."""
    spark = docs.sparkSession

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    content = normalise(text) if normalise else text
    rows = picked(docs, id=F.col(id_col).cast("long"), content=content)
    stream = StreamDedup(spark, state_dir or tracked(shared_path(spark, "exact-dedup")), files_per_batch)
    slim = written(rows.select("id", digest(F.col("content")).alias("digest"), "rf_file", "rf_row"), "digests")
    if batch is None:
        n, h = slim.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", "digest").cast("decimal(20,0)"))).first()
        batch = f"{n}.{h or 0}".replace("-", "m")
    own = stream.landed(batch)
    if own is None:
        before = written(stream.held(), "before") if state_dir else None
        own = stream.land(_told_apart(slim, rows, before, digest, content), batch)
    stream.ingest()
    held = written(stream.held(), "held")
    out = own.join(held.filter("group_size > 1"), ["digest", "variant"], "left").withColumn("stays", F.coalesce("stays", F.struct("id", "rf_file", "rf_row")))
    return out.select(
        "id", F.col("stays.id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        ((F.col("stays.rf_file") == F.col("rf_file")) & (F.col("stays.rf_row") == F.col("rf_row"))).alias("kept"),
        "digest", "rf_file", "rf_row",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with its columns."""
    docs = filed(docs)
    with scratch(docs.sparkSession):
        gone = written(exact_dedup(docs, id_col, text_col).filter("NOT kept").select("rf_file", "rf_row"), "copies")
        kept(gone)
    return keep_rows(docs, gone, "left_anti")
