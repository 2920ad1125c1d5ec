"""A queue of sheets as a file stream: one micro-batch after another, each job exactly once.

A submitted request lands as JSON in the inbox.  A request for a sheet that its owner already has
waiting or running is not taken again: it gets the id of that job.  A sheet whose job has ended may
be submitted anew.  A micro-batch runs its jobs together, and one by one where that fails, so that
an error fails the job that made it and nothing else.  What a batch writes is under its number, so
a batch that is repeated replaces what it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REQUEST = "job_id string, owner_id string, sheet_id string, source_filename string, geometry_mode string, recognition_strategy string, submitted bigint"
ENDED = "job_id string, state string, error string, processed_count bigint"
WHO = ["owner_id", "sheet_id"]


class JobQueue:
    def __init__(self, spark: SparkSession, store: str, work: Callable[[DataFrame], DataFrame], files_per_batch: int = 1):
        """work: from requests to results with job_id; a column `error` marks failed jobs, and so does
        an exception."""
        self.spark, self.store, self.work, self.files = spark, store, work, files_per_batch
        self.inbox, self.query = f"{store}/inbox", None
        fs, p = self._path(self.inbox)
        fs.mkdirs(p)

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _table(self, name: str, schema: str) -> DataFrame:
        fs, p = self._path(f"{self.store}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.store}/{name}") if fs.exists(p) else self.spark.createDataFrame([], schema)

    # ---- submitting

    def _requests(self) -> DataFrame:
        return self.spark.read.schema(REQUEST).json(self.inbox)

    def _active(self) -> DataFrame:
        return self._requests().join(self._table("ended", ENDED).select("job_id"), "job_id", "left_anti").select("job_id", *WHO)

    def submit_all(self, requests: DataFrame) -> DataFrame:
        """owner_id, sheet_id, job_id of `requests` (owner_id, sheet_id and any of REQUEST): the id of an
        active job, or of a new one.  Requests for one sheet are one job."""
        rest = [c for c in ("source_filename", "geometry_mode", "recognition_strategy") if c in requests.columns]
        order = self._requests().agg(F.coalesce(F.max("submitted"), F.lit(-1))).first()[0] + 1
        wanted = requests.groupBy(*WHO).agg(*[F.min(c).alias(c) for c in rest]) if rest else requests.select(*WHO).distinct()
        new = wanted.join(self._active(), WHO, "left_anti").withColumns({
            "job_id": F.sha2(F.concat_ws(":", *WHO, F.lit(uuid.uuid4().hex)), 256), "submitted": F.lit(order).cast("bigint")})
        new.coalesce(1).write.mode("append").json(self.inbox)
        return wanted.select(*WHO).join(self._active(), WHO)

    def submit(self, owner_id: str, sheet_id: str, **rest: str) -> str:
        """The id of the sheet's job."""
        row = {"owner_id": owner_id, "sheet_id": sheet_id} | rest
        schema = ", ".join(f"{k} string" for k in row)
        return self.submit_all(self.spark.createDataFrame([tuple(row.values())], schema)).first().job_id

    # ---- working

    def _run(self, jobs: DataFrame, path: str) -> DataFrame:
        """Writes the results of some jobs; the states in which they end."""
        out = self.work(jobs)
        out.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(out.schema).parquet(path)
        error = F.min("error") if "error" in out.columns else F.lit(None).cast("string")
        facts = out.groupBy("job_id").agg(error.alias("error"), F.count(F.lit(1)).alias("processed_count"))
        state = F.when(F.col("error").isNotNull(), "failed").otherwise("completed")
        return jobs.select("job_id").join(facts, "job_id", "left").select("job_id", state.alias("state"), "error", F.coalesce("processed_count", F.lit(0)).alias("processed_count"))

    def _batch(self, requests: DataFrame, number: int) -> None:
        requests.select("job_id").write.mode("overwrite").parquet(f"{self.store}/started/batch={number}")
        jobs = requests.dropDuplicates(["job_id"]).persist()
        results = f"{self.store}/results/batch={number}"
        try:
            ended = self._run(jobs, f"{results}/part=0")
        except Exception:  # noqa: BLE001  any error of the caller's function
            ended = None
            for k, r in enumerate(jobs.select("job_id").toLocalIterator()):
                one = jobs.filter(F.col("job_id") == r.job_id)
                try:
                    part = self._run(one, f"{results}/part={k}")
                except Exception as e:  # noqa: BLE001
                    fs, p = self._path(f"{results}/part={k}")
                    fs.delete(p, True)
                    part = one.select("job_id", F.lit("failed").alias("state"), F.lit(f"{type(e).__name__}: {e}"[:1000]).alias("error"), F.lit(0).cast("bigint").alias("processed_count"))
                ended = part if ended is None else ended.unionByName(part)
        if ended is not None:
            ended.write.mode("overwrite").parquet(f"{self.store}/ended/batch={number}")
        jobs.unpersist()

    def _stream(self):
        stream = self.spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", self.files).json(self.inbox)
        return stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.store}/checkpoint")

    def run(self) -> None:
        """Works through all that has landed."""
        self._stream().trigger(availableNow=True).start().awaitTermination()

    def start(self, every: str = "1 second") -> StreamingQuery:
        """Works through what lands, until `shutdown`."""
        self.query = self._stream().trigger(processingTime=every).start()
        return self.query

    def shutdown(self, wait: bool = True) -> None:
        """Stops the stream, after what has landed if `wait`."""
        if self.query is not None:
            if wait:
                self.query.processAllAvailable()
            self.query.stop()
            self.query = None

    # ---- looking

    def snapshots(self, owner_id: str | None = None) -> DataFrame:
        """The jobs of an owner (or of all) in the order of submission: queued, running, completed or
        failed, with the error and the number of results; discarded ones aren't shown."""
        jobs = self._requests() if owner_id is None else self._requests().filter(F.col("owner_id") == owner_id)
        jobs = jobs.join(self._table("discarded", "job_id string"), "job_id", "left_anti")
        started = self._table("started", "job_id string").distinct().withColumn("_started", F.lit(True))
        rows = jobs.join(self._table("ended", ENDED), "job_id", "left").join(started, "job_id", "left")
        state = F.coalesce("state", F.when(F.col("_started"), F.lit("running")), F.lit("queued"))
        return rows.withColumns({"state": state, "processed_count": F.coalesce("processed_count", F.lit(0))}).drop("_started").orderBy("submitted", "sheet_id", "job_id")

    def snapshot(self, job_id: str, owner_id: str):
        """One job of an owner, or None."""
        return self.snapshots(owner_id).filter(F.col("job_id") == job_id).first()

    def _all_results(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.store}/results").drop("batch", "part")

    def results(self, owner_id: str) -> DataFrame:
        """Results of the owner's completed jobs; reading them again changes nothing."""
        return self._all_results().join(self.snapshots(owner_id).filter("state = 'completed'").select("job_id"), "job_id", "left_semi")

    def _marked(self, kind: str, job_id: str) -> bool:
        """Marks a job; False if it was marked before."""
        fs, p = self._path(f"{self.store}/{kind}-marks/{job_id}")
        return bool(fs.createNewFile(p))

    def consume_result(self, job_id: str, owner_id: str) -> DataFrame | None:
        """The results of a completed job, once; None afterwards, and for jobs of others."""
        own = self.snapshot(job_id, owner_id)
        if own is None or own.state != "completed" or not self._marked("consumed", job_id):
            return None
        return self._all_results().filter(F.col("job_id") == job_id)

    def discard_terminal_job(self, job_id: str, owner_id: str) -> bool:
        """Takes a job that has ended out of the snapshots."""
        own = self.snapshot(job_id, owner_id)
        if own is None or own.state not in ("completed", "failed"):
            return False
        self.spark.createDataFrame([(job_id,)], "job_id string").coalesce(1).write.mode("append").parquet(f"{self.store}/discarded")
        return True


def attach(results: DataFrame, sheets: DataFrame) -> DataFrame:
    """Results of the sheets that are still there; those of sheets that are gone are left out."""
    return results.join(sheets.select("sheet_id").distinct(), "sheet_id", "left_semi")


def stage(state: Column, ready: Column, unconfirmed_days: Column) -> Column:
    """Where a sheet stands between its job and its export."""
    return (
        F.when(state == "failed", "Failed").when(state != "completed", "Processing").when(ready, "Ready to export")
        .when(unconfirmed_days < 31, "In review").otherwise("Awaiting review"))


def stage_label(jobs: DataFrame, readiness: DataFrame) -> DataFrame:
    """sheet_id, stage."""
    rows = jobs.join(readiness.select("sheet_id", "ready", "unconfirmed_days"), "sheet_id", "left")
    return rows.select("sheet_id", stage(F.col("state"), F.col("ready"), F.col("unconfirmed_days")).alias("stage"))
