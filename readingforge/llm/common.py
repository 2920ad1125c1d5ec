"""Shared helpers: the cluster's shared folder, row locators, size-checked joins, Arrow batches."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast, and bytes of its files; larger sides are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 150_000, 16 << 20
#: Records in one Arrow batch; with whole documents this bounds a Python worker's memory.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """A block in which settings of the session hold; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """A block with Arrow batches of few records, since one record is a whole text.  What is run in
    it has to be run to its end there, so results are `written` before they are returned."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)})


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  A local session that
    names none gets a temporary folder; a cluster that names none is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    base = "file://" + tempfile.mkdtemp(prefix="readingforge-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/readingforge/{name}-{uuid.uuid4().hex}"


class _Scopes(threading.local):
    """Paths that the open `scratch` blocks of this thread remove, innermost last."""

    def __init__(self):
        self.open: list[list[str]] = []


_scopes = _Scopes()


def tracked(path: str) -> str:
    """`path`, to be removed with the innermost scratch block, if there is one."""
    if _scopes.open:
        _scopes.open[-1].append(path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = tracked(shared_path(spark, name))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.rf_path = path
    return out


@contextmanager
def scratch(spark: SparkSession):
    """A block at whose end the tables written within are removed, but for those that were `kept`."""
    _scopes.open.append([])
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            removed(spark, path)


def kept(*tables: DataFrame) -> None:
    """Leaves tables that a result still reads to the scratch block around, or for good."""
    for t in tables:
        _scopes.open[-1].remove(t.rf_path)
        if len(_scopes.open) > 1:
            _scopes.open[-2].append(t.rf_path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that `df` does not have, in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


#: Plans of which every row is a row of a file.
_ROWWISE = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"}


def _rowwise(node) -> bool:
    children = node.children()
    return node.getClass().getSimpleName() in _ROWWISE and all(_rowwise(children.apply(k)) for k in range(children.size()))


def filed(df: DataFrame) -> DataFrame:
    """`df` if its rows are those of files, perhaps filtered by what every run decides alike, so that
    each has a file and a place there; else (a limit, a sample, a join) the same rows written to the
    shared folder."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.deterministic() and _rowwise(plan):
        try:
            df.select(df.metadataColumn("_metadata")["row_index"])
            return df
        except AnalysisException:
            pass
    return written(df, "rows")


def located(df: DataFrame, file: str = "rf_file", row: str = "rf_row") -> DataFrame:
    """`df` with two columns that name each row: its file and its place there."""
    df = filed(df)
    meta = df.metadataColumn("_metadata")
    return df.withColumns({file: meta["file_path"], row: meta["row_index"]})


def picked(df: DataFrame, **columns: Column) -> DataFrame:
    """Only the given columns, and rf_file and rf_row, which name each row."""
    df = filed(df)
    meta = df.metadataColumn("_metadata")
    return df.select(*[c.alias(n) for n, c in columns.items()], meta["file_path"].alias("rf_file"), meta["row_index"].alias("rf_row"))


def nbytes(table: DataFrame) -> int:
    """The bytes of a written table."""
    spark = table.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(table.rf_path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins; `small` (a written table) is broadcast only if its rows and bytes are within the bounds."""
    few = nbytes(small) <= BROADCAST_BYTES and small.count() <= limit
    return big.join(F.broadcast(small) if few else small.hint("merge"), on, how)


def keep_rows(df: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    """The rows of `df` whose locator is in (`left_semi`) or not in (`left_anti`) `chosen`, a
    written table of rf_file and rf_row; columns as in `df`, which must be `filed`."""
    file, row = fresh(df, "rf_file", "rf_row")
    rows = located(df, file, row)
    keys = chosen.select(F.col("rf_file").alias(file), F.col("rf_row").alias(row))
    keys.rf_path = chosen.rf_path
    return join_checked(rows, keys, [file, row], how).drop(file, row)
