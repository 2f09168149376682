"""Shared plumbing: staged tables in the shared folder, column selection, batching."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a fresh local one in local mode and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="sumlattice-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Bytes of an Arrow batch that a Python worker gets at once, where the session allows more; one row at least.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep rows of long texts from meeting in one large Arrow batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


_RUNS: ContextVar[list[Stage] | None] = ContextVar("runs", default=None)


@contextmanager
def scratch() -> Iterator[None]:
    """Delete the tables of every operator run begun within, unless an error leaves early; what is to stay must be written elsewhere by then."""
    runs: list[Stage] = []
    token = _RUNS.set(runs)
    try:
        yield
    finally:
        _RUNS.reset(token)
    for run in runs:
        run.delete(run.root)


class Stage:
    """Tables of one operator run, written to the shared folder and read back.

    A written table cuts the lineage: a lost executor costs the tasks it ran, not
    the whole history, and later jobs do not repeat earlier ones.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[DataFrame] = []
        self.paths: dict[int, str] = {}
        if (runs := _RUNS.get()) is not None:
            runs.append(self)

    def path(self, label: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{label}"

    def write(self, df: DataFrame, label: str, **options: str) -> DataFrame:
        at = self.path(label)
        df.write.options(**options).mode("errorifexists").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self.tables.append(out)
        self.paths[id(out)] = at
        return out

    def release(self) -> None:
        """Let the driver collect its garbage, upon which executors delete shuffle files of finished steps."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def finish(self, df: DataFrame) -> DataFrame:
        """Write a result and delete all other tables of the run."""
        out = self.write(df, "result")
        self.drop(*self.tables[:-1])
        self.release()
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        self.delete(*[self.paths.pop(id(t)) for t in tables if id(t) in self.paths])

    def delete(self, *paths: str) -> None:
        for at in paths:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of ids and other values of fixed width up to which a table is broadcast rather than shuffled: 20 MB about.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A table of ids or digests with a broadcast hint if its rows were counted and are few; else Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def with_text(df: DataFrame, text: Column, text_col: str = "text") -> DataFrame:
    """The table with another text; a column ``n_chars`` follows it."""
    df = df.withColumn(text_col, text)
    if "n_chars" in df.columns:
        df = df.withColumn("n_chars", F.char_length(text_col).cast(df.schema["n_chars"].dataType))
    return df


def crc32_of_id(column: str) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small row slices of Arrow batches, without copying."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
