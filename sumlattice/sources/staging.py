"""Intermediate tables in the shared folder: they cut the lineage, so plans stay small and losses cheap."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few values up to which a table is broadcast: 20 MB about.
BROADCAST_ROWS = 200_000
#: Open scopes, outermost first: paths of a scope's tables, and whether results are among them.
_SCOPES: ContextVar[tuple[tuple[list[str], bool], ...]] = ContextVar("scopes", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a fresh local one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sumlattice-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def file_system(spark: SparkSession, at: str) -> tuple:
    """Hadoop's file system and path of a place in any store that Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def staged(df: DataFrame, label: str = "table", result: bool = False) -> DataFrame:
    """Write a table under ``spark.checkpoint.dir`` and read it back; a ``result`` outlives the operator's own scope."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/sumlattice-{label}-{uuid.uuid4().hex}"
    if scopes := [paths for paths, takes in _SCOPES.get() if takes or not result]:
        scopes[-1].append(at)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


@contextmanager
def scratch(spark: SparkSession, results: bool = True) -> Iterator[None]:
    """Delete what was staged within.

    Operators open scopes without ``results``: theirs go to the caller's scope, if there is
    one.  What is computed from tables of the scope has to be read before it ends.
    """
    own: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), (own, results)))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for at in own:
            fs, path = file_system(spark, at)
            fs.delete(path, True)


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A table of small rows with a broadcast hint if they were counted and are few; else Spark shuffles both sides of its join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
