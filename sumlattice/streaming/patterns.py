"""Pattern counts kept up to date from a stream: they add up, so a batch only adds its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.roc import compress


def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Pattern counts (x, p, n) after another batch of (x, y) rows."""
    new = compress(batch)
    if old is None:
        return new
    return old.unionByName(new).groupBy("x").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def sink(folder: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each batch's counts in a folder of its own, so that a replay replaces, not adds."""

    def write(batch: DataFrame, epoch: int) -> None:
        compress(batch).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return write


def current(df: DataFrame) -> DataFrame:
    """The counts of all batches that ``sink`` wrote, read from its folder."""
    return df.groupBy("x").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
