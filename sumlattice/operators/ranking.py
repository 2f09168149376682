"""Orders of candidates.  Every order is total: it ends in combo_id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.combos import whole
from ..functions.parsing import CRITERIA, RANK_COLUMNS, RESULT_RANK_COLUMNS, choice
from ..sources.staging import staged


def _down(c: str) -> Column:
    return F.desc_nulls_last(c)


def candidate_order(rank_by: str = "auc", prefer_fewer_items: bool = True) -> list[Column]:
    choice(rank_by, RANK_COLUMNS, "rank_by")
    return [_down(rank_by), *([F.asc("n_items")] if prefer_fewer_items else []), F.asc("combo_id")]


def preselect_order(by: str = "auc") -> list[Column]:
    choice(by, CRITERIA, "preselect_by")
    return [_down(by), _down("youden"), _down("sensitivity"), _down("specificity"), F.asc("n_items"), F.asc("combo_id")]


def result_order(rank_by: str = "youden", columns: Sequence[str] = ()) -> list[Column]:
    choice(rank_by, RESULT_RANK_COLUMNS, "rank_by")
    rest = [c for c in ("youden", "auc", "sensitivity", "specificity", "accuracy") if c != rank_by and (not columns or c in columns)]
    tail = [c for c in ("n_items", "combo_id", "items") if not columns or c in columns]
    return [_down(rank_by), *map(_down, rest), *map(F.asc, tail[: 2 if "combo_id" in tail else 3])]


def ranked(df: DataFrame, order: Sequence[Column], top_n: int | None = None) -> DataFrame:
    """Rows in order with ``rank`` from 1; with ``top_n`` each task keeps that many and only they meet."""
    if top_n is not None:
        top_n = whole(top_n, "top_n")
        df = df.orderBy(*order).limit(top_n)
        return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    # A range sort spreads all rows; a rank is the rows of earlier parts and those before in its own, which
    # the sorted part's running number counts.  The parts are written: computed twice, their bounds would be
    # drawn twice and needn't agree.
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    parts = staged(parts, "ranked", result=True).withColumn("_part", F.shiftright("_at", 33))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    nth = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return parts.join(F.broadcast(offsets), "_part").withColumn("rank", (nth + F.col("_before")).cast("int")).drop("_part", "_at", "_before")


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, position: str = "position") -> DataFrame:
    """The first ``n`` rows of each key with their position from 1."""
    return df.withColumn(position, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(position) <= n)
