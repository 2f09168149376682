"""Counting, enumerating and unranking item subsets: sizes ascending, lexicographic within a size."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Subsets kept from the first search, by preset.
PRESETS = {"quick": 100, "balanced": 500, "thorough": 1000, "exhaustive": None}
#: Most subsets that a search may have: ranks are longs.
MAX_TOTAL = 2**62


def whole(value: object, name: str, least: int = 1) -> int:
    """A plain integer of at least ``least``; anything else is an error."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != int(value) or value < least:
        raise ValueError(f"{name} must be an integer of at least {least}")
    return int(value)


def level_sizes(n: int, min_items: int, max_items: int) -> list[tuple[int, int]]:
    """(size, number of subsets) of each size; ``max_items`` is clipped to ``n``."""
    top = min(max_items, n)
    if n < 1:
        raise ValueError("there are no items")
    if min_items > top:
        raise ValueError(f"min_items ({min_items}) is above the largest size ({top})")
    return [(k, math.comb(n, k)) for k in range(min_items, top + 1)]


def count_combinations(items: int | Sequence[str], min_items: int = 1, max_items: int = 4, detail: bool = False) -> int | pd.DataFrame:
    """Number of subsets, or with ``detail`` a table (n_items, n_combinations) by size."""
    n = items if isinstance(items, int) and not isinstance(items, bool) else len(items)
    levels = level_sizes(whole(n, "items"), whole(min_items, "min_items"), whole(max_items, "max_items"))
    if detail:
        return pd.DataFrame(levels, columns=["n_items", "n_combinations"])
    return sum(c for _, c in levels)


def suggest_preselect(items: int | Sequence[str], min_items: int = 1, max_items: int = 4, mode: str = "balanced") -> int:
    """How many subsets a preset keeps from the first search; never more than there are."""
    if mode not in PRESETS:
        raise ValueError(f"mode must be one of {', '.join(PRESETS)}")
    total = count_combinations(items, min_items, max_items)
    return total if PRESETS[mode] is None else min(PRESETS[mode], total)


def enumerate_combinations(n: int, min_items: int = 1, max_items: int = 4) -> Iterator[tuple[int, ...]]:
    for k, _ in level_sizes(n, min_items, max_items):
        yield from itertools.combinations(range(n), k)


def locate(rank: int, levels: Sequence[tuple[int, int]]) -> tuple[int, int]:
    """(size, rank within the size) of a global 0-based rank."""
    if rank < 0:
        raise ValueError("a rank is 0 or more")
    for k, c in levels:
        if rank < c:
            return k, rank
        rank -= c
    raise ValueError("the rank is beyond the last subset")


def unrank(n: int, k: int, ranks: np.ndarray) -> np.ndarray:
    """Item positions of the lexicographic ``ranks`` among subsets of size ``k``, for whole arrays."""
    ranks = np.asarray(ranks, np.int64)
    if not 1 <= k <= n:
        raise ValueError("a subset's size lies between 1 and the number of items")
    if len(ranks) and (ranks.min() < 0 or ranks.max() >= math.comb(n, k)):
        raise ValueError("a rank is beyond the last subset")
    out = np.empty((len(ranks), k), np.int64)
    left = ranks.copy()
    low = np.zeros(len(ranks), np.int64)
    for j in range(k):
        # Subsets whose place j holds an item before i, of all whose places before j are as they are.
        tail = np.array([math.comb(n - i - 1, k - j - 1) for i in range(n)], np.int64)
        before = np.append(0, np.cumsum(tail))
        item = np.searchsorted(before, left + before[low], "right") - 1
        out[:, j] = item
        left -= before[item] - before[low]
        low = item + 1
    return out


def unrank_global(n: int, levels: Sequence[tuple[int, int]], ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``ranks``, item positions) for each size that the ranks reach."""
    starts = np.cumsum([0, *(c for _, c in levels)])
    for (k, _), lo, hi in zip(levels, starts, starts[1:]):
        at = np.flatnonzero((ranks >= lo) & (ranks < hi))
        if len(at):
            yield at, unrank(n, k, ranks[at] - lo)


def candidates(spark: SparkSession, items: Sequence[str], min_items: int = 1, max_items: int = 4, start: int = 0, size: int | None = None, partitions: int | None = None) -> DataFrame:
    """(combo_id, n_items, item_idx, items) of all subsets, or of ``size`` from rank ``start`` on."""
    names = [*items]
    levels = level_sizes(len(names), min_items, max_items)
    total = sum(c for _, c in levels)
    if total > MAX_TOTAL:
        raise ValueError("there are too many subsets")
    if not 0 <= start < total:
        raise ValueError("the chunk starts beyond the last subset")
    end = total if size is None else min(total, start + whole(size, "size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranks = b.column(0).to_numpy()
            for at, idx in unrank_global(len(names), levels, ranks):
                size = idx.shape[1]
                lists = pa.ListArray.from_arrays(np.arange(0, idx.size + 1, size, dtype=np.int32), idx.ravel().astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(ranks[at]), pa.array(np.full(len(at), size, np.int32)), lists], ["combo_id", "n_items", "item_idx"])

    made = spark.range(start, end, 1, partitions or max(1, min(spark.sparkContext.defaultParallelism, (end - start) // 1000))).mapInArrow(run, "combo_id long, n_items int, item_idx array<int>")
    return made.withColumn("items", F.array_join(F.transform("item_idx", lambda i: F.get(F.array(*map(F.lit, names)), i)), ", "))


def candidate_rows(spark: SparkSession, items: Sequence[str], min_items: int = 1, max_items: int = 4) -> DataFrame:
    """The same table from the driver, for the few subsets that a plan broadcasts."""
    rows = [(r, len(c), [*c], ", ".join(items[i] for i in c)) for r, c in enumerate(enumerate_combinations(len(items), min_items, max_items))]
    return F.broadcast(spark.createDataFrame(rows, "combo_id long, n_items int, item_idx array<int>, items string"))
