"""Stratified folds: in each repeat and class rows in the order of a keyed hash, cut into even runs.

Hashes are even, so where a fold begins is known but for a few deviations: rows beyond that
window are counted only, rows within it, some roots of the class's size, are sorted, and a row's
fold is how many beginnings aren't behind it.  Where that fails, as with repeated row ids, ranks are
counted by the hash's first digits and then within them.  No task ever sorts a class.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.combos import whole
from ..sources.staging import scratch, staged

#: Half a window about the expected beginning of a fold: deviations of its place, and rows besides.
DEVIATIONS, BESIDES = 8, 40
#: Beginnings up to which a row is compared with each.
COMPARED = 64


def fold_key(seed: Column, row_id: str = "row_id", tail: str | None = None) -> Column:
    """The hash that orders rows; ``tail`` names a column that has what ``key_tail`` makes."""
    return F.md5(F.concat(seed.cast("string"), key_tail(row_id) if tail is None else F.col(tail)).cast("binary"))


def key_tail(row_id: str = "row_id") -> Column:
    return F.concat(F.lit("|"), F.col(row_id).cast("string"))


def even_run(rank: Column, n: Column, k: Column) -> Column:
    """Which of ``k`` contiguous runs a 0-based rank of ``n`` lies in, from 1; the first n mod k runs have one more."""
    size, extra = F.floor(n / k), n % k
    head = extra * (size + 1)
    return F.when(rank < head, F.floor(rank / (size + 1))).otherwise(extra + F.floor((rank - head) / F.greatest(size, F.lit(1)))).cast("int") + 1


def starts(n: int, k: int) -> list[int]:
    """0-based ranks of the rows with which the second to k-th of ``k`` even runs begin; the first n mod k runs have one more."""
    return [m * (n // k) + min(m, n % k) for m in range(1, k)]


def windows(places: Iterable[tuple[int, int]]) -> list[str]:
    """Beginnings and ends, in turn, of the ranges of hashes where rows of these ranks among so many lie all but surely."""
    ends: list[list[float]] = []
    for q, n in sorted((rank / n, n) for rank, n in places):
        half = DEVIATIONS * math.sqrt(q * (1 - q) / n) + BESIDES / n
        ends.append([q - half, q + half])
    merged: list[list[float]] = []
    for low, high in sorted(ends):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    return ["" if v <= 0 else "g" if v >= 1 else f"{int(v * 16**12):012x}" for pair in merged for v in pair]  # before and behind all hashes


def passed(h: Column, edges: Sequence[Column]) -> Column:
    """How many edges a hash has reached: an odd number within a window."""
    return sum((F.when(h >= e, 1).otherwise(0) for e in edges), F.lit(0))


def cut(rows: DataFrame, seed: Column, k: int, sizes: dict[object, int], y: str, row_id: str) -> DataFrame | None:
    """The rows of every ``repeat`` with ``fold``, from where folds begin; None where a beginning isn't one row of its window.

    ``sizes`` has the rows of each class.  The rows are read once for the beginnings, and
    the result reads them once more, without a shuffle.
    """
    if k - 1 > COMPARED:
        return None
    hashed = rows.withColumn("_h", fold_key(seed, row_id))
    edge = F.coalesce(*(F.when(F.col(y) == F.lit(v), passed(F.col("_h"), [*map(F.lit, windows((r, n) for r in starts(n, k)))])) for v, n in sizes.items()))
    placed = hashed.select("repeat", F.col(y).alias("y"), edge.alias("e"), "_h", F.col(f"`{row_id}`").alias("id")).withColumn("key", F.when(F.col("e") % 2 == 1, F.struct("_h", "id")))
    with scratch(rows.sparkSession, results=False):
        counts = staged(placed.groupBy("repeat", "y", "e", "key").agg(F.count("*").alias("c")), "fold-places")
        here, wanted = {}, []
        for r in counts.groupBy("repeat", "y", "e").agg(F.sum("c").alias("c")).orderBy("repeat", "y", "e").collect():
            before = here.get((r["repeat"], r["y"]), 0)
            here[r["repeat"], r["y"]] = before + r["c"]
            wanted += [(r["repeat"], r["y"], r["e"], s - before) for s in starts(sizes[r["y"]], k) if before <= s < before + r["c"]]
        kind = {f.name: f.dataType.simpleString() for f in counts.schema.fields}
        asked = rows.sparkSession.createDataFrame(wanted, f"repeat int, y {kind['y']}, e int, nth long")
        before = F.coalesce(F.sum("c").over(Window.partitionBy("repeat", "y", "e").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        near = counts.where("key IS NOT NULL").withColumn("before", before).join(F.broadcast(asked), ["repeat", "y", "e"])
        first = near.where("nth >= before AND nth < before + c").select("repeat", "y", "nth", "before", "c", "key").collect()
    if len(first) != len(here) * (k - 1) or any(r["before"] != r["nth"] or r["c"] > 1 for r in first):
        return None
    cuts = {}
    for r in sorted(first, key=lambda r: r["key"]):
        cuts.setdefault((r["repeat"], r["y"]), []).append(r["key"])
    # A column for each beginning: fields of an array are far slower to compare with.
    cuts = rows.sparkSession.createDataFrame([(*key, *own) for key, own in cuts.items()], ", ".join([f"repeat int, `{y}` {kind['y']}", *(f"_c{i} {kind['key']}" for i in range(k - 1))]))
    cuts = cuts.select("repeat", f"`{y}`", *(F.col(f"_c{i}.{c}").alias(f"_c{i}{c}") for i in range(k - 1) for c in ("_h", "id")))
    behind = sum((F.when((F.col("_h") > F.col(f"_c{i}_h")) | ((F.col("_h") == F.col(f"_c{i}_h")) & (F.col(f"`{row_id}`") >= F.col(f"_c{i}id"))), 1).otherwise(0) for i in range(k - 1)), F.lit(1))
    return hashed.join(F.broadcast(cuts), ["repeat", y]).select(*(f"`{c}`" for c in rows.columns), behind.cast("int").alias("fold"))


def assign(rows: DataFrame, seed: Column, k: Column, keys: Sequence[str], name: str = "fold", y: str = "y", row_id: str = "row_id", digits: int = 2) -> DataFrame:
    """The rows with fold ``name`` within each key and class, by hash order and then row id."""
    rows = rows.withColumn("_h", fold_key(seed, row_id)).withColumn("_b", F.substring("_h", 1, digits)).withColumn("_k", k)
    of = [*keys, y]
    counts = rows.groupBy(*of, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*of).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*of, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"), F.sum("_c").over(Window.partitionBy(*of)).alias("_n"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*of, "_b").orderBy("_h", row_id)) - 1)
    rows = rows.join(counts, [*of, "_b"])
    return rows.withColumn(name, even_run(F.col("_r") + F.col("_o"), F.col("_n"), F.col("_k"))).drop("_h", "_b", "_k", "_r", "_o", "_n")


def usable_folds(rows: DataFrame, k: int, y: str = "y") -> tuple[int, dict[object, int]]:
    """(``k``, or the smaller class's size with a warning; the rows of each class); fewer than 2 is an error."""
    k = whole(k, "k", 2)
    seen = rows.groupBy(y).agg(F.count("*").alias("n")).limit(4).collect()
    if not seen:
        raise ValueError("there are no rows")
    if any(r[y] is None for r in seen):
        raise ValueError("the outcome has NA values")
    if len(seen) != 2:
        raise ValueError(f"the outcome must have exactly two values, not {len(seen)}")
    least = min(r["n"] for r in seen)
    if k > least:
        warnings.warn(f"k ({k}) exceeds the smaller class ({least}); reducing it to {least}", stacklevel=3)
        k = least
    if k < 2:
        raise ValueError("the smaller class has too few rows for folds")
    return k, {r[y]: r["n"] for r in seen}


def stratified_folds(rows: DataFrame, k: int = 5, repeats: int = 1, seed: int = 1, y: str = "y", row_id: str = "row_id") -> DataFrame:
    """Every row of ``rows`` once for each repeat, with ``repeat``, ``fold`` and ``fold_name``; it is tested in that fold."""
    (k, sizes), repeats = usable_folds(rows, k, y), whole(repeats, "repeats")
    every = rows.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    number = F.lit(seed) + F.col("repeat") - 1
    made = cut(every, number, k, sizes, y, row_id)
    if made is None:
        made = assign(every, number, F.lit(k), ["repeat"], "fold", y, row_id)
    return made.withColumn("fold_name", F.concat(F.lit("Rep"), F.col("repeat").cast("string"), F.lit("_Fold"), F.col("fold").cast("string")))
