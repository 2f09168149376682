"""Folds of many training sets at once, as counts of patterns.

Every (repeat, outer fold, seed) asks for its own division of that outer fold's training
rows, by the order of the seed's keyed hash.  No row is written or sorted for a division:
a fold begins at the row of a certain rank, a row's rank in a training set is its rank
among all rows less that among the left-out fold's.

Hashes are even, so that all beginnings of a seed's folds lie in a few narrow windows.  One pass
over the rows, in which a row meets the seeds of its repeat and is aggregated at once, counts
patterns between windows and keeps the rows within them, some roots of their number, which then tell
beginnings and folds.  Where a beginning isn't in its window, or windows are many, ranks are
counted by prefixes of the hash, in three such passes:

1. counts by prefix, which tell behind which prefix each fold begins;
2. the rows of those few prefixes, in order, of which one is where the fold begins;
3. patterns counted by the stretch of hashes, between two beginnings, that a row lies in.

Stretches then say which fold of which training set their rows are in.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import few, staged
from .folds import fold_key, key_tail, passed, starts, windows

#: Rows of a prefix that are sorted where a fold begins, about.
PREFIX_ROWS = 4096
#: Beginnings that a row is compared with one by one.
COMPARED = 128


def prefix_digits(n_rows: int) -> int:
    """Hexadecimal digits of the hash by which so many rows are counted."""
    return min(6, max(2, math.ceil(math.log(max(1, n_rows) / PREFIX_ROWS, 16)) if n_rows > PREFIX_ROWS else 2))


def divided(folds: DataFrame, wanted: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """(repeat, outer_fold, seed, inner, x, p, n): pattern counts of each inner fold.

    ``folds`` (row_id, y, x, repeat, fold) are rows of every repeat, ``wanted`` (repeat,
    outer_fold, seed) the divisions.  A division has ``k`` folds, fewer where the smaller
    class of the training rows is smaller, and isn't made where that leaves one.  With
    ``digits`` ranks are counted by prefixes of so many.
    """
    made = by_windows(folds, wanted, k) if digits is None else None
    return by_prefixes(folds, wanted, k, digits or prefix_digits(folds.count())) if made is None else made


def _hashed(folds: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """Every row with the hashes of its repeat's seeds."""
    seeds = wanted.groupBy("repeat").agg(F.sort_array(F.collect_set("seed")).alias("seeds"))  # a row for each repeat
    rows = folds.select("row_id", "y", "repeat", "fold", *columns, key_tail().alias("_t")).join(F.broadcast(seeds), "repeat")
    return rows.withColumn("seed", F.explode("seeds")).withColumn("_h", fold_key(F.col("seed"), tail="_t")).drop("seeds", "_t")


def by_windows(folds: DataFrame, wanted: DataFrame, k: int) -> DataFrame | None:
    """``divided`` from one pass over the rows; None where a beginning isn't in its window, or windows are many."""
    spark, at, division = folds.sparkSession, ["repeat", "seed", "y"], ["repeat", "seed", "outer_fold"]
    kind = folds.schema["y"].dataType.simpleString()
    sizes: dict = {}  # repeat: class: fold: rows, as many as there are folds
    for r in folds.groupBy("repeat", "y", "fold").agg(F.count("*").alias("n")).collect():
        sizes.setdefault(r["repeat"], {}).setdefault(r["y"], {})[r["fold"]] = r["n"]
    ranks, places, expected = [], {}, 0
    for r in wanted.groupBy("repeat", "outer_fold").agg(F.count("*").alias("n")).collect():
        totals = {y: sum(own.values()) - own.get(r["outer_fold"], 0) for y, own in sizes.get(r["repeat"], {}).items()}
        own_k = min([k, *totals.values()]) if totals else 0
        for y, n in totals.items() if own_k > 1 else ():
            ranks += [(r["repeat"], r["outer_fold"], y, s) for s in starts(n, own_k)]
            places.setdefault(y, set()).update((s, n) for s in starts(n, own_k))
            expected += r["n"] * (own_k - 1)
    edges = {y: windows(own) for y, own in places.items()}  # of all repeats, whose folds are of nearly equal sizes
    if not edges or max(map(len, edges.values())) > COMPARED:
        return None

    edge = F.coalesce(*(F.when(F.col("y") == F.lit(y), passed(F.col("_h"), [*map(F.lit, own)])) for y, own in edges.items()))
    rows = _hashed(folds, wanted, "x").withColumn("e", edge)
    key = F.when(F.col("e") % 2 == 1, F.struct("_h", "row_id")).alias("key")
    cells = staged(rows.groupBy(*at, "fold", "e", "x", key).agg(F.count("*").alias("c")), "hash-patterns")
    sums = cells.groupBy(*at, "fold", "e").agg(F.sum("c").alias("c")).join(few(wanted), ["repeat", "seed"]).where("fold <> outer_fold")
    sums = sums.groupBy(*division, "y", "e").agg(F.sum("c").alias("c"))
    below = lambda *by: Window.partitionBy(*division, "y", *by).orderBy("key" if by else "e").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda *by: F.coalesce(F.sum("c").over(below(*by)), F.lit(0))
    begins = sums.withColumn("before", before()).join(F.broadcast(spark.createDataFrame(ranks, f"repeat int, outer_fold int, y {kind}, rank long")), ["repeat", "outer_fold", "y"])
    begins = staged(begins.where("e % 2 = 1 AND rank >= before AND rank < before + c").select(*division, "y", "e", "rank", (F.col("rank") - F.col("before")).alias("nth")), "fold-begins")
    if begins.count() != expected:
        return None

    near = cells.where("key IS NOT NULL").select(*at, "fold", "e", "key", "c").join(few(begins), [*at, "e"]).where("fold <> outer_fold")
    first = near.withColumn("before", before("rank")).where("nth >= before AND nth < before + c")
    cuts = staged(first.groupBy(*division, "y").agg(F.collect_list(F.struct("e", "key")).alias("cuts")), "fold-firsts")  # a row for each division and class
    behind = F.filter("cuts", lambda c: (c["e"] < F.col("e")) | ((c["e"] == F.col("e")) & (c["key"] <= F.col("key"))))
    met = cells.join(few(cuts), at).where("fold <> outer_fold").withColumn("inner", F.size(behind) + 1)
    return met.groupBy("repeat", "outer_fold", "seed", "inner", "x").agg(F.sum(F.col("c") * F.col("y")).alias("p"), F.sum(F.col("c") * (1 - F.col("y"))).alias("n"))


def by_prefixes(folds: DataFrame, wanted: DataFrame, k: int, digits: int = 2) -> DataFrame:
    """``divided`` from three passes over the rows, wherever folds begin."""
    at = ["repeat", "seed", "y"]
    division = ["repeat", "seed", "outer_fold"]
    hashed = lambda *columns: _hashed(folds, wanted, *columns).withColumn("_b", F.substring("_h", 1, digits))

    counts = staged(hashed().groupBy(*at, "fold", "_b").agg(F.count("*").alias("c")), "hash-counts")
    own = counts.select(*at, "_b", F.col("fold").alias("outer_fold"), F.col("c").alias("own"))
    train = counts.groupBy(*at, "_b").agg(F.sum("c").alias("all")).join(wanted, ["repeat", "seed"]).join(own, [*at, "_b", "outer_fold"], "left")
    train = train.withColumn("c", F.col("all") - F.coalesce("own", F.lit(0)))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*division, "y").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    train = train.withColumn("before", before).withColumn("total", F.sum("c").over(Window.partitionBy(*division, "y")))
    train = train.withColumn("k", F.least(F.lit(k), F.min("total").over(Window.partitionBy(*division)))).where("k > 1 AND c > 0")
    # The first total mod k folds have one row more than the others.
    start = F.col("m") * F.floor(F.col("total") / F.col("k")) + F.least(F.col("m"), F.col("total") % F.col("k"))
    begins = train.withColumn("m", F.explode(F.sequence(F.lit(1), (F.col("k") - 1).cast("int")))).withColumn("nth", start - F.col("before")).where("nth >= 0 AND nth < c")
    begins = few(staged(begins.select(*division, "y", "m", "_b", "nth"), "fold-begins"))

    near = hashed().join(begins, [*at, "_b"]).where("fold <> outer_fold")
    nth = F.row_number().over(Window.partitionBy(*division, "y", "m").orderBy("_h", "row_id")) - 1
    first = staged(near.withColumn("_n", nth).where("_n = nth").select(*division, "y", F.struct("_h", "row_id").alias("first")), "fold-firsts")
    cuts = few(first.groupBy(*at).agg(F.array_sort(F.collect_set("first")).alias("cuts")))  # a row for each seed of a repeat and class
    most = first.groupBy(*at).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0  # folds that begin in a repeat, outer folds times inner ones at most

    # Written out, comparisons are compiled with their stage; very many would make too large an expression.
    here = F.struct("_h", "row_id")
    reached = sum((F.when(F.get("cuts", F.lit(i)) <= here, 1).otherwise(0) for i in range(most)), F.lit(0)) if most <= COMPARED else F.size(F.filter("cuts", lambda c: c <= here))
    placed = hashed("x").join(cuts, at).withColumn("stretch", reached)
    cells = staged(placed.groupBy(*at, "fold", "stretch", "x").agg(F.count("*").alias("c")), "hash-patterns")
    places = first.join(cuts, at).groupBy(*division, "y").agg(F.collect_list(F.array_position("cuts", F.col("first"))).alias("places"), F.first(F.size("cuts")).alias("last"))
    stretches = places.withColumn("stretch", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("inner", F.size(F.filter("places", lambda p: p <= F.col("stretch"))) + 1)
    met = cells.join(stretches.select(*division, "y", "stretch", "inner"), [*at, "stretch"]).where("fold <> outer_fold")
    return met.groupBy("repeat", "outer_fold", "seed", "inner", "x").agg(F.sum(F.col("c") * F.col("y")).alias("p"), F.sum(F.col("c") * (1 - F.col("y"))).alias("n"))
