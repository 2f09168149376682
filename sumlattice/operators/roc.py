"""Score frequencies, tie-aware ROC statistics and optimal cutoffs as DataFrame plans.

Counts stay longs, sums of their products are exact decimals.  AUC is an integer sum over
one product, each rounded once; Youden's index is evaluated as (tp/P + tn/N) - 1, since ties are
broken on the doubles themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.exact import total, wide
from ..sources.staging import staged

#: Values in all patterns up to which patterns are broadcast: 16 MB.
NUMBERED_VALUES = 2_000_000
METRICS = ("auc", "cutoff", "sensitivity", "specificity", "youden", "accuracy", "ppv", "npv")


def compress(rows: DataFrame, keys: Sequence[str] = (), times: str | None = None) -> DataFrame:
    """Rows of equal items become one pattern (keys, x, p, n): every statistic depends on these counts only.

    ``times`` names a column that says how many rows a row stands for.  Its patterns are
    written: counts are longs if those of both classes are below 2^62, else decimals.
    """
    if times is None:
        return rows.groupBy(*keys, "x").agg(F.sum("y").alias("p"), F.sum(F.lit(1) - F.col("y")).alias("n"))
    n = F.col(times).cast("long").cast("decimal(19,0)")
    sides = F.sum(F.when(F.col("y") == 1, n).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, n).otherwise(0)).alias("n")
    made = staged(rows.groupBy(*keys, "x").agg(*(c.cast(exact.WIDE).alias(name) for c, name in zip(sides, ("p", "n")))), "weighted-patterns")
    most = made.agg(F.greatest(F.sum("p"), F.sum("n"))).first()[0] or 0
    if most >= exact.WIDEST:
        raise ValueError("the rows of a class, weighted, are more than 10^27")
    return made if most >= exact.MOST else made.withColumn("p", F.col("p").cast("long")).withColumn("n", F.col("n").cast("long"))


def pattern_numbers(patterns: DataFrame) -> DataFrame | None:
    """(number, x) of the distinct ``x``, written; None where they are too many to broadcast."""
    values = patterns.limit(NUMBERED_VALUES + 1).agg(F.sum(F.greatest(F.size("x"), F.lit(1)))).first()[0] or 0
    return staged(patterns.select("x").distinct().withColumn("number", F.monotonically_increasing_id()), "pattern-numbers") if values <= NUMBERED_VALUES else None


def numbered(rows: DataFrame, numbers: DataFrame | None) -> DataFrame:
    """The rows with the number of their pattern as ``x``, which is cheaper to write and to group by than an array."""
    return rows if numbers is None else rows.join(F.broadcast(numbers), "x").drop("x").withColumnRenamed("number", "x")


def named(df: DataFrame, numbers: DataFrame | None) -> DataFrame:
    """``numbered`` undone."""
    return df if numbers is None else df.withColumnRenamed("x", "number").join(F.broadcast(numbers), "number").drop("number")


def sum_score(x: str = "x", idx: str = "item_idx") -> Column:
    """Left-to-right double sum of the chosen items."""
    return F.aggregate(F.col(idx), F.lit(0.0), lambda a, i: a + F.get(F.col(x), i))


def score_frequencies(patterns: DataFrame, candidates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, combo_id, n_items, score, p, n): positives and negatives at each observed score.

    ``candidates`` is small and broadcast; only counts of scores are shuffled.
    """
    scored = patterns.crossJoin(candidates.select("combo_id", "n_items", "item_idx"))
    return scored.withColumn("score", sum_score()).groupBy(*keys, "combo_id", "n_items", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles, null where b is zero."""
    return F.when(b > 0, a.cast("double") / b.cast("double"))


def roc_table(freq: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each observed score as cutoff, with its counts and statistics.

    One sort per key: what lies below a score gives true negatives and missed positives.
    """
    whole, below = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    t = freq.select(
        "*", F.sum("p").over(whole).alias("n_positive"), F.sum("n").over(whole).alias("n_negative"),
        F.coalesce(F.sum("p").over(below), zero).alias("fn"), F.coalesce(F.sum("n").over(below), zero).alias("tn"),
    )
    t = t.withColumn("tp", F.col("n_positive") - F.col("fn")).withColumn("fp", F.col("n_negative") - F.col("tn"))
    return with_metrics(t).withColumnRenamed("score", "cutoff")


def with_metrics(t: DataFrame) -> DataFrame:
    """sensitivity, specificity, youden, accuracy, ppv and npv from tp, fp, fn and tn; null on a zero denominator."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    t = t.withColumn("sensitivity", ratio(tp, tp + fn)).withColumn("specificity", ratio(tn, tn + fp))
    t = t.withColumn("youden", F.col("sensitivity") + F.col("specificity") - F.lit(1.0)).withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn))
    return t.withColumn("ppv", ratio(tp, tp + fp)).withColumn("npv", ratio(tn, tn + fn))


def cutoff_order(method: str) -> Column:
    """What is largest at the optimal cutoff."""
    if method == "youden":
        return F.struct("youden", "sensitivity", "specificity", (-F.col("cutoff")).alias("low"))
    a, b = F.lit(1.0) - F.col("sensitivity"), F.lit(1.0) - F.col("specificity")
    return F.struct((-F.sqrt(a * a + b * b)).alias("near"), F.col("youden").alias("then"), F.col("cutoff").alias("high"))


def wins(freq: DataFrame) -> list[Column]:
    """Aggregates of twice the pairs that scores' positives win, ties half, by places of wide counts: negatives below are true negatives."""
    won = F.lit(2) * F.col("tn") + F.col("n")
    made = exact.limb_products(F.col("p"), won) if exact.is_wide(freq) else [total(wide(F.col("p")) * wide(won))]
    return [c.alias(f"wins{i}") for i, c in enumerate(made)]


def auc_column(n_parts: int) -> Column:
    """AUC from the sums of ``wins`` and the class sizes, null where a class is missing."""
    pairs = F.lit(2.0) * F.col("n_positive") * F.col("n_negative")
    own = [F.col(f"wins{i}") for i in range(n_parts)]
    return F.when(pairs > 0, (own[0].cast("double") if n_parts == 1 else exact.limb_double(own)) / pairs).alias("auc")


def candidate_table(freq: DataFrame, keys: Sequence[str] = ("combo_id", "n_items"), method: str = "youden") -> DataFrame:
    """A row for each key: AUC and the statistics at the optimal cutoff.

    The aggregate uses the partitioning and sort of the windows below it.
    """
    t = roc_table(freq, keys)
    kept = ("cutoff", "sensitivity", "specificity", "youden", "accuracy", "ppv", "npv", "tp", "fp", "fn", "tn")
    won = wins(freq)
    best = t.groupBy(*keys).agg(
        *won, F.first("n_positive").alias("n_positive"), F.first("n_negative").alias("n_negative"),
        F.max_by(F.struct(*kept), cutoff_order(method)).alias("b"),
    )
    return best.select(*keys, auc_column(len(won)), "b.*", "n_positive", "n_negative")


def auc_of(freq: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, auc, n_positive, n_negative): null where a class is missing."""
    below = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    t = freq.withColumn("tn", F.coalesce(F.sum("n").over(below), F.lit(0).cast("long")))
    won = wins(freq)
    a = t.groupBy(*keys).agg(*won, F.sum("p").alias("n_positive"), F.sum("n").alias("n_negative"))
    return a.select(*keys, auc_column(len(won)), "n_positive", "n_negative")
