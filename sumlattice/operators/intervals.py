"""Confidence intervals: DeLong for AUC from score frequencies, Clopper-Pearson for shares."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.intervals import check_level, clopper_pearson, normal_quantile

#: Candidates up to which those kept are broadcast.
BROADCAST_CANDIDATES = 20_000
#: Shares with intervals, and the counts they are of: (numerator, denominator).
SHARES = {
    "sensitivity": ("tp", ("tp", "fn")), "specificity": ("tn", ("tn", "fp")), "accuracy": (("tp", "tn"), ("tp", "tn", "fp", "fn")),
    "ppv": ("tp", ("tp", "fp")), "npv": ("tn", ("tn", "fn")),
}
DELONG = ("auc", "auc_se", "auc_lower", "auc_upper")
INTERLEAVED = [c for m in ("auc", "cutoff", "sensitivity", "specificity", "youden", "accuracy", "ppv", "npv") for c in ([m] if m in ("cutoff", "youden") else [m, f"{m}_lower", f"{m}_upper"])]


def delong(freq: DataFrame, keys: Sequence[str] = ("combo_id",), level: float = 0.95) -> DataFrame:
    """(keys, auc, auc_se, auc_lower, auc_upper) from (keys, score, p, n).

    With a the doubled placement value of a score's positives and b that of its
    negatives, both variances are quotients of integer sums, exact whatever the order and
    the counts.  Sums are made in the plan; a candidate's few of them meet on arrays.
    A class of fewer than two rows leaves the interval null.
    """
    z = normal_quantile(1 - (1 - check_level(level)) / 2)
    below = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    t = freq.withColumn("nb", F.coalesce(F.sum("n").over(below), zero)).withColumn("pb", F.coalesce(F.sum("p").over(below), zero))
    t = t.withColumn("all_p", F.sum("p").over(Window.partitionBy(*keys)))
    a = F.lit(2) * F.col("nb") + F.col("n")
    b = F.lit(2) * (F.col("all_p") - F.col("pb")) - F.col("p")
    wide = exact.is_wide(freq)
    squares = lambda w, v: exact.limb_products(w, v, v) if wide else exact.square_parts(w, v)
    won = exact.limb_products(F.col("p"), a) if wide else [exact.total(exact.wide(F.col("p")) * exact.wide(a))]
    sums = {"wins": won, "a": squares(F.col("p"), a), "b": squares(F.col("n"), b)}
    s = t.groupBy(*keys).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), *(c.alias(f"{name}{i}") for name, parts in sums.items() for i, c in enumerate(parts)))
    n_parts = {name: len(parts) for name, parts in sums.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {c: exact.integers(batch.column(c).to_pylist()) for c in batch.schema.names[len(keys) :]}
            parts = {name: [own[f"{name}{i}"] for i in range(k)] for name, k in n_parts.items()}
            pos, neg, wins = own["n_pos"], own["n_neg"], exact.join_limbs(parts["wins"])
            p, n = exact.doubles(pos), exact.doubles(neg)
            spread = lambda total, side: exact.doubles(total * (exact.join_limbs(parts[side]) if wide else exact.join_parts(*parts[side])) - wins * wins)
            with np.errstate(divide="ignore", invalid="ignore"):
                auc = np.where((p > 0) & (n > 0), exact.doubles(wins) / (2.0 * p * n), np.nan)
                se = np.sqrt(spread(pos, "a") / (4.0 * p * n * n * (p - 1)) / p + spread(neg, "b") / (4.0 * n * p * p * (n - 1)) / n)
            se = np.where((p >= 2) & (n >= 2), se, np.nan)
            made = auc, se, np.maximum(0.0, auc - z * se), np.minimum(1.0, auc + z * se)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(v, from_pandas=True) for v in made)], [*keys, *DELONG])

    return s.mapInArrow(run, ", ".join([*(f"`{k}` {s.schema[k].dataType.simpleString()}" for k in keys), *(f"{c} double" for c in DELONG)]))


def share_intervals(df: DataFrame, level: float = 0.95) -> DataFrame:
    """The table with exact intervals of its shares, from tp, fp, fn and tn; those of all rows of a batch at once."""
    level = check_level(level)
    add = [f"{m}_{end}" for m in SHARES for end in ("lower", "upper")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"{c} double" for c in add])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = {c: b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("tp", "fp", "fn", "tn")}
            total = lambda names: sum(of[c] for c in ((names,) if isinstance(names, str) else names))
            k, n = (np.stack([total(s[i]) for s in SHARES.values()]) for i in (0, 1))
            low, high = clopper_pearson(k.ravel(), n.ravel(), level)
            ends = [pa.array(v, from_pandas=True) for pair in zip(low.reshape(k.shape), high.reshape(k.shape)) for v in pair]
            yield pa.RecordBatch.from_arrays([*b.columns, *ends], [*b.schema.names, *add])

    return df.mapInArrow(run, schema)


def with_counts(table: DataFrame) -> DataFrame:
    """The table with tp, fp, fn and tn, which rates and class sizes determine where it hasn't any; null where they are."""
    if {"tp", "fp", "fn", "tn"} <= {*table.columns}:
        return table
    pos, neg = (F.col(c).cast("long") for c in ("n_positive", "n_negative"))
    hit = lambda rate, n: F.round(F.col(rate).cast("double") * n).cast("long")
    table = table.drop("tp", "fp", "fn", "tn").withColumn("tp", hit("sensitivity", pos)).withColumn("tn", hit("specificity", neg))
    return table.withColumn("fn", pos - F.col("tp")).withColumn("fp", neg - F.col("tn"))


def with_intervals(top: DataFrame, patterns: DataFrame, level: float = 0.95) -> DataFrame:
    """The few candidates that were kept, with intervals; their scores are counted again, others' are not.

    ``top`` has combo_id, n_items and item_idx besides the candidate table's columns.
    """
    from .roc import score_frequencies

    few = top.limit(BROADCAST_CANDIDATES + 1).count() <= BROADCAST_CANDIDATES
    freq = score_frequencies(patterns, F.broadcast(top) if few else top)
    auc = delong(freq, ("combo_id",), level).select("combo_id", "auc_lower", "auc_upper")
    return share_intervals(top.join(auc, "combo_id"), level)
