"""Scoring of very many candidates: ranges of ranks against a broadcast pattern matrix.

A task unranks its range, histograms the scores of each class and picks the cutoff, all on
arrays.  Subsets in order share all items but the last: sums are made once for each such
prefix, and where items have few whole values, so are the histograms of all its subsets.
Results equal the relational plan's bit for bit.
With ``top_n`` a task passes on only its own best rows, as the final order needs no more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions import exact
from ..functions.combos import level_sizes, unrank_global

#: Bytes of scores that a task holds at a time, and of the patterns and counts that are broadcast, at most.
BATCH_BYTES = 32 << 20
#: Prefix scores times values of an item up to which histograms are matrix products, and bytes of the matrix of weights.
PRODUCT_CELLS, PRODUCT_BYTES = 128, 64 << 20
PATTERN_BYTES = 256 << 20
_FLOATS = ("auc", "cutoff", "sensitivity", "specificity", "youden", "accuracy", "ppv", "npv")
COUNTS = ("tp", "fp", "fn", "tn", "n_positive", "n_negative")


def schema_of(count: str = "long") -> str:
    return ", ".join(["combo_id long", "n_items int", "items string", *(f"{c} double" for c in _FLOATS), *(f"{c} {count}" for c in COUNTS)])


def holds(counts: DataFrame, n_items: int, groups: int = 1) -> bool:
    """Whether the matrix of these patterns, with the counts of so many groups, stays within PATTERN_BYTES."""
    most = PATTERN_BYTES // (8 * (n_items + 4 * groups))
    patterns = counts if groups == 1 else counts.select("x").distinct()
    return patterns.limit(most + 1).count() <= most


def tasks(spark: SparkSession, total: int, workers: int | None = None, chunk: int | None = None) -> int:
    """Tasks for so many candidates: ``workers`` or else up to four a core, and no task with more than ``chunk``."""
    n = workers or min(4 * spark.sparkContext.defaultParallelism, total // 2000)
    return max(1, n, math.ceil(total / chunk) if chunk else 1)


def _matrix(rows: pa.Table, n_items: int) -> np.ndarray:
    return rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(rows), n_items)


def _counts(rows: pa.Table, column: str) -> np.ndarray:
    return rows[column].to_numpy().astype(np.int64, copy=False)


def _places(rows: pa.Table, column: str) -> list[np.ndarray]:
    """Counts as longs, wide ones by limbs, least first: sums of either are exact."""
    if not pa.types.is_decimal(rows.schema.field(column).type):
        return [_counts(rows, column)]
    values = [int(v) for v in rows[column].to_pylist()]
    return [np.array([v // exact.LIMB**i % exact.LIMB for v in values], np.int64) for i in range(exact.LIMBS)]


def histograms(scores: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, positives, negatives) with a row for each candidate, scores ascending, zero counts where unused."""
    m, u = scores.shape
    low = scores.min(initial=0)
    span = scores.max(initial=0) - low
    if span <= 4 * u + 64 and (scores == np.floor(scores)).all():
        width = int(span) + 1
        at = (scores - low).astype(np.int64) + (np.arange(m) * width)[:, None]
        if ((p + n) == 1).all():
            pos, neg = np.bincount(at[:, p == 1].ravel(), minlength=m * width), np.bincount(at[:, n == 1].ravel(), minlength=m * width)
        else:
            pos = exact.bincount(at.ravel(), np.broadcast_to(p, (m, u)).ravel(), m * width)
            neg = exact.bincount(at.ravel(), np.broadcast_to(n, (m, u)).ravel(), m * width)
        return np.broadcast_to(low + np.arange(width, dtype=float), (m, width)), pos.reshape(m, width), neg.reshape(m, width)
    order = np.argsort(scores, 1, kind="stable")
    s = np.take_along_axis(scores, order, 1)
    pos, neg = np.cumsum(p[order], 1), np.cumsum(n[order], 1)
    last = np.append(s[:, 1:] != s[:, :-1], np.ones((m, 1), bool), 1)
    # Counts of a run of equal scores stand at its last place.
    at = np.maximum.accumulate(np.where(last, np.arange(u), -1), 1)
    before = np.append(np.full((m, 1), -1), at[:, :-1], 1)
    get = lambda c: np.where(before >= 0, np.take_along_axis(c, np.maximum(before, 0), 1), 0)
    return s, np.where(last, pos - get(pos), 0), np.where(last, neg - get(neg), 0)


class Fans:
    """Histograms of subsets, each prefix's at once.

    ``columns`` (items, patterns) are scores, ``weights`` the counts of patterns, any number
    of kinds.  With few whole values an item's value and the prefix's score say the score, so
    that one product of indicators, (prefix and score, pattern) by (pattern, item and value,
    weighted), counts both for all items that may follow.
    """

    def __init__(self, columns: np.ndarray, weights: Sequence[np.ndarray], max_items: int):
        self.columns, self.weights = columns, [*weights]
        low, high = columns.min(1, initial=np.inf), columns.max(1, initial=-np.inf)
        spans = high - low
        self.small = columns.shape[1] > 0 and bool(np.isfinite(spans).all() and (columns == np.floor(columns)).all() and np.abs(columns).max() < 2**40)
        if self.small:
            self.n_values = int(spans.max()) + 1
            scores = int(np.sort(spans)[::-1][: max(1, max_items - 1)].sum()) + 1
            total = max(int(w.sum(dtype=float)) for w in self.weights)
            self.kind = np.float32 if total < 2**24 else np.float64  # in which such sums are exact
            size = columns.size * self.n_values * len(self.weights) * np.dtype(self.kind).itemsize
            self.small = scores * self.n_values <= PRODUCT_CELLS and size <= PRODUCT_BYTES and total < 2**53
        if self.small:
            self.low, self.index = low, (columns - low[:, None]).astype(np.int64)
            marks = (self.index[:, :, None] == np.arange(self.n_values)).transpose(1, 0, 2).astype(self.kind)
            self.marked = [np.ascontiguousarray(marks * w[:, None, None].astype(self.kind)).reshape(columns.shape[1], -1) for w in self.weights]

    def prefix_sums(self, part: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first rows of runs of one prefix, sums of its items left to right)."""
        first = np.flatnonzero(np.append(True, (part[1:, :-1] != part[:-1, :-1]).any(1)))
        heads = part[first, :-1]
        sums = np.zeros((len(first), of.shape[1]), of.dtype)
        for j in range(heads.shape[1]):
            sums += of[heads[:, j]]
        return first, sums

    def scores(self, part: np.ndarray) -> np.ndarray:
        """The scores of subsets that follow one another in order."""
        first, sums = self.prefix_sums(part, self.columns)
        return np.repeat(sums, np.diff(np.append(first, len(part))), 0) + self.columns[part[:, -1]]

    def histograms(self, part: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(scores, counts of each kind), a row for each subset, where values are few."""
        first, sums = self.prefix_sums(part, self.index)
        which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(part))))
        n_scores, v = int(sums.max(initial=0)) + 1, self.n_values
        made = [np.zeros((len(part), n_scores + v - 1), self.kind) for _ in self.weights]
        following = part[first, -2] + 1 if part.shape[1] > 1 else np.zeros(len(first), np.int64)
        step = max(1, BATCH_BYTES // (8 * n_scores * max(1, self.columns.shape[1])))
        for start in np.unique(following):
            own = np.flatnonzero(following == start)
            for at in range(0, len(own), step):
                some = own[at : at + step]
                rows = np.flatnonzero((which >= some[0]) & (which <= some[-1]) & (following[which] == start))
                place, item = np.searchsorted(some, which[rows]), part[rows, -1] - start
                marks = (sums[some, None, :] == np.arange(n_scores)[None, :, None]).astype(self.kind).reshape(-1, sums.shape[1])
                for out, marked in zip(made, self.marked):
                    both = (marks @ marked[:, start * v :]).reshape(len(some), n_scores, -1, v)[place, :, item]
                    for value in range(v):  # a score is a prefix's and a value
                        out[rows, value : value + n_scores] += both[:, :, value]
        return self.low[part].sum(1)[:, None] + np.arange(n_scores + v - 1, dtype=float), [m.astype(np.int64) for m in made]


def statistics(values: np.ndarray, pos: np.ndarray, neg: np.ndarray, method: str) -> dict[str, np.ndarray]:
    """The candidate table's columns, a value for each row of histograms."""
    total_p, total_n = pos.sum(1), neg.sum(1)
    fn, tn = np.cumsum(pos, 1) - pos, np.cumsum(neg, 1) - neg
    wins = exact.doubles(exact.dot(pos, 2 * tn + neg))
    real = lambda v: v.astype(float)  # noqa: E731  # wide counts are Python's integers, whose own quotients would be rounded otherwise
    there = (pos + neg) > 0
    tp, fp = total_p[:, None] - fn, total_n[:, None] - tn
    with np.errstate(divide="ignore", invalid="ignore"):
        sens, spec = real(tp) / real(total_p)[:, None], real(tn) / real(total_n)[:, None]
        youden = sens + spec - 1.0
        if method == "youden":
            best = there
            for v in (youden, sens, spec):
                v = np.where(best, v, -np.inf)
                best = best & (v == v.max(1, keepdims=True))
            at = best.argmax(1)
        else:
            a, b = 1.0 - sens, 1.0 - spec
            far = np.where(there, np.sqrt(a * a + b * b), np.inf)
            best = there & (far == far.min(1, keepdims=True))
            v = np.where(best, youden, -np.inf)
            best &= v == v.max(1, keepdims=True)
            at = best.shape[1] - 1 - best[:, ::-1].argmax(1)
        row = np.arange(len(at))
        tp, fp, fn, tn = tp[row, at], fp[row, at], fn[row, at], tn[row, at]
        return {
            "auc": wins / (2.0 * real(total_p) * real(total_n)), "cutoff": values[row, at], "sensitivity": sens[row, at], "specificity": spec[row, at], "youden": youden[row, at],
            "accuracy": real(tp + tn) / real(total_p + total_n), "ppv": real(tp) / real(tp + fp), "npv": real(tn) / real(tn + fn), "tp": tp, "fp": fp, "fn": fn, "tn": tn, "n_positive": total_p, "n_negative": total_n,
        }


def score(spark: SparkSession, patterns: DataFrame, items: Sequence[str], min_items: int, max_items: int, method: str = "youden", start: int = 0, size: int | None = None, top_n: int | None = None, order: Sequence[tuple[str, bool]] = (), workers: int | None = None, chunk: int | None = None) -> DataFrame:
    """The candidate table of ranks [start, start + size).

    ``patterns`` (x, p, n) are broadcast as arrays, PATTERN_BYTES at most; more is an
    error, for which the relational plan is the way.  ``order`` lists (column, descending);
    its first column descends.
    """
    if not holds(patterns, len(items)):
        raise ValueError("more distinct rows than the kernel holds; use the relational engine")
    rows = patterns.select("x", "p", "n").toArrow()
    names, levels = [*items], level_sizes(len(items), min_items, max_items)
    total = sum(c for _, c in levels)
    end = total if size is None else min(total, start + size)
    shared = spark.sparkContext.broadcast((np.ascontiguousarray(_matrix(rows, len(names)).T), _places(rows, "p"), _places(rows, "n")))
    wide = exact.is_wide(patterns)
    step = max(1, BATCH_BYTES // (8 * max(1, len(rows))))

    def best(df: pd.DataFrame) -> pd.DataFrame:
        if top_n is None or len(df) <= top_n:
            return df
        by = [c for c, _ in order]
        return df.sort_values(by, ascending=[not d for _, d in order], na_position="last", kind="stable").head(top_n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, p, n = shared.value
        fans = Fans(columns, (*p, *n), levels[-1][0])
        held: list[pd.DataFrame] = []
        floor = -np.inf
        for b in batches:
            ids = b["id"].to_numpy()
            for at, idx in unrank_global(len(names), levels, ids):
                for lo in range(0, len(at), step):
                    part, own = idx[lo : lo + step], ids[at[lo : lo + step]]
                    if fans.small:
                        values, counted = fans.histograms(part)
                        pos, neg = counted[: len(p)], counted[len(p) :]
                    else:
                        scores = fans.scores(part)
                        values, pos, neg = zip(*(histograms(scores, *own) for own in zip(p, n)))
                        values = values[0]
                    found = statistics(values, exact.join_limbs(pos), exact.join_limbs(neg), method)
                    if top_n is not None:
                        # Rows below the worst of the best so far needn't become a table.
                        v = np.nan_to_num(found[order[0][0]].astype(float), nan=-np.inf)
                        if len(v) > top_n:
                            floor = max(floor, np.partition(v, len(v) - top_n)[len(v) - top_n])
                        on = np.flatnonzero(v >= floor)
                        part, own, found = part[on], own[on], {k: c[on] for k, c in found.items()}
                    if len(own):
                        held.append(pd.DataFrame({"combo_id": own, "n_items": np.int32(part.shape[1]), **found, "at": [*part]}))
                    if top_n is not None and len(held) > 8:
                        held = [best(pd.concat(held))]
            if top_n is None and held:
                yield named(pd.concat(held))
                held = []
        if held:
            yield named(best(pd.concat(held)))

    def named(df: pd.DataFrame) -> pd.DataFrame:
        df = df.assign(items=[", ".join(names[i] for i in x) for x in df["at"]])
        if wide:
            df = df.assign(**{c: [Decimal(int(v)) for v in df[c]] for c in COUNTS})
        return df[["combo_id", "n_items", "items", *_FLOATS, *COUNTS]]

    made = spark.range(start, end, 1, tasks(spark, end - start, workers, chunk)).mapInPandas(run, schema_of(exact.WIDE if wide else "long"))
    return nan_to_null(made)


def score_folds(spark: SparkSession, counts: DataFrame, items: Sequence[str], min_items: int, max_items: int, top_n: int, order: Sequence[tuple[str, bool]], method: str = "youden", workers: int | None = None, chunk: int | None = None) -> DataFrame:
    """The best ``top_n`` candidates of each task for each fold's training set.

    ``counts`` (repeat, fold, x, p, n) are test counts of patterns, PATTERN_BYTES at most
    with those of every fold; a training set has those of its repeat's other folds.  A
    candidate's scores are added up once for all folds.
    """
    names, levels = [*items], level_sizes(len(items), min_items, max_items)
    if not holds(counts, len(names), counts.select("repeat", "fold").distinct().count()):
        raise ValueError("more distinct rows and folds than the kernel holds; use the relational plan")
    rows = counts.select("repeat", "fold", "x", "p", "n").toArrow()
    x, place = np.unique(_matrix(rows, len(names)), axis=0, return_inverse=True)
    groups, at = np.unique(np.stack([_counts(rows, "repeat"), _counts(rows, "fold")], 1), axis=0, return_inverse=True)
    own = np.zeros((2, len(groups), len(x)), np.int64)
    for side, c in enumerate(("p", "n")):
        np.add.at(own[side], (at.ravel(), place.ravel()), _counts(rows, c))
    train = np.stack([own[:, groups[:, 0] == r].sum(1) for r in groups[:, 0]], 1) - own
    shared = spark.sparkContext.broadcast((np.ascontiguousarray(x.T), train, groups.tolist()))
    step = max(1, BATCH_BYTES // (8 * max(1, len(x))))
    by, up = [c for c, _ in order], [not d for _, d in order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, (p, n), of = shared.value
        fans = Fans(columns, [w for g in range(len(of)) for w in (p[g], n[g])], levels[-1][0])
        held: list[list[pd.DataFrame]] = [[] for _ in of]
        first = lambda parts: pd.concat(parts).sort_values(by, ascending=up, na_position="last", kind="stable").head(top_n)
        for b in batches:
            ids = b["id"].to_numpy()
            for places, idx in unrank_global(len(names), levels, ids):
                for lo in range(0, len(places), step):
                    part, combo = idx[lo : lo + step], ids[places[lo : lo + step]]
                    if fans.small:
                        values, counted = fans.histograms(part)
                    else:
                        scores = fans.scores(part)
                    for g in range(len(of)):
                        if fans.small:
                            found = statistics(values, counted[2 * g], counted[2 * g + 1], method)
                        else:
                            there = (p[g] + n[g]) > 0
                            found = statistics(*histograms(scores[:, there], p[g][there], n[g][there]), method)
                        made = pd.DataFrame({"combo_id": combo, "n_items": np.int32(part.shape[1]), **found})
                        made["item_idx"] = [*part]
                        held[g] = [first([*held[g], made])]
        for (r, f), parts in zip(of, held):
            if parts:
                out = parts[0].assign(repeat=np.int32(r), fold=np.int32(f))
                out["items"] = [", ".join(names[i] for i in c) for c in out["item_idx"]]
                yield out[["repeat", "fold", "combo_id", "n_items", "items", "item_idx", *_FLOATS, "tp", "fp", "fn", "tn", "n_positive", "n_negative"]]

    total = sum(c for _, c in levels)
    made = spark.range(0, total, 1, tasks(spark, total, workers, chunk)).mapInPandas(run, "repeat int, fold int, " + schema_of().replace("items string", "items string, item_idx array<int>"))
    return nan_to_null(made)


def nan_to_null(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in _FLOATS else F.col(c) for c in df.columns))
