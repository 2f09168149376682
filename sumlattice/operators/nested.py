"""Nested cross-validation of sum scores, all folds at once.

Score counts add up, so those of a training set are the whole table's less those of
its test fold: every candidate is scored once, whatever the number of folds.  A score
that only the test fold has is not in the training table.  Counts and choices, which
are small whatever the number of rows, are written once, as several outputs read them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.combos import candidates as subsets
from ..functions.combos import count_combinations
from ..functions.parsing import CRITERIA, CUTOFF_METHODS, choice
from ..sources.staging import few, scratch, staged
from . import kernel
from .folds import stratified_folds
from .inner import divided
from .intervals import BROADCAST_CANDIDATES
from .ranking import first_per, preselect_order
from .roc import auc_of, candidate_table, compress, named, numbered, pattern_numbers, score_frequencies, sum_score, with_metrics


SUMMARY = ("outer_fold", "selected_items", "n_items", "auc", "cutoff", "sensitivity", "specificity", "youden", "accuracy", "ppv", "npv")
#: Candidates that the plan beyond the kernel broadcasts at a time, 20 MB about.
CANDIDATE_BLOCK = 200_000


@dataclass
class NestedResult:
    """Tables of a nested cross-validation; ``summary`` has a row for each outer fold."""

    summary: DataFrame
    outer_results: DataFrame
    selected_models: DataFrame
    selected_model_frequency: DataFrame
    outer_predictions: DataFrame
    settings: dict

    def report(self) -> str:
        from ..functions.report import nested_report

        return nested_report(self)

    def summary_report(self) -> str:
        from ..functions.report import nested_summary

        return nested_summary(self)

    def plot_data(self, kind: str = "auc") -> DataFrame:
        """What a chart of outer AUCs ("auc") or of chosen sets ("selection") is drawn from."""
        from ..functions.report import auc_plot_data, selection_plot_data

        return {"auc": auc_plot_data, "selection": selection_plot_data}[choice(kind, ("auc", "selection"), "kind")](self)

    __str__ = report


def train_frequencies(test: DataFrame, keys: Sequence[str], fold_keys: Sequence[str], fold: str, folds: DataFrame | None = None) -> DataFrame:
    """Training counts of every fold from test counts (keys, fold, score, p, n), by subtraction.

    ``keys`` name a candidate within its ``fold_keys`` (those that folds belong to).
    ``folds`` (fold_keys, fold) are all folds, read from ``test``, which is written then, if not given.
    """
    folds = few(test.select(*fold_keys, fold).distinct()) if folds is None else F.broadcast(folds)
    # A score's counts in each fold, as many as there are folds, stay together.
    cells = test.groupBy(*keys, "score").agg(F.sum("p").alias("p_all"), F.sum("n").alias("n_all"), F.map_from_entries(F.collect_list(F.struct(fold, F.struct("p", "n")))).alias("own"))
    every = cells.join(folds, [*fold_keys]).withColumn("own", F.try_element_at("own", F.col(fold)))
    p, n = F.col("p_all") - F.coalesce("own.p", F.lit(0)), F.col("n_all") - F.coalesce("own.n", F.lit(0))
    return every.select(*keys, fold, "score", p.alias("p"), n.alias("n")).where("p + n > 0")


def train_search(folds: DataFrame, candidates: DataFrame, method: str = "youden") -> tuple[DataFrame, DataFrame]:
    """(candidate table for each training set, test counts of each fold) for all candidates."""
    test = staged(score_frequencies(compress(folds, ["repeat", "fold"]), candidates, ["repeat", "fold"]), "test-counts")
    keys = ["repeat", "combo_id", "n_items"]
    return candidate_table(train_frequencies(test, keys, ["repeat"], "fold"), ["repeat", "fold", "combo_id", "n_items"], method), test


def at_cutoff(test: DataFrame, cutoffs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and statistics of test scores at the training cutoff, and the test AUC (null if a class is missing)."""
    j = test.join(cutoffs.select(*keys, "cutoff"), [*keys])
    hit = F.col("score") >= F.col("cutoff")
    c = j.groupBy(*keys, "cutoff").agg(*(F.sum(F.when(cond, F.col(v)).otherwise(0)).alias(a) for a, cond, v in (("tp", hit, "p"), ("fp", hit, "n"), ("fn", ~hit, "p"), ("tn", ~hit, "n"))))
    return with_metrics(c).join(auc_of(j, keys).select(*keys, "auc"), [*keys])


def fold_mean(value: Column, fold: str) -> Column:
    """Mean over folds that adds in the order of folds, nulls left out."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(fold).alias("f"), value.alias("v")))))
    return F.when(F.size(pairs) > 0, F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["v"]) / F.size(pairs))


#: Inner folds: each candidate's own, or one division of an outer training set for all its candidates.
INNER_FOLDS = ("own", "shared")


def inner_cv(folds: DataFrame, chosen: DataFrame, k: int, seed: int, outer_k: int, method: str = "youden", inner_folds: str = "own", numbers: DataFrame | None = None) -> DataFrame:
    """Means of each preselected candidate over inner folds of its outer training set.

    ``folds`` has a row for each row and repeat, ``chosen`` (repeat, fold, position,
    combo_id, n_items, item_idx) is what the first search kept.  With "own" inner folds the
    i-th outer fold's j-th candidate has folds from seed + i + j, with "shared" ones all have
    those of seed + i.  Either way rows become counts of patterns for each division, and
    only patterns meet candidates.  ``numbers`` are the patterns of ``folds`` whose ``x`` are numbers.
    """
    choice(inner_folds, INNER_FOLDS, "inner_folds")
    number = ((F.col("repeat") - 1) * F.lit(outer_k) + F.col("outer_fold")).cast("int")
    chosen = chosen.withColumnRenamed("fold", "outer_fold").withColumn("seed", F.lit(seed) + number + (F.col("position") if inner_folds == "own" else F.lit(0)))
    patterns = named(divided(folds, chosen.select("repeat", "outer_fold", "seed").distinct(), k), numbers)
    ids = ["repeat", "outer_fold", "position", "combo_id", "n_items"]
    scored = patterns.join(few(chosen, BROADCAST_CANDIDATES), ["repeat", "outer_fold", "seed"]).withColumn("score", sum_score())
    cells = staged(scored.groupBy(*ids, "inner", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), "inner-counts")
    train = candidate_table(train_frequencies(cells, ids, ids[:3], "inner"), [*ids, "inner"], method)
    test = at_cutoff(cells, train, [*ids, "inner"])
    return test.groupBy(*ids).agg(
        fold_mean(F.coalesce("auc", F.lit(0.5)), "inner").alias("mean_auc"), fold_mean(F.col("sensitivity"), "inner").alias("mean_sensitivity"),
        fold_mean(F.col("specificity"), "inner").alias("mean_specificity"), fold_mean(F.col("youden"), "inner").alias("mean_youden"),
    )


def kept_per_fold(counts: DataFrame, blocks: Iterable[DataFrame], top_n: int, by: str, method: str = "youden") -> DataFrame:
    """The best ``top_n`` candidates of each training set, with the search's columns.

    ``counts`` (repeat, fold, x, p, n) are test counts of patterns, written; ``blocks`` are
    tables of candidates, each of which is broadcast in its turn.  What is kept is carried
    from block to block, so that no table holds more than a block's candidates of every fold.
    """
    kept, folds = None, staged(counts.select("repeat", "fold").distinct(), "fold-names")
    for block in blocks:
        test = score_frequencies(counts, F.broadcast(block), ["repeat", "fold"])
        found = candidate_table(train_frequencies(test, ["repeat", "combo_id", "n_items"], ["repeat"], "fold", folds), ["repeat", "fold", "combo_id", "n_items"], method)
        found = first_per(found, ["repeat", "fold"], preselect_order(by), top_n).join(F.broadcast(block.select("combo_id", "items", "item_idx")), "combo_id")
        if kept is not None:
            found = first_per(kept.unionByName(found).drop("position"), ["repeat", "fold"], preselect_order(by), top_n)
        kept = staged(found, "kept")
    return kept


def nested_cv(rows: DataFrame, candidates: DataFrame | None, outer_k: int = 5, inner_k: int = 4, outer_repeats: int = 1, preselect_top_n: int = 20, preselect_by: str = "auc", selection_criterion: str = "auc", method: str = "youden", seed: int = 1, space: tuple[Sequence[str], int, int] | None = None, inner_folds: str = "own", workers: int | None = None, chunk: int | None = None, patterns: DataFrame | None = None) -> NestedResult:
    """Nested cross-validation of (row_id, y, x) over the candidates.

    For very many candidates give ``space`` (items, min_items, max_items) instead: the
    kernel searches it for all folds at once.  Where the kernel can't hold the patterns,
    ``space`` is scored as a plan, CANDIDATE_BLOCK candidates at a time.  ``patterns`` of the
    rows are counted here if not given.

    Search, cutoffs and choice see an outer fold's training rows only; the chosen set
    meets its test rows once.
    """
    choice(preselect_by, CRITERIA, "preselect_by"), choice(selection_criterion, CRITERIA, "selection_criterion"), choice(method, CUTOFF_METHODS, "cutoff_method"), choice(inner_folds, INNER_FOLDS, "inner_folds")
    with scratch(rows.sparkSession, results=False):
        numbers = pattern_numbers(compress(rows) if patterns is None else patterns)
        folds = staged(stratified_folds(numbered(rows, numbers), outer_k, outer_repeats, seed).drop("fold_name"), "folds")
        k = folds.agg(F.max("fold")).first()[0]
        counts = staged(named(compress(folds, ["repeat", "fold"]), numbers), "fold-patterns")
        if space is not None and not kernel.holds(counts, len(space[0]), k * outer_repeats):
            # More than the kernel holds: the plan, whose results are equal, in blocks.
            total = count_combinations([*space[0]], *space[1:])
            kept = kept_per_fold(counts, (subsets(rows.sparkSession, *space, at, CANDIDATE_BLOCK) for at in range(0, total, CANDIDATE_BLOCK)), preselect_top_n, preselect_by, method)
        elif space is None:
            kept = kept_per_fold(counts, [candidates], preselect_top_n, preselect_by, method)
        else:
            order = [(c, True) for c in dict.fromkeys((preselect_by, "youden", "sensitivity", "specificity"))] + [("n_items", False), ("combo_id", False)]
            found = kernel.score_folds(rows.sparkSession, counts, *space, preselect_top_n, order, method, workers, chunk)
            kept = staged(first_per(found, ["repeat", "fold"], preselect_order(preselect_by), preselect_top_n), "kept")
        inner = inner_cv(folds, kept.select("repeat", "fold", "position", "combo_id", "n_items", "item_idx"), inner_k, seed, k, method, inner_folds, numbers)
        best = first_per(inner.withColumnRenamed("outer_fold", "fold"), ["repeat", "fold"], [F.desc_nulls_last(f"mean_{selection_criterion}"), F.asc("position")], 1, "pick")
        keys = ["repeat", "fold", "combo_id", "n_items"]
        picked = staged(best.select(*keys, F.col(f"mean_{selection_criterion}").alias("criterion"), "mean_auc", "mean_youden").join(kept.select(*keys, "items", "item_idx", "cutoff"), keys), "picked")
        if (usable := picked.where("criterion IS NOT NULL").count()) < k * outer_repeats:
            raise ValueError(f"{k * outer_repeats - usable} outer folds have no candidate with a mean {selection_criterion} over inner folds")
        own = counts.join(F.broadcast(picked.select("repeat", "fold", "combo_id", "n_items", "item_idx")), ["repeat", "fold"])  # a candidate for each fold
        test = own.groupBy(*keys, sum_score().alias("score")).agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        shown = at_cutoff(test, picked, keys).drop("cutoff")
        name = F.concat(F.lit("Rep"), F.col("repeat").cast("string"), F.lit("_Fold"), F.col("fold").cast("string"))
        out = picked.join(shown, keys).withColumn("outer_fold", name).withColumnRenamed("items", "selected_items")
        results = out.select(*SUMMARY, F.col("mean_auc").alias("inner_mean_auc"), F.col("mean_youden").alias("inner_mean_youden"))
        results, n_folds = staged(results, "outer-results", result=True), k * outer_repeats
        frequency = results.groupBy(F.col("selected_items").alias("items")).agg(F.count("*").alias("n_selections")).withColumn("frequency", F.col("n_selections") / F.lit(float(n_folds))).orderBy(F.desc("frequency"), "items")
        chosen = F.broadcast(picked.select("repeat", "fold", name.alias("outer_fold"), "item_idx", "cutoff"))
        predicted = named(folds.join(chosen, ["repeat", "fold"]), numbers).withColumn("predicted_score", sum_score())
        predictions = predicted.select(F.col("row_id").alias("row_index"), F.col("y").alias("true_outcome"), "predicted_score", (F.col("predicted_score") >= F.col("cutoff")).cast("int").alias("predicted_class"), "outer_fold")
        predictions, summary = staged(predictions, "outer-predictions", result=True), results.select(*SUMMARY)
        settings = {"outer_k": k, "inner_k": inner_k, "outer_repeats": outer_repeats, "preselect_top_n": preselect_top_n, "preselect_by": preselect_by, "selection_criterion": selection_criterion, "cutoff_method": method, "inner_folds": inner_folds, "seed": seed}
        return NestedResult(summary, results, summary.select("outer_fold", "selected_items"), frequency, predictions, settings)
