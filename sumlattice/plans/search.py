"""Exhaustive searches over item subsets: strict, lenient ("brute force") and final fits."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.combos import candidate_rows, candidates, count_combinations, whole
from ..functions.intervals import check_level
from ..functions.parsing import CUTOFF_METHODS, RANK_COLUMNS, choice, describe_item_count, item_bounds, resolve_items, resolve_parallel
from ..operators import kernel
from ..operators.intervals import INTERLEAVED, with_counts, with_intervals
from ..operators.ranking import candidate_order, ranked
from ..operators.roc import candidate_table, score_frequencies, with_metrics
from ..sources.prepare import prepared
from ..sources.staging import scratch, staged

#: Patterns times candidates up to which the relational plan is chosen.
RELATIONAL_PAIRS = 20_000_000
RELATIONAL_CANDIDATES = 20_000
#: Candidates that the relational plan broadcasts at a time, 20 MB about.
CANDIDATE_BLOCK = 200_000
COLUMNS = ("rank", "items", "n_items", "auc", "cutoff", "sensitivity", "specificity", "youden", "accuracy", "ppv", "npv", "n_positive", "n_negative")


def with_names(df: DataFrame, items: list[str]) -> DataFrame:
    """The table with item names beside ``item_idx``."""
    names = F.array(*map(F.lit, items))
    return df.withColumn("items", F.array_join(F.transform("item_idx", lambda i: F.get(names, i)), ", "))


def score_all(patterns: DataFrame, items: list[str], low: int, high: int, method: str, engine: str = "auto", rank_by: str = "auc", prefer_fewer: bool = True, top_n: int | None = None, start: int = 0, size: int | None = None, workers: int | None = None, chunk: int | None = None) -> DataFrame:
    """The unranked candidate table by the engine asked for, or by the number of pairs it would compare.

    ``workers`` and ``chunk`` bound the kernel's tasks.  The relational plan takes more
    than CANDIDATE_BLOCK candidates in blocks, whose tables are written.
    """
    spark, total = patterns.sparkSession, count_combinations(items, low, high)
    if not 0 <= start < total:
        raise ValueError("the chunk starts beyond the last subset")
    asked = min(total - start, total if size is None else size)
    engine = {"R": "relational", "Rcpp": "auto"}.get(engine, engine)
    choice(engine, ("auto", "relational", "kernel"), "engine")
    if engine == "auto":
        # Patterns are counted no further than the question needs.
        most = RELATIONAL_PAIRS // max(1, asked)
        few = asked <= RELATIONAL_CANDIDATES and patterns.limit(most + 1).count() <= most
        engine = "relational" if few or not kernel.holds(patterns, len(items)) else "kernel"
    if engine == "kernel":
        order = [(rank_by, True), *([("n_items", False)] if prefer_fewer else []), ("combo_id", False)]
        return kernel.score(spark, patterns, items, low, high, method, start, size, top_n, order, workers, chunk)

    def block(at: int, n: int) -> DataFrame:
        own = candidate_rows(spark, items, low, high) if total <= RELATIONAL_CANDIDATES else F.broadcast(candidates(spark, items, low, high, at, n))
        own = own.where((F.col("combo_id") >= at) & (F.col("combo_id") < at + n))
        made = candidate_table(score_frequencies(patterns, own), method=method)
        return made.join(own.select("combo_id", "items"), "combo_id")

    if asked <= CANDIDATE_BLOCK:
        return block(start, asked)
    patterns, end = staged(patterns, "patterns"), start + asked
    best = (lambda t: t.orderBy(*candidate_order(rank_by, prefer_fewer)).limit(top_n)) if top_n is not None else (lambda t: t)
    return reduce(DataFrame.unionByName, [staged(best(block(at, min(CANDIDATE_BLOCK, end - at))), "block") for at in range(start, end, CANDIDATE_BLOCK)])


def _bounds(items: list[str], min_items: int, max_items: int) -> tuple[int, int]:
    return whole(min_items, "min_items"), whole(max_items, "max_items")


def exhaustive_search(df: DataFrame, outcome: str, items: object, min_items: int = 1, max_items: int = 4, positive_label: object = 1, negative_label: object = 0, cutoff_method: str = "youden", rank_by: str = "auc", top_n: int | None = None, prefer_fewer_items: bool = True, ci: bool = False, conf_level: float = 0.95, engine: str = "auto", parallel: object = "none", chunk_start: int | None = None, chunk_size: int | None = None, n_workers: int | None = None) -> DataFrame:
    """All subsets of a strict table, scored and ranked.

    With both ``chunk_start`` (0-based) and ``chunk_size`` only those ranks are scored, in
    order of enumeration and without ``top_n``; ``rank`` is then the place in the chunk.
    ``n_workers`` is the number of the kernel's tasks.
    """
    choice(cutoff_method, CUTOFF_METHODS, "cutoff_method"), choice(rank_by, RANK_COLUMNS, "rank_by"), resolve_parallel(parallel, "exhaustive")
    names = resolve_items(df, items)
    low, high = _bounds(names, min_items, max_items)
    if top_n is not None:
        whole(top_n, "top_n")
    if n_workers is not None:
        whole(n_workers, "n_workers")
    patterns = prepared(df, outcome, names, positive_label, negative_label).patterns
    if chunk_start is not None and chunk_size is not None:
        made = score_all(patterns, names, low, high, cutoff_method, engine, start=whole(chunk_start, "chunk_start", 0), size=whole(chunk_size, "chunk_size"), workers=n_workers)
        made = made.withColumn("rank", (F.col("combo_id") - chunk_start + 1).cast("int"))
        return made.select(*COLUMNS, "combo_id")
    made = score_all(patterns, names, low, high, cutoff_method, engine, rank_by, prefer_fewer_items, top_n, workers=n_workers)
    out = ranked(made, candidate_order(rank_by, prefer_fewer_items), top_n)
    return attach_intervals(out, patterns, names, conf_level, low, high) if ci else out.select(*COLUMNS, "combo_id")


def attach_intervals(out: DataFrame, patterns: DataFrame, names: list[str], conf_level: float, low: int, high: int) -> DataFrame:
    """Interleaved intervals for a ranked table of subsets of ``low`` to ``high`` items, looked up by name or, where names have commas, by rank."""
    check_level(conf_level)
    if not any("," in n for n in names):
        index = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
        top = out.withColumn("item_idx", F.transform(F.split("items", ", "), lambda n: index[n]))
    else:
        top = out.join(candidates(out.sparkSession, names, low, min(high, len(names))).select("combo_id", "item_idx"), "combo_id")
    return with_intervals(with_counts(top), patterns, conf_level).select("rank", "items", "n_items", *INTERLEAVED, "n_positive", "n_negative", "combo_id").orderBy("rank")


def add_intervals(table: DataFrame, df: DataFrame, outcome: str, items: object, positive_label: object = 1, negative_label: object = 0, conf_level: float = 0.95, lenient: bool = True) -> DataFrame:
    """Intervals for a candidate table of an earlier search of ``df``, whatever of its columns is left.

    The table needs ``items``, AUC, cutoff, sensitivity, specificity and class sizes, as numbers
    or as a CSV file's text; counts and other rates are recovered from them.  Without ``rank`` rows keep the order of their AUC.
    Names of items mustn't have commas, and a set that names no item of ``df`` is an error.
    """
    names = resolve_items(df, items)
    if any("," in n for n in names):
        raise ValueError("names of items mustn't have commas")
    kinds = {"n_items": "int", "n_positive": "long", "n_negative": "long", "rank": "int", "combo_id": "long"} | {c: "double" for c in COLUMNS[3:11]}
    table = table.select(*(F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in table.columns))
    if gone := [c for c in ("items", "auc", "cutoff", "sensitivity", "specificity", "n_positive", "n_negative") if c not in table.columns]:
        raise ValueError(f"the table has no {', '.join(gone)}")
    known = F.array(*map(F.lit, names))
    if (wrong := table.where(F.exists(F.split("items", ", "), lambda n: ~F.array_contains(known, n))).first()) is not None:
        raise ValueError(f"the table has a set of other items: {wrong['items']}")
    had = {*table.columns}
    if "combo_id" not in had:  # sets are told apart by their names
        table = table.withColumn("combo_id", F.xxhash64("items"))
    if "n_items" not in had:
        table = table.withColumn("n_items", F.size(F.split("items", ", ")))
    if "rank" not in had:
        table = ranked(table, [F.desc_nulls_last("auc"), F.asc("n_items"), F.asc("items")])
    patterns = prepared(df, outcome, names, positive_label, negative_label, lenient=lenient).patterns
    rates = with_metrics(with_counts(table).drop("sensitivity", "specificity", "youden", "accuracy", "ppv", "npv"))
    out = attach_intervals(rates, patterns, names, conf_level, 1, len(names))
    return out if "combo_id" in had else out.drop("combo_id")


def final_fit(df: DataFrame, outcome: str, items: object, min_items: int = 1, max_items: int = 4, positive_label: object = 1, negative_label: object = 0, cutoff_method: str = "youden", rank_by: str = "auc", top_n: int | None = 20, prefer_fewer_items: bool = True, ci: bool = True, conf_level: float = 0.95, engine: str = "auto") -> DataFrame:
    """The search on all data, its performance being apparent, not validated; with intervals."""
    out = exhaustive_search(df, outcome, items, min_items, max_items, positive_label, negative_label, cutoff_method, rank_by, top_n, prefer_fewer_items, ci, conf_level, engine)
    return out.withColumn("performance_type", F.lit("apparent"))


@dataclass
class BruteForceResult:
    """A full-data search; ``results`` is lazy or a stored table, ``candidates`` its first rows."""

    best_model: DataFrame
    candidates: DataFrame
    results: DataFrame | None
    settings: dict[str, Any] = field(default_factory=dict)
    n_original: int = 0
    n_analyzed: int = 0
    total_combinations: int = 0
    results_path: str | None = None
    loaded_from_cache: bool = False

    def report(self) -> str:
        from ..functions.report import brute_force_report

        return brute_force_report(self)

    __str__ = report


def brute_force(df: DataFrame, outcome: str, items: object, min_items: int | None = None, max_items: int | None = None, item_count: str | None = None, cutoff_method: str = "youden", rank_by: str = "auc", top_n: int | None = 20, prefer_fewer_items: bool = True, positive_label: object = 1, negative_label: object = 0, engine: str = "auto", parallel: object = "none", results_storage: str = "auto", results_dir: str | None = None, output_dir: str | None = None, cache: str = "off", cache_dir: str | None = None, n_workers: int | None = None, chunk_size: int | None = None) -> BruteForceResult:
    """Search a lenient table: text is parsed and incomplete rows are dropped.

    ``top_n`` of None keeps all candidates in ``candidates``, 0 none.  ``n_workers`` is
    the number of the kernel's tasks, more where one would have over ``chunk_size`` candidates.
    """
    from ..sources import store

    choice(cutoff_method, CUTOFF_METHODS, "cutoff_method"), choice(rank_by, RANK_COLUMNS, "rank_by"), resolve_parallel(parallel, "exhaustive")
    store.check_cache(cache, cache_dir), store.check_storage(results_storage)
    for name, n in (("n_workers", n_workers), ("chunk_size", chunk_size)):
        if n is not None:
            whole(n, name)
    names = resolve_items(df, items)
    low, high = item_bounds(item_count, min_items, max_items, len(names))
    low, high = _bounds(names, low, high)
    if top_n is not None:
        whole(top_n, "top_n", 0)
    total = count_combinations(names, low, high)
    settings = {"outcome": outcome, "items": names, "min_items": low, "max_items": min(high, len(names)), "item_count": describe_item_count(low, min(high, len(names))), "cutoff_method": cutoff_method, "rank_by": rank_by, "prefer_fewer_items": prefer_fewer_items, "positive_label": positive_label, "negative_label": negative_label}
    with scratch(df.sparkSession, results=False):
        data = prepared(df, outcome, names, positive_label, negative_label, lenient=True)

        def build(best: int | None) -> DataFrame:
            return score_all(data.patterns, names, low, high, cutoff_method, engine, rank_by, prefer_fewer_items, best, workers=n_workers, chunk=chunk_size)

        full, path, hit = store.keep(data.patterns, build, settings, total, results_storage, results_dir, cache, cache_dir, max(1, top_n) if top_n is not None else None)
    head = ranked(full, candidate_order(rank_by, prefer_fewer_items), max(1, top_n or 0) if top_n is not None else None).select(*COLUMNS, "combo_id")
    shown = head.limit(0) if top_n == 0 else head
    out = BruteForceResult(head.where("rank = 1"), shown, None if results_storage == "none" else full, settings, data.n_original, data.n_analyzed, total, path, hit)
    if output_dir:
        store.write_csv(df.sparkSession, output_dir, {"roc_bruteforce_results": out.results, "roc_bruteforce_candidates": shown, "roc_bruteforce_best_model": out.best_model})
    return out
