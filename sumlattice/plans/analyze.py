"""One call from a raw table to a validated scale, and its reusable configuration."""

from __future__ import annotations

import warnings
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.combos import PRESETS, candidate_rows, count_combinations, suggest_preselect, whole
from ..functions.parsing import CRITERIA, CUTOFF_METHODS, RANK_COLUMNS, choice, item_bounds, resolve_items, resolve_parallel
from ..operators.nested import INNER_FOLDS, NestedResult, nested_cv
from ..operators.ranking import candidate_order, ranked
from ..sources import store
from ..sources.prepare import prepared
from ..sources.staging import scratch, staged
from .search import COLUMNS, RELATIONAL_CANDIDATES, attach_intervals, score_all


@dataclass(frozen=True)
class Config:
    """Settings of an analysis: defaults, then the preset of ``mode``, then what is given."""

    outcome: str
    items: tuple[str, ...] | None = None
    min_items: int | None = None
    max_items: int | None = None
    item_count: str | None = None
    mode: str = "balanced"
    outer_k: int = 5
    inner_k: int = 4
    outer_repeats: int = 5
    inner_repeats: int = 1
    inner_folds: str = "own"
    preselect_top_n: int | None = None
    preselect_by: str = "auc"
    selection_criterion: str = "auc"
    cutoff_method: str = "youden"
    positive_label: Any = 1
    negative_label: Any = 0
    stratified: bool = True
    engine: str = "auto"
    parallel: Any = False
    n_workers: int | None = None
    threads_per_worker: int = 1
    chunk_size: int = 200_000
    cache: str = "off"
    cache_dir: str | None = None
    seed: int = 1

    def __post_init__(self) -> None:
        choice(self.mode, tuple(PRESETS), "mode"), choice(self.cutoff_method, CUTOFF_METHODS, "cutoff_method")
        choice(self.preselect_by, CRITERIA, "preselect_by"), choice(self.selection_criterion, CRITERIA, "selection_criterion")
        choice(self.inner_folds, INNER_FOLDS, "inner_folds")
        mode = resolve_parallel(self.parallel, "nested")
        for name, least in (("outer_k", 2), ("inner_k", 2), ("outer_repeats", 1), ("inner_repeats", 1), ("chunk_size", 1), ("threads_per_worker", 1)):
            whole(getattr(self, name), name, least)
        if self.n_workers is not None:
            whole(self.n_workers, "n_workers")
        if self.threads_per_worker != 1 and mode != "hybrid":
            raise ValueError("threads_per_worker is for parallel='hybrid'")
        if self.inner_repeats > 1:
            warnings.warn("inner_repeats above 1 isn't supported; 1 is used", stacklevel=2)
        if not self.stratified:
            raise ValueError("folds are always stratified")
        store.check_cache(self.cache, self.cache_dir)
        item_bounds(self.item_count, self.min_items, self.max_items, len(self.items) if self.items else None)

    def sizes(self) -> tuple[int, int]:
        return item_bounds(self.item_count, self.min_items, self.max_items, len(self.items) if self.items else None)

    @property
    def total_combinations(self) -> int | None:
        return count_combinations([*self.items], *self.sizes()) if self.items else None

    @property
    def workers(self) -> int | None:
        return self.n_workers * self.threads_per_worker if self.n_workers else None

    def preselect(self, items: list[str]) -> int:
        low, high = self.sizes()
        if self.preselect_top_n is None:
            return suggest_preselect(items, low, high, self.mode)
        return min(whole(self.preselect_top_n, "preselect_top_n"), count_combinations(items, low, high))

    def report(self) -> str:
        lines = [f"{k}: {v}" for k, v in asdict(self).items() if v is not None]
        if self.items:
            lines.append(f"combinations: {self.total_combinations:,}")
            if self.preselect([*self.items]) >= 100_000:
                lines.append("warning: very many candidates are kept for the inner folds")
        return "\n".join(lines)

    __str__ = report


@dataclass
class Analysis:
    """Everything that an analysis found."""

    config: Config
    nested: NestedResult
    final_model: DataFrame
    final_candidates: DataFrame
    results: DataFrame | None
    n_original: int
    n_analyzed: int
    total_combinations: int
    settings: dict = field(default_factory=dict)
    results_path: str | None = None
    loaded_from_cache: bool = False

    def report(self) -> str:
        from ..functions.report import analysis_report

        return analysis_report(self)

    def plot_data(self, kind: str = "auc") -> DataFrame:
        return self.nested.plot_data(kind)

    __str__ = report


def run_config(df: DataFrame, config: Config, row_id: str) -> NestedResult:
    """Nested cross-validation of a strict table with a unique ``row_id``, as configured."""
    items = resolve_items(df, config.items)
    with scratch(df.sparkSession, results=False):
        data = prepared(df, config.outcome, items, config.positive_label, config.negative_label, row_id)
        return _validated(data.rows, data.patterns, items, config, row_id)


def _validated(rows: DataFrame, patterns: DataFrame, items: list[str], config: Config, row_id: str) -> NestedResult:
    low, high = config.sizes()
    if rows.groupBy("row_id").count().where("count > 1 OR row_id IS NULL").limit(1).count():
        raise ValueError(f"{row_id} must name each row once")
    total = count_combinations(items, low, high)
    pool, space = (candidate_rows(rows.sparkSession, items, low, high), None) if total <= RELATIONAL_CANDIDATES else (None, (items, low, high))
    return nested_cv(rows, pool, config.outer_k, config.inner_k, config.outer_repeats, config.preselect(items), config.preselect_by, config.selection_criterion, config.cutoff_method, config.seed, space, config.inner_folds, config.workers, config.chunk_size, patterns)


def analyze(df: DataFrame, outcome: str, items: object, row_id: str, final_top_n: int | None = 20, final_rank_by: str = "auc", ci: bool = True, conf_level: float = 0.95, results_storage: str = "auto", results_dir: str | None = None, output_dir: str | None = None, **settings: Any) -> Analysis:
    """Prepare, cross-validate, search all data, attach intervals, store.

    The table is read once.  ``row_id`` names a unique column: Spark's rows have no positions.
    """
    choice(final_rank_by, RANK_COLUMNS, "rank_by"), store.check_storage(results_storage)
    names = resolve_items(df, items)
    config = Config(outcome=outcome, items=tuple(names), **settings)
    low, high = config.sizes()
    if final_top_n is not None:
        whole(final_top_n, "final_top_n")
    facts = {"outcome": outcome, "items": names, "min_items": low, "max_items": min(high, len(names)), "cutoff_method": config.cutoff_method, "rank_by": final_rank_by, "positive_label": config.positive_label, "negative_label": config.negative_label}
    total, order = count_combinations(names, low, high), candidate_order(final_rank_by)
    with scratch(df.sparkSession, results=False):
        data = prepared(df, outcome, names, config.positive_label, config.negative_label, row_id, lenient=True)
        nested = _validated(data.rows, data.patterns, names, config, row_id)
        full, path, hit = store.keep(data.patterns, lambda best: score_all(data.patterns, names, low, high, config.cutoff_method, config.engine, final_rank_by, top_n=best, workers=config.workers, chunk=config.chunk_size), facts, total, results_storage, results_dir, config.cache, config.cache_dir, final_top_n)
        head = ranked(full, order, final_top_n)
        head = staged(attach_intervals(head, data.patterns, names, conf_level, low, high) if ci else head.select(*COLUMNS, "combo_id"), "final-candidates", result=True)
    out = Analysis(config, nested, head.where("rank = 1"), head, None if results_storage == "none" else full, data.n_original, data.n_analyzed, total, facts, path, hit)
    if output_dir:
        store.write_csv(df.sparkSession, output_dir, {
            "nested_cv_outer_fold_results": nested.outer_results, "nested_cv_selected_models": nested.selected_models, "nested_cv_outer_predictions": nested.outer_predictions,
            "nested_cv_summary": nested.summary, "nested_cv_selected_model_frequency": nested.selected_model_frequency,
            "final_exhaustive_results_ranked": ranked(full, order) if out.results is not None else None, "final_candidates": head.orderBy("rank"), "final_model": out.final_model,
        })
    return out


def summary_statistics(nested: NestedResult) -> DataFrame:
    """Mean and sample standard deviation of the outer folds' statistics."""
    m = ("auc", "sensitivity", "specificity", "youden", "accuracy", "ppv", "npv")
    long = nested.summary.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in m))).alias("v")).select("v.*")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
