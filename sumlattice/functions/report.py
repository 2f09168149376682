"""Text reports, and the tables that plots are drawn from."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _table(df: DataFrame, n: int = 20) -> str:
    return df.limit(n).toPandas().to_string(index=False, float_format=lambda v: f"{v:.4f}")


def nested_report(nested: Any) -> str:
    """Fold table and the three sets chosen most often."""
    return f"Outer folds\n{_table(nested.summary.orderBy('outer_fold'), 200)}\n\nChosen most often\n{_table(nested.selected_model_frequency, 3)}"


def nested_summary(nested: Any) -> str:
    """Counts, settings, mean and spread, and the three sets chosen most often."""
    from ..plans.analyze import summary_statistics

    rows = nested.outer_predictions.select("row_index").distinct().count()
    said = "\n".join(f"{k}: {v}" for k, v in nested.settings.items())
    return f"Observations: {rows}\n{said}\n\n{_table(summary_statistics(nested).orderBy('metric'))}\n\nChosen most often\n{_table(nested.selected_model_frequency, 3)}"


def analysis_report(a: Any) -> str:
    return (
        f"Rows: {a.n_original} given, {a.n_analyzed} analyzed\nCombinations: {a.total_combinations:,}\n\n{nested_report(a.nested)}\n\n"
        f"Final model (apparent performance)\n{_table(a.final_model)}\n\nCandidates\n{_table(a.final_candidates)}"
    )


def brute_force_report(b: Any) -> str:
    return (
        f"Rows: {b.n_original} given, {b.n_analyzed} analyzed\nItems per scale: {b.settings['item_count']}\nCombinations: {b.total_combinations:,}\n\n"
        f"Best\n{_table(b.best_model)}\n\nCandidates\n{_table(b.candidates)}\n\nPerformance on the data that chose the scale is optimistic; validate it on other rows."
    )


def selection_plot_data(nested: Any) -> DataFrame:
    """Bars of a selection chart: the ten sets chosen most often."""
    return nested.selected_model_frequency.orderBy(F.desc("n_selections"), "items").limit(10)


def auc_plot_data(nested: Any) -> DataFrame:
    """Points of a strip chart of outer AUCs, with their mean and the line of chance."""
    mean = nested.summary.agg(F.avg("auc").alias("mean_auc"))
    return nested.summary.select("outer_fold", "auc").crossJoin(F.broadcast(mean)).withColumn("chance", F.lit(0.5))
