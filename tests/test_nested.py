"""Inner folds by counted ranks, and searches of folds in blocks."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumlattice.functions import combos
from sumlattice.operators import folds as by_rank
from sumlattice.operators import inner, nested, roc
from sumlattice.operators.folds import stratified_folds
from sumlattice.plans import search
from sumlattice.sources import prepare


def by_hand(rows, wanted, k):
    """Pattern counts of every division, from the rows themselves."""
    out = {}
    for repeat, outer, seed in wanted:
        own = [r for r in rows if r["repeat"] == repeat and r["fold"] != outer]
        least = min(sum(r["y"] == y for r in own) for y in (0, 1))
        n_folds = min(k, least)
        for y in (0, 1):
            order = sorted((r for r in own if r["y"] == y), key=lambda r: (hashlib.md5(f"{seed}|{r['row_id']}".encode()).hexdigest(), r["row_id"]))
            for fold, part in enumerate(np.array_split(np.arange(len(order)), n_folds) if n_folds > 1 else [], 1):
                for i in part:
                    cell = out.setdefault((repeat, outer, seed, fold, tuple(order[i]["x"])), [0, 0])
                    cell[1 - y] += 1
    return {(*key, *counts) for key, counts in out.items()}


@pytest.mark.parametrize("n,share,digits", [(40, 0.5, 1), (400, 0.2, 2)])
def test_divisions(spark, monkeypatch, n, share, digits):
    monkeypatch.setattr(inner, "COMPARED", 128 if digits == 1 else 2)
    rng = np.random.default_rng(n)
    y = np.zeros(n, int)
    y[rng.choice(n, max(4, int(n * share)), replace=False)] = 1
    rows = spark.createDataFrame([(i * 7, int(y[i]), [float(v) for v in rng.integers(0, 3, 2)]) for i in range(n)], "row_id long, y int, x array<double>")
    folds = stratified_folds(rows, 3, 2, 5).persist()
    wanted = [(r, f, 5 + (r - 1) * 3 + f + j) for r in (1, 2) for f in (1, 2, 3) for j in range(4)]
    for k in (2, 5):
        got = inner.divided(folds, spark.createDataFrame(wanted, "repeat int, outer_fold int, seed int"), k, digits)
        assert {(r["repeat"], r["outer_fold"], r["seed"], r["inner"], tuple(r["x"]), r["p"], r["n"]) for r in got.collect()} == by_hand(folds.collect(), wanted, k)


def test_division_of_a_tiny_class(spark):
    """One row of a class is left in some training sets, which therefore have no division."""
    rows = spark.createDataFrame([(i, int(i < 2), [float(i % 3)]) for i in range(12)], "row_id long, y int, x array<double>")
    folds = stratified_folds(rows, 2, 1, 1)
    wanted = [(1, 1, 3), (1, 2, 3)]
    assert inner.divided(folds, spark.createDataFrame(wanted, "repeat int, outer_fold int, seed int"), 3).count() == 0 == len(by_hand(folds.collect(), wanted, 3))
    with pytest.raises(ValueError, match="no candidate"):
        nested.nested_cv(rows, combos.candidate_rows(spark, ["a"], 1, 1), 2, 2, 1, 1)


@pytest.mark.parametrize("deviations", [8, 0.01])
def test_folds_from_windows(spark, monkeypatch, deviations):
    """Beginnings are found in windows in one pass; where windows are too narrow, by ranks."""
    monkeypatch.setattr(by_rank, "DEVIATIONS", deviations)
    monkeypatch.setattr(by_rank, "BESIDES", 40 if deviations == 8 else 0)
    rows = spark.createDataFrame([(i * 7, int(i % 5 == 0), [float(i % 3), float(i % 4)]) for i in range(4000)], "row_id long, y int, x array<double>").persist()
    every, seed, sizes = rows.withColumn("repeat", F.explode(F.lit([1, 2]))), F.lit(5) + F.col("repeat") - 1, {0: 3200, 1: 800}
    show = lambda df: sorted(map(tuple, df.select("row_id", "repeat", "y", "fold").collect()))
    made = by_rank.cut(every, seed, 3, sizes, "y", "row_id")
    assert (made is None) == (deviations < 1) and (made is None or "Window" not in (plan := made._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning" not in plan)
    want = show(by_rank.assign(every, seed, F.lit(3), ["repeat"]))
    assert (made is None or show(made) == want) and show(stratified_folds(rows, 3, 2, 5)) == want
    assert by_rank.cut(every.withColumn("row_id", F.lit(1)), seed, 3, sizes, "y", "row_id") is None

    folds = stratified_folds(rows, 3, 2, 5).persist()
    wanted = [(r, f, 5 + (r - 1) * 3 + f + j) for r in (1, 2) for f in (1, 2, 3) for j in range(2)]
    asked = spark.createDataFrame(wanted, "repeat int, outer_fold int, seed int")
    for k in (2, 4):
        assert (inner.by_windows(folds, asked, k) is None) == (deviations < 1)
        got = inner.divided(folds, asked, k).collect()
        assert {(r["repeat"], r["outer_fold"], r["seed"], r["inner"], tuple(r["x"]), r["p"], r["n"]) for r in got} == by_hand(folds.collect(), wanted, k)


def test_prefix_digits():
    assert [inner.prefix_digits(n) for n in (0, 10, 10**6, 10**7, 10**9, 10**13)] == [2, 2, 2, 3, 5, 6]


@pytest.mark.parametrize("inner_folds", nested.INNER_FOLDS)
def test_blocks_beyond_the_kernel(spark, monkeypatch, inner_folds):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (120, 5))
    y = (x[:, 0] + x[:, 1] + rng.integers(0, 3, 120) > 3).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), *map(int, x[i])) for i in range(120)], "row_id long, y int, a int, b int, c int, d int, e int")
    items = ["a", "b", "c", "d", "e"]
    rows = prepare.strict(df, "y", items, row_id="row_id")
    run = lambda: [sorted(map(str, t.collect())) for t in (lambda r: (r.outer_results, r.outer_predictions))(nested.nested_cv(rows, None, 3, 2, 2, 4, seed=5, space=(items, 1, 3), inner_folds=inner_folds))]
    want = run()
    monkeypatch.setattr(nested.kernel, "PATTERN_BYTES", 8)
    monkeypatch.setattr(nested, "CANDIDATE_BLOCK", 6)
    assert run() == want and len(want[0]) == 6


def test_no_cartesian_product_at_millions_of_candidates(spark):
    items = [f"q{i}" for i in range(103)]
    counts = spark.range(0, 1 << 22).select((F.col("id") % 2).cast("int").alias("repeat"), (F.col("id") % 5).cast("int").alias("fold"), F.array_repeat(F.rand(1), 103).alias("x"), F.lit(1).cast("long").alias("p"), F.lit(1).cast("long").alias("n"))
    block = combos.candidates(spark, items, 1, 4, 4_000_000, nested.CANDIDATE_BLOCK)
    made = roc.score_frequencies(counts, F.broadcast(block), ["repeat", "fold"])
    found = roc.candidate_table(nested.train_frequencies(made, ["repeat", "combo_id", "n_items"], ["repeat"], "fold", spark.range(0, 10).selectExpr("int(id % 2) AS repeat", "int(id % 5) AS fold")), ["repeat", "fold", "combo_id", "n_items"])
    for df in (made, found):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") == 1 and "SortMergeJoin" not in plan
    assert search.CANDIDATE_BLOCK == nested.CANDIDATE_BLOCK


def test_rows_carry_numbers_of_patterns(spark, monkeypatch):
    """What is written of each row and repeat has no array, and results are the same where patterns are too many to number."""
    df = spark.createDataFrame([(i, int(i * 7 % 11 > 4), i % 3, i % 4) for i in range(90)], "row_id long, y int, a int, b int")
    rows, pool, kinds = prepare.strict(df, "y", ["a", "b"], row_id="row_id"), combos.candidate_rows(spark, ["a", "b"], 1, 2), []
    write = nested.staged
    monkeypatch.setattr(nested, "staged", lambda t, label="table", **kw: (kinds.append(t.schema["x"].dataType.simpleString()) if label == "folds" else None) or write(t, label, **kw))
    run = lambda: [sorted(map(str, t.collect())) for t in (lambda r: (r.outer_results, r.outer_predictions))(nested.nested_cv(rows, pool, 3, 2, 2, 2, seed=5))]
    want = run()
    monkeypatch.setattr(roc, "NUMBERED_VALUES", 3)
    assert run() == want and len(want[1]) == 180 and kinds == ["bigint", "array<double>"]


def test_beginnings_of_folds_are_columns(spark):
    rows = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "row_id long, y int").withColumn("repeat", F.lit(1))
    made = by_rank.cut(rows, F.lit(3), 3, {0: 200, 1: 100}, "y", "row_id")
    assert "array" not in (plan := made._jdf.queryExecution().executedPlan().toString()) and "_cuts" not in plan and made.count() == 300
