"""Statistics that hold at any count."""

import math

import numpy as np
import pytest

from sumlattice.functions import exact
from sumlattice.operators import intervals, kernel, roc


def test_exact_sums_on_arrays():
    rng = np.random.default_rng(1)
    for most in (10, 2**31, 2**40, 2**58, 2**62):
        a, b = rng.integers(0, most, (7, 50)), rng.integers(0, 2**62, (7, 50))
        want = [sum(int(x) * int(y) for x, y in zip(r, s)) for r, s in zip(a, b)]
        assert [int(v) for v in exact.dot(a, b)] == want and exact.doubles(exact.dot(a, b)).tolist() == [float(w) for w in want]
        at = rng.integers(0, 5, 50)
        assert exact.bincount(at, a[0] >> 4, 6).tolist() == [int(sum(int(v) >> 4 for v in a[0][at == k])) for k in range(6)]
    assert exact.dot(np.zeros((0, 3), np.int64), np.zeros((0, 3), np.int64)).shape == (0,)


def plain(freq):
    """(auc, se) in whole numbers up to the last quotients."""
    p, n = sum(r[1] for r in freq), sum(r[2] for r in freq)
    rows = sorted(freq)
    a = [2 * sum(r[2] for r in rows[:i]) + rows[i][2] for i in range(len(rows))]
    b = [2 * sum(r[1] for r in rows[i:]) - rows[i][1] for i in range(len(rows))]
    w = sum(r[1] * v for r, v in zip(rows, a))
    s10 = float(p * sum(r[1] * v * v for r, v in zip(rows, a)) - w * w) / (4.0 * float(p) * float(n) * float(n) * (float(p) - 1))
    s01 = float(n * sum(r[2] * v * v for r, v in zip(rows, b)) - w * w) / (4.0 * float(n) * float(p) * float(p) * (float(n) - 1))
    return float(w) / (2.0 * float(p) * float(n)), math.sqrt(s10 / float(p) + s01 / float(n))


@pytest.mark.parametrize("most", [50, 10**5, 3 * 10**9, 10**13, 10**17])
def test_both_engines_at_large_counts(spark, most):
    rng = np.random.default_rng(most % 97)
    x = [[float(i), float(j)] for i in range(3) for j in range(4)]
    counts = [(v, int(p), int(n)) for v, (p, n) in zip(x, rng.integers(0, most, (12, 2)))] + [([0.5, 0.5], 1, 0)]
    patterns = spark.createDataFrame(counts, "x array<double>, p long, n long")
    sets = spark.createDataFrame([(0, 1, [0]), (1, 1, [1]), (2, 2, [0, 1])], "combo_id long, n_items int, item_idx array<int>")
    freq = roc.score_frequencies(patterns, sets)
    columns = ["combo_id", "auc", "cutoff", "sensitivity", "specificity", "youden", "accuracy", "ppv", "npv", "tp", "fp", "fn", "tn", "n_positive", "n_negative"]
    for method in ("youden", "closest_topleft"):
        a = sorted(map(tuple, roc.candidate_table(freq, method=method).select(*columns).collect()))
        b = sorted(map(tuple, kernel.score(spark, patterns, ["u", "v"], 1, 2, method).select(*columns).collect()))
        assert a == b and [r[0] for r in a] == [0, 1, 2]
    scores = {0: lambda v: v[0], 1: lambda v: v[1], 2: sum}
    for r in intervals.delong(freq).collect():
        found = {}
        for v, p, n in counts:
            at = found.setdefault(scores[r["combo_id"]](v), [0, 0])
            at[0], at[1] = at[0] + p, at[1] + n
        auc, se = plain([(s, *c) for s, c in found.items()])
        assert (r["auc"], r["auc_se"]) == (auc, se) and [x[1] for x in a if x[0] == r["combo_id"]] == [auc]


def test_three_thousand_million_a_class(spark):
    n = 3 * 10**9
    got = kernel.statistics(np.array([[0.0, 1.0]]), np.array([[0, n]]), np.array([[n, 0]]), "youden")
    assert got["auc"].tolist() == [1.0] and got["cutoff"].tolist() == [1.0]
    freq = spark.createDataFrame([(0, 1, 1.0, n, 0), (0, 1, 0.0, 0, n)], "combo_id long, n_items int, score double, p long, n long")
    assert roc.candidate_table(freq).first()["auc"] == 1.0 == roc.auc_of(freq, ["combo_id"]).first()["auc"]
    assert tuple(intervals.delong(freq).first())[1:] == (1.0, 0.0, 1.0, 1.0)


@pytest.mark.parametrize("most", [9, 2**40, 2**62])
def test_weights_whose_sums_are_beyond_longs(spark, most):
    rng = np.random.default_rng(5)
    x = [[float(i), j / 2] for i in range(3) for j in range(4)] * 4
    rows = [(int(y), v, int(t)) for v, y, t in zip(x, rng.integers(0, 2, 48), rng.integers(most // 2, most, 48))]
    patterns = roc.compress(spark.createDataFrame(rows, "y int, x array<double>, times long"), times="times")
    count = "decimal(38,0)" if most == 2**62 else "bigint"
    assert dict(patterns.dtypes)["p"] == dict(patterns.dtypes)["n"] == count
    sets = spark.createDataFrame([(0, 1, [0]), (1, 1, [1]), (2, 2, [0, 1])], "combo_id long, n_items int, item_idx array<int>")
    freq = roc.score_frequencies(patterns, sets)
    columns = ["combo_id", "auc", "cutoff", "sensitivity", "specificity", "youden", "accuracy", "ppv", "npv", "tp", "fp", "fn", "tn", "n_positive", "n_negative"]
    a = sorted(map(tuple, roc.candidate_table(freq).select(*columns).collect()))
    assert a == sorted(map(tuple, kernel.score(spark, patterns, ["u", "v"], 1, 2).select(*columns).collect()))
    assert {tuple(map(int, r[-2:])) for r in a} == {(sum(t for y, _, t in rows if y == 1), sum(t for y, _, t in rows if y == 0))}
    whole = kernel.score(spark, patterns.withColumn("x", roc.F.transform("x", lambda v: 2 * v)), ["u", "v"], 1, 2).drop("cutoff")
    assert sorted(map(tuple, whole.select("combo_id", "auc").collect())) == [r[:2] for r in a if r[0] < 2] + [tuple(whole.where("combo_id = 2").select("combo_id", "auc").first())]
    scores = {0: lambda v: v[0], 1: lambda v: v[1], 2: sum}
    for r in intervals.delong(freq).collect():
        found = {}
        for y, v, t in rows:
            found.setdefault(scores[r["combo_id"]](v), [0, 0])[1 - y] += t
        assert (r["auc"], r["auc_se"]) == plain([(s, *c) for s, c in found.items()]) and r["auc"] == a[r["combo_id"]][1]


@pytest.mark.parametrize("kind", ["few", "uneven", "negative", "wide", "real", "large"])
def test_prefixes_share_their_sums(kind):
    """Histograms of a prefix's subsets at once equal those of each subset's own scores."""
    rng = np.random.default_rng(6)
    columns = {"few": rng.integers(0, 3, (7, 40)), "uneven": rng.integers(0, 4, (7, 40)) * np.array([[1], [0], [1], [1], [0], [1], [1]]) + 5, "negative": rng.integers(-2, 1, (7, 40)), "wide": rng.integers(0, 90, (7, 40)), "real": rng.standard_normal((7, 40)), "large": rng.integers(0, 2, (7, 40))}[kind].astype(float)
    p, n = rng.integers(0, 2**58 // 40 if kind == "large" else 9, (2, 40))
    fans = kernel.Fans(columns, (p, n), 4)
    assert fans.small == (kind in ("few", "uneven", "negative"))
    from sumlattice.functions.combos import level_sizes, unrank_global

    for ranks in (np.arange(98), np.arange(13, 71), np.array([3]), np.arange(60, 63)):
        for _, part in unrank_global(7, level_sizes(7, 1, 4), ranks):
            scores = np.zeros((len(part), 40))
            for j in range(part.shape[1]):
                scores += columns[part[:, j]]
            assert (fans.scores(part) == scores).all()
            if fans.small:
                values, (pos, neg) = fans.histograms(part)
                a, b = kernel.statistics(values, pos, neg, "youden"), kernel.statistics(*kernel.histograms(scores, p, n), "youden")
                assert all(np.array_equal(a[c], b[c], equal_nan=True) for c in a)
