import itertools
import math

import numpy as np
import pytest

from sumlattice.functions import combos, intervals, parsing


@pytest.mark.parametrize("n,k", [(8, 1), (8, 3), (9, 4), (5, 5)])
def test_unrank_equals_enumeration(n, k):
    assert [tuple(r) for r in combos.unrank(n, k, np.arange(math.comb(n, k)))] == [*itertools.combinations(range(n), k)]


def test_counts():
    assert combos.count_combinations(103, 1, 4, detail=True)["n_combinations"].tolist() == [103, 5253, 176851, 4421275]
    assert combos.count_combinations(103) == 4603482
    assert combos.count_combinations(3, 1, 9) == 7
    with pytest.raises(ValueError):
        combos.count_combinations(3, 5, 9)
    assert [combos.locate(r, combos.level_sizes(5, 1, 2)) for r in (0, 4, 5, 14)] == [(1, 0), (1, 4), (2, 0), (2, 9)]
    assert combos.suggest_preselect(103, mode="quick") == 100 and combos.suggest_preselect(3, mode="exhaustive") == 7
    for bad in ((5, 2, [10]), (5, 6, [0])):
        with pytest.raises(ValueError):
            combos.unrank(bad[0], bad[1], np.array(bad[2]))


def test_conditions_and_item_counts():
    assert parsing.parse_condition(" >= 9e-1 ") == (">=", 0.9)
    for bad in ("=> 0.90", "greater than 0.90", ">= abc", "0.90", None):
        with pytest.raises(ValueError):
            parsing.parse_condition(bad)
    assert parsing.parse_item_count("== 4") == (4, 4) and parsing.parse_item_count("<=4") == (1, 4) and parsing.parse_item_count("2 : 4") == (2, 4) and parsing.parse_item_count(" = = 1 0\t") == (10, 10)
    for bad in ("==0", "4:2", "x", "<=9", 4, "", "==", "3", "==3:4", ">=2", "==-1", "==2.0", "1:2:3"):
        with pytest.raises(ValueError):
            parsing.parse_item_count(bad, 5)
    with pytest.raises(ValueError):
        parsing.item_bounds("==2", 1, None, 5)
    assert [parsing.describe_item_count(*x) for x in ((4, 4), (1, 4), (2, 4))] == ["exactly 4", "up to 4", "2 to 4"]
    assert parsing.parse_items("q1, q2") == ["q1", "q2"]
    for bad in ("auto", "invalid", 123):
        with pytest.raises(ValueError):
            parsing.resolve_parallel(bad, "nested")
    assert parsing.resolve_parallel(True, "nested") == "outer" and parsing.resolve_parallel(True, "x") == "chunks"


def test_clopper_pearson():
    ends = lambda k, n, level=0.95: tuple(v.item() for v in intervals.clopper_pearson(np.array([k]), np.array([n]), level))
    assert ends(10, 10) == (pytest.approx(0.025 ** (1 / 10), abs=1e-14), 1.0)
    assert ends(0, 10) == (0.0, pytest.approx(1 - 0.025 ** (1 / 10), abs=1e-14))
    assert all(math.isnan(v) for k, n in ((3, 0), (float("nan"), 4), (5, 4), (-1, 4)) for v in ends(k, n))
    low, high = ends(500_000, 1_000_000)
    assert 0.4989 < low < 0.5 < high < 0.5011
    # Both ends leave a tail of binomial terms, each in whole logarithms, whatever the sizes.
    rng = np.random.default_rng(2)
    n = np.concatenate([rng.integers(1, 40, 60), rng.integers(500, 3000, 40)])
    k = (rng.random(100) * (n + 1)).astype(int)
    for level in (0.95, 0.5):
        low, high = intervals.clopper_pearson(k, n, level)
        term = lambda n, i, x: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(x) + (n - i) * math.log1p(-x))
        for a, b, x, y in zip(k.tolist(), n.tolist(), low, high):
            if a > 0:
                assert sum(term(b, i, x) for i in range(a, b + 1)) == pytest.approx((1 - level) / 2, rel=1e-10)
            if a < b:
                assert sum(term(b, i, y) for i in range(a + 1)) == pytest.approx((1 - level) / 2, rel=1e-10)
    low, high = intervals.clopper_pearson(np.array([3 * 10**9, 1]), 10**10)
    sd = math.sqrt(0.3 * 0.7 / 1e10)
    assert low[0] == pytest.approx(0.3 - 1.95996 * sd, abs=sd / 1000) and high[0] == pytest.approx(0.3 + 1.95996 * sd, abs=sd / 1000)
    assert low[1] == pytest.approx(-math.log(0.975) / 1e10, rel=1e-9)
    assert intervals.clopper_pearson(np.zeros(0), np.zeros(0))[0].shape == (0,)


def test_incomplete_beta():
    x = np.linspace(0, 1, 41)
    assert np.allclose(intervals.incomplete_beta(1, 5, x), 1 - (1 - x) ** 5, atol=1e-15) and np.allclose(intervals.incomplete_beta(3, 1, x), x**3, atol=1e-15)
    for a, b in ((2, 3), (450, 500), (399, 401), (1000, 3)):
        at = np.clip(a / (a + b) + np.linspace(-4, 4, 30) * math.sqrt(a * b / (a + b)) / (a + b), 0, 1)
        made = intervals.incomplete_beta(a, b, at)
        assert (np.diff(made) >= 0).all() and np.allclose(made + intervals.incomplete_beta(b, a, 1 - at), 1, atol=1e-13)
