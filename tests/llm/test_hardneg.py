import numpy as np
import pytest

from sumlattice.llm import hardneg


def brute(rows, every=100, positives=5, negatives=10, shares=(30, 90)):
    ok = []
    for i, v, label in rows:
        if i is None or label is None or not v or None in v or not np.isfinite(np.array(v, float)).all():
            continue
        x = [int(np.floor(256 * float(c))) if abs(c) < 1e12 else 10**15 for c in v]
        if sum(c * c for c in x) < 2**62:
            ok.append((i, (label + 1) % 10 if i % 7 == 0 else label, x))
    out = []
    for d in {len(x) for *_, x in ok}:
        own = [r for r in ok if len(r[2]) == d]
        for a in sorted({r[0] for r in own if r[0] % every == 0}):
            _, label, q = min(r for r in own if r[0] == a)
            score = sorted((-sum(c * e for c, e in zip(q, x)), i, k == label) for i, k, x in own if i != a)
            for s, p, _ in [r for r in score if r[2]][:positives]:
                fit = [r for r in score if not r[2] and shares[0] * -s <= 100 * -r[0] <= shares[1] * -s][:negatives]
                out += [(a, p, rank, i, -s, -n) for rank, (n, i, _) in enumerate(fit, 1)]
    return out


def check(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "vec_id long, embedding array<double>, label int, rank int, x string").repartition(3)
    got = [tuple(r) for r in hardneg.mine(spark, df, **kw).collect()]
    assert sorted(got) == sorted(brute(rows, **{k: v for k, v in kw.items()}))
    return got


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, monkeypatch, small):
    if small:
        for name, value in (("ANCHOR_VALUES", 3000), ("TARGETS", 7), ("ROWS", 50), ("SAMPLE_ROWS", 60), ("PIVOTS", 4)):
            monkeypatch.setattr(hardneg, name, value)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 10))
    x = centres[rng.integers(0, 12, 1500)] + 0.3 * rng.standard_normal((1500, 10))
    x[:300] *= rng.uniform(0.1, 5, (300, 1))
    rows = [(i, [*map(float, v)], int(rng.integers(0, 10))) for i, v in enumerate(x)]
    rows += [(2000 + i, rows[5][1], int(i % 4)) for i in range(400)]  # a large group of copies, with ties
    assert len(check(spark, rows, every=5 if small else 100)) > 500


def test_annuli_grow_until_certified(spark, monkeypatch):
    """A first annulus that is far too small, and keys that leave out most of the index."""
    monkeypatch.setattr(hardneg, "FIRST", 0.05)
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.uniform(1, 4) * np.eye(6)[i % 6] + 0.05 * rng.standard_normal(6)], int(rng.integers(0, 3))) for i in range(900)]
    passes = []
    once = hardneg._pass
    monkeypatch.setattr(hardneg, "_pass", lambda *a: passes.append(1) or once(*a))
    assert check(spark, rows, every=50) and len(passes) > 2


def test_odd_rows(spark):
    v = [1.0, 2.0]
    rows = [(0, v, 1), (0, [0.5, 2.0], 0), (100, v, 1), (1, v, 2), (1, v, 2), (2, [2.0, 1.0], 1), (2, [2.0, 1.0], 1), (None, v, 1), (3, v, None), (4, None, 1), (5, [], 1), (6, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (9, [float("inf"), 1.0], 1), (10, [1e300, 1.0], 2), (11, [1e7, 0.0], 2), (12, [0.0, 0.0], 1), (13, [-1.0, -1.0], 1), (200, [3.0], 1), (15, [3.0], 1), (16, [1.5], 4), (300, [1e6, 1.0], 1), (17, [0.4, 0.9], 5), (18, [0.7, 1.2], 6)]
    assert check(spark, rows)
    assert check(spark, rows, positives=1, negatives=2, shares=(10, 100))
    assert check(spark, rows[:1]) == [] and check(spark, [r for r in rows if r[2] is None]) == [] and check(spark, [r for r in rows if r[2] == 1]) is not None


def test_query(spark):
    got = hardneg.op13_hard_negatives(spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
