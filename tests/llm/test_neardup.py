import math

import numpy as np
import pytest

from sumlattice.llm import neardup
from sumlattice.llm.vectors import unit


def brute(rows, threshold=0.9):
    """(n_links, component, kept) of each row by comparing all pairs."""
    ok = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links = {i: set() for i in range(len(rows))}
    for d in {len(rows[i][1]) for i in ok}:
        own = [i for i in ok if len(rows[i][1]) == d]
        x = unit(np.array([rows[i][1] for i in own], float))
        for a, b in zip(*np.nonzero(x @ x.T >= threshold)):
            if a != b:
                links[own[a]].add(own[b])
    out, low = [None] * len(rows), {}
    for i in range(len(rows)):
        if i not in low:
            seen, todo = {i}, [i]
            while todo:
                todo += (new := links[todo.pop()] - seen)
                seen |= new
            ids = [rows[k][0] for k in seen if rows[k][0] is not None]
            low |= {k: min(ids, default=None) for k in seen}
        c = low[i]
        out[i] = (rows[i][0], len(links[i]), c, c is None or rows[i][0] == c)
    return out


def test_codes_estimate_without_bias():
    rng = np.random.default_rng(4)
    for dims in (8, 64, 100):
        x = unit(rng.standard_normal((600, dims)))
        turned = x @ neardup.rotation(dims).T
        assert np.allclose(turned @ turned.T, x @ x.T)
        codes, factor = neardup.encode(turned)
        estimate, half = neardup.interval(codes, factor, neardup.planes(turned[:200]), dims)
        error = estimate - x @ x[:200].T
        error[np.arange(200), np.arange(200)] = 0
        assert (np.abs(error) <= half).mean() > 0.9999 and abs(error.mean()) < 0.004
        tight, wide = np.abs(error).std(), half.mean()
        assert tight < wide  # the interval isn't empty, nor does it decide nothing
        assert (estimate + half < 0.9).mean() > (0.5 if dims == 64 else 0.0)
    bits = neardup.pack_bits(np.eye(70, dtype=bool))
    assert bits.shape == (70, 2) and (np.bitwise_count(bits).sum(1) == 1).all()


def near(rng, v, cosine):
    r = rng.standard_normal(len(v))
    r -= (r @ v) * v
    return cosine * v + math.sqrt(1 - cosine**2) * r / np.linalg.norm(r)


def planted(seed=3, dims=24, n=400):
    rng = np.random.default_rng(seed)
    x = unit(rng.standard_normal((n, dims)))
    out = [*x]
    out += [near(rng, x[0], rng.uniform(0.985, 1)) for _ in range(250)]  # a large tight group
    out += [near(rng, x[1], rng.uniform(0.9, 0.97)) for _ in range(60)]  # a wide one, chains within it
    out += [near(rng, x[2 + i], c) for i, c in enumerate(np.linspace(0.88, 0.93, 100))]
    out += [x[3] * 1e200, x[3] * 1e-200, x[3] * 7]
    out += [x[4]] * 150  # copies
    return [(int(i), [*map(float, v)]) for i, v in enumerate(out)]


@pytest.mark.parametrize("block", [512, 40])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = planted()
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, n long").repartition(3)
    want = {r[0]: r for r in brute(rows)}
    # With all cells every pair meets: nothing may differ.
    got = {r["vec_id"]: tuple(r) for r in neardup.near_duplicates(spark, df, cells=10_000).collect()}
    assert got == want
    got = {r["vec_id"]: tuple(r) for r in neardup.near_duplicates(spark, df).collect()}
    assert all(got[i][1] <= want[i][1] for i in want)
    assert sum(r[1] for r in got.values()) >= 0.99 * sum(r[1] for r in want.values())
    loose = [i for i in want if 0 < want[i][1] < 5]
    assert sum(got[i][1] for i in loose) >= 0.95 * sum(want[i][1] for i in loose)


def test_visits_between_balls(spark, monkeypatch):
    """Two groups whose angle is about the threshold's: neither all nor none of their pairs are linked."""
    monkeypatch.setattr(neardup, "BLOCK", 30)
    rng = np.random.default_rng(8)
    a = unit(rng.standard_normal((1, 6)))[0]
    b = near(rng, a, 0.9)
    rows = [(i, [*map(float, near(rng, (a, b)[i % 2], rng.uniform(0.98, 1)))]) for i in range(300)] + [(1000 + i, [*map(float, near(rng, a, rng.uniform(0.8, 0.97)))]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for cells in (10_000, neardup.CELLS):
        got = {r["vec_id"]: tuple(r) for r in neardup.near_duplicates(spark, df, cells=cells).collect()}
        assert got == {r[0]: r for r in brute(rows)} or cells == neardup.CELLS


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, -0.0]), (2, [0.0, 1.0]), (3, [0.0, 3.0]), (None, [0.0, 1.0]), (None, [-1.0, -1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (None, None), (9, [1.0]), (10, [5.0]), (11, [-1.0]), (1, [1.0, 0.0]), (12, [float("inf"), 0.0]), (13, [-0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "vec_id long, embedding array<double>, node string, kept boolean").repartition(2)
    got = sorted(map(str, map(tuple, neardup.near_duplicates(spark, df).collect())))
    assert got == sorted(map(str, brute(rows)))
    assert neardup.near_duplicates(spark, df.limit(0)).count() == 0 and neardup.near_duplicates(spark, df.where("vec_id = 4")).count() == 1
    single = df.selectExpr("vec_id", "cast(embedding AS array<float>) AS embedding")
    assert neardup.near_duplicates(spark, single).count() == len(rows)
    with pytest.raises(ValueError):
        neardup.near_duplicates(spark, df, 1.0)


def test_query(spark):
    got = neardup.op12_embedding_near_dedup(spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))
