import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumlattice.functions import combos
from sumlattice.operators import intervals, kernel, nested, ranking, roc
from sumlattice.operators.folds import stratified_folds
from sumlattice.plans import analyze, queries, search
from sumlattice.sources import prepare, store
from sumlattice.streaming import patterns as stream

_RNG = np.random.default_rng(20)
Y = [i % 2 for i in range(16)]
Q = {f"q{k}": [int(v) for v in np.clip(_RNG.integers(0, 3, 16) + np.array(Y) * _RNG.integers(0, 2, 16), 0, 2)] for k in (1, 2, 3)}


@pytest.fixture(scope="module")
def clear(spark):
    return spark.createDataFrame([(i, y, *(Q[q][i] for q in Q)) for i, y in enumerate(Y)], "row_id long, y int, q1 int, q2 int, q3 int").cache()


@pytest.fixture(scope="module")
def weak(spark):
    rng = np.random.default_rng(21)
    return spark.createDataFrame([(i, int(i > 6), *map(int, rng.integers(0, 3, 3))) for i in range(14)], "row_id long, y int, Q1 int, Q2 int, Q3 int").cache()


def brute(rows, items, low, high, method="youden"):
    """Candidate rows by comparing all pairs of rows."""
    out = []
    for k in range(low, high + 1):
        for c in itertools.combinations(items, k):
            s = [(r["y"], float(sum(r[i] for i in c))) for r in rows]
            pos, neg = [v for y, v in s if y], [v for y, v in s if not y]
            auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
            best = None
            for cut in sorted({v for _, v in s}):
                tp, tn = sum(v >= cut for v in pos), sum(v < cut for v in neg)
                sens, spec = tp / len(pos), tn / len(neg)
                you = sens + spec - 1
                key = (you, sens, spec, -cut) if method == "youden" else (-(((1 - sens) ** 2 + (1 - spec) ** 2) ** 0.5), you, cut)
                if best is None or key > best[0]:
                    best = (key, cut, sens, spec, you)
            out.append((", ".join(c), auc, *best[1:]))
    return sorted(out, key=lambda r: (-r[1], r[0].count(","), 0))


@pytest.mark.parametrize("engine", ["relational", "kernel"])
@pytest.mark.parametrize("method", ["youden", "closest_topleft"])
def test_against_pairs(clear, weak, engine, method):
    for df, items, high in ((clear, ["q1", "q2", "q3"], 3), (weak, ["Q1", "Q2", "Q3"], 2)):
        got = search.exhaustive_search(df, "y", items, 1, high, cutoff_method=method, engine=engine, top_n=20).orderBy("rank").collect()
        assert [(r["items"], r["auc"], r["cutoff"], r["sensitivity"], r["specificity"], r["youden"]) for r in got] == brute(df.collect(), items, 1, high, method)


def test_ties_and_options(spark, clear):
    got = search.exhaustive_search(clear, "y", "q1:q3", 1, 3).orderBy("rank").collect()
    assert [r["items"] for r in got] == [r[0] for r in brute(clear.collect(), ["q1", "q2", "q3"], 1, 3)] and [r["rank"] for r in got] == [*range(1, 8)]
    flat = spark.createDataFrame([(i % 2, 1, 1, 1) for i in range(40)], "y int, a int, b int, c int")
    for engine in ("relational", "kernel"):
        rows = search.exhaustive_search(flat, "y", ["a", "b", "c"], engine=engine, top_n=7).orderBy("rank").collect()
        assert {r["auc"] for r in rows} == {0.5} and [r["combo_id"] for r in rows] == [*range(7)]
    words = clear.withColumn("y", F.when(F.col("y") == 1, "case").otherwise("control"))
    assert search.exhaustive_search(words, "y", [2, 3], positive_label="case", negative_label="control").where("rank = 1").first()["items"] == brute(clear.collect(), ["q1", "q2"], 1, 2)[0][0]
    for bad in (0, -1, 1.5):
        with pytest.raises(ValueError):
            search.exhaustive_search(clear, "y", ["q1"], top_n=bad)
    chunk = search.exhaustive_search(clear, "y", ["q1", "q2", "q3"], 1, 3, chunk_start=2, chunk_size=3).orderBy("rank").collect()
    assert [r["combo_id"] for r in chunk] == [2, 3, 4]


def test_engines_agree_on_random_items(spark):
    rng = np.random.default_rng(4)
    for values in (rng.integers(0, 3, (60, 6)).astype(float), rng.standard_normal((60, 6)), rng.integers(0, 2, (60, 6)) * 0.1):
        df = spark.createDataFrame([(int(i % 2), *map(float, v)) for i, v in enumerate(values)], "y int, a double, b double, c double, d double, e double, f double")
        a, b = (search.exhaustive_search(df, "y", ["a", "b", "c", "d", "e", "f"], 1, 4, engine=e).orderBy("rank").collect() for e in ("relational", "kernel"))
        assert a == b


def test_blocks_of_candidates(spark, monkeypatch):
    rng = np.random.default_rng(14)
    df = spark.createDataFrame([(int(i % 2), *map(float, v)) for i, v in enumerate(rng.standard_normal((50, 5)))], "y int, a double, b double, c double, d double, e double")
    run = lambda **kw: search.exhaustive_search(df, "y", ["a", "b", "c", "d", "e"], 1, 4, **kw).orderBy("rank").collect()
    want = run(engine="relational")
    monkeypatch.setattr(search, "RELATIONAL_CANDIDATES", 5)
    monkeypatch.setattr(search, "CANDIDATE_BLOCK", 7)
    assert run(engine="relational") == want and run(engine="relational", top_n=6) == want[:6]
    assert [r["combo_id"] for r in run(engine="relational", chunk_start=3, chunk_size=20)] == [*range(3, 23)]
    monkeypatch.setattr(kernel, "PATTERN_BYTES", 49 * 8 * 9)  # one row too few: the plan in blocks
    assert not kernel.holds(roc.compress(prepare.strict(df, "y", ["a", "b", "c", "d", "e"])), 5) and run() == want
    with pytest.raises(ValueError, match="kernel"):
        run(engine="kernel")


def test_tasks(spark):
    assert kernel.tasks(spark, 10_000, 3) == 3 and kernel.tasks(spark, 10_000, 3, 1000) == 10 and kernel.tasks(spark, 1) == 1
    rows = spark.createDataFrame([([float(i)], i % 2, 1 - i % 2) for i in range(6)], "x array<double>, p long, n long")
    assert kernel.score(spark, rows, ["a"], 1, 1, workers=3).rdd.getNumPartitions() == 3


def test_strict_errors(spark, clear):
    for change, message in ((lambda d: d.withColumn("q1", F.when(F.col("row_id") > 0, F.col("q1"))), "NA"), (lambda d: d.withColumn("y", F.lit(1)), "one class"), (lambda d: d.withColumn("y", F.col("row_id").cast("int")), "two labels"), (lambda d: d.withColumn("q1", F.lit("x")), "numeric"), (lambda d: d.drop("y"), "missing")):
        with pytest.raises(ValueError, match=message):
            prepare.strict(change(clear), "y", ["q1", "q2"])
    with pytest.warns(UserWarning, match="class proportion"):
        prepare.strict(spark.createDataFrame([(1, 1)] * 20 + [(0, 1)], "y int, a int"), "y", ["a"])


def test_lenient(spark):
    df = spark.createDataFrame([("1", " 2 ", 1.0), ("0", "", 2.0), ("0", "3e0", float("nan")), ("0", "4", 5.0), (None, "1", 1.0)], "y string, a string, b double")
    assert [tuple(r) for r in prepare.lenient(df, "y", ["a", "b"]).orderBy("a").collect()] == [(1.0, 2.0, 1.0), (0.0, 4.0, 5.0)]
    with pytest.raises(ValueError, match="non-numeric"):
        prepare.lenient(df.withColumn("a", F.lit("1d")), "y", ["a"])
    with pytest.raises(ValueError, match="numeric or coercible"):
        prepare.lenient(df.withColumn("a", F.lit(True)), "y", ["a"])


def test_delong_closed_forms(spark):
    freq = lambda pos, neg: spark.createDataFrame([(1, float(s), pos.get(s, 0), neg.get(s, 0)) for s in {*pos, *neg}], "combo_id long, score double, p long, n long")
    assert tuple(intervals.delong(freq({5: 10}, {1: 10})).first())[1:] == (1.0, 0.0, 1.0, 1.0)
    assert tuple(intervals.delong(freq({2: 10}, {2: 10})).first())[1:] == (0.5, 0.0, 0.5, 0.5)
    r = intervals.delong(freq({0: 5, 1: 10, 2: 8}, {0: 10, 1: 5, 2: 3})).first()
    assert r["auc"] == 282 / 414 and r["auc_lower"] < r["auc"] < r["auc_upper"]
    assert intervals.delong(freq({1: 1}, {0: 3})).first()["auc_se"] is None
    assert roc.auc_of(freq({1: 2}, {}), ["combo_id"]).first()["auc"] is None


@pytest.mark.parametrize("n", [0, 20_000, 300_000])
def test_rank_without_limit(spark, n):
    df = spark.range(0, n, 1, 7).select("id", (F.xxhash64("id") % 1000).alias("v"), F.lit("x" * 40).alias("pad"))
    got = ranking.ranked(df, [F.desc("v"), F.asc("id")]).toPandas().sort_values("rank")
    assert got["rank"].tolist() == [*range(1, n + 1)]
    assert got[["v", "id"]].equals(got[["v", "id"]].sort_values(["v", "id"], ascending=[False, True]))


def test_intervals_of_names_with_commas(spark, clear):
    odd = clear.select("y", F.col("q1").alias("a, b"), F.col("q2").alias("c"), F.col("q3").alias("d"))
    got = search.exhaustive_search(odd, "y", ["a, b", "c", "d"], 2, 3, ci=True, top_n=4).orderBy("rank").collect()
    want = search.exhaustive_search(clear, "y", ["q1", "q2", "q3"], 2, 3, ci=True, top_n=4).orderBy("rank").collect()
    assert [(r["auc"], r["auc_lower"], r["auc_upper"]) for r in got] == [(r["auc"], r["auc_lower"], r["auc_upper"]) for r in want] and len(got) == 4


@pytest.mark.parametrize("name", ["clopper_pearson_ci", "intervals_of_csv"])
def test_interval_queries_equal_their_sql_by_position(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    con, (query, sql) = duckdb.connect(), queries.CATALOGUE[name]
    tables = {
        "customer": "SELECT i AS c_custkey, (i * 37 % 110) * 100.0::DOUBLE - 1000 AS c_acctbal, CASE i % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'HOUSEHOLD' END AS c_mktsegment FROM range(20) t(i)",
        "orders": "SELECT i AS o_orderkey, i * 7 % 20 AS o_custkey, CASE WHEN i * i % 7 < 3 THEN 'F' ELSE 'O' END AS o_orderstatus, (i * 11 % 5 + 1) || '-X' AS o_orderpriority, (i * 131 % 450) * 1000.0::DOUBLE AS o_totalprice, DATE '1995-01-01' + CAST(i * 13 % 365 AS INTEGER) AS o_orderdate FROM range(200) t(i)",
    }
    for t, made in tables.items():
        con.execute(f"CREATE TABLE {t} AS {made}")
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    want, got = con.execute(sql), query(spark, str(tmp_path))
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("name", ["clopper_pearson_ci", "intervals_of_csv"])
def test_interval_queries_equal_their_sql_where_a_share_is_of_no_rows(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    con, (query, sql) = duckdb.connect(), queries.CATALOGUE[name]
    tables = {  # the first item runs against the outcome, so that the best cutoff is the lowest score and nobody is below it
        "customer": "SELECT i AS c_custkey, i * 3000.0::DOUBLE AS c_acctbal, 'BUILDING' AS c_mktsegment FROM range(4) t(i)",
        "orders": "SELECT i AS o_orderkey, i % 4 AS o_custkey, CASE WHEN i % 5 < 2 THEN 'F' ELSE 'O' END AS o_orderstatus, (i % 5 + 1) || '-X' AS o_orderpriority, 1000.0::DOUBLE AS o_totalprice, DATE '1995-01-01' AS o_orderdate FROM range(60) t(i)",
    }
    for t, made in tables.items():
        con.execute(f"CREATE TABLE {t} AS {made}")
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got, want = query(spark, str(tmp_path)).collect(), con.execute(sql).fetchall()
    assert any(r["npv"] is None and (r["npv_lower"], r["npv_upper"]) == (0.0, 1.0) for r in got)
    assert sorted(map(tuple, got)) == sorted(want)


def test_folds(spark):
    rows = spark.createDataFrame([(i, int(i < 30)) for i in range(100)], "row_id long, y int")
    made = stratified_folds(rows, 5, 2, 9).toPandas()
    assert (made.groupby(["repeat", "fold", "y"]).size().unstack() == [14, 6]).all().all() and (made.groupby(["repeat", "row_id"]).size() == 1).all()
    by = lambda m: m.sort_values(["repeat", "row_id"]).reset_index(drop=True)[["repeat", "row_id", "y", "fold"]]
    assert by(made).equals(by(stratified_folds(rows.repartition(7), 5, 2, 9).toPandas()))
    few = spark.createDataFrame([(i, int(i < 5)) for i in range(25)], "row_id long, y int")
    with pytest.warns(UserWarning, match="reducing"):
        assert stratified_folds(few, 10).agg(F.max("fold")).first()[0] == 5
    with pytest.raises(ValueError):
        stratified_folds(few.where("row_id >= 4"), 2)
    with pytest.raises(ValueError):
        stratified_folds(few, 1)


def test_nested_and_analysis(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (80, 3))
    y = (x[:, 0] + x[:, 1] + rng.integers(0, 2, 80) > 2).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), *map(int, x[i])) for i in range(80)], "id long, y int, q1 int, q2 int, q3 int")
    a = analyze.analyze(df, "y", ["q1", "q2", "q3"], "id", max_items=2, outer_k=2, inner_k=2, outer_repeats=1, preselect_top_n=2, output_dir=str(tmp_path / "csv"))
    assert a.nested.summary.count() == 2 and a.nested.outer_predictions.count() == 80
    assert a.final_model.first()["items"] == "q1, q2" and a.final_model.first()["auc_lower"] is not None
    assert {p.name for p in (tmp_path / "csv").glob("*.csv")} >= {"nested_cv_summary.csv", "final_model.csv"}
    rows = prepare.strict(df, "y", ["q1", "q2"], row_id="id")
    folds = stratified_folds(rows, 2, 1, 1).persist()
    train, _ = nested.train_search(folds, spark.createDataFrame([(0, 2, [0, 1])], "combo_id long, n_items int, item_idx array<int>"))
    for r in train.collect():
        own = folds.where(F.col("fold") != r["fold"]).select("y", F.expr("x[0]").alias("q1"), F.expr("x[1]").alias("q2")).collect()
        assert (r["auc"], r["cutoff"]) == brute(own, ["q1", "q2"], 2, 2)[0][1:3]
    assert "Outer folds" in str(a) and "Chosen most often" in a.nested.report() and "Observations: 80" in a.nested.summary_report()
    auc = a.plot_data("auc").collect()
    assert len(auc) == 2 and auc[0]["mean_auc"] == pytest.approx(sum(r["auc"] for r in auc) / 2) and {r["chance"] for r in auc} == {0.5}
    assert sum(r["n_selections"] for r in a.nested.plot_data("selection").collect()) == 2
    with pytest.raises(ValueError):
        a.plot_data("bars")
    one = nested.nested_cv(rows, combos.candidate_rows(spark, ["q1", "q2"], 1, 2), 2, 2, 1, 2, seed=5)
    two = nested.nested_cv(rows, None, 2, 2, 1, 2, seed=5, space=(["q1", "q2"], 1, 2))
    assert sorted(one.outer_results.collect()) == sorted(two.outer_results.collect())
    with pytest.raises(ValueError, match="inner_folds"):
        nested.nested_cv(rows, None, 2, 2, space=(["q1", "q2"], 1, 2), inner_folds="none")


def test_nested_beyond_the_kernel(spark, clear, monkeypatch):
    rows = prepare.strict(clear, "y", ["q1", "q2"], row_id="row_id")
    want = nested.nested_cv(rows, None, 2, 2, 1, 2, seed=5, space=(["q1", "q2"], 1, 2))
    want = sorted(want.outer_results.collect())
    monkeypatch.setattr(nested.kernel, "PATTERN_BYTES", 3 * 8 * (2 + 4 * 2))
    got = nested.nested_cv(rows, None, 2, 2, 1, 2, seed=5, space=(["q1", "q2"], 1, 2))
    assert sorted(got.outer_results.collect()) == want and len(want) == 2


def test_store_and_cache(spark, weak, tmp_path, monkeypatch):
    run = lambda **kw: search.brute_force(weak, "y", ["Q1", "Q2", "Q3"], **kw)
    plain = run(top_n=None)
    saved = run(results_storage="rds", results_dir=str(tmp_path))
    assert "Combinations: 7" in str(saved) and "Best" in saved.report()
    sizes = store.map_chunks(store.read_results(spark, saved.results_path), lambda part: part.groupby("n_items", as_index=False).size()[["n_items", "size"]], "n_items int, size long")
    assert {r["n_items"]: r["s"] for r in sizes.groupBy("n_items").agg(F.sum("size").alias("s")).collect()} == {1: 3, 2: 3, 3: 1}
    assert json.loads(open(saved.results_path + ".json").read())["complete"] is True
    assert store.query_results(saved.results_path, spark, "auc", None).drop("rank").count() == plain.candidates.count() == 7
    first = run(cache="reuse", cache_dir=str(tmp_path / "c"))
    again = run(cache="reuse", cache_dir=str(tmp_path / "c"), top_n=2)
    assert not first.loaded_from_cache and again.loaded_from_cache and again.candidates.count() == 2
    assert not run(cache="refresh", cache_dir=str(tmp_path / "c")).loaded_from_cache and not run(cache="reuse", cache_dir=str(tmp_path / "c"), item_count="==1").loaded_from_cache
    (tmp_path / "c" / "x" / "half").mkdir(parents=True)
    assert store.clean_cache(spark, str(tmp_path / "c")) == ["x/half"]
    assert run(cache="reuse", cache_dir=f"file://{tmp_path}/c").loaded_from_cache
    monkeypatch.setattr(store, "MEMORY_LIMIT", 3)
    large = run()  # stored without a folder being named
    assert large.results.count() == 7 and large.results_path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert run(results_storage="none", top_n=2).candidates.count() == 2
    assert run(top_n=0).candidates.count() == 0
    with pytest.raises(ValueError):
        run(cache="reuse")
    with pytest.raises(ValueError):
        store.query_results(run(results_storage="none"))


def test_conditions(spark):
    t = spark.createDataFrame([("Q1", 1, .80, 1., 1., .75, .75, .78), ("Q2", 2, .85, 2., .90, .86, .76, .87), ("Q3", 3, .83, 2., .85, .90, .75, .88)], "items string, n_items int, auc double, cutoff double, sensitivity double, specificity double, youden double, accuracy double")
    n = lambda **c: store.query_results(t, top_n=None, **c).count()
    assert [n(sensitivity=">= 0.90"), n(specificity=">= 0.86"), n(sensitivity=">= 0.90", specificity=">= 0.86"), n(auc=">= 0.83"), n(n_items="<= 2"), n(cutoff=">= 2")] == [2, 2, 1, 2, 2, 2]
    for bad in ({"ppv": ">= 0"}, {"x": "> 1"}, {"auc": "=> 1"}):
        with pytest.raises(ValueError):
            n(**bad)


def test_stream_of_patterns(spark, clear, tmp_path):
    rows = prepare.strict(clear, "y", ["q1", "q2"], row_id="row_id").select("x", "y")
    write = stream.sink(str(tmp_path / "s"))
    for epoch, part in enumerate(rows.randomSplit([0.5, 0.5], 3)):
        write(part, epoch), write(part, epoch)
    got = stream.current(spark.read.parquet(str(tmp_path / "s")))
    assert sorted(map(tuple, got.select("p", "n").collect())) == sorted(map(tuple, roc.compress(rows).select("p", "n").collect()))


def test_config():
    c = analyze.Config("y", ("a", "b", "c"), item_count="<=2", mode="quick")
    assert c.sizes() == (1, 2) and c.total_combinations == 6 and c.preselect(["a", "b", "c"]) == 6
    for bad in ({"item_count": "==1", "min_items": 1}, {"mode": "x"}, {"outer_k": 1}, {"stratified": False}, {"threads_per_worker": 2}, {"cache": "reuse"}, {"parallel": "auto"}):
        with pytest.raises(ValueError):
            analyze.Config("y", ("a", "b"), **bad)
