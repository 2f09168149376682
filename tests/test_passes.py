"""How often inputs are read, what is left in the shared folder, and CSV in stores that aren't local."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumlattice.plans import analyze, search
from sumlattice.sources import prepare, staging, store


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (90, 3))
    y = (x[:, 0] + x[:, 1] + rng.integers(0, 2, 90) > 2).astype(int)
    at = str(tmp_path_factory.mktemp("source"))
    spark.createDataFrame([(i, int(y[i]), *map(int, x[i])) for i in range(90)], "id long, y int, q1 int, q2 int, q3 int").repartition(2).write.mode("overwrite").parquet(at)
    return at


def scans(spark, at, run):
    """How often ``run`` reads a table: its rows are counted as they come from the source."""
    counter = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            counter.add(len(b))
            yield b

    df = spark.read.parquet(at)
    run(df.mapInPandas(count, df.schema))
    return counter.value / df.count()


def test_one_pass(spark, source):
    kw = {"max_items": 2, "outer_k": 2, "inner_k": 2, "outer_repeats": 1, "preselect_top_n": 2}
    assert scans(spark, source, lambda df: search.brute_force(df, "y", ["q1", "q2", "q3"]).candidates.collect()) == 1
    assert scans(spark, source, lambda df: search.exhaustive_search(df, "y", ["q1", "q2", "q3"], ci=True).collect()) == 1
    assert scans(spark, source, lambda df: str(analyze.analyze(df, "y", ["q1", "q2", "q3"], "id", **kw))) == 1


def left(spark):
    return sorted(n.rsplit("-", 1)[0] for n in os.listdir(staging.shared_folder(spark)) if n.startswith("sumlattice-"))


def test_scratch(spark, source):
    df = spark.read.parquet(source)
    before = left(spark)
    a = analyze.analyze(df, "y", ["q1", "q2", "q3"], "id", max_items=2, outer_k=2, inner_k=2, outer_repeats=1, preselect_top_n=2)
    new = left(spark)
    for x in before:
        new.remove(x)
    assert new == [f"sumlattice-{x}" for x in ("final-candidates", "outer-predictions", "outer-results", "results")]
    assert a.nested.summary.count() == 2 and a.nested.outer_predictions.count() == 90 and a.n_original == a.n_analyzed == 90
    before = left(spark)
    with staging.scratch(spark):
        assert search.brute_force(df, "y", ["q1", "q2"]).candidates.count() == 3 and len(left(spark)) > len(before)
        with pytest.raises(ValueError):
            search.brute_force(df.withColumn("y", F.lit(2)), "y", ["q1"])
    assert left(spark) == before


def test_checks_of_one_pass(spark):
    text = spark.createDataFrame([(1, "1", " 2 ", 1.0), (2, "0", "", 2.0), (3, "0", "3e0", float("nan")), (4, "0", "4", 5.0), (5, None, "1", 1.0), (6, "", "x", None)], "id long, y string, a string, b double")
    with pytest.raises(ValueError, match="column a contains"):
        prepare.prepared(text, "y", ["a", "b"], lenient=True)
    got = prepare.prepared(text.where("id < 6"), "y", ["a", "b"], row_id="id", lenient=True)
    assert (got.n_original, got.n_analyzed) == (5, 2) and sorted(map(tuple, got.rows.collect())) == [(1, 1, [2.0, 1.0]), (4, 0, [4.0, 5.0])]
    assert sorted(map(tuple, got.patterns.collect())) == [([2.0, 1.0], 1, 0), ([4.0, 5.0], 0, 1)]
    assert prepare.prepared(text.where("id < 6"), "y", ["a"], lenient=True).n_analyzed == 3  # the gap in b doesn't matter
    for broken, message in ((text.where("id < 5").withColumn("y", F.lit(2)), "two labels"), (text.where("id = 4"), "one class"), (text.withColumn("b", F.lit(float("inf"))).where("id < 6"), "column b contains"), (text.withColumn("y", F.lit("yes")), "column y contains")):
        with pytest.raises(ValueError, match=message):
            prepare.prepared(broken, "y", ["a", "b"], lenient=True)
    with pytest.raises(ValueError, match="only one class"):  # the other class has gaps only
        prepare.prepared(text.where("id IN (1, 2)"), "y", ["a"], lenient=True)
    bad = text.where("id < 5").withColumn("y", F.col("y").cast("int"))
    with pytest.raises(ValueError, match="item b has NA"):
        prepare.prepared(bad, "y", ["b"])
    with pytest.raises(ValueError, match="item a must be numeric"):
        prepare.prepared(bad, "y", ["a"])


def test_csv_of_a_store(spark, source, tmp_path):
    """A path that only Hadoop's file systems know."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shelf.link./out", f"file://{tmp_path}")
    df = spark.read.parquet(source).repartition(5).orderBy("id").withColumn("a, b", F.lit('x "y", z'))
    files = store.write_csv(spark, "viewfs://shelf/out/deep/er", {"one": df, "two": None, "three": df.limit(0), "four": df.select("id")})
    assert [f.rsplit("/", 1)[1] for f in files] == ["one.csv", "three.csv", "four.csv"] and sorted(n for n in os.listdir(tmp_path / "deep/er") if not n.startswith(".")) == ["four.csv", "one.csv", "three.csv"]
    back = spark.read.option("header", True).option("escape", "\\").csv("viewfs://shelf/out/deep/er/one.csv")
    assert back.columns == df.columns and [int(r["id"]) for r in back.coalesce(1).collect()] == [*range(90)] and back.first()["a, b"] == 'x "y", z'
    assert (tmp_path / "deep/er/three.csv").read_text() == 'id,y,q1,q2,q3,"a, b"\n'
    out = "viewfs://shelf/out/analysis"
    analyze.analyze(spark.read.parquet(source), "y", ["q1", "q2", "q3"], "id", max_items=2, outer_k=2, inner_k=2, outer_repeats=1, preselect_top_n=2, output_dir=out)
    made = sorted(n for n in os.listdir(tmp_path / "analysis") if n.endswith(".csv") and not n.startswith("."))
    assert len(made) == 8 and len((tmp_path / "analysis" / "nested_cv_outer_predictions.csv").read_text().splitlines()) == 91
    (tmp_path / "file").write_text("")
    with pytest.raises(Exception):
        store.write_csv(spark, str(tmp_path / "file"), {"one": df})


def rows_read(df):
    """Rows that the scan of a collected table read from the row groups it didn't skip."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            found.append(p.metrics().apply("numOutputRows").value())
        if hasattr(p, "plan") and p.getClass().getSimpleName().endswith("StageExec"):
            walk(p.plan())
        children = p.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return sum(found)


def test_conditions_skip_row_groups_of_stored_results(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "GROUP_BYTES", 1 << 14)
    rng = np.random.default_rng(9)
    x = rng.integers(0, 3, (60, 14))
    y = (x[:, 0] + x[:, 1] + rng.integers(0, 2, 60) > 2).astype(int)
    items = [f"q{i}" for i in range(14)]
    df = spark.createDataFrame([(int(y[i]), *map(int, x[i])) for i in range(60)], ", ".join(["y int", *(f"{q} int" for q in items)]))
    run = lambda rank_by: search.brute_force(df, "y", items, max_items=4, rank_by=rank_by, results_storage="parquet", results_dir=str(tmp_path))
    found = run("sensitivity")
    full = spark.read.parquet(found.results_path)
    every, good = rows_read(full.select("items", "sensitivity")), full.select("items", "sensitivity").where("sensitivity >= 0.9")
    assert every == found.total_combinations == 1470 and good.count() <= rows_read(good) < every / 2
    plain = search.brute_force(df, "y", items, max_items=4, top_n=None).candidates
    show = lambda t: sorted(map(str, t.select("items", "auc", "sensitivity", "cutoff").collect()))
    assert show(good.select("*").join(full, ["items", "sensitivity"])) == show(plain.where("sensitivity >= 0.9")) and show(full) == show(plain)


def test_ranks_of_all_rows_shuffle_them_once(spark):
    df = spark.range(0, 5000, 1, 3).select("id", (F.xxhash64("id") % 50).alias("v"))
    seen = spark.sparkContext.accumulator(0)
    counted = df.mapInPandas(lambda frames: (f for f in frames if seen.add(len(f)) or True), df.schema)
    from sumlattice.operators import ranking

    with staging.scratch(spark):
        got = ranking.ranked(counted, [F.desc("v"), F.asc("id")])
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "Exchange hashpartitioning(_at" not in plan and plan.count("Sort [") <= 1
        rows = got.orderBy("rank").collect()
        assert [r["rank"] for r in rows] == [*range(1, 5001)] and [(r["v"], r["id"]) for r in rows] == sorted(((r["v"], r["id"]) for r in df.collect()), key=lambda t: (-t[0], t[1]))


def test_complete_rows_have_no_flags(spark, monkeypatch):
    tables, write = {}, prepare.staged
    monkeypatch.setattr(prepare, "staged", lambda t, label="table", **kw: tables.setdefault(label, write(t, label, **kw)))
    rows = spark.createDataFrame([(1, 1, 2.0, 1.0), (2, 0, None, 2.0), (3, 0, 3.0, 4.0)], "id long, y int, a double, b double")
    got = prepare.prepared(rows, "y", ["a", "b"], row_id="id", lenient=True)
    assert {(r["row_id"], r["gaps"] and tuple(r["gaps"]), r["bad"]) for r in tables["rows"].collect()} == {(1, None, None), (2, (True, False), None), (3, None, None)}
    assert (got.n_original, got.n_analyzed, got.rows.count()) == (3, 2, 2)
