import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sumlattice.llm import components, jaccard, substrings, words
from sumlattice.llm.common import Stage


def corpus(seed=1):
    rnd = random.Random(seed)
    new = lambda n: [f"w{rnd.randint(0, 99999)}" for _ in range(n)]
    passage, out = new(60), []
    base = new(120)
    for i in range(60):  # near copies, at all distances
        t = base.copy()
        for _ in range(rnd.randint(0, 7)):
            t[rnd.randrange(len(t))] = rnd.choice(new(1))
        out.append(t)
    out += [base] * 12
    out += [new(30) + passage + new(30) for _ in range(15)]
    out += [new(rnd.randint(1, 6)) for _ in range(10)] + [["a"], ["a"], ["a", "b"], ["a"] * 50, passage + passage]
    rnd.shuffle(out)
    rows = [(i * 3, " \n".join(t), "x") for i, t in enumerate(out)]
    return rows + [(1000, None, "x"), (1001, "", "x"), (1002, " \t\n", "x"), (1003, "É é x " * 30, None), rows[5], rows[6]]


def shingles(text, k):
    w = [bytes(x) for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components_of(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t, *_ in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, s in sets:
        for b, t in sets:
            if a < b and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(s), find(i)) for i, s in sets}


def test_jaccard_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string").repartition(4)
    for k, percent in ((4, 85), (5, 80)):
        got = jaccard.join(spark, df, size=k, percent=percent)
        assert {tuple(r)[:3] for r in got.collect()} == components_of(rows, k, percent) and got.count() == len(rows)
    kept = jaccard.one_of_each(spark, df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i, _, c in components_of(rows, 5, 80) if i == c})
    assert jaccard.join(spark, df.limit(0)).count() == 0 == jaccard.one_of_each(spark, df.limit(0)).count()
    alone = spark.createDataFrame([(None, "a b c d e f", None), (4, "a b c d e f", None)], "doc_id long, text string, lang string")
    assert {tuple(r)[:3] for r in jaccard.join(spark, alone).collect()} == {(None, 2, None), (4, 2, 4)}


def test_all_links_count(spark, monkeypatch):
    rows = corpus(3)
    rows += [(2000 + i, " ".join(f"m{k}" for k in range(300) if k not in (i, 250)), "x") for i in range(40)]  # all near one another
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string").repartition(4)
    sets = {i: frozenset(shingles(t, 4)) for i, t, *_ in rows}
    near = lambda s, t: s != t and 100 * len(s & t) >= 85 * len(s | t)
    want = {(i, sum(near(s, t) for t in set(sets.values()) if s and t)) for i, s in sets.items()}
    assert max(n for _, n in want) >= 39
    for group in (2048, 7):  # one block, and several for each component
        monkeypatch.setattr(jaccard, "GROUP", group)
        got = jaccard.join(spark, df, size=4, percent=85)
        assert {(r["doc_id"], r["n_links"]) for r in got.collect()} == want and got.count() == len(rows)


def test_overlaps(monkeypatch):
    rng = np.random.default_rng(6)
    for full, pairs in ((200, 1 << 22), (0, 50), (2, 50), (10**6, 1 << 22)):  # both, thin columns only, few at a time, full only
        monkeypatch.setattr(jaccard, "FULL", full), monkeypatch.setattr(jaccard, "PAIRS", pairs), monkeypatch.setattr(jaccard, "DENSE", 16)
        x, y = ([np.unique(rng.integers(0, 150, rng.integers(1, 90)).astype(np.uint64)) for _ in range(n)] for n in (12, 5))
        for p, q in ((x, y), (x, x), (x[:1], [np.array([999], np.uint64)])):
            assert jaccard.overlaps(p, q).tolist() == [[len(np.intersect1d(a, b)) for b in q] for a in p]


def test_bound_holds():
    rng = np.random.default_rng(5)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 400, np.uint64) * np.uint64(2)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        assert jaccard.most_common(jaccard.counts(a), jaccard.counts(b), len(a), len(b)) >= len(np.intersect1d(a, b))


def test_components(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(100, 140)] + [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(40)] + [(500, i) for i in range(501, 600)]
    root = {x: x for p in links for x in p}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(links, "a long, b long")
    want = {(x, r) for x, r in root.items() if any(x in p and p[0] != p[1] for p in links)}
    assert {tuple(r) for r in components.components(Stage(spark, "t"), df).collect()} == want


def test_words(monkeypatch):
    texts = ["Ab  c\td", None, "", "  ", "x" * 3000, "é É b\x0bc", "q"]
    for piece in (4, 1000, 1 << 20):
        monkeypatch.setattr(words, "PIECE", piece)
        w = words.find(pa.array(texts), lower=True)
        assert [[bytes(w.data[a:b]) for a, b in zip(w.start[w.bound[i] : w.bound[i + 1]], w.end[w.bound[i] : w.bound[i + 1]])] for i in range(len(w))] == [(t or "").encode().split() for t in texts]
        same = words.find(pa.array(["c ab", "d"]))
        assert w.of(0)[0] == same.of(0)[1] and w.of(0)[1] == same.of(0)[0] and w.of(0)[2] == same.of(1)[0]
    assert len(words.shingle_set(w.of(0), 5)) == 1 and not len(words.shingle_set(w.of(1), 5))


def cut(rows, n):
    seen, at = {}, {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        for p in range(len(w) - n + 1):
            seen.setdefault(tuple(w[p : p + n]), (i, p))
    out = set()
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - n + 1):
            if seen[tuple(w[p : p + n])] < (i, p):
                gone |= {*range(p, p + n)}
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.add((i, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return out


def test_substrings_against_plain(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string, whole string").repartition(4)
    for batches in (1, 2, 6):
        got = substrings.dedup(spark, df, batches=batches).select("doc_id", "n_words", "n_removed", "kept_sha256")
        assert {tuple(r) for r in got.collect()} == cut(rows, 20) and got.count() == len(rows)
    new = substrings.without_repeats(spark, df)
    assert new.columns == df.columns and new.count() == len(rows)
    want = {(i, h) for i, _, _, h in cut(rows, 20)}
    assert {(r["doc_id"], hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest()) for r in new.collect()} == want
    assert substrings.dedup(spark, df.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, "a b " * 20), (1, "a b " * 20)], "doc_id long, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in substrings.dedup(spark, alone).collect()} == {(None, 0), (1, 38)}


def test_index_across_calls(spark, tmp_path, monkeypatch):
    rows = corpus(5)[:-4]  # ids ascend
    df = spark.createDataFrame(rows, "doc_id long, text string, whole string")
    got, n = set(), len(rows)
    for k, (lo, hi) in enumerate(((0, n // 4), (n // 4, n // 2), (n // 2, 3 * n // 4), (3 * n // 4, n))):
        part = lambda a, b: spark.createDataFrame(rows[a:b], df.schema).repartition(3)
        if k == 2:  # a call breaks off before its result is written, and is made again
            with monkeypatch.context() as broken, pytest.raises(ZeroDivisionError):
                broken.setattr(substrings, "_cut", lambda *_: 1 // 0)
                substrings.dedup(spark, part(lo, hi), batches=2, index=str(tmp_path / "index"))
        found = substrings.dedup(spark if k < 2 else spark.newSession(), part(lo, hi), batches=1, index=str(tmp_path / "index"))
        got |= {tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    assert got == cut(rows, 20)
    index = substrings.FingerprintIndex(spark, str(tmp_path / "index"))
    assert [len(r.names) for r in (index.fingerprints, index.windows, index.wholes)] == [2, 2, 2]  # others were merged
    for r in index.kinds:
        for run in r.every():
            assert run.count() == run.select(*r.keys).distinct().count() > 0
    physical = lambda df: df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    batch = spark.range(5).select("id", F.col("id").alias("key")).groupBy("key").count()
    with substrings._sorted_buckets(spark):
        plan = physical(batch.join(index.fingerprints.every()[0].hint("merge"), "key"))
        assert plan.count("Exchange") == plan.count("Sort [") == 1  # of the batch; the run stays where and as it is
        merged = []
        monkeypatch.setattr(index.fingerprints, "_write", lambda rows, first, last: merged.append(physical(rows)) or "run")
        index.fingerprints.compact(1, F.coalesce("a.doc", "b.doc").alias("doc"))
        assert len(merged) == 1 and "SortMergeJoin" in merged[0] and "Exchange" not in merged[0] and "Sort [" not in merged[0]
    index.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_regular_words_differ(spark):
    flip = str.maketrans("ab", "ba")
    for n in (64, 1024, 4096):
        x = thue_morse(n)
        keys = words.find(pa.array([f"{x} {x.translate(flip)} {x}"])).key
        assert keys[0] == keys[2] != keys[1]
    x = thue_morse(2048)
    y = x.translate(flip)
    rows = [(1, " ".join([x] * 30)), (2, " ".join([y] * 30)), (3, " ".join([*"abcdefghijklmnopqrstuv", x])), (4, " ".join([*"abcdefghijklmnopqrstuv", y]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r)[:3] for r in jaccard.join(spark, df, size=4, percent=95).collect()} == components_of(rows, 4, 95)
    assert {tuple(r) for r in substrings.dedup(spark, df, batches=1).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()} == cut(rows, 20)
