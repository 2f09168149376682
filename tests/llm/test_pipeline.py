import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from sumlattice.llm import bpe, classifier, pii
from sumlattice.llm.common import shared_dir


def test_stages(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    folder = Path(shared_dir(spark))
    before = {*folder.iterdir()}
    out = pipeline.run(spark, path).toPandas()
    (left,) = {*folder.iterdir()} - before  # the result's table alone
    assert [p.name for p in left.iterdir()] == ["005-best-fit-packing"]
    assert len(pipeline.STAGES) == 5 and set(out["doc_id"]) <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert (out.groupby("sequence_id")["length"].sum() <= 2048).all()
    for _, f in pipeline.STAGES[1:4]:
        assert f(spark, docs.limit(0), path).columns == docs.columns and f(spark, docs.limit(0), path).count() == 0


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a clean text"), (2, None)], "doc_id long, text string")
    for labels in ([], [(7, 1)]):  # none at all, none of these documents
        model = classifier.trained(spark, docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert {r["doc_id"] for r in classifier.keep_good(spark, docs, model).collect()} == {1, 2}
    assert classifier.keep_good(spark, docs, 0.0).count() == 0 and classifier.keep_good(spark, docs, 1.0).count() == 2


def first_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        for i, used in enumerate(bins):
            if used + n <= capacity:
                bins[i] += n
                break
        else:
            bins.append(n)
    return len(bins)


def test_run_against_a_plain_version(spark):
    from test_duplicates import components_of

    path = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    # Scores are those of the classifier, which has tests of its own; all later stages are plain Python.
    scores = classifier.score(spark, docs, classifier.trained(spark, docs, labels))
    good = {r["doc_id"] for r in scores.collect() if r["score"] >= classifier.THRESHOLD}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good)
    kept = {i for i, _, c in components_of(rows, 5, 80) if i == c}
    rows, seen, texts = [r for r in rows if r[0] in kept], set(), {}
    for i, t in rows:
        w, gone = re.findall(r"[^\x20\x09-\x0D]+", t or ""), set()
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                gone.update(range(k, k + 20))
            seen.add(window)
        texts[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
    texts = {i: pii.redact(t, pii.find(t)[1]) for i, t in texts.items()}
    library, want = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY)), set()
    library.no_truncation(), library.no_padding()
    for i, t in texts.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))}
    out = pipeline.run(spark, path).toPandas()
    assert {tuple(map(int, r)) for r in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)} == want and len(out) == len(want)
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 2048
    assert -(-out["length"].sum() // 2048) <= out["sequence_id"].nunique() <= first_fit(out["length"], 2048)


def test_stages_keep_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, "x"), (None, "", "y"), (None, None, None), (2, "mail a@b.co now", "z"), (2, "mail a@b.co now", "z"), (3, long, None), (4, long + " end", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed string").repartition(3)
    near, cut, private = (f(spark, df, "") for _, f in pipeline.STAGES[1:4])
    assert sorted((str(r["doc_id"]) for r in near.collect())) == ["1", "2", "3", "None", "None"]
    assert cut.count() == 7 and max(len(r["text"]) for r in cut.where("doc_id = 4").collect()) < 200 and cut.where("doc_id = 3").first()["text"] == long
    assert private.count() == 7 and private.where("text = 'mail <EMAIL> now'").count() == 2
    packed = pipeline.STAGES[4][1](spark, df, "").toPandas()
    assert (packed.groupby("sequence_id")["length"].sum() <= 2048).all() and packed["doc_id"].isna().sum() == 2
    for out in (near, cut, private):
        assert out.columns == df.columns
