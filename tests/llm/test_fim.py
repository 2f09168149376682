import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sumlattice.llm import fim


def plain_form(doc_id, text, unit="line", rate=100, spm_rate=50):
    text = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else [*text]
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return len(u), "plain", None, None, text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm_rate else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit", fim.UNITS)
def test_every_cut(unit):
    texts = ["", "\n", "a", "a\n", "\n\n\n", "é\nß𝄞\n\nx", "ab\n" * 40 + "end", "𝄞é" * 50, "é" * 300 + "\n" + "x\n" * 7]
    for text in texts:
        data = text.encode()
        units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else [*text]
        for stride in (1, 3, 64):
            for chunk in (1, 2, 7, 1 << 16):
                index = fim.Checkpoints(data, unit, stride, chunk)
                assert index.n == len(units) and index.n_chars == len(text) and len(index.at) <= 1 + len(units) // stride
                for k in range(len(units) + 1):
                    head = "".join(units[:k])
                    assert index.cut(k) == (len(head.encode()), len(head))
    with pytest.raises(ValueError):
        fim.Checkpoints(b"", "word")


def test_rows(spark):
    long = "".join(f"line {i} ß𝄞 {'x' * (i % 97)}\n" for i in range(30_000)) + "y" * 300_000
    texts = ["a\nb\nc\n", "", None, "one", "x <P> y\nz", "<S>\n", "\r\n a\n", "<\nP>\nS>", "a<\n<S\n<M", long, long[::-1]]
    rows = [(i, t, 7) for i, t in enumerate(texts * 6)] + [(None, "a\nb", 0), (3, "one", 1), (3, "one", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    for unit, rate, spm in (("line", 100, 50), ("character", 60, 100), ("line", 100, 0)):
        made = fim.transform(df, unit=unit, rate=rate, spm_rate=spm).withColumn("back", fim.restored())
        got = sorted(map(tuple, made.collect()), key=str)
        assert got == sorted(((i, *plain_form(i, t, unit, rate, spm), t or "") for i, t, _ in rows), key=str)
    assert fim.transform(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.transform(df, unit="word")


def test_query(spark):
    got = fim.op11_fill_in_middle(spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {(r["doc_id"], *(f := plain_form(r["doc_id"], r["text"]))[:4], sha(f[4]), sha(r["text"] or "")) for r in docs.collect()}
    assert {tuple(r) for r in got.collect()} == want and got.where(F.col("form") == "psm").count() > 0 < got.where("form = 'spm'").count()
