import gzip
import hashlib

import numpy as np
import pytest

from sumlattice.llm import ann, warc


def test_records_and_damage():
    data = warc.write_record(1, "http://a b/\r\n", b"x" * 500) + warc.write_record(2, None, b"") + warc.write_record(3, "u", b"x" * 500, 1)
    for size in (1, 7, 1 << 20):
        got = [*warc.read_records(data[i : i + size] for i in range(0, len(data), size))]
        assert [r.headers["warc-type"] for r in got] == ["response", "response", "revisit"] and [len(r.payload) for r in got] == [500, 0, 0]
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\n") and b"a%20b/%0D%0A" in gzip.decompress(data)
    with pytest.raises(warc.WarcError):
        [*warc.read_records([data[:-5]])]
    with pytest.raises(warc.WarcError):
        [*warc.read_records([data[: len(data) // 2]])]
    plain = gzip.decompress(warc.write_record(1, "u", b"hello"))
    for bad in (plain.replace(b"hello", b"jello"), plain.replace(b"Content-Length: 5\r\n\r\nhello", b"Content-Length: 5\r\n\r\nhell"), plain[:-1], b"nothing"):
        with pytest.raises(warc.WarcError):
            [*warc.read_records([gzip.compress(bad)])]


def test_reader_inflates_no_more_than_a_chunk_ahead():
    data = warc.write_record(1, "u", b"x" * (50 << 20)) + warc.write_record(2, "u", b"y")
    members = warc._Members(data[i : i + 5000] for i in range(0, len(data), 5000))
    assert members.next() and members.until(b"\r\n\r\n").startswith(b"WARC/1.1")
    most, n = 0, 0
    for piece in members.exactly(50 << 20):
        most, n = max(most, len(piece) + len(members.plain)), n + len(piece)
    assert n == 50 << 20 and most <= warc.CHUNK
    assert [len(r.payload) for r in warc.read_records([data[:9], b"", data[9:], b""])] == [50 << 20, 1]
    assert [*warc.read_records([])] == [] and [*warc.read_records([b""])] == []


def test_revisits_are_checked(spark):
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    good = [(1, 200, "a", "response", None), (2, 200, "a", "revisit", 1), (None, 0, "e", "response", None)]
    assert sorted(map(str, warc.checked(spark, spark.createDataFrame(good, columns)).collect())) == sorted(map(str, spark.createDataFrame(good, columns).collect()))
    for bad in ((3, 200, "b", "revisit", 1), (3, 201, "a", "revisit", 1), (3, 200, "a", "revisit", 2)):
        with pytest.raises(warc.WarcError):
            warc.checked(spark, spark.createDataFrame([*good, bad], columns))


def test_pages(spark, tmp_path):
    big = "é" * 60
    rows = [(5, "u", big), (2, "u", big), (9, None, big), (2, "u", "short"), (7, "u", "short"), (1, "u", None), (None, "u", big), (3, "u", big + "!"), (9, None, big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    table = warc.write_archives(spark, df)
    got = sorted(map(tuple, warc.read_archives(table).collect()), key=str)
    want = []
    for page, _, html in rows:
        payload = (html or "").encode()
        again = page is not None and html == big and page > 2
        want.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want, key=str)
    files = warc.export(table, str(tmp_path))
    assert sum(len([*warc.read_records([open(f, "rb").read()])]) for f in files) == len(rows)
    assert warc.read_archives(warc.write_archives(spark, df.limit(0))).count() == 0


def nearest(rows, queries, k=5):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, a in rows:
        if q in queries:
            s = sorted((-float(a @ b / np.sqrt((a @ a) * (b @ b))), i) for i, b in rows if i != q)[:k]
            out[q] = [i for _, i in s]
    return out


def test_search_recall_and_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    rows = [(i, [*map(float, v)]) for i, v in enumerate(x)]
    rows += [(9000 + i, rows[7][1]) for i in range(300)]  # a large group of equal vectors
    rows += [(9990, None), (9991, []), (9992, [0.0] * 32), (9993, [float("nan")] * 32), (9994, [None] * 32), (9995, [1.0] * 31), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = ann.search(spark, df, df.where("vec_id % 50 = 0 AND vec_id < 9990")).toPandas()
    want = nearest([r for r in rows if r[0] != 9995], {r[0] for r in rows if r[0] is not None and r[0] % 50 == 0})
    assert set(got["query_id"]) == set(want)
    hits = sum(len(set(own["vec_id"]) & set(want[q])) for q, own in got.groupby("query_id"))
    assert hits >= 0.95 * 5 * len(want)
    same = got[got.query_id == 9000].sort_values("rank")
    assert same["vec_id"].tolist() == [7, 9001, 9002, 9003, 9004] and np.allclose(same["score"], 1)
    few = df.where("vec_id < 3")
    assert ann.search(spark, few, few.where("vec_id = 0")).count() == 2
    assert ann.search(spark, df.limit(0), df.limit(0)).count() == 0 == ann.search(spark, df, df.limit(0)).count()


def test_table_scan_equals_products():
    rng = np.random.default_rng(3)
    x = ann._unit(rng.standard_normal((500, 9)))
    books = ann.fit(x)
    codes = ann.encode(x, books, ann.eta(9))
    recon = np.concatenate([books[m][codes[:, m]] for m in range(len(books))], 1)
    tables = np.stack([x[:20, a:b] @ books[m].T for m, (a, b) in enumerate(ann.split(9))], 1).astype(np.float32)
    assert np.allclose(ann.scan(tables, codes), x[:20] @ recon.T, atol=1e-5)
    plain = np.stack([((x[:, a:b, None] - books[m].T[None]) ** 2).sum(1).argmin(1) for m, (a, b) in enumerate(ann.split(9))], 1)
    other = np.concatenate([books[m][plain[:, m]] for m in range(len(books))], 1)
    loss = lambda r: ((x - r) ** 2).sum() + (ann.eta(9) - 1) * (((x - r) * x).sum(1) ** 2).sum()
    assert loss(recon) <= loss(other)


def test_rerank_goes_on_where_codes_tie():
    rng = np.random.default_rng(5)
    unit, ids = ann._unit(rng.standard_normal((1000, 8))), np.arange(1000)
    q, qid = unit[:20], np.arange(20)
    exact = q @ unit.T
    exact[qid, qid] = -np.inf
    want = np.argsort(-exact, 1, kind="stable")[:, :5]
    # The rough scores tell nothing for the first ten queries, all for the others.
    rough = np.where(np.arange(20)[:, None] < 10, rng.standard_normal(exact.shape), exact).astype(np.float32)
    least = np.full(20, -np.inf)
    s, i = ann.best_of(q, qid, rough, ids, unit, 5, 1000, least)
    assert (i == want).all() and np.allclose(s, np.take_along_axis(exact, want, 1))
    s, i = ann.best_of(q, qid, rough, ids, unit, 5, 50, least)
    assert (i[10:] == want[10:]).all() and (i[:10] == want[:10]).mean() > 0.8
    assert (ann.best_of(q, qid, rough[:, :3], ids[:3], unit[:3], 5, 50, least)[1][5:, 3:] == np.iinfo(np.int64).max).all()


def test_search_of_unlike_dimensions_and_repeated_queries(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [*map(float, rng.standard_normal(4 if i % 3 else 6))]) for i in range(300)] + [(50, [9.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = ann.search(spark, df, df.where("vec_id % 50 = 0"), rerank=ann.SCAN_ROWS).toPandas()
    vectors = {}
    for i, v in rows:
        vectors.setdefault(i, []).append(v)
    for q in range(0, 300, 50):
        for dims in {len(v) for v in vectors[q]}:
            a = np.array(min(v for v in vectors[q] if len(v) == dims))
            want = sorted((-(a @ np.array(v)) / np.linalg.norm(a) / np.linalg.norm(v), i) for i, v in rows if len(v) == dims and i != q)[:5]
            own = got[got.query_id == q].sort_values("rank")
            assert own["vec_id"].tolist() == [i for _, i in want] and np.allclose(own["score"], [-s for s, _ in want])


def test_long_pages_clashing_columns_and_empty_tables(spark):
    long = "<p>é</p>" * 300_000
    rows = [(1, "u", long, "x", 7, "y"), (2, "u", long, "x", 7, "y"), (3, None, "q", "x", 7, None), (3, None, "q", "x", 7, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, refers_to long, digest string")
    got = warc.checked(spark, warc.read_archives(warc.write_archives(spark, pages)))
    size, digest = len(long.encode()), hashlib.sha256(long.encode()).hexdigest()
    small = (3, 1, hashlib.sha256(b"q").hexdigest(), "response", None)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, size, digest, "response", None), (2, size, digest, "revisit", 1), small, small], key=str)
    assert warc.checked(spark, warc.read_archives(warc.write_archives(spark, pages.limit(0)))).count() == 0
