import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sumlattice.llm import bpe, packing

PATH = public_tokenizers.path(bpe.VOCABULARY)
ODD = ["a", "the", "ing", " ", "\n", "'", "'s", "'ll", "É", "é", "Σ", "σς", "İ", "ß", "1", "²", "½", "१", "中", "!", "?!", "<|", "<|endoftext|>", "\x1c", "\x85", "\xa0", "​", "😀", "K", "ﬁ", "_", "ª", "Ǆ", "\x00", "x" * 60]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_library(library):
    own, rnd = bpe.load(PATH), random.Random(1)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 14))) for _ in range(2000)]
    texts += ["".join(rnd.choice("abtheingon") for _ in range(rnd.randint(40, 3000))) for _ in range(60)]
    texts += [w * n for w in ("ab", "a", "theth", "!!") for n in (31, 400)]
    for t, ids in zip(texts, own.encode_many(texts)):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want, t
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_tree_of_texts(library, monkeypatch):
    rnd = random.Random(3)
    odd = [x for x in ODD if x != "x" * 60] + ["don't", "we'll ", " 12 ", "x" * 30, "           "]
    texts = ["".join(rnd.choice(odd) for _ in range(rnd.randint(0, 90))) for _ in range(300)] + ["", " " * 50, "\n \n", "'" * 40, "a'r" * 30]
    for leaf in (2, 5, 16, 64):
        monkeypatch.setattr(bpe, "LEAF", leaf)
        own = bpe.WordBpe(PATH)
        for t, ids in zip(texts, own.encode_many(texts)):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, (leaf, t)


def test_documents_are_halved(library):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()]
    assert sum(len(bpe._leaves(t)) > 2 for t in texts) > len(texts) // 4  # joins happen on ordinary documents
    for t, ids in zip(texts, bpe.load(PATH).encode_many(texts)):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


def test_regular_words(library):
    x = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    y = x.translate(str.maketrans("ab", "ba"))
    for n in (64, 1024, 2048, 4096):
        texts = [x[:n], y[:n], f"{x[:n]} {y[:n]}"]
        assert [i.tolist() for i in bpe.load(PATH).encode_many(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_start_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 16)
    own = bpe.WordBpe(PATH)
    texts = [" ".join(f"w{i}{j}x" for i in range(9)) for j in range(5)]
    assert [x.tolist() for x in own.encode_many(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_rows(spark, library):
    rows = [(1, None, 7), (None, "", 7), (2, "same text", 7), (2, "same text", 7), (3, "ab" * 40_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip_digests(df, PATH).collect()}
    want = set()
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want and bpe.round_trip_digests(df, PATH).count() == 5
    assert {r["id"]: r["text"] for r in bpe.decode(bpe.encode(df.where("doc_id = 2").limit(1), PATH), PATH).collect()} == {2: "same</w> text</w>"}
    assert bpe.round_trip_digests(df.limit(0), PATH).count() == 0


def test_plan_is_full_and_complete():
    rnd = random.Random(2)
    for cap in (7, 30, 2048):
        for _ in range(20):
            counts = {rnd.randint(1, cap): rnd.randint(1, 40) for _ in range(rnd.randint(1, 12))}
            used: dict[int, int] = {}
            for bins, combination in packing.plan(counts, cap):
                assert sum(s * t for s, t in combination) <= cap
                for s, t in combination:
                    used[s] = used.get(s, 0) + bins * t
            assert used == counts
    # The fullest rest, against all combinations.
    assert packing.fullest([9, 6, 4], {9: 1, 6: 2, 4: 3}, 14) == [(6, 1), (4, 2)]
    assert packing.fullest([5], {5: 1}, 4) == []


def test_pack(spark, library):
    rows = [(1, "word " * 3000, 1), (2, None, 1), (2, None, 1), (None, "", 1), (3, "a few words", 1), (4, "b" * 5000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(3)
    got = packing.pack(spark, df, PATH, 64).toPandas()
    assert (got["length"] <= 64).all() and len(got[got.doc_id == 2]) == 2
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 64
    ids = np.array([*library.encode(rows[0][1], add_special_tokens=False).ids, 0], "<u4")
    own = got[got.doc_id == 1].sort_values("piece")
    assert own["ids_crc32"].tolist() == [zlib.crc32(ids[a : a + 64].tobytes()) for a in range(0, len(ids), 64)]
    assert got["sequence_id"].nunique() == -(-got["length"].sum() // 64)
    assert packing.pack(spark, df.limit(0), PATH).count() == 0
