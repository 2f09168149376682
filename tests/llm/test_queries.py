"""Registered queries on the smallest tables, against what their results have to be."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sumlattice.llm import registry

SF = "/root/testdata/sf0.001"
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def encoded(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation(), tokenizer.no_padding()
    return tokenizer, {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in docs.items()}


def run(spark, name, types, at=SF):
    got = registry.queries()[name](spark, at)
    assert [(c, t) for c, t in got.dtypes if c in types] == [*types.items()]
    return got.select(*types).collect()


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in registry.queries()) == [*range(1, 14)]


@pytest.mark.parametrize("name,mod,rest", [("op4_toxicity", 3, 1), ("op7_quality_classifier", 4, 2)])
def test_scores(spark, name, mod, rest):
    """On the next larger tables: the smallest ones have some ten toxic documents, from which nothing is learnt."""
    at = "/root/testdata/sf0.01"
    got = run(spark, name, {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}, at)
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id").collect())
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    column = "toxic" if mod == 3 else "quality"
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert len(pos) > 10 < len(neg)
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) > 0.8 * len(pos) * len(neg)


def test_line_quality(spark, docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = run(spark, "op5_line_quality", {"doc_id": "bigint", **{c: "bigint" for c in names}, "base_failed": "boolean", "kept": "boolean"})
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        text = docs[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = Counter(x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
        grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
        assert tuple(r[c] for c in names) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(n - 1 for n in lines.values()), len(covered))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (r["base_failed"] and r["kept"])


def test_personal_data(spark, docs):
    """Base spans by other expressions: their digest, and that the method's spans only add to them."""
    got = run(spark, "op3_pii_spans", {"doc_id": "bigint", **{f"n_{k}": "bigint" for k in ("email", "ip", "card", "phone")}, "base_sha256": "string", "spans": "string"})
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(d := re.sub("[^0-9]", "", x)) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(re.sub("[^0-9]", "", x)) <= 15),
    }
    for r in got:
        found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, (pattern, good)) in enumerate(kinds.items()) for m in re.finditer(pattern, docs[r["doc_id"]]) if good(m[0])]
        assert r["base_sha256"] == sha(",".join(s for *_, s in sorted(found))) and {s for *_, s in found} <= {*r["spans"].split(",")}
        assert tuple(r[f"n_{kind}"] for kind in kinds) == tuple(sum(k == i for _, k, _ in found) for i in range(4))
    assert len(got) == len(docs) and any(r["spans"] for r in got)


def test_nearest_neighbours(spark):
    got = run(spark, "op6_nearest_neighbours", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"})
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    asked = {i for i in rows if i % 50 == 0}
    assert {(r["query_id"], r["rank"]) for r in got} == {(q, k) for q in asked for k in range(1, 6)}
    hits = 0
    for q in asked:
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        s = x @ (rows[q] / np.linalg.norm(rows[q]))
        assert all(r["score"] == pytest.approx(s[np.searchsorted(ids, r["vec_id"])], abs=1e-12) and r["vec_id"] != q for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        hits += len({r["vec_id"] for r in own} & {int(i) for i in ids[np.lexsort((ids, -np.where(ids == q, -9, s)))[:5]]})
    assert hits >= 0.9 * 5 * len(asked)


def test_encoding(spark, docs, encoded):
    tokenizer, ids = encoded
    got = run(spark, "op8_bpe_round_trip", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    want = {(i, len(x), sha(np.array(x, "<u4").tobytes()), sha(tokenizer.decode(x, skip_special_tokens=False))) for i, x in ids.items()}
    assert {tuple(r) for r in got} == want and len(got) == len(docs)


def test_packing(spark, docs, encoded):
    got = run(spark, "op9_best_fit_packing", {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"})
    want = set()
    for i, x in encoded[1].items():
        x = [*x, 0]
        want |= {(i, k, at, len(x[at : at + 2048]), zlib.crc32(np.array(x[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(x), 2048))}
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.02 * sum(r["length"] for r in got) / 2048 + 1
