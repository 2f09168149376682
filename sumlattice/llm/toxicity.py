"""Toxicity: Levenshtein automata intersected with a lexicon trie, scored in context.

The lexicon is learnt: words, and stems of words, that mark toxic documents.  All its
terms stand in one trie; a word is run through the product of the trie with the
automaton that allows one edit, whose states are made as words ask for them.  A hit
counts by its term's weight, apart for exact and misspelled ones, and apart for
contexts of quotation and of speech to someone; a logistic regression weighs these.
Which terms may be misspelled is measured: words one edit away must be rare in clean texts.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stats, words
from .common import Stage, table

#: Labelled rows that lexicon and weights are learnt from, at most.
FIT_ROWS = 20_000
#: The least log ratio of a term's rates in toxic and other texts, for the term and for its misspellings.
LEAST_WEIGHT = 2.5
#: Lengths of stems.
STEMS = (4, 5, 6, 7, 8)
WINDOW = 8
THRESHOLD = 0.7
CACHE_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")
#: Words that report what others say, and words that address someone.
_REPORT = frozenset("said says say called calls wrote writes quote quoted quotes word words term slur reported alleged dit disait sagte schrieb dijo escribió llamó".split())
_ADDRESS = frozenset("you your yours you're youre u ur du dein deine ihr tu toi vous votre tú te usted eres".split())
_QUOTES = re.compile('["“”„«»]')


class Automaton:
    """The lexicon's trie and the one-edit automaton, as a deterministic automaton made on demand."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], fuzzy: frozenset[str] | None = None):
        """Words of ``fuzzy`` (all, if None) may be misspelled."""
        self.child: list[dict[str, int]] = [{}]
        self.term: dict[int, tuple[float, bool]] = {}
        self.stem: dict[int, float] = {}
        loose = {t for t in terms if fuzzy is None or t in fuzzy}
        self.name: dict[int, str] = {}
        for t, w in terms.items():
            n = self._node(t)
            self.term[n], self.name[n] = (w, t in loose), t
        for t, w in stems.items():
            self.stem[self._node(t)] = w
        # Nodes below which some term may be misspelled; elsewhere an edit leads nowhere.
        self.fuzzy = {0}
        for t in loose:
            n = 0
            for c in t:
                n = self.child[n][c]
                self.fuzzy.add(n)
        self.state: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.accept: list[tuple[float, int] | None] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._close({(0, 0)}))

    def _node(self, text: str) -> int:
        n = 0
        for c in text:
            if c not in self.child[n]:
                self.child[n][c] = len(self.child)
                self.child.append({})
            n = self.child[n][c]
        return n

    def _close(self, items: set) -> frozenset:
        """Add what leaving out one letter of a term reaches, and stems that are complete."""
        out = set(items)
        for n, e in items:
            if n < 0:
                continue
            if e == 0:
                out.update((k, 1) for k in self.child[n].values() if k in self.fuzzy and (k, 0) not in out)
                if n in self.stem:
                    out.add((-1, self.stem[n]))
        best = max((w for n, w in out if n < 0), default=None)
        return frozenset(x for x in out if x[0] >= 0 or x[1] == best)

    def _state(self, items: frozenset) -> int:
        if items not in self.state:
            self.state[items] = len(self.sets)
            self.sets.append(items)
            self.next.append({})
            found = []
            for n, e in items:
                if n < 0:
                    found.append((e, 0))
                elif n in self.term and (e == 0 or self.term[n][1]):
                    found.append((self.term[n][0], e))
            self.accept.append(max(found, key=lambda x: (-x[1], x[0])) if found else None)
        return self.state[items]

    def _step(self, s: int, c: str) -> int:
        out: set = set()
        for n, e in self.sets[s]:
            if n < 0:
                out.add((n, e))
                continue
            k = self.child[n].get(c)
            if k is not None and (e == 0 or k in self.fuzzy):
                out.add((k, e))
            if e == 0:
                if n in self.fuzzy:
                    out.add((n, 1))  # a letter too many
                out.update((x, 1) for y, x in self.child[n].items() if y != c and x in self.fuzzy)  # another letter
        to = self.next[s][c] = self._state(self._close(out)) if out else self.dead
        return to

    def _end(self, word: str) -> int:
        s, nxt, dead = self.start, self.next, self.dead
        for c in word:
            to = nxt[s].get(c)
            s = to if to is not None else self._step(s, c)
            if s == dead:
                break
        return s

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the best term that the word is, a term with one edit, or a stem's word."""
        return self.accept[self._end(word)]

    def near(self, word: str) -> list[str]:
        """All terms that the word misspells, none if it is a term or a stem's word itself."""
        s = self._end(word)
        best = self.accept[s]
        if best is None or best[1] == 0:
            return []
        return [self.name[n] for n, e in self.sets[s] if e == 1 and n in self.term and self.term[n][1]]


@dataclass
class Model:
    terms: dict[str, float]
    stems: dict[str, float]
    fuzzy: frozenset[str]
    weights: np.ndarray


N_FEATURES = 10


class Scanner:
    """Features of texts for one lexicon; kept by a worker while it lasts."""

    def __init__(self, model: Model):
        self.automaton, self.known = Automaton(model.terms, model.stems, model.fuzzy), {}

    def features(self, text: str) -> list[float]:
        low = text.lower()
        found = _WORD.findall(low)
        known, match = self.known, self.automaton.match
        new = set(found).difference(known)
        if new:
            if len(known) > CACHE_WORDS:
                known.clear()
                new = set(found)
            for w in new:
                known[w] = match(w)
        hits = [(i, h) for i, w in enumerate(found) if (h := known[w])]
        out = [1.0] + [0.0] * (N_FEATURES - 1)
        if not hits:
            return out
        # Words between quotation marks, by how many marks stand before them.
        marks = [m.start() for m in _QUOTES.finditer(low)]
        begins = [m.start() for m in _WORD.finditer(low)] if marks else []
        inside = np.searchsorted(marks, [begins[i] for i, _ in hits]) % 2 == 1 if marks else [False] * len(hits)
        for (i, (weight, edits)), within in zip(hits, inside):
            near = found[max(0, i - WINDOW) : i + WINDOW + 1]
            quoted = bool(within) or not _REPORT.isdisjoint(near)
            out[1 + edits] += 0.0 if quoted else weight
            out[3 + edits] += weight if quoted else 0.0
            out[5] += weight * (not _ADDRESS.isdisjoint(near))
            out[6] = max(out[6], weight if not edits else 0.0)
            out[7] = max(out[7], weight if edits else 0.0)
        out[8] = sum(1 for _, h in hits if not h[1])
        out[9] = 100 * len(hits) / len(found)
        return [out[0], *(float(np.log1p(x)) for x in out[1:])]


_SCANNERS: dict[str, Scanner] = {}


def _scanner(key: str, model: Model) -> Scanner:
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(model)
    return _SCANNERS[key]


def _terms_of(text: str) -> set[str]:
    found = set(_WORD.findall(text.lower()))
    return found | {w[:k] + "*" for w in found for k in STEMS if len(w) >= k}


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n1, n0) from (y, text): texts of either label with the term, counted by batch."""
    for b in words.grouped(batches, 1, 1 << 20):
        n: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n[y].update(_terms_of(text or ""))
        terms = [*(n[0] | n[1])]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([n[1][t] for t in terms], pa.int64()), pa.array([n[0][t] for t in terms], pa.int64())], ["term", "n1", "n0"])


def _collisions(spark: SparkSession, counted: DataFrame, model: Model) -> dict[str, int]:
    """Texts of label 0 by the term that some word of theirs would misspell, a text once for each such word."""
    shared = spark.sparkContext.broadcast(model)  # a lexicon of FIT_ROWS texts at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value.terms, shared.value.stems)
        for b in batches:
            n: Counter[str] = Counter()
            for word, n0 in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for t in automaton.near(word):
                    n[t] += n0
            yield pa.RecordBatch.from_arrays([pa.array([*n], pa.string()), pa.array([*n.values()], pa.int64())], ["term", "n0"])

    clean = counted.where("n0 > 0 AND term NOT LIKE '%*'").select("term", "n0")
    return {r["term"]: r["n0"] for r in clean.mapInArrow(run, "term string, n0 long").groupBy("term").agg(F.sum("n0").alias("n0")).collect()}


def learn(spark: SparkSession, own: DataFrame, least: int = 5) -> Model | float:
    """Lexicon and weights from (id, y, text), or the share of label 1 where there is only one label (0 without rows).

    Near copies count once, by their least shingle, so that a copied text's own words
    don't become terms.
    """
    stage = Stage(spark, "toxicity")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.grouped(batches, 1):
            w = words.find(b.column(1), lower=True)
            low = [int(s[0]) if len(s := words.shingle_set(w.of(i), 3)) else 0 for i in range(len(w))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(low, np.uint64).view(np.int64))], ["y", "text", "low"])

    rows = stage.write(own.select("y", "text").mapInArrow(sketch, "y int, text string, low long").groupBy("low", "y").agg(F.min("text").alias("text")), "rows")
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return float(n.get(1, 0) > 0)

    counted = stage.write(rows.select("y", "text").mapInArrow(_counts, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "terms")
    # What is in toxic texts, but not in most of them, and hardly elsewhere.
    lean = F.log((F.col("n1") + 0.5) / (n[1] + 1)) - F.log((F.col("n0") + 0.5) / (n[0] + 1))
    known = counted.where((F.col("n1") >= least) & (F.col("n1") <= 0.8 * n[1]) & (F.col("n0") * n[1] < 0.2 * F.col("n1") * n[0])).withColumn("lean", lean).where(F.col("lean") >= LEAST_WEIGHT)
    seen, weight = {}, {}
    for r in known.collect():  # words of FIT_ROWS texts at most
        seen[r["term"]], weight[r["term"]] = r["n1"], r["lean"]
    model = Model({t: w for t, w in weight.items() if t[-1] != "*"}, {t[:-1]: w for t, w in weight.items() if t[-1] == "*"}, frozenset(), np.zeros(N_FEATURES))
    # A word that a stem of its own rate covers adds nothing, and a stem of one frequent word claims too much.
    model.stems = {s: w for s, w in model.stems.items() if seen[s + "*"] > 1.5 * max((seen.get(t, 0) for t in model.terms if t.startswith(s)), default=0)}
    # A term may be misspelled if words like it are as much rarer in clean texts as the term itself must be.
    met = _collisions(spark, counted, model)
    model.fuzzy = frozenset(t for t in model.terms if (met.get(t, 0) + 1) * (n[1] + 1) * np.exp(LEAST_WEIGHT) <= seen[t] * (n[0] + 1))
    x, y = [], []
    for r in _scan(spark, rows, model).collect():  # FIT_ROWS at most
        x.append(r["x"]), y.append(r["y"])
    model.weights = _logistic(np.array(x), np.array(y, float))
    return model


def _scan(spark: SparkSession, rows: DataFrame, model: Model) -> DataFrame:
    shared = spark.sparkContext.broadcast(model)  # a lexicon of FIT_ROWS texts at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scanner = Scanner(m)
        for b in words.grouped(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scanner.features(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["y", "x"])

    return rows.select("y", "text").mapInArrow(run, "y int, x array<double>")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        size = np.abs(step).max()
        w = w + step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w


def score(spark: SparkSession, docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row.

    A text is read whole, however long; a null or empty one has no hits and is scored
    so; null ids and repeated rows are
    rows like others; extra columns aren't read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    if not isinstance(model, Model):
        return own.select("doc_id", F.lit(float(model)).alias("score"))
    shared = spark.sparkContext.broadcast(model)  # a lexicon of FIT_ROWS texts at most
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scanner = _scanner(key, m)
        for b in words.grouped(batches, 1):
            x = np.array([scanner.features(t or "") for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(x @ m.weights, -30, 30))))], ["doc_id", "score"])

    return own.mapInArrow(run, f"doc_id {kind}, score double")


def trained(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | float:
    """The model of the labelled rows that aren't held out."""
    return learn(spark, stats.labelled(docs, labels, "toxic", rows, ~stats.held_out("id", 3, 1)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document, from labels of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(spark, docs, trained(spark, docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", stats.held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
