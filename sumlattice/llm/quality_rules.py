"""Quality rules with a line model: a linear-chain conditional random field.

Every line with a word is content or boilerplate.  The field's emission weights look
at the line's characters and words and whether it repeats, its transition weights at
neighbouring lines; Viterbi decoding finds the likeliest labels, and the share of
characters in content lines decides whether a document stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stats, words
from .common import Stage, table

#: Labelled documents that the field is fitted on, at most; their lines in a chain, and their chains, at most.
FIT_DOCUMENTS = 3000
FIT_LINES = 256
FIT_CHAINS = 4000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_CONTENT = 0.5


@dataclass
class Field:
    """Weights: ``emission`` scores content against boilerplate, ``step[i, j]`` a change from i to j."""

    mean: np.ndarray
    scale: np.ndarray
    emission: np.ndarray
    step: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.append(np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -5, 5), 1) @ self.emission


#: Where there are no labels: every line is content.
NEUTRAL = Field(np.zeros(stats.N_SHARES + 1), np.ones(stats.N_SHARES + 1), np.append(1.0, np.zeros(stats.N_SHARES + 1)), np.zeros((2, 2)))


def _padded(values: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of each group as a row, and the groups' sizes; ``group`` ascends."""
    n = np.bincount(group, minlength=n_groups)
    out = np.zeros((n_groups, max(1, n.max(initial=0))))
    out[group, np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out, n


def _alike(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(groups, their members' places, each member's group in this set) of groups whose sizes ``n`` are alike.

    Sizes of one set differ by a factor of two at most, so that padding at most doubles the work.
    """
    begin, level = np.cumsum(n) - n, np.ceil(np.log2(np.maximum(n, 1)))
    for v in np.unique(level[n > 0]):
        own = np.flatnonzero((level == v) & (n > 0))
        row = np.repeat(np.arange(len(own)), n[own])
        first = np.cumsum(n[own]) - n[own]
        yield own, begin[own][row] + np.arange(len(row)) - first[row], row


def viterbi(score: np.ndarray, n: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Likeliest labels of each row of content scores, ``n`` of them; ties go to content."""
    rows, width = score.shape
    labels = np.zeros((rows, width), np.int8)
    back = np.zeros((rows, width, 2), np.int8)
    a0, a1 = np.zeros(rows), score[:, 0].copy()
    end0, end1 = a0.copy(), a1.copy()
    for t in range(1, width):
        from0, from1 = np.stack([a0 + step[0, 0], a1 + step[1, 0]]), np.stack([a0 + step[0, 1], a1 + step[1, 1]])
        back[:, t, 0], back[:, t, 1] = from0[1] >= from0[0], from1[1] >= from1[0]
        a0, a1 = from0.max(0), from1.max(0) + score[:, t]
        live = t < n
        end0[live], end1[live] = a0[live], a1[live]
    now = (end1 >= end0).astype(np.int8)
    for t in range(width - 1, -1, -1):
        live = t < n
        labels[live, t] = now[live]
        if t:
            now = np.where(live, back[np.arange(rows), t, now], now)
    return labels


def _expected(score: np.ndarray, n: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of content at each place and expected changes, by forward and backward sums."""
    rows, width = score.shape
    fore, aft = np.zeros((rows, width, 2)), np.zeros((rows, width, 2))
    fore[:, 0, 1] = score[:, 0]
    for t in range(1, width):
        x = fore[:, t - 1, :, None] + step[None]
        fore[:, t] = np.logaddexp(x[:, 0], x[:, 1])
        fore[:, t, 1] += score[:, t]
    for t in range(width - 2, -1, -1):
        nxt = aft[:, t + 1].copy()
        nxt[:, 1] += score[:, t + 1]
        x = step[None] + nxt[:, None, :]
        aft[:, t] = np.where((t + 1 < n)[:, None], np.logaddexp(x[:, :, 0], x[:, :, 1]), 0.0)
    both = fore + aft
    at = np.arange(width)[None] < n[:, None]
    total = np.logaddexp(both[..., 0], both[..., 1])
    content = np.where(at, np.exp(both[..., 1] - total), 0.0)
    changes = np.zeros((2, 2))
    if width > 1:
        pair = at[:, 1:]
        for i in range(2):
            for j in range(2):
                x = fore[:, :-1, i] + step[i, j] + score[:, 1:] * j + aft[:, 1:, j] - total[:, :-1]
                changes[i, j] = np.exp(x[pair]).sum()
    return content, changes


def fit(doc: np.ndarray, x: np.ndarray, y: np.ndarray, rounds: int = 120) -> Field:
    """A field from lines (chain, features) and the labels of their documents; ``doc`` ascends.

    Lines take their document's label at first.  A model without transitions then
    relabels lines of rejected documents that look like content, so that the field
    learns lines, not documents.
    """
    mean, scale = x.mean(0), x.std(0) + 1e-6
    _, group = np.unique(doc, return_inverse=True)
    z = np.append(np.ones((len(x), 1)), np.clip((x - mean) / scale, -5, 5), 1)
    target = y.astype(float)
    # Rejected lines are few; both kinds get the same say.
    weight = np.where(y == 1, 0.5 / max(target.mean(), 1e-3), 0.5 / max(1 - target.mean(), 1e-3))
    emission = np.zeros(z.shape[1])
    for _ in range(25):  # Newton steps of a weighted logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ emission, -30, 30)))
        g = z.T @ (weight * (target - p)) - 0.5 * emission
        h = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + 0.5 * np.eye(len(emission))
        emission = emission + np.linalg.solve(h, g)
    target = np.where((y == 0) & (z @ emission > 0), 1.0, target)
    step = np.zeros((2, 2))
    sets = [*_alike(np.bincount(group))]
    pair = group[1:] == group[:-1]
    a, b = target[:-1][pair], target[1:][pair]
    seen = np.array([[((1 - a) * (1 - b)).sum(), ((1 - a) * b).sum()], [(a * (1 - b)).sum(), (a * b).sum()]])
    m, v = np.zeros(len(emission) + 4), np.zeros(len(emission) + 4)
    for i in range(1, rounds + 1):  # Adam on the likelihood
        score, content, changes = z @ emission, np.zeros(len(z)), np.zeros((2, 2))
        for own, line, row in sets:
            wide, n = _padded(score[line], row, len(own))
            chance, moves = _expected(wide, n, step)
            content[line] = chance[np.arange(wide.shape[1])[None] < n[:, None]]
            changes += moves
        grad = np.append(z.T @ (target - content) - 0.5 * emission, (seen - changes).ravel() - 0.5 * step.ravel()) / len(z)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        emission, step = emission + move[:-4], step + move[-4:].reshape(2, 2)
    return Field(mean, scale, emission, step)


def _lines(batch: pa.RecordBatch, column: int) -> tuple[words.Words, np.ndarray, np.ndarray, np.ndarray, list[list[bool]]]:
    w = words.find(batch.column(column))
    _, bound = words.buffers(batch.column(column))
    data = w.data.tobytes()
    dup = [stats.duplicate_lines(data[bound[i] : bound[i + 1]]) for i in range(len(w))]
    doc, chars, x = stats.line_features(w, bound)
    return w, doc, chars, np.append(x, np.array([d for ds in dup for d in ds], float).reshape(-1, 1), 1), dup


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_DOCUMENTS) -> Field:
    """The field fitted on at most ``rows`` documents labelled for quality; NEUTRAL without both labels.

    A document of more than FIT_LINES lines is several chains.  FIT_CHAINS of all chains, drawn
    by a hash of their features, are what the driver holds and fits on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.grouped(batches, 1):
            _, doc, _, x, _ = _lines(b, 1)
            y = b.column(0).to_numpy()[doc]
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
            ends = [*first[1:].tolist(), len(doc)]
            for lo, hi in ((at, min(at + FIT_LINES, end)) for begin, end in zip(first.tolist(), ends) for at in range(begin, end, FIT_LINES)):
                yield pa.RecordBatch.from_arrays([pa.array([int(y[lo])], pa.int32()), pa.array([x[lo:hi].astype(np.float32).tobytes()], pa.binary())], ["y", "x"])

    own = stats.labelled(docs, labels, "quality", rows, id_col=id_col, text_col=text_col)
    chains = own.select("y", "text").mapInArrow(run, "y int, x binary")
    found = sorted((r["y"], bytes(r["x"])) for r in chains.orderBy(F.xxhash64("x"), "y").limit(FIT_CHAINS).collect())
    if len({y for y, _ in found}) < 2:
        return NEUTRAL
    parts = [np.frombuffer(x, np.float32).reshape(-1, stats.N_SHARES + 1).astype(float) for _, x in found]
    n = [len(p) for p in parts]
    return fit(np.repeat(np.arange(len(parts)), n), np.concatenate(parts), np.repeat([y for y, _ in found], n))


def judge(spark: SparkSession, docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", min_content: float = MIN_CONTENT) -> DataFrame:
    """Counts, base verdict, content share and verdict of every row.

    A null or empty text has no words and fails the base rules; its content share is 0.
    Null ids and repeated rows are rows like others; extra columns aren't read; an
    empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(field)  # a few dozen weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.grouped(batches, 1):
            w, doc, chars, x, dup = _lines(b, 1)
            _, bound = words.buffers(b.column(1))
            n = np.diff(w.bound)
            word_chars = stats.count(~stats.CONTINUATION[w.data] & ~stats.SPACE[w.data], bound)
            again = np.array([stats.repeated(w.of(i)) for i in range(len(w))], np.int64)
            failed = (n < MIN_WORDS) | (100 * again > MAX_REPEAT_PERCENT * n)
            good = np.zeros(len(w))
            if len(doc):
                size = np.bincount(doc, minlength=len(w))
                score = shared.value.scores(x)
                for own, line, row in _alike(size):  # rows of like length together, so that one long text doesn't widen all
                    wide, m = _padded(score[line], row, len(own))
                    label = viterbi(wide, m, shared.value.step)
                    good[own] = np.bincount(row, chars[line] * label[np.arange(wide.shape[1])[None] < m[:, None]], len(own))
            share = good / np.maximum(word_chars, 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(v.astype(np.int64)) for v in (n, word_chars, stats.count(stats.SYMBOL[w.data], bound), np.array([sum(d) for d in dup]), again)), pa.array(failed), pa.array(~failed & (share >= min_content)), pa.array(share)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"],
            )

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document, by the labels of its lines."""
    docs = table(spark, sf_dir, "documents")
    return judge(spark, docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op5_line_quality": op5_line_quality}
ORACLES: dict[str, str] = {}
