"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Document statistics are standardised and mapped to random cosines, whose inner
products approximate a Gaussian kernel.  Tasks sum up their part of the normal
equations; the driver adds a few of these sums, whose size doesn't depend on the
number of rows, and solves them.  Scores of rows set aside are calibrated by pooling
adjacent violators.
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

#: Labelled rows that the model is fitted on, at most; a fifth of them calibrates.
FIT_ROWS = 20_000
PARTS = 8
WIDTH = 256
#: Rows whose features are made at a time.
BLOCK = 64
RIDGE = 1.0
THRESHOLD = 0.7


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random cosines of each row, added up in one order: a matrix product's last bits depend on the rows beside it."""
        z, out = np.clip((x - self.mean) / self.scale, -4, 4), np.ones((len(x), WIDTH + 1))
        for lo in range(0, len(x), BLOCK):
            some = z[lo : lo + BLOCK]
            at = np.tile(self.phase, (len(some), 1))
            for k, turn in enumerate(self.omega):
                at += some[:, k : k + 1] * turn
            out[lo : lo + BLOCK, :WIDTH] = np.cos(at) * np.sqrt(2 / WIDTH)
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        return stats.row_sums(self.features(x), self.beta)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; within a step of the calibration the raw score still orders a little."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, self.knots, self.values) + 0.001 / (1 + np.exp(-np.clip(4 * raw - 2, -30, 30))), 0.0, 1.0)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the non-decreasing fit of y to raw, by pooling adjacent violators."""
    keys, at = np.unique(raw, return_inverse=True)
    total, n = np.bincount(at, y), np.bincount(at)
    blocks: list[list[float]] = []
    for k, t, c in zip(keys.tolist(), total.tolist(), n.tolist()):
        blocks.append([t, c, k, k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, c2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + c2, blocks[-1][2], hi]
    knots = [x for b in blocks for x in ((b[2], b[3]) if b[2] < b[3] else (b[2],))]
    values = [b[0] / b[1] for b in blocks for _ in range(2 if b[2] < b[3] else 1)]
    return np.array(knots), np.array(values)


def _features(own: DataFrame) -> DataFrame:
    """(y, part, x) of labelled texts; part 0 calibrates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.grouped(batches, 2):
            w = words.find(b.column(2))
            x = stats.document_features(w, words.buffers(b.column(2))[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([row.tobytes() for row in x], pa.binary())], ["y", "part", "x"])

    return own.select("y", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(5)).cast("int").alias("part"), "text").mapInArrow(run, "y int, part int, x binary")


def _sums(rows: DataFrame, f) -> list[np.ndarray]:
    """What ``f(x, y)`` gives for each task's rows, added up over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] | None = None
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64).reshape(b.num_rows, -1)
                got = f(x, b.column(0).to_numpy().astype(float))
                total = got if total is None else [p + q for p, q in zip(total, got)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([t.astype(np.float64).tobytes()], pa.binary()) for t in total], [f"s{i}" for i in range(len(total))])

    n = len(f(np.zeros((1, stats.N_DOCUMENT)), np.zeros(1)))
    parts = rows.select("y", "x").mapInArrow(run, ", ".join(f"s{i} binary" for i in range(n))).collect()  # PARTS rows
    return [sum(np.frombuffer(r[i], np.float64) for r in parts) for i in range(n)]


def fit(spark: SparkSession, own: DataFrame, seed: int = 3) -> Model | float:
    """A model from (id, y, text), or the share of label 1 where there is only one label (0.5 without rows)."""
    stage = Stage(spark, "classifier")
    rows = stage.write(_features(own).repartition(PARTS), "features")
    seen = {(r["y"], r["c"]): r["n"] for r in rows.groupBy("y", (F.col("part") == 0).alias("c")).agg(F.count("*").alias("n")).collect()}
    n = {y: sum(v for (k, _), v in seen.items() if k == y) for y in (0, 1)}
    if not n[0] or not n[1]:
        stage.drop(rows)
        return n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5
    learn = rows.where("part <> 0") if all(seen.get((y, False)) for y in (0, 1)) else rows
    one, two, m = _sums(learn, lambda x, y: [x.sum(0), (x * x).sum(0), np.array([float(len(x))])])
    mean = one / m
    scale = np.sqrt(np.maximum(two / m - mean**2, 0)) + 1e-6
    rng, dims = np.random.default_rng(seed), stats.N_DOCUMENT
    model = Model(mean, scale, rng.standard_normal((dims, WIDTH)) / np.sqrt(dims), rng.uniform(0, 2 * np.pi, WIDTH), np.zeros(WIDTH + 1), np.zeros(1), np.zeros(1))
    shared = spark.sparkContext.broadcast(model)

    def equations(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        p = shared.value.features(x)
        return [(p.T @ p).ravel(), p.T @ y]

    gram, right = _sums(learn, equations)
    model.beta = np.linalg.solve(gram.reshape(WIDTH + 1, -1) + RIDGE * np.eye(WIDTH + 1), right)
    aside = rows.where("part = 0") if seen.get((0, True)) and seen.get((1, True)) else rows
    got = aside.select("y", "x").collect()  # FIT_ROWS at most
    raw = model.raw(np.array([np.frombuffer(r["x"], np.float64) for r in got]))
    model.knots, model.values = isotonic(raw, np.array([float(r["y"]) for r in got]))
    stage.drop(rows)
    return model


def score(spark: SparkSession, docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row.

    A text is read whole, however long; a null or empty one has all statistics zero and is
    scored like others; null ids and repeated rows are rows like others; extra columns
    aren't read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    if not isinstance(model, Model):
        return own.select("doc_id", F.lit(float(model)).alias("score"))
    shared = spark.sparkContext.broadcast(model)  # WIDTH weights and at most FIT_ROWS knots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.grouped(batches, 1):
            w = words.find(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(stats.document_features(w, words.buffers(b.column(1))[1])))], ["doc_id", "score"])

    return own.mapInArrow(run, f"doc_id {kind}, score double")


def trained(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | float:
    """The model of the labelled rows that aren't held out."""
    return fit(spark, stats.labelled(docs, labels, "quality", rows, ~stats.held_out("id", 4, 2)))


def keep_good(spark: SparkSession, docs: DataFrame, model: Model | float, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns.

    All rows stay where nothing could be learnt: ``fit`` gives 0.5 without rows only, and 0
    or 1 where all labels are the same.  Null and empty texts are scored like others, and
    repeated rows stay or go together.
    """
    if not isinstance(model, Model):
        return docs if model == 0.5 or model >= threshold else docs.limit(0)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.grouped(batches, at):
            w = words.find(b.column(at))
            yield b.filter(pa.array(shared.value.score(stats.document_features(w, words.buffers(b.column(at))[1])) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document, from labels of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(spark, docs, trained(spark, docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", stats.held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
ORACLES: dict[str, str] = {}
