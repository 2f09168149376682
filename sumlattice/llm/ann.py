"""Approximate nearest neighbours by score-aware quantisation and four-bit table scans.

Unit vectors are coded by a product quantiser whose loss weighs the part of the
residual that is parallel to the vector ``eta`` times as much as the rest, since
that part is what moves the inner products that matter.  A scan adds up, for each
query, one table entry per code; the best of each block are scored again on the
original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, table

#: Rows the quantiser is fitted on, at most; all rows are coded and searched.
FIT_ROWS = 8192
#: Components of the queries that one pass over the index answers, 4 MB; they are what is broadcast.
QUERY_VALUES = 1 << 19
#: Rows scanned at a time, and how many of them are scored exactly for each query at first.
SCAN_ROWS = 4096
RERANK = 128
CENTRES = 16


def eta(dims: int, threshold: float = 0.2) -> float:
    """Weight of the parallel residual for inner products above ``threshold`` of the norm."""
    return max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))


def split(dims: int, width: int = 2) -> list[tuple[int, int]]:
    return [(at, min(at + width, dims)) for at in range(0, dims, width)]


def encode(x: np.ndarray, books: list[np.ndarray], weight: float, sweeps: int = 2) -> np.ndarray:
    """Codes of unit vectors by coordinate descent on the anisotropic loss."""
    cuts, n = split(x.shape[1]), len(x)
    codes = np.empty((n, len(cuts)), np.uint8)
    parallel = np.zeros(n)
    for m, (a, b) in enumerate(cuts):
        codes[:, m] = ((x[:, a:b, None] - books[m].T[None]) ** 2).sum(1).argmin(1)
        parallel += ((x[:, a:b] - books[m][codes[:, m]]) * x[:, a:b]).sum(1)
    for _ in range(sweeps):
        for m, (a, b) in enumerate(cuts):
            part, book = x[:, a:b], books[m]
            own = (part**2).sum(1)[:, None] - part @ book.T  # parallel residual of each centre
            rest = parallel - own[np.arange(n), codes[:, m]]
            loss = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)[None] + (weight - 1) * (rest[:, None] + own) ** 2
            codes[:, m] = loss.argmin(1)
            parallel = rest + own[np.arange(n), codes[:, m]]
    return codes


def fit(x: np.ndarray, rounds: int = 6, seed: int = 7) -> list[np.ndarray]:
    """Codebooks for unit vectors: plain k-means first, then weighted least squares per centre."""
    rng, weight, books = np.random.default_rng(seed), eta(x.shape[1]), []
    for a, b in split(x.shape[1]):
        part = x[:, a:b]
        centres = part[rng.choice(len(part), CENTRES, replace=len(part) < CENTRES)] + 1e-9 * rng.standard_normal((CENTRES, b - a))
        for _ in range(rounds):
            own = ((part[:, :, None] - centres.T[None]) ** 2).sum(1).argmin(1)
            for k in range(CENTRES):
                if (own == k).any():
                    centres[k] = part[own == k].mean(0)
        books.append(centres)
    for _ in range(3):
        codes = encode(x, books, weight, 1)
        recon = np.concatenate([books[m][codes[:, m]] for m in range(len(books))], 1)
        total = ((x - recon) * x).sum(1)
        for m, (a, b) in enumerate(split(x.shape[1])):
            part = x[:, a:b]
            rest = total - ((part - books[m][codes[:, m]]) * part).sum(1)
            for k in range(CENTRES):
                i = np.flatnonzero(codes[:, m] == k)
                if len(i):
                    p = part[i]
                    left = len(i) * np.eye(b - a) + (weight - 1) * p.T @ p
                    books[m][k] = np.linalg.solve(left, p.sum(0) + (weight - 1) * ((rest[i] + (p**2).sum(1))[:, None] * p).sum(0))
            total = rest + ((part - books[m][codes[:, m]]) * part).sum(1)
    return books


def scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(queries, rows) sums of table entries; neighbouring four-bit codes share a table of 256."""
    out = np.zeros((tables.shape[0], len(codes)), np.float32)
    for m in range(0, codes.shape[1], 2):
        if m + 1 < codes.shape[1]:
            both = (tables[:, m, :, None] + tables[:, m + 1, None, :]).reshape(len(tables), -1)
            out += both[:, codes[:, m].astype(np.int64) * CENTRES + codes[:, m + 1]]
        else:
            out += tables[:, m][:, codes[:, m]]
    return out


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles."""
    v = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    good = "forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x != 0)"
    return v.where(good)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def best_of(q: np.ndarray, qid: np.ndarray, rough: np.ndarray, ids: np.ndarray, unit: np.ndarray, k: int, rerank: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best (scores, ids) of each query among rows in ascending order of id.

    The ``rerank`` rows of best rough scores are scored exactly.  Where one of the later half
    of them is among the ``k`` best, and above ``least``, the rough order doesn't settle that
    query and twice as many are scored, up to all rows.  Equal rough scores go by id.
    """
    n, todo = len(ids), np.arange(len(q))
    best, own = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    take = min(n, max(rerank, 1))
    while len(todo):
        unsettled = []
        step = max(1, 256 * 128 // take)  # so that gathered vectors stay as many
        for some in (todo[at : at + step] for at in range(0, len(todo), step)):
            near = np.argpartition(-rough[some], take - 1, 1)[:, :take]
            near = np.take_along_axis(near, np.lexsort((near, -np.take_along_axis(rough[some], near, 1)), 1), 1)
            score = np.einsum("qd,qnd->qn", q[some], unit[near])
            score[ids[near] == qid[some, None]] = -np.inf
            by = np.lexsort((ids[near], -score), 1)[:, :k]
            s = np.take_along_axis(score, by, 1)
            best[some, : s.shape[1]], own[some, : s.shape[1]] = s, np.take_along_axis(ids[near], by, 1)
            unsettled.append(some[((by >= take // 2) & (s >= least[some, None]) & np.isfinite(s)).any(1)])
        todo = np.concatenate(unsettled) if take < n else todo[:0]
        take = min(n, 2 * take)
    return best, own


def search(spark: SparkSession, df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """The ``k`` nearest found of each query by cosine: query_id, rank, vec_id, score.

    ``queries`` has rows of the same columns; a query's own id is no candidate; of several
    query rows of one id the least vector asks.  Vectors that are null, zero, not finite or
    without id take no part; those of unlike numbers of dimensions, which have no cosine,
    are tables of their own, searched one after another.  Equal scores go by the smaller id;
    of equal vectors a block keeps the k + 1 smallest ids, which no other could displace.
    ``rerank`` of SCAN_ROWS or more scores all rows exactly.  Extra columns aren't read.
    Without usable vectors or queries the result is empty.
    """
    stage = Stage(spark, "ann")
    every, asking = usable(df, id_col, vector_col), usable(queries, id_col, vector_col)
    sizes = [r["d"] for r in asking.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    found = [x for dims in sizes for x in _search(spark, stage, every.where(F.size("v") == dims), asking.where(F.size("v") == dims), dims, k, rerank)]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = found[0]
    for x in found[1:]:
        best = best.unionAll(x)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return stage.finish(best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def _search(spark: SparkSession, stage: Stage, rows: DataFrame, asking: DataFrame, dims: int, k: int, rerank: int) -> list[DataFrame]:
    """What each task of each pass found, for vectors of ``dims`` dimensions."""
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).collect()])
    if not len(sample):
        return []
    books, weight = fit(_unit(sample)), eta(dims)
    shared = spark.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SCAN_ROWS):
                b = whole.slice(at, SCAN_ROWS)
                codes = encode(_unit(_matrix(b.column(1), dims)), shared.value, weight)
                padded = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
                packed = padded[:, ::2] << 4 | padded[:, 1::2]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([row.tobytes() for row in packed], pa.binary())], ["vec_id", "v", "codes"])

    index = stage.write(rows.mapInArrow(code, "vec_id long, v array<double>, codes binary"), "index")
    asked = stage.write(asking.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks, found = -(-asked.count() // max(256, QUERY_VALUES // dims)), []
    for block in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()  # QUERY_VALUES components about
        if some:
            found.append(stage.write(_pass(spark, index, np.array([r["vec_id"] for r in some]), _unit(np.array([r["v"] for r in some])), shared, dims, k, rerank), "block"))
    return found


def _pass(spark: SparkSession, index: DataFrame, ids: np.ndarray, unit: np.ndarray, shared, dims: int, k: int, rerank: int) -> DataFrame:
    """The best of each task of the index for one block of queries."""
    asked = spark.sparkContext.broadcast((ids, unit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = asked.value
        books, cuts = shared.value, split(dims)
        tables = np.zeros((len(q), len(cuts), CENTRES), np.float32)
        for m, (a, b) in enumerate(cuts):
            tables[:, m] = q[:, a:b] @ books[m].T
        top_score = np.full((len(q), k), -np.inf)
        top_id = np.full((len(q), k), np.iinfo(np.int64).max)
        for whole in batches:
            for at in range(0, whole.num_rows, SCAN_ROWS):
                b = whole.slice(at, SCAN_ROWS)
                ids, x = b.column(0).to_numpy(), _matrix(b.column(1), dims)
                packed = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
                order = np.argsort(ids, kind="stable")
                ids, x, packed = ids[order], x[order], packed[order]
                _, same, n = np.unique(np.ascontiguousarray(x).view([("", np.float64)] * dims).ravel(), return_inverse=True, return_counts=True)
                if n.max() > k + 1:
                    by = np.argsort(same, kind="stable")
                    nth = np.arange(len(by)) - np.repeat(np.cumsum(n) - n, n)
                    keep = np.sort(by[nth <= k])
                    ids, x, packed = ids[keep], x[keep], packed[keep]
                codes = np.stack([packed >> 4, packed & 15], 2).reshape(len(ids), -1)[:, : len(cuts)]
                unit = _unit(x)
                for lo in range(0, len(q), 256):
                    part = slice(lo, lo + 256)
                    rough = scan(tables[part], codes)
                    rough[qid[part, None] == ids[None]] = -np.inf
                    score, own = best_of(q[part], qid[part], rough, ids, unit, k, rerank, top_score[part, -1])
                    s, i = np.concatenate([top_score[part], score], 1), np.concatenate([top_id[part], own], 1)
                    by = np.lexsort((i, -s), 1)[:, :k]
                    top_score[part], top_id[part] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)
        there = np.isfinite(top_score)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, there.sum(1))), pa.array(top_id[there]), pa.array(top_score[there])], ["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth vector against all rows."""
    df = table(spark, sf_dir, "embeddings")
    return search(spark, df, df.where("vec_id % 50 = 0"))


QUERIES = {"op6_nearest_neighbours": op6_nearest_neighbours}
ORACLES: dict[str, str] = {}
