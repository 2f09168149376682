"""Hard negatives by one-dimensional distance keys.

Largest inner products are nearest neighbours once each row x has one more component,
sqrt(M^2 - |x|^2) with M the largest norm, and the anchor a zero there: the squared distance
is |q|^2 + M^2 - 2 q.x.  The index keeps the rows sorted by (pivot, distance to the pivot).
By the triangle inequality a row within R of an anchor has a key within R of the anchor's own
distance to that pivot, so that an anchor reads intervals of keys: first those of a small
annulus, then what is missing up to the distance of the k-th best row found, which bounds
all that wasn't read.  An anchor is done once its intervals reach that bound.

Negatives are asked for below a ceiling; rows nearer than the ceiling's distance form a ball
around the anchor whose keys are left out where a whole interval lies in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, table
from .vectors import FINITE, dimensions, matrix, sample

#: Rows that pivots are chosen from and first bounds are taken from, and pivots, at most; all rows are indexed.
SAMPLE_ROWS = 4096
PIVOTS = 32
#: Components of the anchors that one pass over the index serves, 8 MB; they are what is broadcast.
ANCHOR_VALUES = 1 << 20
#: Share of the first bound's distance that the first annulus reaches.
FIRST = 0.8
#: Targets and rows that are compared at a time.
TARGETS, ROWS = 256, 4096
#: Squared norm up to which inner products fit in longs; and up to which doubles hold them exactly.
MOST, EXACT = 2.0**62, 2.0**53
FOUND = "target long, vec_id long, score long"
_NONE = np.iinfo(np.int64).min


def relabelled(label: str = "label", vec_id: str = "vec_id", classes: int = 10) -> F.Column:
    """The label, one further where the id is divisible by 7."""
    return F.when(F.pmod(F.col(vec_id), F.lit(7)) == 0, (F.col(label) + 1) % F.lit(classes)).otherwise(F.col(label))


def prepared(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, x) of the rows that take part, components as whole numbers."""
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[label_col].cast("long").alias("label"), df[vector_col].alias("v"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL").where(FINITE.format(v="v"))
    rows = rows.where(F.expr(f"aggregate(v, 0D, (a, c) -> a + pow(floor(least(greatest(double(c), -1e12D), 1e12D) * 256D), 2)) < {MOST!r}D"))
    return rows.select("vec_id", relabelled().alias("label"), F.expr("transform(v, c -> CAST(floor(least(greatest(double(c), -1e12D), 1e12D) * 256D) AS LONG))").alias("x"))


@dataclass
class Targets:
    """What is searched for: for each target an anchor, whether of its label, scores from ``low`` to ``high``, the bound so far and the radii read."""

    anchor: np.ndarray
    same: bool
    low: np.ndarray
    high: np.ndarray
    k: int
    score: np.ndarray  # of the k-th best so far, _NONE where fewer were found
    own: np.ndarray  # its id
    done: np.ndarray  # radius up to which all was read
    radius: np.ndarray  # radius that the next pass reads

    def some(self, on: np.ndarray) -> Targets:
        return Targets(self.anchor[on], self.same, self.low[on], self.high[on], self.k, self.score[on], self.own[on], self.done[on], self.radius[on])


class Space:
    """Anchors, pivots and distances, for one pass over the index."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, pivots: np.ndarray, most: float):
        self.ids, self.labels, self.q, self.pivots, self.most = ids, labels, q, pivots, most
        self.kind = np.float64 if most <= EXACT else np.int64
        self.q2 = (q.astype(float) ** 2).sum(1)
        flat = np.append(q.astype(float), np.zeros((len(q), 1)), 1)
        self.to_pivot = distances(flat, pivots)

    def reach(self, anchor: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance of a row with such a score from its anchor."""
        return np.minimum(2 * np.sqrt(self.most), np.sqrt(np.maximum(0.0, self.q2[anchor] + self.most - 2.0 * score)))  # no row is farther than 2M

    def need(self, t: Targets) -> np.ndarray:
        """The radius within which all rows that can be among the best of a target lie."""
        return self.reach(t.anchor, np.where(t.score > _NONE, t.score, t.low)) + self.slack

    @property
    def slack(self) -> float:
        """More than rounding can do to a distance, which at worst is a root of cancelled squares."""
        return 1e-6 * (np.sqrt(self.most) + 1)


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(float)
    return np.append(x, np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))[:, None], 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to the few rows of b, without cancellation."""
    return np.stack([np.sqrt(((a - p) ** 2).sum(1)) for p in b], 1)


def spread_out(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows, each farthest from those before it."""
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def best(target: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best rows of each target, by score and then smaller id."""
    by = np.lexsort((ids, -score, target))
    target, ids, score = target[by], ids[by], score[by]
    first = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, np.int64)
    keep = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target)))) < k
    return target[keep], ids[keep], score[keep]


def look(s: Space, t: Targets, pivot: int, keys: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, score: np.ndarray, own: np.ndarray, slack: float) -> list[tuple]:
    """What rows of one pivot, in order of their keys, offer to targets in the part of their intervals that wasn't read."""
    mine = s.to_pivot[t.anchor, pivot]
    inner = s.reach(t.anchor, t.high) - slack  # rows nearer than this are above the ceiling
    lo, hi = np.maximum(mine - t.radius, inner - mine) - slack, mine + t.radius + slack
    old_lo, old_hi = mine - t.done - slack, mine + t.done + slack
    on = np.flatnonzero((hi >= keys[0]) & (lo <= keys[-1]) & ~((t.done >= 0) & (old_lo <= keys[0]) & (old_hi >= keys[-1])))
    out = []
    for at in range(0, len(on), TARGETS):
        j = on[at : at + TARGETS]
        used, which = np.unique(t.anchor[j], return_inverse=True)
        a, b = np.searchsorted(keys, lo[j].min()), np.searchsorted(keys, hi[j].max(), "right")
        if a == b:
            continue
        made = (s.q[used].astype(s.kind) @ x[a:b].astype(s.kind).T).astype(np.int64)[which]
        k = keys[None, a:b]
        good = (k >= lo[j, None]) & (k <= hi[j, None]) & ~((t.done[j, None] >= 0) & (k >= old_lo[j, None]) & (k <= old_hi[j, None]))
        good &= (labels[None, a:b] == s.labels[t.anchor[j], None]) == t.same
        good &= (ids[None, a:b] != s.ids[t.anchor[j], None]) & (made >= t.low[j, None]) & (made <= t.high[j, None])
        good &= (made > score[j, None]) | ((made == score[j, None]) & (ids[None, a:b] <= own[j, None]))
        r, c = np.nonzero(good)
        if len(r):
            found = best(j[r], ids[a:b][c], made[r, c], t.k)
            out.append(found)
    return out


def _pass(stage: Stage, index: DataFrame, space, targets, dims: int) -> DataFrame:
    """(target, vec_id, score): each task's best rows in the intervals of one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (s, slack), t = space.value, targets.value
        score, own = t.score.copy(), t.own.copy()
        held = (np.zeros(0, np.int64),) * 3
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                pivots, keys, ids, labels = (b.column(c).to_numpy() for c in ("pivot", "distance", "vec_id", "label"))
                x = matrix(b.column("x"), dims, np.int64)
                for p in np.unique(pivots):
                    part = np.flatnonzero(pivots == p)
                    part = part[np.argsort(keys[part], kind="stable")]
                    new = look(s, t, int(p), keys[part], ids[part], labels[part], x[part], score, own, slack)
                    if new:
                        held = best(*(np.concatenate(c) for c in zip(held, *new)), t.k)
                        # The k-th best so far is what rows have to beat from now on.
                        last = np.flatnonzero(np.append(held[0][1:] != held[0][:-1], True))
                        full = last[np.diff(np.append(-1, last)) == t.k]
                        score[held[0][full]], own[held[0][full]] = held[2][full], held[1][full]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], ["target", "vec_id", "score"])

    # Only keys that some anchor asks for are read: the intervals' bounds reach the scan.
    s, t = space.value[0], targets.value
    asked = F.lit(False)
    for p in range(len(s.pivots)):
        mine = s.to_pivot[t.anchor, p]
        low, high = float((np.maximum(mine - t.radius, s.reach(t.anchor, t.high) - s.slack - mine)).min() - s.slack), float((mine + t.radius).max() + s.slack)
        asked |= (F.col("pivot") == p) & F.col("distance").between(low, high)
    return stage.write(index.where(asked).mapInArrow(run, FOUND), "found")


def top(stage: Stage, index: DataFrame, s: Space, t: Targets, dims: int) -> DataFrame:
    """(target, vec_id, score, rank): the ``k`` best rows of each target; passes go on until the bound on what wasn't read certifies them."""
    spark, slack = index.sparkSession, s.slack
    shared = spark.sparkContext.broadcast((s, slack))
    tables, left = [], np.arange(len(t.anchor))
    rank = Window.partitionBy("target").orderBy(F.desc("score"), "vec_id")
    while len(left):
        sub = t.some(left)
        numbers = spark.sparkContext.broadcast(left)

        def renumbered(batches: Iterator[pa.RecordBatch], numbers=numbers) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(numbers.value[b.column(0).to_numpy()]), b.column(1), b.column(2)], ["target", "vec_id", "score"])

        made = _pass(stage, index, shared, spark.sparkContext.broadcast(sub), dims)
        tables.append(made.mapInArrow(renumbered, FOUND))
        found = tables[0]
        for more in tables[1:]:
            found = found.unionAll(more)
        found = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= t.k)
        t.done[left] = t.radius[left]
        for r in found.where(F.col("rank") == t.k).collect():  # a row for each target of this block
            if r["score"] > t.score[r["target"]] or (r["score"] == t.score[r["target"]] and r["vec_id"] < t.own[r["target"]]):
                t.score[r["target"]], t.own[r["target"]] = r["score"], r["vec_id"]
        need = s.need(t)
        left = np.flatnonzero(t.done < need)
        t.radius = np.maximum(t.radius, need)
    return found if tables else spark.createDataFrame([], FOUND + ", rank int")


def first_bounds(s: Space, labels: np.ndarray, ids: np.ndarray, x: np.ndarray, t: Targets) -> None:
    """Bounds from sampled rows, which are rows of the index, and the radii of the first annuli."""
    for at in range(0, len(t.anchor), TARGETS):
        j = slice(at, at + TARGETS)
        used, which = np.unique(t.anchor[j], return_inverse=True)
        score = (s.q[used].astype(s.kind) @ x.astype(s.kind).T).astype(np.int64)[which]
        good = ((labels[None] == s.labels[t.anchor[j], None]) == t.same) & (ids[None] != s.ids[t.anchor[j], None]) & (score >= t.low[j, None]) & (score <= t.high[j, None])
        if score.shape[1] >= t.k:
            t.score[j] = -np.partition(-np.where(good, score, _NONE + 1), t.k - 1, 1)[:, t.k - 1]
    t.score[t.score == _NONE + 1] = _NONE
    reach, inner = s.need(t), np.minimum(s.reach(t.anchor, t.high), s.need(t))
    t.radius = np.where(t.score > _NONE, inner + FIRST * (reach - inner), reach)


def _targets(anchor: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> Targets:
    n = len(anchor)
    return Targets(anchor, same, low, high, k, np.full(n, _NONE), np.full(n, np.iinfo(np.int64).max), np.full(n, -1.0), np.zeros(n))


def _mine(spark: SparkSession, stage: Stage, rows: DataFrame, every: int, dims: int, positives: int, negatives: int, shares: tuple[int, int]) -> list[DataFrame]:
    """Hard negatives of vectors of one number of dimensions, a table for each block of anchors."""
    most = float(rows.agg(F.max(F.expr("aggregate(x, 0L, (a, c) -> a + c * c)"))).first()[0])
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "x").limit(SAMPLE_ROWS).toArrow()
    some_x = matrix(some["x"], dims, np.int64)
    pivots = spread_out(augmented(some_x, most), PIVOTS)
    shared = spark.sparkContext.broadcast((pivots, most))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                d = distances(augmented(matrix(b.column(2), dims, np.int64), shared.value[1]), shared.value[0])
                p = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(p)), p])], ["vec_id", "label", "x", "pivot", "distance"])

    index = rows.mapInArrow(keyed, "vec_id long, label long, x array<long>, pivot int, distance double")
    # The id spreads rows of equal keys, such as a large group of copies.
    index = stage.write(index.repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id"), "index")
    asked = stage.write(index.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("a")).select("vec_id", "a.*"), "anchors")
    blocks, out = -(-asked.count() // max(256, ANCHOR_VALUES // dims)), []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()  # ANCHOR_VALUES components about
        if not len(own):
            continue
        s = Space(own["vec_id"].to_numpy(), own["label"].to_numpy(), matrix(own["x"], dims, np.int64), pivots, most)
        n, limit = len(s.ids), np.int64(2**62)
        t = _targets(np.arange(n), True, np.full(n, -limit), np.full(n, limit), positives)
        first_bounds(s, some["label"].to_numpy(), some["vec_id"].to_numpy(), some_x, t)
        near = top(stage, index, s, t, dims).orderBy("target", "rank").collect()  # positives of each anchor of the block
        if not near:
            continue
        anchor, pos_id, pos = (np.array([r[c] for r in near], object) for c in ("target", "vec_id", "score"))
        low, high = [-(-shares[0] * p // 100) for p in pos], [shares[1] * p // 100 for p in pos]
        keep = np.array([a <= b for a, b in zip(low, high)], bool)
        anchor, pos_id, pos = anchor[keep].astype(np.int64), pos_id[keep].astype(np.int64), pos[keep].astype(np.int64)
        t = _targets(anchor, False, np.array(low, object)[keep].astype(np.int64), np.array(high, object)[keep].astype(np.int64), negatives)
        if not len(anchor):
            continue
        first_bounds(s, some["label"].to_numpy(), some["vec_id"].to_numpy(), some_x, t)
        made = top(stage, index, s, t, dims)
        names = spark.createDataFrame([(i, int(s.ids[a]), int(p), int(v)) for i, (a, p, v) in enumerate(zip(anchor, pos_id, pos))], "target long, anchor_id long, positive_id long, positive_score long")
        made = made.join(F.broadcast(names), "target")  # a few rows for each anchor of the block
        out.append(stage.write(made.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    return out


def mine(spark: SparkSession, df: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, shares: tuple[int, int] = (30, 90), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact.

    Anchors are rows whose id is divisible by ``every``.  Its positives are the rows of its
    label with the largest inner products, its negatives for a positive the largest of other
    labels between ``shares`` hundredths of the positive's score; ties go by smaller id.
    Labels of ids divisible by 7 are one further, components are floor(256 x).

    Rows without id or label and vectors that are null, empty or not finite take no part, nor
    do those whose whole components have a norm of 2^31 or more, as their products needn't fit
    in a long.  Vectors of unlike numbers of dimensions have no inner product and are mined apart.
    Rows of a repeated id are rows of their own as positives and negatives, but not for an
    anchor of that id; of several anchor rows of one id the least asks.  Other columns aren't
    read.  Without anchors, positives or negatives there are no rows.
    """
    stage = Stage(spark, "hardneg")
    rows = stage.write(prepared(df, id_col, vector_col, label_col), "rows")
    out = [x for d in dimensions(rows, "x") for x in _mine(spark, stage, rows.where(F.size("x") == d), every, d, positives, negatives, shares)]
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionAll(more)
    return stage.finish(whole)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all rows."""
    return mine(spark, table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLES = {
    "op13_hard_negatives": """WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN pairs USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""
}
