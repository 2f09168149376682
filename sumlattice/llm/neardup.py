"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A unit vector o is turned by a random rotation P and keeps the signs of Po, its code c (unit
length too), and f = <c, Po>.  For another vector q, <c, Pq> / f estimates <o, q> without
bias, within sqrt((1 - f^2) / f^2) / sqrt(D - 1) times a normal deviate.  Pq is rounded to
four bits, with a dither that keeps the estimate unbiased, so that <c, Pq> is counted on bit
planes.  Pairs whose interval lies below the threshold are done with; all others are computed
anew on the vectors, since no estimate may link a pair by itself.

Pairs meet without a cross join.  Pivots are a bounded sample of the vectors:

* a vector within half the threshold's angle of its nearest pivot belongs to that pivot's
  *ball*: all vectors of a ball are linked with each other, which needs no comparison, and a
  ball stands for its vectors wherever they are further on.  Large groups of near copies
  have pivots among them and become balls.
* every vector against every ball: angles to its pivot and the ball's radius say that it is
  linked with all of it, with none, or has to *visit* it; only visitors are compared.
* loose vectors, those of no ball, are compared with loose ones of the same *cell*, a cell
  being what shares one of its ``cells`` nearest pivots.

Cells and balls of more than BLOCK rows become tiles of two blocks each, so that no task
holds more than two blocks, however large a group is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, small, table
from .components import components
from .vectors import FINITE, NONZERO, dimensions, matrix, sample, unit

THRESHOLD = 0.9
#: Nearest pivots whose cells a loose vector lies in.
CELLS = 5
#: Pivots: so many times the root of the number of vectors, and their components at most (float64, 32 MB), which is what is broadcast.
PIVOTS_PER_ROOT = 4
PIVOT_VALUES = 1 << 22
#: Rows of one side of a tile, about.
BLOCK = 512
#: Deviates beyond which an estimate's error is taken to be impossible.
CONFIDENCE = 4.0
#: Slack of comparisons of angles, far above what rounding does to them.
SLACK = 1e-6
LINKS, EDGE, GAIN, CELL, VISIT = range(5)
FOUND = "kind int, key long, value long"


def rotation(dims: int, seed: int = 12) -> np.ndarray:
    """A random rotation, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def encode(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sign codes packed to words of 64 bits, correction factors) of rotated unit vectors."""
    signs = turned >= 0
    factor = np.abs(turned).sum(1) / math.sqrt(turned.shape[1])
    return pack_bits(signs), factor


def pack_bits(bits: np.ndarray) -> np.ndarray:
    words = -(-bits.shape[1] // 64)
    full = np.zeros((len(bits), words * 64), bool)
    full[:, : bits.shape[1]] = bits
    return np.packbits(full, axis=1, bitorder="little").view(np.uint64)


def planes(turned: np.ndarray, seed: int = 13) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bit planes, sums, lows, steps, error lengths) of rotated vectors in four bits: value = low + step * number."""
    dims = turned.shape[1]
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / 14, 1e-300)
    dither = np.random.default_rng([seed, dims]).random(dims)
    number = np.floor((turned - low[:, None]) / step[:, None] + dither).astype(np.int64)
    error = np.sqrt(((low[:, None] + step[:, None] * number - turned) ** 2).sum(1))
    return np.stack([pack_bits(number >> j & 1 == 1) for j in range(4)]), number.sum(1), low, step, error


def interval(codes: np.ndarray, factor: np.ndarray, asked: tuple, dims: int, confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, half widths) of inner products of coded vectors with vectors on bit planes, a row for each code."""
    bits, total, low, step, error = asked
    inside = np.zeros((len(codes), bits.shape[1]), np.int64)  # sum of numbers where the sign is positive
    for j in range(4):
        for w in range(codes.shape[1]):
            inside += np.bitwise_count(codes[:, w, None] & bits[j, None, :, w]).astype(np.int64) << j
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    along = (low * (2 * ones[:, None] - dims) + step * (2 * inside - total)) / math.sqrt(dims)
    f = np.minimum(factor, 1.0)[:, None]
    spread = (np.sqrt(np.maximum(0.0, 1 - f * f)) / math.sqrt(max(1, dims - 1)) + error / math.sqrt(dims)) / f
    return along / f, confidence * spread + SLACK


def linked(a: np.ndarray, b: np.ndarray, codes: np.ndarray, factor: np.ndarray, turned_b: np.ndarray, threshold: float, allowed=None) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows of a, rows of b, how many pairs were computed anew) of pairs of unit vectors at or above the threshold."""
    estimate, half = interval(codes, factor, planes(turned_b), a.shape[1])
    i, j = np.nonzero(estimate + half >= threshold)
    if allowed is not None:
        on = allowed(i, j)
        i, j = i[on], j[on]
    keep = np.concatenate([np.einsum("pd,pd->p", a[i[at : at + 4096]], b[j[at : at + 4096]]) >= threshold for at in range(0, len(i), 4096)] or [np.zeros(0, bool)])
    return i[keep], j[keep], len(i)


def least_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the first row that links lead to."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


class _Space:
    """What tasks share for vectors of one number of dimensions."""

    def __init__(self, pivots: np.ndarray, threshold: float, cells: int):
        self.dims, self.pivots, self.cells = pivots.shape[1], unit(pivots), min(cells, len(pivots))
        self.threshold, self.theta = threshold, math.acos(threshold)
        self.turn = rotation(self.dims)
        self.step = max(16, (1 << 21) // len(pivots))  # 16 MB of products at a time


def _batches(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            yield whole.slice(at, step)


def _coded(space, nodes: DataFrame) -> DataFrame:
    """The nodes with code, correction factor, ball (or -1) and angle to its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        for b in _batches(batches, s.step):
            x = unit(matrix(b.column("v"), s.dims))
            near = x @ s.pivots.T
            best = near.argmax(1)
            angle = np.arccos(np.clip(near[np.arange(len(x)), best], -1, 1))
            ball = np.where(angle <= s.theta / 2 - SLACK, best, -1)
            codes, factor = encode(x @ s.turn.T)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("node", "low", "n", "v")), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factor), pa.array(ball.astype(np.int32)), pa.array(angle)],
                ["node", "low", "n", "v", "code", "factor", "ball", "angle"],
            )

    return nodes.select("node", "low", "n", "v").mapInArrow(run, f"node long, low long, n long, v {nodes.schema['v'].dataType.simpleString()}, code binary, factor double, ball int, angle double")


def _angles(s: _Space, b: pa.RecordBatch, balls: tuple) -> tuple:
    """(products with pivots, own balls, counts, whether linked with all of a ball, whether visiting it)."""
    radius, _, _ = balls
    x = unit(matrix(b.column("v"), s.dims))
    near = x @ s.pivots.T
    own = b.column("ball").to_numpy()
    with np.errstate(invalid="ignore"):
        angle = np.arccos(np.clip(near, -1, 1))
        all_of = angle + radius <= s.theta - SLACK  # a radius of NaN is that of a pivot without a ball
        visits = ~all_of & (angle - radius <= s.theta + SLACK)
    at = np.flatnonzero(own >= 0)
    all_of[at, own[at]] = visits[at, own[at]] = False
    return near, own, b.column("n").to_numpy(), all_of, visits


def _certain(space, balls, coded: DataFrame) -> DataFrame:
    """What angles to pivots say alone: links, edges between groups, what balls gain from loose vectors, sizes of cells and of visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, (radius, size, head) = space.value, balls.value
        for b in _batches(batches, s.step):
            near, own, n, all_of, visits = _angles(s, b, balls.value)
            loose, node = own < 0, b.column("node").to_numpy()
            group = np.where(loose, node, head[own])
            links = np.where(loose, n, size[own]) - 1 + all_of @ size
            i, j = np.nonzero(all_of)
            gain, cell = loose.astype(np.int64) * n @ all_of, np.bincount(_cells(near[loose], s.cells).ravel(), minlength=len(head))
            out = [(LINKS, node, links), (EDGE, group[i], head[j])]
            out += [(k, at := np.flatnonzero(c), c[at]) for k, c in ((GAIN, gain), (CELL, cell), (VISIT, visits.sum(0)))]
            kind = np.concatenate([np.full(len(k), kind, np.int32) for kind, k, _ in out])
            yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(np.concatenate([o[c] for o in out]).astype(np.int64)) for c in (1, 2))], ["kind", "key", "value"])

    return coded.mapInArrow(run, FOUND)


def _cells(near: np.ndarray, cells: int) -> np.ndarray:
    """The nearest pivots of each row, ascending by number."""
    return np.sort(np.argpartition(-near, cells - 1, 1)[:, :cells], 1) if len(near) else np.zeros((0, cells), np.int64)


def _tiles(space, balls, sizes, coded: DataFrame) -> DataFrame:
    """A row for each tile that a vector has a part in: (place, i, j, side, ...); cells are places from 0, balls behind them."""
    kind = coded.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, (cell_size, visitors, members) = space.value, sizes.value
        blocks = [np.maximum(1, -(-x // BLOCK)) for x in (cell_size, visitors, members)]
        for b in _batches(batches, s.step):
            near, own, _, _, visits = _angles(s, b, balls.value)
            loose, node, head = own < 0, b.column("node").to_numpy(), balls.value[2]
            mix = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
            every = np.full((len(own), s.cells), -1)
            every[loose] = _cells(near[loose], s.cells)
            rows: list[tuple[int, int, int, int, int]] = []
            for r in np.flatnonzero(loose):
                for c in every[r]:
                    if cell_size[c] > 1:
                        k, me = int(blocks[0][c]), int(mix[r] % blocks[0][c])
                        rows += [(r, c, min(me, o), max(me, o), int(me > o)) for o in range(k)]
            for r, c in zip(*np.nonzero(visits)):
                me = int(mix[r] % blocks[1][c])
                rows += [(r, len(head) + c, me, o, 1) for o in range(int(blocks[2][c]))]
            for r in np.flatnonzero(~loose & (visitors[own] > 0)):
                c = own[r]
                me = int(mix[r] % blocks[2][c])
                rows += [(r, len(head) + c, o, me, 0) for o in range(int(blocks[1][c]))]
            if rows:
                at, *place = (np.array(x, np.int64) for x in zip(*rows))
                group = pa.array(np.where(loose, node, head[own])[at])
                picked = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, place), pa.array(loose[at]), group, pa.array([*every[at]], pa.list_(pa.int64())), *(picked.column(c) for c in ("node", "n", "v", "code", "factor"))],
                    ["place", "i", "j", "side", "loose", "grp", "cells", "node", "n", "v", "code", "factor"],
                )

    return coded.mapInArrow(run, f"place long, i long, j long, side long, loose boolean, grp long, cells array<long>, node long, n long, v {kind}, code binary, factor double")


def _compare(space, pivots: int, tiles: DataFrame) -> DataFrame:
    """Links and edges of every tile; a pair of loose vectors counts in the first cell that both lie in."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        s = space.value
        place, i, j = (k.as_py() for k in key)
        visiting, within = place >= pivots, place < pivots and i == j
        side = t["side"].to_numpy()
        left, right = (np.arange(len(side)),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        x = unit(matrix(t["v"], s.dims))
        codes = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint64).reshape(len(x), -1)
        n, node, group, loose = (t[c].to_numpy() for c in ("n", "node", "grp", "loose"))
        cells = None if visiting else matrix(t["cells"], s.cells, np.int64)
        place_of = lambda p, q: (left[p], right[q])

        def allowed(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            a, b = place_of(p, q)
            on = a < b if within else np.ones(len(a), bool)
            at = np.flatnonzero(on)
            for lo in range(0, len(at), 1 << 16):  # the first cell that both lie in is this one
                own, other = cells[a[at[lo : lo + (1 << 16)]]], cells[b[at[lo : lo + (1 << 16)]]]
                on[at[lo : lo + (1 << 16)]] = np.where((own[:, :, None] == other[:, None, :]).any(2), own, np.iinfo(np.int64).max).min(1) == place
            return on

        p, q, _ = linked(x[left], x[right], codes[left], t["factor"].to_numpy()[left], x[right] @ s.turn.T, s.threshold, None if visiting else allowed)
        a, b = place_of(p, q)
        links = np.zeros(len(x), np.int64)
        np.add.at(links, b, n[a])
        heard = loose[b] if visiting else np.ones(len(b), bool)  # vectors of other balls count their visits only
        np.add.at(links, a[heard], n[b[heard]])
        if visiting:
            first = np.unique(b, return_index=True)[1]
            one, other = group[b[first]], group[a[first]]
        else:
            low = least_reachable(len(x), a, b)
            moved = np.flatnonzero(low != np.arange(len(x)))
            one, other = group[moved], group[low[moved]]
        some = np.flatnonzero(links)
        kind = np.repeat(np.array([LINKS, EDGE], np.int32), [len(some), len(one)])
        return pa.table({"kind": pa.array(kind), "key": np.concatenate([node[some], one]), "value": np.concatenate([links[some], other])})

    return tiles.groupBy("place", "i", "j").applyInArrow(run, FOUND)


def _search(spark: SparkSession, stage: Stage, nodes: DataFrame, dims: int, threshold: float, cells: int) -> tuple[DataFrame, list[DataFrame]]:
    """((node, low, grp) of every node, tables of links and edges) for vectors of one number of dimensions."""
    total = nodes.count()
    few = max(1, min(math.ceil(PIVOTS_PER_ROOT * math.sqrt(total)), PIVOT_VALUES // dims))
    pivots = sample(nodes, few)
    space = spark.sparkContext.broadcast(_Space(pivots, threshold, cells))
    coded = stage.write(_coded(space, nodes), "coded")
    radius, size, members, head = np.full(len(pivots), np.nan), *np.zeros((2, len(pivots)), np.int64), np.full(len(pivots), -1)
    for r in coded.where("ball >= 0").groupBy("ball").agg(F.max("angle").alias("a"), F.sum("n").alias("n"), F.count("*").alias("m"), F.min("node").alias("h")).collect():  # a row for each pivot at most
        radius[r["ball"]], size[r["ball"]], members[r["ball"]], head[r["ball"]] = r["a"], r["n"], r["m"], r["h"]
    balls = spark.sparkContext.broadcast((radius, size, head))
    certain = stage.write(_certain(space, balls, coded), "certain")
    sums = {k: np.zeros(len(pivots), np.int64) for k in (GAIN, CELL, VISIT)}
    for r in certain.where(F.col("kind").isin([*sums])).groupBy("kind", "key").agg(F.sum("value").alias("s")).collect():  # three rows for each pivot at most
        sums[r["kind"]][r["key"]] = r["s"]
    sizes = spark.sparkContext.broadcast((sums[CELL], sums[VISIT], members))
    compared = stage.write(_compare(space, len(pivots), _tiles(space, balls, sizes, coded)), "compared")
    found = [certain.where(F.col("kind").isin(LINKS, EDGE)), compared]
    gains = spark.createDataFrame([(int(k), int(sums[GAIN][k])) for k in np.flatnonzero(sums[GAIN])], "ball int, value long")  # a row for each pivot at most
    found.append(coded.join(F.broadcast(gains), "ball").select(F.lit(LINKS).alias("kind"), F.col("node").alias("key"), "value"))
    heads = spark.createDataFrame([(int(k), int(head[k])) for k in np.flatnonzero(head >= 0)], "ball int, head long")
    return coded.select("node", "low", "ball").join(F.broadcast(heads), "ball", "left").select("node", "low", F.coalesce("head", "node").alias("grp")), found


def near_duplicates(spark: SparkSession, df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", cells: int = CELLS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; links are pairs with a cosine of ``threshold`` or more.

    ``n_links`` are the other rows linked directly, ``component_id`` is the smallest id
    reachable, and rows of that id are kept.  No pair below the threshold is linked.  Equal
    vectors are one until the end, so copies are never expanded; links between vectors of
    balls and others are all found, those between two loose vectors if they share a cell.
    Vectors that are null, empty, zero or not finite link with nothing and are kept; those of
    unlike numbers of dimensions have no cosine and are compared apart.  Rows of a repeated
    id are rows of their own, kept together; rows without id link like others, are not kept
    where an id represents them, and are kept, with a null component, where none does.  Other
    columns aren't read.  An empty table gives no rows.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    stage = Stage(spark, "neardup")
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].alias("v"))
    good = F.expr(f"{FINITE.format(v='v')} AND {NONZERO.format(v='v')}")
    key = [F.xxhash64(F.lit(s), "v").alias(f"h{s}") for s in (1, 2)]  # 128 bits name a vector in the last join
    nodes = stage.write(rows.where(good).groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n")).select("*", *key).withColumn("node", F.monotonically_increasing_id()), "nodes")
    groups, found = [], []
    for dims in dimensions(nodes):
        own, made = _search(spark, stage, nodes.where(F.size("v") == dims), dims, threshold, cells)
        groups.append(own), found.extend(made)
    bare = rows.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not groups:
        return stage.finish(bare)
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionAll(union(parts[1:]))
    groups, found = stage.write(union(groups), "groups"), union(found)
    roots = components(stage, found.where(F.col("kind") == EDGE).select(F.col("key").alias("a"), F.col("value").alias("b")))
    links = found.where(F.col("kind") == LINKS).groupBy(F.col("key").alias("node")).agg(F.sum("value").alias("n_links"))
    named = groups.join(small(roots.select(F.col("node").alias("grp"), "root")), "grp", "left").withColumn("root", F.coalesce("root", "grp"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    whole = stage.write(named.join(small(least), "root").join(links, "node").join(nodes.select("node", "h1", "h2"), "node").select("h1", "h2", "n_links", "component_id"), "vectors")
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept")
    made = rows.where(good).select("vec_id", *key).join(small(whole), ["h1", "h2"]).select("vec_id", "n_links", "component_id", kept)
    return stage.finish(made.unionAll(bare))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every vector at a cosine of 0.9."""
    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_embedding_near_dedup": op12_embedding_near_dedup}
ORACLES = {
    "op12_embedding_near_dedup": """WITH RECURSIVE good AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM low LEFT JOIN degree USING (vec_id)"""
}
