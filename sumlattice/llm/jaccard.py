"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Of each distinct set of shingles one representative takes part.  Shingles have one
order, rare ones first, and of a set only so many of the first count as columns that
two sets above the threshold must share one of them.  A column belongs to the block of
its smallest member, so that the columns of a group of near copies lie in one block.
A task multiplies a block's incidence with its transpose on arrays, which adds up how
many of its columns each two members share; the counts of all blocks are added up for
each pair.  A pair is discarded as soon as its count, with all that other blocks and the
shingles behind the columns could add, stays below what its sizes ask for.  What is left
is compared in full.

No rows are made for the pairs of a group: each member is first held against the
smallest member of its blocks only, whereupon most of a group shares a component, and
the product then passes over pairs within a component.  Large blocks are cut, and two
parts at a time are multiplied.

That finds components.  Links are counted afterwards within each component, where the
overlaps of all its sets are added up column by column, again on arrays.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .common import Stage, small, table
from .components import components

#: Shingles that are put last in the order, at most; it steers cost only.
FREQUENT = 50_000
#: Shingles for each hash range that a set's counts are kept of, and ranges at most.
PER_RANGE = 2
MAX_RANGES = 8192
COUNT_ROWS = 4096
#: Members of a block that stand in a part of it, about.
BLOCK = 1024
#: Sets, and shingles of all of them, that stand in a part when a component's links are counted, about.
GROUP = 1024
GROUP_SHINGLES = 1 << 19
#: Columns that are multiplied at once as a dense matrix, pairs that are added up at once, and how full a dense column is.
DENSE = 2048
PAIRS = 1 << 21
FULL = 200


def _frequent(texts: DataFrame, size: int) -> np.ndarray:
    """Hashes of the most frequent shingles, commonest first.

    A task counts over blocks of rows and passes on what is in a thousandth of a block's
    rows or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = n >= max(4, rows // 1000)
            return pa.RecordBatch.from_arrays([pa.array(key[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["key", "n"])

        for b in words.grouped(batches, 0):
            held += words.find(b.column(0), lower=True).shingle_sets(size)
            rows += b.num_rows
            if rows >= COUNT_ROWS:
                yield flush()
                held, rows = [], 0
        yield flush()

    found = texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return np.array([r["key"] for r in found.orderBy(F.desc("n"), "key").limit(FREQUENT).collect()], np.int64).view(np.uint64)


def _columns(texts: DataFrame, frequent: np.ndarray, size: int, percent: int) -> DataFrame:
    """(id, n, set, counts, columns, late, last): size, digest and counts of each document's set, its first shingles in the order, and where the last of them stands."""
    order = np.argsort(frequent, kind="stable")
    shared = texts.sparkSession.sparkContext.broadcast((frequent[order], len(frequent) - order))  # FREQUENT rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, weight = shared.value
        for b in words.grouped(batches, 1):
            n, digest, columns, ranges, lates, lasts = [], [], [], [], [], []
            for s in words.find(b.column(1), lower=True).shingle_sets(size):
                ranges.append(counts(s))
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                # Any set that overlaps in ceil(percent % of n) or more has one of these.
                keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                late = np.zeros(len(s), np.int64)
                if len(often) and len(s):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    late = np.where(often[at] == s, weight[at], 0)
                    by = np.argsort(late, kind="stable")
                    s, late = s[by], late[by]
                columns.append(s[:keep].view(np.int64))
                lates.append(int(late[keep - 1]) if keep else 0), lasts.append(int(s[keep - 1]) - (1 << 63) if keep else 0)  # signed, in the same order
            ends = np.cumsum([0, *map(len, columns)]).astype(np.int32)
            flat = np.concatenate(columns) if columns else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(ranges, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(lates, pa.int64()), pa.array(lasts, pa.int64())], ["id", "n", "set", "counts", "columns", "late", "last"])

    return texts.select("id", "text").mapInArrow(run, "id long, n long, set binary, counts binary, columns array<long>, late long, last long")


def counts(s: np.ndarray) -> bytes:
    """How many of a set's hashes lie in each of equal ranges; 255 stands for more as well."""
    bits = min(MAX_RANGES, max(8, len(s) // PER_RANGE)).bit_length() - 1
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def most_common(a: bytes, b: bytes, n: int, m: int) -> int:
    """A number that two sets of these counts and sizes can't have more shingles in common than."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if (x == 255).any() or (y == 255).any():
        return min(n, m)
    x, y = x.astype(np.int64), y.astype(np.int64)
    size = min(len(x), len(y))
    return int(np.minimum(x.reshape(size, -1).sum(1), y.reshape(size, -1).sum(1)).sum())


def _compare(stage: Stage, pairs: DataFrame, sets: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            most = np.array([most_common(x, y, *nm) for x, y, nm in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), zip(n.tolist(), m.tolist()))], np.int64)
            yield batch.filter(pa.array((100 + percent) * most >= percent * (n + m))).select(["a", "b"])

    of = lambda x, n: sets.select(F.col("rep").alias(x), F.col("n").alias(n), F.col("counts").alias(f"counts_{x}"))
    both = pairs.join(of("b", "m"), "b").join(of("a", "n"), "a").select("a", "b", "n", "m", "counts_a", "counts_b")
    pairs = stage.write(both.mapInArrow(bounded, "a long, b long"), "bounded")
    ids = stage.write(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct(), "ids")
    own = stage.write(texts.join(small(ids), "id"), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()

        def sets_of(column: pa.Array) -> list[np.ndarray]:
            return words.find(column, lower=True).shingle_sets(size)

        for b in words.grouped(words.grouped(batches, 2), 3):
            a_ids, a_first = np.unique(b.column(0).to_numpy(), return_index=True)
            new = {k: i for k, i in zip(a_ids.tolist(), a_first.tolist()) if k not in kept}
            fresh = dict(zip(new, sets_of(b.column(2).take(pa.array([*new.values()], pa.int64())))))
            held = {k: fresh[k] if k in fresh else kept[k] for k in a_ids.tolist()}
            kept = OrderedDict([*held.items()][-2:])
            hit = []
            for a, s in zip(b.column(0).to_pylist(), sets_of(b.column(3))):
                common = len(np.intersect1d(held[a], s, assume_unique=True))
                hit.append(100 * common >= percent * (len(held[a]) + len(s) - common))
            yield b.filter(pa.array(hit, pa.bool_())).select(["a", "b"])

    left = pairs.join(own.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(own.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return stage.write(both.mapInArrow(run, "a long, b long"), "links")


def _memberships(stage: Stage, sets: DataFrame) -> DataFrame:
    """(hub, rep, keys, own, total, n, p, late, last): the columns of each set in each block that it is a member of.

    A block is named after its smallest member, the hub.  ``own`` counts the set's
    columns in the block, ``total`` those in all blocks and ``p`` all its columns;
    columns of one member join nothing and are in no block.
    """
    cell = sets.select("rep", F.explode("columns").alias("key"))
    shared = cell.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub <> top").select("key", "hub")
    cells = cell.join(stage.write(shared, "shared"), "key").withColumn("total", F.count("*").over(Window.partitionBy("rep")))
    members = cells.groupBy("rep", "hub").agg(F.collect_list("key").alias("keys"), F.first("total").alias("total"))  # of one set: no more than its columns
    facts = sets.select("rep", "n", F.size("columns").cast("long").alias("p"), "late", "last")
    return members.join(facts, "rep").select("hub", "rep", "keys", F.size("keys").cast("long").alias("own"), "total", "n", "p", "late", "last")


def _stars(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of each member with its blocks' hubs, unless the counts in the block already rule them out."""
    facts = ("own", "total", "n", "p", "late", "last")
    hubs = members.where("rep = hub").select("hub", *(F.col(c).alias(f"hub_{c}") for c in facts))
    both = members.where("rep <> hub").select("hub", "rep", *facts).join(hubs, "hub")
    behind, hub_behind = F.col("n") - F.col("p"), F.col("hub_n") - F.col("hub_p")
    here, there = F.struct("late", "last"), F.struct(F.col("hub_late"), F.col("hub_last"))
    behind = F.when(here < there, behind).when(here > there, hub_behind).otherwise(F.least(behind, hub_behind))
    most = F.col("own") + F.least(F.col("total") - F.col("own"), F.col("hub_total") - F.col("hub_own")) + behind
    asked = F.lit(percent) * (F.col("n") + F.col("hub_n"))
    near = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    return both.where(near & (F.lit(100 + percent) * most >= asked)).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()


def _product(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b, common, asked), a < b: columns that two members share within ``x`` or, where ``y`` isn't null, between ``x`` and ``y``.

    ``asked`` is how many they must share in all blocks together.  Pairs that can't reach
    it whatever other blocks add, and pairs within a component, are left out.
    """

    def columns(m: pa.StructArray) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
        keys = m.field("keys")
        ends, flat = keys.offsets.to_numpy(), keys.values.to_numpy().view(np.uint64)
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])], {c: m.field(c).to_numpy() for c in ("rep", "root", "own", "total", "n", "p", "late", "last")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                a_keys, a = columns(x.values)
                b_keys, b = columns(y.values) if y.is_valid else (a_keys, a)
                n, m = a["n"][:, None], b["n"][None]
                live = (a["root"][:, None] != b["root"][None]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                if not y.is_valid:
                    live = np.triu(live, 1)
                if not live.any():
                    continue
                common = overlaps(a_keys, b_keys)
                # Shingles behind the columns: those of the set whose last column comes first.
                place = np.unique(np.stack([np.append(a["late"], b["late"]), np.append(a["last"], b["last"])], 1), axis=0, return_inverse=True)[1].ravel()
                i, j = place[: len(a_keys), None], place[None, len(a_keys) :]
                s, t = (a["n"] - a["p"])[:, None], (b["n"] - b["p"])[None]
                asked = -(-percent * (n + m) // (100 + percent)) - np.where(i < j, s, np.where(i > j, t, np.minimum(s, t)))
                rest = np.minimum((a["total"] - a["own"])[:, None], (b["total"] - b["own"])[None])
                at, to = np.nonzero(live & (common > 0) & (common + rest >= asked))
                if len(at):
                    first, second = a["rep"][at], b["rep"][to]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(first, second)), pa.array(np.maximum(first, second)), pa.array(common[at, to]), pa.array(asked[at, to])], ["a", "b", "common", "asked"])

    return blocks.mapInArrow(run, "a long, b long, common long, asked long")


def _parts(stage: Stage, members: DataFrame, key: str, label: str) -> DataFrame:
    """(x, y) of all parts of each ``key`` and all pairs of its parts; ``y`` is null for a part by itself.

    ``members`` has (key, part, parts, m).  A part goes to each of the others once.
    """
    parts = stage.write(members.repartition(key, "part").groupBy(key, "part").agg(F.first("parts").alias("parts"), F.collect_list("m").alias("m")), label)
    alone = parts.select(F.col("m").alias("x"), F.lit(None).cast(parts.schema["m"].dataType).alias("y"))
    many = parts.where("parts > 1")
    x = many.select(key, F.col("part").alias("i"), F.col("m").alias("x"))
    y = many.where("part > 0").select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("part").cast("long") - 1)).alias("i"), F.col("m").alias("y"))
    return alone.unionAll(x.join(y, [key, "i"]).select("x", "y"))


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of the sets ``x`` has in common with each of ``y``.

    The product of the two incidences: full columns as dense matrices, thin ones pair by pair.
    """
    key = np.intersect1d(np.concatenate(x), np.concatenate(y))

    def entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        every, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(key, every)
        at[at == len(key)] = 0
        real = key[at] == every if len(key) else np.zeros(len(every), bool)
        at, row = at[real], row[real]
        order = np.argsort(at, kind="stable")
        return at[order], row[order], np.bincount(at, minlength=len(key))

    (a, i, p), (b, j, q) = entries(x), entries(y)
    out = np.zeros((len(x), len(y)), np.int64)
    full = p * q * FULL > len(x) * len(y)
    dense = np.flatnonzero(full)
    for at in range(0, len(dense), DENSE):
        some = dense[at : at + DENSE]
        sides = []
        for col, row, n in ((a, i, len(x)), (b, j, len(y))):
            part = slice(np.searchsorted(col, some[0], "left"), np.searchsorted(col, some[-1], "right"))
            col, row = col[part], row[part]
            col, row = col[full[col]], row[full[col]]
            side = np.zeros((n, len(some)), np.float32)
            side[row, np.searchsorted(some, col)] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)  # at most DENSE each: exact
    thin = ~full[a]
    a, i = a[thin], i[thin]
    n, first = q[a], (np.cumsum(q) - q)[a]
    ends, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        k = n[at:to]
        other = j[np.repeat(first[at:to] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        out += np.bincount(np.repeat(i[at:to], k) * len(y) + other, minlength=out.size).reshape(out.shape)
        at = to
    return out


def _degrees(stage: Stage, sets: DataFrame, roots: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(set, n_links) of every set in a component of several: with how many others of it the set reaches the threshold."""
    members = stage.write(sets.select("set", "rep", "n").join(roots, F.col("rep") == F.col("node")).select("set", "rep", "n", "root"), "grouped")
    groups = members.groupBy("root").agg(F.count("*").alias("k"), F.sum("n").alias("total"))
    groups = stage.write(groups.select("root", "k", F.expr(f"greatest(ceil(k / {GROUP}), ceil(total / {GROUP_SHINGLES}))").alias("blocks")), "groups")
    two = members.join(groups.where("k = 2"), "root").select("set", F.lit(1).cast("long").alias("n_links"))  # nothing else makes them one component
    large = stage.write(members.join(groups.where("k > 2"), "root").select("set", "rep", "root", "blocks"), "large")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.grouped(batches, 0):
            found = [s.tobytes() for s in words.find(b.column(0), lower=True).shingle_sets(size)]
            own = pa.array([hashlib.blake2b(s, digest_size=16).digest() == d for s, d in zip(found, b.column(1).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found, pa.binary())], ["set", "root", "blocks", "shingles"]).filter(own)

    own = texts.join(small(large), F.col("id") == F.col("rep")).select("text", "set", "root", "blocks").mapInArrow(shingles, "set binary, root long, blocks long, shingles binary")
    own = own.withColumn("part", F.pmod(F.xxhash64("set"), F.col("blocks")))
    # Rows may repeat, a set stands in its part once.
    own = own.groupBy("root", "part", "set").agg(F.first("blocks").alias("parts"), F.first("shingles").alias("shingles"))
    both = _parts(stage, own.select("root", "part", "parts", F.struct("set", "shingles").alias("m")), "root", "group-parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(m: pa.StructArray) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
            found = [np.frombuffer(s, np.uint64) for s in m.field("shingles").to_pylist()]
            return m.field("set").to_pylist(), found, np.array([len(s) for s in found], np.int64)

        for batch in batches:
            ids, degree = [], []
            for x, y in zip(batch.column(0), batch.column(1)):
                a_set, a, n = of(x.values)
                b_set, b, m = of(y.values) if y.is_valid else (a_set, a, n)
                common = overlaps(a, b)
                near = 100 * common >= percent * (n[:, None] + m[None, :] - common)
                if y.is_valid:
                    ids += b_set
                    degree.append(near.sum(0))
                ids += a_set
                degree.append(near.sum(1) - (0 if y.is_valid else 1))  # not with itself
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(np.concatenate(degree).astype(np.int64))], ["set", "n_links"])

    counted = both.mapInArrow(run, "set binary, n_links long")
    return stage.write(counted.unionAll(two).groupBy("set").agg(F.sum("n_links").alias("n_links")), "degrees")


def join(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document.

    Documents link when 100 * intersection >= ``percent`` * union of their sets of
    ``size``-word shingles; a document with fewer words has its whole sequence as its
    one shingle, and one without words links with nothing.  ``component_id`` is the
    smallest id reachable by links; ``n_links`` counts all links to
    different sets, each set once however many documents have it; it is null without
    ``count_links``.  Repeated rows are copies.  A null id gets a null component and
    links with nothing.  Extra columns aren't read; an empty table gives no rows.
    """
    stage = Stage(spark, "jaccard")
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    every = stage.write(_columns(texts, _frequent(texts, size), size, percent), "columns")
    full = every.where("n > 0 AND id IS NOT NULL")
    sets = stage.write(full.groupBy("set").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "counts", "columns", "late", "last"))), "sets")
    members = stage.write(_memberships(stage, sets), "members")
    stage.release()

    # First each set against the smallest member of its blocks.
    links = _compare(stage, stage.write(_stars(members, percent), "pairs"), sets, texts, size, percent)
    roots = stage.write(components(stage, links), "roots")
    stage.release()

    # Then the blocks whose members lie in different components.
    members = members.join(roots, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep")).drop("node")
    several = members.groupBy("hub").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("k")).where("r1 <> r2")
    several = stage.write(several.select("hub", F.ceil(F.col("k") / BLOCK).alias("parts")), "several")
    members = members.join(several, "hub")
    members = members.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    both = _parts(stage, members.select("hub", "part", "parts", F.struct("rep", "root", "own", "total", "n", "p", "late", "last", "keys").alias("m")), "hub", "parts")
    counted = _product(both, percent).groupBy("a", "b").agg(F.sum("common").alias("common"), F.first("asked").alias("asked"))
    pairs = stage.write(counted.where("common >= asked").select("a", "b"), "pairs")
    new = _compare(stage, pairs, sets, texts, size, percent)
    if not new.isEmpty():
        roots = stage.write(components(stage, roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(new)), "roots")
    stage.release()
    known = sets.select("set", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("set", F.coalesce("root", "rep").alias("root"))
    if count_links:
        known = known.join(_degrees(stage, sets, roots, texts, size, percent), "set", "left").select("set", "root", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    else:
        known = known.withColumn("n_links", F.lit(None).cast("long"))
    known = stage.write(known, "known")
    out = every.select("id", "n", "set").join(known, "set", "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("id")))
    n_links = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("n_links")).otherwise(F.lit(0) if count_links else F.lit(None))
    return stage.finish(out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), n_links.alias("n_links")))


def one_of_each(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of the smallest id of each component, one row for each id; rows without id stay."""
    stage = Stage(spark, "representatives")
    found = stage.write(join(spark, docs, id_col, text_col, size, percent, count_links=False).where("doc_id IS NOT NULL"), "components")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    twice = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(id_col)).count().where("count > 1").select(id_col)
    gone, twice = small(stage.write(gone, "gone")), small(stage.write(twice, "twice"))
    kept = docs.join(gone, id_col, "left_anti")
    again = kept.join(twice, id_col, "left_semi").dropDuplicates([id_col])
    return kept.join(twice, id_col, "left_anti").unionByName(again).select(*docs.columns)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and links of every document, for sets of four-word shingles and 85 percent."""
    return join(spark, table(spark, sf_dir, "documents"), size=4, percent=85)


QUERIES = {"op1_ngram_jaccard_join": op1_ngram_jaccard_join}
ORACLES = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct([array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), cells AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM cells a JOIN cells b ON a.k = b.k AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (max(a.n) + max(b.n) - count(*))
), sides AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, sides.b FROM reach JOIN sides ON reach.r = sides.a),
least_id AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
alike AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS set_id FROM s),
counted AS (
  SELECT x.doc_id, count(DISTINCT y.set_id) AS n_links
  FROM sides JOIN alike x ON x.doc_id = sides.a JOIN alike y ON y.doc_id = sides.b WHERE x.set_id <> y.set_id GROUP BY x.doc_id
)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM s JOIN least_id ON id = s.doc_id LEFT JOIN counted ON counted.doc_id = s.doc_id"""
}
