"""Packing documents into sequences of a fixed number of tokens by minimum bin slack.

Only lengths matter to a plan, and there are at most ``capacity`` of them.  So the
plan is made from the number of pieces of each length: the longest length left
opens a bin, a bitset subset-sum over the lengths left finds the fullest feasible
rest, and that combination is removed as many times as its pieces are there.
Pieces then find their place by their rank among those of their length, which
tasks compute on their own from the ranks at which their pieces begin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import VOCABULARY, load
from .common import Stage, slices, table

CAPACITY = 2048
END_ID = 0


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The combination of available lengths that fills ``room`` best, as (length, times).

    ``lengths`` descend.  Bit s of a set says that s can be filled; each length adds
    itself up to as often as it is there, by doubling steps.
    """
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for size in lengths:
        if size > room:
            continue
        left, times = min(counts[size], room // size), 1
        while left > 0:
            take = min(times, left)
            made = (reach | (reach << (take * size))) & full
            if made != reach:
                steps.append((size, take, reach))
                reach = made
            left -= take
            times *= 2
        if reach >> room:
            break
    best, out = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> best & 1:
            out[size] = out.get(size, 0) + take
            best -= take * size
    return sorted(out.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, times)]) by minimum bin slack, for so many pieces of each length."""
    left = {size: n for size, n in counts.items() if n > 0}
    order = sorted(left, reverse=True)
    out = []
    while order:
        top = order[0]
        left[top] -= 1
        rest = dict(fullest([x for x in order if left[x] > 0], left, capacity - top))
        left[top] += 1
        rest[top] = rest.get(top, 0) + 1
        bins = min(left[size] // times for size, times in rest.items())
        for size, times in rest.items():
            left[size] -= bins * times
        out.append((bins, sorted(rest.items(), reverse=True)))
        order = [x for x in order if left[x] > 0]
    return out


def places(plans: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, times, first sequence, offset), by rank."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for bins, combination in plans:
        offset = 0
        for size, times in combination:
            at = used.get(size, 0)
            rows.setdefault(size, []).append((at, times, sequence, offset))
            used[size] = at + bins * times
            offset += size * times
        sequence += bins
    return {size: np.array(x, np.int64) for size, x in rows.items()}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every document: its ids, then END_ID, cut only where longer than ``capacity``.

    ``part`` and ``nth`` say where a piece stands: the task that read it, and its rank
    there among pieces of its length.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([END_ID], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = load(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(bpe.encode_many([t or "" for t in b.column(1).to_pylist()])):
                ids = np.append(ids, end)
                for k, at in enumerate(range(0, len(ids), capacity)):
                    cut = ids[at : at + capacity]
                    row.append(i), piece.append(k), start.append(at), length.append(len(cut)), crc.append(zlib.crc32(cut))
            size = np.array(length, np.int64)
            order = np.argsort(size, kind="stable")
            ranked = size[order]
            first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(ranked)))
            nth = np.empty(len(size), np.int64)
            nth[order] = np.arange(len(ranked)) - np.repeat(first, n) + seen[ranked]
            seen += np.bincount(size, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(nth)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    A null or empty text is one piece of length 1 (END_ID alone); null ids and
    repeated rows are packed like others.  A very long text is encoded whole, in one task,
    and cut into pieces.  Extra columns aren't read; an empty table packs into nothing.
    """
    stage = Stage(spark, "packing")
    cut = stage.write(pieces(docs, path, capacity, id_col, text_col), "pieces")
    begin = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(begin), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    where = spark.sparkContext.broadcast(places(plan(counts, capacity)))  # about capacity * ln(capacity) rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length):
                rows, own = where.value[int(size)], np.flatnonzero(length == size)
                at = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                k = rank[own] - at[:, 0]
                sequence[own], offset[own] = at[:, 2] + k // at[:, 1], at[:, 3] + k % at[:, 1] * size
            out = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    ranked = cut.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens."""
    return pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLES: dict[str, str] = {}
