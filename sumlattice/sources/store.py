"""Stored candidate tables: Parquet with a description beside it, a result cache, CSV copies."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import uuid
import warnings
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import CONDITION_COLUMNS, choice, filter_conditions
from ..operators.ranking import ranked, result_order
from .staging import file_system, scratch, shared_folder, staged

STORAGE = ("auto", "memory", "rds", "none", "parquet")
CACHE = ("off", "reuse", "refresh")
MEMORY_LIMIT = 100_000
FORMAT = 2
#: Bytes of a row group of a stored result, about.
GROUP_BYTES = 1 << 20


def check_storage(mode: str) -> str:
    return choice(mode, STORAGE, "results_storage")


def check_cache(mode: str, folder: str | None) -> str:
    choice(mode, CACHE, "cache")
    if mode != "off" and not folder:
        raise ValueError("a cache needs cache_dir")
    return mode


def storage_policy(mode: str, total: int) -> str:
    """memory (a lazy table), parquet or none."""
    if mode == "auto":
        return "memory" if total <= MEMORY_LIMIT else "parquet"
    if mode == "memory" and total > MEMORY_LIMIT:
        warnings.warn(f"{total} candidates are asked for in memory", stacklevel=3)
    return {"rds": "parquet"}.get(mode, mode)


def results_path(folder: str, prefix: str, outcome: str, n_items: int, low: int, high: int, rank_by: str) -> str:
    """A fresh path that says what it holds."""
    clean = lambda x: re.sub(r"[^A-Za-z0-9_-]+", "_", str(x))
    stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S")
    return f"{folder.rstrip('/')}/{clean(prefix)}_{clean(outcome)}_p{n_items}_k{low}-{high}_{clean(rank_by)}_{stamp}_{uuid.uuid4().hex[:8]}.parquet"


def _write_text(spark: SparkSession, at: str, text: str) -> None:
    fs, path = file_system(spark, at)
    out = fs.create(path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, at: str) -> str:
    fs, path = file_system(spark, at)
    source = fs.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def write_results(df: DataFrame, path: str, metadata: dict, cluster_by: str | None = None) -> str:
    """Spark's commit protocol makes the table appear whole; the description stands beside it.

    With ``cluster_by`` rows are sorted by that statistic over all files, largest first, in
    small row groups, so that conditions on it and on what goes with it read few of them.
    ``df`` is computed twice then, as the sort draws a sample: give a written table.
    """
    write = df.write
    if cluster_by is not None:
        order = F.desc_nulls_last(cluster_by)
        write = df.repartitionByRange(order).sortWithinPartitions(order).write.option("parquet.block.size", GROUP_BYTES)
    write.mode("errorifexists").parquet(path)
    _write_text(df.sparkSession, path + ".json", json.dumps(metadata | {"complete": True, "clustered_by": cluster_by, "written": datetime.now(timezone.utc).isoformat()}, default=str))
    return path


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A stored table, one file or many; only columns and rows that are asked for are read."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(f"there is no stored result at {path}")
    return spark.read.parquet(path)


def for_each_chunk(df: DataFrame, f: Callable) -> None:
    """Call ``f`` with an iterator of rows for each partition, on the executors."""
    df.foreachPartition(f)


def map_chunks(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """What ``f`` makes of each part of a table: from a pandas frame to a pandas frame of ``schema``, on the executors."""
    return df.mapInPandas(lambda frames: map(f, frames), schema)


def cache_key(df: DataFrame, settings: dict) -> str:
    """Digest of a table, whatever the order of its rows, and of what the search depends on; for a search, of its patterns."""
    h = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    row = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    text = json.dumps({"data": [row["n"], str(row["s"]), row["x"]], "columns": df.dtypes, "settings": settings, "format": FORMAT}, sort_keys=True, default=str)
    return hashlib.md5(text.encode()).hexdigest()


def _entries(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(time, name) of what lies in a folder, oldest first."""
    fs, at = file_system(spark, folder)
    return sorted((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(at)) if fs.exists(at) else []


def load_cache(spark: SparkSession, folder: str, key: str) -> DataFrame | None:
    """The newest table of a key whose description is there, as that is written last."""
    for _, name in reversed(_entries(spark, f"{folder}/{key}")):
        if name.endswith(".json") and json.loads(_read_text(spark, f"{folder}/{key}/{name}")).get("complete") is True:
            return spark.read.parquet(f"{folder}/{key}/{name[:-5]}")
    return None


def save_cache(df: DataFrame, folder: str, key: str, metadata: dict) -> DataFrame:
    """A new table beside older ones of the key, which then go; nothing is renamed, so that any store will do."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    older = [n for _, n in _entries(spark, f"{folder}/{key}") if n.endswith(".json")]
    write_results(df, f"{folder}/{key}/{name}", metadata)
    for n in older:  # the description first: half an entry is none
        for at in (n, n[:-5]):
            fs, path = file_system(spark, f"{folder}/{key}/{at}")
            fs.delete(path, True)
    return spark.read.parquet(f"{folder}/{key}/{name}")


def clean_cache(spark: SparkSession, folder: str) -> list[str]:
    """Remove tables that have no description: of searches that broke off, or still run."""
    gone = []
    for _, key in _entries(spark, folder):
        names = {n for _, n in _entries(spark, f"{folder}/{key}")}
        gone += [f"{key}/{n}" for n in sorted(names) if not n.endswith(".json") and f"{n}.json" not in names]
    for at in gone:
        fs, path = file_system(spark, f"{folder}/{at}")
        fs.delete(path, True)
    return gone


def keep(patterns: DataFrame, build: Callable[[int | None], DataFrame], settings: dict, total: int, storage: str, folder: str | None, cache: str, cache_dir: str | None, best: int | None = None) -> tuple[DataFrame, str | None, bool]:
    """(candidate table, its path if stored, whether it came from the cache).

    The table is made once: it is written to the cache, to ``folder`` or, without one,
    to the shared folder, and read from there.  The cache holds the whole unranked table;
    what depends on how it is shown is done when it is read.  Where nothing is to be
    stored, only the ``best`` rows of each task are made, all if that is None.
    """
    spark = patterns.sparkSession
    key = cache_key(patterns, settings) if cache != "off" else None
    if cache == "reuse" and (found := load_cache(spark, cache_dir, key)) is not None:
        return found, f"{cache_dir}/{key}", True
    if key:
        return save_cache(build(None), cache_dir, key, settings), f"{cache_dir}/{key}", False
    policy = storage_policy(storage, total)
    if policy == "parquet":
        path = results_path(folder or f"{shared_folder(spark)}/results", "search", settings["outcome"], len(settings["items"]), settings["min_items"], settings["max_items"], settings["rank_by"])
        with scratch(spark, results=False):
            write_results(staged(build(None), "unsorted"), path, settings, settings["rank_by"])
        return spark.read.parquet(path), path, False
    return staged(build(best if policy == "none" else None), "results", result=True), None, False


def query_results(source: DataFrame | str | object, spark: SparkSession | None = None, rank_by: str = "youden", top_n: int | None = 20, **conditions: str | None) -> DataFrame:
    """Candidates of a table, path or result that meet all conditions, ranked anew.

    ``top_n`` of None keeps all, 0 none.
    """
    for c in conditions:
        choice(c, CONDITION_COLUMNS, "a condition's column")
    if isinstance(source, str):
        source = read_results(spark or SparkSession.getActiveSession(), source)
    elif not isinstance(source, DataFrame):
        found = getattr(source, "results", None)
        if found is None:
            raise ValueError("the result was not stored; search again with another results_storage")
        source = found
    df = filter_conditions(source, conditions)
    order = result_order(rank_by, df.columns)
    if top_n == 0:
        return ranked(df.drop("rank"), order, 1).limit(0)
    out = ranked(df.drop("rank"), order, top_n)
    return out.select("rank", *[c for c in out.columns if c != "rank"])


def write_csv(spark: SparkSession, folder: str, tables: dict[str, DataFrame | None]) -> list[str]:
    """A CSV file for each table, in any store that Spark writes; a table that isn't there is left out.

    Rows are written by the table's own tasks, in its order, and their files are then joined
    by Hadoop's file system behind one header, a buffer at a time.  A file that doesn't
    come about whole is an error.
    """
    fs, at = file_system(spark, folder)
    if not fs.mkdirs(at):
        raise ValueError(f"can't make {folder}")
    copy, conf = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name, df in tables.items():
        if df is None:
            continue
        parts, target = f"{folder.rstrip('/')}/_{name}-{uuid.uuid4().hex}", f"{folder.rstrip('/')}/{name}.csv"
        df.write.option("header", False).csv(parts)
        fs, at = file_system(spark, parts)
        files = sorted((s.getPath().getName(), s.getPath(), s.getLen()) for s in fs.listStatus(at))
        if not files or files[0][0] != "_SUCCESS":
            raise OSError(f"the parts of {target} aren't complete")
        head = io.StringIO()
        csv.writer(head, lineterminator="\n").writerow(df.columns)
        to = file_system(spark, target)[1]
        stream = fs.create(to, True)
        try:
            stream.write(bytearray(head.getvalue().encode()))
            for _, path, _ in files[1:]:
                source = fs.open(path)
                try:
                    copy(source, stream, conf, False)
                finally:
                    source.close()
        finally:
            stream.close()
        if fs.getFileStatus(to).getLen() != len(head.getvalue().encode()) + sum(n for *_, n in files[1:]):
            raise OSError(f"{target} isn't complete")
        fs.delete(at, True)
        out.append(target)
    return out
