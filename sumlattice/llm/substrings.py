"""Substring deduplication on a log-structured index of window fingerprints.

The index is a folder of runs: immutable bucketed tables, each sorted by hash, one file a
bucket.  A batch of documents is dealt to the buckets once and merge-joined with each run,
which are neither shuffled nor sorted again; what the batch adds becomes a run, and too
many runs are merged, bucket by bucket.  An index outlives its session: a later
call, given the folder, is deduplicated against all that was added before.  A call's
batches count once all of it is done; what one that broke off left behind isn't read.

Of each window one fingerprint is chosen by its words alone (the least hash of its
sub-windows), so that equal windows choose the same.  Fingerprint runs have those of
all windows ever added, with the document where there has been one only; a window
whose fingerprint was never met before is new.  When a fingerprint is met again, the
windows behind it, of the one earlier document too, whose text the index keeps, go to
window runs, by a hash of 64 bits; a match is verified by 32 bits of an independent hash of the bytes of its words.
Documents that equal an earlier one word for word are removed whole beforehand, on runs
of digests.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import closing, contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import Stage, bound_batches, small, table, with_text

#: Words of the sub-windows from which a window's fingerprint is chosen.
SUB = 6
#: Batches that one call takes its documents in, by id; and runs of a kind that aren't compacted.
BATCHES = 3
MAX_RUNS = 2


def anchors(h: np.ndarray, window: int, sub: int = SUB) -> np.ndarray:
    """For each window of a text, where its chosen sub-window starts: the first least of the hashes ``h`` of its sub-windows."""
    span = window - sub + 1
    if len(h) < span:
        return np.zeros(0, np.int64)
    # Sliding minimum by doubling; ties go left.
    low, at, step = h, np.arange(len(h)), 1
    while step * 2 <= span:
        take = low[step:] < low[:-step]
        low, at = np.where(take, low[step:], low[:-step]), np.where(take, at[step:], at[:-step])
        step *= 2
    n = len(h) - span + 1
    take = low[span - step : span - step + n] < low[:n]
    return np.where(take, at[span - step : span - step + n], at[:n])


def _names(spark: SparkSession, folder: str) -> list[str]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Let Spark take a bucket of one file as sorted, which it does on request only."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Runs:
    """Immutable tables of rows with distinct keys, bucketed and sorted by them, in one folder.

    A run's folder is named after the batches that it holds.  One whose last batch comes
    after ``last`` is left over from a call that broke off and is deleted; so is one
    whose batches another holds as well.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], last: int):
        self.spark, self.folder, self.schema, self.keys = spark, folder, schema, keys
        self.tables: dict[str, str] = {}
        found = _names(spark, folder)
        span = {n: tuple(map(int, n.split("-")[1:3])) for n in found}
        whole = [n for n in found if span[n][1] <= last]
        self.names = sorted(n for n in whole if not any(m != n and span[m][0] <= span[n][0] and span[n][1] <= span[m][1] for m in whole))
        self.old = [n for n in found if n not in self.names]
        self.tidy()

    def read(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = f"run_{uuid.uuid4().hex}"
            by = ", ".join(self.keys)
            self.spark.sql(f"CREATE TABLE {self.tables[name]} ({self.schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {int(name.split('-')[3])} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(self.tables[name])

    def every(self) -> list[DataFrame]:
        return [self.read(n) for n in self.names]

    def _write(self, rows: DataFrame, first: int, last: int) -> str:
        """Rows that were dealt by key are written where they are, as they then lie by bucket."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"run-{first:06d}-{last:06d}-{buckets}"
        self.tables[name] = f"run_{uuid.uuid4().hex}"
        rows.write.bucketBy(buckets, *self.keys).sortBy(*self.keys).option("path", f"{self.folder}/{name}").saveAsTable(self.tables[name])
        return name

    def add(self, rows: DataFrame) -> DataFrame:
        number = 1 + max((int(n.split("-")[2]) for n in self.names), default=0)
        self.names.append(self._write(rows, number, number))
        # Read without its buckets, so that Spark can split the batch's frequent keys in joins with it.
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{self.names[-1]}")

    def compact(self, most: int, *values: Column) -> None:
        """Merge neighbours of least size until ``most`` runs are left.

        ``values`` are the other columns of a key, of its rows ``a`` and ``b`` in the older
        and the newer run.  Runs are merge-joined: a union of bucketed tables isn't
        shuffled before an aggregate by Spark 4.1, though its parts lie in different tasks,
        and leaves a key in several rows.
        """
        while len(self.names) > most:
            size = [self._bytes(n) for n in self.names]
            k = min(range(len(size) - 1), key=lambda k: size[k] + size[k + 1])
            a, b = self.names[k : k + 2]
            same = [F.col(f"a.{x}") == F.col(f"b.{x}") for x in self.keys]
            both = self.read(a).alias("a").join(self.read(b).alias("b").hint("merge"), same, "full")
            rows = both.select(*(F.coalesce(f"a.{x}", f"b.{x}").alias(x) for x in self.keys), *values)
            self.names[k : k + 2] = [self._write(rows, int(a.split("-")[1]), int(b.split("-")[2]))]
            self.forget(a, b)
            self.old += [a, b]

    def _bytes(self, name: str) -> int:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()

    def tidy(self) -> None:
        """Delete runs that others hold as well."""
        for n in self.old:
            _delete(self.spark, f"{self.folder}/{n}")
        self.old = []

    def forget(self, *names: str) -> None:
        """Take runs off the session's catalog; their files stay."""
        for n in names or [*self.tables]:
            if n in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(n)}")


class FingerprintIndex:
    """Fingerprints, repeated windows, digests and texts of all documents added so far, in ``folder``.

    It has one writer at a time.  Batches count from ``commit`` on.  With ``keep`` false
    the index serves one call only: it keeps no texts, and merged runs go at once.
    """

    def __init__(self, spark: SparkSession, folder: str, window: int = 20, max_runs: int = MAX_RUNS, keep: bool = True):
        self.spark, self.folder, self.window, self.max_runs, self.keep = spark, folder, window, max_runs, keep
        last = self.batch = max(map(int, _names(spark, f"{folder}/done")), default=0)
        self.fingerprints = Runs(spark, f"{folder}/fingerprints", "key BIGINT, doc BIGINT, was BIGINT", ["key"], last)
        self.windows = Runs(spark, f"{folder}/windows", "key BIGINT, check INT, doc BIGINT, pos INT, hist BOOLEAN, again BOOLEAN", ["key", "check"], last)
        self.wholes = Runs(spark, f"{folder}/wholes", "whole BINARY, first BIGINT, hist BOOLEAN", ["whole"], last)
        self.kinds = (self.fingerprints, self.windows, self.wholes)
        for name in _names(spark, f"{folder}/texts"):
            if int(name) > last:
                _delete(spark, f"{folder}/texts/{name}")

    def texts(self) -> DataFrame | None:
        """(id, text) of the documents added so far, but whole copies and those too short for a window."""
        paths = [f"{self.folder}/texts/{n}" for n in _names(self.spark, f"{self.folder}/texts")]
        return self.spark.read.schema("id long, text string").parquet(*paths) if paths else None

    def add(self, stage: Stage, docs: DataFrame, texts: DataFrame, history: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Add a batch; (id, whole) of its whole copies and (id, starts) of its other repeated windows.

        ``docs`` has what ``_documents`` tells of the batch, ``texts`` its (id, text), and
        ``history`` those of all earlier batches, where the index doesn't keep them.  What is in the index goes before the
        batch; within the batch smaller ids go first.
        """
        history = self.texts() if self.keep else history
        self.batch += 1
        long = docs.where(f"n >= {self.window} AND id IS NOT NULL")
        first = long.groupBy("whole").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        for k, run in enumerate(self.wholes.every()):
            first = first.join(run.select("whole", F.lit(True).alias(f"there{k}")), "whole", "left")
        hist = F.coalesce(*(F.col(f"there{k}") for k in range(len(self.wholes.names))), F.lit(False))
        first = self.wholes.add(first.select("whole", F.when(hist | (F.col("first") < F.col("last")), F.col("first")).alias("first"), hist.alias("hist")))
        twice = first.where("first IS NOT NULL").withColumnRenamed("first", "first_id")
        copies = stage.write(long.select("id", "whole").join(twice, "whole").where("hist OR id > first_id").select("id", "whole").distinct(), "copies")

        cells = long.join(small(copies), ["id", "whole"], "left_anti").select("id", F.explode("anchors").alias("key"))
        seen = cells.groupBy("key").agg(F.min("id").alias("doc"), F.count("*").alias("n"))
        runs = self.fingerprints.every()
        for k, run in enumerate(runs):
            seen = seen.join(run.select("key", F.col("doc").alias(f"doc{k}"), F.lit(True).alias(f"there{k}")), "key", "left")
        known = F.coalesce(*(F.col(f"there{k}") for k in range(len(runs))), F.lit(False))
        # Of several documents their windows are in the window runs already.
        met = [F.coalesce(F.col(f"there{k}") & F.col(f"doc{k}").isNull(), F.lit(False)) for k in range(len(runs))]
        many = F.greatest(*met, F.lit(False), F.lit(False))
        one = F.coalesce(*(F.col(f"doc{k}") for k in range(len(runs))), F.lit(None).cast("long"))
        seen = self.fingerprints.add(seen.select("key", F.when((F.col("n") == 1) & ~known, F.col("doc")).alias("doc"), F.when(known & ~many, one).alias("was")))
        repeated = seen.where("doc IS NULL")
        hit = stage.write(cells.join(repeated.select("key"), "key").groupBy("id").agg(F.collect_set("key").alias("repeated")), "hit")  # of one document: no more than its words
        own = texts.join(small(hit.select("id")), "id").join(hit, "id")
        found = _windows(own, self.window).withColumn("hist", F.lit(False))
        if history is not None and runs:
            was = stage.write(repeated.where("was IS NOT NULL").groupBy(F.col("was").alias("id")).agg(F.collect_set("key").alias("repeated")), "was")
            found = found.unionByName(_windows(history.join(small(was.select("id")), "id").join(was, "id"), self.window).withColumn("hist", F.lit(True)))
        found = stage.write(found, "windows")

        seen = found.groupBy("key", "check").agg(F.min(F.when(~F.col("hist"), F.struct("id", "pos"))).alias("first"), F.count("*").alias("n"), F.max("hist").alias("hist"))
        runs = self.windows.every()
        for k, run in enumerate(runs):
            seen = seen.join(run.select("key", "check", F.lit(True).alias(f"there{k}")), ["key", "check"], "left")
        hist = F.col("hist") | F.coalesce(*(F.col(f"there{k}") for k in range(len(runs))), F.lit(False))
        seen = self.windows.add(seen.select("key", "check", F.col("first.id").alias("doc"), F.col("first.pos").alias("pos"), hist.alias("hist"), (hist | (F.col("n") > 1)).alias("again")))
        late = found.where("NOT hist").drop("hist").join(seen.where("again").select("key", "check", "hist", F.struct("doc", F.col("pos").alias("at")).alias("first")), ["key", "check"])
        late = late.where(F.col("hist") | (F.struct("id", "pos") > F.col("first"))).groupBy("id").agg(F.collect_list("pos").alias("starts"))
        late = stage.write(late, "late")
        stage.drop(found, hit)
        if self.keep:
            own = stage.write(long.join(small(copies), ["id", "whole"], "left_anti").select("id").distinct(), "own")
            texts.join(small(own), "id", "left_semi").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/texts/{self.batch:06d}")
        self.compact()
        stage.release()
        return copies, late

    def compact(self) -> None:
        true, none = F.lit(True), F.lit(None).cast("long")
        one = F.when(F.col("a.key").isNull() | F.col("b.key").isNull(), F.coalesce("a.doc", "b.doc"))
        self.fingerprints.compact(self.max_runs, one.alias("doc"), none.alias("was"))
        self.windows.compact(self.max_runs, none.alias("doc"), F.lit(None).cast("int").alias("pos"), true.alias("hist"), true.alias("again"))
        self.wholes.compact(self.max_runs, none.alias("first"), true.alias("hist"))
        if not self.keep:
            self._tidy()

    def commit(self) -> None:
        """From now on all batches added count, whatever happens to the session."""
        self.spark.range(0).write.mode("overwrite").parquet(f"{self.folder}/done/{self.batch:06d}")
        self._tidy()

    def _tidy(self) -> None:
        for runs in self.kinds:
            runs.tidy()

    def close(self) -> None:
        for runs in self.kinds:
            runs.forget()


def _documents(texts: DataFrame, window: int) -> DataFrame:
    """(id, n, digest, whole, anchors): words, SHA-256 of the words joined by spaces, a digest and the anchors' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.grouped(batches, 1):
            w = words.find(b.column(1))
            _, bound = words.buffers(b.column(1))
            data, n, digest, whole, found = w.data.tobytes(), [], [], [], []
            for i, sub in enumerate(w.windows(SUB)):
                joined = b" ".join(data[bound[i] : bound[i + 1]].split())
                n.append(len(w.of(i))), digest.append(hashlib.sha256(joined).hexdigest()), whole.append(_digest(joined))
                found.append(sub[np.unique(anchors(sub, window))].view(np.int64))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest), pa.array(whole, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "n", "digest", "whole", "anchors"])

    return texts.select("id", "text").mapInArrow(run, "id long, n long, digest string, whole binary, anchors array<long>")


def _windows(own: DataFrame, window: int) -> DataFrame:
    """(key, check, id, pos) of the windows whose anchor is among ``repeated``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.grouped(batches, 1, 1 << 18):
            w, other = words.find(b.column(1)), words.find(b.column(1), base=1)
            keys, checks, ids, places = [], [], [], []
            for doc, repeated, key, sub, h, check in zip(b.column(0).to_pylist(), b.column(2), map(w.of, range(len(w))), w.windows(SUB), w.windows(window), other.windows(window, 1)):
                again = np.unique(repeated.values.to_numpy()).view(np.uint64)
                pos = np.flatnonzero(np.isin(sub[anchors(sub, window)], again))
                keys.append(h[pos]), checks.append((check[pos] >> np.uint64(32)).astype(np.uint32)), places.append(pos), ids.append(np.full(len(pos), doc))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(checks).view(np.int32)), pa.array(np.concatenate(ids).astype(np.int64)), pa.array(np.concatenate(places).astype(np.int32))], ["key", "check", "id", "pos"])

    return own.select("id", "text", "repeated").mapInArrow(run, "key long, check int, id long, pos int")


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """(id, whole, n_removed, digest, kept) from (id, text, starts of windows to remove)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.grouped(batches, 1):
            whole, removed, digest, kept = [], [], [], []
            for text, starts in zip(b.column(1).to_pylist(), b.column(2)):
                found = (text or "").encode().split()
                cover = np.zeros(len(found) + 1, np.int64)
                at = np.unique(starts.values.to_numpy())
                at = at[at + window <= len(found)]
                np.add.at(cover, at, 1), np.add.at(cover, at + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                left = b" ".join([x for x, g in zip(found, gone.tolist()) if not g])
                whole.append(_digest(b" ".join(found))), removed.append(int(gone.sum())), digest.append(hashlib.sha256(left).hexdigest()), kept.append(left.decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(whole, pa.binary()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept)], ["id", "whole", "n_removed", "digest", "kept"])

    return texts.select("id", "text", "starts").mapInArrow(run, "id long, whole binary, n_removed long, digest string, kept string")


def _digest(joined: bytes) -> bytes:
    return hashlib.blake2b(joined, digest_size=16).digest()


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, batches: int = BATCHES, index: str | None = None) -> DataFrame:
    """(doc_id, whole, n_words, n_removed, kept_sha256, kept) of every document.

    A word goes if a window of ``window`` words that covers it starts earlier too, in
    a document of smaller id or further up in its own.  ``kept`` is what is left, words
    joined by one space, where something was removed, else null; ``whole`` is a digest of
    the document's words.  A null text has no words, and texts may be of any length.  Rows
    that repeat an id and a text are alike and none of them is the earlier one; if an id
    has several texts, what repeats in one of them goes from all at that place.  Rows
    without id are kept whole and are no source.  Extra columns aren't read; an empty
    table gives no rows.

    With a folder ``index`` the documents are added to the index there, and all that
    earlier calls added goes before them.  A call that fails adds nothing and can be made
    again; calls on one folder go one after another.
    """
    bound_batches(spark)
    stage = Stage(spark, "substrings")
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    every = stage.write(_documents(texts, window), "documents")
    edges = every.where("id IS NOT NULL").approxQuantile("id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    bounds = [None, *sorted({*map(int, edges)}), None]
    copies = dup = None
    with closing(FingerprintIndex(spark, index or f"{stage.root}/index", window, keep=index is not None)) as runs, _sorted_buckets(spark):
        for lo, hi in zip(bounds, bounds[1:]):
            within = F.lit(True) if lo is None else F.col("id") > lo
            within = within if hi is None else within & (F.col("id") <= hi)
            before = None if lo is None else texts.where(F.col("id") <= lo)
            found = runs.add(stage, every.where(within), texts.where(within), before)
            copies, dup = found if dup is None else (copies.unionByName(found[0]), dup.unionByName(found[1]))
        cut = texts.join(small(dup.select("id")), "id").join(dup, "id")
        changed = stage.write(_cut(cut, window), "changed").dropDuplicates(["id", "whole"])
        changed = changed.select("id", "whole", F.col("n_removed").alias("r"), F.col("digest").alias("d"), F.col("kept").alias("k"))
        out = every.select("id", "n", "digest", "whole").join(small(copies).withColumn("copy", F.lit(True)), ["id", "whole"], "left").join(changed, ["id", "whole"], "left")
        nothing = hashlib.sha256(b"").hexdigest()
        out = out.select(
            F.col("id").alias("doc_id"), "whole", F.col("n").alias("n_words"),
            F.when(F.col("copy"), F.col("n")).otherwise(F.coalesce("r", F.lit(0))).alias("n_removed"),
            F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("d", "digest")).alias("kept_sha256"),
            F.when(F.col("copy"), F.lit("")).otherwise(F.col("k")).alias("kept"),
        )
        out = stage.finish(out)
        if index is not None:
            runs.commit()
    if index is None:
        stage.delete(f"{stage.root}/index")
    return out


def without_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """All rows, with what ``dedup`` keeps of their texts; texts in which nothing repeats stay as they are.

    So do null and empty texts and rows without id.  Of repeated rows of one id and text all
    are treated alike.  A very long text is read whole; other columns stay.
    """
    stage = Stage(spark, "without-repeats")
    found = dedup(spark, docs, id_col, text_col, window).where("n_removed > 0").select(F.col("doc_id").alias(id_col), F.struct("whole", "kept").alias("new"))
    found = stage.write(found.groupBy(id_col).agg(F.collect_set("new").alias("new_texts")), "changed")  # one for each text of an id
    ids = small(stage.write(found.select(id_col), "ids"))
    same = docs.join(ids, id_col, "left_anti")
    changed = docs.join(ids, id_col, "left_semi").join(found, id_col)
    schema, at = changed.schema, changed.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.grouped(batches, at):
            new = []
            for text, texts in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                by = {x["whole"]: x["kept"] for x in texts}
                new.append(by.get(_digest(b" ".join((text or "").encode().split())), text))
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    changed = changed.mapInArrow(run, schema).select(*docs.columns)
    return same.select(*docs.columns).unionByName(with_text(changed, F.col(text_col), text_col).select(*docs.columns))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and digest of what is left of every document, for windows of 20 words."""
    return dedup(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES = {
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM win) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
own AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM own ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
}
