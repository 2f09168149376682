"""WARC archives: a writer of one gzip member per record and a sequential reader.

An archive is a table of segments, each a run of whole gzip members, so that any
store that Spark writes can hold it; joined in order, the segments of an archive
are an ordinary ``.warc.gz`` file.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, slices, table

#: Payloads from so many bytes on are stored once.
REVISIT_BYTES = 100
SEGMENT_BYTES = 4 << 20
CHUNK = 1 << 16
_LINE = re.compile(r"[\x00-\x20\x7f]")


class WarcError(ValueError):
    """An archive that is cut off, badly framed or whose digests don't hold."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def _urn(page: object) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit, which leaves the payload out."""
    digest = hashlib.sha256(payload).hexdigest()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_LINE.sub(lambda m: f'%{ord(m[0]):02X}', url) if url else 'about:blank'}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{digest if not block else hashlib.sha256(block).hexdigest()}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[-1:-1] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


class _Members:
    """Gzip members of a stream of chunks, inflated a CHUNK at a time and no further than was asked for."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.packed = filter(None, chunks), b""
        self.inflate, self.plain = zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        """Inflate some bytes of the member; false at its end."""
        while not self.inflate.eof:
            self.packed = self.packed or next(self.chunks, b"")
            try:
                made = self.inflate.decompress(self.packed, CHUNK)
            except zlib.error as e:
                raise WarcError(f"damaged gzip member: {e}") from e
            if not made and not self.packed and not self.inflate.eof:
                raise WarcError("the last gzip member is cut off")
            self.packed = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if made:
                self.plain += made
                return True
        return False

    def next(self) -> bool:
        """Go to the next member; false where the archive ends."""
        self.inflate, self.plain = zlib.decompressobj(31), bytearray()
        self.packed = self.packed or next(self.chunks, b"")
        return bool(self.packed)

    def until(self, end: bytes) -> bytes:
        """What stands before ``end``, which is passed over."""
        seen = 0
        while (at := self.plain.find(end, max(0, seen - len(end)))) < 0:
            seen = len(self.plain)
            if not self.more():
                raise WarcError(f"not a record: {bytes(self.plain[:80])!r}")
        out = bytes(self.plain[:at])
        del self.plain[: at + len(end)]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, piece by piece."""
        while n:
            if not self.plain and not self.more():
                raise WarcError("the member ends before its content length")
            piece = bytes(self.plain[:n])
            del self.plain[: len(piece)]
            n -= len(piece)
            yield piece


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"not a header: {line[:80]!r}")
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def read_records(chunks: Iterable[bytes]) -> Iterator[Record]:
    """Records of an archive, one after the other, framed by Content-Length and checked by digest.

    A record's block is digested as it is inflated; a revisit, which has no payload, is
    checked by ``checked`` against the response that it names.
    """
    members = _Members(chunks)
    while members.next():
        first, *lines = members.until(b"\r\n\r\n").split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise WarcError(f"not a record: {first[:80]!r}")
        headers = _headers(lines)
        if not re.fullmatch(r"\d+", headers.get("content-length", "")):
            raise WarcError("no content length")
        n, digest, pieces = int(headers["content-length"]), hashlib.sha256(), []
        for piece in members.exactly(n):
            digest.update(piece)
            pieces.append(piece)
        while members.more():
            if len(members.plain) > 4:
                break
        if members.plain != b"\r\n\r\n":
            raise WarcError(f"content length {n} doesn't frame the record")
        record = Record(headers, b"".join(pieces))
        if (said := headers.get("warc-block-digest")) and said != f"sha256:{digest.hexdigest()}":
            raise WarcError(f"block digest of {headers.get('warc-record-id')} doesn't hold")
        if headers.get("content-type", "").startswith("application/http"):
            http, _, record.payload = record.block.partition(b"\r\n\r\n")
            record.http = _headers(http.split(b"\r\n")[1:])
        if headers.get("warc-type") == "response" and headers.get("warc-payload-digest") != f"sha256:{hashlib.sha256(record.payload).hexdigest()}":
            raise WarcError(f"payload digest of {headers.get('warc-record-id')} doesn't hold")
        yield record


def archives(pages: DataFrame) -> DataFrame:
    """(archive, segment, data) from rows (page_id, url, payload, refers_to), an archive for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, parts, size = f"part-{TaskContext.get().partitionId():06d}", 0, [], 0

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int32()), pa.array([b"".join(parts)], pa.binary())], ["archive", "segment", "data"])

        for b in slices(batches, 64):
            for r in b.to_pylist():
                parts.append(write_record(r["page_id"], r["url"], r["payload"], r["refers_to"]))
                size += len(parts[-1])
                if size >= SEGMENT_BYTES:
                    yield segment()
                    n, parts, size = n + 1, [], 0
        if parts:
            yield segment()

    return pages.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "archive string, segment int, data binary")


def export(archive_table: DataFrame, folder: str) -> list[str]:
    """Write archives as local ``.warc.gz`` files, for looking at a few of them."""
    out: dict[str, None] = {}
    for r in archive_table.orderBy("archive", "segment").toLocalIterator():
        at = Path(folder, f"{r['archive']}.warc.gz")
        with at.open("ab") as f:
            f.write(r["data"])
        out[str(at)] = None
    return [*out]


def read_archives(archive_table: DataFrame) -> DataFrame:
    """A row for each record of the archives, in what order they come."""

    def page(urn: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(m[1]) if m else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            data = memoryview(b.column("data")[0].as_buffer())
            out: list[tuple] = []
            for r in read_records(bytes(data[at : at + CHUNK]) for at in range(0, len(data), CHUNK)):
                h = r.headers
                out.append((page(h.get("warc-record-id")), int(r.http["content-length"]), h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"], page(h.get("warc-refers-to"))))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archive_table.select("data").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def checked(spark: SparkSession, records: DataFrame) -> DataFrame:
    """The records, read once; a revisit whose response is missing or has another digest or length is an error.

    Of several responses of one id one must agree.  Only revisits and the responses
    that they name meet, by id and digest.  No records are no error.
    """
    stage = Stage(spark, "warc-records")
    records = stage.write(records, "records")
    key = ["refers_to", "payload_digest", "payload_bytes"]
    named = records.where("record_type = 'revisit'").select(*key).distinct()
    there = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), *key[1:])
    lost = named.join(there, key, "left_anti").limit(1).collect()
    if lost:
        raise WarcError(f"no response of page {lost[0]['refers_to']} has the digest and length that its revisit states")
    return records


def write_archives(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """The archive table of these pages, payloads of REVISIT_BYTES and more stored once.

    A null text has an empty payload, a null url the target about:blank.  Of rows of
    one id and payload each is a response if one is.  Rows with a null id are always
    responses and no row refers to them.  A text may be of any length that a row can have.
    Extra columns aren't read; an empty table gives an empty archive table.
    """
    stage = Stage(spark, "warc")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), F.encode(F.coalesce(pages[text_col], F.lit("")), "UTF-8").alias("payload"))
    digests = stage.write(rows.where((F.octet_length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", F.unhex(F.sha2("payload", 256)).alias("digest")), "digests")
    first = stage.write(digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to"), "first")
    again = stage.write(digests.join(first, "digest").where("page_id > refers_to").distinct(), "revisits")
    # A page's own digest tells repeated ids with different payloads apart.
    marked = rows.withColumn("digest", F.unhex(F.sha2("payload", 256))).join(again, ["page_id", "digest"], "left")
    return stage.write(archives(marked), "archives", compression="none")


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives that were written of all of them."""
    return checked(spark, read_archives(write_archives(spark, table(spark, sf_dir, "pages"))))


QUERIES = {"op10_warc_round_trip": op10_warc_round_trip}
ORACLES = {
    "op10_warc_round_trip": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM f"""
}
