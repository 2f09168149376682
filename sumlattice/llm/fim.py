"""Fill-in-the-middle: whole texts cut at two units and written with the middle last.

Units are counted once, a chunk of bytes at a time.  Every ``STRIDE`` units the count
leaves a checkpoint with its byte and code-point offset, so what a text keeps is in
proportion to its units over STRIDE.  A cut is found by binary search among the
checkpoints and a scan of fewer than STRIDE units behind the one before it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, slices, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("line", "character")
#: Units between two checkpoints, and bytes that are looked at in one step.
STRIDE = 64
CHUNK = 1 << 16
FORMS = "n long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(data: bytes, start: int, stop: int, unit: str) -> np.ndarray:
    """Offsets behind the units that end within ``data[start:stop]``; the text's own end isn't one unless a unit ends there."""
    part = np.frombuffer(data, np.uint8, stop - start, start)
    if unit == "line":
        return np.flatnonzero(part == 10) + start + 1
    # A code point ends before each byte that begins one, and at the end of the text.
    ends = np.flatnonzero((part & 0xC0) != 0x80) + start
    return ends[ends > 0]


def code_points(data: bytes, start: int, stop: int) -> int:
    """Code points that begin within ``data[start:stop]``."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8, stop - start, start) & 0xC0) != 0x80))


class Checkpoints:
    """Number of units of a text and a sparse index of where they end.

    ``units[i]`` units end at byte ``at[i]``, which ``chars[i]`` code points precede.
    """

    def __init__(self, data: bytes, unit: str = "line", stride: int = STRIDE, chunk: int = CHUNK):
        if unit not in UNITS:
            raise ValueError(f"unit must be one of {', '.join(UNITS)}")
        self.data, self.unit, self.stride, self.chunk = data, unit, stride, chunk
        self.units, self.at, self.chars = [0], [0], [0]
        n, chars, last = 0, 0, 0
        for start in range(0, len(data), chunk):
            stop = min(len(data), start + chunk)
            ends = unit_ends(data, start, stop, unit)
            seen = start
            for k in range((-n - 1) % stride, len(ends), stride):
                end = int(ends[k])
                chars += code_points(data, seen, end)
                seen = end
                self.units.append(n + k + 1), self.at.append(end), self.chars.append(chars)
            chars += code_points(data, seen, stop)
            n += len(ends)
            last = int(ends[-1]) if len(ends) else last
        self.n = n + (last < len(data))
        self.n_chars = chars

    def cut(self, units: int) -> tuple[int, int]:
        """(byte, code point) behind the first ``units`` units."""
        if units >= self.n:
            return len(self.data), self.n_chars
        near = bisect_right(self.units, units) - 1
        n, start, chars = self.units[near], self.at[near], self.chars[near]
        at = start
        while n < units:  # fewer than a stride of units, however long they are
            stop = min(len(self.data), start + self.chunk)
            ends = unit_ends(self.data, start, stop, self.unit)
            ends = ends[ends > self.at[near]]
            if n + len(ends) >= units:
                at = int(ends[units - n - 1])
                break
            n, start = n + len(ends), stop
        return at, chars + code_points(self.data, self.at[near], at)


def draws(doc_id: object) -> tuple[int, int, int, int]:
    """The first four 32-bit numbers of the digest of an id; a null id counts as the empty text."""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in range(0, 16, 4))


def rewrite(data: bytes, doc_id: object, unit: str, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle, output) of one text in UTF-8."""
    index = Checkpoints(data, unit)
    h1, h2, h3, h4 = draws(doc_id)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not data or h3 % 100 >= rate or any(x in data for x in (p, s, m)):
        return index.n, "plain", None, None, data
    low, high = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (a, a_chars), (b, b_chars) = index.cut(low), index.cut(high)
    first, middle, rest = data[:a], data[a:b], data[b:]
    spm = h4 % 100 < spm_rate
    out = b"".join((s, rest, p, first, m, middle) if spm else (p, first, s, rest, m, middle))
    return index.n, "spm" if spm else "psm", a_chars, b_chars - a_chars, out


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    A text is cut into ``n`` units, lines or characters, at two places that its id decides;
    ``rate`` of 100 texts are rewritten and ``spm_rate`` of 100 of those with the suffix
    first.  A null text counts as empty; an empty text and one that holds a marker stay
    plain, with null lengths.  Null and repeated ids are rows like others, so that equal
    rows get equal outputs; an empty table gives none.  Other columns aren't read.  A text
    of any length is looked at whole, CHUNK bytes at a time.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [rewrite(text.as_buffer().to_pybytes() if text.is_valid else b"", i, unit, rate, spm_rate) for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()))]
            n, form, first, middle, out = zip(*made) if made else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, {FORMS}")


def _after(text: Column, marker: str) -> tuple[Column, Column]:
    """What stands before and behind a marker's first place."""
    before = F.substring_index(text, marker, 1)
    return before, F.substr(text, F.char_length(before) + F.lit(len(marker) + 1))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of.

    A marker's first place is the one that was written: the text holds none, and none can
    arise where a part meets a marker, as a marker has its ``<`` and ``>`` at its ends only.
    """
    body = F.substr(F.col(output), F.lit(len(PREFIX) + 1))
    one, rest = _after(body, SUFFIX)
    other, middle = _after(rest, MIDDLE)
    psm = F.concat(one, middle, other)
    one, rest = _after(body, PREFIX)
    other, middle = _after(rest, MIDDLE)
    spm = F.concat(other, middle, one)
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form and the digests of its output and of the text rebuilt from that."""
    made = transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
_CUTS = """WITH base AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM base),
cuts AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts"""
ORACLES = {"op11_fill_in_middle": _CUTS}
