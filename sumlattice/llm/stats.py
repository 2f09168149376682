"""Counts over texts and their lines, for whole batches at a time, and labelled samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import crc32_of_id


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


SPACE = _mask(" \t\n\x0b\x0c\r")
SYMBOL = _mask("#*$%&|<>")
UPPER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = _mask("0123456789")
STOP = _mask(".,;:!?")
CONTINUATION = np.zeros(256, bool)
CONTINUATION[128:192] = True


def count(mask: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """How many places of a mask lie between neighbouring bounds."""
    return np.diff(np.searchsorted(np.flatnonzero(mask), bound))


def row_sums(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sum of each row, equal for equal rows; those of a matrix product depend on a row's place."""
    return (x * weights).sum(1)


def repeated(key: np.ndarray, size: int = 8) -> int:
    """Words in windows of ``size`` words that are found twice or more, the first included."""
    h = words.windows(key, size)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    cover = np.zeros(len(key) + 1, np.int64)
    cover[at] += 1
    np.subtract.at(cover, at + size, 1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> list[bool]:
    """For each line with a word whether it equals an earlier line."""
    seen: set[bytes] = set()
    out = []
    for line in text.split(b"\n"):
        if line.strip():
            out.append(line in seen)
            seen.add(line)
    return out


def _shares(w: words.Words, bound: np.ndarray, by_word: np.ndarray) -> np.ndarray:
    """Feature columns for segments of bytes, of which ``by_word`` has the word bounds."""
    code, n = w.data, np.diff(by_word)
    chars = np.maximum(count(~CONTINUATION[code] & ~SPACE[code], bound), 1)
    some = np.maximum(n, 1)
    last = code[np.maximum(w.end - 1, 0)] if len(w.end) else np.zeros(0, np.uint8)
    size = w.end - w.start
    again = np.zeros(len(w.key), bool)
    again[1:] = w.key[1:] == w.key[:-1]
    again[by_word[:-1][n > 0]] = False
    of = lambda flags: count(flags, by_word) / some
    return np.stack([
        np.log1p(n), chars / some / 10,
        count(UPPER[code], bound) / chars, count(DIGIT[code], bound) / chars, count(SYMBOL[code], bound) / chars,
        count(code == 124, bound) / some, count(code == 33, bound) / some, count(STOP[code], bound) / some,
        count(code >= 192, bound) / chars, of(STOP[last]), of(SYMBOL[last] | (last == 33)), of(again), of(size <= 3), of(size >= 14), of(UPPER[code[w.start]] if len(w.start) else again),
    ], 1)


N_SHARES = 15


def line_features(w: words.Words, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, characters in words, features) of each line with a word, in order."""
    start = np.unique(np.concatenate([bound[:-1], np.flatnonzero(w.data == 10) + 1]))
    start = start[start < len(w.data)]
    edge = np.append(start, len(w.data))
    by_word = np.searchsorted(w.start, edge)
    x = _shares(w, edge, by_word)
    chars = count(~CONTINUATION[w.data] & ~SPACE[w.data], edge)
    full = np.diff(by_word) > 0
    return np.searchsorted(bound, start[full], "right") - 1, chars[full], x[full]


def document_features(w: words.Words, bound: np.ndarray) -> np.ndarray:
    """Statistics of each text; zeros stand for texts without words."""
    by_word = w.bound
    x = _shares(w, bound, by_word)
    n = np.maximum(np.diff(by_word), 1)
    data, extra = w.data.tobytes(), []
    lines = count(w.data == 10, bound)
    for i in range(len(w)):
        key = w.of(i)
        dup = duplicate_lines(data[bound[i] : bound[i + 1]])
        extra.append((len(np.unique(key)) / n[i], repeated(key) / n[i], sum(dup) / max(len(dup), 1), np.log1p(n[i] / max(len(dup), 1))))
    return np.concatenate([x, np.array(extra).reshape(-1, 4), (lines / n)[:, None]], 1) * (np.diff(by_word) > 0)[:, None]


N_DOCUMENT = N_SHARES + 5


def held_out(column: str, modulus: int, remainder: int):
    """Whether an id belongs to the rows whose labels are never learnt from."""
    return crc32_of_id(column) % modulus == remainder


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, y, text) of at most ``rows`` labelled documents, those of the least hash of their id.

    Rows without id, or whose label is neither 0 nor 1, are left out, and so are ids
    with labels that disagree.  Of several documents of one id the least text counts, so
    that repeated rows don't raise the bound.  ``keep`` is a condition on the column ``id``.
    """
    own = labels.select(labels[id_col].alias("id"), labels[label].cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    own = own.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").drop("y2")
    if keep is not None:
        own = own.where(keep)
    few = own.orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(rows)
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(few), "id").groupBy("id").agg(F.min("y").alias("y"), F.min("text").alias("text"))
