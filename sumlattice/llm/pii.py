"""Personal data, also where it is disguised, with spans in the text as it is.

Plain patterns find the base spans.  For disguises a chain of transducers rewrites
the text: homoglyphs and other widths to ASCII and invisible characters to nothing,
spelled digits to digits, at and dot in brackets to their signs, and at and dot in
words within an address, which a table of states over words, gaps and signs reads from
end to end.  Each output character keeps the span of source characters it came from, so
what the patterns find in the rewritten text maps back to the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import table, with_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive, and not from within a run of digits: the same matches without going back.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def find_plain(text: str) -> list[Span]:
    """Base spans, leftmost and non-overlapping within each kind, by start and then kind."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        done = 0
        for m in _AT_DOMAIN.finditer(text):
            at = m.start()
            while at > done and text[at - 1] in _LOCAL:
                at -= 1
            if at < m.start():
                out.append((at, 0, m.end()))
                done = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _NO_DIGIT.sub("", m[0])) <= 19 and _luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


#: Letters of other scripts that look like Latin ones.
_ALIKE = {
    **dict(zip("аАВсСеЕНіІјЈкКМоОрРѕЅТуУхХԁԛԚԝԜһҺӏӀѵѴгԍԌҽӨ", "aABcCeEHiIjJkKMoOpPsSTyYxXdqQwWhHlIvVrGGeO")),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυγκτωϲϳ", "ABEZHIKMNOPTYXaivopuyktwcj")),
    **dict(zip("օսոհցՕՍԼ", "ounhgOUL")),
    **dict(zip("ɑɡıȷɩʏᴄᴏᴠᴡᴢ", "agijiycovwz")),
    **dict(zip("‐‑‒–−․。｡", "-----...")),
}
#: Digits in words.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: The signs @ and . in words; ``at`` is a word of prose too, and so is ``point``.
_AT_WORDS = ("at", "arroba", "arobase", "arrobase", "arobas", "klammeraffe")
_DOT_WORDS = ("dot", "point", "punto", "punkt")
#: Ends of domains that aren't words of English prose.
_TOP = frozenset("com org net edu gov mil info biz io co app dev eu de fr es uk ca ch nl pt pl se dk fi ie mx ar cl pe br ru jp cn au nz".split())
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


@cache
def _plain_char(c: str) -> str | None:
    """What a character stands for in ASCII, None for itself."""
    if c < "\x80":
        return None
    if c in _INVISIBLE:
        return ""
    if c in _ALIKE:
        return _ALIKE[c]
    if (d := unicodedata.decimal(c, -1)) >= 0:
        return str(d)
    if unicodedata.category(c) == "Zs":
        return " "
    k = unicodedata.normalize("NFKC", c)
    return k if len(k) == 1 and k < "\x80" else None


@dataclass
class Mapped:
    """A text and its offset tape, which is made at the first edit.

    Character i came from source characters lo[i] to hi[i]; ``made`` marks rewritten ones.
    """

    text: str
    lo: list[int] = field(default_factory=list)
    hi: list[int] = field(default_factory=list)
    made: list[bool] = field(default_factory=list)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace spans, given in order and without overlap; each new character maps to its whole span."""
        if not edits:
            return self
        if not self.lo:
            n = len(self.text)
            self.lo, self.hi, self.made = [*range(n)], [*range(1, n + 1)], [False] * n
        text, lo, hi, made, at = [], [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            lo += self.lo[at:a] + [self.lo[a]] * len(new)
            hi += self.hi[at:a] + [self.hi[b - 1]] * len(new)
            made += self.made[at:a] + [True] * len(new)
            at = b
        return Mapped("".join([*text, self.text[at:]]), lo + self.lo[at:], hi + self.hi[at:], made + self.made[at:])


_NOT_ASCII = re.compile(r"[^\x00-\x7f]")
# By first letters, as a pattern of some fifty words would try each of them at each word.
_FIRST = "".join(sorted({w[0] for w in _DIGIT_WORDS}))
_NUMBER = "|".join(f"{c}(?:{'|'.join(sorted((w[1:] for w in _DIGIT_WORDS if w[0] == c), key=len, reverse=True))})" for c in _FIRST)
_DOTS = "|".join(_DOT_WORDS)
_SPELT = re.compile(rf"\b(?=[0-9{_FIRST}])(?:{_NUMBER}|[0-9]+)(?:(?:[\s,-]+|\s*\b(?:{_DOTS})\b\s*|\.)(?:{_NUMBER}|[0-9]+)\b)+", re.I)
_TOKEN = re.compile(rf"(?P<word>{_NUMBER})|(?P<digits>[0-9]+)|(?P<dot>{_DOTS}|\.)|(?P<gap>[\s,-]+)", re.I)
_PLUS = re.compile(r"\b(?:plus|más|mas)\s+(?=[0-9])", re.I)
_BRACKET = re.compile(rf"[\[({{<]\s*(?:(?P<at>{'|'.join(_AT_WORDS)}|@)|(?:{_DOTS}|\.))\s*[\])}}>]\s*", re.I)
_SAID = re.compile(rf"\b(?:{_DOTS}|{'|'.join(_AT_WORDS[1:])})\b", re.I)
_PIECE = re.compile(r"(?P<atom>[A-Za-z0-9_%+-]+)|(?P<gap>\s+)|(?P<sign>[@.])|(?P<other>[^\sA-Za-z0-9_%+@.-]+)")
#: The address transducer: what follows a state and a piece.  Without an entry the address ends.
_NEXT = {
    ("start", "atom"): "local", ("local", "."): "local dot", ("local dot", "atom"): "local", ("local", "gap"): "local gap",
    ("local gap", "dot"): "local dot said", ("local dot said", "gap"): "local dot", ("local", "@"): "at", ("local gap", "at"): "at said",
    ("at said", "gap"): "at", ("at", "atom"): "domain", ("domain", "."): "domain dot", ("domain dot", "atom"): "domain",
    ("domain", "gap"): "domain gap", ("domain gap", "dot"): "domain dot said", ("domain dot said", "gap"): "domain dot",
}
_CLASS = {**dict.fromkeys(_AT_WORDS, "at"), **dict.fromkeys(_DOT_WORDS, "dot")}


def _homoglyphs(m: Mapped) -> Mapped:
    """Characters to the ASCII ones that they look like or stand for, invisible ones to nothing."""
    if m.text.isascii() or all(_plain_char(c) is None for c in set(m.text)):
        return m
    return m.rewrite([(x.start(), x.end(), new) for x in _NOT_ASCII.finditer(m.text) if (new := _plain_char(x[0])) is not None])


def _spelt_digits(m: Mapped) -> Mapped:
    """Two digits in words or more in a row, and words joined by dots: to digits, with a dot in words to its sign.

    A single word beside digits stays, as it is mostly an article (``555-1373 Un``).  Gaps
    go between two words and beside a dot, and become a blank between a word and digits,
    so that words before a number in digits don't lengthen its first part.
    """
    edits = []
    for run in _SPELT.finditer(m.text):
        tokens = [*_TOKEN.finditer(m.text, run.start(), run.end())]
        kinds = [t.lastgroup for t in tokens]
        if "word" not in kinds:
            continue
        # A word's neighbours beyond gaps, which stand neither first nor last.
        solid = [i for i, k in enumerate(kinds) if k != "gap"]
        near = {i: [*solid[max(0, n - 1) : n], *solid[n + 1 : n + 2]] for n, i in enumerate(solid)}
        digits = {i for i in solid if kinds[i] == "word" and (any(kinds[k] == "word" or kinds[k] == "dot" and tokens[k][0] != "." for k in near[i]) or [kinds[k] for k in near[i]] == ["dot", "dot"])}
        kinds = ["prose" if k == "word" and i not in digits else k for i, k in enumerate(kinds)]
        for i, (t, kind) in enumerate(zip(tokens, kinds)):
            if kind == "word":
                edits.append((t.start(), t.end(), _DIGIT_WORDS[t[0].lower()]))
            elif kind == "dot" and t[0] != ".":
                edits.append((t.start(), t.end(), "."))
            elif kind == "gap":
                beside = {kinds[i - 1], kinds[i + 1]}
                if beside == {"word"} or "dot" in beside:
                    edits.append((t.start(), t.end(), ""))
                elif "word" in beside and t[0] not in (" ", "-"):
                    edits.append((t.start(), t.end(), " "))
    m = m.rewrite(edits)
    return m.rewrite([(x.start(), x.end(), "+") for x in _PLUS.finditer(m.text)])


def _brackets(m: Mapped) -> Mapped:
    """At and dot in brackets, with blanks around them, to their signs, wherever they stand."""
    edits, done = [], 0
    for x in _BRACKET.finditer(m.text):
        at = x.start()
        while at > done and m.text[at - 1].isspace():
            at -= 1
        done = x.end()
        edits.append((at, done, "@" if x["at"] else "."))
    return m.rewrite(edits)


class _Address:
    """An address being read: the signs that its words would become, and how far it is whole."""

    def __init__(self) -> None:
        self.edits: list[tuple[int, int, str]] = []
        self.whole = 0  # edits of the longest whole address so far
        self.at, self.said, self.written = "@", set[str](), False

    def ends(self, label: str) -> None:
        """A label of the domain was read; the address is whole if its words can mean one.

        ``arroba`` and its like need no other evidence.  ``at`` needs a dot in words, and where
        that is ``point`` a usual end of a domain; so does a written address that words go on.
        """
        sure = label.lower() in _TOP
        if self.at == "at":
            good = bool(self.said) and (sure or "point" not in self.said)
        elif self.at == "@":
            good = bool(self.said) and (sure or not self.written and "point" not in self.said)
        else:
            good = bool(self.said) or self.written
        if good:
            self.whole = len(self.edits)


def _addresses(m: Mapped) -> Mapped:
    """At and dot in words, bare, to their signs within what is an address from end to end."""
    if not m.lo and not _SAID.search(m.text):
        return m
    edits: list[tuple[int, int, str]] = []
    state, now, begin, word = "start", _Address(), 0, ""
    for piece in _PIECE.finditer(m.text):
        kind, text = str(piece.lastgroup), piece[0]
        kind = text if kind == "sign" else "other" if kind == "gap" and len(text) > 2 else kind
        low = text.lower()
        said = _CLASS.get(low) if kind == "atom" else None
        to = _NEXT.get((state, said)) if said else None
        to = to or _NEXT.get((state, kind))
        if to is None:
            # The address ends before this piece; the last label may be the next one's local part.
            edits += now.edits[: now.whole]
            taken = now.whole > 0
            now = _Address()
            state = state.replace("domain", "local") if state in ("domain", "domain gap") and not taken else "start"
            to = (_NEXT.get((state, said)) if said else None) or _NEXT.get((state, kind)) or _NEXT.get(("start", kind), "start")
        if to.endswith(" gap"):
            begin = piece.start()
        elif to.endswith(" said"):
            word = low
        elif state.endswith(" said"):
            now.edits.append((begin, piece.end(), "@" if to == "at" else "."))
            if to == "at":
                now.at = word
            elif to == "domain dot":
                now.said.add(word)
        elif to == "domain dot" and m.lo and m.made[piece.start()]:
            now.said.add("dot")  # in brackets or another script
        elif to == "domain dot":
            now.written = True
        elif to == "domain" and state == "domain dot":
            now.ends(text)
        state = to
    return m.rewrite(edits + now.edits[: now.whole])


#: The chain of transducers; each reads what the one before it wrote.
CHAIN = (_homoglyphs, _spelt_digits, _brackets, _addresses)


def find_disguised(text: str) -> list[Span]:
    """Spans that the patterns find only after rewriting, in source characters."""
    m = plain = Mapped(text)
    for transducer in CHAIN:
        m = transducer(m)
    if m is plain:
        return []
    return [(kind, m.lo[a], m.hi[b - 1]) for kind, a, b in find_plain(m.text) if any(m.made[a:b]) or m.hi[b - 1] - m.lo[a] != b - a]


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: those of the rewritten text join them that don't lie in a base span of their kind."""
    base = find_plain(text)
    more = [x for x in find_disguised(text) if not any(x[0] == k and a <= x[1] and x[2] <= b for k, a, b in base)]
    return base, sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping ones the first."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base, spans, redacted) of every row.

    Counts are of base spans, ``n_added`` counts what rewriting added.  Texts are read
    whole, however long, in time that grows with their length.  A null text is empty
    and has no spans; null ids and repeated rows are rows like others; extra
    columns aren't read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.grouped(batches, 1):
            counts: list[list[int]] = [[] for _ in range(5)]
            base, spans, redacted = [], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                own, every = find(text)
                for k, name in enumerate(KINDS):
                    counts[k].append(sum(x[0] == name for x in own))
                counts[4].append(len(every) - len(own))
                base.append(_joined(own)), spans.append(_joined(every)), redacted.append(redact(text, every) if every else None)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base), pa.array(spans), pa.array(redacted, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base", "spans", "redacted"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, n_added long, base string, spans string, redacted string")


def redact_column(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with the personal data in its text replaced; other columns and rows stay as they are.

    Null and empty texts stay so, and repeated rows are rewritten alike.
    """
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.grouped(batches, at):
            new = [t if t is None else redact(t, s) if (s := find(t)[1]) else t for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return with_text(docs.mapInArrow(run, schema), F.col(text_col), text_col)


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    found = detect(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans", "n_added")


def base_digest(spans: list[Span]) -> str:
    return hashlib.sha256(_joined(spans).encode()).hexdigest()


QUERIES = {"op3_pii_spans": op3_pii_spans}
ORACLES: dict[str, str] = {}
