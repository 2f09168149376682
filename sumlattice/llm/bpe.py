"""BPE encoding and decoding by tree concatenation.

A text isn't split before it is encoded: it is halved, down to leaves of about ``LEAF``
characters, wherever a half happens to end.  All leaves of a batch are encoded side by
side as arrays.  Then neighbours are joined, level by level: a window of words around
each join is encoded again, those of a level side by side, and grows until its
outermost words and their tokens are those that both sides already had.  Splitting into
words looks ahead only, so from there on both sides stand as they are.

A single word of over ``WORD_LEAF`` bytes is halved likewise, with windows of tokens.  A
token sequence is the encoding of its bytes exactly when each neighbouring pair is.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import slices, table

VOCABULARY = "word_bpe_49k.json"
#: Characters of a text, and bytes of a word, from which it is halved.
LEAF = 1024
WORD_LEAF = 48
#: Words on either side of a join that its first window has.
WINDOW = 2
#: Bytes of a word up to which new words are merged side by side.
SHORT = 32
#: Characters of a word that have random numbers of their own.
PLACES = 64
#: Words that a worker keeps with their ids; at so many it starts anew.
CACHE_WORDS = 250_000


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


#: Characters for which Python's own splitting or lower-casing may differ from the file's rules.
_UNSURE = re.compile("[\x1c-\x1fİ̀-\U0010ffff]")


class WordBpe:
    """The vocabulary file's encoding, with ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens: list[str] = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        chars = _byte_chars()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.inner = [vocab[c] for c in chars]
        self.last = [vocab[c + suffix] for c in chars]
        self.inner_np, self.last_np = np.array(self.inner, np.int32), np.array(self.last, np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        back = {i: (a, b) for (a, b), (_, i) in self.merges.items()}
        self.parts: dict[int, tuple[int, ...]] = {}
        for i in {*self.inner, *self.last}:
            self.parts[i] = (i,)
        for i, (a, b) in sorted(back.items(), key=lambda x: self.merges[x[1]][0]):
            self.parts[i] = self.parts[a] + self.parts[b]
        self.library = Tokenizer.from_file(path)
        self.pairs = _Pairs(self.merges)
        self.table = _Words()

    def _merge(self, s: list[int]) -> list[int]:
        """The merge loop: always the lowest rank, leftmost first."""
        get, far = self.merges.get, (1 << 60, 0)
        ranks = [get(p, far) for p in zip(s, s[1:])]
        while ranks:
            best = min(ranks)
            if best is far:
                break
            at = ranks.index(best)
            s[at : at + 2] = [best[1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get((s[at - 1], s[at]), far)
            if at < len(ranks):
                ranks[at] = get((s[at], s[at + 1]), far)
        return s

    def _tree(self, s: list[int]) -> list[int]:
        if len(s) <= WORD_LEAF:
            return self._merge(s)
        level = [self._merge(s[at : at + WORD_LEAF]) for at in range(0, len(s), WORD_LEAF)]
        while len(level) > 1:  # each pass joins neighbours, which are independent of the others
            level = [self._join(*level[at : at + 2]) if at + 1 < len(level) else level[at] for at in range(0, len(level), 2)]
        return level[0]

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        k = 2
        while True:
            a, b = left[-k:], right[:k]
            base = [x for t in a + b for x in self.parts[t]]
            window = self._merge(base) if len(base) <= 8 * WORD_LEAF else self._heap(base)
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2

    def _heap(self, s: list[int]) -> list[int]:
        """The merge loop for wide windows, in time n log n."""
        import heapq

        nxt, prev, get = [*range(1, len(s)), -1], [-1, *range(len(s) - 1)], self.merges.get
        live, heap = [True] * len(s), []

        def put(i: int) -> None:
            if (j := nxt[i]) >= 0 and (m := get((s[i], s[j]))):
                heapq.heappush(heap, (m[0], i, s[i], s[j], m[1]))

        for i in range(len(s) - 1):
            put(i)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = nxt[i]
            if not live[i] or j < 0 or s[i] != x or s[j] != y:
                continue
            s[i], live[j], nxt[i] = made, False, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            put(i)
            if prev[i] >= 0:
                put(prev[i])
        return [x for x, on in zip(s, live) if on]

    def word(self, data: bytes) -> list[int]:
        """Ids of one word, given as its UTF-8 bytes."""
        return self._tree([*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]]) if data else []

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: its parts between special tokens, normalised, are encoded by tree concatenation."""
        parts: list[str] = []
        simple: list[bool] = []
        plan: list[list[int]] = []  # of each text: parts, and special ids as negative numbers
        for t in texts:
            if not _UNSURE.search(t) and "<|" not in t:
                plan.append([len(parts)])
                parts.append(t.lower()), simple.append(True)
                continue
            own, at = [], 0
            for m in [*self.special_re.finditer(t), None]:
                own.append(len(parts))
                parts.append(self.library.normalizer.normalize_str(t[at : m.start() if m else len(t)])), simple.append(False)
                if m:
                    own.append(-1 - self.special[m[0]])
                    at = m.end()
            plan.append(own)
        ids = self._tree_of_texts(parts, simple)
        return [ids[own[0]] if len(own) == 1 else np.concatenate([ids[k] if k >= 0 else np.array([-1 - k], "<u4") for k in own]) for own in plan]

    def _tree_of_texts(self, parts: list[str], simple: list[bool]) -> list[np.ndarray]:
        """Ids of each part: leaves, then joins level by level."""
        stores: list[_Spans] = []

        def encoded(pieces: list[tuple[int, int, int]]) -> list[_Node]:
            """A node for each piece (part, start, end), all encoded side by side."""
            stores.append(self._spans(pieces, parts, simple))
            ends = stores[-1].ends
            return [_Node([(len(stores) - 1, a, b)] if b > a else []) for a, b in zip([0, *ends[:-1]], ends)]

        cuts = [_leaves(t) for t in parts]
        leaves = encoded([(k, a, b) for k, c in enumerate(cuts) for a, b in zip(c, c[1:])])
        level, at = [], 0
        for c in cuts:
            level.append(leaves[at : at + len(c) - 1])
            at += len(c) - 1
        while True:
            joins = [(k, i) for k, nodes in enumerate(level) for i in range(0, len(nodes) - 1, 2)]
            if not joins:
                break
            pending, width = [(k, i) for k, i in joins if level[k][i].ranges and level[k][i + 1].ranges], WINDOW
            made = {(k, i): _Node(level[k][i].ranges + level[k][i + 1].ranges) for k, i in joins}  # a side of white space changes nothing
            while pending:
                sides = [(level[k][i].last(width), level[k][i + 1].first(width)) for k, i in pending]
                pieces = [(k, int(stores[x[0]].lo[x[1]]), int(stores[y[0]].hi[y[2] - 1])) for (k, _), ((_, x, _), (_, y, _)) in zip(pending, sides)]
                again = []
                for at, node, (left, x, whole_left), (right, y, whole_right) in zip(pending, encoded(pieces), *zip(*sides)):
                    s, a, b = node.ranges[0]
                    same = lambda r, i, q, j: stores[r].lo[i] == stores[q].lo[j] and stores[r].hi[i] == stores[q].hi[j]
                    if (whole_left or same(s, a, x[0], x[1])) and (whole_right or same(s, b - 1, y[0], y[2] - 1)):
                        made[at] = _Node(left + node.ranges + right)
                    else:
                        again.append(at)
                pending, width = again, 2 * width
            level = [[made[k, i] if (k, i) in made else nodes[i] for i in range(0, len(nodes), 2)] for k, nodes in enumerate(level)]
        out = []
        for nodes in level:
            found = [stores[s].ids[stores[s].at[a] : stores[s].at[b]] for n in nodes for s, a, b in n.ranges]
            out.append(found[0] if len(found) == 1 else np.concatenate(found) if found else _NO_IDS)
        return out

    def _spans(self, pieces: list[tuple[int, int, int]], parts: list[str], simple: list[bool]) -> _Spans:
        """Words of pieces of parts, with their places in the parts and their ids."""
        plain, odd = [i for i, p in enumerate(pieces) if simple[p[0]]], [i for i, p in enumerate(pieces) if not simple[p[0]]]
        texts = [parts[k][a:b] for k, a, b in pieces]
        n_words = np.zeros(len(pieces), np.int64)
        lo, hi, n, ids, ends = self._plain([texts[i] for i in plain]) if plain else (_NO_PLACES, _NO_PLACES, _NO_PLACES, _NO_IDS, _NO_PLACES)
        n_words[plain] = np.diff(ends, prepend=0)
        if not odd:
            shift = np.repeat([pieces[i][1] for i in plain], n_words[plain])
            return _Spans(lo + shift, hi + shift, np.append(0, np.cumsum(n)), ids, ends.tolist())
        found, at, of = [], np.append(0, np.cumsum(n)), dict(zip(plain, zip([0, *ends.tolist()], ends.tolist())))
        for i, (_, start, _) in enumerate(pieces):
            if i in of:
                a, b = of[i]
                found.append((lo[a:b] + start, hi[a:b] + start, n[a:b], ids[at[a] : at[b]]))
            else:  # rarer scripts: the library finds the words
                own = self.library.pre_tokenizer.pre_tokenize_str(texts[i])
                tokens = [self.word(bytes(map(self.byte_of.__getitem__, w))) for w, _ in own]
                place = np.array([s for _, s in own], np.int64).reshape(-1, 2) + start
                found.append((place[:, 0], place[:, 1], np.array([*map(len, tokens)], np.int64), np.array([x for t in tokens for x in t], "<u4")))
        lo, hi, n, ids = (np.concatenate(x) for x in zip(*found))
        return _Spans(lo, hi, np.append(0, np.cumsum(n)), ids, np.cumsum([len(f[0]) for f in found]).tolist())

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0].tobytes()

    def _plain(self, low: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of normalised texts of characters below U+0300: places in their texts, numbers of ids, ids; and where each text's words end."""
        whole = "\n".join(low)
        c = np.frombuffer(whole.encode("utf-16-le"), np.uint16)
        nothing = _NO_PLACES, _NO_PLACES, _NO_PLACES, _NO_IDS, np.zeros(len(low), np.int64)
        if not len(c):
            return nothing
        kind = _KIND[c]
        start = np.empty(len(c), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == 2
        quotes = np.flatnonzero(c == 39)
        for q in quotes[start[quotes]].tolist():
            n = 2 if whole[q + 1 : q + 2] in _ONE else 3 if whole[q + 1 : q + 3] in _TWO else 0
            if n:
                start[q + 1 : q + n] = False
                if q + n < len(c):
                    start[q + n] = True
        start &= kind != 0
        lo = np.flatnonzero(start)
        if not len(lo):
            return nothing
        # A word ends where the next one or white space starts.
        edge = np.flatnonzero(start | (kind == 0))
        hi = np.append(edge, len(c))[np.searchsorted(edge, lo) + 1]
        keys = _word_keys(c, lo, hi)
        at = self.table.find(keys)
        if (missing := np.flatnonzero(at < 0)).size:
            new, first = np.unique(keys[missing], return_index=True)
            first = missing[first]
            self.table.add(new, self._ids_of([whole[a:b] for a, b in zip(lo[first].tolist(), hi[first].tolist())]))
            at = self.table.find(keys)  # all again, as the table may have started anew
            if (at < 0).any():  # more new words than the table holds
                if len(low) == 1:
                    tokens = self._ids_of([whole[a:b] for a, b in zip(lo.tolist(), hi.tolist())])
                    return lo, hi, np.array([*map(len, tokens)], np.int64), np.concatenate(tokens), np.array([len(lo)])
                half = len(low) // 2
                a, b = self._plain(low[:half]), self._plain(low[half:])
                return *(np.concatenate([x, y]) for x, y in zip(a[:4], b[:4])), np.append(a[4], b[4] + len(a[0]))
        n = self.table.count[at]
        ends = np.cumsum(n)
        ids = self.table.pool[np.repeat(self.table.offset[at] - (ends - n), n) + np.arange(ends[-1])]
        size = np.array([*map(len, low)], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        words = np.searchsorted(lo, begin + size)
        shift = np.repeat(begin, np.diff(words, prepend=0))
        return lo - shift, hi - shift, n, ids, words

    def _ids_of(self, words: list[str]) -> list[np.ndarray]:
        """Ids of new words; those of up to SHORT bytes are merged side by side."""
        out: list[np.ndarray] = [_NO_IDS] * len(words)
        by_width: dict[int, list[tuple[int, bytes]]] = {}
        for i, w in enumerate(words):
            data = w.encode()
            if len(data) > SHORT:
                out[i] = np.array(self.word(data), "<u4")
            else:
                by_width.setdefault(max(4, (len(data) + 3) // 4 * 4), []).append((i, data))
        for width, group in by_width.items():
            ids, n = self._side_by_side([d for _, d in group], width)
            for (i, _), row, m in zip(group, ids, n.tolist()):
                out[i] = row[:m]
        return out

    def _side_by_side(self, data: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """The merge loop on a row of symbols for each word."""
        n = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8)
        row = np.repeat(np.arange(len(data)), n)
        col = np.arange(len(raw)) - np.repeat(np.cumsum(n) - n, n)
        s = np.full((len(data), width + 1), -1, np.int32)
        s[row, col] = self.inner_np[raw]
        s[np.arange(len(data)), n - 1] = self.last_np[raw[np.cumsum(n) - 1]]
        out, left = np.full((len(data), width), -1, "<i4"), np.arange(len(data))
        r = np.full((len(data), width + 1), _FAR, np.int32)
        r[:, :-1] = self.pairs.rank(s[:, :-1], s[:, 1:])
        cols = np.arange(width)
        while len(left):
            j = r.argmin(1)
            best = r[np.arange(len(left)), j]
            live = best < _FAR
            if not live.all():
                out[left[~live]] = s[~live, :-1]
                s, r, j, best, left = s[live], r[live], j[live], best[live], left[live]
            at = np.arange(len(left))
            over = cols >= j[:, None]
            r[:, :-1] = np.where(over, r[:, 1:], r[:, :-1])
            over[at, j] = False
            s[:, :-1] = np.where(over, s[:, 1:], s[:, :-1])
            s[at, j] = self.pairs.made[best]
            r[at, j] = self.pairs.rank(s[at, j], s[at, np.minimum(j + 1, width)])
            k = at[j > 0]
            r[k, j[k] - 1] = self.pairs.rank(s[k, j[k] - 1], s[k, j[k]])
        return out, (out >= 0).sum(1)

    def decode(self, ids: bytes | np.ndarray) -> str:
        """Tokens joined by spaces, as the library decodes where the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Words:
    """Ids of words met so far, by a 64-bit hash of the word: an open-addressed table.

    Hashes add up random numbers, so that however words are built, one outside the table
    is taken for one of its entries with a chance of about 1e-14.
    """

    def __init__(self, bits: int = 1 + (CACHE_WORDS - 1).bit_length()):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.clear()

    def clear(self) -> None:
        self.slot_key, self.slot_entry = np.zeros(self.mask + 1, np.uint64), np.full(self.mask + 1, -1, np.int32)
        self.offset, self.count, self.entries = np.zeros(CACHE_WORDS, np.int64), np.zeros(CACHE_WORDS, np.int64), 0
        self.pool, self.used = np.zeros(4 * CACHE_WORDS, "<u4"), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 if there is none."""
        at = self._slot(keys)
        out = np.where(self.slot_key[at] == keys, self.slot_entry[at], -1)
        left = np.flatnonzero((out < 0) & (self.slot_entry[at] >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            hit = self.slot_key[at[left]] == keys[left]
            out[left[hit]] = self.slot_entry[at[left[hit]]]
            left = left[~hit & (self.slot_entry[at[left]] >= 0)]
        return out

    def add(self, keys: np.ndarray, ids: list[np.ndarray]) -> None:
        """Keys that are not there yet, each once; what does not fit is left out."""
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        if self.entries + len(keys) > CACHE_WORDS or self.used + n.sum() > len(self.pool):
            self.clear()
            room = min(CACHE_WORDS, int(np.searchsorted(np.cumsum(n), len(self.pool), "right")))
            keys, ids, n = keys[:room], ids[:room], n[:room]
        if not len(keys):
            return
        entry = np.arange(self.entries, self.entries + len(keys))
        flat = np.concatenate(ids)
        self.offset[entry], self.count[entry] = self.used + np.cumsum(n) - n, n
        self.pool[self.used : self.used + len(flat)] = flat
        self.entries, self.used = self.entries + len(keys), self.used + len(flat)
        at = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            _, first = np.unique(at[left], return_index=True)
            first = first[self.slot_entry[at[left[first]]] < 0]
            won = left[first]
            self.slot_key[at[won]], self.slot_entry[at[won]] = keys[won], entry[won]
            left = np.delete(left, first)
            at[left] = (at[left] + 1) & self.mask


@dataclass
class _Spans:
    """Words of pieces that were encoded side by side: places in their parts, where the ids of each begin, ids, and where each piece's words end."""

    lo: np.ndarray
    hi: np.ndarray
    at: np.ndarray
    ids: np.ndarray
    ends: list[int]


@dataclass
class _Node:
    """An encoded stretch of a part: ranges (store, first word, end) in order, none of them empty."""

    ranges: list[tuple[int, int, int]]

    def last(self, n: int) -> tuple[list[tuple[int, int, int]], tuple[int, int, int], bool]:
        """The ranges before the last ``n`` words, the range that these begin in, and whether they are all."""
        rest = [*self.ranges]
        while True:
            s, a, b = rest.pop()
            if b - a > n:
                return [*rest, (s, a, b - n)], (s, b - n, b), False
            if b - a == n or not rest:
                return rest, (s, a, b), not rest
            n -= b - a

    def first(self, n: int) -> tuple[list[tuple[int, int, int]], tuple[int, int, int], bool]:
        """The ranges after the first ``n`` words, the range that these end in, and whether they are all."""
        rest = self.ranges[::-1]
        while True:
            s, a, b = rest.pop()
            if b - a > n:
                return [(s, a + n, b), *rest[::-1]], (s, a, a + n), False
            if b - a == n or not rest:
                return rest[::-1], (s, a, b), not rest
            n -= b - a


def _leaves(text: str) -> list[int]:
    """Where the leaves of a text begin and end.  A stretch without white space, as long as a leaf, isn't cut here, but within its words."""
    out = [0]
    for at in range(LEAF, len(text) - LEAF // 2, LEAF):
        if not _UNBROKEN.fullmatch(text, max(0, at - LEAF), at):
            out.append(at)
    return [*out, len(text)]


def _word_keys(c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: random numbers for each character and place are added up; long words are hashed one by one."""
    place = np.zeros(len(c), np.int64)
    place[lo] = lo
    np.maximum.accumulate(place, out=place)
    np.subtract(np.arange(len(c)), place, out=place)
    np.minimum(place, PLACES - 1, out=place)
    place *= 0x300
    place += c
    sums = np.empty(len(c) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_NUMBERS[place], out=sums[1:])
    keys = sums[hi] - sums[lo]
    for i in np.flatnonzero(hi - lo > PLACES).tolist():
        keys[i] = int.from_bytes(hashlib.blake2b(c[lo[i] : hi[i]].tobytes(), digest_size=8).digest(), "little")
    return keys


_UNBROKEN = re.compile(r"\S+")
_NO_PLACES = np.zeros(0, np.int64)
_NO_IDS = np.zeros(0, "<u4")
_ONE, _TWO = {*"stmd"}, {"re", "ve", "ll"}
#: White space 0, letters 1, digits 2, others 3; and a random number for each place and character.
_KIND = np.array([0 if chr(c).isspace() else {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(0x300)], np.int8)
_NUMBERS = np.random.default_rng(20240229).integers(0, 1 << 64, PLACES * 0x300, np.uint64)
_FAR = np.int32(2**31 - 1)


class _Pairs:
    """Ranks of symbol pairs, as an open-addressed table that whole arrays are looked up in."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]], bits: int = 20):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _FAR, np.int32)
        self.made = np.array([made for _, made in sorted(merges.values())], np.int32)
        keys = np.array([(a << 20) | b for a, b in merges], np.int64)
        for key, at, (rank, _) in zip(keys.tolist(), self._slot(keys).tolist(), merges.values()):
            while self.keys[at] != -1:
                at = (at + 1) & self.mask
            self.keys[at], self.ranks[at] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; where there is no such pair or a symbol is -1, a number above all ranks."""
        keys = np.where((a < 0) | (b < 0), np.int64(-2), (a.astype(np.int64) << 20) | b)
        shape, keys = keys.shape, keys.ravel()
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.ranks[at], _FAR)
        left = np.flatnonzero((there != keys) & (there != -1) & (keys >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (there != -1)]
        return out.reshape(shape)


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One encoder for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary) of every row, repeated ones and those without id too; a null text counts as empty, texts may be of any length, other columns are left behind."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in bpe.encode_many([t or "" for t in b.column(1).to_pylist()])], pa.binary())], ["id", "ids"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, text) from what ``encode`` returns; null ids count as empty.  One row for each row, repeated ones too; extra columns aren't read."""
    kind = encoded.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or b"") for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every row as digests, in one pass over the texts.

    One row for each input row, null ids and repeated rows included; a null or
    empty text has no tokens and the digests of nothing.  Only the id and the text
    are read, so extra columns of any name do no harm.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = load(path), hashlib.sha256
        for b in slices(batches):
            n, first, second = [], [], []
            for ids in bpe.encode_many([t or "" for t in b.column(1).to_pylist()]):
                n.append(len(ids))
                first.append(sha(ids).hexdigest())
                second.append(sha(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(first), pa.array(second)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and digest of the ids of every document, and digest of their decoded text."""
    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


QUERIES = {"op8_bpe_round_trip": op8_bpe_round_trip}
ORACLES: dict[str, str] = {}
