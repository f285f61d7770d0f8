"""Candidates of many texts at once: those of detect.spans_of(), text by text, found on arrays of characters.

The texts of a chunk are joined by line ends, which no candidate holds and which are an edge as a text's end is. Runs of
digits and what stands around them give the places where a pattern may fit; where these don't settle it, the pattern does.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from inkveil.functions import checks
from inkveil.functions.patterns import AGENDAS, AMOUNT, DOMAINS, FILINGS, FIRST, GAP, KINDS, PRECEDENCE, SECOND
from inkveil.functions.text import EDGE, LONG, SHORT, norm_of

#: Texts and characters of a chunk, whose arrays stay in a core's cache; one longer text is a chunk of its own.
MOST_TEXTS, MOST_CHARS = 1000, 200_000
#: More stems of known entities than this are looked up by each word of a text.
MOST_STEMS = 32
TYPES = [*FIRST, "MENO", *SECOND]
CODE = {t: i for i, t in enumerate(TYPES)}
_MENO, _URL, _EMAIL, _ACCOUNT = (CODE[t] for t in ("MENO", "URL", "EMAIL", "BANKOVY_UCET"))
_N = len(TYPES)
#: Who keeps a span, by type and whether it is sure: the first stage, what is doubtful before what is sure; later types in their order; names.
_PRIORITY = np.array([[s * _N + PRECEDENCE.index(t) if t in FIRST else 3 * _N + CODE[t] * (t != "MENO") + 9 * _N * (t == "MENO") for s in (0, 1)] for t in TYPES])
_WORD, _DIGIT, _SPACE, _EXPANDS = 1, 2, 4, 8
#: The pattern of amounts, whose options differ in what follows the number only, which is of one length then.
_SUM = re.compile(rf"\b{AMOUNT}(?:,\d{{2}}{GAP}€|,\d{{2}}{GAP}EUR\b|,-{GAP}€|{GAP}Sk\b)")
_OTHERS = ("EMAIL", "URL", "LV", "PARCELA", "ORSR_VLOZKA")
_DOMAINS = "".join(sorted({d[0] for d in DOMAINS.split()}))
_BEFORE, _AFTER = "\n" * 4, "\n" * 8


class _Characters:
    """What each character is, its value as a digit, its case-folded form and that without length; as far as texts had need of."""

    def __init__(self):
        self.n = 0

    def upto(self, most: int) -> _Characters:
        if most >= self.n:
            self.n = 0x3000
            while self.n <= most:
                self.n *= 2
            chars = [chr(i) for i in range(min(self.n, 0x110000))]
            folded = [c.casefold() for c in chars]
            self.flags = np.array([_WORD * (c.isalnum() or c == "_") + _DIGIT * c.isdecimal() + _SPACE * c.isspace() + _EXPANDS * (len(f) != 1) for c, f in zip(chars, folded)], np.uint8)
            self.value = np.array([int(c) if c.isdecimal() else 0 for c in chars], np.int64)
            self.folded = np.array([ord(f) if len(f) == 1 else i for i, f in enumerate(folded)], np.uint32)
            self.short = self.folded.copy()
            for long, short in zip(LONG, SHORT):
                self.short[self.folded == ord(long)] = ord(short)
        return self


_CHARACTERS = _Characters()


class Found(NamedTuple):
    """Resolved spans of a chunk, by text and place: each one's text, start in it, place in the joined texts, type, whether sure, number of a name's entity."""

    text: np.ndarray
    start: np.ndarray
    a: np.ndarray
    b: np.ndarray
    type: np.ndarray
    sure: np.ndarray
    entity: np.ndarray
    chunk: Chunk

    def of(self, keep: np.ndarray) -> Found:
        return Found(*(c[keep] for c in self[:-1]), self.chunk)


def _disjoint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which spans are left when each one found takes its place from later ones."""
    keep = np.ones(len(a), bool)
    if len(a) > 1 and (a[1:] < b[:-1]).any():
        done = 0
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            keep[i] = x >= done
            done = y if x >= done else done
    return keep


def _array(spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.fromiter(chain.from_iterable(spans), np.int64, 2 * len(spans))
    return flat[::2], flat[1::2]


def _is(codes: np.ndarray, chars: str) -> np.ndarray:
    out = codes == ord(chars[0])
    for c in chars[1:]:
        out |= codes == ord(c)
    return out


class Chunk:
    """Texts joined by line ends."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.all = _BEFORE + "\n".join(texts) + _AFTER
        self.codes = np.frombuffer(self.all.encode("utf-32-le"), np.uint32)
        self.chars = _CHARACTERS.upto(int(self.codes.max()))
        self.flags = self.chars.flags[self.codes]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.begins = np.cumsum(sizes) - sizes + len(_BEFORE)
        self.ends = self.begins + sizes - 1

    def _fitting(self, pattern: re.Pattern, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pattern fits, of all places where it may."""
        out, done, match, text = [], 0, pattern.match, self.all
        for a in starts.tolist():
            if a >= done and (m := match(text, a)):
                done = m.end()
                out.append((a, done))
        return _array(out)

    def _digit(self, at: np.ndarray) -> np.ndarray:
        return self.chars.value[self.codes[at]]

    def numbers(self) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray | None]]:
        """Type, starts, ends and whether sure (None: all are) of each type that runs of digits lead to."""
        codes, flags = self.codes, self.flags
        digit = (flags & _DIGIT) != 0
        turns = np.flatnonzero(digit[1:] != digit[:-1]) + 1
        a, b = turns[::2], turns[1::2]
        n, c = b - a, codes[b]
        opens, closes = (flags[a - 1] & _WORD) == 0, (flags[b] & _WORD) == 0
        later = lambda x, rest: np.append(x[1:], x.dtype.type(rest))[: len(x)]
        near = later(a, 0) == b + 1  # whether one character only lies between a run and the next
        b2, n2, c2, closes2 = later(b, 0), later(n, 0), later(c, 0), later(closes, False)
        near2, b3, n3 = later(near, False), later(b2, 0), later(n2, 0)
        gap, slash = (c == 0x20) | (c == 0xA0), c == ord("/")
        gap2 = (c2 == 0x20) | (c2 == 0xA0)
        before = codes[a - 1]
        slashed = slash & near
        slashed4 = slashed & (n2 == 4)

        k = np.flatnonzero(opens & (n == 6) & slashed4 & closes2)
        x = a[k]
        d = [self._digit(x + i) for i in (0, 1, 2, 3, 4, 5, 7, 8, 9, 10)]
        month, day = d[2] * 10 + d[3], d[4] * 10 + d[5]
        shaped = (day >= 1) & (day <= 31) & np.logical_or.reduce([(month - s >= 1) & (month - s <= 12) for s in checks.MONTH_SHIFTS])
        number = np.zeros(len(x), np.int64)
        for i in d:
            number = number * 10 + i
        yield "RODNE_CISLO", x[shaped], b2[k][shaped], (number % 11 == 0)[shaped]

        apart = opens & closes
        k = apart & (n == 8)
        x = a[k]
        rest = sum((self._digit(x + i) * w for i, w in enumerate(checks.COMPANY)), np.zeros(len(x), np.int64)) % 11
        yield "ICO", x, b[k], self._digit(x + 7) == np.where(rest == 0, 1, np.where(rest == 1, 0, 11 - rest))
        k = apart & (n == 10)
        yield "DIC", a[k], b[k], None
        state = (before == ord("K")) & (codes[a - 2] == ord("S")) & ((flags[a - 3] & _WORD) == 0)
        k = state & closes & (n == 10)
        yield "IC_DPH", a[k] - 2, b[k], None
        x, y = self._fitting(KINDS["IBAN"].pattern, a[state & (((n == 2) & (c == 0x20)) | ((n > 2) & (n <= 22) & (n % 4 == 2)))] - 2)
        yield "IBAN", x, y, np.array([checks.iban(self.all[i:j]) for i, j in zip(x.tolist(), y.tolist())], bool)

        k = np.flatnonzero((n <= 6) & (c == ord("-")) & near & (n2 >= 2) & (n2 <= 10) & (c2 == ord("/")) & near2 & (n3 == 4))
        k = k[_disjoint(a[k], b3[k])]
        sure = np.ones(len(k), bool)
        for ends, sizes, weights in ((b[k], n[k], checks.PREFIX), (b2[k], n2[k], checks.BASE)):
            total = np.zeros(len(k), np.int64)
            for i, w in enumerate(reversed(weights), 1):
                total += np.where(sizes >= i, self._digit(np.maximum(ends - i, 0)) * w, 0)
            sure &= total % 11 == 0
        yield "BANKOVY_UCET", a[k], b3[k], sure

        zero = opens & (codes[a] == ord("0")) & near & (n2 == 3) & (((n == 4) & gap) | ((n >= 2) & (n <= 3) & slash & gap2))
        plus = (before == ord("+")) & (n == 3) & gap & near & (n2 <= 3)
        yield "TELEFON", *self._fitting(KINDS["TELEFON"].pattern, np.sort(np.concatenate([a[zero], a[plus] - 1]))), None
        next1, next2, next3 = codes[b + 1], codes[b + 2], codes[b + 3]
        gap_after = (next1 == 0x20) | (next1 == 0xA0)
        dated = ((n <= 2) & (c == ord(".")) & (gap_after | (near & (n2 <= 2) & (c2 == ord("."))))) | ((n == 4) & (c == ord("-")) & near & (n2 == 2) & (c2 == ord("-")))
        yield "DATUM", *self._fitting(KINDS["DATUM"].pattern, a[opens & dated]), None
        priced = (c == ord(",")) & ((near & (n2 == 2) & gap2) | ((next1 == ord("-")) & ((next2 == 0x20) | (next2 == 0xA0)) & (next3 == ord("€"))))
        priced |= gap & ((near & (n2 == 3)) | ((next1 == ord("S")) & (next2 == ord("k"))))
        yield "SUMA", *self._fitting(_SUM, a[opens & (n <= 3) & priced]), None
        filed = (before == ord("-")) & _is(codes[a - 2], FILINGS) & ((flags[a - 3] & _WORD) == 0) & (n <= 4) & slashed4
        heard = opens & (n <= 2) & _is(c, "".join(sorted({w[0] for w in AGENDAS.split()})))
        yield "SPISOVA_ZNACKA", *self._fitting(KINDS["SPISOVA_ZNACKA"].pattern, np.sort(np.concatenate([a[filed] - 2, a[heard]]))), None

    def _others(self, t: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of a type that numbers() doesn't find."""
        if t != "URL":
            return _array(KINDS[t].spans(self.all))
        # An address holds a dot and the first letter of a domain, or starts in a way of its own.
        codes = self.codes
        dots, www, http = (np.flatnonzero(codes == ord(x)) for x in ".wh")
        may = np.sort(np.concatenate([dots[_is(codes[dots + 1], _DOMAINS)], www[codes[www + 1] == ord("w")], http[codes[http + 1] == ord("t")]]))
        return _array(KINDS["URL"].spans(self.all, may.tolist()))

    def names(self, known: list[tuple], names) -> tuple[list[int], list[int], list[int]]:
        """Starts, ends and entities of tokens whose stem is one of a known entity's. A stem starts its word's folded form: only words around it are looked at."""
        starts, ends, entities = [], [], []
        folded = self.chars.short[self.codes].tobytes().decode("utf-32-le")
        spaces = np.flatnonzero(self.flags & _SPACE).tolist()
        counts = np.add.reduceat((self.flags & _EXPANDS) != 0, self.begins, dtype=np.int64).tolist() if (self.flags & _EXPANDS).any() else None
        find = folded.find
        for i, (lo, hi, entry) in enumerate(zip(self.begins.tolist(), self.ends.tolist(), known)):
            if not entry or lo == hi:
                continue
            stems = names.of(entry)
            if len(stems) > MOST_STEMS or (counts and counts[i]):
                for a, b, _, _, key in names.find(self.texts[i], entry):
                    starts.append(lo + a)
                    ends.append(lo + b)
                    entities.append(int(key[7:]))
                continue
            seen = set()
            for s in stems:
                at = find(s, lo, hi)
                while at >= 0:
                    k = bisect_left(spaces, at)
                    a, b = spaces[k - 1] + 1, spaces[k]
                    if a not in seen:
                        seen.add(a)
                        run = self.all[a:b]
                        e = stems.get(names.stem(run))
                        if e is not None:
                            left = run.lstrip(EDGE)
                            a = b - len(left)
                            starts.append(a)
                            ends.append(a + len(left.rstrip(EDGE)))
                            entities.append(e)
                    at = find(s, b, hi)
        return starts, ends, entities

    def found(self, known: list[tuple], names, types: frozenset[str] | None = None) -> Found:
        """Resolved spans, of the given types only."""
        parts = []

        def add(t: str, a: np.ndarray, b: np.ndarray, sure: np.ndarray | None = None, entity: np.ndarray | None = None) -> None:
            parts.append((a, b, np.full(len(a), CODE[t]), np.ones(len(a), bool) if sure is None else sure, np.full(len(a), -1) if entity is None else entity))

        for x in self.numbers():
            add(*x)
        # A name never drives out another type.
        if types is None or "MENO" in types:
            a, b, entity = (np.array(c, np.int64) for c in self.names(known, names))
            add("MENO", a, b, None, entity)
        need = set(_OTHERS if types is None else types.intersection(_OTHERS))
        if not need.issuperset(_OTHERS):
            # The others matter to a wanted span that is theirs, too, and all of theirs hold a dot; e-mails to addresses. LV, PARCELA and ORSR_VLOZKA each start with words that no other type's span holds.
            dots = np.concatenate([[0], np.cumsum(self.codes == ord("."))])
            if any((dots[b] > dots[a]).any() for a, b, k, _, _ in parts if len(k) and TYPES[k[0]] in types):
                need.update(_OTHERS)
            elif need:
                need.update(["EMAIL", "URL"])
        for t in need:
            add(t, *self._others(t))
        a, b, kind, sure, entity = map(np.concatenate, zip(*parts))
        # Accounts are disjoint, e-mails likewise: only the last to start before a span may hold it.
        keep = ~self._inside(a, b, kind == _ACCOUNT, kind <= _MENO, True) & ~self._inside(a, b, kind == _EMAIL, kind == _URL, False)
        a, b, kind, sure, entity = a[keep], b[keep], kind[keep], sure[keep], entity[keep]
        order = np.lexsort((_PRIORITY[kind, sure.astype(np.int64)], b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, order = a[new], b[new], order[new]
        text = np.searchsorted(self.begins, a, "right") - 1
        out = Found(text, a - self.begins[text], a, b, kind[order], sure[order], entity[order], self)
        return out if types is None else out.of(np.isin(out.type, [CODE[t] for t in types]))

    @staticmethod
    def _inside(a: np.ndarray, b: np.ndarray, outer: np.ndarray, inner: np.ndarray, strictly: bool) -> np.ndarray:
        """Which of the inner spans lie in an outer one; strictly: in a longer one."""
        oa, ob = a[outer], b[outer]
        if not len(oa):
            return np.zeros(len(a), bool)
        i = np.searchsorted(oa, a, "right") - 1
        at = np.maximum(i, 0)
        out = inner & (i >= 0) & (b <= ob[at])
        return out & ~((a == oa[at]) & (b == ob[at])) if strictly else out


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """First and last place of each chunk."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if i > first and (i - first >= MOST_TEXTS or size + n > MOST_CHARS):
            yield first, i
            first, size = i, 0
        size += n
    if texts:
        yield first, len(texts)


def search(texts: list[str | None], known: list[list | None], names, types: frozenset[str] | None = None) -> Iterator[tuple[int, Found]]:
    """The place of each chunk's first text, and its spans."""
    for i, j in chunks(texts):
        # A null text holds nothing.
        yield i, Chunk([t or "" for t in texts[i:j]]).found([tuple(k or ()) for k in known[i:j]], names, types)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all ranges, one range after another, and where each begins among them."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0), np.concatenate([[0], ends])


def _strings(offsets: np.ndarray, data: np.ndarray | bytes) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def _widths(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)


def _columns(f: Found) -> list[pa.Array]:
    """type, surface, start, end, auto, group_key."""
    codes, chars = f.chunk.codes, f.chunk.chars
    places, offsets = _ranges(f.a, f.b - f.a)
    inside = codes[places]
    at = np.concatenate([[0], np.cumsum(_widths(inside))])
    surface = _strings(at[offsets], inside.tobytes().decode("utf-32-le").encode())
    flags = chars.flags[inside]
    if (flags & _EXPANDS).any():
        key = pa.array([norm_of(s) for s in surface.to_pylist()], pa.string())
    else:
        solid = (flags & _SPACE) == 0
        folded = chars.folded[inside]
        at = np.concatenate([[0], np.cumsum(np.where(solid, _widths(folded), 0))])
        key = _strings(at[offsets], folded[solid].tobytes().decode("utf-32-le").encode())
    named = f.entity >= 0
    if named.any():
        key = pc.replace_with_mask(key, pa.array(named), pa.array([f"entity:{i}" for i in f.entity[named].tolist()], pa.string()))
    kinds = pa.array(TYPES, pa.string()).take(pa.array(f.type))
    return [kinds, surface, pa.array(f.start.astype(np.int32)), pa.array((f.start + f.b - f.a).astype(np.int32)), pa.array(f.sure), key]


_NAMES = ["type", "surface", "start", "end", "auto", "group_key"]


def arrays(texts: list[str | None], known: list[list | None], names, types: frozenset[str] | None = None) -> pa.Array:
    """Lists of resolved spans, one a text; null for a null text."""
    out, sizes = [], np.zeros(len(texts) + 1, np.int64)
    for i, f in search(texts, known, names, types):
        n = len(f.chunk.texts)
        sizes[i + 1 : i + 1 + n] = np.bincount(f.text, minlength=n)
        out.append(pa.StructArray.from_arrays(_columns(f), _NAMES))
    if not out:
        out.append(pa.StructArray.from_arrays([pa.array([], t) for t in (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string())], _NAMES))
    mask = pa.array([t is None for t in texts]) if None in texts else None
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.concat_arrays(out), mask=mask)


def tally(texts: list[str | None], known: list[list | None], names, into: np.ndarray) -> None:
    """Adds the number of spans and the sum of their starts, by type and whether sure."""
    for _, f in search(texts, known, names):
        np.add.at(into, (0, f.type, f.sure.astype(np.int64)), 1)
        np.add.at(into, (1, f.type, f.sure.astype(np.int64)), f.start)
