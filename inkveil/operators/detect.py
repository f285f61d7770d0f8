"""Candidates of a text unit and their resolution: one pass over Arrow batches, one row in and one row out, no shuffle.

Why Python: overlapping alternatives, look-around and offsets of all matches take several interpreted array
expressions a pattern in SQL, which measured five times the CPU of this pass. A text that lacks what a type's
matches hold is passed over.

Defined cases: a null text has a null list; an empty text and a null or empty list of entities give none.
"""

from __future__ import annotations

import gc
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkveil.functions.patterns import FIRST, KINDS, PRECEDENCE, SECOND, Kind
from inkveil.functions.text import EDGE, norm_of, stem_of, tokens
from inkveil.operators import bulk

CANDIDATE = "array<struct<type:string,surface:string,start:int,end:int,auto:boolean,group_key:string>>"
#: Words whose stems a task keeps.
MOST_STEMS = 200_000
#: Types that may be doubtful.
DOUBTFUL = tuple(t for t, k in KINDS.items() if k.sure)
_RANK = {t: i for i, t in enumerate(PRECEDENCE)}
Span = tuple[int, int, str, bool, str | None]  # start, end, type, whether sure, group key of a name


def scan(text: str, kinds: dict[str, Kind]) -> list[Span]:
    """Candidates of the given types, type by type."""
    out = []
    for t, (pattern, needs, shape, sure, spans) in kinds.items():
        if needs is None or needs in text:
            for a, b in spans(text) if spans else [m.span() for m in pattern.finditer(text)]:
                if shape is None or shape(text[a:b]):
                    out.append((a, b, t, sure is None or sure(text[a:b]), None))
    return out


class Names:
    """Stems of words and of known entities, kept for a task."""

    def __init__(self):
        self.words: dict[str, str | None] = {}
        self.entities: dict[str, tuple[str, ...]] = {}

    def stem(self, run: str) -> str | None:
        """The stem of a run of characters' token; None if it has none."""
        found = self.words.get(run, self)
        if found is self:
            if len(self.words) >= MOST_STEMS:
                self.words.clear()
            core = run.strip(EDGE)
            # The commonest new words are numbers.
            found = self.words[run] = (core if core.isdigit() and core.isascii() else stem_of(core)) if core else None
        return found

    def of(self, known: tuple) -> dict[str, int]:
        """Each stem of an entity's words, and the first entity that has it."""
        out = {}
        for i, entity in enumerate(known):
            stems = self.entities.get(entity)
            if stems is None:
                if len(self.entities) >= 1000:
                    self.entities.clear()
                number = entity and entity.isascii() and entity.isdigit()
                stems = self.entities[entity] = (entity,) if number else tuple(stem_of(word) for word, _ in tokens(entity or ""))
            for s in stems:
                out.setdefault(s, i)
        out.pop("", None)
        return out

    def find(self, text: str, known: tuple) -> list[Span]:
        """Each token whose stem is one of a known entity's."""
        stems = self.of(known)
        if not stems:
            return []
        out, words = [], self.words
        for run in set(text.split()):
            s = words.get(run, self)
            i = stems.get(self.stem(run) if s is self else s)
            if i is None:
                continue
            left = run.lstrip(EDGE)
            core, n, at = left.rstrip(EDGE), len(run), text.find(run)
            while at >= 0:
                # Only where the run is a whole one.
                if (at == 0 or text[at - 1].isspace()) and (at + n == len(text) or text[at + n].isspace()):
                    a = at + n - len(left)
                    out.append((a, a + len(core), "MENO", True, f"entity:{i}"))
                at = text.find(run, at + n)
        return sorted(out)


def not_in_accounts(spans: list[Span]) -> list[Span]:
    """Without what lies strictly inside an account number."""
    accounts = [s for s in spans if s[2] == "BANKOVY_UCET"]
    inside = lambda s: any(a[0] <= s[0] and s[1] <= a[1] and a[:2] != s[:2] for a in accounts)
    return [s for s in spans if s[2] == "BANKOVY_UCET" or not inside(s)] if accounts else spans


def one_a_span(spans: list[Span]) -> list[Span]:
    """Of equal spans a doubtful candidate drives out the sure ones; then the type of the highest precedence stays."""
    best: dict[tuple[int, int], Span] = {}
    for s in spans:
        was = best.get(s[:2])
        if was is None or (s[3], _RANK[s[2]]) < (was[3], _RANK[was[2]]):
            best[s[:2]] = s
    return list(best.values())


def not_in_emails(spans: list[Span]) -> list[Span]:
    """Without addresses that are part of an e-mail. E-mails don't overlap, so one may hold an address only if it is the last to start before it ends."""
    mails = [s for s in spans if s[2] == "EMAIL"]
    if not mails:
        return spans
    starts = [s[0] for s in mails]

    def inside(s: Span) -> bool:
        i = bisect_left(starts, s[0] + 1) - 1
        return i >= 0 and s[1] <= mails[i][1]

    return [s for s in spans if s[2] != "URL" or not inside(s)]


def resolved(first: list[Span], second: list[Span]) -> list[Span]:
    """The rules in order, then by span. A name that is also an e-mail, a date and the like yields to that type."""
    every = one_a_span(not_in_accounts(first)) + second
    out: dict[tuple[int, int], Span] = {}
    for s in not_in_emails(every):
        was = out.get(s[:2])
        if was is None or was[2] == "MENO":
            out[s[:2]] = s
    return [out[k] for k in sorted(out)]


def columns_of(texts: list[str | None], rows: list[list[Span] | None]) -> tuple[list, ...]:
    """Columns of all spans: type, surface, start, end, auto, group_key."""
    cols = tuple([] for _ in range(6))
    types, surfaces, starts, ends, autos, keys = (c.append for c in cols)
    for t, spans in zip(texts, rows):
        for a, b, ty, sure, key in spans or ():
            surface = t[a:b]
            types(ty)
            surfaces(surface)
            starts(a)
            ends(b)
            autos(sure)
            keys(norm_of(surface) if key is None else key)
    return cols


def as_array(texts: list[str | None], rows: list[list[Span] | None]) -> pa.Array:
    offsets = [0, *accumulate(len(r or ()) for r in rows)]
    kinds = [("type", pa.string()), ("surface", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("auto", pa.bool_()), ("group_key", pa.string())]
    fields = [pa.array(c, k) for c, (_, k) in zip(columns_of(texts, rows), kinds)]
    mask = pa.array([r is None for r in rows]) if None in rows else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, [n for n, _ in kinds]), mask=mask)


@contextmanager
def no_cycles() -> Iterator[None]:
    """Many small tuples without any cycle: the collector would walk them again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def candidates(df: DataFrame, kinds: dict[str, Kind], text: str, out: str) -> DataFrame:
    """out: candidates of the given types, unresolved, type by type."""

    def run(col: pa.Array) -> pa.Array:
        texts = col.to_pylist()
        return as_array(texts, [None if t is None else scan(t, kinds) for t in texts])

    return df.withColumn(out, F.arrow_udf(run, CANDIDATE)(F.col(text)))


def spans_of(text: str, known: tuple, names: Names) -> list[Span]:
    """Resolved candidates of a text."""
    return resolved(scan(text, FIRST) + names.find(text, known), scan(text, SECOND))


def spans_of_types(text: str, known: tuple, names: Names, types: frozenset[str]) -> list[Span]:
    """Those of spans_of() that are of the given types.

    Whether a span stays depends on its rivals, of the very same span, on accounts around it and, for addresses, on
    e-mails around it. So other types are looked for only if their pattern fits the span of a wanted candidate.
    A name never drives out another type.
    """
    wanted = {t: k for t, k in KINDS.items() if t in types}
    first = {(s[0], s[1]) for s in scan(text, wanted)}
    if "MENO" in types:
        first |= {(s[0], s[1]) for s in names.find(text, known)}
    if not first:
        return []
    need = set(wanted) | {t for t, k in KINDS.items() if t not in wanted and (k.needs is None or k.needs in text) and any(k.pattern.fullmatch(text, a, b) for a, b in first)}
    if "MENO" in types or not need.isdisjoint(FIRST):
        need.add("BANKOVY_UCET")
    if "URL" in need:
        need.add("EMAIL")
    pick = lambda kinds: {t: k for t, k in kinds.items() if t in need}
    every = resolved(scan(text, pick(FIRST)) + (names.find(text, known) if "MENO" in types else []), scan(text, pick(SECOND)))
    return [s for s in every if s[2] in types]


def found_of(col: pa.Array, known: pa.Array, types: frozenset[str] | None = None) -> pa.Array:
    """Resolved candidates of texts with their known entities, of the given types only."""
    with no_cycles():
        return bulk.arrays(col.to_pylist(), known.to_pylist(), Names(), types)


def _each(col: pa.Array, known: pa.Array, spans: Callable[[str, tuple, Names], list[Span]]) -> pa.Array:
    with no_cycles():
        names, texts = Names(), col.to_pylist()
        return as_array(texts, [None if t is None else spans(t, tuple(k or ()), names) for t, k in zip(texts, known.to_pylist())])


def found(col: pa.Array, known: pa.Array) -> pa.Array:
    """Resolved candidates of texts with their known entities, for SQL."""
    return found_of(col, known)


def unresolved(units: DataFrame, known: str, out: str) -> DataFrame:
    """out: candidates of the first types and of names, before any rule."""

    def run(col: pa.Array, entities: pa.Array) -> pa.Array:
        return _each(col, entities, lambda t, k, names: scan(t, FIRST) + names.find(t, k))

    return units.withColumn(out, F.arrow_udf(run, CANDIDATE).asNondeterministic()(F.col("text"), F.col(known)))


def contested(units: DataFrame, known: str, out: str) -> DataFrame:
    """out: resolved candidates that several claim, of the first types and names, in one pass over the text; claims of each.

    Later types don't matter to these: of several first types and names on one span never the name is left.
    """
    kind = CANDIDATE.replace("group_key:string", "group_key:string,claims:int")

    def run(col: pa.Array, entities: pa.Array) -> pa.Array:
        with no_cycles():
            names, texts, rows, claims = Names(), col.to_pylist(), [], []
            for t, k in zip(texts, entities.to_pylist()):
                if t is None:
                    rows.append(None)
                    continue
                raw = scan(t, FIRST) + names.find(t, tuple(k or ()))
                n = Counter(s[:2] for s in raw)
                rows.append([s for s in resolved(raw, []) if n[s[:2]] > 1])
                claims += [n[s[:2]] for s in rows[-1]]
            spans = as_array(texts, rows)
            fields = [*spans.values.flatten(), pa.array(claims, pa.int32())]
            names_ = [f.name for f in spans.values.type] + ["claims"]
            return pa.ListArray.from_arrays(spans.offsets, pa.StructArray.from_arrays(fields, names_), mask=spans.is_null())

    return units.withColumn(out, F.arrow_udf(run, kind).asNondeterministic()(F.col("text"), F.col(known)))


def entities_of(known: str | None, extra_terms: list[str] | None) -> Column:
    """Known entities of a row, and a reviewer's own after those; blank ones don't count."""
    entities = F.coalesce(F.col(known), F.array().cast("array<string>")) if known else F.array().cast("array<string>")
    terms = [t.strip() for t in extra_terms or () if t.strip()]
    return F.concat(entities, F.array(*map(F.lit, terms))) if terms else entities


def detect(units: DataFrame, known: str | None = None, extra_terms: list[str] | None = None, only: Iterable[str] | None = None) -> DataFrame:
    """units with cands: resolved candidates ordered by span. known: a column of known entities. extra_terms: a reviewer's own, after those. only: the types wanted; what else is in the text is looked at as far as it matters to these."""
    types = None if only is None else frozenset(only)

    def run(col: pa.Array, entities: pa.Array) -> pa.Array:
        return found_of(col, entities, types)

    # Not deterministic in name only: else the optimizer may run it once for each use of its column.
    return units.withColumn("cands", F.arrow_udf(run, CANDIDATE).asNondeterministic()(F.col("text"), entities_of(known, extra_terms)))


def counted(units: DataFrame, known: str | None = None, extra_terms: list[str] | None = None) -> DataFrame:
    """type, auto, n, starts: how many candidates detect() finds and the sum of their starts. A task counts its own; only these counts leave it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, names = np.zeros((2, len(bulk.TYPES), 2), np.int64), Names()
        with no_cycles():
            for batch in batches:
                bulk.tally(batch.column(0).to_pylist(), batch.column(1).to_pylist(), names, totals)
        t, sure = np.nonzero(totals[0])
        columns = [[bulk.TYPES[i] for i in t], pa.array(sure == 1), *totals[:, t, sure]]
        yield pa.RecordBatch.from_pydict(dict(zip(["type", "auto", "n", "starts"], columns)))

    counts = units.select("text", entities_of(known, extra_terms).alias("_known")).mapInArrow(run, "type string, auto boolean, n long, starts long")
    return counts.groupBy("type", "auto").agg(F.sum("n").alias("n"), F.sum("starts").alias("starts"))


def register(spark: SparkSession) -> None:
    """detect_spans(text, entities) for SQL."""
    spark.udf.register("detect_spans", F.arrow_udf(found, CANDIDATE))
