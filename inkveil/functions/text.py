"""String functions: folding, stems, tokens, group norms, snippets; as Column expressions, and stems and tokens in Python for detection."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, functions as F

# Long vowels and syllabic consonants with their short forms; listed endings of declined names;
# punctuation that is no part of a token at its edges: ASCII, ellipsis, quotes, guillemets, dashes, minus, dot, section.
LONG, SHORT = "áéíóúýĺŕ", "aeiouylr"
ENDINGS = "a e i o u y om ou ov ovi ova ovu ove ovej ovou ovom ovci ovcov iam iach ami ovce oviec ovciam ovciach ovcami".split()
EDGE = ".,;:!?()[]{}<>\"'/\\|*_-" + "…" + "„“”" + "‚‘’" + "«»‹›" + "–—−" + "·§"
_FOLD = str.maketrans(LONG, SHORT)
_RUN = re.compile(r"\S+")


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def fold_length(c: Column) -> Column:
    return F.translate(c, LONG, SHORT)


def stem(word: Column) -> Column:
    """The folded word without its longest listed ending, of which three letters at least stay."""
    return F.regexp_replace(fold_length(casefold(word)), rf"^(.{{3,}}?)(?:{'|'.join(ENDINGS)})$", "$1")


def normalize(c: Column) -> Column:
    return casefold(F.regexp_replace(c, r"(?U)\s", ""))


def soft_hyphens(c: Column) -> Column:
    """Each soft hyphen as a hyphen; one for one, so that places stay."""
    return F.translate(c, "\u00ad", "-")


def snippet(text: Column, start: Column, end: Column, width: int = 40) -> Column:
    """What stands around a span, white space collapsed."""
    a = F.greatest(start - width, F.lit(0))
    return F.trim(F.regexp_replace(F.substring(text, a + 1, end + width - a), r"(?U)\s+", " "))


_LAST = {e[-1] for e in ENDINGS}
_LENGTHS, _ENDINGS = sorted({len(e) for e in ENDINGS}, reverse=True), set(ENDINGS)


def stem_of(word: str) -> str:
    """stem() of a Python string."""
    w = word.casefold().translate(_FOLD)
    if w[-1:] in _LAST:
        for n in _LENGTHS:
            if len(w) - n >= 3 and w[-n:] in _ENDINGS:
                return w[:-n]
    return w


def tokens(text: str) -> Iterator[tuple[str, int]]:
    """Runs without white space, without edge punctuation, and where they start; none that are empty."""
    for m in _RUN.finditer(text):
        left = m[0].lstrip(EDGE)
        core = left.rstrip(EDGE)
        if core:
            yield core, m.end() - len(left)


#: White space as (?U)\s takes it.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def snippet_of(text: str, start: int, end: int, width: int = 40) -> str:
    """snippet() of a Python string."""
    return _SPACE.sub(" ", text[max(start - width, 0) : end + width]).strip(" ")


def norm_of(surface: str) -> str:
    """normalize() of a Python string."""
    return "".join(surface.split()).casefold()
