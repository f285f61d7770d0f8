"""What each identifier type looks like: one expression a type, put together from a few parts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import NamedTuple

from inkveil.functions import checks

# Month names in the genitive, top-level domains that need no scheme, register sections and court
# letters of the commercial register, letters of filing numbers, agendas of courts (longer ones first).
MONTHS = "januára februára marca apríla mája júna júla augusta septembra októbra novembra decembra"
DOMAINS = "sk cz com eu org net info biz edu gov io dev"
SECTIONS, COURTS = "Sro Sa Pš Dr", "VBTNZ"
FILINGS, AGENDAS = "VZPXR", "Cb Ro Er C T D"


def digits(least: int, most: int | None = None) -> str:
    return rf"\d{{{least}}}" if most is None else rf"\d{{{least},{most}}}"


def either(*options: str) -> str:
    return "(?:" + "|".join(options) + ")"


def one_of(words: str) -> str:
    return either(*words.split())


def grouped(size: str, gap: str, times: str) -> str:
    return f"(?:{gap}{size}){times}"


GAP, EDGE, NO_DIGIT, NEW_NUMBER = "[ \u00a0]", r"\b", r"(?!\d)", r"(?<!\d)"
LABEL = "[A-Za-z0-9-]+"
HOST = LABEL + grouped(LABEL, r"\.", "*") + r"\."
AMOUNT = digits(1, 3) + grouped(digits(3), GAP, "*")
LOCAL_PHONE = GAP.join(["", digits(3), digits(3)])


class Kind(NamedTuple):
    """pattern: of the whole surface. needs: what each match holds, so that a text without it is passed over. shape: what a match must be to count; sure: whether it is redacted unasked. spans: a faster way to the same places as the pattern's."""

    pattern: re.Pattern
    needs: str | None = None
    shape: Callable[[str], bool] | None = None
    sure: Callable[[str], bool] | None = None
    spans: Callable[[str], Iterable[tuple[int, int]]] | None = None


def kind(*options: str, **rest) -> Kind:
    """The options are tried in order at each place."""
    return Kind(re.compile("|".join(options)), **rest)


#: Types that contest each other's spans, in the order of their candidates.
FIRST = {
    "RODNE_CISLO": kind(EDGE + digits(6) + "/" + digits(4) + EDGE, needs="/", shape=checks.birth_number_shape, sure=checks.birth_number),
    "ICO": kind(EDGE + digits(8) + EDGE, sure=checks.company_number),
    "IC_DPH": kind(EDGE + "SK" + digits(10) + EDGE, needs="SK"),
    "DIC": kind(EDGE + digits(10) + EDGE),
    "IBAN": kind(EDGE + "SK" + digits(2) + grouped(digits(4), " ?", "{5}") + EDGE, needs="SK", sure=checks.iban),
    "BANKOVY_UCET": kind(NEW_NUMBER + digits(1, 6) + "-" + digits(2, 10) + "/" + digits(4) + NO_DIGIT, needs="/", sure=checks.account),
}
#: Types that come after names, in the order of their candidates.
SECOND = {
    "EMAIL": kind(rf"{EDGE}[A-Za-z0-9._%+-]+@{HOST}[A-Za-z]{{2,}}{EDGE}", needs="@"),
    "URL": kind(EDGE + either(r"https?://(?:www\.)?", r"www\.") + HOST + "[A-Za-z]{2,}" + EDGE, EDGE + HOST + one_of(DOMAINS) + EDGE, needs="."),
    "TELEFON": kind(r"\+421" + GAP.join(["", digits(1, 3), digits(3, 4), digits(3, 4)]), EDGE + "0" + digits(3) + LOCAL_PHONE + EDGE, EDGE + "0" + digits(1, 2) + "/" + digits(3) + LOCAL_PHONE + EDGE),
    "DATUM": kind(
        EDGE + r"\.".join([digits(1, 2), digits(1, 2), digits(4)]) + EDGE,
        EDGE + rf"\.{GAP}".join([digits(2), digits(2), digits(4)]) + EDGE,
        EDGE + "-".join([digits(4), digits(2), digits(2)]) + EDGE,
        EDGE + rf"{digits(1, 2)}\.{GAP}{one_of(MONTHS)}{GAP}{digits(4)}" + EDGE,
    ),
    "SUMA": kind(*[EDGE + AMOUNT + ending for ending in (rf",\d{{2}}{GAP}€", rf",\d{{2}}{GAP}EUR\b", rf",-{GAP}€", rf"{GAP}Sk\b")]),
    "LV": kind(rf"{EDGE}LV č\.{GAP}{digits(1, 4)}{NO_DIGIT}", needs="LV č."),
    "PARCELA": kind(rf"{EDGE}parc\. č\.{GAP}{digits(1, 4)}(?:/{digits(1, 2)})?{NO_DIGIT}", rf"{EDGE}parcela registra „[CE]“ KN č\.{GAP}{digits(1, 4)}/{digits(1, 2)}{NO_DIGIT}", needs=" č."),
    "ORSR_VLOZKA": kind(rf"{EDGE}Oddiel: {one_of(SECTIONS)}, Vložka č\.{GAP}{digits(3, 5)}/[{COURTS}]{EDGE}", needs="Oddiel: "),
    "SPISOVA_ZNACKA": kind(rf"{EDGE}[{FILINGS}]-{digits(1, 4)}/{digits(4)}{NO_DIGIT}", rf"{EDGE}{digits(1, 2)}{one_of(AGENDAS)}/{digits(1, 3)}/{digits(4)}{NO_DIGIT}", needs="/"),
}


# Faster ways to the same places. A search is quick where each match starts with a character of few, so an edge is looked
# for behind the first character, or the search starts from a rare character inside and goes to the left.


def quick(pattern: str) -> Callable[[str], list[tuple[int, int]]]:
    """Places of an equal pattern that starts with a literal or a class."""
    every = re.compile(pattern).finditer
    return lambda text: [m.span() for m in every(text)]


def around(hit: str, before: str, after: str, options: str) -> Callable[..., list[tuple[int, int]]]:
    """Places of options, of which each match holds a hit, and else only characters of before to its left and of after to its right. places: of all that may be hits, if known."""
    hits, is_hit, whole = re.compile(hit).finditer, re.compile(hit).match, re.compile(options).finditer
    left, right = re.compile(f"(?:{before})*"), re.compile(f"(?:{after})*")

    def run(text: str, places: Iterable[int] | None = None) -> list[tuple[int, int]]:
        out, done, seen, mirrored, n = [], 0, 0, None, len(text)
        for h in hits(text) if places is None else filter(None, (is_hit(text, p) for p in places)):
            a, b = h.span()
            if a < seen:
                continue
            mirrored = text[::-1] if mirrored is None else mirrored
            a = max(n - left.match(mirrored, n - a).end(), done)
            b = right.match(text, b).end()
            # One character more, so that an edge at the end is seen.
            for m in whole(text, a, b + 1):
                done = m.end()
                out.append(m.span())
            seen = b if before == after else done
        return out

    return run


_WORD = r"(?<!\w\d)"
_MONTH = one_of(MONTHS)
_ALIKE = "[A-Za-z0-9-]"
SPANS = {
    "RODNE_CISLO": around(r"/\d{4}\b", r"\d", "", EDGE + digits(6) + "/" + digits(4) + EDGE),
    "ICO": quick(rf"\d{_WORD}\d{{7}}\b"),
    "DIC": quick(rf"\d{_WORD}\d{{9}}\b"),
    "IC_DPH": quick(r"SK(?<!\wSK)\d{10}\b"),
    "IBAN": quick(r"SK(?<!\wSK)\d{2}(?: ?\d{4}){5}\b"),
    "BANKOVY_UCET": around(r"-\d{2,10}/\d{4}(?!\d)", r"\d", "", NEW_NUMBER + r"\d{1,6}-\d{2,10}/\d{4}(?!\d)"),
    "EMAIL": around("@", "[A-Za-z0-9._%+-]", "[A-Za-z0-9.-]", rf"{EDGE}[A-Za-z0-9._%+-]+@{HOST}[A-Za-z]{{2,}}{EDGE}"),
    "URL": around(rf"https?://|www\.|\.{one_of(DOMAINS)}\b", "[A-Za-z0-9.:/-]", "[A-Za-z0-9.:/-]", "|".join([EDGE + either(r"https?://(?:www\.)?", r"www\.") + HOST + "[A-Za-z]{2,}" + EDGE, EDGE + HOST + one_of(DOMAINS) + EDGE])),
    "TELEFON": quick(rf"[+0](?:(?<=\+)421{GAP}\d{{1,3}}{GAP}\d{{3,4}}{GAP}\d{{3,4}}|(?<=0)(?<!\w0)(?:\d{{3}}|\d{{1,2}}/\d{{3}}){GAP}\d{{3}}{GAP}\d{{3}}\b)"),
    "DATUM": quick(rf"\d{_WORD}(?:\d?\.(?:\d{{1,2}}\.\d{{4}}|{GAP}{_MONTH}{GAP}\d{{4}})|\d\.{GAP}\d{{2}}\.{GAP}\d{{4}}|\d{{3}}-\d{{2}}-\d{{2}})\b"),
    "SUMA": around("€|EUR|Sk", r"[\d \u00a0,-]", "", "|".join([EDGE + AMOUNT + ending for ending in (rf",\d{{2}}{GAP}€", rf",\d{{2}}{GAP}EUR\b", rf",-{GAP}€", rf"{GAP}Sk\b")])),
    "LV": quick(rf"LV(?<!\wLV) č\.{GAP}\d{{1,4}}(?!\d)"),
    "PARCELA": quick(rf"parc(?<!\wparc)(?:\. č\.{GAP}\d{{1,4}}(?:/\d{{1,2}})?(?!\d)|ela registra „[CE]“ KN č\.{GAP}\d{{1,4}}/\d{{1,2}}(?!\d))"),
    "ORSR_VLOZKA": quick(rf"Oddiel: (?<!\wOddiel: ){one_of(SECTIONS)}, Vložka č\.{GAP}\d{{3,5}}/[{COURTS}]\b"),
    "SPISOVA_ZNACKA": around(r"/\d{4}(?!\d)", r"[\dA-Za-z/-]", "", rf"{EDGE}[{FILINGS}]-{digits(1, 4)}/{digits(4)}{NO_DIGIT}|{EDGE}{digits(1, 2)}{one_of(AGENDAS)}/{digits(1, 3)}/{digits(4)}{NO_DIGIT}"),
}

FIRST, SECOND = ({t: k._replace(spans=SPANS[t]) for t, k in kinds.items()} for kinds in (FIRST, SECOND))
KINDS = FIRST | SECOND
#: Who keeps a span that several types of the first stage, or a name, claim.
PRECEDENCE = "RODNE_CISLO IBAN BANKOVY_UCET IC_DPH ICO DIC MENO".split()
