"""Sample documents with exact ground truth, as a table: a row a document, made anew from its seed alone.

Documents take turns of six types and two formats; one more is an image without text, which must be refused. Each has
two parties in all cases of declension and in several spellings, every identifier type in every shape, valid and with
a wrong checksum, look-alike numbers and capitalised words that must stay, and its marks spread over the parts of its
format. Entries: surface, type, auto_redact (sure), should_flag (wrong checksum), neither for look-alikes.

Defined cases: no documents give the image alone; equal seeds give equal rows on any machine and partitioning.
"""

from __future__ import annotations

import json
import random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from inkveil.functions import checks as C, patterns as P
from inkveil.operators.evaluate import part_surface
from inkveil.sources import docx as D

DOC_TYPES = "kupna_zmluva navrh_vklad zaloba vypis_lv splnomocnenie vypis_orsr".split()
CASES = "nom gen dat acc loc ins".split()
# Endings of declension by case, of masculine names, of feminine names in -a and surnames in -ová, of places in -ava and -ice.
MALE, FEMALE, SURNAME_F = ("", "a", "ovi", "a", "ovi", "om"), ("a", "y", "e", "u", "e", "ou"), ("ová", "ovej", "ovej", "ovú", "ovej", "ovou")
PLACE_AVA, PLACE_ICE = ("a", "y", "e", "u", "e", "ou"), ("e", None, "iam", "e", "iach", "ami")
FIRST_M, FIRST_F, SURNAMES = "Ján Milan Jozef Martin Michal Štefan Tomáš Adam".split(), "Jan Zuzan Elen Ivan Katarín Dan Ren Vier".split(), "Novák Horváth Kováč Hudák Polák Varg Kollár Bartoš Šimko Ďurián".split()
PLACES = [("Bratislav", "ava"), ("Trnav", "ava"), ("Koš", "ice"), ("Pezin", "ava")]
#: Capitalised words that share a beginning with a name and are no form of it.
WORDS = {"Kováč": "Kováčska", "Novák": "Nováčik", "Horváth": "Horvátsky", "Hudák": "Hudácka"}
SCHEMA = "source_file string, doc_type string, format string, seed long, must_be_refused boolean, known array<string>, units array<struct<unit_seq:int,location:string,text:string>>, parts map<string,string>, pii array<struct<surface:string,type:string,auto_redact:boolean,should_flag:boolean,part:string,grammatical_case:string>>, content binary"


class Person:
    def __init__(self, r: random.Random):
        self.family = r.choice([s for s in SURNAMES if s not in ("Varg", "Šimko")])
        if r.random() < 0.5:
            first = r.choice(FIRST_M)
            self.first, self.last = [first + e for e in MALE], [self.family + e for e in MALE]
        else:
            first = r.choice([f for f in FIRST_F if len(f) > 3 or f in ("Jan", "Dan", "Ren")])
            self.first, self.last = [first + e for e in FEMALE], [self.family + e for e in SURNAME_F]

    def full(self, case: int) -> str:
        return f"{self.first[case]} {self.last[case]}"

    def spellings(self) -> list[str]:
        """Full name, surname, and the surname after a title with a fixed space."""
        return [self.full(0), self.last[0], f"p. {self.last[0]}"]


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _checked(r: random.Random, make, check, valid: bool) -> str:
    """The first of random surfaces whose checksum holds, or doesn't."""
    while True:
        s = make()
        if check(s) is valid:
            return s


def birth_number(r: random.Random, valid: bool) -> str:
    return _checked(r, lambda: f"{r.randint(54, 99)}{r.choice([0, 50, 20, 70]) + r.randint(1, 12):02d}{r.randint(1, 28):02d}/{_digits(r, 4)}", C.birth_number, valid)


def company_number(r: random.Random, valid: bool) -> str:
    return _checked(r, lambda: _digits(r, 8), C.company_number, valid)


def iban(r: random.Random, valid: bool) -> str:
    gap = r.choice(["", " "])
    return _checked(r, lambda: gap.join(["SK" + _digits(r, 2), "1100", *[_digits(r, 4) for _ in range(4)]]), C.iban, valid)


def account(r: random.Random, valid: bool) -> str:
    return _checked(r, lambda: f"{_digits(r, 6)}-{r.randint(1, 9)}{_digits(r, 9)}/1100", C.account, valid)


def surfaces(r: random.Random) -> dict[str, str]:
    """One sure surface of each type without a checksum, in one of its shapes."""
    gap = lambda: r.choice("  ")
    day, month, year = r.randint(1, 28), r.randint(1, 12), r.randint(1950, 2030)
    amount = f"{r.randint(1, 999)}{gap()}{_digits(r, 3)}"
    return {
        "DIC": "20" + _digits(r, 8), "IC_DPH": "SK20" + _digits(r, 8),
        "EMAIL": r.choice(["{0}.{1}@example.sk", "{0}-{1}@mail.example.com", "{0}_{1}+x@x-1.eu"]).format(r.choice(["info", "office"]), r.randint(1, 999)),
        "URL": r.choice(["www.firma{}.sk", "https://www.firma{}.museum", "http://firma{}.example.org", "firma{}.eu"]).format(r.randint(1, 999)),
        "TELEFON": r.choice([f"+421{gap()}9{_digits(r, 2)}{gap()}{_digits(r, 3)}{gap()}{_digits(r, 3)}", f"09{_digits(r, 2)}{gap()}{_digits(r, 3)}{gap()}{_digits(r, 3)}", f"02/{_digits(r, 3)}{gap()}{_digits(r, 3)}{gap()}{_digits(r, 3)}"]),
        "DATUM": r.choice([f"{day}.{month}.{year}", f"{day:02d}.{gap()}{month:02d}.{gap()}{year}", f"{year}-{month:02d}-{day:02d}", f"{day}.{gap()}{r.choice(P.MONTHS.split())}{gap()}{year}"]),
        "SUMA": amount + r.choice([f",{_digits(r, 2)}{gap()}€", f",{_digits(r, 2)}{gap()}EUR", f",-{gap()}€", f"{gap()}Sk"]),
        "LV": f"LV č.{gap()}{r.randint(1, 9999)}",
        "PARCELA": r.choice([f"parc. č.{gap()}{r.randint(1, 9999)}", f"parc. č.{gap()}{r.randint(1, 9999)}/{r.randint(1, 99)}", f"parcela registra „{r.choice('CE')}“ KN č.{gap()}{r.randint(1, 9999)}/{r.randint(1, 99)}"]),
        "ORSR_VLOZKA": f"Oddiel: {r.choice(P.SECTIONS.split())}, Vložka č.{gap()}{r.randint(100, 99999)}/{r.choice(P.COURTS)}",
        "SPISOVA_ZNACKA": r.choice([f"{r.choice(P.FILINGS)}-{r.randint(1, 9999)}/{year}", f"{r.randint(1, 99)}{r.choice(P.AGENDAS.split())}/{r.randint(1, 999)}/{year}"]),
    }


def look_alikes(r: random.Random) -> list[tuple[str, str]]:
    """Numbers that look like identifiers and are none, with their kind."""
    return [("INVOICE_NO", f"Faktúra č. 2024{_digits(r, 3)}"), ("PAGE_COUNT", f"Strana {r.randint(1, 9)} z {r.randint(10, 40)}"), ("ORDER_NO", f"Obj. č. {r.randint(1, 999)}/2024"), ("ARTICLE_NO", f"čl. {r.randint(1, 30)} ods. {r.randint(1, 9)}"), ("CLAUSE_REF", f"bod {r.randint(1, 12)}.{r.randint(1, 9)}"), ("TIME_STAMP", f"{r.randint(8, 18):02d}:{r.randint(10, 59)} hod.")]


def document(i: int, n: int, seed: int) -> dict:
    """Document i of n; the last, beyond n, is the image."""
    kind, image = DOC_TYPES[i % len(DOC_TYPES)], i >= n
    own = seed * 1000 + (99999 if image else 10 * i)
    fmt = "pdf" if image or i // len(DOC_TYPES) % 2 else "docx"
    row = {"source_file": "image_only.pdf" if image else f"{kind}_{i:06d}.{fmt}", "doc_type": kind, "format": fmt, "seed": own, "must_be_refused": image, "known": [], "units": [], "parts": {}, "pii": [], "content": None}
    if image:
        return row
    r = random.Random(own)
    one, two = Person(r), Person(r)
    paragraphs: list[tuple[str, list]] = []

    def add(location: str, *pieces) -> None:
        """A paragraph of words and marks: (surface, type), sure unless told 'flag' or 'decoy', with the case of a name."""
        runs = []
        for x in pieces:
            if isinstance(x, tuple):
                surface, type_, how, case = (*x, "auto", None)[:4] if len(x) == 2 else (*x, None)[:4]
                row["pii"].append({"surface": surface, "type": type_, "auto_redact": how == "auto", "should_flag": how == "flag", "part": location, "grammatical_case": case})
                cut = r.randint(1, len(surface) - 1) if len(surface) > 1 and r.random() < 0.3 else 0  # a surface over two runs
                runs += [surface[:cut], surface[cut:]] if cut else [surface]
            else:
                runs.append(x)
        paragraphs.append((location, runs))

    name = lambda p, c: (p.full(c), "MENO", "auto", CASES[c])
    add("body", "Účastníkom je ", name(one, 0), " a protistranou ", name(two, 0), ".")
    for c, lead in enumerate(("Koná", "Podľa vôle", "Patrí", "Vidíme", "Hovorí sa o", "Spolu s")):
        add("body", f"{lead} ", name(one, c), "; ďalej len ", (one.last[c], "MENO", "auto", CASES[c]), ".")
    for s in one.spellings():
        add("body", "Uvádza sa aj ako ", (s.split(" ")[-1], "MENO"), " v spise." if s[:2] != "p." else " podľa listiny.")
    stem, end = r.choice(PLACES)
    place = [stem + (e or "") for e in (PLACE_AVA if end == "ava" else PLACE_ICE)] if end == "ava" else [stem + "ic" + (e or "") for e in PLACE_ICE]
    add("body", "Obec ", (place[0], "OBEC"), ", kataster ", (place[4], "KATASTER"), ".")
    found = surfaces(r)
    for t, s in found.items():
        add("body", f"{r.choice(['Údaj', 'Ďalší údaj', 'Záznam'])}: ", (s, t), "; koniec.")
    for t, make in (("RODNE_CISLO", birth_number), ("ICO", company_number), ("IBAN", iban), ("BANKOVY_UCET", account)):
        add("table_cell" if fmt == "docx" else "body", "Hodnota ", (make(r, True), t), ", chybná ", (make(r, False), t, "flag"), ".")
    for t, s in look_alikes(r):
        add("body", "Odkaz ", (s, t, "decoy"), " nie je údajom.")
    for p in (one, two):
        if p.family in WORDS:
            add("body", "Neďaleko je ", (WORDS[p.family], "CAPITALISED_COMMON", "decoy"), " dielňa.")
    if fmt == "docx":
        add("header", (found["EMAIL"], "EMAIL"), " | ", (found["URL"], "URL"))
        add("footer", "Kontakt ", (found["TELEFON"], "TELEFON"))
        add("footnote", "Pozri ", (two.last[1], "MENO", "auto", "gen"), ".")
        add("comment", "Overiť ", (one.full(1), "MENO", "auto", "gen"), ".")
        add("ins", "Doplnené: ", (found["SUMA"], "SUMA"))
        add("del", "Zrušené: ", (two.full(0), "MENO"))
        row["content"] = D.build([(w, x) for w, x in paragraphs], {"creator": f"JUDr. {two.full(0)}", "Company": f"Kancelária {two.last[0]}"})
        row["parts"] = D.extract(row["content"])
        row["units"] = [{"unit_seq": u, "location": w, "text": t} for u, w, t in D.Document(row["content"]).texts()]
        row["pii"].append({"surface": two.full(0), "type": "MENO", "auto_redact": True, "should_flag": False, "part": "metadata_core", "grammatical_case": None})
        rename = {"ins": "tracked_change_ins", "del": "tracked_change_del"}
        for x in row["pii"]:
            x["part"] = rename.get(x["part"], x["part"])
    else:
        texts = ["".join(x) for _, x in paragraphs]
        row["units"] = [{"unit_seq": u, "location": "page", "text": t} for u, t in enumerate(texts)]
        row["parts"] = {"text_layer": "\n".join(texts), "annotations": f"Overiť {one.full(3)}", "form_fields": two.full(0), "attachments": found["TELEFON"], "info_metadata": f"JUDr. {two.full(0)}", "xmp": two.full(0)}
        for part, s, t in (("annotation", one.full(3), "MENO"), ("form_field", two.full(0), "MENO"), ("attachment", found["TELEFON"], "TELEFON"), ("metadata", two.full(0), "MENO"), ("xmp", two.full(0), "MENO")):
            row["pii"].append({"surface": s, "type": t, "auto_redact": True, "should_flag": False, "part": part, "grammatical_case": None})
    row["known"] = [one.full(0), two.full(0)]
    return row


def generate(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n documents and the image, as SCHEMA."""
    pairs = pa.map_(pa.string(), pa.string())
    unit = pa.struct([("unit_seq", pa.int32()), ("location", pa.string()), ("text", pa.string())])
    mark = pa.struct([("surface", pa.string()), ("type", pa.string()), ("auto_redact", pa.bool_()), ("should_flag", pa.bool_()), ("part", pa.string()), ("grammatical_case", pa.string())])
    kinds = {"source_file": pa.string(), "doc_type": pa.string(), "format": pa.string(), "seed": pa.int64(), "must_be_refused": pa.bool_(), "known": pa.list_(pa.string()), "units": pa.list_(unit), "parts": pairs, "pii": pa.list_(mark), "content": pa.binary()}

    def run(batches):
        for b in batches:
            rows = [document(i, n, seed) for i in b.column(0).to_pylist()]
            cols = [pa.array([list(r[k].items()) if k == "parts" else r[k] for r in rows], t) for k, t in kinds.items()]
            yield pa.RecordBatch.from_arrays(cols, list(kinds))

    return spark.range(n + 1).mapInArrow(run, SCHEMA)


def units_of(made: DataFrame) -> DataFrame:
    """doc_id, unit_seq, location, text, known."""
    return made.select(F.col("source_file").alias("doc_id"), "known", F.explode("units").alias("u")).select("doc_id", "u.unit_seq", "u.location", "u.text", "known")


def truth_of(made: DataFrame) -> DataFrame:
    """doc_id, surface, type, auto_redact, should_flag, part (of the ground truth), extracted (the part of a file that holds it)."""
    d = made.select(F.col("source_file").alias("doc_id"), "format", F.explode("pii").alias("p"))
    return d.select("doc_id", "p.surface", "p.type", "p.auto_redact", "p.should_flag", "p.part", part_surface(F.col("format"), F.col("p.part")).alias("extracted"))


def files_of(made: DataFrame) -> DataFrame:
    return made.select(F.col("source_file").alias("doc_id"), F.col("must_be_refused").alias("must_refuse"))


def originals_of(made: DataFrame) -> DataFrame:
    """doc_id, part, text."""
    return made.select(F.col("source_file").alias("doc_id"), F.explode("parts").alias("part", "text"))


def truth_json(row: dict) -> str:
    """A document's ground truth as its *.gt.json file."""
    pii = [{"id": f"pii_{i:04d}", **{k: p[k] for k in ("surface", "type", "auto_redact", "should_flag", "grammatical_case")}, "location": {"surface_part": p["part"], "detail": {}}} for i, p in enumerate(row["pii"], 1)]
    entities = [{"entity_id": f"e{i}", "canonical": k, "category": "MENO", "variants": []} for i, k in enumerate(row["known"])]
    return json.dumps({"source_file": row["source_file"], "doc_type": row["doc_type"], "seed": row["seed"], "text_layer": not row["must_be_refused"], "must_be_refused": row["must_be_refused"], "entities": entities, "pii": pii}, ensure_ascii=False)
