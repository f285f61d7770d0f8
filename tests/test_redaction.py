"""Golden strings of detection and of rewriting."""

import json

import pytest
from pyspark.sql import functions as F

from inkveil.functions import text as T
from inkveil.operators import evaluate as E, redact as R
from inkveil.operators.detect import detect
from inkveil.sources import truth as S
from inkveil.streaming.redaction import redact_stream

GOLDEN = [
    ("850315/0018", "RODNE_CISLO", True), ("850315/0019", "RODNE_CISLO", False), ("12345679", "ICO", True), ("12345670", "ICO", False),
    ("8503150018", "DIC", True), ("SK24 1100 0000 0026 1234 5678", "IBAN", True), ("013389-1543039117/1100", "BANKOVY_UCET", True), ("013389-1543039118/1100", "BANKOVY_UCET", False),
]
NOTHING = ["Obj. č. 123/2024", "bod 4.2", "14:35 hod.", "", "Kováčska dielňa"]


@pytest.fixture(scope="module")
def found(spark):
    texts = [g[0] for g in GOLDEN] + NOTHING + ["Novákovcov a Kováčovej", "a@b.sk alebo www.x.sk", None]
    df = spark.createDataFrame([(i, t, ["Ján Novák", "Ján Kováč"]) for i, t in enumerate(texts)], "i long, text string, known array<string>")
    return {t: r.cands for t, r in zip(texts, sorted(detect(df, "known").select("i", "cands").collect()))}


def test_golden(found):
    for text, kind, auto in GOLDEN:
        assert [(c.type, c.surface, c.auto) for c in found[text]] == [(kind, text, auto)], text


def test_nothing(found):
    for t in NOTHING:
        assert found[t] == []
    assert found[None] is None


def test_names_and_addresses(found):
    assert [c.surface for c in found["Novákovcov a Kováčovej"]] == ["Novákovcov", "Kováčovej"]
    assert [c.type for c in found["a@b.sk alebo www.x.sk"]] == ["EMAIL", "URL"]


def test_worked_example(spark):
    text = "Ján Novák, RČ 850315/0018, účet 013389-1543039117/1100, chybné 850315/0019."
    u = spark.createDataFrame([(1, 1, "body", text, ["Ján Novák"])], "doc_id long, unit_seq int, location string, text string, known array<string>")
    decided = R.decide(R.spans(u, "known"))
    assert R.redact(u, R.label(decided)).first().text == "[MENO_1] [MENO_1], RČ [RODNE_CISLO_1], účet [BANKOVY_UCET_1], chybné 850315/0019."
    assert [r.surface for r in R.low_confidence(decided).collect()] == ["850315/0019"]


SHAPES = {
    "EMAIL": ["a.b+c@x-1.example.com", "a@x-.sk"],
    "URL": ["https://www.firma.museum", "http://a.b.sk", "www.x-y.example", "firma.eu"],
    "TELEFON": ["+421 905 123 456", "+421\u00a02\u00a01234\u00a05678", "0905 123\u00a0456", "02/123 456 789", "046/123 456 789"],
    "DATUM": ["1.1.2020", "05. 06. 2020", "05.\u00a006. 2020", "2020-05-06", "7. decembra 1999"],
    "SUMA": ["1 234,50 €", "12\u00a0345\u00a0678,00\u00a0EUR", "5,- €", "100 000 Sk"],
    "LV": ["LV č. 12", "LV č.\u00a01234"],
    "PARCELA": ["parc. č. 12/3", "parc. č.\u00a0999", "parcela registra „C“ KN č. 5/17", "parcela registra „E“ KN č. 123/4"],
    "ORSR_VLOZKA": ["Oddiel: Sro, Vložka č. 123/V", "Oddiel: Pš, Vložka č.\u00a012345/T"],
    "SPISOVA_ZNACKA": ["V-1/2024", "R-1234/2025", "12Cb/345/2025", "1C/1/2020", "33Er/9/2021"],
    "IBAN": ["SK2411000000002612345678"],
    "IC_DPH": ["SK2021234567"],
}
NEGATIVE = ["123/2024", "1234567", "123456789", "850315 0018", "851315/0018", "850332/0018", "SK24\u00a01100 0000 0026 1234 5678", "x@y", "dokument.pdf", "0905123456789", "1.1.20", "7. December 1999", "1 234", "LV č. 12345", "parc. č. 12345", "Oddiel: Xyz, Vložka č. 123/V", "A-1/2024", "12Ab/345/2025"]
OVERLAPS = {"+421 90 0905 123 456": [("TELEFON", "+421 90 0905 123")], "1.1.2020-01-02": [("DATUM", "1.1.2020")], "12345670 a 12345679": [("ICO", "12345670"), ("ICO", "12345679")], "a.b@www.x.sk": [("EMAIL", "a.b@www.x.sk")]}
DECLINED = {
    "Novák": "Novák Nováka Novákovi Novákom Novákovci Novákovcov Nováková Novákovej Novákovú Novákovou".split(),
    "Košice": "Košice Košíc Košiciam Košiciach Košicami".split(),
    "Levoča": "Levoča Levoče Levoči Levoču Levočou".split(),
    "Bratislava": "Bratislava Bratislavy Bratislave Bratislavu Bratislavou".split(),
    "Ján Novák": "Ján Jána Jánovi Jánom Novák Nováka Novákovi Novákovci".split(),
}
OTHERS = {"Kováč": ["Kováčska", "Kováčskej"], "Kučera": ["Kučeravý", "Kučeravej"], "Novák": ["Nováčik", "Nováčika"], "Horváth": ["Horvátsky"], "Hudák": ["Hudácka"], "Levoča": ["Levočský"]}


def spans_of(spark, rows):
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "i long, text string, known array<string>")
    return [r.cands for r in sorted(detect(df, "known").select("i", "cands").collect())]


def test_shapes_and_negatives(spark):
    cases = [(t, s) for t, every in SHAPES.items() for s in every]
    for (t, s), got in zip(cases, spans_of(spark, [(f"({s})", None) for _, s in cases])):
        assert [(c.type, c.surface, c.start) for c in got] == [(t, s, 1)], s
    for s, got in zip(NEGATIVE, spans_of(spark, [(s, None) for s in NEGATIVE])):
        assert got == [], s
    for (s, want), got in zip(OVERLAPS.items(), spans_of(spark, [(s, None) for s in OVERLAPS])):
        assert [(c.type, c.surface) for c in got] == want


def test_declension_edges_and_equal_spans(spark):
    cases = [(e, f) for e, forms in DECLINED.items() for f in forms]
    for (e, f), got in zip(cases, spans_of(spark, [(f"videl {f}, tam", [e]) for e, f in cases])):
        assert [(c.type, c.surface, c.start) for c in got] == [("MENO", f, 6)], (e, f)
    cases = [(e, f) for e, forms in OTHERS.items() for f in forms]
    for (e, f), got in zip(cases, spans_of(spark, [(f"videl {f}, tam", [e]) for e, f in cases])):
        assert got == [], (e, f)
    edges = list(T.EDGE)
    for c, got in zip(edges, spans_of(spark, [(f"{c}Novák{c}{c}", ["Novák"]) for c in edges])):
        assert [(x.surface, x.start) for x in got] == [("Novák", 1)], c
    both = spans_of(spark, [("12345679", ["12345679"]), ("12345670", ["12345670"]), ("2020-01-02", ["2020-01-02"]), ("Novák-Kováč", ["Novák"])])
    assert [[(c.type, c.auto) for c in x] for x in both] == [[("ICO", True)], [("ICO", False)], [("DATUM", True)], []]


def test_labels_share_a_start_and_rewriting_overlaps(spark):
    rows = [(1, 1, "body", "abcdef", "A", "ab", 0, 2, True, "ab", ""), (1, 1, "body", "abcdef", "B", "abcd", 0, 4, True, "abcd", ""), (1, 1, "body", "abcdef", "A", "cde", 2, 5, True, "cde", "")]
    d = spark.createDataFrame(rows, "doc_id long, unit_seq int, location string, text string, type string, surface string, start int, end int, auto boolean, group_key string, snippet string")
    k = R.label(R.decide(d)).orderBy("start", "end").collect()
    assert [r.label for r in k] == ["[A_1]", "[A_1]", "[A_2]"]
    assert R.redact(d.select("doc_id", "unit_seq", "location", "text").distinct(), R.label(R.decide(d))).first().text == "[A_1][A_2]f"


def test_redacted_is_redact(spark):
    rows = [(i % 3, i, "body", t, ["Ján Novák"]) for i, t in enumerate(["Ján Novák a@b.sk", "a@b.sk, 12345679 a 12345670", None, "", "nič", "Novákovci 12345679 12345679"])]
    u = spark.createDataFrame(rows, "doc_id int, unit_seq int, location string, text string, known array<string>").repartition(3)
    one = R.redacted(u, "known").orderBy("unit_seq").collect()
    assert one == R.redact(u, R.label(R.decide(R.spans(u, "known")))).orderBy("unit_seq").collect()
    assert one[1].text == "[EMAIL_1], [ICO_1] a 12345670" and one[5].text == "[MENO_1] [ICO_1] [ICO_1]"


def test_report_text(spark):
    rows = [(1, 1, "body", "MENO", "Novak", True, "k1"), (1, 2, "header", "MENO", "Novak", True, "k1"), (1, 3, "body", "MENO", "Horak", True, "k2"), (1, 4, "footnote", "RODNE_CISLO", "900101/0000", False, "k3"), (2, 1, "body", "DIC", "2502182454", True, "k4")]
    d = spark.createDataFrame([(a, b, c, t, s, 0, len(s), x, k, "") for a, b, c, t, s, x, k in rows], "doc_id long, unit_seq int, location string, type string, surface string, start int, end int, auto boolean, group_key string, snippet string")
    d = R.decide(d)
    one, two = [r.report for r in R.report_text(R.label(d), d).orderBy("doc_id").collect()]
    assert "TYPE | label | count | locations\nMENO | [MENO_1] | 2 | body, header\nMENO | [MENO_2] | 1 | body\n\n[LOW CONFIDENCE" in one
    assert one.endswith("type | surface | location\nRODNE_CISLO | 900101/0000 | footnote\n") and two.endswith("location\n(none)\n")


def test_evaluation(spark):
    truth = spark.createDataFrame([("a.docx", "Novák", "MENO", True, False, "body"), ("a.docx", "Novákov dom", "DECOY", False, False, "body"), ("a.docx", r"x\E.*", "URL", True, False, "header"), ("a.docx", "12345670", "ICO", False, True, "body")], "doc_id string, surface string, type string, auto_redact boolean, should_flag boolean, part string")
    text = "Novákov dom 12345670 Novákovi patrí dom"
    doc = lambda t: spark.createDataFrame([("a.docx", "document_xml", t)], "doc_id string, part string, text string")
    assert [(r.surface, r.gt_parts) for r in E.leaks(truth, doc(text)).collect()] == [("Novák", "body")]
    assert E.leaks(truth, doc("Novákov dom x\\Eyz")).count() == 0 and E.leaks(truth, doc(r"x\E.*")).count() == 1
    kept = E.retention(truth, doc(text), doc("dom patrí Novákov")).first()
    assert (kept.kept, kept.total) == (2, 3)  # of dom, patrí, dom; what a surface touches isn't content
    files = spark.createDataFrame([("a.docx", False)], "doc_id string, must_refuse boolean")
    greedy, _ = E.baseline("greedy", doc(text), truth, files)
    assert greedy.first().text == "Novákov dom [REDACTED] [REDACTED]ovi patrí dom"
    outs = spark.createDataFrame([("a_anon.docx", None)], "path string, error string")
    assert E.classified(files, outs).first().status == "graded"
    assert E.format_of(F.lit("X.DOCX")) is not None
    with pytest.raises(Exception, match="decoy and real"):
        E.checked(truth.unionByName(truth.filter("type = 'DECOY'").withColumn("auto_redact", F.lit(True)))).collect()
    assert spark.range(1).select(E.part_surface(F.lit("docx"), F.lit("table_cell"))).first()[0] == "document_xml"
    with pytest.raises(Exception, match="no extracted part"):
        spark.range(1).select(E.part_surface(F.lit("pdf"), F.lit("header"))).collect()


def test_truth_files_and_stream(spark, tmp_path):
    gt = {"source_file": "a.docx", "doc_type": "zaloba", "must_be_refused": False, "entities": [{"entity_id": "e", "canonical": "Ján Novák", "category": "MENO", "variants": []}], "pii": [{"id": "p", "surface": "Novák", "type": "MENO", "auto_redact": True, "should_flag": False, "location": {"surface_part": "body", "detail": {"paragraph_index": "1"}}}]}
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt" / "a.docx.gt.json").write_text(json.dumps(gt, ensure_ascii=False))
    (tmp_path / "gt" / "b.docx.gt.json").write_text(json.dumps({**gt, "source_file": "b.docx", "must_be_refused": True, "entities": [], "pii": []}))
    assert [tuple(r) for r in S.read_truth(spark, f"{tmp_path}/gt").select("doc_id", "surface", "part").collect()] == [("a.docx", "Novák", "body")]
    assert [(r.doc_id, r.must_refuse, r.known) for r in S.read_truth_files(spark, f"{tmp_path}/gt").orderBy("doc_id").collect()] == [("a.docx", False, ["Ján Novák"]), ("b.docx", True, [])]
    assert spark.range(1).select(S.known_lines(F.lit(" a \n\n\u00a0\r\nb"))).first()[0] == ["a", "b"]
    schema = "doc_id long, unit_seq int, location string, text string"
    spark.createDataFrame([(1, 1, "body", "a@b.sk a 12345679")], schema).write.parquet(f"{tmp_path}/in")
    q = redact_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").first().text == "[EMAIL_1] a [ICO_1]"
