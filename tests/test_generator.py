"""Generated documents: the same from their seed, whole through the engine."""

import collections
import json

from inkveil.functions import checks as C
from inkveil.operators import evaluate as E, redact as R
from inkveil.sources import docx as X, generator as G, truth as S


def test_seeds_and_truth(spark, tmp_path):
    one, two = (sorted(G.generate(spark, 14).repartition(n).collect()) for n in (1, 3))
    assert one == two and len(one) == 15 and one != sorted(G.generate(spark, 14, 7).collect())
    image = [r for r in one if r.must_be_refused]
    assert [r.source_file for r in image] == ["image_only.pdf"] and image[0].units == []
    assert {r.doc_type for r in one} == set(G.DOC_TYPES) and {r.format for r in one} == {"docx", "pdf"}
    for r in one:
        text = " ".join(r.parts.values())
        assert all(p.surface in text for p in r.pii)
        for p in r.pii:
            check = {"RODNE_CISLO": C.birth_number, "ICO": C.company_number, "IBAN": C.iban, "BANKOVY_UCET": C.account}.get(p.type)
            if check:
                assert check(p.surface) is p.auto_redact and p.should_flag is not p.auto_redact
        if not r.must_be_refused:
            kinds = collections.Counter(p.type for p in r.pii)
            assert {"MENO", "DIC", "URL", "SUMA", "LV", "TIME_STAMP", "OBEC"} <= set(kinds)
        (tmp_path / f"{r.source_file}.gt.json").write_text(G.truth_json(r.asDict(recursive=True)))
    read = S.read_truth(spark, str(tmp_path))
    assert read.count() == sum(len(r.pii) for r in one) and S.read_truth_files(spark, str(tmp_path)).filter("must_refuse").count() == 1
    assert json.loads((tmp_path / "image_only.pdf.gt.json").read_text())["text_layer"] is False


def test_nothing_leaks_and_look_alikes_stay(spark):
    made = G.generate(spark, 24, 5).cache()
    truth = G.truth_of(made)
    assert E.collisions(truth).count() == 0
    labelled = R.label(R.decide(R.spans(G.units_of(made), "known")))
    out = X.parsed(X.write_docx(made.filter("format = 'docx'").selectExpr("source_file as path", "content"), labelled))
    parts = out.selectExpr("path as doc_id", "explode(parts) as (part, text)")
    of = truth.join(parts.select("doc_id").distinct(), "doc_id", "left_semi")
    assert {r.type for r in E.leaks(of, parts).collect()} <= set(E.CLASS_A)
    for r in E.rates(of, parts).collect():
        assert r.decoy_survival in (None, 1.0) and r.flag_survival in (None, 1.0) and (r.recall in (None, 1.0) or r.type in E.CLASS_A), r
