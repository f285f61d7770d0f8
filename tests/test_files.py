"""Intake, pages, paths, the verdict as text and the commands."""

from pyspark.sql import functions as F

from inkveil import __main__ as commands
from inkveil.operators import redact as R, summary
from inkveil.plans import catalog
from inkveil.sources import docx as D, files as FI


def test_intake_and_paths(spark, tmp_path):
    names = ["b.PDF", "a.docx", "x.txt", "b.PDF", "noend", "a.docx"]
    rows = FI.intake(spark.createDataFrame(list(enumerate(names)), "seq long, path string")).orderBy("seq").collect()
    assert [(r.seq, r.path) for r in rows] == [(0, "b.PDF"), (1, "a.docx")]
    paths = spark.createDataFrame([("d.x/a.docx", "written"), ("b", "written"), ("c.pdf", "incomplete")], "path string, status string")
    assert [tuple(r) for r in FI.exported(paths).collect()] == [("d.x/a.docx", "d.x/a_anon.docx", "d.x/a_anon_report.txt"), ("b", "b_anon", "b_anon_report.txt")]
    for n in ("a.docx", "image_only.pdf", "c.pdf", "d.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert sorted(r.path.rsplit("/")[-1] for r in FI.listing(spark, str(tmp_path)).collect()) == ["a.docx", "c.pdf"]


def test_pages(spark):
    rows = [("a", 1, "Ján No­vák, tel. 0905 123 456", ["No-vák"]), ("a", 2, " ", []), ("b", 1, " \n", []), ("c", 1, "a@b­c.sk", [])]
    pages = spark.createDataFrame(rows, "doc_id string, page_no long, text string, known array<string>")
    out, status = FI.redacted_pages(pages, "known")
    assert {(r.doc_id, r.page_no): r.text for r in out.collect()} == {("a", 1): "Ján [MENO_1], tel. [TELEFON_1]", ("a", 2): " ", ("c", 1): "[EMAIL_1]"}
    assert {r.doc_id: (r.status, r.skipped) for r in status.collect()} == {"a": ("written", []), "b": ("refused", []), "c": ("written", [])}
    lost = R.decide(R.spans(FI.page_units(pages, "known"), "known")).withColumn("surface", F.when(F.col("type") == "TELEFON", "elsewhere").otherwise(F.col("surface")))
    assert [r.type for r in FI.placed(lost, pages).filter("not located").collect()] == ["TELEFON"]


def test_verdict_as_text(spark):
    text, passed = summary.eval_report(*catalog.made(spark, 12))
    assert passed and text.startswith("leaks: none\n") and text.endswith("VERDICT: PASS\n") and "refused: 1" in text
    truth, files, originals, _, outputs = catalog.made(spark, 12)
    text, passed = summary.eval_report(truth, files, originals, originals, outputs.limit(11))
    assert not passed and "missing: 1" in text and "leak_ok: FAIL" in text and "coverage_ok: FAIL" in text


def test_commands(spark, tmp_path):
    assert commands.main([]) == 2 and commands.main(["redact", "x"]) == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(D.build([("body", ["Ján Novák a@b.sk"])]))
    assert commands.main(["redact", f"{tmp_path}/in", f"{tmp_path}/out", "Ján Novák"]) == 0
    done = spark.read.parquet(f"{tmp_path}/out/files").first()
    assert D.Document(bytes(done.content)).texts()[0][2] == "[MENO_1] [MENO_1] [EMAIL_1]"
    assert "EMAIL | [EMAIL_1] | 1 | body" in spark.read.parquet(f"{tmp_path}/out/reports").first().report
    assert commands.main(["generate", "3", f"{tmp_path}/made"]) == 0 and spark.read.parquet(f"{tmp_path}/made").count() == 4
    assert commands.main(["verdict", "6"]) == 0
