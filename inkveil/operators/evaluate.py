"""Grading redacted text against ground truth: leaks, rates by type, retention, gates, verdicts, manifests, baselines.

truth: doc_id, surface, type, auto_redact, should_flag, part. surfaces: doc_id, part, text (redacted or original).
A document's surfaces are gathered before they meet its text, so that each text is read once, in Arrow batches.

Defined cases: an empty surface is nowhere; null texts hold nothing; ratios over nothing are null, and gates pass them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

# Least shares that gates ask for; parts that are metadata, and those that a scrub of a page file
# covers; types that count as places and firms, which the leak verdict leaves out; doubtful types that the greedy baseline takes.
RETENTION, DECOYS, FLAGS = 0.98, 0.95, 1.0
METADATA = ("core_xml", "app_xml", "custom_xml", "info_metadata", "xmp")
SCRUB = ("form_fields", "attachments", "info_metadata", "xmp", "annotations")
CLASS_A = ("OBEC", "KATASTER", "ORG")
GREEDY_FLAGS = ("RODNE_CISLO", "ICO", "IBAN")
# Where a part of the ground truth is found in an extracted file, by format.
PARTS = {
    "docx": {"body": "document_xml", "table_cell": "document_xml", "textbox": "document_xml", "tracked_change_ins": "document_xml", "tracked_change_del": "document_xml", "header": "header", "footer": "footer", "footnote": "footnotes", "endnote": "endnotes", "comment": "comments", "metadata_core": "core_xml", "metadata_app": "app_xml"},
    "pdf": {"body": "text_layer", "annotation": "annotations", "form_field": "form_fields", "attachment": "attachments", "metadata": "info_metadata", "xmp": "xmp"},
}
LABEL = "[REDACTED]"
_WORD = re.compile(r"\w+")
Spans = list[tuple[int, int]]


def part_surface(format_: Column, part: Column) -> Column:
    """The extracted part that holds a part of the ground truth; an unknown one fails the job."""
    known = F.create_map(*[F.lit(x) for f, parts in PARTS.items() for p, s in parts.items() for x in (f"{f}:{p}", s)])
    key = F.concat(format_, F.lit(":"), part)
    return F.coalesce(F.try_element_at(known, key), F.raise_error(F.concat(F.lit("no extracted part for "), F.coalesce(key, F.lit("null")))))


def format_of(name: Column) -> Column:
    """docx, or else pdf, by a file's ending."""
    return F.when(F.lower(name).endswith(".docx"), "docx").otherwise("pdf")


def places(text: str, needle: str) -> Spans:
    """Occurrences of needle in text, left to right, none overlapping."""
    out, at = [], text.find(needle) if needle else -1
    while at >= 0:
        out.append((at, at + len(needle)))
        at = text.find(needle, at + len(needle))
    return out


def outside(spans: Spans, decoys: Spans) -> Spans:
    """Without those that lie in a longer decoy."""
    return [s for s in spans if not any(d[0] <= s[0] and s[1] <= d[1] and d[1] - d[0] > s[1] - s[0] for d in decoys)]


def present(text: Column, surfaces: Column, decoys: Column) -> Column:
    """Those of surfaces that occur in text outside every strictly longer decoy."""

    def run(texts: pa.Array, wanted: pa.Array, spared: pa.Array) -> pa.Array:
        out = []
        for t, ws, ds in zip(texts.to_pylist(), wanted.to_pylist(), spared.to_pylist()):
            around = [x for d in ds or () for x in places(t or "", d)]
            out.append([w for w in ws or () if outside(places(t or "", w), around)])
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>").asNondeterministic()(text, surfaces, decoys)


def substituted(text: Column, targets: Column, decoys: Column, label: str = LABEL) -> Column:
    """text with label for each stretch of targets that touch or overlap; those within a longer decoy stay."""

    def run(texts: pa.Array, wanted: pa.Array, spared: pa.Array) -> pa.Array:
        out = []
        for t, ws, ds in zip(texts.to_pylist(), wanted.to_pylist(), spared.to_pylist()):
            around = [x for d in ds or () for x in places(t or "", d)]
            at, new = 0, []
            for s, e in sorted(outside([x for w in ws or () for x in places(t or "", w)], around)):
                if new and s <= at:
                    at = max(at, e)
                else:
                    new += [t[at:s], label]
                    at = e
            out.append(t if t is None else "".join([*new, t[at:]]))
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(text, targets, decoys)


def other_words(text: Column, surfaces: Column) -> Column:
    """Words of text that no occurrence of a surface overlaps."""

    def run(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        out = []
        for t, ws in zip(texts.to_pylist(), wanted.to_pylist()):
            covered = bytearray(len(t or ""))
            for w in ws or ():
                for s, e in places(t or "", w):
                    covered[s:e] = b"\1" * (e - s)
            out.append([m[0] for m in _WORD.finditer(t or "") if 1 not in covered[m.start() : m.end()]])
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>").asNondeterministic()(text, surfaces)


def classes(truth: DataFrame) -> DataFrame:
    """doc_id, type, surface, class: once each; sure wins over doubtful, and that over decoy, within a type."""
    rank = F.when(F.col("auto_redact"), 0).when(F.col("should_flag"), 1).otherwise(2)
    return truth.groupBy("doc_id", "type", "surface").agg(F.min(rank).alias("r")).select("doc_id", "type", "surface", F.element_at(F.array(F.lit("auto"), F.lit("flag"), F.lit("decoy")), F.col("r") + 1).alias("class"))


def _decoys() -> Column:
    return F.collect_set(F.when(~F.col("auto_redact") & ~F.col("should_flag"), F.col("surface"))).alias("decoys")


def leaks(truth: DataFrame, redacted: DataFrame) -> DataFrame:
    """doc_id, surface, type, found_in, gt_parts, kind of every sure surface that is still there."""
    sure = F.when(F.col("auto_redact"), F.struct("surface", "type"))
    t = truth.groupBy("doc_id").agg(F.collect_set(sure).alias("wanted"), _decoys())
    hit = t.join(redacted.select("doc_id", "part", "text"), "doc_id")
    hit = hit.withColumn("there", present(F.col("text"), F.transform("wanted", lambda x: x.surface), F.col("decoys")))
    hit = hit.select("doc_id", "part", F.explode(F.filter("wanted", lambda x: F.array_contains("there", x.surface))).alias("w"))
    out = hit.groupBy("doc_id", "w.surface", "w.type").agg(F.array_sort(F.collect_set("part")).alias("found"))
    parts = truth.filter("auto_redact").groupBy("doc_id", "surface", "type").agg(F.array_join(F.array_sort(F.collect_set("part")), ",").alias("gt_parts"))
    kind = F.when(F.array_contains("found", "text_layer"), "text_layer").when(F.size(F.array_except("found", F.array(*map(F.lit, SCRUB)))) == 0, "scrub").otherwise("other")
    return out.join(parts, ["doc_id", "surface", "type"]).select("doc_id", "surface", "type", F.array_join("found", ",").alias("found_in"), "gt_parts", kind.alias("kind"))


def leak_verdict(leaked: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, leaks by kind without those of places and firms, verdict and exit_code (0 pass, 1 fail, 2 no files)."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    x = leaked.filter(~F.col("type").isin(*CLASS_A)).agg(n("text_layer"), n("scrub"), n("other"), F.count("*").alias("leaks"))
    x = x.crossJoin(files.agg(F.count("*").alias("files")))  # one row each
    code = F.when(F.col("files") == 0, 2).when(F.col("leaks") > 0, 1).otherwise(0)
    return x.select("files", "text_layer", "scrub", "other", F.when(code == 0, "PASS").otherwise("FAIL").alias("verdict"), code.alias("exit_code"))


def rates(truth: DataFrame, redacted: DataFrame, review: DataFrame | None = None) -> DataFrame:
    """type, and per class the number, the number removed or kept, and the ratio (null if there is none). review: doc_id, surface of what went to review."""
    texts = redacted.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    c = classes(truth).groupBy("doc_id").agg(F.collect_list(F.struct("type", "surface", "class")).alias("rows"), F.collect_set("surface").alias("every"))
    c = c.join(truth.groupBy("doc_id").agg(_decoys()), "doc_id").join(texts, "doc_id")
    c = c.withColumn("there", present(F.col("text"), F.col("every"), F.col("decoys"))).select("doc_id", "there", F.explode("rows").alias("x"))
    c = c.select("doc_id", "x.type", "x.surface", "x.class", F.array_contains("there", F.col("x.surface")).alias("there"))
    if review is None:
        c = c.withColumn("seen", F.lit(False))
    else:
        c = c.join(review.select("doc_id", "surface", F.lit(True).alias("seen")).distinct(), ["doc_id", "surface"], "left")
    n = lambda k, ok: F.count_if((F.col("class") == k) & ok)
    g = c.groupBy("type").agg(n("auto", F.lit(True)).alias("auto_total"), n("auto", ~F.col("there")).alias("auto_removed"), n("decoy", F.lit(True)).alias("decoy_total"), n("decoy", F.col("there")).alias("decoy_kept"), n("flag", F.lit(True)).alias("flag_total"), n("flag", F.col("there")).alias("flag_kept"), n("flag", F.coalesce("seen", F.lit(False))).alias("flag_in_review"))
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return g.withColumns({"recall": ratio("auto_removed", "auto_total"), "decoy_survival": ratio("decoy_kept", "decoy_total"), "flag_survival": ratio("flag_kept", "flag_total")})


def paired(originals: DataFrame, graded: DataFrame) -> DataFrame:
    """doc_id of both; a document of one alone fails the job."""
    j = originals.select("doc_id", F.lit(1).alias("a")).distinct().join(graded.select("doc_id", F.lit(1).alias("b")).distinct(), "doc_id", "full")
    missing = F.raise_error(F.concat(F.lit("originals and graded files differ: "), F.col("doc_id").cast("string")))
    return j.select(F.when(F.col("a").isNull() | F.col("b").isNull(), missing.cast(dict(j.dtypes)["doc_id"])).otherwise(F.col("doc_id")).alias("doc_id"))


def retention(truth: DataFrame, original: DataFrame, redacted: DataFrame) -> DataFrame:
    """doc_id, kept, total: words of the original that no personal data overlaps, against the multiset of words of the output. Decoys are content."""
    meta = ~F.col("part").isin(*METADATA)
    real = truth.filter("auto_redact or should_flag").groupBy("doc_id").agg(F.collect_set("surface").alias("real"))
    words = lambda d, real: d.select("doc_id", F.explode(other_words(F.col("text"), real)).alias("w"))
    none = F.array().cast("array<string>")
    a = words(original.filter(meta).join(real, "doc_id", "left"), F.coalesce("real", none)).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    b = words(redacted.filter(meta), none).groupBy("doc_id", "w").agg(F.count("*").alias("m"))
    return a.join(b, ["doc_id", "w"], "left").groupBy("doc_id").agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("kept"), F.sum("n").alias("total"))


def resolved_output(truth_files: DataFrame, outputs: DataFrame) -> DataFrame:
    """doc_id, must_refuse, output: the file of outputs (path) that belongs to each: its own name, or else that with _anon before the ending; null if there is neither."""
    alias = F.regexp_replace(F.col("doc_id").cast("string"), r"^(.*?)(\.[^./]*)?$", "$1_anon$2")
    one = outputs.select(F.col("path").alias("p1")).distinct()
    two = outputs.select(F.col("path").alias("p2")).distinct()
    j = truth_files.withColumn("_alias", alias).join(one.hint("merge"), F.col("doc_id") == F.col("p1"), "left").join(two.hint("merge"), F.col("_alias") == F.col("p2").cast("string"), "left")
    return j.select("doc_id", "must_refuse", F.coalesce("p1", "p2").alias("output"))


def classified(truth_files: DataFrame, outputs: DataFrame) -> DataFrame:
    """doc_id, must_refuse, output, status (refused, unexpected, missing, broken, graded). outputs: path, error (null if it opened)."""
    # A row a file on both sides, whatever the planner takes for their size: none is sent to every task.
    j = resolved_output(truth_files, outputs).join(outputs.select(F.col("path").alias("output"), "error").dropDuplicates(["output"]).hint("merge"), "output", "left")
    there = F.col("output").isNotNull()
    status = F.when(F.col("must_refuse"), F.when(there, "unexpected").otherwise("refused")).when(~there, "missing").when(F.col("error").isNotNull(), "broken").otherwise("graded")
    return j.select("doc_id", "must_refuse", "output", status.alias("status"))


GATES = ("leak_ok", "integrity_ok", "unexpected_ok", "coverage_ok", "retention_ok", "decoy_ok", "flag_ok")


def gates(leaked: DataFrame, by_type: DataFrame, kept: DataFrame, files: DataFrame) -> DataFrame:
    """One row of seven verdicts. files: status of each, see classified()."""
    n = lambda s: (F.count_if(F.col("status") == s) == 0)
    f = files.agg(n("broken").alias("integrity_ok"), n("unexpected").alias("unexpected_ok"), n("missing").alias("coverage_ok"))
    t = by_type.agg(F.bool_and(F.coalesce(F.col("decoy_survival") >= DECOYS, F.lit(True))).alias("decoy_ok"), F.bool_and(F.coalesce(F.col("flag_survival") >= FLAGS, F.lit(True))).alias("flag_ok"))
    r = kept.agg(F.coalesce(F.try_divide(F.sum("kept"), F.sum("total")) >= RETENTION, F.lit(True)).alias("retention_ok"))
    lk = leaked.agg((F.count("*") == 0).alias("leak_ok"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(True)).alias(c)
    return lk.crossJoin(f).crossJoin(t).crossJoin(r).select(*map(yes, GATES))  # one-row aggregates


def run_eval(truth: DataFrame, truth_files: DataFrame, original: DataFrame, redacted: DataFrame, outputs: DataFrame) -> DataFrame:
    """The seven verdicts of a redactor's outputs, and whether all hold: only files that are graded count for what their texts hold."""
    files = classified(truth_files, outputs)
    graded = files.filter("status = 'graded'").select("doc_id")
    of = lambda d: d.join(graded, "doc_id", "left_semi")
    t, o, r = of(truth), of(original), of(redacted)
    x = gates(leaks(t, r), rates(t, r), retention(t, o, r), files)
    ok = F.lit(True)
    for g in GATES:
        ok = ok & F.col(g)
    return x.withColumn("passed", ok)


BASELINES = ("null", "scorch", "empty_output", "refuse_all", "greedy", "corrupt_output", "overeager_refusal")


def greedy(original: DataFrame, truth: DataFrame) -> DataFrame:
    """original without what is sure, and what is doubtful of some types."""
    wanted = F.col("auto_redact") | (F.col("should_flag") & F.col("type").isin(*GREEDY_FLAGS))
    target = truth.groupBy("doc_id").agg(F.collect_set(F.when(wanted, F.col("surface"))).alias("t"), _decoys())
    d = original.join(target, "doc_id", "left")
    return d.withColumn("text", substituted(F.col("text"), F.col("t"), F.col("decoys"))).drop("t", "decoys")


def baseline(name: str, original: DataFrame, truth: DataFrame, truth_files: DataFrame, greedy: Callable[[DataFrame, DataFrame], DataFrame] = greedy) -> tuple[DataFrame, DataFrame]:
    """surfaces and outputs of a known-bad redactor.

    null changes nothing; scorch and empty_output leave nothing; refuse_all writes no file; greedy takes doubtful ones,
    too; corrupt_output writes files that don't open; overeager_refusal is greedy and writes what it must refuse.
    """
    if name not in BASELINES:
        raise ValueError(f"no baseline {name}")
    due = truth_files if name == "overeager_refusal" else truth_files.filter("not must_refuse")
    error = F.lit("not a file of its format" if name == "corrupt_output" else None).cast("string")
    outputs = due.select(F.col("doc_id").alias("path"), error.alias("error"))
    if name in ("null", "corrupt_output", "refuse_all"):
        return original, outputs.filter(F.lit(name != "refuse_all"))
    if name in ("scorch", "empty_output"):
        return original.withColumn("text", F.lit("")), outputs
    return greedy(original, truth), outputs


def merged(spans: DataFrame) -> DataFrame:
    """doc_id, start, end: touching and overlapping spans as one."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # By rows: by default those of one order are added up together, which makes one of empty spans that don't touch.
    island = F.sum(F.when(F.col("start") <= F.col("_r"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("_r", reach).withColumn("_k", island).groupBy("doc_id", "_k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_k")


def covers_more(outer: Column, inner: Column) -> Column:
    """Whether a rectangle (x0, y0, x1, y1) holds another and is larger."""
    area = lambda r: (r.x1 - r.x0) * (r.y1 - r.y0)
    return (outer.x0 <= inner.x0) & (outer.y0 <= inner.y0) & (outer.x1 >= inner.x1) & (outer.y1 >= inner.y1) & (area(outer) > area(inner))


def manifest(files: DataFrame) -> DataFrame:
    """path, sha256 of files given as path, content."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def manifest_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, status: MISSING, CHANGED or UNEXPECTED. Both: path, sha256."""
    j = expected.select("path", F.col("sha256").alias("e")).join(actual.select("path", F.col("sha256").alias("a")), "path", "full")
    s = F.when(F.col("a").isNull(), "MISSING").when(F.col("e").isNull(), "UNEXPECTED").when(F.col("a") != F.col("e"), "CHANGED")
    return j.select("path", s.alias("status")).filter("status is not null")


def collisions(truth: DataFrame) -> DataFrame:
    """Surfaces that are a decoy and real in one document."""
    c = truth.groupBy("doc_id", "surface").agg(F.bool_or(F.col("auto_redact") | F.col("should_flag")).alias("real"), F.bool_or(~F.col("auto_redact") & ~F.col("should_flag")).alias("decoy"))
    return c.filter("real and decoy").select("doc_id", "surface")


def checked(truth: DataFrame) -> DataFrame:
    """truth, unless a surface of it is a decoy and real in one document: then the job fails."""
    bad = F.bool_or(F.col("auto_redact") | F.col("should_flag")) & F.bool_or(~F.col("auto_redact") & ~F.col("should_flag"))
    c = truth.groupBy("doc_id", "surface").agg(bad.alias("_bad"))
    j = truth.join(c, ["doc_id", "surface"])
    return j.filter(F.when(F.col("_bad"), F.raise_error(F.concat(F.lit("decoy and real: "), F.col("surface"))).cast("boolean")).otherwise(True)).select(*truth.columns)
