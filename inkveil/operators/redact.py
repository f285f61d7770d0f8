"""Decisions, labels, rewriting, reports. Where a document's rows have to meet, they are dealt by doc_id once; what follows is windowed and summed within that."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from inkveil.functions.text import snippet
from inkveil.operators.detect import detect

# The notice, sections and columns of a report.
NOTICE = "This report records what the tool CHANGED and what it was UNSURE about.\nIt does NOT certify that the document is clean. A human must review the\nredacted document before it is shared or filed.\n"
REDACTED, LOW_CONFIDENCE = "[REDACTED]\nTYPE | label | count | locations", "[LOW CONFIDENCE / NOT REDACTED]\ntype | surface | location"
TITLE = "=== REDACTION REPORT ==="


def spans(units: DataFrame, known: str | None = None, extra_terms: list[str] | None = None, only: Iterable[str] | None = None) -> DataFrame:
    """One row a candidate: doc_id, unit_seq, location, type, surface, start, end, auto, group_key, snippet.

    A name's group is the first known entity with its stem; any other group is the surface without white space. only: the types wanted.
    """
    # Outer, then filtered: else the optimizer puts a filter on the whole detection below the explode.
    d = detect(units, known, extra_terms, only).select("doc_id", "unit_seq", "location", "text", F.explode_outer("cands").alias("c")).filter(F.col("c").isNotNull())
    return d.select("doc_id", "unit_seq", "location", "c.type", "c.surface", "c.start", "c.end", "c.auto", "c.group_key", snippet(F.col("text"), F.col("c.start"), F.col("c.end")).alias("snippet"))


def decide(found: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """found with redact: sure candidates but for suppressed groups, and forced groups of doubtful ones."""
    if decisions is None:
        return found.withColumn("redact", F.col("auto"))
    d = decisions.groupBy("doc_id", "type", "group_key").agg(F.bool_or(F.col("action") == "suppress").alias("_s"), F.bool_or(F.col("action") == "force").alias("_f"))
    x = found.join(d, ["doc_id", "type", "group_key"], "left")
    return x.withColumn("redact", F.when(F.col("auto"), ~F.coalesce("_s", F.lit(False))).otherwise(F.coalesce("_f", F.lit(False)))).drop("_s", "_f")


def build_decisions(review: DataFrame) -> DataFrame:
    """doc_id, type, group_key, action of ticked review rows: an unticked sure group is suppressed, a ticked doubtful one forced. ticked null: as it was, sure groups ticked and doubtful ones not."""
    action = F.when((F.col("bucket") == "auto") & ~F.col("ticked"), "suppress").when((F.col("bucket") == "review") & F.col("ticked"), "force")
    return review.select("doc_id", "type", "group_key", action.alias("action")).filter("action is not null").distinct()


def carried(review: DataFrame, before: DataFrame) -> DataFrame:
    """review rows with ticked: as it was before for groups that are still there, else ticked if sure."""
    was = before.select("doc_id", "type", "group_key", F.col("ticked").alias("_was")).dropDuplicates(["doc_id", "type", "group_key"])
    return review.join(was, ["doc_id", "type", "group_key"], "left").withColumn("ticked", F.coalesce("_was", F.col("bucket") == "auto")).drop("_was")


def label(decided: DataFrame) -> DataFrame:
    """The redacted candidates with label: numbers by type in the order of a group's first sighting.

    Of those that start at one place the shortest is the one sighted; the others take its label.
    """
    kept = decided.filter("redact").repartition("doc_id")
    here = Window.partitionBy("doc_id", "unit_seq", "start").orderBy("end", "type", "group_key")
    lead = F.first(F.struct("type", "group_key")).over(here)
    kept = kept.withColumn("_lead", lead)
    group = [F.col("doc_id"), F.col("_lead.type"), F.col("_lead.group_key")]
    kept = kept.withColumn("_first", F.min(F.struct("unit_seq", "start", "end")).over(Window.partitionBy(*group)))
    n = F.dense_rank().over(Window.partitionBy("doc_id", "_lead.type").orderBy("_first", "_lead.group_key"))
    kept = kept.withColumn("label", F.concat(F.lit("["), F.col("_lead.type"), F.lit("_"), n.cast("string"), F.lit("]")))
    return kept.drop("_lead", "_first")


def rewritten(text: Column, marks: Column) -> Column:
    """text with each covered stretch replaced by the labels that start in it; marks: ordered (start, end, label)."""
    zero = F.struct(F.lit(0).alias("pos"), F.lit(-1).alias("last"), F.lit("").alias("out"))

    def step(a, m):
        gap = F.substring(text, a.pos + 1, F.greatest(m.start - a.pos, F.lit(0)))
        return F.struct(F.greatest(a.pos, m.end).alias("pos"), m.start.alias("last"), F.concat(a.out, gap, F.when(m.start == a.last, F.lit("")).otherwise(m.label)).alias("out"))

    return F.aggregate(marks, zero, step, lambda a: F.concat(a.out, F.substring(text, a.pos + 1, F.length(text))))


_NO_MARKS = "array<struct<start:int,end:int,label:string>>"


def redact(units: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, unit_seq, location, text with labels in place of what they stand for."""
    marks = labelled.groupBy("doc_id", "unit_seq").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("marks"))
    d = units.select("doc_id", "unit_seq", "location", "text").join(marks, ["doc_id", "unit_seq"], "left")
    return d.select("doc_id", "unit_seq", "location", rewritten(F.col("text"), F.coalesce("marks", F.array().cast(_NO_MARKS))).alias("text"))


def redacted(units: DataFrame, known: str | None = None, extra_terms: list[str] | None = None) -> DataFrame:
    """redact() of units by their own sure candidates, with one exchange, by doc_id: a unit's text travels on one of its rows.

    Units of one document must differ in unit_seq, as labels are counted by it.
    """
    d = detect(units, known, extra_terms).select("doc_id", "unit_seq", "location", "text", F.posexplode_outer("cands").alias("_p", "c"))
    carries = F.coalesce("_p", F.lit(0)) == 0
    rows = d.select("doc_id", "unit_seq", "location", F.when(carries, F.col("text")).alias("text"), "c.type", "c.group_key", "c.start", "c.end", F.coalesce("c.auto", F.lit(False)).alias("sure"))
    rows = rows.repartition("doc_id").withColumn("_g", F.when(F.col("sure"), F.struct("type", "group_key")))
    here = Window.partitionBy("doc_id", "unit_seq", "sure", "start").orderBy("end", "type", "group_key")
    rows = rows.withColumn("_g", F.first("_g").over(here))
    rows = rows.withColumn("_first", F.min(F.struct("unit_seq", "start", "end")).over(Window.partitionBy("doc_id", "sure", "_g")))
    n = F.dense_rank().over(Window.partitionBy("doc_id", "sure", "_g.type").orderBy("_first", "_g.group_key"))
    rows = rows.withColumn("_mark", F.when(F.col("sure"), F.struct("start", "end", F.concat(F.lit("["), F.col("_g.type"), F.lit("_"), n.cast("string"), F.lit("]")).alias("label"))))
    units_ = rows.groupBy("doc_id", "unit_seq", "location").agg(F.max("text").alias("text"), F.array_sort(F.collect_list("_mark")).alias("marks"))
    return units_.select("doc_id", "unit_seq", "location", rewritten(F.col("text"), F.col("marks")).alias("text"))


def report_rows(labelled: DataFrame) -> DataFrame:
    """doc_id, label, type, n, occurrences, locations."""
    named = labelled.withColumn("type", F.regexp_extract("label", r"^\[(.*)_(\d+)\]$", 1)).withColumn("n", F.regexp_extract("label", r"^\[(.*)_(\d+)\]$", 2).cast("int"))
    return named.groupBy("doc_id", "label", "type", "n").agg(F.count("*").alias("occurrences"), F.array_join(F.array_sort(F.collect_set("location")), ", ").alias("locations"))


def occurrence_lists(labelled: DataFrame) -> DataFrame:
    """doc_id, label, places (unit_seq, start, location, surface: every one, in reading order), context (the first snippet that isn't empty)."""
    at = F.struct("unit_seq", "start", "end", "location", "surface")
    return labelled.groupBy("doc_id", "label").agg(F.array_sort(F.collect_list(at)).alias("places"), F.min_by("snippet", F.when(F.col("snippet") != "", F.struct("unit_seq", "start", "end"))).alias("context"))


def groups(labelled: DataFrame) -> DataFrame:
    """doc_id, label, type, group_key: what each label stands for."""
    at = F.struct("unit_seq", "start", "end")
    return labelled.groupBy("doc_id", "label").agg(F.min_by(F.struct("type", "group_key"), at).alias("g")).select("doc_id", "label", "g.type", "g.group_key")


def low_confidence(decided: DataFrame) -> DataFrame:
    return decided.filter("not redact").select("doc_id", "unit_seq", "location", "type", "surface", "start", "snippet")


def review_rows(decided: DataFrame) -> DataFrame:
    """One row a group: first surface and snippet, locations, count, bucket (auto or review)."""
    at = F.struct("unit_seq", "start", "end")
    g = decided.groupBy("doc_id", "type", "group_key", F.when(F.col("redact"), "auto").otherwise("review").alias("bucket"))
    return g.agg(F.min_by("surface", at).alias("text"), F.min_by("snippet", at).alias("snippet"), F.array_join(F.array_sort(F.collect_set("location")), ",").alias("locations"), F.count("*").alias("count"))


def review_order(review: DataFrame) -> DataFrame:
    """review rows with place, from 1 in each document: sure groups first, then by type and text."""
    return review.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("bucket", "type", "text", "group_key")))


def report_text(labelled: DataFrame, decided: DataFrame, title: str = TITLE) -> DataFrame:
    """doc_id, report of each document with a candidate: redactions by type and number, then what was left, in reading order."""
    row = F.concat_ws(" | ", "type", "label", F.col("occurrences").cast("string"), "locations")
    top = report_rows(labelled).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("type", "n", row.alias("row")))).alias("a"))
    low = low_confidence(decided).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit_seq", "start", F.concat_ws(" | ", "type", "surface", "location").alias("row")))).alias("b"))
    a, b = F.transform(F.col("a"), lambda x: x.row), F.transform(F.col("b"), lambda x: x.row)
    rows = lambda c, none: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.lit("\n"), F.array_join(c, "\n"))).otherwise(none)
    head = f"{title}\n\n{NOTICE}\n{REDACTED}"
    report = F.concat(F.lit(head), rows(a, ""), F.lit(f"\n\n{LOW_CONFIDENCE}"), rows(b, "\n(none)"), F.lit("\n"))
    return top.join(low, "doc_id", "full").select("doc_id", report.alias("report"))


def report_path(out_path: Column) -> Column:
    """The report's path beside a document's: its name without the ending, and _report.txt."""
    return F.concat(F.regexp_replace(out_path, r"(?<=[^/.])\.[^./]*$", ""), F.lit("_report.txt"))
