"""Files and pages: what is taken in, what has text, where results go, and what may be handed out.

Pages stand for files of which only the text layer can be read: doc_id, page_no, text, and parts of their own for what
lies beside the text. Writing such a file means its page texts; all else about it is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkveil.functions.text import soft_hyphens
from inkveil.operators import redact as R

ENDINGS = (".docx", ".pdf")
IMAGE_ONLY = "image_only"


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def intake(files: DataFrame) -> DataFrame:
    """seq, path of files of the endings that are read, each once, where it came first."""
    return files.filter(ending(F.col("path")).isin(*ENDINGS)).groupBy("path").agg(F.min("seq").alias("seq")).select("seq", "path")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the files of a folder that a verdict is about: of known endings, not named as images."""
    d = spark.read.format("binaryFile").load(folder).select("path", "content")
    return d.filter(ending(F.col("path")).isin(*ENDINGS) & ~F.contains(F.regexp_extract("path", r"([^/]*)$", 1), F.lit(IMAGE_ONLY)))


def text_layers(pages: DataFrame) -> DataFrame:
    """doc_id, text_layer: whether any page has more than white space."""
    return pages.groupBy("doc_id").agg(F.coalesce(F.bool_or(F.regexp_replace("text", r"(?U)\s", "") != ""), F.lit(False)).alias("text_layer"))


def page_units(pages: DataFrame, *others: str) -> DataFrame:
    """doc_id, unit_seq, location, text, and other columns: pages as units, soft hyphens as hyphens."""
    return pages.select("doc_id", F.col("page_no").cast("int").alias("unit_seq"), F.lit("page").alias("location"), soft_hyphens(F.col("text")).alias("text"), *others)


def placed(decided: DataFrame, pages: DataFrame) -> DataFrame:
    """decided, with located: whether the page holds the surface, as it is or with soft hyphens for its hyphens. Others must not count as redacted."""
    p = pages.select("doc_id", F.col("page_no").cast("int").alias("unit_seq"), F.col("text").alias("_text"))
    there = F.contains("_text", "surface") | F.contains("_text", F.translate("surface", "-", "\u00ad"))
    return decided.join(p, ["doc_id", "unit_seq"], "left").withColumn("located", F.coalesce(there, F.lit(False))).drop("_text")


def redacted_pages(pages: DataFrame, known: str | None = None, decisions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """doc_id, page_no, text of documents with a text layer; and doc_id, status (written, refused, incomplete), skipped (surfaces that weren't located)."""
    units = page_units(pages, *([known] if known else []))
    found = placed(R.decide(R.spans(units, known), decisions), pages)
    skipped = found.filter("redact and not located").groupBy("doc_id").agg(F.array_sort(F.collect_set("surface")).alias("skipped"))
    text = R.redact(units, R.label(found.withColumn("redact", F.col("redact") & F.col("located"))))
    layers = text_layers(pages)
    out = text.join(layers.filter("text_layer"), "doc_id", "left_semi").select("doc_id", F.col("unit_seq").alias("page_no"), "text")
    status = F.when(~F.col("text_layer"), "refused").when(F.col("skipped").isNotNull(), "incomplete").otherwise("written")
    return out, layers.join(skipped, "doc_id", "left").select("doc_id", status.alias("status"), F.coalesce("skipped", F.array().cast("array<string>")).alias("skipped"))


def out_path(path: Column) -> Column:
    """Beside the file: its name with _anon before the ending."""
    return F.regexp_replace(path, r"^(.*?)(\.[^./]*)?$", "$1_anon$2")


def exported(status: DataFrame) -> DataFrame:
    """path, out, report of files that were written whole; a file in part is never handed out. status: path, status."""
    out = out_path(F.col("path"))
    return status.filter("status = 'written'").select("path", out.alias("out"), R.report_path(out).alias("report"))
