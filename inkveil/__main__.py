"""python -m inkveil generate N FOLDER | redact FOLDER OUT [NAME...] | verdict N: samples, redaction of a folder of .docx files, and the engine's verdict on samples.

generate and redact write tables (Parquet): files as path and content, beside them reports and statuses.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession, functions as F

from inkveil.operators import redact as R, summary
from inkveil.plans import catalog
from inkveil.sources import docx, generator


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("generate", "redact", "verdict") or (args[0] != "verdict" and len(args) < 3):
        print(__doc__)
        return 2
    spark = SparkSession.builder.getOrCreate()
    if args[0] == "generate":
        generator.generate(spark, int(args[1])).write.parquet(args[2])
        return 0
    if args[0] == "verdict":
        text, passed = summary.eval_report(*catalog.made(spark, int(args[1])))
        print(text, end="")
        return 0 if passed else 1
    folder, out, *names = args[1:]
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    read = docx.parsed(files).withColumn("known", F.array(*map(F.lit, names)).cast("array<string>"))
    decided = R.decide(R.spans(docx.units_of(read, "known"), "known"))
    labelled = R.label(decided)
    docx.write_docx(files, labelled).write.parquet(f"{out}/files")
    R.report_text(labelled, decided).write.parquet(f"{out}/reports")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
