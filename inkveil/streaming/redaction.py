"""Redaction of a stream of text units: detection is stateless; labels are numbered within a micro-batch's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from inkveil.operators.detect import detect
from inkveil.operators.redact import redacted


def detect_stream(units: DataFrame, known: str | None = None) -> DataFrame:
    """Candidates of each unit, on a stream as on a table."""
    return detect(units, known)


def redact_stream(units: DataFrame, out: str, checkpoint: str, known: str | None = None) -> StreamingQuery:
    """Redacted units as Parquet, a folder a batch, written anew if the batch is. A document's units must come in one batch, as its labels are numbered there."""

    def each(batch: DataFrame, epoch: int) -> None:
        redacted(batch, known).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return units.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
