"""Scoring of messages as they arrive.

Each micro-batch is scored by the batch functions, so a stream takes lexicons of any size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.enrich import Scorer, ingest_conversations


def batch_writer(scorer: Scorer, path: str) -> Callable[[DataFrame, int], None]:
    """Writes one micro-batch, scored, under its number; written again it takes its own place."""

    def write(batch: DataFrame, number: int) -> None:
        rows = ingest_conversations(batch, scorer, "category", "host_mode", "api")
        (
            rows.withColumn("batch", F.lit(number).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch", "host_mode")
            .parquet(path)
        )

    return write


def scored_stream(
    arriving: DataFrame, scorer: Scorer, path: str, checkpoint: str
) -> DataStreamWriter:
    """Writer that adds arriving messages, scored, to the message table.

    ``arriving`` carries id, conversation_id, speaker, message, timestamp, category,
    host_mode and api. The table is laid out by batch and host mode. A batch that is run
    again after a failure replaces what its first run wrote, so each message counts once.
    """
    return arriving.writeStream.foreachBatch(batch_writer(scorer, path)).option("checkpointLocation", checkpoint)
