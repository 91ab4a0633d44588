"""Operators on streams of drawings: each micro-batch holds whole drawings, so batch operators apply as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def per_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Apply ``operator`` to every micro-batch of nested drawings and write it below ``folder`` by batch number.

    A batch that is run again after a failure overwrites its own folder, so each drawing is written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
