"""A stream of operations into a table: each micro-batch is one version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidelog.table import Table


def batch_writer(table: Table, query: str, maintain_every: int = 0) -> Callable[[DataFrame, int], None]:
    """For foreachBatch. The manifest keeps each query's last batch, so a batch that comes again does nothing."""

    def write(batch: DataFrame, number: int) -> None:
        table.write(batch, stream=(query, number))
        if maintain_every and number % maintain_every == maintain_every - 1:
            table.maintain()

    return write


def start(ops: DataFrame, table: Table, query: str, checkpoint: str, maintain_every: int = 0, **trigger) -> StreamingQuery:
    """Write a stream (key, tombstone, payload[, ordinal]) to a table."""
    writer = ops.writeStream.foreachBatch(batch_writer(table, query, maintain_every)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
