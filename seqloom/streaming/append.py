"""Appending sealed blocks from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators import packed


def append_blocks(stream: DataFrame, path: str, checkpoint: str, variant: str = "bstar", size: int = 4096) -> StreamingQuery:
    """Writes the blocks of a stream of (pos, value) that brings whole blocks in each trigger.

    Each trigger replaces the folder of its epoch, so a trigger that runs again after a failure leaves its blocks once.
    """

    def seal(batch: DataFrame, epoch: int) -> None:
        packed.encode(batch, variant, size).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(seal).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
