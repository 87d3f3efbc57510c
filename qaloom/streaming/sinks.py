"""Starting a stream: triggers, checkpoints, several sinks per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery


def start(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet", once: bool = False,
    every: str = "10 seconds", partition_by: list[str] | None = None, **options,
) -> StreamingQuery:
    """Write a stream to files, or to the topic `path` with fmt='kafka' (a `value` column). `checkpoint` plays the part
    of a consumer group: a restart goes on where it ended."""
    w = stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).options(**options)
    w = w.option("topic" if fmt == "kafka" else "path", path)
    if partition_by:
        w = w.partitionBy(*partition_by)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def start_many(
    stream: DataFrame, outputs: dict[str, Callable[[DataFrame], DataFrame]], root: str, checkpoint: str,
    mode: str = "append", once: bool = False, every: str = "10 seconds", merges: list[Callable[[DataFrame, int], None]] | None = None,
) -> StreamingQuery:
    """Derive several tables from every batch and write each to root/name/batch=N.

    A batch that is repeated after a failure overwrites its own folder, so each table holds every batch once. `merges` are called
    first with the batch and its number, for tables that a batch changes in place; they must bear being repeated.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            for merge in merges or []:
                merge(rows, batch_id)
            for name, derive in outputs.items():
                derive(rows).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        finally:
            rows.unpersist()

    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()
