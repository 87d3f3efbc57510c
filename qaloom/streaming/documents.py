"""document.uploaded stream to points and knowledge.indexed events, with the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from qaloom.functions.text import basename
from qaloom.operators.chunking import chunk_documents, pack_paragraphs
from qaloom.operators.events import dedup_stream, indexed_events
from qaloom.operators.quality import extract_text
from qaloom.operators.vectors import make_points
from qaloom.sources.writers import merge_points
from qaloom.streaming.sinks import start, start_many


def uploads_with_content(uploads: DataFrame, blobs: DataFrame, delay: str = "10 minutes", dedup: bool = True) -> DataFrame:
    """Upload events joined with their blob by key; repeated deliveries of an upload are dropped. The time of the upload is the
    document's version.

    uploads: parsed document.uploaded events. blobs: key, content; a stream of new files (then also with `modified`) or
    a table. With two streams both sides are bounded by the watermark. An upload without a blob comes out with null content (from
    two streams once the watermark has passed it), which `start_indexing` writes to its rejects.
    """
    events = uploads.withColumn("uploaded_at", F.to_timestamp("timestamp"))
    events = dedup_stream(events, ["documentId", "timestamp"], "uploaded_at", delay) if dedup else events
    same = F.col("s3Path") == F.col("key")
    if blobs.isStreaming:
        blobs = blobs.withWatermark("modified", delay)
        gap = F.expr(f"INTERVAL {delay}")
        same = same & F.col("modified").between(F.col("uploaded_at") - gap, F.col("uploaded_at") + gap)
    return events.join(blobs, same, "left").select(
        F.col("documentId").alias("document_id"), F.col("tenantId").alias("tenant_id"),
        F.col("projectId").alias("project_id"), F.col("correlationId").alias("correlation_id"),
        basename(F.col("s3Path")).alias("name"), "content", F.unix_micros("uploaded_at").alias("version"),
    )


def start_indexing(
    documents: DataFrame, embedder, root: str, checkpoint: str, max_words: int = 200, sep: str = "\n\n", once: bool = False
) -> StreamingQuery:
    """Merge the points of every batch into root/points, and write its indexed events and rejected files.

    A document that is uploaded again replaces its points, one that comes late does not; see `writers.merge_points`.
    """

    def good(batch: DataFrame) -> DataFrame:
        return extract_text(batch)[0]

    def merge(batch: DataFrame, batch_id: int) -> None:
        keep = ["tenant_id", "project_id", "version"]
        chunks = chunk_documents(good(batch), "document_id", "text", max_words, sep, keep)
        merge_points(batch.sparkSession, make_points(chunks, embedder, version_col="version"), f"{root}/points", batch_id)

    def indexed(batch: DataFrame) -> DataFrame:
        count: Column = F.size(pack_paragraphs(F.col("text"), max_words, sep))
        return indexed_events(good(batch).withColumn("chunks", count))

    # rejects: files of other types and uploads without a blob, with reasons
    outputs = {"knowledge_indexed": indexed, "rejects": lambda b: extract_text(b)[1]}
    return start_many(documents, outputs, root, checkpoint, once=once, merges=[merge])


def start_rejected_lines(bad: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write the bad half of `parse_events`, the line and its reason, so that no message vanishes."""
    return start(bad.select("value", "reason"), path, checkpoint, once=once)
