"""Event logs: parsing with a reject side, duplicates, lineage, counts per window. All work on batch and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from qaloom.operators.reports import to_event
from qaloom.operators.skew import first_n


def parse_events(lines: DataFrame, schema: StructType, required=(), value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, bad). A line that is no JSON object or lacks a required field goes to bad with a reason; one bad line
    never fails a batch."""
    corrupt = "_corrupt"
    full = StructType(list(schema.fields)).add(corrupt, "string")
    event = F.from_json(F.col(value).cast("string"), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    parsed = lines.select("*", F.explode(F.array(event)).alias("_e"))  # bound here, so that filter and output share one parse
    absent = F.filter(
        F.array(*[F.when(F.col(f"_e.{f}").isNull(), f) for f in required]) if required else F.array().cast("array<string>"),
        lambda x: x.isNotNull(),
    )
    reason = F.when(F.col("_e").isNull() | F.col(f"_e.{corrupt}").isNotNull(), "malformed").when(
        F.size(absent) > 0, F.concat(F.lit("missing "), F.array_join(absent, ","))
    )
    marked = parsed.withColumn("reason", reason)
    good = marked.filter("reason is null").select("_e.*").drop(corrupt)
    return good, marked.filter("reason is not null").drop("_e")


def dedup_events(events: DataFrame, key: list[str], order: list) -> DataFrame:
    """Batch form: the first delivery per key, cut per input partition before the shuffle."""
    return first_n(events, key, order)


def dedup_stream(events: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """Stream form: later deliveries within `delay` are dropped; state older than that is released."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def event_windows(events: DataFrame, ts: str, size: str, by: list[str], watermark: str | None = None) -> DataFrame:
    """Counts per time window and group. A watermark needs a time with zone; without one the column stays as it is."""
    src = events
    if watermark:
        src = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return src.groupBy(F.window(ts, size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), *by, "n"
    )


def unanswered(causes: DataFrame, effects: DataFrame, key: str, ts: str, now: Column, within: Column) -> DataFrame:
    """Batch form: causes older than `within` without an effect of the same key. `streaming.lineage` has the stream form."""
    late = causes.filter(F.col(ts) + within < now)
    return late.join(effects.select(key).distinct(), key, "left_anti")


def document_status(uploads: DataFrame, indexed: DataFrame) -> DataFrame:
    """Status from the indexed events, since the stored one never changes."""
    done = indexed.groupBy("document_id").agg(F.max("chunk_count").alias("chunk_count"))
    return uploads.join(done, "document_id", "left").withColumn(
        "status", F.when(F.col("chunk_count").isNotNull(), "indexed").otherwise("uploaded")
    )


def indexed_events(counts: DataFrame) -> DataFrame:
    """knowledge.indexed events from document_id, tenant_id, project_id, chunks, correlation_id."""
    text = lambda c: F.col(c).cast("string")
    value = to_event(
        ("eventType", F.lit("knowledge.indexed")), ("tenantId", text("tenant_id")), ("projectId", text("project_id")),
        ("documentId", text("document_id")), ("chunkCount", F.col("chunks")), ("correlationId", text("correlation_id")),
    )
    return counts.select("document_id", value.alias("value"))
