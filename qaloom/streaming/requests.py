"""test.requested stream to script requests: retrieval over the point table, page structure, prompt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from qaloom.functions.text import collection_name
from qaloom.operators.prompts import CONTEXT_K, CONTEXT_TYPES, build_prompts
from qaloom.operators.vectors import context_block, embed, knn_topk
from qaloom.streaming.sinks import start_many


def first_prompts(
    requests: DataFrame, points: DataFrame, pages: DataFrame, embedder: Callable[[Column], Column], k: int = CONTEXT_K
) -> DataFrame:
    """Prompts of first attempts. requests: parsed test.requested events, one per run. points: id, collection, vector,
    type, text. pages: run_id, page_structure, page_title, viewport. Only collections that are asked about are searched."""
    runs = requests.select(
        F.col("runId").alias("run_id"), collection_name(F.col("tenantId"), F.col("projectId")).alias("collection"), "url", "prompt"
    )
    asked = embed(runs, embedder, "prompt").select(F.col("run_id").alias("query_id"), "collection", "vector")
    searched = points.withColumnRenamed("id", "point_id")
    hits = knn_topk(asked, searched, k, CONTEXT_TYPES)
    context = context_block(hits, asked, searched.select("point_id", "text"))
    rows = (
        runs.join(context.select(F.col("query_id").alias("run_id"), F.col("block").alias("context_block")), "run_id")
        .join(pages.select("run_id", "page_structure", "page_title", "viewport"), "run_id", "left")
        .withColumns({
            "attempt": F.lit(1), "is_retry": F.lit(False), "width": F.col("viewport.width"), "height": F.col("viewport.height"),
            "attempt_number": F.lit(None).cast("int"), "previous_error": F.lit(None).cast("string"),
            "previous_error_context": F.lit(None).cast("string"), "console_errors": F.lit(None).cast("string"),
        })
    )
    return build_prompts(rows)


def start_prompts(
    requests: DataFrame, points: Callable[[], DataFrame], pages: Callable[[], DataFrame], embedder, root: str, checkpoint: str,
    once: bool = False,
) -> StreamingQuery:
    """Write the prompts of every batch. The tables are opened anew per batch, so documents indexed meanwhile count."""
    return start_many(requests, {"prompts": lambda b: first_prompts(b, points(), pages(), embedder)}, root, checkpoint, once=once)
