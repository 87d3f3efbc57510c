"""Cause and effect across event streams by correlation id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def follow(
    causes: DataFrame, effects: DataFrame, within: str, delay: str, key: str = "correlation_id", ts: str = "ts"
) -> DataFrame:
    """Every cause with the effect that came within the time bound, or with nulls once the watermark rules it out.

    Used for uploads and their indexed events, and for run requests and their reports. State on both sides is bounded
    by the watermark and the interval. Effect columns get the prefix effect_.
    """
    e = effects.select(*[F.col(c).alias(f"effect_{c}") for c in effects.columns])
    c = causes.withWatermark(ts, delay)
    e = e.withWatermark(f"effect_{ts}", delay)
    bound = (F.col(f"effect_{ts}") >= F.col(ts)) & (F.col(f"effect_{ts}") <= F.col(ts) + F.expr(f"INTERVAL {within}"))
    return c.join(e, (F.col(key) == F.col(f"effect_{key}")) & bound, "leftOuter")


def unanswered(causes: DataFrame, effects: DataFrame, within: str, delay: str, key: str = "correlation_id", ts: str = "ts") -> DataFrame:
    """Causes whose effect did not come in time."""
    joined = follow(causes, effects, within, delay, key, ts)
    return joined.filter(F.col(f"effect_{key}").isNull()).select(*causes.columns)
