"""Deterministic ids: the same row gets the same id on every run and every retry of a task."""

from pyspark.sql import Column, functions as F


def stable_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
