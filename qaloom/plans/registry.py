"""Registered queries: a callable (spark, sf_dir) -> DataFrame each, and the SQL that must give the same rows."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = sql
        return fn

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled(template: str, **exprs: str) -> str:
    """SQL concat of a `{name}` template; nulls read 'None'."""
    parts = []
    for text, field, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(quoted(text))
        if field is not None:
            parts.append(f"coalesce(CAST({exprs[field]} AS VARCHAR), 'None')")
    return "concat(" + ", ".join(parts) + ")"
