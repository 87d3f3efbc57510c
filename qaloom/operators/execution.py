"""Execution logs: console and network messages, error classes, locator strategies, artifact keys."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from qaloom.functions import templates as t
from qaloom.functions.text import blank, key_path, render, strip
from qaloom.operators.skew import asof, first_n, join_within, joined_text, lookup_join, ordinal

ATTEMPT = ["run_id", "attempt"]


# --- messages to attempts ----------------------------------------------------------------------------------------


def of_attempts(messages: DataFrame, attempts: DataFrame, at: str = "ts", started: str = "started_at") -> DataFrame:
    """Messages with the attempt of their run that was under way: the last one started when the message came.

    messages: run_id, event_id (unique) and a time; attempts: run_id, attempt, started_at. Messages from before the first
    attempt, and of runs without attempts, have a null attempt and stay apart from the lists of attempts.
    """
    return asof(messages.drop("attempt"), attempts, ["run_id"], at, started, ["attempt"], ["event_id"])


# --- console -----------------------------------------------------------------------------------------------------
#
# messages: run_id, attempt, event_id (arrival number), msg_type, msg. `by` says what a list belongs to.


def bucket(msg_type: Column) -> Column:
    return F.when(msg_type == "error", "errors").when(msg_type == "warning", "warnings").otherwise("logs")


def console_buckets(messages: DataFrame, by: list[str] = ATTEMPT) -> DataFrame:
    """Message counts per attempt."""
    b = bucket(F.col("msg_type"))
    return messages.groupBy(*by).agg(*[F.count_if(b == n).alias(n) for n in ("errors", "warnings", "logs")])


def console_lines(messages: DataFrame, by: list[str] = ATTEMPT) -> DataFrame:
    """The ordered list of every bucket as rows: run_id, attempt, bucket, seq, msg. Lists are kept as rows because an attempt may
    hold any number of messages."""
    rows = messages.select(*by, bucket(F.col("msg_type")).alias("bucket"), "event_id", "msg")
    return ordinal(rows, [*by, "bucket"], "event_id").select(*by, "bucket", "seq", "msg")


def first_errors(messages: DataFrame, n: int = 3, by: list[str] = ATTEMPT) -> DataFrame:
    """The first n console errors of each attempt and the number left out. The rank filter cuts every input partition
    to n rows per attempt before the shuffle."""
    errors = messages.filter(F.col("msg_type") == "error")
    counts = errors.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.count(F.lit(1)).alias("errors"))
    first = (
        first_n(errors.select(*by, "event_id", "msg"), by, ["event_id"], n)
        .groupBy(*by)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "msg"))), lambda x: x["msg"]).alias("first"))
    )
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return first.join(counts, same).select(*by, "errors", "first", F.greatest(F.col("errors") - n, F.lit(0).cast("bigint")).alias("more"))


def console_text() -> Column:
    """The report's console text from errors, first, more: a heading, the first errors and an overflow line."""
    bullets = F.array_join(F.transform("first", lambda m: F.concat(F.lit("• "), m)), "\n")
    more = F.when(F.col("more") > 0, F.concat(F.lit("\n... and "), F.col("more").cast("string"), F.lit(" more")))
    return F.concat(
        F.lit("Console Errors ("), F.col("errors").cast("string"), F.lit("):\n"), bullets, F.coalesce(more, F.lit(""))
    )


def console_top(messages: DataFrame, n: int = 3, by: list[str] = ATTEMPT) -> DataFrame:
    return first_errors(messages, n, by).select(
        *by, "errors", F.array_join("first", "\n").alias("first3"), "more", console_text().alias("text")
    )


def error_lines(messages: DataFrame, by: list[str] = ATTEMPT) -> DataFrame:
    """All console errors of an attempt as one '- ' list, built in two levels where an attempt has very many."""
    errors = messages.filter(F.col("msg_type") == "error")
    return joined_text(errors, by, "event_id", F.concat(F.lit("- "), F.col("msg")), "\n", "console_errors")


# --- failed requests ---------------------------------------------------------------------------------------------


def failed_requests(requests: DataFrame, by: list[str] = ATTEMPT) -> DataFrame:
    """Ordered failed requests with the message cut to 200 characters. requests: run_id, attempt, event_id, url, failure."""
    text = F.substring(F.when(blank(F.col("failure")), "Unknown").otherwise(F.col("failure")), 1, 200)
    rows = requests.select(*by, "event_id", "url", text.alias("failure"))
    return ordinal(rows, by, "event_id").select(*by, "seq", "url", "failure")


def failed_request_counts(requests: DataFrame, by: list[str] = ATTEMPT) -> DataFrame:
    return requests.groupBy(*by).agg(F.count(F.lit(1)).alias("failed_requests"))


# --- error classes -----------------------------------------------------------------------------------------------


def timeout_locator(message: Column) -> Column:
    """After the last 'waiting for', before the next 'to' (also inside a word), trimmed."""
    return strip(F.split_part(F.split_part(message, F.lit("waiting for"), F.lit(-1)), F.lit("to"), F.lit(1)))


def _case(*branches: tuple[Column, Column | str]) -> Column:
    out = None
    for cond, value in branches:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def _kinds(cls: Column, message: Column) -> dict[str, Column]:
    lowered = F.lower(message)
    return {
        "navigation": cls == "nav_timeout",
        "locator": (cls == "TimeoutError") & F.contains(lowered, F.lit("waiting for")),
        "timeout": cls == "TimeoutError",
        "assertion": cls == "AssertionError",
        "crash": cls == "crash",
        "strict": F.contains(lowered, F.lit("strict mode")),
        "generic": cls.isNotNull(),
    }


def classify_errors(attempts: DataFrame) -> DataFrame:
    """Add error, error_type and status to attempts with exc_class, raw_error, passed.

    exc_class: nav_timeout, TimeoutError, AssertionError, crash, any other class name, or null for no exception.
    error_type is filled only for classes outside timeout, assertion, navigation and crash.
    """
    cls, msg = F.col("exc_class"), F.coalesce("raw_error", F.lit(""))
    k = _kinds(cls, msg)
    error = _case(
        (k["navigation"], t.NAVIGATION_ERROR.format(ms=t.EXECUTION_TIMEOUT_MS)),
        (k["locator"], render(t.LOCATOR_ERROR, locator=timeout_locator(msg))),
        (k["timeout"], render(t.TIMEOUT_ERROR, message=F.substring(msg, 1, 150))),
        (k["assertion"], render(t.ASSERTION_ERROR, message=F.substring(msg, 1, 100))),
        (k["crash"], render(t.CRASH_ERROR, message=F.substring(msg, 1, 100))),
        (k["strict"] & k["generic"], t.STRICT_ERROR),
        (k["generic"], F.concat(cls, F.lit(": "), F.substring(msg, 1, 100))),
    )
    own_type = k["generic"] & ~cls.isin("nav_timeout", "TimeoutError", "AssertionError", "crash")
    return attempts.withColumns({
        "error": error,
        "error_type": F.when(own_type, cls),
        "status": F.when(F.col("passed"), "passed").otherwise("failed"),
    })


def error_contexts(attempts: DataFrame, logs: DataFrame, requests: DataFrame, by: list[str] = ATTEMPT, by_run: bool = False) -> DataFrame:
    """Add error_context and console_text to attempts with url, and page_size and traceback where known.

    logs: `first_errors` of the console messages; requests: `failed_request_counts`. Both have one row per attempt (`by`). `by_run`: the
    attempts are dealt by run, the first column of `by`, and don't move for the logs.
    """
    join = (lambda a, b: join_within(a, b, *by)) if by_run else (lambda a, b: a.join(b, by, "left"))
    have = set(attempts.columns)
    opt = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    first_error = F.col("first")[0]
    cls, msg = F.col("exc_class"), F.coalesce("raw_error", F.lit(""))
    k = _kinds(cls, msg)
    zero = F.lit(0)
    context = _case(
        (k["navigation"], render(t.NAVIGATION_CONTEXT, url=F.col("url"))),
        (k["timeout"], render(
            t.TIMEOUT_CONTEXT,
            url=F.col("url"), page_size=F.coalesce(opt("page_size"), F.lit("0")),
            errors=F.coalesce("errors", zero), failed_requests=F.coalesce("failed_requests", zero),
            first_error=F.coalesce(F.concat(F.lit("First error: "), first_error), F.lit("")),
        )),
        (k["assertion"], render(t.ASSERTION_CONTEXT, message=msg)),
        (k["crash"], render(
            t.CRASH_CONTEXT, message=msg, traceback=F.right(F.coalesce(opt("traceback"), F.lit("")), F.lit(800)))),
        (k["strict"] & k["generic"], render(t.STRICT_CONTEXT, message=F.substring(msg, 1, 300))),
        (k["generic"], render(
            t.GENERIC_CONTEXT, error_type=cls, message=msg,
            traceback=F.right(F.coalesce(opt("traceback"), F.lit("")), F.lit(500)))),
    )
    return (
        join(join(attempts, logs), requests)
        .withColumns({"error_context": context, "console_text": console_text()})
        .drop("errors", "first", "more", "failed_requests")
    )


# --- locator strategies ------------------------------------------------------------------------------------------


def resolve_strategies(log: DataFrame) -> DataFrame:
    """First usable strategy of each run and the failures logged before it.

    log: run_id, rank (unique integer, trial order), name, outcome ('ok', 'invisible', 'raised'), error. Strategies
    behind the winner were never tried; an invisible one is neither chosen nor logged. `message` is the final error
    when nothing was usable.
    """
    ok = F.col("outcome") == "ok"
    winners = log.groupBy("run_id").agg(
        F.min(F.when(ok, F.struct("rank", "name"))).alias("_w")
    )
    # a run may hold any share of the log, so its rows are spread before they meet the one winner row
    tried = lookup_join(
        log.filter(F.col("outcome") == "raised").select("run_id", "rank", "name", "error"),
        winners.select("run_id", F.col("_w.rank").alias("_wr")),
        ["run_id"], ["run_id", "rank"],
    ).filter(F.col("_wr").isNull() | (F.col("rank") < F.col("_wr")))
    line = F.concat(F.lit("  - "), F.col("name"), F.lit(": "), F.substring("error", 1, 200))
    failures = joined_text(tried, ["run_id"], "rank", line, "\n", "failures")
    return winners.join(failures, "run_id", "left").select(
        "run_id",
        F.col("_w.name").alias("winner"),
        F.coalesce("failures", F.lit("")).alias("failures"),
        F.when(
            F.col("_w").isNull(), render(t.NOT_FOUND_ERROR, failures=F.coalesce("failures", F.lit("")))
        ).alias("message"),
    )


# --- artifacts ---------------------------------------------------------------------------------------------------


def artifact_keys(attempts: DataFrame, captured: Column | None = None) -> DataFrame:
    """Screenshot and DOM keys of an attempt; null where the capture failed."""
    ok = F.lit(True) if captured is None else captured
    base = (F.col("tenant_id"), F.col("project_id"), F.col("run_id"))
    n = F.col("attempt").cast("string")
    return attempts.withColumns({
        "screenshot_s3_path": F.when(
            ok, key_path(*base, F.concat(F.lit("screenshot_attempt_"), n, F.lit(".png")))),
        "dom_s3_path": F.when(ok, key_path(*base, F.concat(F.lit("dom_attempt_"), n, F.lit(".html")))),
    })
