"""Attempts of a run: which ones count, what the next one is told, where a run goes next.

attempts: run_id, attempt (from 1), passed, and optionally pipeline_error, the text of a crash outside the test
script. Logs may be delivered more than once, so functions bring them to one row per (run, attempt) first and every later
group holds at most `max_attempts` rows; `unique=True` skips that step where the log is known to have no copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from qaloom.operators.skew import first_n

MAX_ATTEMPTS = 3

# fixed values: run states in the order a run goes through them
STATUS_ORDER = ("queued", "scenario_generated", "passed", "failed", "analyzing", "completed")
STATUS_RANK = {"queued": 0, "scenario_generated": 1, "passed": 2, "failed": 2, "analyzing": 3, "completed": 4}


def _crashed(df: DataFrame) -> Column:
    return F.col("pipeline_error").isNotNull() if "pipeline_error" in df.columns else F.lit(False)


def failed(passed: Column) -> Column:
    """A missing outcome counts as passed here."""
    return ~F.coalesce(passed, F.lit(True))


def dedupe_attempts(attempts: DataFrame, newest: str | None = None) -> DataFrame:
    """One row per (run, attempt), cut per input partition before the shuffle. Where copies disagree the one with the largest
    `newest` wins; without such a column the choice is arbitrary but the same in every run."""
    rest = [c for c in attempts.columns if c not in ("run_id", "attempt")]
    order = ([F.desc_nulls_last(newest)] if newest else []) + [F.xxhash64(*rest)]
    return first_n(attempts, ["run_id", "attempt"], order, 1)


def effective_attempts(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS, unique: bool = False, mark: str | None = None) -> DataFrame:
    """Attempts that really ran: up to the first pass, the first pipeline crash or the limit. With `mark` the others stay as well, and a
    column of that name tells them apart."""
    stop = F.when(_crashed(attempts) | ~failed(F.col("passed")), 1).otherwise(0)
    before = W.partitionBy("run_id").orderBy("attempt").rowsBetween(W.unboundedPreceding, -1)
    within = F.col("attempt") <= max_attempts
    kept = attempts if mark else attempts.filter(within)
    rows = (kept if unique else dedupe_attempts(kept)).withColumn("_stopped", F.coalesce(F.max(stop).over(before), F.lit(0)))
    if mark:
        return rows.withColumn(mark, within & (F.col("_stopped") == 0)).drop("_stopped")
    return rows.filter(F.col("_stopped") == 0).drop("_stopped")


def final_attempt(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS, unique: bool = False) -> DataFrame:
    """The last effective attempt of each run, with the number of attempts made."""
    return (
        effective_attempts(attempts, max_attempts, unique)
        .groupBy("run_id")
        .agg(
            F.max("attempt").alias("attempt"),
            F.max_by("passed", "attempt").alias("passed"),
            F.count(F.lit(1)).alias("attempts_made"),
        )
    )


def should_retry(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS, unique: bool = False) -> DataFrame:
    """retry per effective attempt: it failed, did not crash, and attempts are left."""
    return effective_attempts(attempts, max_attempts, unique).withColumn(
        "retry", failed(F.col("passed")) & ~_crashed(attempts) & (F.col("attempt") < max_attempts)
    )


def retry_context(
    attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS, unique: bool = False, console_errors: DataFrame | None = None,
    raw: list[str] | None = None, mark: str | None = None,
) -> DataFrame:
    """Add what the previous attempt left behind: number, error, error context, screenshot and DOM keys, and its own console
    errors where `console_errors` (run_id, attempt, console_errors: see `execution.error_lines`) is given.

    `raw` are columns that are handed on as they are (`previous_` and the name), where the texts are made from them later. `mark`: see
    `effective_attempts`; the attempt before one that ran has run as well.
    """
    carried = {
        "previous_error": "error", "previous_error_context": "error_context",
        "previous_screenshot": "screenshot_s3_path", "previous_dom": "dom_s3_path",
    }
    w = W.partitionBy("run_id").orderBy("attempt")
    eff = effective_attempts(attempts, max_attempts, unique, mark)
    cols = {"attempt_number": F.lag("attempt").over(w), "is_retry": F.col("attempt") > 1}
    for name in raw or []:
        cols["previous_" + name] = F.lag(name).over(w)
    for name, src in carried.items():
        cols[name] = F.lag(src).over(w) if src in eff.columns else F.lit(None).cast("string")
    rows = eff.withColumns(cols)
    if console_errors is None:
        return rows
    # the text joins by the number of the attempt before; it is not carried through the window
    return rows.join(console_errors.select("run_id", F.col("attempt").alias("attempt_number"), "console_errors"), ["run_id", "attempt_number"], "left")


def route(first_results: DataFrame) -> DataFrame:
    """Next stage per row; here a missing outcome counts as failed."""
    return first_results.withColumn(
        "route", F.when(F.coalesce("passed", F.lit(False)), "visual_analysis").otherwise("analysis")
    )


def run_failures(attempts: DataFrame) -> DataFrame:
    return attempts.filter(failed(F.col("passed")))


def any_failure(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("run_id").agg(F.bool_or(failed(F.col("passed"))).alias("has_failures"))


def crashed_runs(attempts: DataFrame, unique: bool = False) -> DataFrame:
    """Runs whose pipeline crashed: no further attempt, the run row keeps its status."""
    return effective_attempts(attempts, unique=unique).filter(_crashed(attempts))


def status_rank(status: Column) -> Column:
    return F.coalesce(*[F.when(status == s, r) for s, r in STATUS_RANK.items()])


def current_status(log: DataFrame) -> DataFrame:
    """Furthest state per run from a log of (run_id, attempt, status)."""
    return log.groupBy("run_id").agg(
        F.max_by("status", F.struct("attempt", status_rank(F.col("status")).alias("r"))).alias("status")
    )


def illegal_jumps(log: DataFrame) -> DataFrame:
    """Rows whose state does not follow the one before it in the same attempt. log adds step, the order within."""
    w = W.partitionBy("run_id", "attempt").orderBy("step")
    rank = status_rank(F.col("status"))
    return (
        log.withColumn("previous", F.lag("status").over(w))
        .withColumn("_d", rank - status_rank(F.col("previous")))
        .filter(F.when(F.col("previous").isNull(), rank != 0).otherwise(F.coalesce(F.col("_d") != 1, F.lit(True))))
        .drop("_d")
    )


def status_log(attempts: DataFrame, unique: bool = False) -> DataFrame:
    """The states every effective attempt goes through, one row per step; a crash ends after 'queued'."""
    steps = F.when(_crashed(attempts), F.array(F.lit("queued"))).otherwise(
        F.array(
            F.lit("queued"), F.lit("scenario_generated"),
            F.when(failed(F.col("passed")), "failed").otherwise("passed"), F.lit("analyzing"), F.lit("completed"),
        )
    )
    return effective_attempts(attempts, unique=unique).select("run_id", "attempt", F.posexplode(steps).alias("step", "status"))
