"""Attempt events of runs: which runs end, which go on, how far they are.

attempts: run_id, attempt, passed, pipeline_error, ts. An attempt tells by itself whether it ends its run (it passed, it
crashed, or it was the last one allowed), so ends and retries need no state beyond duplicate removal, and the order of
arrival does not matter. Only a run whose next attempt never comes has no event that tells; `attempt_states` waits for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from qaloom.operators.events import dedup_stream
from qaloom.operators.runs import MAX_ATTEMPTS, failed


def ends_run(max_attempts: int = MAX_ATTEMPTS) -> Column:
    return ~failed(F.col("passed")) | F.col("pipeline_error").isNotNull() | (F.col("attempt") >= max_attempts)


def finished_runs(attempts: DataFrame, delay: str = "1 hour", max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The final attempt of every run, once."""
    return dedup_stream(attempts.filter(ends_run(max_attempts)), ["run_id"], "ts", delay)


def retry_requests(attempts: DataFrame, delay: str = "1 hour", max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Attempts to be made next: run_id and the next attempt number, once per failed attempt."""
    go_on = dedup_stream(attempts.filter(~ends_run(max_attempts)), ["run_id", "attempt"], "ts", delay)
    return go_on.withColumn("attempt", F.col("attempt") + 1)


def run_progress(attempts: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Attempts so far, any pass, last error per run; state of a window is dropped once the watermark has passed it."""
    return (
        attempts.withWatermark("ts", delay)
        .groupBy(F.window("ts", size).alias("w"), "run_id")
        .agg(
            F.max("attempt").alias("attempts"), F.bool_or(F.coalesce("passed", F.lit(False))).alias("passed"),
            F.max_by("pipeline_error", "attempt").alias("last_error"),
        )
        .select(F.col("w.start").alias("window_start"), "run_id", "attempts", "passed", "last_error")
    )


def attempt_states(
    attempts: DataFrame, wait: str = "30 minutes", delay: str = "10 minutes", max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """What became of each run: run_id, attempt, since, state.

    `finished` comes with the attempt that ends a run, once. `stalled` comes when the watermark has passed `wait` after the last
    attempt seen and no attempt has ended the run; `attempt` and `since` are those of that last attempt. A stalled run that goes on
    after all starts anew. Attempts may come in any order and repeatedly. A run's state is its last attempt, that attempt's time
    and whether it has ended; it is dropped `wait` after the last event, also for runs that have ended.
    """
    patience = pd.Timedelta(wait).value // 1_000_000
    rows = attempts.select("run_id", "attempt", "ts", ends_run(max_attempts).alias("ends")).withWatermark("ts", delay)

    def row(run, attempt: int, since: int, state: str) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [run], "attempt": [attempt], "since": [pd.Timestamp(since, unit="ms")], "state": [state]})

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        attempt, since, latest, ended = state.get if state.exists else (0, 0, 0, False)
        if state.hasTimedOut:
            state.remove()
            if not ended:
                yield row(key[0], attempt, since, "stalled")
            return
        was = ended
        end = None
        for f in frames:
            f = f.assign(ms=f["ts"].astype("datetime64[ms]").astype("int64"))
            top = f.sort_values(["attempt", "ms"]).iloc[-1]
            if (top["attempt"], top["ms"]) > (attempt, since):
                attempt, since = int(top["attempt"]), int(top["ms"])
            latest = max(latest, int(f["ms"].max()))
            last = f[f["ends"]].sort_values(["attempt", "ms"]).head(1)
            if len(last):
                ended, end = True, min(end or (2**31, 0), (int(last["attempt"].iloc[0]), int(last["ms"].iloc[0])))
        state.update((attempt, since, latest, ended))
        state.setTimeoutTimestamp(max(latest + patience, state.getCurrentWatermarkMs() + 1))
        if ended and not was:
            yield row(key[0], *end, "finished")

    kind = rows.schema["run_id"].dataType.simpleString()
    return rows.groupBy("run_id").applyInPandasWithState(
        follow, f"run_id {kind}, attempt int, since timestamp, state string", "attempt int, since long, latest long, ended boolean", "append", "EventTimeTimeout")
