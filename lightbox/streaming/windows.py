"""Time-based grouping of events: quiet-time sessions and anchored limits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lightbox.plans.ordered import FOLD_ROWS, greedy_segments, running

# Attempts per window, window and inactivity time in seconds.
MAX_ATTEMPTS = 10
ATTEMPT_WINDOW = 300
INACTIVE_AFTER = 60


def _micros(rows: DataFrame, ts: str):
    """Microseconds on the column's own clock, whatever the session's zone."""
    instant = F.col(ts).cast("timestamp")
    if dict(rows.dtypes)[ts] == "timestamp_ntz":
        instant = F.from_utc_timestamp(instant, F.current_timezone())
    return F.unix_micros(instant)


def gap_sessions(
    rows: DataFrame, by: Sequence[str], gap_ms: int, ts: str = "ts", fold_rows: int = FOLD_ROWS
) -> DataFrame:
    """(by..., started_us, last_us, n): runs of events less than ``gap_ms`` apart.

    Events in one slice of the length of the gap always share a run, so they are
    combined to (first, last, count) before any ordering; only slices are
    ordered. A key with very many slices is ordered over several tasks.
    """
    gap = gap_ms * 1000
    us = rows.select(*by, _micros(rows, ts).alias("_t"))
    slices = us.withColumn("_s", F.floor(F.col("_t") / F.lit(gap))).groupBy(*by, "_s").agg(
        F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count("*").alias("_n")
    )
    widest = slices.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if widest <= fold_rows:
        order = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        order = order.orderBy("_s")
        opens = F.coalesce(F.col("_lo") - F.lag("_hi").over(order) > gap, F.lit(True))
        numbered = slices.withColumn("_o", opens.cast("long")).withColumn(
            "_run", F.sum("_o").over(order.rowsBetween(Window.unboundedPreceding, 0))
        )
    else:
        placed = running(slices, by, [F.col("_s")])
        before = placed.select((F.col("sequence") + 1).alias("sequence"), F.col("_hi").alias("_prev"))
        marked = placed.join(before, "sequence", "left").withColumn(
            "_o",
            ((F.col("position") == 1) | (F.col("_lo") - F.col("_prev") > gap)).cast("long"),
        )
        numbered = running(
            marked.drop("position", "sequence"), by, [F.col("_s")], F.col("_o")
        ).withColumnRenamed("total", "_run")
    return numbered.groupBy(*by, "_run").agg(
        F.min("_lo").alias("started_us"), F.max("_hi").alias("last_us"), F.sum("_n").alias("n")
    ).drop("_run")


def debounced_refresh(requests: DataFrame, quiet_ms: int, ts: str = "ts") -> DataFrame:
    """One refresh per run of requests, due ``quiet_ms`` after the last of them."""
    return gap_sessions(requests, [], quiet_ms, ts).select(
        (F.col("last_us") + quiet_ms * 1000).alias("due_us"), F.col("n").alias("requests")
    )


def inactive_sessions(
    events: DataFrame, by: str, timeout_s: int = INACTIVE_AFTER, ts: str = "ts"
) -> DataFrame:
    """Sessions of each key that end after ``timeout_s`` without an event."""
    return gap_sessions(events, [by], timeout_s * 1000, ts).select(
        by, "started_us", (F.col("last_us") + timeout_s * 1_000_000).alias("ended_us"), "n"
    )


def session_stream(
    events: DataFrame, by: Sequence[str], gap: str, late: str = "10 minutes", ts: str = "ts"
) -> DataFrame:
    """The streaming form of both: closed sessions in append mode."""
    return (
        events.withWatermark(ts, late)
        .groupBy(*by, F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select(*by, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
    )


def attempt_limiter(
    attempts: DataFrame, by: str, limit: int = MAX_ATTEMPTS, window_s: int = ATTEMPT_WINDOW,
    ts: str = "ts", tie: str = "seq", fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """Add ``attempt`` (1-based in its window) and ``allowed``.

    A window starts at its first attempt and is over once more than
    ``window_s`` whole seconds have passed. Refused attempts do not count, so
    exactly the first ``limit`` of a window are allowed.
    """
    timed = attempts.withColumn("_at", _micros(attempts, ts))
    cut = greedy_segments(
        timed, [by], ["_at", tie], (window_s + 1) * 1_000_000 - 1, at="_at", fold_rows=fold_rows
    )
    return cut.withColumn("allowed", F.col("rank") <= limit).withColumnRenamed(
        "rank", "attempt"
    ).drop("_at", "segment")


def attempt_limiter_stream(
    attempts: DataFrame, by: str, limit: int = MAX_ATTEMPTS, window_s: int = ATTEMPT_WINDOW,
    ts: str = "ts", tie: str | None = None, late: str = "10 minutes",
) -> DataFrame:
    """The streaming form: state per key is the window's start and its count.

    Windows and their expiry run on event time, so a pause in delivery resets
    nothing; attempts more than ``late`` behind are dropped. A key's rows of one
    micro-batch are taken together in the order of time and ``tie``.
    """
    extra = [tie] if tie else []
    kinds = dict(attempts.dtypes)
    out = f"{by} {kinds[by]}, {ts} {kinds[ts]}, allowed boolean"

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(batches)).sort_values([ts, *extra], kind="stable")
        at = pdf[ts].astype("int64").to_numpy() // _unit(pdf[ts])
        allowed = np.zeros(len(at), bool)
        i = 0
        # One step per window: its end is found by bisection.
        while i < len(at):
            if start is None or (at[i] - start) // 1_000_000 > window_s:
                start, used = int(at[i]), 0
            end = int(np.searchsorted(at, start + (window_s + 1) * 1_000_000, side="left"))
            allowed[i : min(end, i + limit - used)] = True
            used = min(limit, used + end - i)
            i = end
        yield pd.DataFrame({by: [key[0]] * len(pdf), ts: pdf[ts].to_numpy(), "allowed": allowed})
        state.update((start, int(used)))
        over = start // 1000 + (window_s + 1) * 1000
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))

    return attempts.select(by, ts, *extra).withWatermark(ts, late).groupBy(by).applyInPandasWithState(
        step, out, "start long, used int", "append", GroupStateTimeout.EventTimeTimeout
    )


def _unit(series: pd.Series) -> int:
    """Ticks per microsecond of the series' clock."""
    return 1000 if series.dt.unit == "ns" else 1
