"""Streams whose answers hang on the order of events: keyed state with event-time timers.

Rows may come in any order within the watermark's delay.  A key holds its rows until the
watermark has passed them, settles them in order of (time, tie), and then only needs what its fold
carries on.  Answers are given once, when they can't change any more.  Rows later than the delay are
dropped by the engine, as everywhere behind a watermark; failure streaks alone take them back into
account, however late they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import retry_wait

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEVER = 253_402_214_400_000_000  # 9999-12-31, in microseconds


def timed(stream: DataFrame, at: Column, delay: str) -> DataFrame:
    """Adds ``_at`` (for the watermark) and ``at`` (microseconds); rows of ``beat`` move the watermark and go no further."""
    marked = stream.withColumn("_at", at.cast("timestamp")).withWatermark("_at", delay)
    if "_beat" in stream.columns:
        # one condition that names the time as well, else it would be tested below the watermark
        marked = marked.where(F.when(F.col("_beat"), F.col("_at").isNull()).otherwise(F.col("_at").isNotNull())).drop("_beat")
    return marked.withColumn("at", F.unix_micros("_at"))


class Settled(StatefulProcessor):
    """A fold over a key's rows in order of (at, tie), each taken once the watermark has passed it.

    A key has one timer, for the earliest row that waits (``due``): each firing settles all rows that
    the watermark has passed, so rows are read once for each batch and not once for each of them.

    ``step`` takes what was carried (None at first) and a row, and gives what is carried on and the
    rows that come out.  ``until`` says from when on (microseconds) what is carried tells nothing,
    so that the key may go; None: never.
    """

    def __init__(self, row_type: str, carry_type: str, columns: list[str], step: Callable, until: Callable) -> None:
        self.row_type, self.carry_type, self.columns, self.step, self.until = row_type, carry_type, columns, step, until

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row_type)
        self.carry = handle.getValueState("carry", self.carry_type)
        self.due = handle.getValueState("due", "ms long")

    def _wake(self, at: int) -> None:
        """Sets the timer for the earliest waiting row (microseconds), unless it is due no later."""
        ms, due = -(-int(at) // 1000), self.due.get()[0] if self.due.exists() else None
        if due is None or ms < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        # whole numbers beside nulls come as floats, which a state column of longs would take as null
        plain = lambda v: None if pd.isna(v) else v if isinstance(v, str) else int(v)
        new = [tuple(map(plain, r)) for part in rows for r in part[self.columns].itertuples(index=False)]
        if not new:
            return
        self.waiting.appendList(new)
        self._wake(min(r[0] for r in new))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in held if r[0] <= now), key=lambda r: r[:2])
        carried = tuple(self.carry.get()) if self.carry.exists() else None
        out = []
        for row in ready:
            carried, given = self.step(carried, row)
            out += given
        rest = [r for r in held if r[0] > now]
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        self.due.clear()
        if rest:
            self._wake(min(r[0] for r in rest))
        ends = self.until(carried) if carried is not None else None
        if ends is not None and ends <= now:
            self.carry.clear()
        elif carried is not None and ready:
            self.carry.update(carried)
            if ends is not None:
                self.handle.registerTimer(min(-(-ends // 1000), NEVER // 1000))
        if out:
            yield pd.DataFrame([(*key, *r) for r in out])

    def close(self) -> None:
        pass


def _overlap(carried: tuple | None, row: tuple) -> tuple[tuple, list]:
    at, run_id, ends = row
    busy = carried[0] if carried else -NEVER
    return (max(busy, NEVER if ends is None else int(ends)),), [(run_id,)] if busy > at else []


def overlapping_runs(stream: DataFrame, delay: str) -> DataFrame:
    """user_id, company_id, run_id of runs that start while an earlier one of their user and company is unfinished.

    State is one end time and the rows within ``delay``; a key goes when its last run has ended.  A run
    without an end blocks all later ones, so its key stays.
    """
    rows = timed(stream, F.col("started_at"), delay).select("user_id", "company_id", "at", "run_id", F.unix_micros(F.col("completed_at").cast("timestamp")).alias("ends"))
    fold = Settled("at long, run_id string, ends long", "busy long", ["at", "run_id", "ends"], _overlap, lambda carried: None if carried[0] >= NEVER else carried[0])
    return rows.groupBy("user_id", "company_id").transformWithStateInPandas(fold, "user_id string, company_id string, run_id string", "Append", "EventTime")


def _changed(carried: tuple | None, row: tuple) -> tuple[tuple, list]:
    at, seq, year = row
    was = carried[0] if carried else None
    return (year,), [(int(at), int(seq))] if None not in (was, year) and was != year else []


def year_changes(stream: DataFrame, delay: str) -> DataFrame:
    """user_id, updated_at, seq, kind: a notification for each change of a user's graduation year.

    State is the last settled year of each user and the rows within ``delay``.
    """
    rows = timed(stream, F.col("updated_at"), delay).select("user_id", "at", "seq", F.col("graduation_year").cast("int").alias("year"))
    fold = Settled("at long, seq long, year int", "year int", ["at", "seq", "year"], _changed, lambda carried: None)
    made = rows.groupBy("user_id").transformWithStateInPandas(fold, "user_id string, at long, seq long", "Append", "EventTime")
    return made.select("user_id", F.timestamp_micros("at").cast("timestamp_ntz").alias("updated_at"), "seq", F.lit("ELIGIBLE_JOB_CHANGED").alias("kind"))


class Streaks(StatefulProcessor):
    """The last success of a company and all failures after it, so a success may come at any time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.good = handle.getValueState("good", "at long, run_id string")
        self.fails = handle.getListState("fails", "at long, run_id string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = [(int(a), str(i), s) for part in rows for a, i, s in zip(part["at"], part["run_id"], part["status"], strict=True)]
        good = tuple(self.good.get()) if self.good.exists() else (-NEVER, "")
        better = max([good, *((a, i) for a, i, s in new if s == "COMPLETED")])
        held = [tuple(x) for x in self.fails.get()] if self.fails.exists() else []
        added = [(a, i) for a, i, s in new if s == "FAILED" and (a, i) > better]
        fails = [r for r in held if r > better] + added
        if better > good:
            self.good.update(better)
            self.fails.put(fails) if fails else self.fails.clear()
        elif added:
            self.fails.appendList(added)
        yield pd.DataFrame({"company_id": [key[0]], "failures": [len(fails)], "last": pd.array([max(fails)[0] if fails else None], dtype="Int64")})

    def close(self) -> None:
        pass


def failure_streaks(stream: DataFrame) -> DataFrame:
    """company_id, failures, last_failure, retry_after of the newest state of each company.

    Counts, like the batch form, all failed runs after the last success, repeated rows as often as
    they occur; a streak that ended comes out with 0 failures and no times.  There is no watermark, so
    no row is too late, and the state is a company's failures since its last success.
    """
    rows = stream.select("company_id", F.unix_micros(F.col("started_at").cast("timestamp")).alias("at"), "run_id", "status")
    made = rows.groupBy("company_id").transformWithStateInPandas(Streaks(), "company_id string, failures long, last long", "Update", "None")
    last = F.timestamp_micros("last").cast("timestamp_ntz")
    return made.select("company_id", "failures", last.alias("last_failure"), (last + retry_wait(F.col("failures"))).alias("retry_after"))
