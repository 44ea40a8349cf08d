"""Time limits and cancel requests of running analyses, on streams and on tables.

Events of an analysis are put in order by a buffer before they count: an event
waits in the state until the watermark has passed it, so the order of arrival
within the allowed lateness changes nothing.  An analysis ends with its first
terminal event or at its time limit, whichever comes first in event time; an
event-time timer ends one that has gone silent.  What comes after the end is
dropped, and some time after it the state is gone.

``ended`` over a table and ``watch`` over a stream give the same ends;
``with_cancels`` is one function for both.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioforge.operators.catalog import TERMINAL, timeout_minutes

OUT = "key string, ended_at timestamp, status string, progress int, n_events long"
LATE = "10 minutes"
#: Minutes for which an ended analysis is remembered, so that stragglers don't begin it anew.
REMEMBERED = 24 * 60
MOST_ON_ERROR = 95


def _picked(events: DataFrame) -> DataFrame:
    """key, ts, event_no, status, progress, and the limit that holds if this is the first event."""
    limit = F.coalesce(timeout_minutes(F.coalesce("pages", F.lit(0))), F.lit(25)).cast("int")
    ts = F.col("ts").cast("timestamp")
    return events.select(F.col("key").cast("string").alias("key"), ts.alias("ts"), F.coalesce(F.col("event_no").cast("long"), F.lit(-1)).alias("event_no"), F.col("status").cast("string").alias("status"), F.coalesce("progress", F.lit(0)).cast("int").alias("progress"), limit.alias("limit"))


def ended(events: DataFrame, until=None, terminal: Sequence[str] = TERMINAL) -> DataFrame:
    """OUT, one row per analysis that has ended by ``until`` (a timestamp; by default
    that of the last event).

    ``events``: key, ts, event_no, status, progress, pages.  The time limit counts
    from the first event by the pages it states (O-188).  An event at the limit
    still counts.  ``n_events``: the events up to the end; progress is the highest
    so far, at most 95 for one that timed out.  Rows without key or time are left
    out; equal events count once each.
    """
    e = _picked(events).where("key is not null and ts is not null")
    order = Window.partitionBy("key").orderBy("ts", "event_no", "status", "progress")
    first = F.first(F.struct("ts", "limit")).over(order)
    e = e.withColumn("__first", first).withColumn("deadline", F.timestamp_add("MINUTE", F.col("__first.limit"), F.col("__first.ts"))).where(F.col("ts") <= F.col("deadline"))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.max(F.col("status").isin(*terminal)).over(upto), F.lit(False))
    counted = e.withColumn("__over", over).where("not __over")
    last = F.max_by(F.struct("ts", "status"), F.struct("ts", "event_no", "status", "progress"))
    rows = counted.groupBy("key").agg(F.first("deadline").alias("deadline"), last.alias("last"), F.max("progress").alias("most"), F.count("*").alias("n_events"))
    done = F.col("last.status").isin(*terminal)
    out = rows.select(
        "key",
        F.when(done, F.col("last.ts")).otherwise(F.col("deadline")).alias("ended_at"),
        F.when(done, F.col("last.status")).otherwise(F.lit("error")).alias("status"),
        F.least(F.when(done, F.lit(100)).otherwise(F.lit(MOST_ON_ERROR)), "most").cast("int").alias("progress"),
        "n_events",
    )
    if until is None:  # one row
        return out.join(F.broadcast(events.agg(F.max(F.col("ts").cast("timestamp")).alias("__until"))), F.col("ended_at") <= F.col("__until")).drop("__until")
    return out.where(F.col("ended_at") <= F.lit(until).cast("timestamp"))


class Limiter(StatefulProcessor):
    """Ordering buffer, time limit and end of one analysis."""

    def __init__(self, terminal: Sequence[str]):
        self.terminal = frozenset(terminal)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "deadline long, progress int, n_events long, ended boolean")
        self.waiting = handle.getListState("waiting", "ts long, event_no long, status string, progress int, limit int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.run.get() if self.run.exists() else None
        if now is None or not now[3]:
            for f in rows:
                for r in f.itertuples(index=False):
                    at = int(r.ts.value // 1000)
                    self.waiting.appendValue((at, int(r.event_no), r.status, int(r.progress), int(r.limit)))
                    self.handle.registerTimer(at // 1000 + 1)
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        now = self.run.get() if self.run.exists() else None
        if now is not None and now[3]:
            if passed >= now[0] + REMEMBERED * 60_000_000:
                self.run.clear()
            yield self._frame([])
            return
        held = sorted(self.waiting.get(), key=lambda x: (x[0], x[1], x[2] is not None, x[2] or "", x[3])) if self.waiting.exists() else []
        due, later = [x for x in held if x[0] < passed], [x for x in held if x[0] >= passed]
        end = None
        for at, _, status, progress, limit in due:
            if now is None:
                now = (at + limit * 60_000_000, 0, 0, False)
                self.handle.registerTimer(now[0] // 1000 + 1)
            if at > now[0]:
                break
            now = (now[0], max(now[1], progress), now[2] + 1, False)
            if status in self.terminal:
                end = (at, status, min(100, now[1]))
                break
        if now is not None and end is None and passed > now[0]:
            end = (now[0], "error", min(MOST_ON_ERROR, now[1]))
        self.waiting.clear()
        if end is None:
            if later:
                self.waiting.put(later)
            if now is not None:
                self.run.update(now)
            yield self._frame([])
            return
        self.run.update((end[0], 0, 0, True))
        self.handle.registerTimer(end[0] // 1000 + REMEMBERED * 60_000 + 1)
        yield self._frame([(key[0], pd.Timestamp(end[0], unit="us"), end[1], end[2], now[2])])

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def watch(events: DataFrame, late: str = LATE, terminal: Sequence[str] = TERMINAL) -> DataFrame:
    """OUT for a stream of events (columns as in :func:`ended`), each end once, when
    the watermark (``late`` behind the last event) has passed it.  Needs
    ``lifecycle.use_rocksdb``."""
    e = _picked(events).where("key is not null and ts is not null").withWatermark("ts", late)
    return e.groupBy("key").transformWithStateInPandas(Limiter(terminal), OUT, "Append", "EventTime")


def with_cancels(runs: DataFrame, cancels: DataFrame, limit: str = "25 minutes", late: str | None = None) -> DataFrame:
    """Runs with the cancel requests that reach them: run_id, key, started_at,
    requested_at (null: none).

    ``runs``: run_id, key, started_at; ``cancels``: key, requested_at.  A request
    reaches the runs of its key that began up to ``limit`` before it.  A run with
    several requests has a row for each.  On streams (``late``: how far behind
    rows may come) an outer join in a time interval: the state of a run goes when
    the watermark has passed its interval, and only then is it known to have none.
    """
    r = runs.select("run_id", F.col("key").alias("key"), F.col("started_at").cast("timestamp").alias("started_at"))
    c = cancels.select(F.col("key").alias("__key"), F.col("requested_at").cast("timestamp").alias("requested_at"))
    if late:
        r, c = r.withWatermark("started_at", late), c.withWatermark("requested_at", late)
    inside = (F.col("key") == F.col("__key")) & (F.col("requested_at") >= F.col("started_at")) & (F.col("requested_at") <= F.col("started_at") + F.expr(f"INTERVAL {limit}"))
    return r.join(c, inside, "left_outer").select("run_id", "key", "started_at", "requested_at")
