"""Keyed state machines inside a stream (T2 cumulative, T3 with timers).

* ``cumulative_stream`` chains a second stateful operator behind the windowed
  counts of ``live.live_qps``: windows leave the first one when the watermark
  has closed them, and the second adds them up per level.  Append mode; the
  state is three numbers a level.
* ``phase_machine`` folds progress events per phase and sets a timer with each:
  a phase that is active and hears nothing for a while becomes stalled.  Update
  mode; the state is one row a phase.

Both keep their state in the checkpoint, so a query that is started again goes
on where it ended.
"""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

CUMULATIVE_SCHEMA = "level string, window_end_us long, completed long, cum_completed long, qps double"
PHASE_SCHEMA = "phase long, status string, note string, summary string, fraction double, warnings long, last_seq long"


class _AddUp(StatefulProcessor):
    """Adds up a level's closed windows in order; those without completions in
    between are filled in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "first long, ended long, total long")

    def handleInputRows(self, key, rows, timers):  # noqa: N802
        first, end, total = self.sums.get() if self.sums.exists() else (None, None, 0)
        out = []
        w = pd.concat(list(rows)).sort_values("window_start_us")
        for start, stop, completed in zip(w["window_start_us"], w["window_end_us"], w["completed"], strict=True):
            width = int(stop - start)
            first = int(start) if first is None else first
            while end is not None and end < start:
                end += width
                out.append((end, 0, total, total / ((end - first) / 1e6)))
            end, total = int(stop), total + int(completed)
            out.append((end, int(completed), total, total / ((end - first) / 1e6)))
        self.sums.update((first, end, total))
        got = pd.DataFrame(out, columns=["window_end_us", "completed", "cum_completed", "qps"])
        got.insert(0, "level", key[0])
        yield got

    def close(self) -> None:
        pass


def cumulative_stream(closed: DataFrame) -> DataFrame:
    """Completed so far and queries per second since the level's first
    window at the end of every closed window, from the stream of ``live_qps``.
    The session's state store must be the RocksDB one (``with_state_store``)."""
    return closed.groupBy("level").transformWithStateInPandas(
        _AddUp(), CUMULATIVE_SCHEMA, outputMode="append", timeMode="None")


@contextmanager
def with_state_store(spark):
    """The state store that arbitrary state behind other operators asks for."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _advance(quiet_ms: int):
    fields = ("started", "ended", "note", "summary", "shared", "fraction", "warnings", "last_seq")

    def run(key, parts, state):
        s = dict(zip(fields, state.get, strict=True)) if state.exists else dict.fromkeys(fields) | {"warnings": 0, "last_seq": -1}
        stalled = state.hasTimedOut
        if not stalled:
            for e in pd.concat(list(parts)).sort_values("seq").itertuples(index=False):
                # what a kind says is kept from its latest event, in whatever order the batches come
                if e.kind == "start" and (s["started"] is None or e.seq > s["started"]):
                    s["started"], s["note"] = int(e.seq), e.text
                elif e.kind == "end" and (s["ended"] is None or e.seq > s["ended"]):
                    s["ended"], s["summary"] = int(e.seq), e.text
                elif e.kind == "progress" and e.total > 0 and (s["shared"] is None or e.seq > s["shared"]):
                    s["shared"], s["fraction"] = int(e.seq), float(e.done / e.total)
                elif e.kind == "warn":
                    s["warnings"] += 1
                s["last_seq"] = max(s["last_seq"], int(e.seq))
            state.update(tuple(s[f] for f in fields))
        ended = s["ended"] is not None and s["ended"] > (-1 if s["started"] is None else s["started"])
        status = "done" if ended else "pending" if s["started"] is None else "stalled" if stalled else "active"
        if status == "active" and quiet_ms:
            state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame([(key[0], status, s["note"], s["summary"], s["fraction"] or 0.0, s["warnings"], s["last_seq"])],
                           columns=[c.strip().split(" ")[0] for c in PHASE_SCHEMA.split(",")])

    return run


def phase_machine(events: DataFrame, quiet_ms: int = 0) -> DataFrame:
    """A row per phase whenever its events (phase, seq, kind in
    start/progress/end/warn, text, done, total) change it: what
    ``live.phase_fold`` gives for the events so far.  With ``quiet_ms`` an
    active phase without events for so long gives a row with status stalled,
    until an event revives it."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if quiet_ms else GroupStateTimeout.NoTimeout
    state = ("started long, ended long, note string, summary string, shared long, fraction double, warnings long, last_seq long")
    return events.groupBy(F.col("phase").cast("long").alias("phase")).applyInPandasWithState(
        _advance(quiet_ms), PHASE_SCHEMA, state, "update", timeout)
