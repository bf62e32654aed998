"""Live hook logs: events as they are appended, calls paired as they end.

A session's open calls are its state, kept by Spark across micro-batches and restored after a failure: an entry for each
call, so a micro-batch reads and writes only the calls that it starts or ends. The order of lines within a session is what
pairing goes by, so the source must give it (``line_no``), and a batch is sorted by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparktrail.operators.normalize import canonical_input
from sparktrail.sources.hooks import parsed

CALL = "sid string, call int, line_no long, end_no long, blocked boolean, turn int, run int, tool string, outcome string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def follow(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """(sid, line_no, event fields, bad): events of part files ``<sid>/<anything>.jsonl`` as they appear in a folder.

    Lines carry their number in ``n``, since a streaming text source gives none.
    """
    raw = spark.readStream.option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(folder)
    line_no = F.get_json_object("value", "$.n").cast("long")
    sid = F.coalesce(F.get_json_object("value", "$.session_id"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    return parsed(raw.select(sid.alias("sid"), line_no.alias("line_no"), F.col("value").alias("line")))


class _Cached:
    """A map state, read and written once a key for each micro-batch."""

    def __init__(self, state: Any):
        self._state, self._own, self._changed = state, {}, set()

    def get(self, key: tuple) -> tuple | None:
        if key not in self._own:
            self._own[key] = self._state.getValue(key)
        return self._own[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        self._own[key] = value
        self._changed.add(key)

    def flush(self) -> None:
        for key in self._changed:
            if self._own[key] is not None:
                self._state.updateValue(key, self._own[key])
            elif self._state.containsKey(key):
                self._state.removeKey(key)
        self._own, self._changed = {}, set()


class CallPairing(StatefulProcessor):
    """The open calls of a session. Those of one tool and input are a stack, and so are those of one tool: the state has
    the top of each and, with each call, the one below it in both, so that starting or ending a call touches a few
    entries, however many are open. A call that ended by way of one stack stays in the other until it comes to its top."""

    def __init__(self, timeout_ms: int | None):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "calls int, turn int, run int")
        self.calls_state = handle.getMapState("calls", "call int", "line_no long, turn int, run int, tool string, given string, below_same int, below_tool int, is_open boolean, stacks int")
        self.tops_state = handle.getMapState("tops", "tool string, given string", "call int")

    def _top(self, key: tuple, below: int) -> int | None:
        """The last open call of a stack; ended ones above it leave."""
        top = self.tops.get(key)
        while top is not None:
            call = self.calls.get((top[0],))
            if call[7]:
                return top[0]
            self.calls.put((top[0],), (*call[:8], call[8] - 1) if call[8] > 1 else None)
            top = None if call[below] < 0 else (call[below],)
            self.tops.put(key, top)
        return None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        self.calls, self.tops = _Cached(self.calls_state), _Cached(self.tops_state)
        n, turn, run = self.counts.get() if self.counts.exists() else (0, 0, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values("line_no").itertuples():
            tool = r.tool or ""
            if r.event == "agent_spawn":
                run += 1
            elif r.event == "user_prompt":
                turn += 1
            elif r.event == "pre_tool_use":
                given = canonical_input(r.tool_input, True)
                below = [self._top((tool, given), 5), self._top((tool, ""), 6)]
                self.calls.put((n,), (int(r.line_no), max(turn, 1), max(run, 1), tool, given, *(-1 if b is None else b for b in below), True, 2))
                self.tops.put((tool, given), (n,))
                self.tops.put((tool, ""), (n,))
                n += 1
            elif r.event in ("post_tool_use", "tool_blocked"):
                ended = r.event == "post_tool_use"
                call = self._top((tool, canonical_input(r.tool_input, False)), 5) if ended else None
                call = self._top((tool, ""), 6) if call is None else call
                if call is not None:
                    own = self.calls.get((call,))
                    self.calls.put((call,), (*own[:7], False, own[8]))
                    out.append((key[0], call, own[0], int(r.line_no), not ended, own[1], own[2], own[3], "ended" if ended else "blocked"))
        self.calls.flush()
        self.tops.flush()
        self.counts.update((n, turn, run))
        if self.timeout_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """The session has been silent: its open calls are orphans, and nothing is kept of it."""
        left = sorted((k[0], v) for k, v in self.calls_state.iterator() if v[7])
        for state in (self.calls_state, self.tops_state, self.counts):
            state.clear()
        yield self._frame([(key[0], call, own[0], None, False, own[1], own[2], own[3], "orphan") for call, own in left])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in CALL.split(", ")], dtype=object)
        return frame.astype({"end_no": "Int64"})

    def close(self) -> None:
        """Spark closes the states."""


def paired(events: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """(sid, call, line_no, end_no, blocked, turn, run, tool, outcome) of calls as they end.

    ``outcome`` is ``ended``, ``blocked`` or, for calls still open when a session has been silent for the timeout (if
    one is given, which keeps a query running), ``orphan``. Appends only: a call is told once, when it is decided. The
    session's state store is set to the one on disk, which such state needs.
    """
    events.sparkSession.conf.set(_PROVIDER, _ROCKS)
    own = events.select("sid", "line_no", "event", "tool", "tool_input").groupBy("sid")
    return own.transformWithStateInPandas(CallPairing(timeout_ms), CALL, "Append", "None" if timeout_ms is None else "ProcessingTime")


def tool_rates(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, tool, n): calls by tool and time window, late events within the watermark counted."""
    timed = events.withColumn("at", F.try_to_timestamp("ts")).filter("event = 'pre_tool_use'").withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), "tool").agg(F.count("*").alias("n")).select("w.start", "tool", "n")


def write(rows: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append a stream to Parquet; with ``once`` everything there is, then stop."""
    sink = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (sink.trigger(availableNow=True) if once else sink).start()
