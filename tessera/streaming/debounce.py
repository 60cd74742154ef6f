"""Requests of a stream of change hints: a quiet time, a longest delay, a bounded buffer, and a rescan where something was lost."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.hints import RESCAN, meaningful

#: Hints that wait for a root at most, once what has ended is given out; one more gives them all up for a rescan (fixed value).
BUFFER = 256
#: Rows of requests that are given out at once.
ROWS = 10_000
REQUEST = "root {}, request long, path string, operations int, kind string, reason string, sequence long"
HINT = "at long, sequence long, path string, operations int, kind string, reason string"


def _coalesced(hints: list[tuple]) -> list[tuple]:
    """(path, operations, kind, reason, sequence) for each path of (at, sequence, path, operations, kind, reason)."""
    out: dict[str, list] = {}
    for _, sequence, path, operations, kind, reason in sorted(hints, key=lambda h: h[1]):
        own = out.setdefault(path, [0, kind, "", sequence])
        own[0] |= operations
        if own[1] in ("", "unknown") and kind not in ("", "unknown"):
            own[1] = kind
        own[2] = own[2] or reason or ""
    return [(path, *own) for path, own in sorted(out.items())]


class Debounce(StatefulProcessor):
    """State of a root: hints of requests that are open, how many requests it had, and until when they reach.

    Two timers for each open request: after its last hint by the quiet time, after its first by the longest
    delay. Event time counts as settled `settle` behind the newest hint, where the stream's
    watermark is `late` behind; timers stand at the difference. Where a batch brings more hints than
    may wait, the requests that its own newest hint settles don't wait for the watermark.
    """

    def __init__(self, quiet: float, most: float, settle: float, late: float, buffer: int):
        self.quiet, self.most, self.settle, self.behind, self.buffer = round(quiet * 1e6), round(most * 1e6), round(settle * 1e6), round((late - settle) * 1e6), buffer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", HINT)
        self.past = handle.getValueState("past", "requests long, until long")

    def _held(self) -> tuple[list[tuple], int, int]:
        requests, until = self.past.get() if self.past.exists() else (0, -(1 << 62))
        return sorted(tuple(h) for h in self.pending.get()) if self.pending.exists() else [], requests, until

    def _timers(self, pending: list[tuple]) -> None:
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        if pending:
            first, last = pending[0][0], pending[self._end(pending, 0) - 1][0]
            for close in {last + self.quiet, first + self.most}:
                self.handle.registerTimer(max(0, -(-(close - self.behind) // 1000)))

    def _end(self, pending: list[tuple], begin: int) -> int:
        """Where the request that begins at a place ends."""
        first, end = pending[begin][0], begin + 1
        while end < len(pending) and pending[end][0] < pending[end - 1][0] + self.quiet and pending[end][0] < first + self.most:
            end += 1
        return end

    def _ended(self, pending: list[tuple], settled: int) -> list[tuple[int, int, int]]:
        """(begin, end, close) of the requests that have ended, in order."""
        out, begin = [], 0
        while begin < len(pending):
            end = self._end(pending, begin)
            close = min(pending[end - 1][0] + self.quiet, pending[begin][0] + self.most)
            if close > settled:
                break
            out.append((begin, end, close))
            begin = end
        return out

    def _keep(self, pending: list[tuple], requests: int, until: int) -> None:
        if pending:
            self.pending.put(pending)
        else:
            self.pending.clear()
        self.past.update((requests, until))
        self._timers(pending)

    def _rows(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["root", "request", "path", "operations", "kind", "reason", "sequence"])

    def _given(self, key: tuple, pending: list[tuple], ended: list[tuple[int, int, int]], requests: int) -> Iterator[pd.DataFrame]:
        """Rows of requests that have ended; one of more hints than may wait is a rescan."""
        rows: list[tuple] = []
        for number, (begin, end, _) in enumerate(ended, requests + 1):
            own = pending[begin:end]
            found = _coalesced(own) if len(own) <= self.buffer else [("", RESCAN, "unknown", "overflow", min(h[1] for h in own))]
            rows += [(number, *r) for r in found]
            if len(rows) >= ROWS or end == ended[-1][1]:
                yield self._rows(key, rows)
                rows = []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pending, requests, until = self._held()
        late = []
        for frame in rows:
            for h in frame[["at", "sequence", "path", "operations", "kind", "reason"]].itertuples(index=False, name=None):
                (late if h[0] < until else pending).append((int(h[0]), int(h[1]), h[2], int(h[3]), h[4], h[5]))
        pending.sort()
        if len(pending) > self.buffer and (ended := self._ended(pending, pending[-1][0] - self.settle)):
            yield from self._given(key, pending, ended, requests)
            pending, requests, until = pending[ended[-1][1] :], requests + len(ended), ended[-1][2]
        if len(pending) > self.buffer:
            # the hints are given up; two marks keep the request's times
            lost = min(h[1] for h in pending)
            pending = [(at, lost, "", RESCAN, "unknown", "overflow") for at in sorted({pending[0][0], pending[-1][0]})]
        self._keep(pending, requests, until)
        if late:
            # the request that would have held them is gone
            yield self._rows(key, [(0, "", RESCAN, "unknown", "late", min(h[1] for h in late))])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        settled = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000 + self.behind
        pending, requests, until = self._held()
        if ended := self._ended(pending, settled):
            yield from self._given(key, pending, ended, requests)
            pending, requests, until = pending[ended[-1][1] :], requests + len(ended), ended[-1][2]
        self._keep(pending, requests, until)


def stream_requests(hints: DataFrame, quiet: float = 0.25, most: float = 2.0, settle: float = 0.0, late: float = 60.0, buffer: int = BUFFER) -> DataFrame:
    """(root, request, path, operations, kind, reason, sequence): the requests that coalesced_paths gives in batch, as they end.

    hints: a stream of root, ts, sequence, path, operations, kind, reason. A request ends when no
    hint has come for `quiet` seconds, `most` seconds after its first at the latest. Hints may come
    `settle` seconds out of order. One that comes later, for a request that was given out, or more
    than `buffer` that wait or are one request's, makes a rescan (path '', reason `late` and request
    0, or `overflow`), so that nothing is lost in silence; hints of one batch whose requests have
    ended by its newest don't wait. Only what is over `late` seconds behind the newest hint doesn't
    arrive here at all, which Spark counts. Needs the RocksDB state store.
    """
    if late < settle:
        raise ValueError("late is settle at least")
    spark = hints.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = hints.schema["root"].dataType.simpleString()
    timed = meaningful(hints).withColumn("at", F.unix_micros("ts")).withWatermark("ts", f"{round(late * 1000)} milliseconds")
    fields = timed.select("root", "ts", "at", F.col("sequence").cast("long").alias("sequence"), F.coalesce("path", F.lit("")).alias("path"), F.col("operations").cast("int").alias("operations"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("reason", F.lit("")).alias("reason"))
    return fields.groupBy("root").transformWithStateInPandas(Debounce(quiet, most, settle, late, buffer), REQUEST.format(kind), "Append", "EventTime")
