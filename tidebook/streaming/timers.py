"""Event-time timers: order expiry, unlock maturity and dead-man deadlines, each armed by a key and fired once.

``arms`` has ``(kind, account, id, ts, due)``: at ``ts`` (milliseconds) the timer of ``(kind, account, id)`` is set to ``due``, in place of what it was
set to before; 0 takes it back. A timer fires when time reaches it: at a row of its key at that time or later, before the row counts, or at the watermark. Rows of one key and time are
taken in order of ``due``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEYS = ["kind", "account", "id"]
FIRED = "kind string, account long, id long, due long"
SPAN_BITS = 6  # timers are kept together by kind and 2^6 consecutive sums of account and id
NONE = -(2**63)


class Timers(StatefulProcessor):
    """Keeps the armed times of a group of keys, and one timer for the first of them, which is registered with the state store, so it survives restarts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.armed = handle.getValueState("armed", "account array<long>, id array<long>, due array<long>, first long")

    def _read(self) -> tuple[dict[tuple[int, int], int], int]:
        if not self.armed.exists():
            return {}, 0
        accounts, ids, dues, first = self.armed.get()
        return dict(zip(zip(accounts, ids), dues)), first

    def _write(self, armed: dict[tuple[int, int], int], old: int) -> None:
        first = min(armed.values(), default=0)
        if old and old != first:
            self.handle.deleteTimer(old)
        if first and old != first:
            self.handle.registerTimer(first)
        if armed:
            self.armed.update(([a for a, _ in armed], [i for _, i in armed], list(armed.values()), first))
        else:
            self.armed.clear()

    @staticmethod
    def _fired(kind: str, fired: list[tuple[int, int, int]]) -> Iterator[pd.DataFrame]:
        if fired:
            yield pd.DataFrame({"kind": kind, **{c: [r[k] for r in fired] for k, c in enumerate(("account", "id", "due"))}})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        armed, old = self._read()
        fired = []
        for ts, then, *own in sorted(r for part in rows for r in zip(*(part[c].tolist() for c in ("ts", "due", "account", "id")))):
            due = armed.pop(own := tuple(own), 0)
            if due and due <= ts:
                fired.append((*own, due))
            if then:
                armed[own] = then
        self._write(armed, old)
        yield from self._fired(key[0], fired)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        armed, old = self._read()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        fired = [(*own, due) for own, due in armed.items() if due <= now]
        # the timer that expired is gone from the store already
        self._write({own: due for own, due in armed.items() if due > now}, 0 if old == expiredTimerInfo.getExpiryTimeInMs() else old)
        yield from self._fired(key[0], fired)

    def close(self) -> None:
        pass


def timer_fires(arms: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """The stream of fired timers ``(kind, account, id, due)``; rows later than ``delay`` behind the newest are dropped. Needs the RocksDB state store.

    A call into Python costs about as much for 64 timers as for one, so keys go to the state store in groups.
    """
    timed = arms.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", delay)
    own = {c: F.coalesce(F.col(c), F.lit(NONE)) for c in ("account", "id")}  # pandas would make doubles of integers with nulls among them
    grouped = timed.withColumns(own).withColumn("span", F.shiftright(F.try_add(F.col("account"), F.col("id")), SPAN_BITS)).groupBy("kind", "span")
    fired = grouped.transformWithStateInPandas(Timers(), FIRED, "append", "eventTime")
    return fired.withColumns({c: F.nullif(F.col(c), F.lit(NONE)) for c in own})


def fired_by(arms: DataFrame, now: int) -> DataFrame:
    """The same of a table, with time at ``now``: a timer fires if its key's next row, or else ``now``, is not before it."""
    after = F.coalesce(F.lead("ts").over(W.partitionBy(*KEYS).orderBy("ts", "due")), F.lit(now))
    return arms.withColumn("after", after).where((F.col("due") != 0) & (F.col("due") <= F.col("after"))).select(*KEYS, "due")
