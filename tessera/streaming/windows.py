"""Streaming counterparts of batch queries, and a minute's counters with the wait they imply for a limited caller.

The counters are the one stateful operator here; the other windows are Spark-native extras.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_MS = 60_000


@dataclass
class Limiter:
    """Requests and tokens of the last 60 seconds; what is older by more than that is let go."""

    requests: int
    tokens: int
    seen: list[tuple[int, int]] = field(default_factory=list)

    def evict(self, now: int) -> None:
        self.seen = [(t, n) for t, n in self.seen if not now - t > WINDOW_MS]

    def totals(self, now: int) -> tuple[int, int]:
        self.evict(now)
        return len(self.seen), sum(n for _, n in self.seen)

    def wait(self, now: int, tokens: int) -> int:
        """Milliseconds until a request of so many tokens fits: until the oldest request ends, or enough tokens have; a tenth of a second is added."""
        requests, used = self.totals(now)
        waits = [0]
        if requests >= self.requests and self.seen:
            waits.append(WINDOW_MS - (now - self.seen[0][0]) + 100)
        if used + tokens > self.tokens:
            freed = 0
            for t, n in self.seen:
                freed += n
                if used - freed + tokens <= self.tokens:
                    waits.append(WINDOW_MS - (now - t) + 100)
                    break
            else:
                waits.append(WINDOW_MS + 100 if self.seen else 0)
        return max(waits)

    def add(self, now: int, tokens: int) -> None:
        self.evict(now)
        self.seen.append((now, tokens))


def minute_counts(events: DataFrame, key: str = "user_id", at: str = "ts", amount: str = "value", late: str = "10 minutes") -> DataFrame:
    """(key, ts, recent, total) for each event of a stream: how many events of its key, and how much, came in the minute up to it, its very start included.

    State is the last minute of each key. Events of one key are taken in the order of their times within a micro-batch; one that comes
    in a later one still counts those before it, unless it is more than ``late`` behind. Keys are forgotten once the watermark is past their last minute.
    A null amount adds nothing.
    """
    schema = events.select(key).schema[0].dataType.simpleString()

    def update(k: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old_at, old = (np.array(x) for x in state.get) if state.exists else (np.zeros(0, np.int64), np.zeros(0))
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        new_at, new = rows["at"].to_numpy(np.int64), rows["amount"].fillna(0.0).to_numpy()
        first, width = np.arange(1, len(rows) + 1), WINDOW_MS * 1000
        # What is inside the minute of each event: of the state by its time, of this batch what comes no later in order.
        a, b = np.searchsorted(old_at, new_at - width), np.searchsorted(old_at, new_at, side="right")
        c = np.searchsorted(new_at, new_at - width)
        old_sum, new_sum = (np.concatenate([[0.0], np.cumsum(x)]) for x in (old, new))
        out = pd.DataFrame({key: k[0], "at": new_at, "recent": b - a + first - c, "total": old_sum[b] - old_sum[a] + new_sum[first] - new_sum[c]})
        times, amounts = np.concatenate([old_at, new_at]), np.concatenate([old, new])
        last = int(times.max())
        order = np.argsort(times, kind="stable")
        order = order[times[order] >= last - width]
        state.update((times[order].tolist(), amounts[order].tolist()))
        state.setTimeoutTimestamp(max(last // 1000 + WINDOW_MS, state.getCurrentWatermarkMs() + 1))
        yield out

    rows = events.select(key, F.col(at).cast("timestamp").alias("ts"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(amount).cast("double").alias("amount")).withWatermark("ts", late)
    made = rows.groupBy(key).applyInPandasWithState(update, f"{key} {schema}, at long, recent long, total double", "times array<long>, amounts array<double>", "append", GroupStateTimeout.EventTimeTimeout)
    return made.select(key, F.timestamp_micros("at").alias("ts"), "recent", "total")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of each window; ``late`` is how long a window waits."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return at.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, n) of runs of events without a gap."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return at.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
