"""Sessions over all calls of a stream, without a key, by two stateful processors with event-time timers.

A session ends where no call of any kind comes for longer than the gap, so every call matters for it. Calls are dealt by slice of time and share: each (slice, share) keeps its islands, that is runs of calls with no greater gap, at most slice / gap of them whatever the number of calls. When the watermark reaches a slice's end its islands go on to the second processor, which alone sees the whole order: some islands a slice and share. It merges them and gives out a session once no slice that is still open can hold a call within the gap.

Rows later than the watermark allows are dropped by Spark, all others count wherever they arrive. A row without a command_hash is a heartbeat: it belongs to no session and only moves the watermark on, so that a stream that ends can close its last session. State lives in RocksDB stores; a restart from the checkpoint goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyloom.operators.sessions import GAP

#: Settings of the state's stores: of a kind that keeps timers, with changes written instead of whole snapshots, and few old batches kept.
STORES = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
}
ISLANDS = "first array<bigint>, last array<bigint>, calls array<bigint>, adopted array<bigint>"
FIELDS = ("first", "last", "calls", "adopted")
SHARES = 8


def merged(islands: list[tuple[int, int, int, int]], gap: int) -> list[tuple[int, int, int, int]]:
    """Islands (first, last, calls, adopted) with those joined whose distance is at most gap, in order."""
    out: list[tuple[int, int, int, int]] = []
    for first, last, calls, adopted in sorted(islands):
        if out and first - out[-1][1] <= gap:
            a = out[-1]
            out[-1] = (a[0], max(a[1], last), a[2] + calls, a[3] + adopted)
        else:
            out.append((first, last, calls, adopted))
    return out


class _Islands(StatefulProcessor):
    """What the two processors share: islands in one value of state."""

    def __init__(self, gap: int, width: int):
        self.gap, self.width = gap, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("islands", ISLANDS)

    def held(self) -> list[tuple[int, int, int, int]]:
        return list(zip(*self.state.get(), strict=True)) if self.state.exists() else []

    def keep(self, islands: list[tuple[int, int, int, int]]) -> None:
        if islands:
            self.state.update(tuple([int(v) for v in column] for column in zip(*islands, strict=True)))
        else:
            self.state.clear()

    def close(self) -> None:
        pass


class SliceIslands(_Islands):
    """Islands of one (slice, share); they leave when the watermark reaches the slice's end."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.held()
        known = bool(found)
        for batch in rows:
            calls = batch[batch.real]
            by_second = calls.groupby("timestamp").passthrough.agg(["size", lambda p: int((p == 0).sum())])
            found = merged(found + [(int(t), int(t), int(n), int(a)) for t, n, a in by_second.itertuples()], self.gap)
        self.keep(found)
        if found and not known:
            self.handle.registerTimer((int(key[0]) + 1) * self.width * 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = pd.DataFrame(self.held(), columns=FIELDS)
        out["everything"] = 0
        # rows of a closed slice belong to the time that closed it
        out["at"] = pd.Timestamp(timerValues.getCurrentWatermarkInMs() + 1, unit="ms")
        self.state.clear()
        yield out


class Stitcher(_Islands):
    """All islands of closed slices that may still grow; sessions leave when no open slice can reach them."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.held()
        for batch in rows:
            found = merged(found + [tuple(r) for r in batch[list(FIELDS)].itertuples(index=False)], self.gap)
        yield from self.settled(found, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.settled(self.held(), timerValues)

    def settled(self, islands: list[tuple[int, int, int, int]], timerValues) -> Iterator[pd.DataFrame]:
        opened = timerValues.getCurrentWatermarkInMs() // 1000 // self.width * self.width
        done = [i for i in islands if i[1] + self.gap < opened]
        left = [i for i in islands if i[1] + self.gap >= opened]
        self.keep(left)
        for _, last, *_ in left:
            self.handle.registerTimer(((int(last) + self.gap) // self.width + 1) * self.width * 1000)
        if done:
            yield pd.DataFrame(done, columns=FIELDS).astype("int64")


def session_spans(calls: DataFrame, gap: int = GAP, late: str = "1 hour", width: int | None = None, shares: int = SHARES) -> DataFrame:
    """first, last, calls and adopted of each closed session of a stream of calls, as operators.sessions.spans has them."""
    spark = calls.sparkSession
    for name, value in STORES.items():
        spark.conf.set(name, value)
    width = width or max(3600, 2 * gap)
    at = F.timestamp_seconds("timestamp")
    rows = calls.where("timestamp is not null").select(
        at.alias("at"),
        F.floor(F.col("timestamp") / width).alias("slice"),
        F.pmod(F.xxhash64("command_hash", "timestamp", "bytes_before"), F.lit(shares)).cast("int").alias("share"),
        "timestamp",
        F.coalesce("passthrough", F.lit(1)).alias("passthrough"),
        F.col("command_hash").isNotNull().alias("real"),
    )
    islands = rows.withWatermark("at", late).groupBy("slice", "share").transformWithStateInPandas(
        statefulProcessor=SliceIslands(gap, width),
        outputStructType="first bigint, last bigint, calls bigint, adopted bigint, everything int, at timestamp",
        outputMode="Append",
        timeMode="EventTime",
        eventTimeColumnName="at",
    )
    return islands.groupBy("everything").transformWithStateInPandas(
        statefulProcessor=Stitcher(gap, width),
        outputStructType="first bigint, last bigint, calls bigint, adopted bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
