"""Keyed state in streams: what a key's earlier events decide, kept by Spark's state store between micro-batches.

Each processor sorts the events that a batch brings for a key (few: what arrived since the last batch) and keeps one small
value for the key. Timers in event time end what waits for silence, whether more events of the key come or not; they fire
when the watermark has passed. State is written with each batch's commit, so a repeated batch gives the same rows.

Events of a key must reach the stream in order, batch by batch; within a batch any order will do. Events that are later than
the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_MICRO = 1_000_000


class Debounce(StatefulProcessor):
    """Events gathered to runs with gaps of at most `gap` seconds; a run is given out when `gap` seconds have passed in silence."""

    def __init__(self, gap: int, wait: int, most: int):
        self.gap, self.wait, self.most = gap * _MICRO, wait * _MICRO, most * _MICRO

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "number long, items long, first long, last long")

    def _given(self, key: tuple, number: int, items: int, first: int, last: int) -> Row:
        due = min(last + self.wait, max(first + self.most, last))
        return Row(key=key[0], run=number, items=items, due=due)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.run.get() if self.run.exists() else None
        number, items, first, last = state or (0, 0, 0, 0)
        before = last if items else None
        for at in sorted(r["at"] for r in rows):
            if not items or at // _MICRO - last // _MICRO > self.gap // _MICRO:
                if items:
                    yield self._given(key, number, items, first, last)
                number, items, first = number + 1, 0, at
            items, last = items + 1, max(at, last)
        if before is not None:
            self.handle.deleteTimer(self._end(before))
        self.handle.registerTimer(self._end(last))
        self.run.update((number, items, first, last))

    def _end(self, last: int) -> int:
        """The first millisecond at which an event would begin a new run."""
        return (last // _MICRO + self.gap // _MICRO + 1) * 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.run.exists():
            number, items, first, last = self.run.get()
            if items and self._end(last) <= expiredTimerInfo.getExpiryTimeInMs():
                self.run.update((number, 0, 0, 0))  # the number goes on
                yield self._given(key, number, items, first, last)

    def close(self) -> None:
        pass


class Fence(StatefulProcessor):
    """accepted: whether a write's generation is at least that of every write of its key before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.highest = handle.getValueState("highest", "generation long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        highest = self.highest.get()[0] if self.highest.exists() else None
        before = highest
        for r in sorted(rows, key=lambda r: (r["at"], r["id"])):
            generation = r["generation"]
            yield Row(key=key[0], id=r["id"], accepted=highest is None or (generation is not None and generation >= highest))
            if generation is not None:
                highest = generation if highest is None else max(highest, generation)
        if highest != before:
            self.highest.update((highest,))

    def close(self) -> None:
        pass


class Moves(StatefulProcessor):
    """Moves between a key's successive states that the table doesn't allow."""

    def __init__(self, allowed: dict[str, tuple[str, ...]]):
        self.allowed = allowed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "state string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        previous = self.last.get()[0] if self.last.exists() else None
        for r in sorted(rows, key=lambda r: (r["at"], r["id"])):
            state = r["state"]
            if previous is not None and state is not None and state != previous and state not in self.allowed.get(previous, ()):
                yield Row(key=key[0], id=r["id"], previous=previous, state=state)
            previous = state
        if previous is None:
            self.last.clear()
        else:
            self.last.update((previous,))

    def close(self) -> None:
        pass


class Expiry(StatefulProcessor):
    """Keys whose time has passed and that no later row has put off or pinned."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = max(rows, key=lambda r: (r["at"], r["id"]))
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
            self.until.clear()
        if last["until"] is not None and not last["pinned"]:
            end = last["until"] // 1000 + 1
            if end <= timerValues.getCurrentWatermarkInMs():
                yield Row(key=key[0], until=last["until"])
            else:
                self.until.update((end,))
                self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.until.exists():
            self.until.clear()
            yield Row(key=key[0], until=(expiredTimerInfo.getExpiryTimeInMs() - 1) * 1000)

    def close(self) -> None:
        pass


def _micros(at: str):
    return F.unix_micros(F.col(at).cast("timestamp"))


def _keyed(events: DataFrame, key: str, columns: dict, processor: StatefulProcessor, made: str, at: str | None = None, late: str = "0 seconds") -> DataFrame:
    """The processor over events by key; with `at`, timers run on its watermark."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select(F.col(key).alias("key"), *[c.alias(name) for name, c in columns.items()], *([F.col(at).cast("timestamp").alias("time")] if at else []))
    if at:
        rows = rows.withWatermark("time", late)
    return rows.groupBy("key").transformWithState(
        statefulProcessor=processor, outputStructType=made, outputMode="append", timeMode="eventTime" if at else "none")


def debounced(events: DataFrame, key: str, at: str, gap: int, wait: int, most: int, late: str = "0 seconds") -> DataFrame:
    """key, run, items, due of the stream's runs, as `operators.incremental.debounced` gives them for a table."""
    kind = events.schema[key].dataType.simpleString()
    runs = _keyed(events.where(F.col(at).isNotNull()), key, {"at": _micros(at)}, Debounce(gap, wait, most), f"key {kind}, run long, items long, due long", at, late)
    return runs.select(F.col("key").alias(key), "run", "items", F.timestamp_micros("due").alias("due"))


def fenced(events: DataFrame, key: str, at: str, id_: str, generation: str) -> DataFrame:
    """key, id_, accepted of every write of the stream, as `operators.reports.fenced` gives it for a table."""
    kinds = [events.schema[c].dataType.simpleString() for c in (key, id_)]
    columns = {"at": _micros(at), "id": F.col(id_), "generation": F.col(generation).cast("long")}
    return _keyed(events, key, columns, Fence(), f"key {kinds[0]}, id {kinds[1]}, accepted boolean").select(F.col("key").alias(key), F.col("id").alias(id_), "accepted")


def illegal_moves(events: DataFrame, key: str, at: str, id_: str, state: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """key, id_, previous, state of the stream's moves that aren't allowed, as `events.illegal_moves` gives them for a table."""
    kinds = [events.schema[c].dataType.simpleString() for c in (key, id_)]
    out = _keyed(events, key, {"at": _micros(at), "id": F.col(id_), "state": F.col(state)}, Moves(allowed), f"key {kinds[0]}, id {kinds[1]}, previous string, state string")
    return out.select(F.col("key").alias(key), F.col("id").alias(id_), "previous", F.col("state").alias(state))


def expiring(rows: DataFrame, key: str, at: str, id_: str, until: str, pinned: str, late: str = "0 seconds") -> DataFrame:
    """key, until of keys whose last row's time passes unpinned, when the watermark has gone by."""
    kind = rows.schema[key].dataType.simpleString()
    columns = {"at": _micros(at), "id": F.col(id_), "until": _micros(until), "pinned": F.coalesce(F.col(pinned), F.lit(False))}
    out = _keyed(rows, key, columns, Expiry(), f"key {kind}, until long", at, late)
    return out.select(F.col("key").alias(key), F.timestamp_micros("until").alias(until))


def closing(events: DataFrame, at: str, path: str, after: str = "9999-01-01") -> DataFrame:
    """The stream with one row of no key at the end of time, read from `path`: replays end with it, so that all timers fire."""
    spark = events.sparkSession
    last = spark.range(1).select(*[(F.lit(after) if c == at else F.lit(None)).cast(events.schema[c].dataType).alias(c) for c in events.columns])
    last.write.mode("overwrite").parquet(path)
    return events.unionByName(spark.readStream.schema(T.StructType([events.schema[c] for c in events.columns])).parquet(path))
