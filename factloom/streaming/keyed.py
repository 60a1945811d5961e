"""Memory operations and workflow events as keyed streams over a state store with maps, timers and expiry.

`fold_memories` keeps a user's memories in a map and applies operations in order, over any number of micro-batches and
restarts; each row that it gives is what a memory is after its last operation of a micro-batch. `number_events` gives every
event of a task the next number and keeps the last ones in a map, so a reader that comes late gets them back. A key that
was idle for `idle_seconds` leaves the store: a timer is set at each arrival and deletes everything behind the key.
Both need the RocksDB store: `use_state_store` sets it for the session, and turns off micro-batches without data, which would
never end under an `availableNow` trigger as long as a timer is set. Timers then fire with the next micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
MEMORY = "user_id long, memory_type string, key string, value string, confidence double, pos long, active boolean"
EVENT = "task_id long, seq long, event_id long, replayed boolean"


def use_state_store(spark: SparkSession) -> SparkSession:
    for name, value in STORE.items():
        spark.conf.set(name, value)
    return spark


class _Idle(StatefulProcessor):
    """A processor whose keys leave the store when nothing came for `idle_seconds` (None: never)."""

    def __init__(self, idle_seconds: float | None) -> None:
        self.idle = idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def touched(self, timers: object) -> None:
        """Only the timer of the last arrival is left."""
        if self.idle is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(1000 * self.idle))

    def forget(self) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.forget()
        return iter([])

    def close(self) -> None:
        pass


class MemoryFold(_Idle):
    """ADD overwrites, also with an empty value; UPDATE keeps the value when its own is empty; DELETE deactivates; NOOP does nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.memories = handle.getMapState("memories", "memory_type string, key string", "value string, confidence double, pos long")

    def forget(self) -> None:
        self.memories.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        changed: dict[tuple, tuple] = {}
        for r in pd.concat(list(rows)).sort_values("pos", kind="stable").itertuples(index=False):
            at, confidence = (r.memory_type, r.key), None if pd.isna(r.confidence) else float(r.confidence)
            value = None if pd.isna(r.value) else r.value
            held = self.memories.getValue(at) if self.memories.containsKey(at) else None
            if r.op in ("ADD", "UPDATE"):
                new = value or ("" if r.op == "ADD" or held is None else held[0])
                self.memories.updateValue(at, (new, confidence, int(r.pos)))
                changed[at] = (new, confidence, int(r.pos), True)
            elif r.op == "DELETE" and held is not None:
                self.memories.removeKey(at)
                changed[at] = (held[0], held[1] if confidence is None else confidence, int(r.pos), False)
        self.touched(timerValues)
        out = [(key[0], *at, *now) for at, now in changed.items()]
        yield pd.DataFrame(out, columns=["user_id", "memory_type", "key", "value", "confidence", "pos", "active"]).astype({"user_id": "int64", "pos": "int64", "active": "bool", "confidence": "float64"})


class EventNumbers(_Idle):
    """The next number for each event; a row of type `resume` gives back the last `keep` events instead."""

    def __init__(self, idle_seconds: float | None, keep: int) -> None:
        super().__init__(idle_seconds)
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "seq long")
        self.ring = handle.getMapState("ring", "place long", "seq long, event_id long")

    def forget(self) -> None:
        self.last.clear()
        self.ring.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq = self.last.get()[0] if self.last.exists() else 0
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable").itertuples(index=False):
            if r.event_type == "resume":
                out += sorted((key[0], *self.ring.getValue((p,)), True) for p in range(self.keep) if self.ring.containsKey((p,)))
                continue
            seq += 1
            self.ring.updateValue((seq % self.keep,), (seq, int(r.event_id)))
            out.append((key[0], seq, int(r.event_id), False))
        if seq:
            self.last.update((seq,))
        self.touched(timerValues)
        yield pd.DataFrame(out, columns=["task_id", "seq", "event_id", "replayed"]).astype({"task_id": "int64", "seq": "int64", "event_id": "int64", "replayed": "bool"})


def fold_memories(operations: DataFrame, idle_seconds: float | None = None) -> DataFrame:
    """(user_id, memory_type, key, value, confidence, pos, active) for each memory that a micro-batch changes.

    Operations (user_id, memory_type, key, op, value, confidence, pos) of one micro-batch apply in the order of `pos`, and micro-batches as
    they come. Memories are meant to last: an idle user should leave the store only where the rows given are kept as a table.
    """
    return operations.groupBy("user_id").transformWithStateInPandas(MemoryFold(idle_seconds), MEMORY, "update", "processingTime")


def number_events(events: DataFrame, idle_seconds: float | None = None, keep: int = 64) -> DataFrame:
    """(task_id, seq, event_id, replayed): events (task_id, ts, event_id, event_type) with their number in their task, from 1 on."""
    return events.groupBy("task_id").transformWithStateInPandas(EventNumbers(idle_seconds, keep), EVENT, "update", "processingTime")


def current_memories(changes: DataFrame) -> DataFrame:
    """Active memories from all rows that `fold_memories` gave: the last of each, a grouped maximum."""
    rest = ["value", "confidence", "pos", "active"]
    from pyspark.sql import functions as F

    last = changes.groupBy("user_id", "memory_type", "key").agg(F.max_by(F.struct(*rest), "pos").alias("x"))
    return last.select("user_id", "memory_type", "key", "x.*").where("active").drop("active")
