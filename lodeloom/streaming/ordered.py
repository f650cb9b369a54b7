"""State machines over events in order of their time: one step function, folded over a table or kept as the state of a stream.

A step takes (state, event) and returns (state, what it says): nothing, one text, or a list of (fix_id, text). In a table a
key's events are sorted and go by one at a time; a task holds one state and one batch of rows, however many events a key has.
In a stream events wait in a list state until the watermark has passed them, are then taken in order of (at_s, fix_id), and
a timer wakes the key. So a stream says what the fold over all rows that weren't late says, in whatever order they come.
When a key has been silent for `keep` seconds its state begins anew, in tables and in streams; a timer clears it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

State = dict[str, Any]
Said = str | list[tuple[int, str]] | None
Step = Callable[[State, State], tuple[State, Said]]
OUT = "uid long, fix_id long, said string"


@dataclass(frozen=True)
class Machine:
    """A step, the columns its keys and events have, and what its state holds.

    kept has the fields of the value state; lists and maps have the fields of list states, and the keys and values of map
    states. A step sees them all as entries of one dict, lists as lists of tuples.
    """

    step: Step
    reads: str
    kept: str = ""
    lists: dict[str, str] = field(default_factory=dict)
    maps: dict[str, tuple[str, str]] = field(default_factory=dict)
    keys: tuple[str, ...] = ("uid",)
    keep: int = 86_400

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys([*self.keys, "uid", "fix_id", "at_s", *self.reads.split()]))

    def take(self, state: State, last: int | None, event: State) -> tuple[State, list[tuple[int, int, str]]]:
        """The state after an event, and rows of OUT."""
        if last is not None and event["at_s"] - last >= self.keep:
            state = {}
        state, said = self.step(state, event)
        said = [(event["fix_id"], said)] if isinstance(said, str) else said or []
        return state, [(event["uid"], fix_id, text) for fix_id, text in said]


def fold(machine: Machine, events: DataFrame) -> DataFrame:
    """What the machine says over each key's events in order of (at_s, fix_id). Events without a time are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, last = None, {}, None
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                own = tuple(e[k] for k in machine.keys)
                if own != key:
                    key, state, last = own, {}, None
                state, said = machine.take(state, last, e)
                last = e["at_s"]
                out += said
            columns = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["uid", "fix_id", "said"])

    timed = events.where(F.col("at_s").isNotNull()).select(*machine.columns)
    return timed.repartition(*machine.keys).sortWithinPartitions(*machine.keys, "at_s", "fix_id").mapInArrow(run, OUT)


class Ordered(StatefulProcessor):
    """A machine over a stream: waiting events, the state, and one timer a key, for the earliest event or the state's end."""

    def __init__(self, machine: Machine, event_fields: str):
        self.machine, self.event_fields = machine, event_fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, m = handle, self.machine
        self.waiting = handle.getListState("waiting", self.event_fields)
        # last: time of the last event taken; wake: the timer that is set, in milliseconds
        self.clock = handle.getValueState("clock", "last long, wake long")
        self.kept = handle.getValueState("kept", m.kept) if m.kept else None
        self.lists = {n: handle.getListState(n, f) for n, f in m.lists.items()}
        self.maps = {n: handle.getMapState(n, *fs) for n, fs in m.maps.items()}

    def load(self) -> State:
        names = [f.split()[0] for f in self.machine.kept.split(", ")] if self.kept else []
        state = dict(zip(names, self.kept.get(), strict=True)) if self.kept and self.kept.exists() else {}
        state = {k: v for k, v in state.items() if v is not None}
        state |= {n: [tuple(x) for x in s.get()] for n, s in self.lists.items() if s.exists()}
        return state | {n: {k[0]: v[0] for k, v in s.iterator()} for n, s in self.maps.items() if s.exists()}

    def clear(self) -> None:
        for s in (*([self.kept] if self.kept else []), *self.lists.values(), *self.maps.values()):
            s.clear()

    def save(self, state: State) -> None:
        self.clear()
        if self.kept and any(f.split()[0] in state for f in self.machine.kept.split(", ")):
            self.kept.update(tuple(state.get(f.split()[0]) for f in self.machine.kept.split(", ")))
        for n, s in self.lists.items():
            if state.get(n):
                s.put(state[n])
        for n, s in self.maps.items():
            for k, v in state.get(n, {}).items():
                s.updateValue((k,), (v,))

    def set_clock(self, last: int | None, wake: int | None) -> None:
        """One timer at a time."""
        now = self.clock.get() if self.clock.exists() else (None, None)
        if now[1] != wake:
            if now[1] is not None:
                self.handle.deleteTimer(now[1])
            if wake is not None:
                self.handle.registerTimer(wake)
        if last is None and wake is None:
            self.clock.clear()
        else:
            self.clock.update((last, wake))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        new = [tuple(r[f.split()[0]] for f in self.event_fields.split(", ")) for r in rows]
        self.waiting.appendList(new)
        at = [f.split()[0] for f in self.event_fields.split(", ")].index("at_s")
        last, wake = self.clock.get() if self.clock.exists() else (None, None)
        earliest = min(n[at] for n in new) * 1000
        self.set_clock(last, earliest if wake is None else min(wake, earliest))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        names, passed = [f.split()[0] for f in self.event_fields.split(", ")], timerValues.getCurrentWatermarkInMs()
        events = [dict(zip(names, w, strict=True)) for w in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((e for e in events if e["at_s"] * 1000 <= passed), key=lambda e: (e["at_s"], e["fix_id"]))
        last = self.clock.get()[0] if self.clock.exists() else None
        out: list[Row] = []
        if ready:
            state = self.load()
            for e in ready:
                state, said = self.machine.take(state, last, e)
                last = e["at_s"]
                out += [Row(uid=u, fix_id=f, said=s) for u, f, s in said]
            self.save(state)
            later = [tuple(e[n] for n in names) for e in events if e["at_s"] * 1000 > passed]
            self.waiting.clear()
            if later:
                self.waiting.put(later)
            events = [dict(zip(names, w, strict=True)) for w in later]
        end = None if last is None else (last + self.machine.keep) * 1000
        if end is not None and end <= passed:
            self.clear()
            last = end = None
        # the timer that woke this key is gone
        self.clock.update((last, None))
        ends = [e["at_s"] * 1000 for e in events] + ([end] if end is not None else [])
        self.set_clock(last, min(ends) if ends else None)
        return iter(out)

    def close(self) -> None:
        pass


def stream(machine: Machine, events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """What the machine says over a stream of events that come at most delay late; later ones are dropped."""
    types = dict(events.select(*machine.columns).dtypes)
    fields = ", ".join(f"{c} {types[c]}" for c in machine.columns)
    timed = events.where(F.col("at_s").isNotNull()).select(*machine.columns, F.timestamp_seconds("at_s").alias("ts")).withWatermark("ts", delay)
    return timed.groupBy(*machine.keys).transformWithState(statefulProcessor=Ordered(machine, fields), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
