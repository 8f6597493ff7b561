"""Stateful processors: what a stream holds between micro-batches, in collections of the state store.

Each keeps its state in lists, maps and values of its own, so a batch reads and writes the entries it touches and not a
key's whole state. They run on streams and, with the same result, on batch frames. Sequence numbers order the rows of a
key and have no gaps; rows that come twice count once, rows that come early wait. ``ttl`` (milliseconds without a write)
lets go of what a key that never ends would hold; None holds it for ever.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, ttl: int | None = None, mode: str = "append") -> DataFrame:
    """Rows through a processor, by key. State collections need the RocksDB state store, which this chooses for the
    session if it has another one."""
    rows.sparkSession.streams  # noqa: B018 - starts what coordinates state stores, which a batch frame needs too
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, mode, "ProcessingTime" if ttl else "None")


class Keyed(StatefulProcessor):
    def __init__(self, ttl: int | None = None) -> None:
        self.ttl = ttl

    def close(self) -> None:
        pass


class InOrder(Keyed):
    """Takes rows (seq, ...) in order of seq. ``place`` is the next one; those after a gap wait in a map."""

    COLUMNS, TYPES = ["value"], "value string"

    def __init__(self, first: int = 0, ttl: int | None = None) -> None:
        super().__init__(ttl)
        self.first = first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "seq long", self.ttl)
        self.early = handle.getMapState("early", "seq long", self.TYPES, self.ttl)

    def due(self, rows: Iterator[pd.DataFrame]) -> tuple[int, list[tuple]]:
        """The first number and the rows whose turn it is now."""
        start = at = self.place.get()[0] if self.place.exists() else self.first
        new, out = {}, []
        for pdf in rows:
            for seq, *values in pdf[["seq", *self.COLUMNS]].astype(object).where(pdf[["seq", *self.COLUMNS]].notna(), None).itertuples(index=False):
                if seq >= at:
                    new.setdefault(int(seq), tuple(values))
        waiting = self.early.exists()
        while True:
            if waiting and self.early.containsKey((at,)):
                out.append(tuple(self.early.getValue((at,))))
                self.early.removeKey((at,))
                new.pop(at, None)
            elif at in new:
                out.append(new.pop(at))
            else:
                break
            at += 1
        for seq, values in new.items():
            if not (waiting and self.early.containsKey((seq,))):
                self.early.updateValue((seq,), values)
        if at > start:
            self.place.update((at,))
        return start, out


class WholeLines(InOrder):
    """Parts of text as whole lines (source, line, value). The pieces of a line without an end wait in a list, which a
    further part only appends to. A null part ends the source, and the last line with it."""

    SCHEMA = "source string, line long, value string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.rest = handle.getListState("rest", "piece string", self.ttl)
        self.line = handle.getValueState("line", "line long", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        _, parts = self.due(rows)
        line = start = self.line.get()[0] if self.line.exists() else 0
        out, fresh, held = [], [], None
        for (value,) in parts:
            ended = value is None
            *done, last = ["", ""] if ended else value.split("\n")
            for piece in done:
                if held is None:
                    held = [x[0] for x in self.rest.get()] if self.rest.exists() else []
                text = "".join([*held, *fresh, piece])
                if text or not ended:
                    out.append((key[0], line, text))
                    line += 1
                held, fresh = [], []
            if last:
                fresh.append(last)
        if held is not None:
            self.rest.clear()
        if fresh:
            self.rest.appendList([(x,) for x in fresh])
        if line > start:
            self.line.update((line,))
        yield pd.DataFrame(out, columns=["source", "line", "value"])


class Transcript(InOrder):
    """Events of a turn as what each batch adds to its text and its thinking (turn, seq, text, thinking); ``seq`` is the
    number of the first event that the row covers, so rows follow one another by it."""

    COLUMNS, TYPES = ["type", "payload"], "type string, payload string"
    SCHEMA = "turn string, seq long, text string, thinking string"

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        start, events = self.due(rows)
        new = {kind: "".join(p or "" for t, p in events if t == kind) for kind in ("text", "thinking")}
        out = [(key[0], start, new["text"], new["thinking"])] if any(new.values()) else []
        yield pd.DataFrame(out, columns=["turn", "seq", "text", "thinking"])


class Citations(Keyed):
    """Numbers of a block's ``citation`` events, given out when its ``stop`` comes, each once and in order of seq."""

    SCHEMA = "turn string, block int, numbers array<int>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "seq long, number int", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new, out = [], []
        for seq, kind, payload in pd.concat(list(rows)).sort_values("seq", kind="stable")[["seq", "type", "payload"]].itertuples(index=False):
            if kind == "citation" and str(payload).isdigit():
                new.append((int(seq), int(payload)))
            elif kind == "stop":
                held = [tuple(x) for x in self.held.get()] if self.held.exists() else []
                numbers = list(dict.fromkeys(n for _, n in sorted([*held, *new])))
                if numbers:
                    out.append((*key, numbers))
                self.held.clear()
                new = []
        if new:
            self.held.appendList(new)
        yield pd.DataFrame(out, columns=["turn", "block", "numbers"])


class Saves(Keyed):
    """Play events (kind: reach / meet / take, value) as changes (slot, reached, met, bag): the furthest rank so far, and
    the people and things that are new. Ranks never fall and sets only grow, so events may repeat or come late."""

    SCHEMA = "slot string, reached int, met array<string>, bag array<string>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reached = handle.getValueState("reached", "rank int", self.ttl)
        self.sets = {kind: handle.getMapState(kind, "name string", "had boolean", self.ttl) for kind in ("meet", "take")}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = reached = self.reached.get()[0] if self.reached.exists() else 0
        seen: dict[str, set] = {"meet": set(), "take": set()}
        for pdf in rows:
            for kind, value in zip(pdf["kind"], pdf["value"], strict=True):
                if kind == "reach":
                    reached = max(reached, int(value))
                elif kind in seen and value is not None:
                    seen[kind].add(value)
        new = {kind: sorted(v for v in values if not self.sets[kind].containsKey((v,))) for kind, values in seen.items()}
        for kind, values in new.items():
            for v in values:
                self.sets[kind].updateValue((v,), (True,))
        if reached > before:
            self.reached.update((reached,))
        out = [(key[0], reached, new["meet"], new["take"])] if reached > before or any(new.values()) else []
        yield pd.DataFrame(out, columns=["slot", "reached", "met", "bag"])
