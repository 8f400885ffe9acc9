"""Keyed state of the live path: what a call takes over from its session and its agent, whatever arrives first.

Two keyed operators in a row. ``Merged`` (by tool_use_id) keeps the narrow columns of a call that decide where it belongs, merged
from both lanes as ``merge_lanes`` merges them; when they change, it tells the call's session and its agent, and tells
an earlier session or agent that the call has gone. ``Carried`` (by session or agent) keeps the marks (modes seen, changes
told, relocations, agent types) and the calls, and emits each answer that has changed. An answer is computed from all marks, so
late and repeated rows end in the batch operators' result.

Needs the RocksDB state store (``ROCKSDB``). State is kept for good, or for ``ttl_ms`` after a key's last change.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Columns of a call that its answers depend on: the last known value holds.
NARROW = ("session_id", "agent_id", "called_at", "permission_mode", "agent_name")
#: What both operators read and what the first writes. ``what`` is call, gone, or a mark's kind.
MESSAGE = "scope string, key string, what string, id long, tool_use_id string, at long, value string"
ANSWER = "field string, key string, value string"
SESSION, AGENT = "session", "agent"


def _message(scope: str, key: Column, what: str, value: Column, at: Column | None = None) -> list[Column]:
    none = F.lit(None)
    return [
        F.lit(scope).alias("scope"), key.alias("key"), F.lit(what).alias("what"), F.col("id"), none.cast("string").alias("tool_use_id"),
        (none if at is None else at).cast("long").alias("at"), value.alias("value"),
    ]


def seen_modes(rows: DataFrame) -> DataFrame:
    """rows(id, session_id, mode, ts) of records that show a mode."""
    return rows.filter("session_id IS NOT NULL AND mode IS NOT NULL").select(*_message(SESSION, F.col("session_id"), "seen", F.col("mode"), F.col("ts")))


def told_changes(rows: DataFrame) -> DataFrame:
    """rows(id, session_id, to_mode, ts) of changes that telemetry tells."""
    return rows.filter("session_id IS NOT NULL AND to_mode IS NOT NULL").select(*_message(SESSION, F.col("session_id"), "told", F.col("to_mode"), F.col("ts")))


def relocations(rows: DataFrame) -> DataFrame:
    """rows(id, session_id, relocated_cwd)."""
    return rows.filter("session_id IS NOT NULL AND relocated_cwd IS NOT NULL").select(*_message(SESSION, F.col("session_id"), "moved", F.col("relocated_cwd")))


def agent_types(rows: DataFrame) -> DataFrame:
    """rows(id, agent_id, agent_type)."""
    return rows.filter("agent_id IS NOT NULL AND agent_type IS NOT NULL").select(*_message(AGENT, F.col("agent_id"), "type", F.col("agent_type")))


class _Keyed(StatefulProcessor):
    """One JSON text for each part of a key's state."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl = None if ttl_ms is None else timedelta(milliseconds=ttl_ms)

    def _map(self, handle: StatefulProcessorHandle, name: str):
        args = () if self.ttl is None else (self.ttl,)
        return handle.getMapState(name, "part string", "body string", *(int(a.total_seconds() * 1000) for a in args))

    def close(self) -> None:
        pass


class Merged(_Keyed):
    """facts(id, tool_use_id, NARROW) of either lane -> messages to the call's session and agent."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = self._map(handle, "known")

    def _read(self) -> dict:
        return {k[0]: json.loads(v[0]) for k, v in self.known.iterator()}

    def _take(self, rows: Iterator[Row]) -> tuple[dict, dict]:
        before = self._read()
        now = dict(before)
        for r in rows:
            now["row_seq"] = min(now.get("row_seq", r["id"]), r["id"])
            for c in NARROW:
                if r[c] is not None and r["id"] >= now.get(c, [r["id"]])[0]:
                    now[c] = [r["id"], r[c]]
        for part, value in now.items():
            if before.get(part) != value:
                self.known.updateValue((part,), (json.dumps(value),))
        return before, now

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._take([initialState])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before, now = self._take(rows)
        if before == now:
            return
        value = lambda state, c: state[c][1] if c in state else None
        for scope, place, own in ((SESSION, "session_id", "permission_mode"), (AGENT, "agent_id", "agent_name")):
            old, new = value(before, place), value(now, place)
            if old is not None and old != new:
                yield Row(scope=scope, key=old, what="gone", id=now["row_seq"], tool_use_id=key[0], at=None, value=None)
            if new is not None:
                yield Row(scope=scope, key=new, what="call", id=now["row_seq"], tool_use_id=key[0], at=value(now, "called_at"), value=value(now, own))


def _modes(marks: list[tuple]) -> tuple[list[tuple], str | None]:
    """(changes in order of time, the first change's mode): a seen mode is a change where it differs from the one seen before."""
    changes, last = [], None
    for kind, id_, at, value in sorted(marks, key=lambda m: (m[1], m[0])):
        if kind == "told" or (kind == "seen" and value != last):
            changes.append((id_, at, value))
        if kind == "seen":
            last = value
    first = min(changes, default=(None, None, None))[2]
    return sorted((at, id_, value) for id_, at, value in changes if at is not None), first


class Carried(_Keyed):
    """Messages -> (field, key, value): permission_mode and agent_name by call, cwd by session, where they have changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks, self.calls, self.told = (self._map(handle, n) for n in ("marks", "calls", "told"))

    def _take(self, rows: Iterator[Row]) -> None:
        for r in rows:
            if r["what"] == "gone":
                self.calls.removeKey((r["tool_use_id"],))
                self.told.removeKey((r["tool_use_id"],))
            elif r["what"] == "call":
                self.calls.updateValue((r["tool_use_id"],), (json.dumps([r["id"], r["at"], r["value"]]),))
            else:
                mark = [r["what"], r["id"], r["at"], r["value"]]
                self.marks.updateValue((json.dumps(mark),), (json.dumps(mark),))

    def _answers(self, scope: str, key: str) -> Iterator[tuple[str, str, str | None]]:
        marks = [tuple(json.loads(v[0])) for _, v in self.marks.iterator()]
        calls = {k[0]: json.loads(v[0]) for k, v in self.calls.iterator()}
        if scope == AGENT:
            type_ = max(((m[1], m[3]) for m in marks), default=(None, None))[1]
            peer = min(((seq, own) for seq, _, own in calls.values() if own is not None), default=(None, None))[1]
            for call, (_, _, own) in calls.items():
                yield "agent_name", call, type_ or own or peer
            return
        changes, first = _modes(marks)
        moved = max(((m[1], m[3]) for m in marks if m[0] == "moved"), default=None)
        if moved:
            yield "cwd", key, moved[1]
        times = [when for when, _, _ in changes]
        for call, (_, at, own) in calls.items():
            n = 0 if at is None else bisect_right(times, at)
            yield "permission_mode", call, own or (changes[n - 1][2] if n else first)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._take([initialState])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._take(rows)
        said = {k[0]: json.loads(v[0]) for k, v in self.told.iterator()}
        for field, of, value in self._answers(*key):
            part = of if field != "cwd" else "\n"
            if part not in said or said[part] != value:
                self.told.updateValue((part,), (json.dumps(value),))
                yield Row(field=field, key=of, value=value)


def carried(facts: DataFrame, marks: DataFrame, ttl_ms: int | None = None, known_facts: DataFrame | None = None, known_marks: DataFrame | None = None) -> DataFrame:
    """Streams of call facts (id, tool_use_id, NARROW) and of marks -> a stream of answers (field, key, value). The last one
    of a field and key holds; ``known_facts`` and ``known_marks`` are what batch jobs have read before."""
    mode = "none" if ttl_ms is None else "processingTime"
    narrow = lambda df: df.select("id", "tool_use_id", *NARROW).groupBy("tool_use_id")
    told = narrow(facts).transformWithState(Merged(ttl_ms), MESSAGE, "append", mode, None if known_facts is None else narrow(known_facts))
    by = lambda df: df.groupBy("scope", "key")
    return by(told.unionByName(marks)).transformWithState(Carried(ttl_ms), ANSWER, "append", mode, None if known_marks is None else by(known_marks))
