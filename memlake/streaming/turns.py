"""Turns from a stream of transcript lines, in both dialects: a file's open turn is state until its end comes.

A stateful processor keeps for each file what its last lines left open. With `idle_seconds`, timers tell when a file has rested: closed
turns that no batch of `window` turns took yet are then announced by a row of status `flush`, as a full batch is at once. With
`ttl_ms`, the state of a file unseen for so long is dropped.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memlake.operators.state import Store, insert_or_ignore, with_ids
from memlake.sources.transcripts import ABORTS, COMPLETES, STARTS
from memlake.streaming.source import TranscriptLines

TURN = "path string, session_id string, ordinal long, turn_id string, status string, byte_start long, byte_end long, observed_at string, cwd string, display_text string, pending long"
_COLUMNS = [c.split()[0] for c in TURN.split(", ")]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _said(kind: str | None, event: str | None, p: dict) -> str | None:
    if kind == "event_msg" and event in ("user_message", "agent_message"):
        text = str(p.get("message") or "").strip()
    elif kind == "response_item" and event == "message":
        parts = [str(x.get("text") or x.get("message") or "").strip() for x in p.get("content") or [] if isinstance(x, dict)]
        text = "\n".join(x for x in parts if x)
    elif event == "function_call":
        text = f"tool call: {p.get('name')}"
    elif event == "function_call_output":
        text = f"tool output: {str(p.get('output') or '')[:500]}"
    else:
        return None
    return text or None


class Assembly:
    """Feeds lines of one file of the markers dialect in order; gives closed turns. All it knows is in `state`, which is JSON."""

    def __init__(self, state: dict | None = None):
        self.state = state or {"session": None, "next": 0, "open": None}

    def feed(self, path: str, begin: int, end: int, line: str) -> tuple | None:
        try:
            v = json.loads(line)
        except ValueError:
            return None
        p = v.get("payload") if isinstance(v.get("payload"), dict) else {}
        kind, event, s = v.get("type"), p.get("type"), self.state
        if kind == "session_meta":
            s["session"] = s["session"] or p.get("id") or "unknown-codex-session"
            return None
        starts = kind == "event_msg" and event in STARTS
        if starts or (kind == "turn_context" and s["open"] is None):
            s["open"] = {"turn_id": p.get("turn_id"), "begin": begin, "at": None, "cwd": None, "said": []}
        o = s["open"]
        if o is None:
            return None
        o["end"], o["at"] = end, v.get("timestamp") or v.get("created_at") or o["at"]
        o["cwd"], o["turn_id"] = p.get("cwd") or o["cwd"], o["turn_id"] or p.get("turn_id")
        if text := _said(kind, event, p):
            o["said"].append(text)
        if kind == "event_msg" and event in COMPLETES + ABORTS and s["session"]:
            turn = (path, s["session"], s["next"], o["turn_id"], "completed" if event in COMPLETES else "aborted", o["begin"], end, o["at"], o["cwd"], "\n".join(o["said"]) or None, None)
            s["next"], s["open"] = s["next"] + 1, None
            return turn
        return None


def _texts(content) -> list[str]:
    """Texts and tool marks of a message's content, a string or a list of items."""
    if not isinstance(content, list):
        return [] if content is None else [content if isinstance(content, str) else json.dumps(content, separators=(",", ":"))]
    plain = lambda x: x if isinstance(x, str) else json.dumps(x, separators=(",", ":"))
    out = []
    for x in content:
        if x.get("text") is not None:
            out.append(plain(x["text"]))
        elif x.get("name") is not None:
            out.append(f"tool: {plain(x['name'])}")
        elif x.get("content") is not None:
            out.append(f"tool output: {plain(x['content'])}")
    return out


class RoleAssembly:
    """The same for the roles dialect: a user message that is no tool result opens a turn; an answer with text and no tool use closes it."""

    def __init__(self, state: dict | None = None):
        self.state = state or {"next": 0, "open": None}

    def feed(self, path: str, begin: int, end: int, line: str) -> tuple | None:
        try:
            v = json.loads(line)
        except ValueError:
            return None
        message = v.get("message") if isinstance(v.get("message"), dict) else {}
        role, content, s = v.get("role") or message.get("role"), v["content"] if v.get("content") is not None else message.get("content"), self.state
        if role not in ("user", "assistant"):
            return None
        items = content if isinstance(content, list) else []
        kinds = {x.get("type") for x in items if isinstance(x, dict)}
        if s["open"] is None or role == "user" and "tool_result" not in kinds:
            s["open"] = {"begin": begin, "at": None, "cwd": None, "said": []}
        o = s["open"]
        o["at"], o["cwd"] = v.get("timestamp") or v.get("created_at") or o["at"], v.get("cwd") or o["cwd"]
        o["said"] += _texts([x for x in items if isinstance(x, dict)] if isinstance(content, list) else content)
        has_text = any(isinstance(x, dict) and x.get("text") is not None for x in items) if isinstance(content, list) else content is not None
        if role == "assistant" and has_text and "tool_use" not in kinds:
            stem = os.path.basename(path)
            turn = (path, stem.rpartition(".")[0] or stem, s["next"], None, "completed", o["begin"], end, o["at"], o["cwd"], "\n".join(o["said"]) if o["said"] else None, None)
            s["next"], s["open"] = s["next"] + 1, None
            return turn
        return None


ASSEMBLIES = {"markers": Assembly, "roles": RoleAssembly}


class TurnProcessor(StatefulProcessor):
    """Closed turns of each file, and rows of status `flush` (ordinal of the first turn, pending their number)."""

    def __init__(self, dialect: str, idle_seconds: int | None, window: int, ttl_ms: int | None):
        self.dialect, self.idle, self.window, self.ttl = dialect, idle_seconds, window, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("assembly", "state string", self.ttl)

    def _flush(self, path: str, state: dict) -> tuple | None:
        n, state["pending"] = state.get("pending", 0), 0
        return (path, state.get("session"), state["next"] - n, None, "flush", None, None, None, None, None, n) if n else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        a = ASSEMBLIES[self.dialect](json.loads(self.kept.get()[0]) if self.kept.exists() else None)
        lines, out = pd.concat(list(rows)).sort_values("line_start"), []
        for row in lines.itertuples(index=False):
            if row.line_start < a.state.get("done", 0):
                continue  # seen before
            a.state["done"] = row.line_end
            if turn := a.feed(row.path, row.line_start, row.line_end, row.line):
                out.append(turn)
                a.state["pending"] = a.state.get("pending", 0) + 1
                if self.idle is not None and a.state["pending"] >= self.window:
                    out.append(self._flush(key[0], a.state))
        self.kept.update((json.dumps(a.state),))
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if a.state.get("pending"):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.idle)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.kept.exists():
            state = json.loads(self.kept.get()[0])
            if row := self._flush(key[0], state):
                out.append(row)
                self.kept.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def turn_stream(lines: DataFrame, dialect: str = "markers", idle_seconds: int | None = None, window: int = 10, ttl_ms: int | None = None) -> DataFrame:
    """Closed turns of a stream of lines (path, line_start, line_end, line), as TURN. Lines that come again are passed over."""
    spark = lines.sparkSession
    if spark.conf.get(_PROVIDER).endswith("HDFSBackedStateStoreProvider"):  # the default, which keeps no timers
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = "ProcessingTime" if idle_seconds is not None or ttl_ms is not None else "None"
    return lines.groupBy("path").transformWithStateInPandas(TurnProcessor(dialect, idle_seconds, window, ttl_ms), TURN, "Append", timed)


def stream_lines(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(TranscriptLines)
    return spark.readStream.format("transcript_lines").options(**options).load(root)


def store_turns(store: Store):
    """A foreachBatch function: inserts turns that are not there yet, so a repeated batch changes nothing."""

    def run(batch: DataFrame, _: int) -> None:
        old = store.read("turns")
        new = batch.where("status <> 'flush'").drop("path", "pending").withColumn("id", F.lit(None).cast("long"))
        fresh = with_ids(insert_or_ignore(old, new, ["session_id", "ordinal"], ["byte_start"]).drop("id"), old, ["session_id", "ordinal"])
        store.write("turns", old.unionByName(fresh, allowMissingColumns=True))

    return run
