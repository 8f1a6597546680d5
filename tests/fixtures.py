"""Small invented logs of each source, as text, for tests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.base import Logs, split_lines
from ledgerloom.sources.registry import by_id

A, B = "claude-sonnet-4-5-20250929", "claude-haiku-4-5-20251001"


def _usage(i: int, o: int, w: int | None = None, r: int | None = None, split: tuple | None = None) -> dict:
    u = {"input_tokens": i, "output_tokens": o, "cache_creation_input_tokens": w, "cache_read_input_tokens": r}
    if split:
        u["cache_creation"] = {"ephemeral_5m_input_tokens": split[0], "ephemeral_1h_input_tokens": split[1]}
    return {k: v for k, v in u.items() if v is not None}


def _said(ts: str, rid: str | None, model: str, content: list | str, usage: dict | None) -> dict:
    message = {"model": model, "content": content} | ({"usage": usage} if usage else {})
    return {"type": "assistant", "timestamp": f"2026-{ts}Z", "isSidechain": False, "message": message} | ({"requestId": rid} if rid else {})


def _user(ts: str, content: list | str, **more: object) -> dict:
    return {"type": "user", "timestamp": f"2026-{ts}Z", "message": {"content": content}} | more


def _text(s: str) -> list:
    return [{"type": "text", "text": s}]


def _tool(i: str, name: str, **inputs: object) -> list:
    return [{"type": "tool_use", "id": i, "name": name, "input": inputs}]


def _result(ts: str, i: str, content: str) -> dict:
    return _user(ts, [{"type": "tool_result", "tool_use_id": i, "content": content}])


def _lines(rows: list) -> str:
    return "\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False, separators=(",", ":")) for r in rows) + "\n"


def _deferred(ts: str, kind: str, **payload: object) -> dict:
    return {"type": "attachment", "timestamp": f"2026-{ts}Z", "attachment": {"type": kind} | payload}


_U1 = {"w": 200, "r": 4000, "split": (200, 0)}
SPEND = {
    "/x/projects/oven/main-7a01.jsonl": _lines([
        {"type": "summary", "summary": "invented"},
        _user("03-11T07:30:00", "Implement retries for the oven's client."),
        _said("03-11T07:30:09", "r1", A, [*_text("The client comes first."), *_tool("t1", "Grep", pattern="send")], _usage(700, 30, **_U1)),
        _said("03-11T07:30:11", "r1", A, _tool("t2", "Read", file_path="/oven/client.py"), _usage(700, 90, **_U1)),
        _result("03-11T07:30:12", "t1", "client.py: def send"),
        _said("03-11T07:41:00", "r2", A, _tool("t3", "Task", description="Measure the waits", subagent_type="timer"), _usage(800, 110, 0, 4500, (0, 0))),
        _result("03-11T07:44:00", "t3", "two seconds each"), "",
        _said("03-11T07:45:00", "r3", A, [{"type": "thinking", "thinking": "so " * 30}, *_text("Backing off then.")], _usage(650, 45)),
        {"type": "mode", "mode": "normal"}, '{"type":"user","message":[', {"type": "nobody-knows"},
        _said("03-11T07:46:00", "r4", A, _tool("t4", "mcp__ledger__lookup", key="waits"), _usage(500, 25, 100, 4600, (0, 100))),
        {"type": "system", "subtype": "compact_boundary", "content": "compacted", "timestamp": "2026-03-11T07:50:00Z"},
    ]),
    "/x/projects/oven/main-7a01/subagents/agent-9.jsonl": _lines([
        _user("03-11T07:41:03", "Measure how long each call waits."), _said("03-11T07:43:30", "m1", A, _text("Two seconds each."), _usage(300, 210, 0, 0, (0, 0))),
    ]),
    "/x/projects/menu/side-3c02.jsonl": _lines([
        _user("03-12T18:00:00", "Write the menu."), _said("03-12T18:00:04", "b1", B, _text("Soup first."), _usage(250, 70)),
        _said("03-12T18:07:00", "b2", B, _tool("t9", "Bash", command="date"), _usage(350, 120, 150, 0, (0, 150))),
    ]),
}
CONTEXT = {
    "/x/projects/shop/stock-0005.jsonl": _lines([
        _deferred("04-02T12:00:00", "skill_listing", skillCount=4, content="four skills"),
        _deferred("04-02T12:00:00", "deferred_tools_delta", addedNames=[f"later{i}" for i in range(9)], addedLines=["later"] * 9),
        _deferred("04-02T12:00:00", "mcp_instructions_delta", addedBlocks=[{"server": "tickets"}]),
        _user("04-02T12:00:01", "Take the open orders off the stock."),
        _said("04-02T12:00:02", "c1", A, _tool("k1", "mcp__tickets__list", queue="all"), _usage(30, 50, 15000, 0, (15000, 0))), _result("04-02T12:00:03", "k1", "i" * 80),
        _said("04-02T12:00:04", "c2", A, _tool("k2", "Read", file_path="stock.sql"), _usage(400, 100, 300, 15000, (300, 0))), _result("04-02T12:00:05", "k2", "s" * 210),
        _said("04-02T12:00:06", "c3", A, _tool("k3", "mcp__stock-db__load", rows=[3, 4, 5]), _usage(250, 150, 50, 15300, (50, 0))), _result("04-02T12:00:07", "k3", "d" * 410),
        _user("04-02T12:00:08", "what was said before", isCompactSummary=True),
        _said("04-02T12:00:09", "c4", A, [{"type": "thinking", "thinking": "t" * 220}, *_text("Taken off.")], _usage(200, 700, 150, 15600, (150, 0))),
    ]),
}
ANOMALY = {
    "/x/projects/loop/again-0008.jsonl": _lines([
        *[_said(f"02-20T16:00:{s:02d}", f"s{i}", A, _text("once more"), _usage(80, 40, 0, 7000)) for i, s in enumerate((0, 4, 9, 13, 20, 33))],
        _said("02-20T16:05:00", "twice", A, _text("a"), _usage(150, 20, 0, 900)), _said("02-20T16:05:01", "twice", A, _text("b"), _usage(150, 60, 0, 900)),
        _said("02-20T17:00:00", "large", A, _text("all of it"), _usage(4000, 250, 150000, 0, (150000, 0))),
        _said("02-20T18:00:00", "f1", A, _text("f"), _usage(40, 10, 0, 0)), _said("02-20T19:00:00", "f2", A, _text("f"), _usage(60, 30, 0, 0)),
    ]),
}
KINDS = {
    "/x/projects/k/mend-0001.jsonl": _lines([
        _user("05-03T08:00:00", "The crash is a regression, debug it"),
        _said("05-03T08:00:01", "d0", A, [*_tool("a", "Read", p=1), *_tool("b", "Bash", c=1), *_tool("c", "Edit", e=1)], _usage(900, 150, 0, 0)),
        _said("05-03T08:01:00", "d1", A, _text("a"), _usage(700, 80, 0, 0)), _said("05-03T08:01:01", "d1", A, _text("b"), _usage(700, 210, 0, 0)),
    ]),
    "/x/projects/k/grow-0002.jsonl": _lines([
        _user("05-03T09:00:00", "Build an endpoint and support both formats"),
        _said("05-03T09:00:01", "f0", A, [*_tool("a", "Write", p=1), *_tool("b", "Edit", c=1)], _usage(1500, 400, 0, 0)), _said("05-03T09:01:00", "f1", A, _text("ok"), _usage(1300, 350, 0, 0)),
    ]),
    "/x/projects/k/read-0003.jsonl": _lines([
        _user("05-03T10:00:00", "Analyze the queue, I want to understand it"),
        _said("05-03T10:00:01", "e0", A, [*_tool("a", "Grep", p=1), *_tool("b", "Glob", c=1)], _usage(600, 90, 0, 0)), _said("05-03T10:01:00", "e1", A, _text("ok"), _usage(750, 40, 0, 0)),
    ]),
    "/x/projects/k/read-0003/subagents/agent-2.jsonl": _lines([_said("05-03T10:00:30", "e2", A, _text("sub"), _usage(420, 30, 0, 0))]),
    "/x/projects/k/none-0004.jsonl": _lines([_user("05-02T10:00:00", "ok, go on"), _said("05-02T10:00:01", "p0", A, _text("ok"), _usage(120, 35, 0, 0))]),
}


def _codex(ts: str, kind: str, **payload: object) -> dict:
    return {"timestamp": f"2026-{ts}Z", "type": kind, "payload": payload}


def _spent(ts: str, i: int, c: int, o: int, r: int) -> dict:
    last = {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": r, "total_tokens": i + o}
    return _codex(ts, "event_msg", type="token_count", info={"last_token_usage": last, "total_token_usage": {"input_tokens": 10**6}})


CODEX = {
    "/x/sessions/2026/04/20/rollout-main.jsonl": _lines([
        _codex("04-20T13:00:00", "session_meta", id="1", cwd="/home/ann/oven"), _codex("04-20T13:00:01", "turn_context", model="gpt-5.5"),
        _spent("04-20T13:00:06", 900, 0, 150, 40), _codex("04-20T13:00:07", "response_item", type="message", role="user", content=[{"type": "input_text", "text": "Weigh it."}]),
        _codex("04-20T13:00:08", "response_item", type="function_call", name="shell", call_id="c1", arguments='{"cmd":"wc"}'), _spent("04-20T13:00:09", 1500, 300, 250, 70),
        _codex("04-20T13:00:10", "event_msg", type="context_compacted"), _codex("04-20T13:00:11", "response_item", type="function_call", name="mcp__stock-db__ask", call_id="c2", arguments="{}"),
        _codex("04-20T13:00:12", "event_msg", type="mcp_tool_call_end", call_id="c2", invocation={"server": "stock-db", "tool": "ask"}),
        {"timestamp": "x", "type": "unheard-of", "payload": {}}, _codex("04-20T13:00:13", "event_msg", type="token_count", info=None), _spent("04-20T13:00:14", 2200, 800, 400, 0),
    ]),
    "/x/archived_sessions/rollout-old.jsonl": _lines([_codex("04-19T09:00:01", "turn_context", model="gpt-5.5-codex"), _spent("04-19T09:00:05", 600, 150, 90, 0)]),
}
GEMINI = {
    "/x/tmp/kitchen/chats/session-1.jsonl": _lines([
        {"sessionId": "s", "projectHash": "p", "startTime": "2026-04-21T10:00:00Z", "kind": "main"}, {"$set": {"a": 1}}, "not json",
        {"id": "u1", "timestamp": "2026-04-21T10:00:01Z", "type": "user", "content": [{"text": "how full is the store"}]},
        {"id": "g1", "timestamp": "2026-04-21T10:00:02Z", "type": "gemini", "content": "", "model": "gemini-3", "tokens": {"input": 800, "cached": 100, "output": 40, "thoughts": 60}},
        {"id": "g1", "timestamp": "2026-04-21T10:00:02Z", "type": "gemini", "content": "Counting.", "model": "gemini-3", "tokens": {"input": 800, "cached": 100, "output": 40, "thoughts": 60},
         "thoughts": [{"subject": "Count", "description": "each shelf"}], "toolCalls": [{"id": "tc1", "name": "mcp__stock-db__count", "args": {"s": 12}}]},
        {"id": "u2", "timestamp": "2026-04-21T10:00:03Z", "type": "user", "content": [{"functionResponse": {"id": "tc1", "name": "q", "response": {"output": "half full"}}}]},
        {"type": "novel"}, {"id": "g2", "timestamp": "2026-04-21T10:00:04Z", "type": "gemini", "content": "Half full.", "model": "gemini-3", "tokens": {"input": 950, "cached": 900, "output": 25, "thoughts": 0}},
        {"type": "info", "content": "x"},
    ]),
}
COPILOT = {
    "/x/session-state/2222/events.jsonl": _lines([
        {"type": "session.start", "timestamp": "2026-04-22T09:00:00Z", "data": {"selectedModel": "gpt-5", "context": {"cwd": "/home/ann/pantry/"}}}, "{",
        {"type": "user.message", "timestamp": "2026-04-22T09:00:05Z", "data": {"content": "What is left?"}}, {"type": "assistant.turn_start", "data": {}}, {"type": "brand.new"},
        {"type": "assistant.message", "timestamp": "2026-04-22T09:00:07Z",
         "data": {"content": "I look.", "reasoningText": "shelves", "toolRequests": [{"toolCallId": "c1", "name": "bash", "arguments": {"command": "du"}}]}},
        {"type": "tool.execution_complete", "timestamp": "2026-04-22T09:00:09Z", "data": {"toolCallId": "c1", "toolName": "bash", "result": {"content": "flour"}}},
        {"type": "assistant.message", "timestamp": "2026-04-22T09:00:25Z", "data": {"content": "Flour."}},
    ]),
}


def logs(spark: SparkSession, agent: str, files: dict[str, str]) -> Logs:
    """What a source reads from files given as text."""
    return by_id(agent).from_lines(lines(spark, files))


def lines(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    rows = [(p, p, len(t.encode()), 1_780_000_000 + i, t) for i, (p, t) in enumerate(files.items())]
    df = spark.createDataFrame(rows, "file_id string, path string, size_bytes bigint, m long, value string")
    return split_lines(df.select("file_id", "path", "size_bytes", F.timestamp_seconds("m").alias("modified"), "value"))
