"""Logs written from the test tables, and in SQL the events that they must come to.

Each user of ``events`` is a session; what kind of line an event becomes follows from its type and its
number. The logs go through the sources as text, so that the reports over them run on all of the engine,
while the SQL beside them reads the tables alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerloom.sources.base import Logs, split_lines
from ledgerloom.sources.registry import SOURCES

#: Columns of the events that SQL and the engine are compared by.
EVENTS = (
    "file", "line_no", "sub_seq", "kind", "ts", "request_id", "model", "billed", "input", "output", "cache_creation", "cache_creation_5m", "cache_creation_1h",
    "cache_read", "thinking", "tools", "sidechain", "summary", "chars", "thinking_chars", "has_thinking", "tool_use_id", "attachment_kind", "item_count",
)


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with e (number), u (user), t (type), v and k (numbers), ln (line), nth (purchases so far), ref (the last call)."""
    order = W.partitionBy("u").orderBy("ts", "e")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    buys = F.col("t") == "purchase"
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("e"), F.col("user_id").alias("u"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("t"),
        F.floor("value").cast("long").alias("v"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    return rows.withColumns({
        "ln": F.row_number().over(order) - 1, "nth": F.count_if(buys).over(upto),
        "ref": F.last(F.when(buys & (F.col("e") % 5 < 2), F.col("e")), ignorenulls=True).over(upto),
    })


NUMBERED = """b AS (
  SELECT event_id AS e, user_id AS u, ts::TIMESTAMP AS ts, event_type AS t, floor(value)::BIGINT AS v, (props::JSON->>'k')::BIGINT AS k,
         row_number() OVER w - 1 AS ln, count(*) FILTER (event_type = 'purchase') OVER w AS nth,
         last_value(CASE WHEN event_type = 'purchase' AND event_id % 5 < 2 THEN event_id END IGNORE NULLS) OVER w AS ref
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
)"""


def files_of(lines: DataFrame, path: str, newline: str = "CASE WHEN u % 2 = 0 THEN '\\n' ELSE '\\r\\n' END") -> DataFrame:
    """Whole files from lines (columns u, ln, line). Files of odd users end their lines like Windows does."""
    whole = lines.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("ls"))
    text = F.expr(f"concat(array_join(transform(ls, x -> x.line), {newline}), {newline})")
    return whole.select(
        F.expr(path).alias("file_id"), F.expr(path).alias("path"), F.octet_length(text).cast("long").alias("size_bytes"),
        F.expr("timestamp'2024-03-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(u % 10 AS int), 0, 0)").alias("modified"), text.alias("value"),
    )


def logs(spark: SparkSession, sf_dir: str, source: str) -> Logs:
    """The logs of one source, read as its files would be."""
    path, line = LINES[source]
    lines = numbered(spark, sf_dir).withColumn("stamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return SOURCES[source].from_lines(split_lines(files_of(lines.select("u", "ln", F.expr(line).alias("line")), path)))


def events_of(read: Logs) -> DataFrame:
    """The events with plain columns; ``file`` is the session's name, times are microseconds."""
    usage = [F.col(f"usage.{c}").alias(c) for c in EVENTS[8:15]]
    met = read.events.join(read.files.select("file_id", F.col("session_id").alias("file")), "file_id")
    return met.select(
        "file", F.col("line_no").cast("long").alias("line_no"), F.col("sub_seq").cast("long").alias("sub_seq"), "kind", F.unix_micros("ts").alias("ts"), "request_id", "model", F.col("usage").isNotNull().alias("billed"), *usage,
        F.array_join(F.transform("tool_calls", lambda c: F.concat_ws("/", c["id"], c["name"], c["input_bytes"].cast("string"), c["server"])), ",").alias("tools"),
        "sidechain", F.col("content_summary").alias("summary"), F.col("content_chars").alias("chars"), "thinking_chars", "has_thinking", "tool_use_id",
        "attachment_kind", "item_count",
    )


def json_text(**fields: str) -> str:
    """SQL that strings an object together: values are SQL texts; NULL leaves the field out."""
    parts = ", ".join(f"""'"{k}":' || ({v})""" for k, v in fields.items())
    return "concat('{', concat_ws(',', " + parts + "), '}')"


def text(x: str) -> str:
    """SQL of a JSON string."""
    return f"""concat('"', {x}, '"')"""


def chosen(*cases: tuple[str, str], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {x}" for c, x in cases) + f" ELSE {otherwise} END"


def event_sql(**fields: str) -> str:
    """The columns of ``EVENTS`` in SQL; what isn't said has the default."""
    default = {"sub_seq": "0", "ts": "epoch_us(CASE WHEN e % 13 <> 0 THEN ts END)", "billed": "false", "tools": "''", "sidechain": "false", "chars": "0", "thinking_chars": "0", "has_thinking": "false", "item_count": "0"}
    kinds = {c: "BIGINT" for c in (*EVENTS[8:15], "line_no", "sub_seq", "ts", "chars", "thinking_chars", "item_count")} | {c: "BOOLEAN" for c in ("billed", "sidechain", "has_thinking")}
    fields = {"file": "file", "line_no": "ln"} | fields
    return ", ".join(f"({fields.get(c, default.get(c, 'NULL'))})::{kinds.get(c, 'VARCHAR')} AS {c}" for c in EVENTS)


# -- the first source: all kinds of lines, sub-agents, repeated requests -----------------------------------------------

STAMP = "CASE WHEN e % 13 <> 0 THEN concat('\"', stamp, '\"') END"
MODEL = "CASE WHEN e % 23 = 0 THEN '<synthetic>' WHEN e % 4 = 0 THEN 'claude-sonnet-4-5-20250929' WHEN e % 4 = 1 THEN 'claude-opus-4-1' WHEN e % 4 = 2 THEN 'anthropic/claude-haiku-4-5' ELSE 'other-model' END"
REQUEST = "CASE WHEN e % 6 <> 5 THEN concat('r', u, '-', nth - nth % 3) END"
TOOL = "CASE WHEN e % 5 = 1 THEN 'Task' WHEN e % 20 = 0 THEN 'mcp__git__find' WHEN e % 20 = 5 THEN 'Edit' WHEN e % 20 = 10 THEN 'Bash' WHEN k % 2 = 0 THEN 'Write' ELSE 'Read' END"
TOOL_INPUT = """CASE e % 5 WHEN 0 THEN concat('{"n":', k, '}') ELSE concat('{"subagent_type":"x', k, '","description":"d', v, '"}') END"""
PROMPT = "CASE e % 4 WHEN 0 THEN concat('fix the bug ', k) WHEN 1 THEN concat('Add a feature ', k) WHEN 2 THEN concat('explain this ', k) ELSE concat('go on ', k) END"
RESULT = """concat('[{"type":"tool_result","tool_use_id":"t', coalesce(ref, 0), '","content":"out ', k, 'é"}]')"""


def _first_lines() -> tuple[str, str]:
    flags = {"timestamp": STAMP, "isSidechain": "CASE WHEN e % 7 = 0 THEN 'true' END"}
    usage = json_text(
        input_tokens="CASE WHEN e % 9 <> 0 THEN CAST(k * 10 AS string) END", output_tokens="CAST(v AS string)",
        cache_creation_input_tokens="CASE WHEN e % 2 = 0 THEN CAST(k AS string) END", cache_read_input_tokens="CAST(2 * v AS string)",
        cache_creation="CASE WHEN e % 4 = 0 THEN " + json_text(ephemeral_5m_input_tokens="CAST(k - k DIV 2 AS string)", ephemeral_1h_input_tokens="CAST(k DIV 2 AS string)") + " END",
    )
    blocks = "concat('[', concat_ws(',', " + ", ".join((
        json_text(type=text("'text'"), text=text("concat('buy ', k, ' of it')")),
        "CASE WHEN e % 3 = 0 THEN " + json_text(type=text("'thinking'"), thinking=text("concat('hm ', v)")) + " WHEN e % 3 = 1 THEN " + json_text(type=text("'redacted_thinking'")) + " END",
        "CASE WHEN e % 5 < 2 THEN " + json_text(type=text("'tool_use'"), id=text("concat('t', e)"), name=text(TOOL), input=TOOL_INPUT) + " END",
    )) + "), ']')"
    said = json_text(type=text("'assistant'"), requestId=f"CASE WHEN e % 6 <> 5 THEN {text(REQUEST)} END", message=json_text(model=text(MODEL), usage=usage, content=blocks), **flags)
    asked = json_text(type=text("'user'"), message=json_text(content=text(f"concat({PROMPT}, '\\\\n', 'and é more')")), isCompactSummary="CASE WHEN e % 11 = 0 THEN 'true' END", **flags)
    result = json_text(type=text("'user'"), message=json_text(content=RESULT), **flags)
    looked = json_text(type=text("'user'"), message=json_text(content="concat('[', " + json_text(type=text("'text'"), text=text("concat('look at ', k)")) + ", ']')"), **flags)
    system = json_text(type=text("'system'"), subtype="CASE WHEN e % 3 = 0 THEN '\"compact_boundary\"' END", content=text("concat('note ', k)"), **flags)
    attachment = chosen(
        ("e % 2 = 0", json_text(type=text("'deferred_tools_delta'"), addedNames="concat('[\"a\"', repeat(',\"b\"', CAST(k % 3 AS int)), ']')")),
        ("e % 9 = 5", json_text(type=text("'skill_listing'"), skillCount="CAST(k AS string)")),
        otherwise=json_text(type=text("'mcp_instructions_delta'"), content=text("concat('read me ', k)"), addedLines="'[\"x\",\"yé\"]'"),
    )
    attached = json_text(type=text("'attachment'"), attachment=attachment, **flags)
    odd = chosen(
        ("e % 5 = 0", "'{\"type\":'"), ("e % 5 = 1", "'{\"type\":\"surprise\"}'"), ("e % 5 = 2", "'{\"type\":\"summary\"}'"), ("e % 5 = 3", "' \\t '"),
        otherwise="'{\"type\":\"user\",\"requestId\":5}'",
    )
    line = chosen(("t = 'purchase'", said), ("t = 'view'", asked), ("t = 'click' AND e % 8 = 0", looked), ("t = 'click'", result), ("t = 'signup' AND e % 3 <> 2", system), ("t = 'signup'", attached), otherwise=odd)
    path = "CASE WHEN u % 5 = 0 THEN concat('/logs/projects/p', (u + 1) % 4, '/s', u + 1, '/subagents/agent-', u, '.jsonl') ELSE concat('/logs/projects/p', u % 4, '/s', u, '.jsonl') END"
    return path, line


def _first_events() -> str:
    side = "e % 7 = 0"
    b = "l"
    tools = f"CASE WHEN e % 5 < 2 THEN concat_ws('/', 't' || e, {TOOL}, tool_bytes, CASE WHEN e % 20 = 0 THEN 'git' END) ELSE '' END"
    said = event_sql(
        kind="'Assistant'", request_id=REQUEST, model=MODEL, billed="e % 23 <> 0", sidechain=side, tools=tools, summary="'buy ' || k || ' of it'",
        input="CASE WHEN e % 23 <> 0 AND e % 9 <> 0 THEN k * 10 END", output="CASE WHEN e % 23 <> 0 THEN v END", cache_creation="CASE WHEN e % 23 <> 0 AND e % 2 = 0 THEN k END",
        cache_creation_5m="CASE WHEN e % 23 <> 0 AND e % 4 = 0 THEN k - k // 2 END", cache_creation_1h="CASE WHEN e % 23 <> 0 AND e % 4 = 0 THEN k // 2 END",
        cache_read="CASE WHEN e % 23 <> 0 THEN 2 * v END", chars="length('buy ' || k || ' of it') + thinks + coalesce(tool_bytes, 0)", thinking_chars="thinks", has_thinking="e % 3 < 2",
    )
    prompt = f"({PROMPT})"
    return f"""l AS (
  SELECT *, CASE WHEN u % 5 = 0 THEN 'agent-' || u ELSE 's' || u END AS file, CASE WHEN e % 3 = 0 THEN length('hm ' || v) ELSE 0 END AS thinks,
         CASE WHEN e % 5 < 2 THEN strlen({TOOL_INPUT}) END AS tool_bytes
  FROM b
), ev AS (
  SELECT {said} FROM {b} WHERE t = 'purchase'
  UNION ALL SELECT {event_sql(sub_seq='1', kind="'SubAgentSpawn'", sidechain=side, summary="'d' || v")} FROM {b} WHERE t = 'purchase' AND e % 5 = 1
  UNION ALL SELECT {event_sql(kind="CASE WHEN e % 11 = 0 THEN 'Compaction' ELSE 'User' END", sidechain=side, summary=prompt, chars=f"length({prompt}) + 11")} FROM {b} WHERE t = 'view'
  UNION ALL SELECT {event_sql(kind="'User'", sidechain=side, summary="'look at ' || k", chars="length('look at ' || k)")} FROM {b} WHERE t = 'click' AND e % 8 = 0
  UNION ALL SELECT {event_sql(kind="'ToolResult'", sidechain=side, chars=f"strlen({RESULT})", tool_use_id="'t' || coalesce(ref, 0)")} FROM {b} WHERE t = 'click' AND e % 8 <> 0
  UNION ALL SELECT {event_sql(kind="CASE WHEN e % 3 = 0 THEN 'Compaction' ELSE 'System' END", sidechain=side, summary="'note ' || k", chars="length('note ' || k)")} FROM {b} WHERE t = 'signup' AND e % 3 <> 2
  UNION ALL SELECT {event_sql(
        kind="'Attachment'", sidechain=side, summary=_ATTACHED, attachment_kind=_ATTACHED, item_count="CASE WHEN e % 2 = 0 THEN k % 3 + 1 WHEN e % 9 = 5 THEN k ELSE 0 END",
        chars="CASE WHEN e % 2 = 0 OR e % 9 = 5 THEN 0 ELSE length('read me ' || k) + 3 END")} FROM {b} WHERE t = 'signup' AND e % 3 = 2
)"""


_ATTACHED = "CASE WHEN e % 2 = 0 THEN 'deferred_tools_delta' WHEN e % 9 = 5 THEN 'skill_listing' ELSE 'mcp_instructions_delta' END"

#: Files of the first source: what their paths and lines say.
_FIRST_FILES = """fl AS (
  SELECT file, any_value(u) AS u, 'p' || (CASE WHEN any_value(u) % 5 = 0 THEN any_value(u) + 1 ELSE any_value(u) END % 4) AS project,
         CASE WHEN any_value(u) % 5 = 0 THEN 's' || (any_value(u) + 1) END AS parent, CASE WHEN any_value(u) % 5 = 0 THEN 's' || (any_value(u) + 1) ELSE file END AS row_id,
         count(*) FILTER (t = 'error' AND e % 5 IN (0, 1, 4)) AS skipped, count(*) FILTER (t = 'purchase' AND e % 5 = 1) AS spawns,
         min(CASE WHEN t <> 'error' AND e % 13 <> 0 THEN ts END) AS started, max(CASE WHEN t <> 'error' AND e % 13 <> 0 THEN ts END) AS ended,
         row_number() OVER (ORDER BY any_value(u) % 10 DESC, CASE WHEN any_value(u) % 5 = 0 THEN '/logs/projects/p' || ((any_value(u) + 1) % 4) || '/s' || (any_value(u) + 1) || '/subagents/agent-' || any_value(u) || '.jsonl'
           ELSE '/logs/projects/p' || (any_value(u) % 4) || '/s' || any_value(u) || '.jsonl' END) AS disc
  FROM l GROUP BY file
), md AS (
  SELECT file, arg_max(model, {'n': n, 'm': model}) AS model FROM (SELECT file, model, count(*) AS n FROM ev WHERE kind = 'Assistant' AND model <> '<synthetic>' GROUP BY 1, 2) GROUP BY 1
), f AS (SELECT fl.*, md.model FROM fl LEFT JOIN md ON fl.file = md.file)"""

#: Requests of the first source with what they cost, from ``ev`` and ``f``; {since} narrows the events.
_REQUESTS = """pr(norm, i, o, r, w5, w1) AS (VALUES ('claude-sonnet-4-5', 3.0, 15.0, 0.3, 3.75, 6.0), ('claude-opus-4-1', 15.0, 75.0, 1.5, 18.75, 30.0), ('claude-haiku-4-5', 1.0, 5.0, 0.1, 1.25, 2.0)),
q AS (
  SELECT file, coalesce('r:' || request_id, 'l:' || line_no || ':' || sub_seq) AS req_key, any_value(request_id) AS request_id, max(input) AS input, max(output) AS output,
         max(cache_creation) AS cache_creation, max(cache_creation_5m) AS c5, max(cache_creation_1h) AS c1, max(cache_read) AS cache_read, min(ts) AS ts,
         arg_min(model, line_no) AS model, sum(thinking_chars)::BIGINT AS thinking_chars, bool_or(has_thinking) AS has_thinking, bool_or(sidechain) AS side, count(*) AS n_lines,
         min(line_no) AS first_line, sum(coalesce(input, 0) + coalesce(output, 0) + coalesce(cache_creation, 0) + coalesce(cache_read, 0))::BIGINT AS naive
  FROM ev WHERE kind = 'Assistant' AND billed AND (/*since*/ true) GROUP BY 1, 2
), rq AS (
  SELECT q.*, f.row_id, f.project, f.disc, side OR parent IS NOT NULL AS sidechain, coalesce(input, 0) + coalesce(output, 0) + coalesce(cache_creation, 0) + coalesce(cache_read, 0) AS tokens,
         coalesce(input, 0) * i AS m_in, coalesce(output, 0) * o AS m_out, coalesce(cache_read, 0) * r AS m_read,
         CASE WHEN c5 IS NULL AND c1 IS NULL THEN coalesce(cache_creation, 0) * w5 ELSE coalesce(c5, 0) * w5 + coalesce(c1, 0) * w1 END AS m_write
  FROM q JOIN f ON q.file = f.file LEFT JOIN pr ON norm = CASE q.model WHEN 'claude-sonnet-4-5-20250929' THEN 'claude-sonnet-4-5' WHEN 'anthropic/claude-haiku-4-5' THEN 'claude-haiku-4-5' ELSE q.model END
), r AS (SELECT *, m_in + m_out + m_read + m_write AS micro FROM rq)"""

# -- the second source: counters as deltas, the model carried forward ---------------------------------------------------

def _second_lines() -> tuple[str, str]:
    stamp = {"timestamp": STAMP}
    wrap = lambda kind, payload: json_text(type=text(f"'{kind}'"), payload=payload, **stamp)
    meta = wrap("session_meta", json_text(id=text("u"), cwd=text("CASE WHEN e % 3 = 0 THEN '' ELSE concat('/home/p', k) END"), model="CASE WHEN e % 2 = 0 THEN '\"start-model\"' END"))
    turn = wrap("turn_context", json_text(model=text("CASE WHEN e % 5 = 0 THEN '' ELSE concat('model-', e % 3) END")))
    blocks = "concat('[', " + json_text(type="'\"input_text\"'", text=text("concat('say ', k)")) + ", ',', " + json_text(type="'\"input_text\"'", text=text("'é'")) + ", ']')"
    message = wrap("response_item", json_text(type="'\"message\"'", role=text("CASE WHEN e % 3 = 0 THEN 'assistant' ELSE 'user' END"), content=blocks))
    call = wrap("response_item", json_text(type="'\"function_call\"'", name=text("CASE WHEN e % 8 = 0 THEN 'mcp__git__find' ELSE 'shell' END"), call_id=text("concat('c', e)"), arguments=text("concat('run é', k)")))
    counts = json_text(
        input_tokens="CASE WHEN e % 7 <> 0 THEN CAST(k * 3 AS string) END", cached_input_tokens="CASE WHEN e % 4 <> 0 THEN CAST(v AS string) END",
        output_tokens="CAST(v * 2 AS string)", reasoning_output_tokens="CASE WHEN e % 2 = 0 THEN CAST(k AS string) END",
    )
    info = chosen(("e % 9 = 0", "'null'"), ("e % 9 = 1", "'{}'"), otherwise=json_text(last_token_usage=counts))
    spent = wrap("event_msg", json_text(type="'\"token_count\"'", info=info))
    other = chosen(
        ("e % 4 = 0", wrap("event_msg", json_text(type="'\"context_compacted\"'"))),
        ("e % 4 = 1", wrap("event_msg", json_text(type="'\"mcp_tool_call_end\"'", call_id=text("concat('m', e)"), invocation=json_text(server="CASE WHEN e % 3 <> 0 THEN '\"db\"' END", tool="CASE WHEN e % 5 <> 0 THEN '\"put\"' END")))),
        ("e % 4 = 2", "'not json'"), otherwise="'{\"type\":\"surprise\",\"payload\":{}}'",
    )
    line = chosen(("t = 'signup'", meta), ("t = 'view'", turn), ("t = 'click' AND e % 4 = 0", call), ("t = 'click'", message), ("t = 'purchase'", spent), otherwise=other)
    return "concat('/logs/sessions/2024/01/01/roll-', u, '.jsonl')", line


def _second_events() -> str:
    less = lambda a, b: f"CASE WHEN {a} IS NOT NULL THEN greatest({a} - coalesce({b}, 0), 0) END"
    spent = event_sql(
        kind="'Assistant'", model="cur", billed="true", input=less("ti", "tc"), output=less("tout", "tr"), cache_read="tc", thinking="tr", has_thinking="coalesce(tr, 0) > 0")
    name = "CASE WHEN e % 8 = 0 THEN 'mcp__git__find' ELSE 'shell' END"
    ended = "CASE WHEN e % 3 <> 0 THEN 'mcp__db__put' ELSE 'put' END"
    return f"""l AS (
  SELECT *, 'roll-' || u AS file, coalesce(
           last_value(CASE WHEN t = 'view' AND e % 5 <> 0 THEN 'model-' || (e % 3) END IGNORE NULLS) OVER w,
           first_value(CASE WHEN t = 'signup' AND e % 2 = 0 THEN 'start-model' END IGNORE NULLS) OVER w) AS cur,
         CASE WHEN e % 7 <> 0 THEN k * 3 END AS ti, CASE WHEN e % 4 <> 0 THEN v END AS tc, v * 2 AS tout, CASE WHEN e % 2 = 0 THEN k END AS tr
  FROM b WINDOW w AS (PARTITION BY u ORDER BY ln ROWS UNBOUNDED PRECEDING)
), ev AS (
  SELECT {spent} FROM l WHERE t = 'purchase' AND e % 9 > 1
  UNION ALL SELECT {event_sql(kind="CASE WHEN e % 3 = 0 THEN 'Assistant' ELSE 'User' END", summary="'say ' || k", chars="length('say ' || k) + 2")} FROM l WHERE t = 'click' AND e % 4 <> 0
  UNION ALL SELECT {event_sql(kind="'ToolCall'", chars="length('run é' || k)", tools=f"concat_ws('/', 'c' || e, {name}, length('run é' || k), CASE WHEN e % 8 = 0 THEN 'git' END)")} FROM l WHERE t = 'click' AND e % 4 = 0
  UNION ALL SELECT {event_sql(kind="'Compaction'", summary="'context compacted'")} FROM l WHERE t = 'error' AND e % 4 = 0
  UNION ALL SELECT {event_sql(kind="'ToolCall'", tools=f"concat_ws('/', 'm' || e, {ended}, 0, CASE WHEN e % 3 <> 0 THEN 'db' END)")} FROM l WHERE t = 'error' AND e % 4 = 1 AND e % 5 <> 0
), f AS (
  SELECT l.file, arg_min('/home/p' || k, ln) FILTER (t = 'signup' AND e % 3 <> 0) AS project, count(*) FILTER ((t = 'error' AND e % 4 > 1) OR (t = 'purchase' AND e % 9 = 0)) AS skipped_lines,
         coalesce(any_value(m.model), arg_max(cur, ln) FILTER (cur IS NOT NULL)) AS model
  FROM l LEFT JOIN (SELECT file, arg_max(model, {{'n': n, 'm': model}}) AS model FROM (SELECT file, model, count(*) AS n FROM ev WHERE billed AND model IS NOT NULL GROUP BY 1, 2) GROUP BY 1) m ON l.file = m.file GROUP BY 1
)"""


# -- the third source: a message may be written again, larger -----------------------------------------------------------

def _third_lines() -> tuple[str, str]:
    stamp = {"timestamp": STAMP}
    tokens = json_text(input="CAST(k * 5 AS string)", output="CAST(v AS string)", cached="CASE WHEN e % 3 <> 0 THEN CAST(v AS string) END", thoughts="CASE WHEN e % 4 = 0 THEN CAST(k AS string) END")
    said = json_text(
        type="'\"gemini\"'", id="CASE WHEN e % 10 <> 9 THEN " + text("concat('m', nth - nth % 2)") + " END", model=text("concat('g-', e % 3)"),
        content=text("CASE WHEN e % 6 = 0 THEN '' ELSE concat('answer ', k) END"), tokens="CASE WHEN e % 7 <> 0 THEN " + tokens + " END",
        thoughts="CASE WHEN e % 5 = 0 THEN concat('[', " + json_text(subject=text("'why'"), description=text("concat('so ', v)")) + ", ']') END",
        toolCalls="CASE WHEN e % 5 = 1 THEN concat('[', " + json_text(id=text("concat('t', e)"), name=text("'find'"), args=json_text(n="CAST(k AS string)")) + ", ']') END", **stamp)
    asked = json_text(type="'\"user\"'", content="concat('[', " + json_text(text=text("concat('ask ', k)")) + ", ',', " + json_text(text=text("'é'")) + ", ']')", **stamp)
    plain = json_text(type="'\"user\"'", content=text("concat('ask ', k)"), **stamp)
    answer = chosen(("e % 2 = 0", text("concat('found ', k)")), otherwise=json_text(n="CAST(k AS string)"))
    result = json_text(type="'\"user\"'", content="concat('[', " + json_text(functionResponse=json_text(id=text("concat('t', e)"), response=json_text(output=answer))) + ", ']')", **stamp)
    head = json_text(sessionId=text("concat('x', u)"), startTime="concat('\"', stamp, '\"')")
    other = chosen(("e % 4 = 0", "'{\"$set\":{\"a\":1}}'"), ("e % 4 = 1", "'{\"type\":\"info\"}'"), ("e % 4 = 2", "'{\"type\":\"odd\"}'"), otherwise="'{\"type\":\"gemini\",\"tokens\":5}'")
    line = chosen(("t = 'signup' AND e % 2 = 0", head), ("t = 'signup'", plain), ("t = 'view'", asked), ("t = 'click'", result), ("t = 'purchase'", said), otherwise=other)
    return "concat('/logs/tmp/proj', u % 3, '/chats/session-', u, '.jsonl')", line


def _third_events() -> str:
    answer = "CASE WHEN e % 2 = 0 THEN 'found ' || k ELSE '{\"n\":' || k || '}' END"
    tool = "CASE WHEN e % 5 = 1 THEN length('{\"n\":' || k || '}') END"
    message = event_sql(
        line_no="first_ln", ts="epoch_us(first_ts)", kind="'Assistant'", request_id="id", model="first_model", billed="billed", input="i", output="o", cache_read="c", thinking="th",
        tools="coalesce(tools, '')", summary="said", chars="length(last_said) + last_thought + coalesce(tool_chars, 0)", thinking_chars="last_thought", has_thinking="thinks")
    return f"""l AS (
  SELECT *, 'session-' || u AS file, CASE WHEN e % 10 <> 9 THEN 'm' || (nth - nth % 2) END AS id, CASE WHEN e % 6 = 0 THEN '' ELSE 'answer ' || k END AS shown,
         CASE WHEN e % 5 = 0 THEN 3 + length('so ' || v) ELSE 0 END AS thought, {tool} AS tool_bytes
  FROM b
), g AS (
  SELECT file, coalesce(id, '') AS gid, any_value(id) AS id, min(ln) AS first_ln, arg_min(CASE WHEN e % 13 <> 0 THEN ts ELSE '1700-01-01'::TIMESTAMP END, ln) AS ts0, arg_min('g-' || (e % 3), ln) AS first_model, bool_or(e % 7 <> 0) AS billed,
         max(greatest(k * 5 - CASE WHEN e % 3 <> 0 THEN v ELSE 0 END, 0)) FILTER (e % 7 <> 0) AS i, max(v) FILTER (e % 7 <> 0) AS o, max(v) FILTER (e % 7 <> 0 AND e % 3 <> 0) AS c,
         max(k) FILTER (e % 7 <> 0 AND e % 4 = 0) AS th, arg_max(shown, ln) AS last_said, arg_max(thought, ln) AS last_thought, arg_max(shown, ln) FILTER (shown <> '') AS said,
         bool_or(e % 5 = 0 OR (e % 7 <> 0 AND e % 4 = 0 AND k > 0)) AS thinks, arg_max(concat_ws('/', 't' || e, 'find', tool_bytes), ln) FILTER (e % 5 = 1) AS tools, arg_max(tool_bytes, ln) FILTER (e % 5 = 1) AS tool_chars
  FROM l WHERE t = 'purchase' GROUP BY 1, 2
), ev AS (
  SELECT {message} FROM (SELECT *, nullif(ts0, '1700-01-01'::TIMESTAMP) AS first_ts, 0 AS e, NULL::TIMESTAMP AS ts FROM g)
  UNION ALL SELECT {event_sql(kind="'User'", summary="'ask ' || k", chars="length('ask ' || k) + 2")} FROM l WHERE t = 'view'
  UNION ALL SELECT {event_sql(kind="'ToolResult'", summary=answer, chars=f"length({answer})", tool_use_id="'t' || e")} FROM l WHERE t = 'click'
), f AS (
  SELECT l.file, 'proj' || (any_value(u) % 3) AS project, count(*) FILTER (t = 'error' AND e % 4 > 1) AS skipped_lines, any_value(m.model) AS model,
         epoch_us(coalesce(arg_min(l.ts, ln) FILTER (t = 'signup' AND e % 2 = 0), any_value(m.first_ts))) AS started_at
  FROM l LEFT JOIN (
    SELECT file, (SELECT arg_max(model, {{'n': n, 'm': model}}) FROM (SELECT model, count(*) AS n FROM ev x WHERE x.file = ev.file AND kind = 'Assistant' GROUP BY 1)) AS model, make_timestamp(min(ts)) AS first_ts FROM ev GROUP BY 1
  ) m ON l.file = m.file GROUP BY 1
)"""


# -- the fourth source: no counters at all ------------------------------------------------------------------------------

def _fourth_lines() -> tuple[str, str]:
    wrap = lambda kind, data: json_text(type=text(f"'{kind}'"), data=data, timestamp=STAMP)
    where = json_text(cwd=text("CASE WHEN e % 4 = 0 THEN concat('/home/dev/p', k, '/') ELSE concat('C:', '/w/q', k) END"))
    start = wrap("session.start", json_text(selectedModel="CASE WHEN e % 3 <> 0 THEN '\"m-start\"' END", context="CASE WHEN e % 5 <> 0 THEN " + where + " END", startTime="concat('\"', stamp, '\"')"))
    resume = wrap("session.resume", json_text(resumeTime="concat('\"', stamp, '\"')"))
    asked = wrap("user.message", json_text(content=text("concat('ask ', k)")))
    said = wrap("assistant.message", json_text(
        content=text("concat('tell é', k)"), reasoningText="CASE WHEN e % 3 = 0 THEN " + text("concat('think ', v)") + " END", reasoningOpaque="CASE WHEN e % 4 = 0 THEN '\"zz\"' END", model=text("concat('m-', e % 3)"),
        toolRequests="CASE WHEN e % 5 = 0 THEN concat('[', " + json_text(toolCallId=text("concat('t', e)"), name=text("'mcp__git__find'"), arguments=json_text(n="CAST(k AS string)")) + ", ']') END"))
    done = wrap("tool.execution_complete", json_text(toolCallId=text("concat('t', coalesce(ref, 0))"), toolName="CASE WHEN e % 2 = 0 THEN '\"find\"' END", result=json_text(out=text("concat('é', k)")), model=text("'m-tool'")))
    other = chosen(
        ("e % 4 = 0", wrap("session.model_change", json_text(newModel=text("'m-9'")))), ("e % 4 = 1", "'{\"type\":\"assistant.turn_start\"}'"), ("e % 4 = 2", "'{\"type\":\"odd\",\"data\":{}}'"),
        otherwise="'{\"type\":\"assistant.message\"}'",
    )
    line = chosen(("t = 'signup' AND e % 2 = 0", start), ("t = 'signup'", resume), ("t = 'view'", asked), ("t = 'purchase'", said), ("t = 'click'", done), otherwise=other)
    return "CASE WHEN u % 2 = 0 THEN concat('/logs/session-state/n', u, '/events.jsonl') ELSE concat('/logs/session-state/n', u, '.jsonl') END", line


def _fourth_events() -> str:
    bytes_ = "strlen('{\"n\":' || k || '}')"
    said = event_sql(
        kind="'Assistant'", model="'m-' || (e % 3)", summary="'tell é' || k", thinking_chars="CASE WHEN e % 3 = 0 THEN length('think ' || v) ELSE 0 END", has_thinking="e % 3 = 0 OR e % 4 = 0",
        tools=f"CASE WHEN e % 5 = 0 THEN concat_ws('/', 't' || e, 'mcp__git__find', {bytes_}, 'git') ELSE '' END",
        chars=f"length('tell é' || k) + CASE WHEN e % 3 = 0 THEN length('think ' || v) ELSE 0 END + CASE WHEN e % 5 = 0 THEN {bytes_} ELSE 0 END")
    return f"""l AS (SELECT *, 'n' || u AS file FROM b), ev AS (
  SELECT {event_sql(kind="'System'", ts='epoch_us(ts)', model="CASE WHEN e % 3 <> 0 THEN 'm-start' END", summary="'session start'")} FROM l WHERE t = 'signup' AND e % 2 = 0
  UNION ALL SELECT {event_sql(kind="'System'", ts='epoch_us(ts)', summary="'session resume'")} FROM l WHERE t = 'signup' AND e % 2 <> 0
  UNION ALL SELECT {event_sql(kind="'User'", summary="'ask ' || k", chars="length('ask ' || k)")} FROM l WHERE t = 'view'
  UNION ALL SELECT {said} FROM l WHERE t = 'purchase'
  UNION ALL SELECT {event_sql(kind="'ToolResult'", model="'m-tool'", summary="CASE WHEN e % 2 = 0 THEN 'find' ELSE 't' || coalesce(ref, 0) END", tool_use_id="'t' || coalesce(ref, 0)",
                              chars="strlen('{\"out\":\"é' || k || '\"}')")} FROM l WHERE t = 'click'
), ta AS (
  SELECT file, CASE WHEN t = 'signup' THEN CASE WHEN e % 3 <> 0 THEN 'm-start' END WHEN t = 'error' THEN 'm-9' ELSE 'm-' || (e % 3) END AS model
  FROM l WHERE t = 'purchase' OR (t = 'signup' AND e % 2 = 0) OR (t = 'error' AND e % 4 = 0)
), f AS (
  SELECT l.file, arg_min(CASE WHEN e % 4 = 0 THEN 'p' || k ELSE 'q' || k END, ln) FILTER (t = 'signup' AND e % 2 = 0 AND e % 5 <> 0) AS project, count(*) FILTER (t = 'error' AND e % 4 > 1) AS skipped_lines, any_value(m.model) AS model
  FROM l LEFT JOIN (SELECT file, arg_max(model, {{'n': n, 'm': model}}) AS model FROM (SELECT file, model, count(*) AS n FROM ta WHERE model IS NOT NULL GROUP BY 1, 2) GROUP BY 1) m ON l.file = m.file GROUP BY 1
)"""


LINES: dict[str, tuple[str, str]] = {"claude-code": _first_lines(), "codex": _second_lines(), "gemini": _third_lines(), "copilot": _fourth_lines()}
OTHERS = {"codex": _second_events(), "gemini": _third_events(), "copilot": _fourth_events()}


def base_sql(since: str = "true") -> str:
    """CTEs of the first source: events ``ev``, files ``f``, requests ``r``."""
    return f"WITH {NUMBERED}, {_first_events()}, {_FIRST_FILES}, {_REQUESTS.replace('/*since*/ true', since)}"


def other_sql(source: str) -> str:
    """CTEs of another source: events ``ev``, files ``f``."""
    return f"WITH {NUMBERED}, {OTHERS[source]}"
