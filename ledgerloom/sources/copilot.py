"""Source: session-state/<id>/events.jsonl and session-state/<id>.jsonl. It logs no usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import chars_sql, server_sql, snippet_sql
from ledgerloom.sources.base import STEM, Parsed, Source, env_paths, event, json_size, kind_of, part_of_path, raw_at, strict, text_at, time_at

_D = "$.data"
#: Line types without spend or content. Fixed values.
IGNORED = ("assistant.turn_start", "assistant.turn_end", "tool.execution_start", "session.truncation")
BAD = strict(
    strings=("$.type", "$.timestamp", *(f"{_D}.{x}" for x in (
        "selectedModel", "startTime", "resumeTime", "newModel", "content", "reasoningText", "toolCallId", "toolName", "model", "context.cwd"))),
    objects=(_D, f"{_D}.context"), arrays=(f"{_D}.toolRequests",),
) + f" OR coalesce({kind_of(f'{_D}.toolRequests')} = 'VOID', false)"
BASENAME = r"nullif(regexp_extract({0}, r'([^/\\]+)[/\\]*$', 1), '')"


def parse(lines: DataFrame) -> Parsed:
    rows = lines.selectExpr(
        "file_id", "line_no", "line", "v", f"{BAD} AS bad", f"{text_at('$.type')} AS type", f"{time_at('$.timestamp')} AS ts", f"coalesce({kind_of(_D)}, 'VOID') AS data_kind",
        f"{text_at(f'{_D}.selectedModel')} AS selected", f"{text_at(f'{_D}.newModel')} AS changed", f"{text_at(f'{_D}.model')} AS model", f"{text_at(f'{_D}.content')} AS content",
        f"coalesce({text_at(f'{_D}.reasoningText')}, '') AS reasoning", f"coalesce({kind_of(f'{_D}.reasoningOpaque')}, 'VOID') <> 'VOID' AS opaque",
        f"{text_at(f'{_D}.toolCallId')} AS call_id", f"{text_at(f'{_D}.toolName')} AS tool", f"{BASENAME.format(text_at(f'{_D}.context.cwd'))} AS cwd",
        f"{time_at(f'{_D}.startTime')} AS started", f"{time_at(f'{_D}.resumeTime')} AS resumed", f"{raw_at(f'{_D}.result')} AS result", f"{kind_of(f'{_D}.result')} AS result_kind",
        f"from_json({raw_at(f'{_D}.toolRequests')}, 'array<struct<toolCallId:string,name:string,arguments:string>>') AS asked",
        f"try_variant_get(v, '{_D}.toolRequests', 'array<variant>') AS v_asked",
    )
    size = json_size("c.arguments", f"nullif({kind_of('$.arguments', 'v_asked[i]')}, 'VOID')")
    rows = rows.withColumn("calls", F.expr(
        "coalesce(transform(asked, (c, i) -> named_struct('id', coalesce(c.toolCallId, ''), 'name', coalesce(c.name, 'unknown'), "
        f"'input_bytes', CAST({size} AS bigint), 'server', {server_sql("coalesce(c.name, 'unknown')")})), array())"
    ))
    start = event(kind="'System'", ts="coalesce(ts, started)", model="selected", content_summary="'session start'")
    resume = event(kind="'System'", ts="coalesce(ts, resumed)", content_summary="'session resume'")
    user = event(kind="'User'", ts="ts", content_summary=snippet_sql("content"), content_chars=chars_sql("content"))
    assistant = event(
        kind="'Assistant'", ts="ts", model="model", tool_calls="calls", content_summary=snippet_sql("content"), thinking_chars=chars_sql("reasoning"),
        has_thinking="reasoning <> '' OR opaque", content_chars=f"{chars_sql('content')} + {chars_sql('reasoning')} + aggregate(calls, 0L, (a, c) -> a + c.input_bytes)",
    )
    done = event(
        kind="'ToolResult'", ts="ts", model="model", content_summary="coalesce(tool, call_id)", tool_use_id="call_id",
        content_chars=json_size("result", "nullif(result_kind, 'VOID')"),
    )
    ignored = ", ".join(f"'{x}'" for x in IGNORED)
    has = "data_kind <> 'VOID'"
    out = rows.selectExpr(
        "file_id", "line_no",
        "CASE WHEN bad THEN true WHEN type IN ('assistant.message', 'tool.execution_complete') THEN data_kind = 'VOID' "
        f"ELSE coalesce(type NOT IN ('session.start', 'session.resume', 'session.model_change', 'user.message', {ignored}), true) END AS skip",
        "nullif(CASE WHEN bad THEN NULL WHEN type = 'session.start' THEN selected WHEN type = 'session.model_change' THEN changed WHEN type = 'assistant.message' THEN model END, '') AS tally",
        "CASE WHEN NOT bad AND type IN ('session.start', 'session.resume') THEN cwd END AS cwd",
        f"CASE WHEN bad THEN NULL WHEN type = 'session.start' AND {has} THEN array({start}) WHEN type = 'session.resume' AND {has} THEN array({resume}) WHEN type = 'user.message' THEN array({user}) "
        f"WHEN type = 'assistant.message' AND {has} THEN array({assistant}) WHEN type = 'tool.execution_complete' AND {has} THEN array({done}) END AS events",
    )
    return Parsed(out, {"seen_project": F.expr("min_by(cwd, line_no) FILTER (WHERE cwd IS NOT NULL)")})


SOURCE = Source(
    "copilot", lambda: env_paths("COPILOT_HOME", "~/.copilot", "session-state"), parse,
    session_id=f"CASE WHEN path LIKE '%/events.jsonl' THEN {part_of_path('([^/]+)/events[.]jsonl$')} ELSE {STEM} END",
)
