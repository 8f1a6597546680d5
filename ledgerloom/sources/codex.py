"""Source: sessions/YYYY/MM/DD/*.jsonl and archived_sessions/*.jsonl. Usage comes as deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import chars_sql, last_by, less_sql, server_sql, snippet_sql
from ledgerloom.operators.ranking import carry_forward
from ledgerloom.sources.base import Parsed, Source, env_paths, event, kind_of, long_at, raw_at, strict, text_at, time_at, usage

_P, _L = "$.payload", "$.payload.info.last_token_usage"
_COUNTS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
BAD = strict(
    strings=("$.type", "$.timestamp", *(f"{_P}.{x}" for x in ("type", "id", "cwd", "model", "role", "name", "arguments", "call_id", "tool", "invocation.server", "invocation.tool"))),
    needed_objects=(_P,), objects=(f"{_P}.info", f"{_P}.invocation", _L, f"{_P}.info.total_token_usage"),
    counters=tuple(f"{_P}.info.{u}.{c}" for u in ("last_token_usage", "total_token_usage") for c in _COUNTS),
)


def parse(lines: DataFrame) -> Parsed:
    rows = lines.selectExpr(
        "file_id", "line_no", "line", "v", f"{BAD} AS bad", f"{text_at('$.type')} AS type", f"{text_at(f'{_P}.type')} AS item", f"{time_at('$.timestamp')} AS ts",
        f"nullif({text_at(f'{_P}.model')}, '') AS model_said", f"nullif({text_at(f'{_P}.cwd')}, '') AS cwd", f"{text_at(f'{_P}.role')} AS role",
        f"{kind_of(f'{_P}.content')} AS content_kind", f"{raw_at(f'{_P}.content')} AS content", f"coalesce({text_at(f'{_P}.name')}, 'unknown') AS name",
        f"coalesce({text_at(f'{_P}.call_id')}, '') AS call_id", f"{text_at(f'{_P}.arguments')} AS arguments", f"{kind_of(f'{_P}.info')} AS info_kind", f"{kind_of(_L)} AS last_kind",
        *[f"{long_at(f'{_L}.{c}')} AS {c}" for c in _COUNTS[:4]], f"{text_at(f'{_P}.invocation.server')} AS server",
        f"coalesce({text_at(f'{_P}.invocation.tool')}, {text_at(f'{_P}.tool')}) AS tool",
    )
    upto = W.partitionBy("file_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("turn_model", F.when((F.col("type") == "turn_context") & ~F.col("bad"), F.col("model_said")))
    rows = carry_forward(rows, ["file_id"], ["line_no"], "turn_model", "turn")
    meta = F.first(F.when((F.col("type") == "session_meta") & ~F.col("bad"), F.col("model_said")), ignorenulls=True).over(upto)
    rows = rows.withColumn("current_model", F.coalesce("turn", meta))
    rows = rows.withColumn("text", F.expr(
        "CASE WHEN content_kind = 'STRING' THEN content WHEN content_kind LIKE 'ARRAY%' THEN "
        "aggregate(filter(transform(from_json(content, 'array<struct<text:string>>'), b -> b.text), x -> x IS NOT NULL), '', "
        "(a, x) -> CASE WHEN a = '' THEN x ELSE concat(a, '\\n', x) END) ELSE '' END"
    ))
    message = event(kind="CASE WHEN role = 'assistant' THEN 'Assistant' ELSE 'User' END", ts="ts", content_summary=snippet_sql("text"), content_chars=chars_sql("text"))
    size = chars_sql("arguments")
    call = event(
        kind="'ToolCall'", ts="ts", content_chars=size,
        tool_calls=f"array(named_struct('id', call_id, 'name', name, 'input_bytes', {size}, 'server', {server_sql('name')}))",
    )
    counts = usage(
        input=less_sql("input_tokens", "cached_input_tokens"), output=less_sql("output_tokens", "reasoning_output_tokens"),
        cache_read="cached_input_tokens", thinking="reasoning_output_tokens",
    )
    spent = event(kind="'Assistant'", ts="ts", model="current_model", usage=counts, has_thinking="coalesce(reasoning_output_tokens, 0) > 0")
    compacted = event(kind="'Compaction'", ts="ts", content_summary="'context compacted'")
    full = "CASE WHEN server IS NOT NULL THEN concat('mcp__', server, '__', tool) ELSE tool END"
    ended = event(
        kind="'ToolCall'", ts="ts",
        tool_calls=f"array(named_struct('id', call_id, 'name', {full}, 'input_bytes', 0L, 'server', coalesce(server, {server_sql(full)})))",
    )
    is_spent = "type = 'event_msg' AND item = 'token_count' AND last_kind LIKE 'OBJECT%'"
    out = rows.selectExpr(
        "file_id", "line_no", "current_model", "CASE WHEN type = 'session_meta' AND NOT bad THEN cwd END AS cwd",
        "bad OR coalesce(type NOT IN ('session_meta', 'turn_context', 'response_item', 'event_msg'), true) "
        "OR (type = 'event_msg' AND coalesce(item, '') = 'token_count' AND coalesce(info_kind, 'VOID') = 'VOID') AS skip",
        f"CASE WHEN NOT bad AND {is_spent} THEN current_model END AS tally",
        f"CASE WHEN bad THEN NULL WHEN type = 'response_item' AND item = 'message' THEN array({message}) WHEN type = 'response_item' AND item = 'function_call' THEN array({call}) "
        f"WHEN {is_spent} THEN array({spent}) WHEN type = 'event_msg' AND item = 'context_compacted' THEN array({compacted}) "
        f"WHEN type = 'event_msg' AND item = 'mcp_tool_call_end' AND tool IS NOT NULL THEN array({ended}) END AS events",
    )
    return Parsed(out, {
        "seen_project": F.expr("min_by(cwd, line_no) FILTER (WHERE cwd IS NOT NULL)"), "last_model": last_by("current_model", "line_no"),
    })


SOURCE = Source("codex", lambda: env_paths("CODEX_HOME", "~/.codex", "sessions", "archived_sessions", many=True), parse)
