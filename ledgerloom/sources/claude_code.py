"""Source: projects/<dir>/<session>.jsonl, with sub-agents' files below their parent's folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import chars_sql, server_sql, snippet_sql
from ledgerloom.sources.base import (
    Parsed, Source, env_paths, event, json_size, kind_of, long_at, part_of_path, raw_at, strict, text_at, time_at, usage,
)

#: Line types that say nothing about spend or content. Fixed values.
IGNORED = (
    "summary", "mode", "permission-mode", "last-prompt", "file-history-snapshot", "ai-title", "custom-title", "queue-operation",
    "agent-name", "queued-message", "progress",
)
BLOCK = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string>>"
_U = "$.message.usage"
BAD = strict(
    strings=("$.type", "$.timestamp", "$.requestId", "$.subtype", "$.content", "$.message.model", "$.attachment.type", "$.attachment.content"),
    flags=("$.isSidechain", "$.isCompactSummary", "$.isApiErrorMessage"),
    objects=("$.message", "$.attachment", _U, f"{_U}.cache_creation"),
    counters=(
        f"{_U}.input_tokens", f"{_U}.output_tokens", f"{_U}.cache_creation_input_tokens", f"{_U}.cache_read_input_tokens",
        f"{_U}.cache_creation.ephemeral_5m_input_tokens", f"{_U}.cache_creation.ephemeral_1h_input_tokens", "$.attachment.skillCount",
    ),
    arrays=("$.attachment.addedNames", "$.attachment.names", "$.attachment.addedLines"),
)


def parse(lines: DataFrame) -> Parsed:
    flag = lambda name: f"coalesce(try_variant_get(v, '$.{name}', 'boolean'), false)"
    rows = lines.selectExpr(
        "file_id", "line_no", "line", "v", f"{BAD} AS bad", f"{text_at('$.type')} AS type", f"{time_at('$.timestamp')} AS ts",
        f"{text_at('$.requestId')} AS request_id", f"{text_at('$.message.model')} AS model", f"{flag('isSidechain')} AS sidechain",
        f"{flag('isCompactSummary')} AS compact", f"{flag('isApiErrorMessage')} AS api_error", f"{kind_of('$.message')} AS message_kind",
        f"{kind_of('$.message.content')} AS content_kind", f"{raw_at('$.message.content')} AS content", f"{kind_of(_U)} AS usage_kind",
        f"{kind_of('$.attachment')} AS attachment_t", f"{text_at('$.attachment.type')} AS attachment_kind", f"{kind_of('$.attachment.addedBlocks')} AS blocks_kind",
        f"{text_at('$.subtype')} AS subtype", f"{text_at('$.content')} AS top_content",
    )
    rows = rows.withColumn("v_blocks", F.expr("CASE WHEN content_kind LIKE 'ARRAY%' THEN try_variant_get(v, '$.message.content', 'array<variant>') END"))
    size = json_size("b.input", kind_of("$.input", "v_blocks[i]"))
    rows = rows.withColumn("blocks", F.expr(f"CASE WHEN content_kind LIKE 'ARRAY%' THEN from_json(content, '{BLOCK}') END"))
    rows = rows.withColumn("blocks", F.expr(
        "transform(blocks, (b, i) -> named_struct('type', b.type, 'text', b.text, 'thinking', b.thinking, 'id', coalesce(b.id, ''), "
        f"'name', coalesce(b.name, 'unknown'), 'input', b.input, 'tool_use_id', b.tool_use_id, 'bytes', CAST({size} AS bigint)))"
    ))
    rows = rows.withColumns({
        "synthetic": F.expr("api_error OR coalesce(model = '<synthetic>', false)"),
        "first_text": F.expr(f"get(filter(transform(filter(blocks, b -> b.type = 'text'), b -> {snippet_sql('b.text')}), x -> x IS NOT NULL), 0)"),
        "plain": F.expr("CASE WHEN content_kind = 'STRING' THEN content END"),
        "calls": F.expr(
            "coalesce(transform(filter(blocks, b -> b.type = 'tool_use'), b -> named_struct('id', b.id, 'name', b.name, "
            f"'input_bytes', b.bytes, 'server', {server_sql('b.name')})), array())"
        ),
        "spawns": F.expr(
            "coalesce(transform(filter(blocks, b -> b.type = 'tool_use' AND b.name IN ('Task', 'Agent')), b -> named_struct('tool_call_id', b.id, "
            "'agent_type', get_json_object(b.input, '$.subagent_type'), 'description', get_json_object(b.input, '$.description'))), array())"
        ),
        "result": F.expr("get(filter(blocks, b -> b.type = 'tool_result'), 0)"),
    })
    weight = f"CASE b.type WHEN 'text' THEN {chars_sql('b.text')} WHEN 'thinking' THEN {chars_sql('b.thinking')} WHEN 'tool_use' THEN b.bytes ELSE 0L END"
    total = lambda w: f"aggregate(blocks, 0L, (a, b) -> a + {w})"
    counts = usage(
        input=long_at(f"{_U}.input_tokens"), output=long_at(f"{_U}.output_tokens"), cache_creation=long_at(f"{_U}.cache_creation_input_tokens"),
        cache_creation_5m=long_at(f"{_U}.cache_creation.ephemeral_5m_input_tokens"), cache_creation_1h=long_at(f"{_U}.cache_creation.ephemeral_1h_input_tokens"),
        cache_read=long_at(f"{_U}.cache_read_input_tokens"),
    )
    summary = f"coalesce(first_text, {snippet_sql('plain')})"
    thinking = f"CASE WHEN b.type = 'thinking' THEN {chars_sql('b.thinking')} ELSE 0L END"
    assistant = event(
        kind="'Assistant'", ts="ts", request_id="request_id", model="model", usage=f"CASE WHEN NOT synthetic AND usage_kind LIKE 'OBJECT%' THEN {counts} END",
        tool_calls="calls", sidechain="sidechain", content_summary=summary, content_chars=f"coalesce({total(weight)}, {chars_sql('plain')})",
        thinking_chars=f"coalesce({total(thinking)}, 0)", has_thinking="coalesce(exists(blocks, b -> b.type IN ('thinking', 'redacted_thinking')), false)",
    )
    spawn = event(kind="'SubAgentSpawn'", ts="ts", sidechain="sidechain", content_summary="s.description", spawn="s")
    said = f"CASE WHEN b.text IS NULL THEN 0L ELSE {chars_sql('b.text')} END"
    any_text = f"get(filter(transform(blocks, b -> {snippet_sql('b.text')}), x -> x IS NOT NULL), 0)"
    user = event(
        kind="CASE WHEN result IS NOT NULL THEN 'ToolResult' WHEN compact THEN 'Compaction' ELSE 'User' END", ts="ts", sidechain="sidechain",
        content_summary=f"CASE WHEN result IS NULL THEN coalesce({any_text}, {snippet_sql('plain')}) END",
        content_chars=f"CASE WHEN result IS NOT NULL THEN octet_length(content) ELSE coalesce({total(said)}, {chars_sql('plain')}) END",
        tool_use_id="result.tool_use_id",
    )
    system = event(
        kind="CASE WHEN subtype = 'compact_boundary' THEN 'Compaction' ELSE 'System' END", ts="ts", sidechain="sidechain",
        content_summary=snippet_sql("top_content"), content_chars=chars_sql("top_content"),
    )
    length = lambda p: f"CASE WHEN {kind_of(p)} LIKE 'ARRAY%' THEN size(try_variant_get(v, '{p}', 'array<variant>')) END"
    lines_chars = "aggregate(coalesce(try_variant_get(v, '$.attachment.addedLines', 'array<string>'), array()), 0L, (a, x) -> a + char_length(x))"
    blocks_chars = json_size(raw_at("$.attachment.addedBlocks"), "nullif(blocks_kind, 'VOID')", "char_length")
    attachment = event(
        kind="'Attachment'", ts="ts", sidechain="sidechain", content_summary="attachment_kind", attachment_kind="attachment_kind",
        item_count=f"coalesce({length('$.attachment.addedNames')}, {length('$.attachment.names')}, {long_at('$.attachment.skillCount')}, 0)",
        content_chars=f"{chars_sql(text_at('$.attachment.content'))} + {lines_chars} + {blocks_chars}",
    )
    ignored = ", ".join(f"'{x}'" for x in IGNORED)
    return Parsed(rows.selectExpr(
        "file_id", "line_no",
        "bad OR CASE type WHEN 'assistant' THEN coalesce(message_kind, 'VOID') = 'VOID' WHEN 'attachment' THEN coalesce(attachment_t, 'VOID') = 'VOID' "
        f"WHEN 'user' THEN false WHEN 'system' THEN false ELSE coalesce(type NOT IN ({ignored}), true) END AS skip",
        "CASE WHEN NOT bad AND type = 'assistant' AND message_kind LIKE 'OBJECT%' AND NOT synthetic THEN model END AS tally",
        f"CASE WHEN bad THEN NULL WHEN type = 'assistant' AND message_kind LIKE 'OBJECT%' THEN concat(array({assistant}), transform(spawns, s -> {spawn})) "
        f"WHEN type = 'user' THEN array({user}) WHEN type = 'system' THEN array({system}) "
        f"WHEN type = 'attachment' AND attachment_t LIKE 'OBJECT%' THEN array({attachment}) END AS events",
    ))


SOURCE = Source(
    "claude-code", lambda: env_paths("CLAUDE_CONFIG_DIR", "~/.claude", "projects"), parse,
    parent_session=part_of_path("^.*/([^/]+)/subagents/.*"), project=part_of_path("/projects/([^/]+)/"),
)
