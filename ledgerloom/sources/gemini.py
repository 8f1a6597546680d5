"""Source: tmp/<project>/chats/session-*.jsonl. A message may be written again, larger; its lines merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import USAGE, chars_sql, less_sql, server_sql, snippet_sql
from ledgerloom.sources.base import Parsed, Source, env_paths, event, kind_of, long_at, part_of_path, raw_at, strict, text_at, time_at, usage

_COUNTS = ("input", "output", "cached", "thoughts", "tool", "total")
BAD = strict(
    strings=("$.sessionId", "$.startTime", "$.type", "$.id", "$.timestamp", "$.model"), arrays=("$.thoughts", "$.toolCalls"), objects=("$.tokens",),
    counters=tuple(f"$.tokens.{c}" for c in _COUNTS),
)


def parse(lines: DataFrame) -> Parsed:
    rows = lines.selectExpr(
        "file_id", "line_no", "line", "v", f"{BAD} AS bad", f"{text_at('$.type')} AS type", f"{time_at('$.timestamp')} AS ts", f"coalesce({text_at('$.id')}, '') AS id",
        f"nullif({text_at('$.model')}, '') AS model", f"{kind_of('$.content')} AS content_kind", f"{raw_at('$.content')} AS content", f"{kind_of('$.tokens')} AS tokens_kind",
        *[f"{long_at(f'$.tokens.{c}')} AS t_{c}" for c in _COUNTS[:4]], "get_json_object(line, \"$['$set']\") IS NOT NULL AS is_set",
        f"{text_at('$.sessionId')} IS NOT NULL AS is_header", f"{time_at('$.startTime')} AS start_time",
        f"CASE WHEN {kind_of('$.thoughts')} LIKE 'ARRAY%' THEN from_json({raw_at('$.thoughts')}, 'array<struct<subject:string,description:string>>') END AS thoughts",
        f"CASE WHEN {kind_of('$.toolCalls')} LIKE 'ARRAY%' THEN from_json({raw_at('$.toolCalls')}, 'array<struct<id:string,name:string,args:string>>') END AS asked",
    )
    rows = rows.withColumns({
        "visible": F.expr("CASE WHEN content_kind = 'STRING' THEN content ELSE '' END"),
        "thought": F.expr(f"coalesce(aggregate(thoughts, 0L, (a, t) -> a + {chars_sql('t.subject')} + {chars_sql('t.description')}), 0L)"),
        "thinks": F.expr("coalesce(size(thoughts) > 0 AND thoughts IS NOT NULL, false) OR coalesce(t_thoughts, 0) > 0"),
        "calls": F.expr(
            "coalesce(transform(asked, c -> named_struct('id', coalesce(c.id, ''), 'name', coalesce(c.name, 'unknown'), "
            f"'input_bytes', {chars_sql('c.args')}, 'server', {server_sql("coalesce(c.name, 'unknown')")})), array())"
        ),
        "usage": F.expr(
            "CASE WHEN tokens_kind LIKE 'OBJECT%' THEN "
            + usage(input=less_sql("t_input", "t_cached"), output="t_output", cache_read="t_cached", thinking="t_thoughts") + " END"
        ),
        "blocks": F.expr("CASE WHEN type = 'user' AND content_kind LIKE 'ARRAY%' THEN try_variant_get(v, '$.content', 'array<variant>') END"),
    })
    good = rows.where("NOT bad AND NOT is_set")
    # an assistant message: its lines in one row, at the place of the first
    said = good.where("type = 'gemini'").groupBy("file_id", "id").agg(
        F.min("line_no").alias("line_no"), F.min_by("ts", "line_no").alias("ts"), F.min_by("model", "line_no").alias("model"),
        F.bool_or(F.col("usage").isNotNull()).alias("billed"), *[F.max(f"usage.{c}").alias(f"u_{c}") for c in USAGE],
        F.max_by("visible", "line_no").alias("visible"), F.max_by("thought", "line_no").alias("thought"), F.bool_or("thinks").alias("thinks"),
        F.expr("max_by(calls, line_no) FILTER (WHERE size(calls) > 0)").alias("calls"),
        F.expr(f"max_by({snippet_sql('visible')}, line_no) FILTER (WHERE {snippet_sql('visible')} IS NOT NULL)").alias("summary"),
    )
    message = event(
        kind="'Assistant'", ts="ts", request_id="nullif(id, '')", model="model", usage="CASE WHEN billed THEN " + usage(**{c: f"u_{c}" for c in USAGE}) + " END",
        tool_calls="coalesce(calls, array())", content_summary="summary", thinking_chars="thought", has_thinking="thinks",
        content_chars=f"{chars_sql('visible')} + thought + coalesce(aggregate(calls, 0L, (a, c) -> a + c.input_bytes), 0L)",
    )
    merged = said.selectExpr("file_id", "line_no", "false AS skip", "model AS tally", f"array({message}) AS events", "CAST(NULL AS timestamp) AS start_time")
    answer = f"get(filter(transform(blocks, b -> try_variant_get(b, '$.functionResponse', 'variant')), x -> x IS NOT NULL AND {kind_of('$', 'x')} LIKE 'OBJECT%'), 0)"
    rest = rows.where("bad OR is_set OR coalesce(type, '') <> 'gemini'").withColumn("answer", F.expr(answer))
    rest = rest.withColumn("nth", F.expr(f"array_position(transform(blocks, b -> {kind_of('$.functionResponse', 'b')} IS NOT NULL), true) - 1"))
    rest = rest.withColumns({
        "output_kind": F.expr(kind_of("$.response.output", "answer")),
        "output": F.expr("get_json_object(content, concat('$[', nth, '].functionResponse.response.output'))"),
    })
    rest = rest.withColumn("output", F.expr("CASE WHEN output_kind = 'VOID' THEN 'null' ELSE coalesce(output, '') END"))
    prompt = "array_join(filter(transform(blocks, b -> " + text_at("$.text", "b") + "), x -> x IS NOT NULL), '\\n')"
    rest = rest.withColumn("prompt", F.expr(prompt))
    result = event(kind="'ToolResult'", ts="ts", content_summary=snippet_sql("output"), content_chars=chars_sql("output"), tool_use_id=f"nullif({text_at('$.id', 'answer')}, '')")
    user = event(kind="'User'", ts="ts", content_summary=snippet_sql("prompt"), content_chars=chars_sql("prompt"))
    others = rest.selectExpr(
        "file_id", "line_no", "bad OR (NOT is_set AND CASE WHEN type IS NULL THEN NOT is_header ELSE type NOT IN ('user', 'info', 'error') END) AS skip", "CAST(NULL AS string) AS tally",
        f"CASE WHEN NOT bad AND NOT is_set AND type = 'user' AND blocks IS NOT NULL THEN array(CASE WHEN answer IS NOT NULL THEN {result} ELSE {user} END) END AS events",
        "CASE WHEN NOT bad AND NOT is_set AND type IS NULL AND is_header THEN start_time END AS start_time",
    )
    return Parsed(merged.unionByName(others), {"header_start": F.expr("min_by(start_time, line_no) FILTER (WHERE start_time IS NOT NULL)")})


SOURCE = Source(
    "gemini", lambda: env_paths("GEMINI_HOME", "~/.gemini", "tmp"), parse, glob="session-*.jsonl",
    project=part_of_path("([^/]+)/chats/[^/]+$"), accepts="path RLIKE '/tmp/[^/]+/chats/session-[^/]*[.]jsonl$'",
)
