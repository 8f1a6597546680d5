"""The sources and reports as queries: over logs written from the test tables, each with SQL over the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import classify as K
from ledgerloom.operators import dedup
from ledgerloom.plans import reports as R
from ledgerloom.plans import table_logs as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
FIRST = "claude-code"


def query(sql: str, unknown: str = "") -> Callable[[Query], Query]:
    """Register a function with its SQL. Columns named in ``unknown`` hold numbers or flags that may be NULL: -1 in the result."""
    names = unknown.split()

    def add(f: Query) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(spark, d).withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long")) for c in names})

        replaced = ", ".join(f'coalesce("{c}"::BIGINT, -1) AS "{c}"' for c in names)
        QUERIES[f.__name__] = run if names else f
        ORACLE[f.__name__] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if names else sql
        return f

    return add


def books(spark: SparkSession, d: str, since: str | None = None) -> R.Books:
    return R.Books.open(T.logs(spark, d, FIRST), since)


def day_of_since(spark: SparkSession, d: str) -> str:
    """The tenth last day of the table."""
    return spark.read.parquet(f"{d}/events.parquet").agg(F.date_sub(F.to_date(F.max("ts")), 10).cast("string")).head()[0]


SINCE = "ts >= epoch_us((SELECT (max(ts)::DATE - 10)::TIMESTAMP FROM events))"
BASE = T.base_sql()
ROLLUP = ("requests", "input", "output", "cache_creation", "cache_read", "incomplete_requests", "cost_usd", "unpriced_requests")


def rollup(where: str = "true") -> str:
    core = ("input", "output", "cache_creation", "cache_read")
    return ", ".join([
        f"count(*) FILTER ({where}) AS requests", *[f"coalesce(sum({c}) FILTER ({where}), 0)::BIGINT AS {c}" for c in core],
        f"count(*) FILTER (({where}) AND ({' OR '.join(f'{c} IS NULL' for c in core)})) AS incomplete_requests",
        f"coalesce(sum(micro) FILTER ({where}), 0)::DOUBLE / 1e6 AS cost_usd", f"count(*) FILTER (({where}) AND micro IS NULL) AS unpriced_requests",
    ])


def micros(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.unix_micros(n) for n in names})


_COUNTERS = "input output cache_creation cache_creation_5m cache_creation_1h cache_read"


@query(f"{BASE} SELECT * FROM ev", f"ts thinking {_COUNTERS}")
def log_events(spark: SparkSession, d: str) -> DataFrame:
    return T.events_of(T.logs(spark, d, FIRST))


@query(f"""{BASE} SELECT file, parent, project, row_id, model, epoch_us(started) AS started_at, epoch_us(ended) AS ended_at, skipped AS skipped_lines, spawns AS spawn_calls FROM f""", "started_at ended_at")
def log_files(spark: SparkSession, d: str) -> DataFrame:
    files = T.logs(spark, d, FIRST).files
    return micros(files.select(F.col("session_id").alias("file"), F.col("parent_session").alias("parent"), "project", "row_id", "model", "started_at", "ended_at", "skipped_lines", "spawn_calls"), "started_at", "ended_at")


@query(f"""{BASE} SELECT file, request_id, input, output, cache_creation, c5 AS cache_creation_5m, c1 AS cache_creation_1h, cache_read, ts, model, thinking_chars, has_thinking,
       has_thinking AND thinking_chars = 0 AS encrypted, sidechain, n_lines, naive AS naive_total, tokens AS known_total, micro::DOUBLE / 1e6 AS cost_usd FROM r""", f"ts {_COUNTERS}")
def log_requests(spark: SparkSession, d: str) -> DataFrame:
    reqs = books(spark, d).requests
    return micros(reqs, "ts").select(
        F.col("session_id").alias("file"), "request_id", "input", "output", "cache_creation", "cache_creation_5m", "cache_creation_1h", "cache_read", "ts", "model",
        "thinking_chars", "has_thinking", "encrypted", "sidechain", "n_lines", "naive_total", "known_total", "cost_usd")


def _totals(b: R.Books) -> DataFrame:
    """The one-row frames of the summary side by side."""
    s = R.summary(b)
    side = s["sidechain"].select(F.col("requests").alias("side_requests"), F.col("input").alias("side_input"))
    out = s["totals"].select(*ROLLUP)
    for frame in (side, s["dedup"], s["health"], s["compactions"]):
        out = out.crossJoin(frame)
    return out


def _totals_sql(base: str, events: str = "true") -> str:
    return f"""{base}
SELECT {rollup()}, count(*) FILTER (sidechain) AS side_requests, coalesce(sum(input) FILTER (sidechain), 0)::BIGINT AS side_input,
       sum(n_lines - 1)::BIGINT AS duplicate_lines_collapsed, sum(naive)::BIGINT AS naive_known_tokens, sum(tokens)::BIGINT AS known_tokens,
       CASE WHEN sum(naive) > sum(tokens) THEN (sum(naive)::DOUBLE / sum(tokens)::DOUBLE - 1) * 100 END AS overcount_percent,
       count(*) FILTER (has_thinking) AS requests_with_thinking, count(*) FILTER (has_thinking AND thinking_chars = 0) AS requests_with_encrypted_thinking,
       sum(thinking_chars)::BIGINT AS thinking_chars_total, sum(thinking_chars)::BIGINT // 4 AS thinking_tokens_estimate,
       (SELECT count(*) FROM f) AS sessions_parsed, 0::BIGINT AS sessions_failed, (SELECT sum(skipped)::BIGINT FROM f) AS skipped_lines,
       (SELECT count(*) FROM ev WHERE kind = 'Compaction' AND {events}) AS compactions FROM r"""


@query(_totals_sql(BASE))
def log_summary_totals(spark: SparkSession, d: str) -> DataFrame:
    return _totals(books(spark, d))


@query(_totals_sql(T.base_sql(SINCE), SINCE))
def log_summary_since(spark: SparkSession, d: str) -> DataFrame:
    """Only what happened from a day on; lines without a time are out."""
    return _totals(books(spark, d, day_of_since(spark, d)))


@query(f"{BASE} SELECT coalesce(model, '(unknown)') AS model, {rollup()} FROM r GROUP BY 1")
def log_summary_by_model(spark: SparkSession, d: str) -> DataFrame:
    return R.summary(books(spark, d))["by_model"]


@query(f"{BASE} SELECT make_timestamp(ts)::DATE AS day, {rollup()} FROM r WHERE ts IS NOT NULL GROUP BY 1")
def log_summary_by_day(spark: SparkSession, d: str) -> DataFrame:
    return R.summary(books(spark, d))["by_day"]


_ROWS = """rw AS (
  SELECT row_id, coalesce(any_value(project) FILTER (parent IS NULL), arg_min(project, disc)) AS project, any_value(model) FILTER (parent IS NULL) AS model,
         any_value(started) FILTER (parent IS NULL) AS started, greatest(coalesce(sum(spawns) FILTER (parent IS NULL), 0), count(*) FILTER (parent IS NOT NULL))::BIGINT AS sub_agents,
         arg_min(model, disc) AS any_model, arg_min(started, disc) AS any_started
  FROM f GROUP BY row_id
)"""


@query(f"""{BASE}, {_ROWS}, s AS (SELECT row_id, {rollup()}, coalesce(sum(tokens) FILTER (sidechain), 0)::BIGINT AS sub_agent_tokens FROM r GROUP BY 1)
SELECT s.* EXCLUDE (row_id), s.row_id AS id, project, model, epoch_us(started) AS started_at, sub_agents, 'claude-code' AS agent FROM s JOIN rw ON s.row_id = rw.row_id""", "started_at")
def log_summary_by_session(spark: SparkSession, d: str) -> DataFrame:
    """Sub-agents count towards their parent's session."""
    return micros(R.summary(books(spark, d))["by_session"], "started_at")


_CALLS = """c AS (
  SELECT ev.file, f.disc, f.row_id, line_no, split_part(tools, '/', 1) AS id, split_part(tools, '/', 2) AS name, split_part(tools, '/', 3)::BIGINT AS bytes, nullif(split_part(tools, '/', 4), '') AS server
  FROM ev JOIN f ON ev.file = f.file WHERE tools <> ''
)"""


@query(f"{BASE}, {_CALLS} SELECT name, count(*) AS calls, sum(bytes)::BIGINT AS input_bytes, any_value(server) AS server FROM c GROUP BY 1")
def log_summary_by_tool(spark: SparkSession, d: str) -> DataFrame:
    return R.summary(books(spark, d))["by_tool"]


@query(f"{BASE}, {_CALLS} SELECT name, count(*) AS calls, sum(bytes)::BIGINT AS input_bytes, any_value(server) AS server FROM c GROUP BY 1 ORDER BY calls DESC, name LIMIT 3")
def log_top_tools(spark: SparkSession, d: str) -> DataFrame:
    return R.top_tools(R.summary(books(spark, d)), 3)


@query(f"{BASE} SELECT DISTINCT model FROM r WHERE model IS NOT NULL AND micro IS NULL")
def log_summary_unpriced(spark: SparkSession, d: str) -> DataFrame:
    return R.summary(books(spark, d))["unpriced_models"]


# content by source: one row for each event and source
_PARTS = """pt AS (
  SELECT ev.*, f.disc, f.row_id, x.source, x.n AS part_chars, x.part FROM ev JOIN f ON ev.file = f.file, LATERAL (VALUES
    ('UserPrompts', CASE WHEN kind = 'User' THEN chars ELSE 0 END, 0), ('ToolResults', CASE WHEN kind = 'ToolResult' THEN chars ELSE 0 END, 0),
    ('Attachments', CASE WHEN kind = 'Attachment' THEN chars ELSE 0 END, 0),
    ('AssistantText', CASE WHEN kind = 'Assistant' THEN greatest(chars - thinking_chars - coalesce(nullif(split_part(tools, '/', 3), '')::BIGINT, 0), 0) ELSE 0 END, 0),
    ('Thinking', CASE WHEN kind = 'Assistant' THEN thinking_chars ELSE 0 END, 1),
    ('ToolCalls', CASE WHEN kind = 'Assistant' THEN coalesce(nullif(split_part(tools, '/', 3), '')::BIGINT, 0) ELSE 0 END, 2)
  ) x(source, n, part) WHERE x.n > 0
)"""
_FILL = """fi AS (
  SELECT file, max(w) AS peak_fill, arg_max(w, line_no) AS final_fill, arg_min(coalesce(cache_read = 0, false), line_no) AS cold_start,
         arg_min(CASE WHEN cache_read = 0 THEN coalesce(input, 0) + coalesce(cache_creation, 0) ELSE -1 END, line_no) AS overhead
  FROM (SELECT *, coalesce(input, 0) + coalesce(cache_read, 0) + coalesce(cache_creation, 0) AS w FROM ev WHERE kind = 'Assistant' AND billed) GROUP BY 1
), cs AS (
  SELECT f.file AS session_id, f.row_id, f.disc, peak_fill, final_fill, cold_start, nullif(overhead, -1) AS startup_overhead, compactions, coalesce(content, 0) AS content_chars
  FROM f LEFT JOIN fi ON f.file = fi.file JOIN (SELECT file, count(*) FILTER (kind = 'Compaction') AS compactions FROM ev GROUP BY 1) n ON f.file = n.file
  LEFT JOIN (SELECT file, sum(part_chars)::BIGINT AS content FROM pt GROUP BY 1) p ON f.file = p.file
  WHERE peak_fill IS NOT NULL OR content IS NOT NULL
)"""
CONTEXT = f"{BASE}, {_CALLS}, {_PARTS}, {_FILL}"


def _sessions(frame: DataFrame) -> DataFrame:
    return frame.select("session_id", "row_id", "peak_fill", "final_fill", "cold_start", "startup_overhead", "compactions", "content_chars")


@query(f"{CONTEXT} SELECT * EXCLUDE (disc) FROM cs", "peak_fill final_fill cold_start startup_overhead")
def log_context_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(R.context(books(spark, d))["sessions"])


@query(f"{CONTEXT} SELECT source, sum(part_chars)::BIGINT AS chars, sum(part_chars)::BIGINT // 4 AS est_tokens, sum(part_chars)::DOUBLE / sum(sum(part_chars)) OVER ()::DOUBLE AS share FROM pt GROUP BY 1")
def log_context_sources(spark: SparkSession, d: str) -> DataFrame:
    return R.context(books(spark, d))["sources"]


@query(f"""{CONTEXT} SELECT file, source, sum(part_chars)::BIGINT AS chars, sum(part_chars)::BIGINT // 4 AS est_tokens,
       sum(part_chars)::DOUBLE / sum(sum(part_chars)) OVER (PARTITION BY file)::DOUBLE AS share FROM pt GROUP BY 1, 2""")
def log_context_session_sources(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d)
    names = b.logs.files.select("file_id", F.col("session_id").alias("file"))
    return R.context(b)["session_sources"].join(names, "file_id").drop("file_id")


@query(f"""{CONTEXT} SELECT row_id, source, sum(part_chars)::BIGINT AS chars, sum(part_chars)::BIGINT // 4 AS est_tokens,
       sum(part_chars)::DOUBLE / sum(sum(part_chars)) OVER (PARTITION BY row_id)::DOUBLE AS share FROM pt GROUP BY 1, 2""")
def log_context_row_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sub-agents' content counts towards their parent's row."""
    return R.context(books(spark, d))["row_sources"]


@query(f"""{CONTEXT}, o AS (SELECT id, server FROM c), a AS (
  SELECT coalesce(server, '(built-in)') AS server, 1 AS calls, bytes, 0 AS result FROM c
  UNION ALL SELECT coalesce(o.server, '(built-in)'), 0, 0, chars FROM ev LEFT JOIN o ON tool_use_id = id WHERE kind = 'ToolResult'
) SELECT server, sum(calls)::BIGINT AS calls, sum(bytes)::BIGINT AS call_bytes, sum(result)::BIGINT AS result_chars, (sum(bytes) + sum(result))::BIGINT // 4 AS est_tokens FROM a GROUP BY 1""")
def log_context_servers(spark: SparkSession, d: str) -> DataFrame:
    return R.context(books(spark, d))["servers"]


@query(f"""{CONTEXT}, h AS (
  SELECT pt.file AS session_id, source, part_chars AS chars, pt.disc, line_no, sub_seq, part, tool_use_id AS ref, summary, NULL AS tool FROM pt WHERE source IN ('UserPrompts', 'ToolResults', 'AssistantText', 'Thinking')
  UNION ALL SELECT file, 'ToolCalls', bytes, disc, line_no, 0, 2, NULL, NULL, name FROM c
) SELECT session_id, source, coalesce(tool, CASE WHEN source = 'ToolResults' THEN (SELECT name FROM c WHERE c.id = ref AND (c.disc < h.disc OR (c.disc = h.disc AND c.line_no < h.line_no))) END,
       CASE source WHEN 'ToolResults' THEN 'tool result' WHEN 'Thinking' THEN 'thinking' END, summary, '(no text)') AS label, chars, chars // 4 AS est_tokens
FROM h ORDER BY chars DESC, session_id, disc, line_no, sub_seq, part LIMIT 12""")
def log_context_heaviest(spark: SparkSession, d: str) -> DataFrame:
    return R.context(books(spark, d))["heaviest"]


@query(f"""{CONTEXT} SELECT coalesce(max(item_count) FILTER (attachment_kind = 'deferred_tools_delta'), 0) AS deferred_tools, coalesce(max(item_count) FILTER (attachment_kind = 'skill_listing'), 0) AS skills,
       coalesce(sum(chars) FILTER (attachment_kind = 'mcp_instructions_delta'), 0)::BIGINT AS mcp_instruction_chars, coalesce(sum(chars) FILTER (kind = 'Attachment'), 0)::BIGINT AS attachment_chars,
       (SELECT coalesce(string_agg(DISTINCT server, ',' ORDER BY server), '') FROM c) AS mcp_servers, count(*) FILTER (kind = 'Compaction') AS compactions FROM ev""")
def log_context_inventory(spark: SparkSession, d: str) -> DataFrame:
    return R.context(books(spark, d))["inventory"].withColumn("mcp_servers", F.array_join("mcp_servers", ","))


@query(f"{CONTEXT} SELECT session_id, startup_overhead FROM cs WHERE startup_overhead IS NOT NULL ORDER BY startup_overhead DESC, disc LIMIT 1")
def log_context_max_overhead(spark: SparkSession, d: str) -> DataFrame:
    return R.context(books(spark, d))["max_overhead"]


@query(f"{CONTEXT} SELECT source, sum(part_chars)::BIGINT AS chars FROM pt WHERE row_id = (SELECT min(row_id) FROM f) GROUP BY 1")
def log_drilldown_context(spark: SparkSession, d: str) -> DataFrame:
    """The third level: what fills the window of one session."""
    b = books(spark, d)
    row = b.logs.files.agg(F.min("row_id")).head()[0]
    return R.context_of(b, row)["sources"].select("source", "chars")


ORDER = "tokens DESC, coalesce(micro, 0) DESC, file, request_id ASC NULLS FIRST, disc, first_line"


@query(f"""{BASE} SELECT count(*) AS requests, sum(tokens)::BIGINT AS tokens, coalesce(sum(micro), 0)::DOUBLE / 1e6 AS cost_usd, coalesce(bool_or(micro IS NULL), false) AS any_unpriced FROM r""")
def log_anomalies_totals(spark: SparkSession, d: str) -> DataFrame:
    return R.anomalies(books(spark, d))["totals"]


@query(f"""{BASE}, k AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS n, count(*) OVER () AS all_ FROM r), fr AS (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE, 0.10::DOUBLE, 0.25::DOUBLE]) AS fraction)
SELECT fraction, count(*) AS requests, sum(tokens)::BIGINT AS tokens, coalesce(sum(micro), 0)::DOUBLE / 1e6 AS cost_usd, sum(tokens)::DOUBLE / (SELECT sum(tokens) FROM r)::DOUBLE AS token_share,
       (coalesce(sum(micro), 0)::DOUBLE / 1e6) / ((SELECT sum(micro) FROM r)::DOUBLE / 1e6) AS cost_share
FROM k JOIN fr ON n <= least(greatest(ceil(fraction * all_), 1), all_) GROUP BY 1""")
def log_anomalies_concentration(spark: SparkSession, d: str) -> DataFrame:
    return R.anomalies(books(spark, d))["concentration"]


@query(f"""{BASE} SELECT file AS session_id, project, request_id, model, ts, tokens, micro::DOUBLE / 1e6 AS cost_usd, sidechain, has_thinking, tokens::DOUBLE / (SELECT sum(tokens) FROM r)::DOUBLE AS token_share,
       (micro::DOUBLE / 1e6) / ((SELECT sum(micro) FROM r)::DOUBLE / 1e6) AS cost_share FROM r ORDER BY {ORDER} LIMIT 15""", "ts")
def log_anomalies_heaviest(spark: SparkSession, d: str) -> DataFrame:
    return micros(R.anomalies(books(spark, d))["heaviest"], "ts")


@query(f"""{BASE}, g AS (SELECT *, ts // 1000000 - lag(ts // 1000000) OVER (PARTITION BY file ORDER BY ts) > 43200 AS opens FROM r WHERE ts IS NOT NULL),
n AS (SELECT *, sum(CASE WHEN coalesce(opens, true) THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT file AS session_id, arg_min(project, ts) AS project, min(ts) AS "start", max(ts) AS "end", count(*) AS requests, sum(tokens)::BIGINT AS tokens, sum(micro)::DOUBLE / 1e6 AS cost_usd, count(*) FILTER (has_thinking) AS thinking_requests,
       max(ts) // 1000000 - min(ts) // 1000000 AS span_seconds FROM n GROUP BY file, run HAVING count(*) >= 3""")
def log_anomalies_storms(spark: SparkSession, d: str) -> DataFrame:
    """Requests of a session that follow each other within half a day, three or more."""
    return micros(R.anomalies(books(spark, d), gap_s=43200, least=3)["storms"], "start", "end")


def _classify_sql() -> str:
    words = {t: [f"max(CASE WHEN contains(p, '{w}') THEN 1 ELSE 0 END)" for w in ws] for t, ws in K.KEYWORDS.items()}
    hits = ", ".join(f"2.0 * coalesce({' + '.join(ws)}, 0) AS h{i}" for i, ws in enumerate(words.values()))
    found = ", ".join("concat_ws('|', " + ", ".join(f"CASE WHEN max(CASE WHEN contains(p, '{w}') THEN 1 ELSE 0 END) = 1 THEN 'prompt keyword: \"{w}\"' END" for w in ws) + f") AS w{i}" for i, ws in enumerate(K.KEYWORDS.values()))
    n = {t: " + ".join(f"(name = '{x}')::INT" for x in names) for t, names in K.TOOLS.items()}
    counts = ", ".join(f"coalesce(sum({e}), 0) AS n_{t.lower()}" for t, e in n.items())
    bonus = {
        "Debugging": "CASE WHEN n_bash >= 3 AND n_edit >= 1 THEN 3.0 WHEN n_bash >= 1 AND n_edit >= 1 THEN 1.0 ELSE 0 END",
        "FeatureWork": "CASE WHEN n_write >= 1 AND n_edit >= 1 THEN 3.0 WHEN n_write >= 1 THEN 1.5 ELSE 0 END",
        "Refactoring": "CASE WHEN n_edit >= 3 AND n_write = 0 THEN 3.0 ELSE 0 END",
        "Exploration": "CASE WHEN n_read + n_grep + n_glob > 0 AND n_edit = 0 AND n_write = 0 THEN 3.0 ELSE 0 END",
    }
    size = len(K.KEYWORDS)
    scores = ", ".join(f"h{i} + {bonus.get(t, '0')} AS s{i}, {bonus.get(t, '0')} AS b{i}" for i, t in enumerate(K.KEYWORDS))
    best = f"greatest({', '.join(f's{i}' for i in range(size))})"
    pick = lambda x, other: f"CASE WHEN {best} = 0 THEN {other} " + " ".join(f"WHEN s{i} = {best} THEN {x(i, t)}" for i, t in enumerate(K.KEYWORDS)) + " END"
    mix = "'tool mix: ' || concat_ws(', ', " + ", ".join(f"CASE WHEN n_{t.lower()} > 0 THEN n_{t.lower()} || ' {t}' END" for t in K.TOOLS) + ")"
    signal = pick(lambda i, _: f"concat_ws('|', nullif(w{i}, ''), CASE WHEN b{i} > 0 THEN {mix} END)", "''")
    return f"""{BASE}, {_CALLS}, {_ROWS}, ch AS (SELECT row_id, arg_min(file, {{'a': parent IS NOT NULL, 'b': disc}}) AS file FROM f GROUP BY 1),
pm AS (SELECT ch.row_id, lower(summary) AS p FROM ch JOIN ev ON ch.file = ev.file WHERE kind = 'User'),
hw AS (SELECT ch.row_id, {hits}, {found} FROM ch LEFT JOIN pm ON ch.row_id = pm.row_id GROUP BY 1),
nt AS (SELECT ch.row_id, {counts} FROM ch LEFT JOIN c ON ch.file = c.file GROUP BY 1),
sp AS (SELECT row_id, {rollup()} FROM r GROUP BY 1),
sc AS (SELECT sp.*, rw.project, rw.model, hw.* EXCLUDE (row_id), nt.* EXCLUDE (row_id), {scores} FROM sp JOIN rw ON sp.row_id = rw.row_id JOIN hw ON sp.row_id = hw.row_id JOIN nt ON sp.row_id = nt.row_id),
se AS (SELECT row_id AS id, project, model, {', '.join(ROLLUP)}, input + output + cache_creation + cache_read AS tokens, {pick(lambda _, t: f"'{t}'", "'Unknown'")} AS task_type,
       CASE WHEN {best} = 0 THEN 0.0 ELSE ({best})::DOUBLE / ({' + '.join(f's{i}' for i in range(size))})::DOUBLE END::DOUBLE AS confidence, {signal} AS signals FROM sc)"""


_CLASSIFY = _classify_sql()


@query(f"{_CLASSIFY} SELECT * FROM se")
def log_classify_sessions(spark: SparkSession, d: str) -> DataFrame:
    return R.classify(books(spark, d))["sessions"].withColumn("signals", F.array_join("signals", "|"))


@query(f"""{_CLASSIFY} SELECT task_type, count(*) AS sessions, {', '.join(f'sum({c})::BIGINT AS {c}' for c in (*ROLLUP, 'tokens') if c != 'cost_usd')}, sum(cost_usd::DECIMAL(38,9))::DOUBLE AS cost_usd,
       sum(tokens)::DOUBLE / sum(sum(tokens)) OVER ()::DOUBLE AS token_share FROM se GROUP BY 1""")
def log_classify_by_type(spark: SparkSession, d: str) -> DataFrame:
    got = R.classify(books(spark, d))["by_type"]
    return got.select("task_type", "sessions", *[c for c in ROLLUP if c != "cost_usd"], "tokens", F.round("cost_usd", 9).alias("cost_usd"), "token_share")


@query(f"{_CLASSIFY} SELECT count(*) AS sessions, sum(tokens)::BIGINT AS tokens, sum(unpriced_requests) > 0 AS any_unpriced, sum(cost_usd::DECIMAL(38,9))::DOUBLE AS cost_usd FROM se")
def log_classify_totals(spark: SparkSession, d: str) -> DataFrame:
    return R.classify(books(spark, d))["totals"].withColumn("cost_usd", F.round("cost_usd", 9))


def _flame_sql(leaves: dict[str, str], where: str) -> str:
    flat = " UNION ALL ".join(f"SELECT project, row_id, model, '{k}' AS leaf, {e} AS w FROM r WHERE {where}" for k, e in leaves.items())
    return f"""{BASE}, fl_ AS ({flat}) SELECT coalesce(project, '(unknown project)') || '/' || left(row_id, 8) || '/' || coalesce(model, '(unknown)') || '/' || leaf AS path, round(sum(w))::BIGINT AS value
FROM fl_ WHERE w > 0 GROUP BY 1 HAVING round(sum(w)) > 0"""


@query(_flame_sql({"input": "input", "output": "output", "cache-read": "cache_read", "cache-write": "cache_creation"}, "true"))
def log_flame_tokens(spark: SparkSession, d: str) -> DataFrame:
    return R.flame(books(spark, d))["stacks"].select(F.array_join("frames", "/").alias("path"), "value")


@query(_flame_sql({"input": "m_in", "output": "m_out", "cache-read": "m_read", "cache-write": "m_write"}, "micro IS NOT NULL"))
def log_flame_cost(spark: SparkSession, d: str) -> DataFrame:
    return R.flame(books(spark, d), "cost")["stacks"].select(F.array_join("frames", "/").alias("path"), "value")


@query(f"""{BASE} SELECT project || ';' || coalesce(replace(model, ' ', '_'), '(unknown)') || ' ' || sum(tokens)::BIGINT AS line FROM r GROUP BY project, model HAVING sum(tokens) > 0""")
def log_flame_folded(spark: SparkSession, d: str) -> DataFrame:
    """Two dimensions only, as lines."""
    return R.folded(R.flame(books(spark, d), dims=("project", "model")))


@query(f"""{BASE} SELECT (SELECT coalesce(sum(tokens), 0) FROM r)::BIGINT AS tokens, (SELECT count(*) FROM r WHERE micro IS NULL) AS unpriced_requests""")
def log_flame_header(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d)
    return R.flame(b)["header"].select(F.col("total").alias("tokens")).crossJoin(R.flame(b, "cost")["header"].select("unpriced_requests"))


@query(f"""{BASE}, {_ROWS}, s AS (SELECT row_id, {rollup()} FROM r GROUP BY 1)
SELECT s.* EXCLUDE (row_id), s.row_id AS id, project, coalesce(model, any_model) AS model, epoch_us(coalesce(started, any_started)) AS started_at, sub_agents, 'claude-code' AS agent FROM s JOIN rw ON s.row_id = rw.row_id""", "started_at")
def log_drilldown_sessions(spark: SparkSession, d: str) -> DataFrame:
    return micros(R.drilldown(books(spark, d))["sessions"], "started_at")


@query(f"""{BASE}, n AS (SELECT file, request_id, arg_min(summary, line_no) FILTER (summary <> '') AS summary FROM ev WHERE kind = 'Assistant' AND request_id IS NOT NULL GROUP BY 1, 2),
t AS (SELECT file, request_id, string_agg(name, ',' ORDER BY line_no) AS tools FROM (
  SELECT file, request_id, split_part(tools, '/', 2) AS name, min(line_no) AS line_no FROM ev WHERE kind = 'Assistant' AND request_id IS NOT NULL AND tools <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT r.file AS session_id, r.request_id, r.row_id, r.ts, r.tokens, r.micro::DOUBLE / 1e6 AS cost_usd, n.summary, coalesce(t.tools, '') AS tools
FROM r LEFT JOIN n ON r.file = n.file AND r.request_id = n.request_id LEFT JOIN t ON r.file = t.file AND r.request_id = t.request_id""", "ts")
def log_drilldown_turns(spark: SparkSession, d: str) -> DataFrame:
    got = R.drilldown(books(spark, d))["turns"]
    return micros(got, "ts").select("session_id", "request_id", "row_id", "ts", F.col("known_total").alias("tokens"), "cost_usd", "summary", F.array_join("tools", ",").alias("tools"))


def _of_others(source: str) -> None:
    """Events and files of a source; of the one that starts with a header also when its sessions began."""
    base, timed = T.other_sql(source), source == "gemini"

    def events(spark: SparkSession, d: str) -> DataFrame:
        return T.events_of(T.logs(spark, d, source))

    def files(spark: SparkSession, d: str) -> DataFrame:
        got = T.logs(spark, d, source).files.select(F.col("session_id").alias("file"), "project", "model", "skipped_lines", *(["started_at"] if timed else []))
        return micros(got, "started_at") if timed else got

    events.__name__, files.__name__ = f"log_{source}_events", f"log_{source}_files"
    query(f"{base} SELECT * FROM ev", f"ts thinking {_COUNTERS}")(events)
    query(f"{base} SELECT file, project, model, skipped_lines{', started_at' if timed else ''} FROM f", "started_at" if timed else "")(files)


for _source in T.OTHERS:
    _of_others(_source)


@query(f"{T.other_sql('codex')} SELECT file AS id, count(*) AS requests, coalesce(sum(input), 0)::BIGINT AS input, coalesce(sum(output), 0)::BIGINT AS output, count(*) AS unpriced FROM ev WHERE billed GROUP BY 1")
def log_codex_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Lines without a request id are requests of their own; none of these models has a price."""
    got = R.summary(R.Books.open(T.logs(spark, d, "codex")))["by_session"]
    return got.select("id", "requests", "input", "output", F.col("unpriced_requests").alias("unpriced"))


@query("SELECT 0::BIGINT AS requests, count(DISTINCT user_id) AS sessions FROM events")
def log_copilot_spends_nothing(spark: SparkSession, d: str) -> DataFrame:
    report = R.summary(R.Books.open(T.logs(spark, d, "copilot")))
    return report["totals"].select("requests").crossJoin(report["health"].select(F.col("sessions_parsed").alias("sessions")))
