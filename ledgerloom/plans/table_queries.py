"""The engine's operators over the test tables, each with the SQL that says the same.

The tables are no agent logs, so operators get other columns' names: order lines stand for log lines,
customers for sessions, conversation roles for content sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.operators import attribution, classify, dedup, flame, pricing, ranking, rollup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MONEY = "decimal(18,2)"
MAXIMA = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with one key are one request."""
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", *MAXIMA, "l_returnflag", "l_linestatus", "l_shipdate",
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").alias("seq"),
    )
    return dedup.merge_lines(lines, ["l_orderkey", "l_linenumber"], "seq", maxima=MAXIMA, minima=["l_shipdate"], first=["l_returnflag", "l_linestatus"]).drop("first_seq")


_MERGED = """
SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice, max(l_discount) AS l_discount,
       max(l_tax) AS l_tax, min(l_shipdate) AS l_shipdate, arg_min(l_returnflag, o) AS l_returnflag, arg_min(l_linestatus, o) AS l_linestatus, count(*) AS n_lines
FROM (SELECT *, {'a': l_shipdate, 'b': l_partkey, 'c': l_suppkey, 'd': l_returnflag, 'e': l_linestatus} AS o FROM lineitem)
GROUP BY l_orderkey, l_linenumber
"""


@query(_MERGED)
def request_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)


@query(f"""
SELECT sum(n_lines - 1)::BIGINT AS collapsed, (SELECT sum(l_quantity)::BIGINT FROM lineitem) AS naive, sum(l_quantity)::BIGINT AS merged,
       (SELECT sum(l_quantity) FROM lineitem)::DOUBLE / sum(l_quantity)::DOUBLE * 100 - 100 > 0 AS overcounts
FROM ({_MERGED})
""")
def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    naive = table(spark, d, "lineitem").agg(F.sum("l_quantity").cast("long").alias("naive"))
    merged = _merged(spark, d).agg(F.sum(F.col("n_lines") - 1).alias("collapsed"), F.sum("l_quantity").cast("long").alias("merged"))
    both = merged.crossJoin(naive)  # two rows of totals
    return both.select("collapsed", "naive", "merged", (dedup.overcount_percent(F.col("naive"), F.col("merged")) > 0).alias("overcounts"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Merged order lines as requests: counters from quantity, tax and discount, the price as cost; some are unknown."""
    q, t = F.col("l_quantity").cast("long"), F.round(F.col("l_tax") * 100).cast("long")
    return _merged(spark, d).select(
        "l_orderkey", "l_returnflag", "l_shipdate", F.when(t != 3, q).alias("input"), t.alias("output"), F.when(q % 7 != 0, q * 2).alias("cache_creation"),
        F.round(F.col("l_discount") * 100).cast("long").alias("cache_read"), F.when(t != 5, F.col("l_extendedprice").cast("decimal(38,6)")).alias("micro_usd"),
    )


_REQS = f"""
(SELECT *, CASE WHEN t <> 3 THEN q END AS input, t AS output, CASE WHEN q % 7 <> 0 THEN q * 2 END AS cache_creation, CASE WHEN t <> 5 THEN l_extendedprice::DECIMAL(38,6) END AS micro
 FROM (SELECT *, l_quantity::BIGINT AS q, round(l_tax * 100)::BIGINT AS t, round(l_discount * 100)::BIGINT AS cache_read FROM ({_MERGED})))
"""
_CORE = ("input", "output", "cache_creation", "cache_read")
_SUMS = f"""count(*) AS requests, {', '.join(f'coalesce(sum({c}), 0)::BIGINT AS {c}' for c in _CORE)}, count(*) FILTER ({' OR '.join(f'{c} IS NULL' for c in _CORE)}) AS incomplete_requests,
coalesce(sum(micro)::DOUBLE / 1e6, 0) AS cost_usd, count(*) FILTER (micro IS NULL) AS unpriced_requests"""


@query(f"SELECT {_SUMS} FROM {_REQS}")
def rollup_totals(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d).agg(*rollup.rollup_aggs())


@query(f"SELECT l_returnflag AS model, {_SUMS} FROM {_REQS} GROUP BY 1 ORDER BY 1")
def rollup_by_model(spark: SparkSession, d: str) -> DataFrame:
    return rollup.by(_requests(spark, d), model=F.col("l_returnflag"))


@query(f"SELECT l_shipdate::DATE AS day, {_SUMS} FROM {_REQS} GROUP BY 1 ORDER BY 1")
def rollup_by_day(spark: SparkSession, d: str) -> DataFrame:
    return rollup.by(_requests(spark, d), day=F.to_date("l_shipdate"))


@query(f"""
SELECT coalesce(n_name, 'customer ' || o_custkey::VARCHAR) AS id, {_SUMS} FROM {_REQS}
JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 5 <> 0
GROUP BY 1
""")
def rollup_by_session_fold(spark: SparkSession, d: str) -> DataFrame:
    """Requests count towards their customer's nation, or towards the customer where it has none; the costliest first."""
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    parents = customer.join(nation.where("n_nationkey % 5 <> 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")
    rows = orders.join(parents, F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.select("o_orderkey", F.coalesce("n_name", F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))).alias("id"))
    met = _requests(spark, d).join(rows, F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy("id").agg(*rollup.rollup_aggs()).orderBy(*rollup.costliest_first())


@query("""
WITH m AS (
  SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'anthropic/' || p_brand WHEN 1 THEN substr(p_brand, 1, 7) || '-20250929' WHEN 2 THEN ' ' || substr(p_brand, 1, 7) || '@12345678' ELSE substr(p_brand, 1, 7) END AS model
  FROM part
), k(layer, key, rate) AS (VALUES (0, 'brand#1', 1.0), (0, 'brand#2', 2.0), (0, 'brand#3', 3.0), (1, 'brand#1', 9.0)),
n AS (SELECT model, regexp_replace(lower(trim(model)), '^(anthropic/|us[.]anthropic[.]|anthropic[.])', '') AS norm FROM m),
b AS (
  SELECT model, norm, rate, row_number() OVER (PARTITION BY model ORDER BY layer DESC NULLS LAST, length(key) DESC) AS r
  FROM n LEFT JOIN k ON norm = key OR (starts_with(norm, key) AND regexp_full_match(substr(norm, length(key) + 1), '[-@][0-9]{8,}'))
)
SELECT model, norm, rate::DOUBLE AS rate FROM b WHERE r = 1
""")
def pricing_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    brand, head = F.col("p_brand"), F.substring("p_brand", 1, 7)
    part = F.col("p_size") % 4
    model = F.when(part == 0, F.concat(F.lit("anthropic/"), brand)).when(part == 1, F.concat(head, F.lit("-20250929"))).when(
        part == 2, F.concat(F.lit(" "), head, F.lit("@12345678"))).otherwise(head)
    names = table(spark, d, "part").select(model.alias("model")).distinct()
    prices = pricing.price_table(spark, {" Brand#1 ": (9.0,) * 5}, {f"brand#{i}": (float(i),) * 5 for i in (1, 2, 3)})
    got = pricing.longest_prefix(names, pricing.normalize_model(F.col("model")), prices)
    return got.select("model", pricing.normalize_model(F.col("model")).alias("norm"), F.col("price.input").cast("double").alias("rate"))


@query("""
SELECT l_returnflag AS model, sum(CASE WHEN h IS NULL AND s IS NULL THEN q * 3.75 ELSE coalesce(s, 0) * 3.75 + coalesce(h, 0) * 6.0 END::DECIMAL(38,6))::DOUBLE / 1e6 AS write_usd
FROM (
  SELECT l_returnflag, l_quantity::BIGINT AS q, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity::BIGINT END AS s, CASE WHEN l_linenumber % 3 = 1 THEN l_quantity::BIGINT END AS h
  FROM lineitem
) GROUP BY 1
""")
def cache_write_cost(spark: SparkSession, d: str) -> DataFrame:
    """Cache writes by lifetime, where it is known."""
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber") % 3
    rows = table(spark, d, "lineitem").select(
        "l_returnflag", F.lit("claude-sonnet-4-5").alias("model"), q.alias("cache_creation"), F.when(n == 0, q).alias("cache_creation_5m"),
        F.when(n == 1, q).alias("cache_creation_1h"), *[F.lit(None).cast("long").alias(c) for c in ("input", "output", "cache_read", "thinking")],
    )
    priced = pricing.with_prices(rows, pricing.price_table(spark))
    out = priced.groupBy(F.col("l_returnflag").alias("g")).agg(F.sum(pricing.micro_usd_terms()["cache-write"].cast("decimal(38,6)")).alias("m"))
    return out.select(F.col("g").alias("model"), pricing.usd(F.col("m")).alias("write_usd"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts::DATE >= (SELECT max(ts)::DATE - 1 FROM events) GROUP BY 1")
def since_window(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    since = events.agg(F.date_sub(F.to_date(F.max("ts")), 1).cast("string")).head()[0]
    return events.where(X.in_window("ts", since)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH r AS (SELECT o_totalprice::DECIMAL(18,2) AS p, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k, count(*) OVER () AS n FROM orders),
f AS (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE, 0.10::DOUBLE, 0.25::DOUBLE]) AS fraction)
SELECT fraction, count(*) AS requests, sum(p)::DOUBLE AS total, sum(p)::DOUBLE / (SELECT sum(p) FROM r)::DOUBLE AS share
FROM r JOIN f ON k <= least(greatest(ceil(fraction * n), 1), n) GROUP BY 1 ORDER BY 1
""")
def fat_tail_concentration(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_totalprice").cast(MONEY).alias("p"))
    n, whole = orders.agg(F.count(F.lit(1)), F.sum("p")).head()
    head = ranking.head_sums(orders, "o_totalprice", [F.desc("o_totalprice"), F.asc("o_orderkey")], n, {"total": "p"})
    return head.select("fraction", "requests", F.col("total").cast("double").alias("total"), X.share(F.col("total"), F.lit(whole)).alias("share")).orderBy("fraction")


@query("""
SELECT o_orderkey, o_totalprice, o_totalprice::DECIMAL(18,2)::DOUBLE / (SELECT sum(o_totalprice::DECIMAL(18,2)) FROM orders)::DOUBLE AS share
FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15
""")
def heaviest_requests(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    whole = orders.agg(F.sum(F.col("o_totalprice").cast(MONEY))).head()[0]
    top = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)
    return top.select("o_orderkey", "o_totalprice", X.share(F.col("o_totalprice").cast(MONEY), F.lit(whole)).alias("share"))


def _storms_sql(gap: int, least: int) -> str:
    return f"""
WITH g AS (SELECT *, floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) > {gap} AS opens FROM events),
r AS (SELECT *, sum(CASE WHEN coalesce(opens, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, min(ts) AS "start", max(ts) AS "end", count(*) AS requests, sum(value::DECIMAL(18,2))::DOUBLE AS tokens,
       floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT AS span_seconds
FROM r GROUP BY user_id, run HAVING count(*) >= {least}
"""


@query(_storms_sql(43200, 5))
def retry_storms(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return ranking.bursts(events, ["user_id"], "ts", 43200, 5, [F.sum(F.col("value").cast(MONEY)).cast("double").alias("tokens")])


@query(_storms_sql(86400, 3))
def retry_storms_wide(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return ranking.bursts(events, ["user_id"], "ts", 86400, 3, [F.sum(F.col("value").cast(MONEY)).cast("double").alias("tokens")])


_ROLE = "CASE role WHEN 'user' THEN 'UserPrompts' WHEN 'assistant' THEN 'AssistantText' ELSE 'Attachments' END"


@query(f"""
SELECT source, chars, chars // 4 AS est_tokens, chars::DOUBLE / (sum(chars) OVER ())::DOUBLE AS share
FROM (SELECT {_ROLE} AS source, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1) WHERE chars > 0
""")
def context_by_source(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.expr(_ROLE).alias("source"), F.char_length("text").cast("long").alias("size"))
    return attribution.by_group(rows, "source", "size").select("source", "chars", "est_tokens", "share")


@query(f"""
SELECT conv_id, source, chars, chars // 4 AS est_tokens, chars::DOUBLE / (sum(chars) OVER (PARTITION BY conv_id))::DOUBLE AS share
FROM (SELECT conv_id, {_ROLE} AS source, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1, 2) WHERE chars > 0
""")
def context_by_session(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", F.expr(_ROLE).alias("source"), F.char_length("text").cast("long").alias("size"))
    return attribution.by_group(rows, "source", "size", "conv_id").select("conv_id", "source", "chars", "est_tokens", "share")


@query("""
WITH own AS (SELECT s_suppkey AS ref, n_name AS server FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 0),
both_ AS (
  SELECT server, 1 AS c, ref AS b, 0 AS r FROM own
  UNION ALL SELECT coalesce(server, '(built-in)'), 0, 0, l_quantity::BIGINT FROM lineitem LEFT JOIN own ON l_suppkey = ref
)
SELECT server, sum(c)::BIGINT AS calls, sum(b)::BIGINT AS call_bytes, sum(r)::BIGINT AS result_chars, (sum(b) + sum(r))::BIGINT // 4 AS est_tokens FROM both_ GROUP BY 1
""")
def result_attribution(spark: SparkSession, d: str) -> DataFrame:
    supplier, nation = table(spark, d, "supplier").where("s_suppkey % 3 <> 0"), table(spark, d, "nation")
    owner = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("ref"), F.col("n_name").alias("server"))
    calls = owner.select("server", F.col("ref").alias("bytes"))
    results = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ref"), F.col("l_quantity").cast("long").alias("chars"))
    return attribution.attribute(calls, results, owner, "server")


_LEAVES = {"input": "l_quantity", "output": "l_tax * 100", "cache-read": "l_discount * 100"}
_UNPIVOT = " UNION ALL ".join(f"SELECT l_returnflag AS flag, l_linestatus AS status, '{k}' AS leaf, round({e})::BIGINT AS w FROM lineitem" for k, e in _LEAVES.items())


def _stacks(spark: SparkSession, d: str, *frames: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), *[F.round(F.expr(e)).cast("long").alias(k) for k, e in _LEAVES.items()])
    flat = flame.unpivot(rows, {k: F.col(f"`{k}`") for k in _LEAVES}, F.col("flag"), F.col("status"))
    return flame.fold(flat, [F.col(f) for f in frames])


@query(f"SELECT flag || '/' || status || '/' || leaf AS path, sum(w)::BIGINT AS value FROM ({_UNPIVOT}) WHERE w > 0 GROUP BY 1 ORDER BY 1")
def flame_fold(spark: SparkSession, d: str) -> DataFrame:
    return _stacks(spark, d, "flag", "status", "leaf").select(F.array_join("frames", "/").alias("path"), "value")


@query(f"SELECT flag || '/' || status AS path, sum(w)::BIGINT AS value FROM ({_UNPIVOT}) WHERE w > 0 GROUP BY 1 ORDER BY 1")
def flame_fold_no_type(spark: SparkSession, d: str) -> DataFrame:
    return _stacks(spark, d, "flag", "status").select(F.array_join("frames", "/").alias("path"), "value")


@query("""
SELECT replace(regexp_replace(p_brand, '[ \t]', '_', 'g'), ';', ':') || ';' || regexp_replace(replace(p_type || ';x', ';', ':'), '[ \t]', '_', 'g') || ' ' || sum(p_size)::BIGINT AS line
FROM part GROUP BY p_brand, p_type
""")
def folded_lines(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumn("kind", F.concat("p_type", F.lit(";x")))
    stacks = flame.fold(part, [F.col("p_brand"), F.col("kind")], "p_size")
    return stacks.select(flame.folded_line(F.col("frames"), F.col("value")).alias("line"))


def _classify_sql() -> str:
    hits = lambda ws: " + ".join(f"max(CASE WHEN contains(s, '{w}') THEN 2.0 ELSE 0.0 END)" for w in ws)
    scores = ", ".join(f"{hits(ws)} AS s{i}" for i, ws in enumerate(classify.KEYWORDS.values()))
    n = len(classify.KEYWORDS)
    total = " + ".join(f"s{i}" for i in range(n))
    best = f"greatest({', '.join(f's{i}' for i in range(n))})"
    case = " ".join(f"WHEN s{i} = {best} THEN '{t}'" for i, t in enumerate(classify.KEYWORDS))
    return f"""
WITH p AS (SELECT conv_id, lower(left(trim(regexp_extract(text, '[^\\n]*\\S[^\\n]*')), 80)) AS s FROM conversations WHERE role = 'user'),
q AS (SELECT conv_id, {scores} FROM p GROUP BY conv_id)
SELECT conv_id, CASE WHEN {best} = 0 THEN 'Unknown' {case} END AS task_type, CASE WHEN {best} = 0 THEN 0.0 ELSE {best} / ({total}) END::DOUBLE AS confidence FROM q
"""


@query(_classify_sql())
def classify_conversations(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "conversations").where("role = 'user'").withColumn("s", F.expr(X.snippet_sql("text")))
    rows = said.groupBy("conv_id").agg(F.collect_set(X.ascii_lower(F.col("s"))).alias("prompts"))
    rows = rows.withColumns({f"n_{t.lower()}": F.lit(0) for t in classify.TOOLS})
    return classify.classify(rows).select("conv_id", "task_type", "confidence")


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase
FROM events
""")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("p", F.when(F.col("event_type") == "purchase", F.col("value")))
    return ranking.carry_forward(events, ["user_id"], ["ts", "event_id"], "p", "last_purchase").select("event_id", "last_purchase")


@query(r"SELECT doc_id, left(trim(regexp_extract(text, '[^\n]*[^\s][^\n]*')), 80) AS snippet FROM documents")
def snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.expr(X.snippet_sql("text")).alias("snippet"))


@query("""
SELECT p_partkey, CASE WHEN starts_with(name, 'mcp__') THEN split_part(name, '__', 2) END AS server
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'mcp__' || p_type || '__search' WHEN 1 THEN 'mcp__' || p_brand || '__bulk__insert' WHEN 2 THEN p_name ELSE 'xmcp__a__' || p_name END AS name FROM part)
""")
def mcp_server(spark: SparkSession, d: str) -> DataFrame:
    name = "CASE p_partkey % 4 WHEN 0 THEN 'mcp__' || p_type || '__search' WHEN 1 THEN 'mcp__' || p_brand || '__bulk__insert' WHEN 2 THEN p_name ELSE 'xmcp__a__' || p_name END"
    return table(spark, d, "part").select("p_partkey", F.expr(name).alias("name")).select("p_partkey", F.expr(X.server_sql("name")).alias("server"))


@query("SELECT p_partkey, left(p_name, 8) AS short_id FROM part")
def short_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.short_id(F.col("p_name")).alias("short_id"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def json_prop(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(CASE WHEN i IS NOT NULL THEN greatest(i - coalesce(c, 0), 0) END, -1) AS input, coalesce(c, -1) AS cache_read
FROM (SELECT *, CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity::BIGINT END AS i, CASE WHEN l_linenumber % 3 <> 0 THEN (l_tax * 400)::BIGINT END AS c FROM lineitem)
""")
def disjoint_usage(spark: SparkSession, d: str) -> DataFrame:
    """Input without what was cached, not below 0; unknown stays unknown (-1 here)."""
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity").cast("long")).alias("i"),
        F.when(F.col("l_linenumber") % 3 != 0, F.round(F.col("l_tax") * 400).cast("long")).alias("cache_read"),
    )
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.expr(X.less_sql("i", "cache_read")), F.lit(-1)).alias("input"), F.coalesce("cache_read", F.lit(-1)).alias("cache_read"))


@query("SELECT user_id, bool_or(event_type = 'purchase') AS has_thinking, bool_or(event_type = 'purchase') AND NOT bool_or(value > 50) AS encrypted, count(*) AS n_lines FROM events GROUP BY 1")
def encrypted_flags(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "events").select(
        "user_id", (F.col("event_type") == "purchase").alias("has_thinking"), (F.col("value") > 50).cast("long").alias("thinking_chars"), F.struct("ts", "event_id").alias("seq"))
    merged = dedup.merge_lines(lines, ["user_id"], "seq", sums=["thinking_chars"], ors=["has_thinking"])
    return merged.select("user_id", "has_thinking", dedup.encrypted().alias("encrypted"), "n_lines")
