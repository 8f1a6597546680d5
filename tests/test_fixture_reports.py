"""Reports over small invented logs, held against numbers worked out by hand."""

import math
from collections.abc import Callable

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import fixtures as X
from ledgerloom.plans import reports as R

CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], list[str], tuple]] = {}
USD = lambda c="cost_usd": F.round(c, 9).alias(c)


def query(columns: str, *rows: tuple):
    """The result that must come out, row by row."""

    def add(f):
        CASES[f.__name__] = f, columns.split(", "), rows
        return f

    return add


@pytest.mark.parametrize("name", [
    "fixture_summary_totals", "fixture_summary_since", "fixture_summary_sessions", "fixture_dedup_stats", "fixture_flame_totals", "fixture_concentration", "fixture_storms",
    "fixture_classify", "fixture_context_sessions", "fixture_context_servers", "fixture_codex", "fixture_gemini", "fixture_copilot",
])
def test_report(spark, name):
    make, columns, rows = CASES[name]
    got = sorted((tuple(r[c] for c in columns) for r in make(spark, "").collect()), key=repr)
    assert len(got) == len(rows)
    for x, y in zip(got, sorted(rows, key=repr), strict=True):
        assert all(math.isclose(p, q, rel_tol=1e-9) if isinstance(q, float) else p == q for p, q in zip(x, y, strict=True)), (x, y)
    spark.catalog.clearCache()


@query("requests, input, output, cache_creation, cache_read, incomplete_requests, unpriced_requests, cost_usd", (7, 3550, 670, 450, 13100, 2, 0, 0.02318))
def fixture_summary_totals(spark: SparkSession, d: str) -> DataFrame:
    got = R.summary(R.Books.open(X.logs(spark, "claude-code", X.SPEND)))["totals"]
    return got.select("requests", "input", "output", "cache_creation", "cache_read", "incomplete_requests", "unpriced_requests", USD())


@query("requests, input, output, duplicates", (2, 600, 190, 0))
def fixture_summary_since(spark: SparkSession, d: str) -> DataFrame:
    got = R.summary(R.Books.open(X.logs(spark, "claude-code", X.SPEND), since="2026-03-12"))
    return got["totals"].crossJoin(got["dedup"]).select("requests", "input", "output", F.col("duplicate_lines_collapsed").alias("duplicates"))


@query("id, requests, input, sub_agents, sub_agent_tokens", ("main-7a01", 5, 2950, 1, 510), ("side-3c02", 2, 600, 0, 0))
def fixture_summary_sessions(spark: SparkSession, d: str) -> DataFrame:
    got = R.summary(R.Books.open(X.logs(spark, "claude-code", X.SPEND)))["by_session"]
    return got.select("id", "requests", "input", "sub_agents", "sub_agent_tokens")


@query("duplicates, naive, known, thinking, encrypted", (1, 22700, 17770, 1, 0))
def fixture_dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    got = R.summary(R.Books.open(X.logs(spark, "claude-code", X.SPEND)))["dedup"]
    return got.select(
        F.col("duplicate_lines_collapsed").alias("duplicates"), F.col("naive_known_tokens").alias("naive"), F.col("known_tokens").alias("known"),
        F.col("requests_with_thinking").alias("thinking"), F.col("requests_with_encrypted_thinking").alias("encrypted"))


@query("metric, total", ("tokens", 17770), ("cost", 23180))
def fixture_flame_totals(spark: SparkSession, d: str) -> DataFrame:
    books = R.Books.open(X.logs(spark, "claude-code", X.SPEND))
    parts = [R.flame(books, m)["header"].select(F.lit(m).alias("metric"), "total") for m in ("tokens", "cost")]
    return parts[0].unionByName(parts[1])


@query(
    "fraction, requests, tokens, token_share", (0.01, 1, 154250, 154250 / 198220), (0.05, 1, 154250, 154250 / 198220), (0.1, 1, 154250, 154250 / 198220), (0.25, 3, 168490, 168490 / 198220)
)
def fixture_concentration(spark: SparkSession, d: str) -> DataFrame:
    got = R.anomalies(R.Books.open(X.logs(spark, "claude-code", X.ANOMALY)))["concentration"]
    return got.select("fraction", "requests", "tokens", "token_share")


@query("requests, tokens, span_seconds, cost_usd", (6, 42720, 33, 0.01764))
def fixture_storms(spark: SparkSession, d: str) -> DataFrame:
    return R.anomalies(R.Books.open(X.logs(spark, "claude-code", X.ANOMALY)))["storms"].select("requests", "tokens", "span_seconds", USD())


@query("id, task_type, requests, tokens", ("grow-0002", "FeatureWork", 2, 3550), ("mend-0001", "Debugging", 2, 1960), ("read-0003", "Exploration", 3, 1930), ("none-0004", "Unknown", 1, 155))
def fixture_classify(spark: SparkSession, d: str) -> DataFrame:
    return R.classify(R.Books.open(X.logs(spark, "claude-code", X.KINDS)))["sessions"].select("id", "task_type", "requests", "tokens")


@query("peak_fill, final_fill, startup_overhead, compactions", (15950, 15950, 15030, 1))
def fixture_context_sessions(spark: SparkSession, d: str) -> DataFrame:
    got = R.context(R.Books.open(X.logs(spark, "claude-code", X.CONTEXT)))["sessions"]
    return got.select("peak_fill", "final_fill", "startup_overhead", "compactions")


@query("server, calls, call_bytes, result_chars", ("stock-db", 1, 16, 466), ("(built-in)", 1, 25, 266), ("tickets", 1, 15, 136))
def fixture_context_servers(spark: SparkSession, d: str) -> DataFrame:
    return R.context(R.Books.open(X.logs(spark, "claude-code", X.CONTEXT)))["servers"].select("server", "calls", "call_bytes", "result_chars")


@query("requests, input, output, cache_read, unpriced_requests, naive, thinking, compactions, skipped", (4, 3950, 780, 1250, 4, 6090, 2, 1, 2))
def fixture_codex(spark: SparkSession, d: str) -> DataFrame:
    return _totals(spark, "codex", X.CODEX)


@query("requests, input, output, cache_read, unpriced_requests, naive, thinking, compactions, skipped", (2, 750, 65, 1000, 2, 1875, 1, 0, 2))
def fixture_gemini(spark: SparkSession, d: str) -> DataFrame:
    return _totals(spark, "gemini", X.GEMINI)


@query("requests, input, output, cache_read, unpriced_requests, naive, thinking, compactions, skipped", (0, 0, 0, 0, 0, 0, 0, 0, 2))
def fixture_copilot(spark: SparkSession, d: str) -> DataFrame:
    return _totals(spark, "copilot", X.COPILOT)


def _totals(spark: SparkSession, agent: str, files: dict[str, str]) -> DataFrame:
    got = R.summary(R.Books.open(X.logs(spark, agent, files)))
    one = got["totals"].crossJoin(got["dedup"]).crossJoin(got["compactions"]).crossJoin(got["health"])  # a row each
    return one.select(
        "requests", "input", "output", "cache_read", "unpriced_requests", F.col("naive_known_tokens").alias("naive"),
        F.col("requests_with_thinking").alias("thinking"), "compactions", F.col("skipped_lines").alias("skipped"))
