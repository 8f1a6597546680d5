"""Many log lines for one request become one row: counters merge by their maximum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X


def merge_lines(
    lines: DataFrame, by: list[str], order: str, maxima: list[str] = (), minima: list[str] = (), first: list[str] = (),
    sums: list[str] = (), ors: list[str] = (), extra: list[Column] = (),
) -> DataFrame:
    """One row per ``by``, with n_lines and first_seq. Every aggregate skips NULLs and combines
    before the shuffle; none depends on the order in which rows arrive."""
    aggs = [F.max(c).alias(c) for c in maxima] + [F.min(c).alias(c) for c in minima]
    aggs += [X.first_by(c, order).alias(c) for c in first] + [F.sum(c).alias(c) for c in sums] + [F.bool_or(c).alias(c) for c in ors]
    return lines.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("n_lines"), F.min(order).alias("first_seq"), *extra)


def encrypted() -> Column:
    """A request that thinks without showing what."""
    return F.col("has_thinking") & (F.col("thinking_chars") == 0)


def requests(events: DataFrame, files: DataFrame, since: str | None = None) -> DataFrame:
    """The fact table of every report on spend: one row per request of a file.

    Lines without a request id are requests of their own; files never share one. Columns: file_id,
    req_key, request_id, the seven counters, model, ts, thinking_chars, has_thinking, encrypted,
    sidechain, n_lines, naive_total (known tokens line by line), known_total, first_seq, and
    session_id, parent_session, row_id, project of the file.
    """
    lines = events.where((F.col("kind") == "Assistant") & F.col("usage").isNotNull() & X.in_window("ts", since)).select(
        "file_id", "request_id", "model", "ts", "thinking_chars", "has_thinking", "sidechain", "usage.*",
        F.struct("line_no", "sub_seq").alias("seq"),
        F.coalesce(F.concat(F.lit("r:"), "request_id"), F.concat_ws(":", F.lit("l"), "line_no", "sub_seq")).alias("req_key"),
    ).withColumn("naive_total", X.known_total())
    merged = merge_lines(
        lines, ["file_id", "req_key"], "seq", maxima=list(X.USAGE), minima=["ts"], first=["model", "request_id"],
        sums=["thinking_chars", "naive_total"], ors=["has_thinking", "sidechain"],
    )
    of = files.select("file_id", "session_id", "parent_session", "row_id", "project", "disc")
    return (
        merged.join(of, "file_id")
        .withColumn("sidechain", F.col("sidechain") | F.col("parent_session").isNotNull())
        .withColumn("encrypted", encrypted())
        .withColumn("known_total", X.known_total())
    )


def dedup_stats(reqs: DataFrame) -> DataFrame:
    """One row. Made from the requests alone, which carry what their lines came to."""
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    return reqs.agg(
        X.zero(F.sum(F.col("n_lines") - 1)).alias("duplicate_lines_collapsed"),
        X.zero(F.sum("naive_total")).alias("naive_known_tokens"),
        X.zero(F.sum("known_total")).alias("known_tokens"),
        n(F.col("has_thinking")).alias("requests_with_thinking"),
        n(F.col("encrypted")).alias("requests_with_encrypted_thinking"),
        X.zero(F.sum("thinking_chars")).alias("thinking_chars_total"),
    ).withColumns({
        "thinking_tokens_estimate": X.est_tokens(F.col("thinking_chars_total")),
        "overcount_percent": overcount_percent(F.col("naive_known_tokens"), F.col("known_tokens")),
    })


def overcount_percent(naive: Column, real: Column) -> Column:
    """By how much counting lines would overstate; NULL unless it does."""
    return F.when((naive > real) & (real > 0), (naive.cast("double") / real - 1) * 100)
