"""The reports: functions from logs to named DataFrames. One-row frames hold the headers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.operators import attribution, classify as K, dedup, flame as L, ranking, rollup
from ledgerloom.operators.pricing import micro_usd_terms, price_table, usd, with_cost
from ledgerloom.sources.base import Logs

Report = dict[str, DataFrame]

def _seq() -> Column:
    """An event's place in its file."""
    return F.struct("line_no", "sub_seq")


@dataclass
class Books:
    """Logs with their priced requests, which reports share. ``cache`` keeps the requests for several."""

    logs: Logs
    requests: DataFrame
    since: str | None = None

    @classmethod
    def open(cls, logs: Logs, since: str | None = None, overrides: dict | None = None, cache: bool = False) -> Books:
        reqs = with_cost(dedup.requests(logs.events, logs.files, since), price_table(logs.files.sparkSession, overrides))
        return cls(logs, reqs.cache() if cache else reqs, since)

    def close(self) -> None:
        """Give back what is cached for this report; ``logs`` stay open."""
        self.requests.unpersist()

    def events(self) -> DataFrame:
        return self.logs.events.where(X.in_window("ts", self.since))


def _rows(files: DataFrame) -> DataFrame:
    """A row per session with sub-agents' files folded in: its parent's metadata, or what its files offer."""
    own = F.col("parent_session").isNull()
    last = lambda c: F.max_by(F.when(own, F.struct(F.col(c))), F.when(own, F.struct(F.negative(F.unix_micros("modified")).alias("a"), F.col("path"))))[c]
    return files.groupBy("row_id").agg(
        F.coalesce(last("project"), F.min_by("project", F.when(F.col("project").isNotNull(), F.col("disc")))).alias("project"),
        last("model").alias("model"), last("started_at").alias("started_at"), F.first("agent").alias("agent"),
        F.greatest(F.sum(F.when(own, F.col("spawn_calls")).otherwise(0)), F.count_if(~own)).alias("sub_agents"),
    )


def summary(books: Books) -> Report:
    """Spend in total, by model, day, session and tool, and the state of the logs."""
    reqs, files, events = books.requests, books.logs.files, books.events()
    sessions = reqs.groupBy("row_id").agg(*rollup.rollup_aggs(), X.zero(F.sum(F.when(F.col("sidechain"), F.col("known_total")))).alias("sub_agent_tokens"))
    by_session = sessions.where("requests > 0").join(_rows(files), "row_id").withColumnRenamed("row_id", "id")
    calls = events.select(_seq().alias("seq"), "file_id", F.explode("tool_calls").alias("c"))
    calls = calls.select("c.*", F.struct("file_id", "seq").alias("at"))
    return {
        "totals": reqs.agg(*rollup.rollup_aggs()),
        "sidechain": reqs.agg(*rollup.rollup_aggs(F.col("sidechain"))),
        "by_model": rollup.by(reqs, model=F.coalesce("model", F.lit(X.UNKNOWN_MODEL))),
        "by_day": rollup.by(reqs.where("ts IS NOT NULL"), day=F.to_date("ts")),
        "by_session": by_session.orderBy(*rollup.costliest_first()),
        "by_tool": calls.groupBy("name").agg(
            F.count(F.lit(1)).alias("calls"), F.sum("input_bytes").alias("input_bytes"), X.first_by("server", "at").alias("server")
        ).orderBy("name"),
        "compactions": events.agg(F.count_if(F.col("kind") == "Compaction").alias("compactions")),
        "unpriced_models": reqs.where("model IS NOT NULL AND price IS NULL").select("model").distinct().orderBy("model"),
        "dedup": dedup.dedup_stats(reqs),
        "health": files.agg(F.count(F.lit(1)).alias("sessions_parsed"), X.zero(F.sum("skipped_lines")).alias("skipped_lines")).crossJoin(
            books.logs.failed.agg(F.count(F.lit(1)).alias("sessions_failed"))),  # one row each
    }


def top_tools(report: Report, n: int = 10) -> DataFrame:
    return report["by_tool"].orderBy(F.desc("calls"), "name").limit(n)


#: Where content comes from, in the order that breaks ties. Fixed values.
CONTENT = ("ToolResults", "ToolCalls", "AssistantText", "Thinking", "UserPrompts", "Attachments")


def _parts(events: DataFrame) -> DataFrame:
    """Content by source: one row per event and source with ``chars``; ``part`` is the order inside an event."""
    calls = F.aggregate("tool_calls", F.lit(0).cast("long"), lambda a, c: a + c["input_bytes"])
    chars, thinking = F.col("content_chars"), F.col("thinking_chars")
    speaks = F.col("kind").isin("Assistant", "ToolCall")
    of = lambda cond, source, n, part: F.struct(F.lit(source).alias("source"), F.when(cond, n).otherwise(0).alias("chars"), F.lit(part).alias("part"))
    kind = lambda k: F.col("kind") == k
    pieces = F.array(
        of(kind("User"), "UserPrompts", chars, 0), of(kind("ToolResult"), "ToolResults", chars, 0), of(kind("Attachment"), "Attachments", chars, 0),
        of(speaks, "AssistantText", F.greatest(chars - thinking - calls, F.lit(0)), 0), of(speaks, "Thinking", thinking, 1), of(speaks, "ToolCalls", calls, 2),
    )
    return events.withColumn("_p", F.explode(pieces)).where("_p.chars > 0").select("*", "_p.source", F.col("_p.chars").alias("chars"), "_p.part").drop("_p")


def context(books: Books, scope: Column | None = None, top: int = 12) -> Report:
    """What fills the context windows. ``scope``: a condition on files, for a report on some of them."""
    files = books.logs.files if scope is None else books.logs.files.where(scope)
    files = files.select("file_id", "session_id", "parent_session", "row_id", "project", "agent", F.col("model").alias("session_model"), "disc")
    events = books.events().join(files, "file_id").withColumn("seq", _seq())
    parts = _parts(events)
    rank = F.array_position(F.array(*[F.lit(c) for c in CONTENT]), F.col("source"))
    billed = events.where("kind = 'Assistant' AND usage IS NOT NULL").withColumn("fill", X.window_fill("usage."))
    fills = billed.groupBy("file_id").agg(
        F.max("fill").alias("peak_fill"), F.max_by("fill", "seq").alias("final_fill"), F.min_by("usage", "seq").alias("u"),
    ).select(
        "file_id", "peak_fill", "final_fill", F.coalesce(F.col("u.cache_read") == 0, F.lit(False)).alias("cold_start"),
        F.when(F.col("u.cache_read") == 0, X.zero("u.input") + X.zero("u.cache_creation")).alias("startup_overhead"),
    )
    per_file = events.groupBy("file_id").agg(F.count_if(F.col("kind") == "Compaction").alias("compactions"))
    per_file = per_file.join(parts.groupBy("file_id").agg(F.sum("chars").alias("content_chars")), "file_id", "left").join(fills, "file_id", "left")
    sessions = files.join(per_file, "file_id").where("peak_fill IS NOT NULL OR content_chars IS NOT NULL").withColumn("content_chars", X.zero("content_chars"))

    calls = events.select("file_id", "disc", "seq", "session_id", F.posexplode("tool_calls").alias("ix", "c")).select(
        "file_id", "disc", "seq", "session_id", "ix", "c.*").withColumn("server", F.coalesce("server", F.lit(X.BUILT_IN))).withColumn("at", F.struct("disc", "seq", "ix"))
    owner = calls.groupBy(F.col("id").alias("ref")).agg(F.max_by("server", "at").alias("server"), F.max_by("name", "at").alias("tool"))
    results = events.where("kind = 'ToolResult'").select(F.col("tool_use_id").alias("ref"), F.col("content_chars").alias("chars"))
    servers = attribution.attribute(calls.select("server", F.col("input_bytes").alias("bytes")), results, owner, "server")

    # a result bears the name of its call, if the call came before it
    heavy = parts.where("source IN ('UserPrompts', 'ToolResults', 'AssistantText', 'Thinking')").select(
        "session_id", "source", "chars", F.struct("disc", "seq").alias("place"), "part", F.lit(0).alias("ix"),
        F.when(F.col("kind") == "ToolResult", F.col("tool_use_id")).alias("ref"), F.col("content_summary").alias("text"), F.lit(None).cast("string").alias("tool"),
    ).unionByName(calls.where("input_bytes > 0").select(
        "session_id", F.lit("ToolCalls").alias("source"), F.col("input_bytes").alias("chars"), F.struct("disc", "seq").alias("place"), F.lit(2).alias("part"), "ix",
        F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("text"), F.col("name").alias("tool"),
    ))
    order = [F.desc("chars"), F.asc("session_id"), F.asc("place"), F.asc("part"), F.asc("ix")]
    head = heavy.orderBy(*order).limit(top)  # labels are only looked up for the few that stay
    named = calls.select(F.col("id").alias("_id"), F.struct("disc", "seq").alias("_place"), F.col("name").alias("_name"), "at")
    met = head.join(named, (F.col("ref") == F.col("_id")) & (F.col("_place") < F.col("place")), "left").groupBy(*head.columns).agg(F.max_by("_name", "at").alias("_name"))
    label = F.coalesce("tool", "_name", F.when(F.col("source") == "ToolResults", F.lit("tool result")), F.when(F.col("source") == "Thinking", F.lit("thinking")), "text", F.lit("(no text)"))
    heaviest = met.orderBy(*order).select("session_id", "source", label.alias("label"), "chars", X.est_tokens(F.col("chars")).alias("est_tokens"))

    att = F.col("kind") == "Attachment"
    most = lambda k: X.zero(F.max(F.when(att & (F.col("attachment_kind") == k), F.col("item_count"))))
    inventory = events.agg(
        most("deferred_tools_delta").alias("deferred_tools"), most("skill_listing").alias("skills"),
        X.zero(F.sum(F.when(att & (F.col("attachment_kind") == "mcp_instructions_delta"), F.col("content_chars")))).alias("mcp_instruction_chars"),
        X.zero(F.sum(F.when(att, F.col("content_chars")))).alias("attachment_chars"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_compact(F.transform("tool_calls", lambda c: c["server"])))))).alias("mcp_servers"),
        F.count_if(F.col("kind") == "Compaction").alias("compactions"),
    )
    return {
        "sessions": sessions.orderBy(F.desc_nulls_last("peak_fill"), "session_id").drop("disc"),
        "sources": attribution.by_group(parts, "source", "chars").orderBy(F.desc("chars"), rank),
        "session_sources": attribution.by_group(parts, "source", "chars", "file_id").orderBy("file_id", F.desc("chars"), rank),
        "row_sources": attribution.by_group(parts, "source", "chars", "row_id").orderBy("row_id", F.desc("chars"), rank),
        "servers": servers.orderBy(F.desc("est_tokens"), "server"),
        "heaviest": heaviest,
        "inventory": inventory,
        "max_overhead": sessions.where("startup_overhead IS NOT NULL").orderBy(F.desc("startup_overhead"), "disc").limit(1).select("session_id", "startup_overhead"),
    }


def context_of(books: Books, row_id: str) -> Report:
    """``context`` of one row of the sessions: its own file and its sub-agents'. (``row_sources`` has the sources of all rows.)"""
    return context(books, F.col("row_id") == row_id)


#: Seconds between the requests of a storm, and their least number. Fixed values.
STORM = {"gap_s": 15, "least": 5}


def anomalies(books: Books, top: int = 15, gap_s: int = STORM["gap_s"], least: int = STORM["least"]) -> Report:
    """Where spend is concentrated, the heaviest requests, and bursts of requests."""
    reqs = books.requests.withColumn("tokens", F.col("known_total")).withColumn("cost0", F.coalesce("micro_usd", F.lit(0)))
    sums = [
        F.count(F.lit(1)).alias("requests"), X.zero(F.sum("tokens")).alias("tokens"), F.coalesce(usd(F.sum("micro_usd")), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(F.bool_or(F.col("micro_usd").isNull()), F.lit(False)).alias("any_unpriced"),
    ]
    totals, t = reqs.agg(*sums), reqs.agg(*sums, ranking.splitters("tokens").alias("splitters")).head()
    order = [F.desc("tokens"), F.desc("cost0"), F.asc("session_id"), F.asc_nulls_first("request_id"), F.asc("file_id"), F.asc("first_seq")]
    tokens, cost = F.lit(t.tokens), F.lit(t.cost_usd)
    head = ranking.head_sums(reqs, "tokens", order, t.requests, {"tokens": "tokens", "micro": "micro_usd"}, found=t.splitters)
    concentration = head.select(
        "fraction", "requests", "tokens", F.coalesce(usd(F.col("micro")), F.lit(0.0)).alias("cost_usd"), X.share(F.col("tokens"), tokens).alias("token_share"),
        X.share_or_null(F.coalesce(usd(F.col("micro")), F.lit(0.0)), cost).alias("cost_share"),
    ).orderBy("fraction")
    heaviest = reqs.orderBy(*order).limit(top).select(
        "session_id", "project", "request_id", "model", "ts", "tokens", "cost_usd", "sidechain", "has_thinking", X.share(F.col("tokens"), tokens).alias("token_share"),
        X.share_or_null(F.col("cost_usd"), cost).alias("cost_share"),
    )
    storms = ranking.bursts(reqs, ["session_id"], "ts", gap_s, least, [
        F.min_by("project", "ts").alias("project"), F.sum("tokens").alias("tokens"), usd(F.sum("micro_usd")).alias("cost_usd"), F.count_if("has_thinking").alias("thinking_requests"),
    ])
    return {"totals": totals, "concentration": concentration, "heaviest": heaviest, "storms": storms.orderBy(F.desc("tokens"), "start", "session_id")}


def classify(books: Books) -> Report:
    """Sessions by what was asked and which tools were used."""
    files, events = books.logs.files, books.events()
    chosen = files.groupBy("row_id").agg(F.min_by("file_id", F.struct(F.col("parent_session").isNotNull(), F.col("disc"))).alias("file_id"))
    mine = events.join(chosen, "file_id")
    prompts = mine.where("kind = 'User'").groupBy("row_id").agg(F.collect_set(X.ascii_lower(F.col("content_summary"))).alias("prompts"))
    tools = mine.select("row_id", F.explode("tool_calls").alias("c")).select("row_id", "c.name").groupBy("row_id").agg(*K.tool_counts())
    spent = books.requests.groupBy("row_id").agg(*rollup.rollup_aggs()).where("requests > 0")
    rows = spent.join(_rows(files).select("row_id", "project", "model"), "row_id").join(prompts, "row_id", "left").join(tools, "row_id", "left")
    rows = rows.withColumn("prompts", F.coalesce("prompts", F.array().cast("array<string>"))).na.fill(0, [f"n_{t.lower()}" for t in K.TOOLS])
    sessions = K.classify(rows).drop("prompts", *[f"n_{t.lower()}" for t in K.TOOLS]).withColumnRenamed("row_id", "id").withColumn("tokens", X.rollup_total())
    types = sessions.groupBy("task_type").agg(F.count(F.lit(1)).alias("sessions"), *[F.sum(c).alias(c) for c in (*rollup.MEASURES, "tokens")])
    whole = W.partitionBy(F.lit(1))
    types = types.withColumn("token_share", X.share(F.col("tokens"), F.sum("tokens").over(whole))).withColumn(
        "cost_share", X.share_or_null(F.col("cost_usd"), F.sum("cost_usd").over(whole)))
    return {
        "totals": sessions.agg(F.count(F.lit(1)).alias("sessions"), X.zero(F.sum("tokens")).alias("tokens"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
                               (X.zero(F.sum("unpriced_requests")) > 0).alias("any_unpriced")),
        "by_type": types.orderBy(F.desc("cost_usd"), F.desc("tokens"), K.rank_of(F.col("task_type"))),
        "sessions": sessions.orderBy(F.desc("cost_usd"), F.desc("tokens"), "id"),
    }


DIMS = {
    "project": lambda: F.coalesce("project", F.lit("(unknown project)")), "session": lambda: X.short_id(F.col("row_id")),
    "model": lambda: F.coalesce("model", F.lit(X.UNKNOWN_MODEL)), "type": lambda: F.col("leaf"),
}


def flame(books: Books, metric: str = "tokens", dims: tuple[str, ...] = ("project", "session", "model", "type")) -> Report:
    """Stacks of tokens, or of millionths of a dollar (``metric='cost'``) of the priced requests."""
    if unknown := set(dims) - DIMS.keys():
        raise ValueError(f"unknown dimensions {sorted(unknown)}; known: {', '.join(DIMS)}")
    if metric == "cost":
        rows, leaves = books.requests.where("price IS NOT NULL"), micro_usd_terms()
    else:
        rows = books.requests
        leaves = {"input": X.zero("input"), "output": X.zero("output"), "cache-read": X.zero("cache_read"), "cache-write": X.zero("cache_creation"), "thinking": X.zero("thinking")}
    stacks = L.fold(L.unpivot(rows, leaves, F.col("project"), F.col("row_id"), F.col("model")), [DIMS[d]() for d in dims])
    unpriced = books.requests.agg((F.count_if(F.col("price").isNull()) if metric == "cost" else F.lit(0)).alias("unpriced_requests"))
    return {"stacks": stacks, "header": stacks.agg(X.zero(F.sum("value")).alias("total")).crossJoin(unpriced)}


def folded(report: Report) -> DataFrame:
    return report["stacks"].select(L.folded_line(F.col("frames"), F.col("value")).alias("line"))


def drilldown(books: Books) -> Report:
    """Sessions and their turns; ``context_of`` a session is the third level."""
    reqs, files = books.requests, books.logs.files
    said = books.events().where("kind = 'Assistant' AND request_id IS NOT NULL").withColumn("seq", _seq())
    notes = said.groupBy(F.col("file_id").alias("f"), F.col("request_id").alias("r")).agg(
        F.expr("min_by(content_summary, seq) FILTER (WHERE content_summary IS NOT NULL AND content_summary <> '')").alias("summary"),
        F.array_sort(F.collect_list(F.struct("seq", F.transform("tool_calls", lambda c: c["name"]).alias("names")))).alias("tools"),
    ).withColumn("tools", F.array_distinct(F.flatten(F.transform("tools", lambda t: t["names"]))))
    turns = reqs.join(notes, (F.col("file_id") == F.col("f")) & (F.col("request_id") == F.col("r")), "left")
    turns = turns.withColumn("tools", F.coalesce("tools", F.array().cast("array<string>"))).drop("f", "r", "price")
    per = reqs.groupBy("row_id").agg(*rollup.rollup_aggs()).where("requests > 0")
    any_file = files.groupBy("row_id").agg(*[F.min_by(c, "disc").alias(f"any_{c}") for c in ("model", "started_at")])
    rows = per.join(_rows(files), "row_id").join(any_file, "row_id")
    rows = rows.withColumn("model", F.coalesce("model", "any_model")).withColumn("started_at", F.coalesce("started_at", "any_started_at")).drop("any_model", "any_started_at")
    return {
        "sessions": rows.withColumnRenamed("row_id", "id").orderBy(*rollup.costliest_first()),
        "turns": turns.orderBy("row_id", F.asc_nulls_last("ts"), "disc", "first_seq"),
    }
