"""Sinks: JSON, text tables, folded stacks and an SVG flame graph.

Lists are read from the cluster row by row as they are written, so a report's length is not bound by the driver.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
from collections.abc import Callable, Iterable, Iterator
from html import escape
from typing import TextIO

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.operators.ranking import FRACTIONS
from ledgerloom.operators.rollup import MEASURES
from ledgerloom.plans import reports as R


def _plain(x: object) -> object:
    if isinstance(x, Row):
        return {k: _plain(v) for k, v in x.asDict().items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, dt.datetime):
        return x.astimezone(dt.UTC).replace(tzinfo=None).isoformat() + "Z"  # rows come in the driver's own time zone
    if isinstance(x, dt.date):
        return x.isoformat()
    return float(x) if isinstance(x, decimal.Decimal) else x


#: Frames of a report with one row; the others become lists.
ONE_ROW = {"totals", "sidechain", "dedup", "health", "inventory", "header", "compactions", "max_overhead"}


def as_dict(report: R.Report) -> dict:
    """All frames of a small report."""
    out: dict = {}
    for name, df in report.items():
        rows = [_plain(r) for r in df.drop("price", "disc", "micro_usd", "first_seq").collect()]
        out[name] = (rows[0] if rows else None) if name in ONE_ROW else rows
    return out


# -- JSON ----------------------------------------------------------------------------------------------------------------


def _pick(row: Row | dict | None, **names: str) -> dict:
    """Fields of a row under the names that JSON has for them."""
    return {k: _plain(row[c]) if row is not None else None for k, c in names.items()}


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def _rollup(row: Row | None) -> dict:
    return {m: _plain(row[m]) if row is not None else 0 for m in MEASURES}


def _each(df: DataFrame, make: Callable[[Row], object]) -> Iterator[object]:
    return (make(r) for r in df.toLocalIterator())


def _keyed(df: DataFrame, key: str, make: Callable[[Row], object]) -> Iterator[tuple[str, object]]:
    return ((str(_plain(r[key])), make(r)) for r in df.toLocalIterator())


def _summary(r: R.Report) -> dict:
    health, dedup = r["health"].head(), r["dedup"].head()
    session = lambda x: _pick(x, **_same("id", "project", "model", "started_at")) | {"rollup": _rollup(x)} | _pick(x, **_same("sub_agents", "sub_agent_tokens"))
    return {
        **_pick(health, **_same("sessions_parsed", "sessions_failed", "skipped_lines")),
        "dedup": _pick(dedup, **_same("duplicate_lines_collapsed", "naive_known_tokens", "requests_with_thinking", "requests_with_encrypted_thinking", "thinking_chars_total")),
        "totals": _rollup(r["totals"].head()), "sidechain_totals": _rollup(r["sidechain"].head()),
        "by_model": _keyed(r["by_model"], "model", _rollup), "by_day": _keyed(r["by_day"], "day", _rollup), "by_session": _each(r["by_session"], session),
        "by_tool": _keyed(r["by_tool"], "name", lambda x: _pick(x, **_same("calls", "input_bytes", "server"))),
        "unpriced_models": _each(r["unpriced_models"], lambda x: x.model), "compactions": r["compactions"].head().compactions,
    }


def _context(r: R.Report) -> dict:
    source = _same("source", "chars", "est_tokens", "share")
    own = r["session_sources"].groupBy(F.col("file_id").alias("f")).agg(F.collect_list(F.struct(*source)).alias("sources"))  # six at most
    sessions = r["sessions"].join(own, F.col("file_id") == F.col("f"), "left").orderBy(F.desc_nulls_last("peak_fill"), "session_id")
    inventory, most = r["inventory"].head(), r["max_overhead"].head()

    def session(x: Row) -> dict:
        by = sorted(x.sources or [], key=lambda s: (-s.chars, R.CONTENT.index(s.source)))
        return {
            **_pick(x, id="session_id", project="project", model="session_model"), "sidechain": x.parent_session is not None,
            "startup_overhead_tokens": x.startup_overhead, "cold_start": bool(x.cold_start), "peak_input_tokens": x.peak_fill, "final_input_tokens": x.final_fill,
            "sources": [_pick(s, **source) for s in by], "total_content_chars": x.content_chars, "compactions": x.compactions,
        }

    return {
        "sessions_profiled": r["sessions"].count(), "sessions": _each(sessions, session), "by_source": _each(r["sources"], lambda x: _pick(x, **source)),
        "by_server": _each(r["servers"], lambda x: _pick(x, server="server", calls="calls", call_chars="call_bytes", result_chars="result_chars", est_tokens="est_tokens")),
        "heaviest": _each(r["heaviest"], lambda x: _pick(x, **_same("source", "label", "session_id", "chars", "est_tokens"))),
        "mcp_servers": inventory.mcp_servers, **_pick(inventory, deferred_tools="deferred_tools", skills_listed="skills", mcp_instruction_chars="mcp_instruction_chars",
                                                      attachment_chars="attachment_chars", compactions="compactions"),
        "max_startup_overhead": [most.session_id, most.startup_overhead] if most else None,
    }


def _anomalies(r: R.Report) -> dict:
    return {
        **_pick(r["totals"].head(), requests_analyzed="requests", total_tokens="tokens", total_cost_usd="cost_usd", has_unpriced="any_unpriced"),
        "concentration": _each(r["concentration"], lambda x: _pick(x, request_fraction="fraction", requests="requests", token_share="token_share", cost_share="cost_share")),
        "heaviest": _each(r["heaviest"], lambda x: _pick(x, session_id="session_id", request_id="request_id", model="model", ts="ts", total_tokens="tokens", cost_usd="cost_usd",
                                                         cost_share="cost_share", token_share="token_share", sidechain="sidechain", has_thinking="has_thinking")),
        "retry_storms": _each(r["storms"], lambda x: _pick(x, session_id="session_id", project="project", started_at="start", ended_at="end", requests="requests", total_tokens="tokens",
                                                           cost_usd="cost_usd", span_seconds="span_seconds", thinking_requests="thinking_requests")),
        "storm_min_requests": R.STORM["least"], "storm_max_gap_seconds": R.STORM["gap_s"],
    }


def _classify(r: R.Report) -> dict:
    return {
        **_pick(r["totals"].head(), sessions_classified="sessions", total_tokens="tokens", total_cost_usd="cost_usd", has_unpriced="any_unpriced"),
        "by_task_type": _each(r["by_type"], lambda x: _pick(x, **_same("task_type", "sessions")) | {"rollup": _rollup(x)} | _pick(x, **_same("token_share", "cost_share"))),
        "sessions": _each(r["sessions"], lambda x: _pick(x, **_same("id", "project", "model", "task_type", "confidence", "signals")) | {"rollup": _rollup(x)}),
    }


def _drilldown(r: R.Report) -> dict:
    """Sessions, and the turns of all of them."""
    turn = _same("session_id", "request_id", "model", "ts", "input", "output", "cache_creation", "cache_read", "thinking", "cost_usd", "sidechain", "has_thinking", "encrypted", "summary", "tools")
    return {
        "sessions": _each(r["sessions"], lambda x: _pick(x, **_same("id", "project", "model", "started_at")) | {"rollup": _rollup(x)} | _pick(x, **_same("sub_agents"))),
        "turns": _each(r["turns"], lambda x: {"row": x.row_id} | _pick(x, **turn)),
    }


DOCUMENTS = {"summary": _summary, "context": _context, "anomalies": _anomalies, "classify": _classify, "drilldown": _drilldown}


def document(name: str, report: R.Report, agent: str, since: str | None = None) -> dict:
    """A report under the names that its JSON has; lists (pairs: objects) are still to be read."""
    first = {"agent": agent} | ({"generated_at": dt.datetime.now(dt.UTC).isoformat(timespec="seconds").replace("+00:00", "Z")} if name == "summary" else {}) | {"since": since}
    return first | DOCUMENTS[name](report)


def write_json(x: object, out: TextIO, depth: int = 0) -> None:
    """Indented JSON; iterators are written as they come, those of pairs as objects."""
    pad = "  " * (depth + 1)

    def many(items: Iterable, marks: str, write: Callable[[object], None]) -> None:
        n = 0
        for n, item in enumerate(items, 1):
            out.write((",\n" if n > 1 else f"{marks[0]}\n") + pad)
            write(item)
        out.write(f"\n{'  ' * depth}{marks[1]}" if n else marks)

    def pair(item: tuple[str, object]) -> None:
        out.write(json.dumps(item[0], ensure_ascii=False) + ": ")
        write_json(item[1], out, depth + 1)

    if isinstance(x, dict):
        many(x.items(), "{}", pair)
    elif isinstance(x, Iterator):
        items = iter(x)
        first = next(items, None)
        rest = (y for part in ([first] if first is not None else [], items) for y in part)
        if isinstance(first, tuple):
            many(rest, "{}", pair)
        else:
            many(rest, "[]", lambda y: write_json(y, out, depth + 1))
    elif isinstance(x, (list, tuple)):
        many(x, "[]", lambda y: write_json(y, out, depth + 1))
    else:
        out.write(json.dumps(x, ensure_ascii=False))


# -- text ----------------------------------------------------------------------------------------------------------------


def thousands(n: int) -> str:
    return f"{n:,}"


def cost(usd: float | None, unpriced: int = 0, requests: int = 1) -> str:
    """'?' where nothing is priced, a lower bound where something isn't."""
    if usd is None or (requests and unpriced >= requests):
        return "?"
    return ("≥$" if unpriced else "$") + (f"{usd:,.2f}" if usd >= 1 else f"{usd:.4f}")


def short(label: str | None, most: int = 40) -> str:
    label = label or ""
    return label if len(label) <= most else label[:most] + "…"


def _cell(column: str, row: Row) -> str:
    x = row[column]
    if column == "cost_usd":
        known = row.asDict()
        return cost(x, known.get("unpriced_requests") or 0, known.get("requests") or 0)
    if isinstance(x, bool):
        return "yes" if x else "no"
    if isinstance(x, int):
        return thousands(x)
    if x is not None and (column.endswith("share") or column in ("fraction", "confidence")):
        return f"{x:.1%}"
    if column in ("id", "session_id"):
        return short(x, 8).rstrip("…")
    return short("?" if x is None else ", ".join(x) if isinstance(x, list) else str(x))


def table(title: str, df: DataFrame, most: int = 10, columns: tuple[str, ...] = (), none: str = "(none)") -> str:
    """A section: its title and the first rows of some columns (all, unless named). Costs are shown with what is unpriced in their row."""
    rows = df.drop("price", "disc", "micro_usd", "first_seq").limit(most).collect()
    heads = list(columns) or [c for c in df.columns if c not in ("price", "disc", "micro_usd", "first_seq")]
    if not rows:
        return f"{title.upper()}\n{none}"
    cells = [[_cell(c, r) for c in heads] for r in rows]
    wide = [max(len(h), *(len(x[i]) for x in cells)) for i, h in enumerate(heads)]
    line = lambda xs: "  ".join(x.ljust(w) for x, w in zip(xs, wide, strict=True)).rstrip()
    return "\n".join([title.upper(), line(heads), line(["-" * w for w in wide]), *map(line, cells)])


def notes(*lines: str | None) -> list[str]:
    """A section of remarks, if there are any."""
    some = [f"• {x}" for x in lines if x]
    return ["\n".join(["NOTES", *some])] if some else []


_ROLLUP = ("requests", "input", "output", "cache_creation", "cache_read", "cost_usd")


def _incomplete(t: Row) -> str | None:
    return f"{thousands(t.incomplete_requests)} requests lack a counter; their tokens are a lower bound" if t.incomplete_requests else None


def _unpriced(n: int, names: list[str] = ()) -> str | None:
    return f"{thousands(n)} requests have no price and add no cost" + (f"; unpriced models: {', '.join(names)}" if names else "") if n else None


def summary_text(r: R.Report) -> Iterator[str]:
    t, d, h, side = (r[k].head() for k in ("totals", "dedup", "health", "sidechain"))
    yield f"{thousands(h.sessions_parsed)} sessions parsed, {thousands(h.sessions_failed)} failed, {thousands(h.skipped_lines)} lines skipped"
    if not t.requests:
        yield "no usage data found"
        return
    yield table("totals", r["totals"], columns=_ROLLUP)
    over = f", which would overstate by {d.overcount_percent:.0f}%" if d.overcount_percent is not None else ""
    yield f"requestId dedup: {thousands(d.duplicate_lines_collapsed)} repeated lines collapsed; {thousands(d.known_tokens)} tokens, {thousands(d.naive_known_tokens)} by line{over}"
    if d.requests_with_thinking:
        yield f"thinking: {thousands(d.requests_with_thinking)} requests, {thousands(d.requests_with_encrypted_thinking)} of them encrypted; some {thousands(d.thinking_tokens_estimate)} tokens visible"
    if side.requests:
        yield f"sub-agent share: {thousands(side.requests)} requests, {cost(side.cost_usd, side.unpriced_requests, side.requests)}"
    yield table("by model", r["by_model"], 100, ("model", *_ROLLUP))
    yield table("by day", r["by_day"], 100, ("day", *_ROLLUP))
    yield table("top sessions", r["by_session"], 10, ("id", "project", "model", *_ROLLUP, "sub_agents"))
    yield table("top tools", R.top_tools(r), 10, ("name", "calls", "input_bytes", "server"))
    names = [x.model for x in r["unpriced_models"].limit(10).collect()]
    n = r["compactions"].head().compactions
    yield from notes(_incomplete(t), _unpriced(t.unpriced_requests, names), f"context was compacted {thousands(n)} times" if n else None,
                     f"{thousands(h.sessions_failed)} files could not be read" if h.sessions_failed else None)


def context_text(r: R.Report) -> Iterator[str]:
    yield "MEASURED is what requests were billed for; ESTIMATED is a quarter of the characters"
    most, peak, n = r["max_overhead"].head(), r["sessions"].agg(F.max("peak_fill")).head()[0], r["inventory"].head()
    yield f"MEASURED startup overhead: {thousands(most.startup_overhead)} tokens at most (session {short(most.session_id, 8).rstrip('…')})" if most else "MEASURED startup overhead: ? (no cold start)"
    yield f"MEASURED peak window fill: {thousands(peak)} tokens" if peak is not None else "MEASURED peak window fill: ? (no usage data)"
    yield table("estimated content by source", r["sources"], 10, ("source", "chars", "est_tokens", "share"), "(no content)")
    yield table("estimated content by server", r["servers"], 10, ("server", "calls", "call_bytes", "result_chars", "est_tokens"), "(no tool calls)")
    yield table("heaviest items", r["heaviest"], 10, ("source", "label", "session_id", "chars", "est_tokens"))
    yield "\n".join([
        "INVENTORY", f"MCP servers: {', '.join(n.mcp_servers) or '(none)'}", f"deferred tools (not loaded, so not bloat): {thousands(n.deferred_tools)}", f"skills listed: {thousands(n.skills)}",
        f"MCP instructions: {thousands(n.mcp_instruction_chars)} characters", f"attachments: {thousands(n.attachment_chars)} characters", f"compactions: {thousands(n.compactions)}",
    ])
    yield table("top sessions by peak window", r["sessions"], 10, ("session_id", "project", "session_model", "cold_start", "startup_overhead", "peak_fill", "final_fill"))


def anomalies_text(r: R.Report) -> Iterator[str]:
    t = r["totals"].head()
    yield f"{thousands(t.requests)} request(s) analyzed, {thousands(t.tokens)} tokens, {cost(t.cost_usd, int(t.any_unpriced), 2)}"
    if not t.requests:
        yield "no usage data found"
        return
    yield headline([_plain(x) for x in r["concentration"].collect()])
    yield table("concentration", r["concentration"], 10, ("fraction", "requests", "tokens", "token_share", "cost_share"), "(not enough requests)")
    flags = F.concat_ws(" ", F.when(F.col("token_share") >= 0.1, "★"), F.when(F.col("sidechain"), "↳sub"), F.when(F.col("has_thinking"), "think"))
    yield table("heaviest requests", r["heaviest"].withColumn("flags", flags), 10, ("session_id", "request_id", "model", "tokens", "cost_usd", "token_share", "flags"))
    yield table("retry storms", r["storms"], 15, ("session_id", "project", "start", "span_seconds", "requests", "tokens", "cost_usd", "thinking_requests"), "none detected.")
    yield from notes("some requests have no price: costs are a lower bound" if t.any_unpriced else None,
                     f"a storm is {R.STORM['least']} requests or more of one session, each within {R.STORM['gap_s']} seconds of the one before")


#: Names of the types of work as they are shown. Fixed values.
TYPE_NAMES = {"FeatureWork": "Feature work", "ConfigOps": "Config / ops"}


def classify_text(r: R.Report) -> Iterator[str]:
    t = r["totals"].head()
    yield f"{thousands(t.sessions)} session(s) classified (a heuristic), {thousands(t.tokens)} tokens, {cost(t.cost_usd, int(t.any_unpriced), 2)}"
    if not t.sessions:
        yield "no usage data found"
        return
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv])[F.col("task_type")], F.col("task_type"))
    types, sessions = (r[k].withColumn("task_type", named) for k in ("by_type", "sessions"))
    yield table("by task type", types, 10, ("task_type", "sessions", "requests", "tokens", "token_share", "cost_usd", "cost_share"), "(nothing classified)")
    yield table("sessions", sessions.withColumn("signals", F.slice("signals", 1, 2)), 15, ("id", "project", "task_type", "confidence", "tokens", "cost_usd", "signals"))
    yield from notes("some requests have no price: costs are a lower bound" if t.any_unpriced else None, "types follow from words in prompts and from the tools used; they are guesses")


def drilldown_text(r: R.Report) -> Iterator[str]:
    yield table("sessions", r["sessions"], 15, ("id", "project", "model", *_ROLLUP, "sub_agents"))
    yield table("turns", r["turns"].withColumn("tokens", X.known_total()), 15, ("session_id", "request_id", "ts", "model", "tokens", "cost_usd", "summary", "tools"))


TEXTS = {"summary": summary_text, "context": context_text, "anomalies": anomalies_text, "classify": classify_text, "drilldown": drilldown_text}


def tables(name: str, report: R.Report) -> str:
    return "\n\n".join(TEXTS[name](report))


def headline(concentration: list[dict]) -> str:
    """The smallest head that holds half of all tokens, else the largest tenth."""
    for f in FRACTIONS:
        row = next((r for r in concentration if r["fraction"] == f), None)
        if row and row["token_share"] >= 0.5:
            return f"the heaviest {f:.0%} of requests hold {row['token_share']:.0%} of tokens"
    row = next((r for r in concentration if r["fraction"] == 0.10), None)
    return f"the heaviest 10% of requests hold {row['token_share']:.0%} of tokens" if row else "no requests"


#: Colours of the leaves. Fixed values.
LEAVES = {"input": "#4e79a7", "output": "#f28e2b", "cache-read": "#76b7b2", "cache-write": "#edc948", "thinking": "#b07aa1"}


def grey(name: str) -> str:
    """A grey that the name decides."""
    h = 0xCBF29CE484222325
    for b in name.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    level = 188 + h % 36
    return f"rgb({level},{level},{level})"


def svg(report: R.Report, title: str = "Tokens", width: int = 1200, row: int = 18) -> str:
    """A flame graph; a legend only names leaves that are there.

    Stacks of less than a tenth of a pixel are drawn as one for each first frame, so there are no more
    boxes than the width has room for.
    """
    total = report["header"].head().total or 1
    wide = F.col("value") * (10 * width) >= total
    narrow = F.when(F.size("frames") > 1, F.array(F.col("frames")[0], F.lit("(narrower)"))).otherwise(F.array(F.lit("(narrower)")))
    drawn = report["stacks"].select(F.when(wide, F.col("frames")).otherwise(narrow).alias("frames"), "value").groupBy("frames").agg(F.sum("value").alias("value"))
    stacks = [(r.frames, r.value) for r in drawn.where(wide).orderBy("frames").collect()]
    boxes: dict[tuple, list[int]] = {}
    at = 0
    for frames, value in stacks:
        for depth in range(1, len(frames) + 1):
            box = boxes.setdefault(tuple(frames[:depth]), [at, 0])
            box[1] += value
        at += value
    used = [k for k in LEAVES if any(f[-1] == k for f, _ in stacks)]
    deep = max((len(f) for f, _ in stacks), default=0)
    top, height = 40 + (24 if used else 0), 40 + (24 if used else 0) + (deep + 1) * row
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="monospace" font-size="11">',
           f'<text x="8" y="20" font-size="14">{escape(title)}: {total:,}</text>']
    out.append('<g id="legend">' + "".join(
        f'<rect x="{8 + 120 * i}" y="30" width="12" height="12" fill="{LEAVES[k]}"/><text x="{24 + 120 * i}" y="40">{k}</text>' for i, k in enumerate(used)) + "</g>")
    for path, (start, value) in boxes.items():
        x, w, y = start * width / total, value * width / total, top + (len(path) - 1) * row
        text = escape(path[-1][: int(w / 7)]) if w > 20 else ""
        out.append(f'<g><title>{escape("; ".join(path))} ({value:,})</title><rect x="{x:.1f}" y="{y}" width="{max(w, 0.1):.1f}" height="{row - 1}" '
                   f'fill="{LEAVES.get(path[-1], grey(path[-1]))}"/><text x="{x + 3:.1f}" y="{y + 12}">{text}</text></g>')
    return "\n".join([*out, "</svg>"])
