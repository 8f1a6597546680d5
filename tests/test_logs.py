"""Sources, reports, sinks and the command line over invented logs."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

import fixtures as X
from ledgerloom import cli
from ledgerloom.plans import render
from ledgerloom.plans import reports as R
from ledgerloom.sources import registry
from ledgerloom.sources.config import Config, greet_once, per_token_prices, price_cache
from ledgerloom.streaming import watch


@pytest.fixture(scope="module")
def spend(spark):
    return R.Books.open(X.logs(spark, "claude-code", X.SPEND))


def events(logs):
    return [(r.kind, r.content_chars, r.thinking_chars) for r in logs.events.orderBy("file_id", "line_no", "sub_seq").collect()]


def test_first_source(spark):
    logs = X.logs(spark, "claude-code", {k: v for k, v in X.SPEND.items() if "sub" not in k and "main" in k})
    assert [k for k, _, _ in events(logs)] == [
        "User", "Assistant", "Assistant", "ToolResult", "Assistant", "SubAgentSpawn", "ToolResult", "Assistant", "Assistant", "Compaction"]
    f = logs.files.head()
    assert (f.session_id, f.project, f.model, f.skipped_lines, f.spawn_calls) == ("main-7a01", "oven", X.A, 2, 1)


def test_sub_agents_know_their_parent(spend):
    got = {r.session_id: r.parent_session for r in spend.logs.files.collect()}
    assert got == {"main-7a01": None, "agent-9": "main-7a01", "side-3c02": None}


def test_wrong_types_kill_a_line(spark):
    ok = '{"type":"user","message":{"content":"x"},"timestamp":null}'
    bad = ['{"type":"user","requestId":5}', '{"type":"user","isSidechain":null}', '{"type":"assistant","message":{"usage":{"input_tokens":-1}}}',
           '{"type":"assistant","message":{"usage":{"input_tokens":1.5}}}', '[1]', '{"type":"user","message":"x"}']
    logs = X.logs(spark, "claude-code", {"/x/projects/p/a.jsonl": "\n".join([ok, *bad, "  "])})
    assert logs.files.head().skipped_lines == len(bad)
    assert logs.events.count() == 1


def test_synthetic_lines_have_no_usage(spark):
    rows = [X._said("06-01T10:00:00", "a", "<synthetic>", "oops", X._usage(0, 0)), X._said("06-01T10:00:01", "b", X.A, "fine", X._usage(1, 1))]
    logs = X.logs(spark, "claude-code", {"/x/projects/p/a.jsonl": X._lines(rows)})
    assert logs.files.head().model == X.A
    assert logs.events.where("usage IS NULL").count() == 1


def test_codex_events(spark):
    logs = X.logs(spark, "codex", X.CODEX)
    main = logs.files.where("path LIKE '%main%'").head()
    assert (main.project, main.model, main.skipped_lines) == ("/home/ann/oven", "gpt-5.5", 2)
    assert logs.tool_calls().where("name = 'mcp__stock-db__ask'").count() == 2


def test_gemini_lines_merge(spark):
    logs = X.logs(spark, "gemini", X.GEMINI)
    first = logs.events.where("request_id = 'g1'").collect()
    assert len(first) == 1
    assert (first[0].content_chars, first[0].thinking_chars, first[0].content_summary, len(first[0].tool_calls)) == (9 + 15 + 8, 15, "Counting.", 1)
    assert logs.files.head().project == "kitchen"


def test_copilot_counts_nothing_as_spend(spark):
    logs = X.logs(spark, "copilot", X.COPILOT)
    f = logs.files.head()
    assert (f.session_id, f.project, f.model) == ("2222", "pantry", "gpt-5")
    assert R.summary(R.Books.open(logs))["by_session"].count() == 0


def test_context_report(spark):
    got = render.as_dict(R.context(R.Books.open(X.logs(spark, "claude-code", X.CONTEXT))))
    assert got["inventory"]["deferred_tools"] == 9 and got["inventory"]["skills"] == 4 and got["inventory"]["mcp_servers"] == ["stock-db", "tickets"]
    assert got["heaviest"][0]["label"] == "mcp__stock-db__load"
    assert got["max_overhead"]["startup_overhead"] == 15030
    assert abs(sum(s["share"] for s in got["sources"]) - 1) < 1e-9


def test_regrouping_keeps_totals(spend):
    totals = {R.flame(spend, "tokens", d)["header"].head().total for d in (("project", "session", "model", "type"), ("type",), ("model", "project"))}
    assert totals == {17770}


def test_drilldown_turns(spend):
    turns = R.drilldown(spend)["turns"].collect()
    first = next(t for t in turns if t.request_id == "r1")
    assert (first.summary, first.tools) == ("The client comes first.", ["Grep", "Read"])
    assert len(turns) == 7


def test_empty_window(spark):
    books = R.Books.open(X.logs(spark, "claude-code", X.SPEND), since="2030-01-01")
    got = render.as_dict(R.anomalies(books))
    assert got["totals"]["requests"] == 0 and not got["concentration"] and not got["heaviest"] and not got["storms"]
    assert render.as_dict(R.summary(books))["totals"]["cost_usd"] == 0.0


def test_no_files(spark):
    logs = registry.by_id("claude-code").read(spark, [])
    assert R.summary(R.Books.open(logs))["totals"].head().requests == 0


def test_sinks(spend):
    flame = R.flame(spend)
    assert sum(int(r.line.rsplit(" ", 1)[1]) for r in R.folded(flame).collect()) == 17770
    assert render.svg(flame).count("<rect") > 5 and "thinking" not in render.svg(flame)
    assert "BY MODEL" in render.tables("summary", R.summary(spend))
    assert (render.cost(None), render.cost(1.5), render.cost(0.25, 1, 2), render.cost(0.0, 2, 2)) == ("?", "$1.50", "≥$0.2500", "?")


def test_files_on_disk_command_line_and_saving(spark, tmp_path, monkeypatch):
    for path, text in X.SPEND.items():
        p = tmp_path / path.removeprefix("/x/")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    monkeypatch.setenv("CLAUDE_CONFIG_DIR", str(tmp_path))
    monkeypatch.setenv("LEDGERLOOM_CONFIG", str(tmp_path / "none.toml"))
    assert registry.route().id == "claude-code"
    out = io.StringIO()
    cli.run(spark, cli.parser().parse_args(["summary", "--json"]), out)
    assert json.loads(out.getvalue())["totals"]["input"] == 3550
    assert len(watch.watch_roots(registry.by_id("claude-code"))) == 3
    logs = registry.by_id("claude-code").read(spark)
    logs.save(str(tmp_path / "saved"))
    again = type(logs).load(spark, str(tmp_path / "saved"))
    assert again.events.count() == logs.events.count()


def test_changes_wait_until_quiet(tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text("1")
    naps = []

    def sleep(s):
        naps.append(s)
        if len(naps) == 1:
            f.write_text("22")
        if len(naps) == 2:
            f.write_text("333")

    it = watch.changes([str(tmp_path)], sleep=sleep)
    assert next(it)[str(f)][0] == 1
    assert next(it)[str(f)][0] == 3
    assert naps == [0.1, 0.4, 0.4]


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text('default_agent = "codex"\nmore = 1\n')
    (tmp_path / "bad.toml").write_text("=")
    assert Config.load(str(tmp_path / "c.toml")).default_agent == "codex"
    assert Config.load(str(tmp_path / "bad.toml")) == Config() == Config.load(str(tmp_path / "no"))
    (tmp_path / "p.json").write_text(json.dumps({"models": {"m": {"input": 1, "output": 2, "cache_read": 3, "cache_write_5m": 4, "cache_write_1h": 5}}}))
    assert price_cache(str(tmp_path / "p.json")) == {"m": (1.0, 2.0, 3.0, 4.0, 5.0)} and price_cache(os.devnull) == {}
    got = per_token_prices({"m": {"input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6}, "x": 1})
    assert [round(x, 9) for x in got["m"]] == [1.0, 2.0, 0.1, 1.25, 2.0]


def test_routing_errors(spark):
    with pytest.raises(ValueError, match="known"):
        registry.by_id("nobody")
    with pytest.raises(NotImplementedError):
        registry.by_id("cursor").read(spark)


def test_blank_lines_and_files_without_events(spark):
    logs = X.logs(spark, "claude-code", {"/x/projects/p/a.jsonl": "\t\n \u00a0\n\n", "/x/projects/p/b.jsonl": "", "/x/projects/p/c.jsonl": "x\n\t \n"})
    assert {r.session_id: r.skipped_lines for r in logs.files.collect()} == {"a": 0, "b": 0, "c": 1}
    assert R.summary(R.Books.open(logs))["health"].head().sessions_parsed == 3


def test_files_that_cannot_be_read_are_counted(spark):
    lines = X.lines(spark, X.SPEND)
    found = lines.select("file_id", "path").distinct().unionByName(spark.createDataFrame([("/x/projects/p/gone.jsonl",) * 2], "file_id string, path string"))
    logs = registry.by_id("claude-code").from_lines(lines, found)
    assert [r.path for r in logs.failed.collect()] == ["/x/projects/p/gone.jsonl"]
    health = R.summary(R.Books.open(logs))["health"].head()
    assert (health.sessions_parsed, health.sessions_failed) == (3, 1)
    assert "3 sessions parsed, 1 failed" in render.tables("summary", R.summary(R.Books.open(logs)))


def test_links_are_not_followed(spark, tmp_path):
    real = tmp_path / "projects" / "p"
    real.mkdir(parents=True)
    (real / "a.jsonl").write_text("{}\n")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "b.jsonl").write_text("{}\n")
    (real / "linked").symlink_to(tmp_path / "other")
    (real / "c.jsonl").symlink_to(tmp_path / "other" / "b.jsonl")
    logs = registry.by_id("claude-code").read(spark, [str(tmp_path / "projects")])
    assert [r.session_id for r in logs.files.collect()] == ["a"] and logs.failed.count() == 0
    logs.close()
    assert {os.path.basename(k) for k in watch.state([f"file://{tmp_path}"])} == {"a.jsonl", "b.jsonl"}
    assert list(watch._remote(f"file://{tmp_path}/other").values()) == [(3, pytest.approx(os.stat(tmp_path / "other" / "b.jsonl").st_mtime_ns, abs=1e6))] and watch._remote("file:///none") == {}


def test_unpriced_rows_are_no_money(spark):
    logs = X.logs(spark, "codex", X.CODEX)
    text = render.tables("summary", R.summary(R.Books.open(logs)))
    model = next(x for x in text.splitlines() if x.startswith("gpt-5.5"))
    assert "?" in model and "$0.00" not in model and "unpriced models" in text


def test_text_reports(spend, spark):
    text = {n: render.tables(n, getattr(R, n)(spend)) for n in ("summary", "anomalies", "drilldown")}
    text["classify"] = render.tables("classify", R.classify(R.Books.open(X.logs(spark, "claude-code", X.KINDS))))
    text["context"] = render.tables("context", R.context(R.Books.open(X.logs(spark, "claude-code", X.CONTEXT))))
    for n, parts in {
        "summary": ["17,770", "22,700", "requestId dedup", "sub-agent share", "overstate by 28%", "BY MODEL", "BY DAY", "TOP TOOLS", X.A, X.B],
        "anomalies": ["request(s) analyzed", "CONCENTRATION", "HEAVIEST REQUESTS", "RETRY STORMS", "none detected.", "of requests hold", "NOTES"],
        "classify": ["session(s) classified", "BY TASK TYPE", "SESSIONS", "Feature work", "prompt keyword", "NOTES"],
        "context": ["MEASURED", "ESTIMATED", "15,030", "stock-db", "mcp__stock-db__load", "not bloat", "TOP SESSIONS BY PEAK WINDOW"],
        "drilldown": ["SESSIONS", "TURNS", "The client comes first."],
    }.items():
        assert all(p in text[n] for p in parts), (n, [p for p in parts if p not in text[n]])
    empty = R.Books.open(spend.logs, since="2030-01-01")
    assert all("no usage data found" in render.tables(n, getattr(R, n)(empty)) for n in ("summary", "anomalies", "classify"))


def as_json(name, books):
    out = io.StringIO()
    render.write_json(render.document(name, getattr(R, name)(books), "claude-code"), out)
    return json.loads(out.getvalue())


def test_json_reports(spend, spark):
    rollup = {"requests", "input", "output", "cache_creation", "cache_read", "incomplete_requests", "cost_usd", "unpriced_requests"}
    s = as_json("summary", spend)
    assert set(s) == {"agent", "generated_at", "since", "sessions_parsed", "sessions_failed", "skipped_lines", "dedup", "totals", "sidechain_totals", "by_model", "by_day", "by_session", "by_tool", "unpriced_models", "compactions"}
    assert set(s["totals"]) == rollup == set(s["by_model"][X.A]) and s["totals"]["input"] == 3550 and sum(x["requests"] for x in s["by_day"].values()) == 7
    assert set(s["by_session"][0]) == {"id", "project", "model", "started_at", "rollup", "sub_agents", "sub_agent_tokens"} and s["by_tool"]["Read"]["calls"] == 1
    c = as_json("context", R.Books.open(X.logs(spark, "claude-code", X.CONTEXT)))
    assert c["max_startup_overhead"][1] == 15030 and c["deferred_tools"] == 9 and c["skills_listed"] == 4 and c["mcp_servers"] == ["stock-db", "tickets"]
    assert {"peak_input_tokens", "final_input_tokens", "startup_overhead_tokens", "total_content_chars", "sidechain"} < set(c["sessions"][0])
    assert c["sessions"][0]["total_content_chars"] == sum(x["chars"] for x in c["sessions"][0]["sources"])
    a = as_json("anomalies", spend)
    assert a["requests_analyzed"] == 7 and [x["request_fraction"] for x in a["concentration"]] == [0.01, 0.05, 0.1, 0.25] and a["retry_storms"] == [] and a["storm_min_requests"] == 5
    k = as_json("classify", spend)
    assert k["sessions_classified"] == 2 and set(k["by_task_type"][0]) == {"task_type", "sessions", "rollup", "token_share", "cost_share"} and k["sessions"][0]["signals"]
    d = as_json("drilldown", spend)
    assert len(d["turns"]) == 7 and {"summary", "tools", "encrypted"} < set(d["turns"][0])
    none = as_json("summary", R.Books.open(spend.logs, since="2030-01-01"))
    assert none["by_model"] in ({}, []) and none["totals"]["requests"] == 0


def test_three_levels_and_refreshed_prices(spark, tmp_path, monkeypatch, capsys):
    p = tmp_path / "projects" / "app" / "s1.jsonl"
    p.parent.mkdir(parents=True)
    p.write_text(X.SPEND["/x/projects/oven/main-7a01.jsonl"])
    monkeypatch.setenv("LEDGERLOOM_CONFIG", str(tmp_path / "none.toml"))
    monkeypatch.setenv("LEDGERLOOM_PRICES", str(tmp_path / "cache" / "prices.json"))
    (tmp_path / "listing.json").write_text(json.dumps({"claude-sonnet-4-5": {"input_cost_per_token": 1.0, "output_cost_per_token": 2.0}, "note": "x"}))

    def call(*args):
        out = io.StringIO()
        cli.run(spark, cli.parser().parse_args(["--agent", "claude-code", "--root", str(tmp_path), *args]), out)
        return out.getvalue()

    assert "SESSIONS" in call("tui") and "s1" in call("tui")
    text = call("tui", "--row", "s1")
    assert "TURNS" in text and "The client comes first." in text and "INVENTORY" in text
    before = json.loads(call("summary", "--json"))["totals"]["cost_usd"]
    after = json.loads(call("--refresh-pricing", str(tmp_path / "listing.json"), "summary", "--json"))["totals"]["cost_usd"]
    assert after > 1000 * before and json.loads(call("summary", "--json"))["totals"]["cost_usd"] == after
    assert json.loads(call("--refresh-pricing", str(tmp_path / "nothing"), "summary", "--json"))["totals"]["cost_usd"] == after
    assert "not refreshed" in capsys.readouterr().err
    svg = tmp_path / "f.svg"
    assert f"wrote flamegraph: {svg}" in call("flame", "--out", str(svg)) and 'id="legend"' in svg.read_text()
    assert "nothing to draw" in call("--since", "2030-01-01", "flame", "--fold")


def test_welcome(tmp_path, monkeypatch, capsys):
    """Without a command nothing is read; a first greeting is remembered."""
    monkeypatch.setenv("LEDGERLOOM_STATE_DIR", str(tmp_path / "state"))
    assert cli.main([]) == 0 and "ledgerloom summary" in capsys.readouterr().out
    assert not greet_once() and greet_once(str(tmp_path / "other")) and not greet_once(os.devnull)


def test_usage_that_says_nothing(spark):
    from ledgerloom.functions import exprs as E

    rows = spark.sql("SELECT named_struct('input', a, 'output', null, 'cache_creation', null, 'cache_creation_5m', 3, 'cache_read', null, 'thinking', b) AS usage FROM VALUES (1, null), (null, 0), (null, null) t(a, b)")
    assert [r[0] for r in rows.select(E.is_empty()).collect()] == [False, False, True]


def test_views(spend, spark):
    spend.logs.register("t_")
    assert spark.sql("SELECT count(*) FROM t_events WHERE kind = 'Assistant'").head()[0] == spend.logs.events.where(F.col("kind") == "Assistant").count()
