"""Command line: ``python -m ledgerloom.cli summary --json``."""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.plans import render
from ledgerloom.plans import reports as R
from ledgerloom.sources.base import Logs
from ledgerloom.sources.config import Config, greet_once, price_cache, refresh_prices
from ledgerloom.sources.registry import SOURCES, route
from ledgerloom.streaming.watch import watch


WELCOME = """ledgerloom: where the tokens of coding agents went

  ledgerloom summary       spend by model, day, session and tool
  ledgerloom context       what fills the context windows
  ledgerloom anomalies     where spend is concentrated, and bursts of requests
  ledgerloom classify      what kind of work it was
  ledgerloom flame         a flame graph (--out FILE.svg)
  ledgerloom tui           sessions, their turns, their context
  ledgerloom watch         the summary again whenever logs change

--json for machines, --since YYYY-MM-DD for a window, --agent NAME to choose one of several."""


def _date(text: str) -> str:
    return dt.date.fromisoformat(text).isoformat()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerloom", description="Where the tokens of coding agents went.")
    p.add_argument("--agent", choices=list(SOURCES))
    p.add_argument("--since", type=_date, help="UTC day, YYYY-MM-DD")
    p.add_argument("--prices", help="a price cache (JSON) over the built-in prices; else the user's own is looked for")
    p.add_argument("--refresh-pricing", metavar="LISTING", help="first read prices from a public listing (URL or file) into the cache")
    p.add_argument("--root", action="append", help="folder or other path with logs, instead of the agent's own")
    sub = p.add_subparsers(dest="command")
    for name in ("summary", "context", "anomalies", "classify", "drilldown", "watch"):
        sub.add_parser(name).add_argument("--json", action="store_true")
    browse = sub.add_parser("tui", help="sessions, their turns, and what fills a session's window")
    browse.add_argument("--row", help="a session's id: its turns and its context")
    flame = sub.add_parser("flame")
    flame.add_argument("--out", help="write an SVG here")
    flame.add_argument("--fold", action="store_true", help="print folded lines")
    flame.add_argument("--metric", choices=("tokens", "cost"), default="tokens")
    flame.add_argument("--group-by", default="project,session,model,type")
    return p


def run(spark: SparkSession, args: argparse.Namespace, out=None) -> int:
    out = out or sys.stdout
    source = route(args.agent, Config.load().default_agent)
    if args.refresh_pricing:
        try:
            print(f"ledgerloom: {refresh_prices(args.refresh_pricing, args.prices)} prices kept", file=sys.stderr)
        except (OSError, ValueError) as e:
            print(f"ledgerloom: prices not refreshed ({e}); going on with those at hand", file=sys.stderr)
    overrides = price_cache(args.prices) or None

    def show(logs: Logs) -> None:
        books = R.Books.open(logs, args.since, overrides, cache=True)
        try:
            write(books)
        finally:
            books.close()

    def write(books: R.Books) -> None:
        if args.command == "flame":
            flame(books, args, out)
            return
        if args.command == "tui":
            levels(books, args.row, out)
            return
        name = "summary" if args.command == "watch" else args.command
        report = getattr(R, name)(books)
        if args.json:
            render.write_json(render.document(name, report, source.id, args.since), out)
            print(file=out)
        else:
            print(render.tables(name, report), file=out)

    if args.command == "watch":
        watch(spark, source, show, args.root)
    else:
        logs = source.read(spark, args.root)
        show(logs)
        logs.close()
    return 0


def flame(books: R.Books, args: argparse.Namespace, out) -> None:
    report = R.flame(books, args.metric, tuple(x.strip() for x in args.group_by.split(",") if x.strip()))
    head = report["header"].head()
    if not head.total:
        print(f"nothing to draw ({head.unpriced_requests} unpriced requests)", file=out)
    elif args.out:
        with open(args.out, "w") as f:
            f.write(render.svg(report, "Micro-USD" if args.metric == "cost" else "Tokens"))
        print(f"wrote flamegraph: {args.out}", file=out)
    else:
        for r in R.folded(report).toLocalIterator():
            print(r.line, file=out)


def levels(books: R.Books, row: str | None, out) -> None:
    """The three levels: sessions; the turns of one; what fills its window."""
    report = R.drilldown(books)
    if row is None:
        print(render.table("sessions", report["sessions"], 100, ("id", "project", "model", "requests", "input", "output", "cost_usd", "sub_agents")), file=out)
        return
    turns = report["turns"].where(F.col("row_id") == row).withColumn("tokens", X.known_total())
    print(render.table("turns", turns, 1000, ("request_id", "ts", "model", "tokens", "cost_usd", "summary", "tools")), file=out)
    print(file=out)
    print(render.tables("context", R.context_of(books, row)), file=out)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command is None:
        greet_once()
        print(WELCOME)
        return 0
    if sys.stderr.isatty() and greet_once():
        print(WELCOME, file=sys.stderr)
    spark = SparkSession.builder.appName("ledgerloom").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        return run(spark, args)
    except (LookupError, NotImplementedError, ValueError) as e:
        print(f"ledgerloom: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
