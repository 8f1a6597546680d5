"""Column expressions that reports and sources share. Functions of names return SQL text or Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_MODEL = "(unknown)"
BUILT_IN = "(built-in)"
USAGE = ("input", "output", "cache_creation", "cache_creation_5m", "cache_creation_1h", "cache_read", "thinking")


def snippet_sql(x: str, most: int = 80) -> str:
    """The first line that isn't blank, trimmed, cut to ``most`` characters; NULL if there is none."""
    trim = r"regexp_replace(l, '(?U)^\\s+|\\s+$', '')"
    return rf"left(get(filter(transform(split({x}, '\n'), l -> {trim}), l -> l <> ''), 0), {most})"


def chars_sql(x: str) -> str:
    return f"CAST(char_length(coalesce({x}, '')) AS BIGINT)"


def server_sql(name: str) -> str:
    """The server of a tool named ``mcp__server__tool``; NULL for others."""
    return f"CASE WHEN startswith({name}, 'mcp__') THEN split({name}, '__')[1] END"


def ascii_lower(x: Column) -> Column:
    """Only A to Z change."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def short_id(x: Column) -> Column:
    return F.substring(x, 1, 8)


def in_window(ts: str, since: str | None) -> Column:
    """Everything without ``since``; else rows from that UTC day on. Rows without a time go."""
    return F.lit(True) if since is None else F.to_date(ts) >= F.lit(since).cast("date")


def zero(x: str | Column) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0))


def known_total(prefix: str = "") -> Column:
    """All tokens that are known, thinking included."""
    return sum((zero(f"{prefix}{c}") for c in ("output", "cache_creation", "cache_read", "thinking")), zero(f"{prefix}input"))


def rollup_total(prefix: str = "") -> Column:
    """Tokens of a rollup: without thinking."""
    return sum((zero(f"{prefix}{c}") for c in ("output", "cache_creation", "cache_read")), zero(f"{prefix}input"))


def window_fill(prefix: str = "") -> Column:
    return zero(f"{prefix}input") + zero(f"{prefix}cache_read") + zero(f"{prefix}cache_creation")


def is_empty(usage: str = "usage") -> Column:
    """No counter is known; how long cache writes live doesn't matter."""
    return F.coalesce(*[F.col(f"{usage}.{c}") for c in ("input", "output", "cache_creation", "cache_read", "thinking")]).isNull()


def est_tokens(chars: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(chars / 4).cast("long")


def share(part: Column, whole: Column) -> Column:
    """0 of 0 is 0.0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def share_or_null(part: Column, whole: Column) -> Column:
    return F.when(zero(whole) != 0, part.cast("double") / whole.cast("double"))


def less_sql(a: str, b: str) -> str:
    """a - b, not below 0; NULL stays NULL (greatest() would skip it)."""
    return f"CASE WHEN {a} IS NOT NULL THEN greatest({a} - coalesce({b}, 0), 0) END"


def first_by(value: str, order: str, where: str | None = None) -> Column:
    """The value of the least ``order`` among rows where it (or ``where``) isn't NULL."""
    return F.expr(f"min_by({value}, {order}) FILTER (WHERE {where or f'{value} IS NOT NULL'})")


def last_by(value: str, order: str, where: str | None = None) -> Column:
    return F.expr(f"max_by({value}, {order}) FILTER (WHERE {where or f'{value} IS NOT NULL'})")
