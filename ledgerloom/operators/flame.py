"""Folded stacks: weights of leaves summed along a path of dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot(rows: DataFrame, leaves: dict[str, Column], *keep: Column) -> DataFrame:
    """A row for each leaf with a positive weight: the columns kept, ``leaf``, ``weight``."""
    pairs = F.array(*[F.struct(F.lit(k).alias("leaf"), w.alias("weight")) for k, w in leaves.items()])
    return rows.select(*keep, F.inline(pairs)).where("weight > 0")


def fold(rows: DataFrame, frames: list[Column], weight: str = "weight") -> DataFrame:
    """``frames`` and ``value``: weights are rounded once, after the sum; stacks that round to 0 go."""
    out = rows.groupBy(F.array(*frames).alias("frames")).agg(F.round(F.sum(weight)).cast("long").alias("value"))
    return out.where("value > 0").orderBy("frames")


def folded_line(frames: Column, value: Column) -> Column:
    """``a;b;c 12``: semicolons inside become colons, white space underscores."""
    clean = F.transform(frames, lambda f: F.regexp_replace(F.translate(f, ";", ":"), r"[ \t\n\r\f]", "_"))
    return F.concat(F.array_join(clean, ";"), F.lit(" "), value.cast("string"))
