"""Rollups of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.operators.pricing import usd

MEASURES = ("requests", "input", "output", "cache_creation", "cache_read", "incomplete_requests", "cost_usd", "unpriced_requests")


def rollup_aggs(where: Column | None = None) -> list[Column]:
    """NULL counters add nothing but make a request incomplete; unpriced requests add no cost."""
    on = F.lit(True) if where is None else where
    core = ("input", "output", "cache_creation", "cache_read")
    missing = F.lit(False)
    for c in core:
        missing = missing | F.col(c).isNull()
    return [
        F.count_if(on).alias("requests"),
        *[X.zero(F.sum(F.when(on, X.zero(c)))).alias(c) for c in core],
        F.count_if(on & missing).alias("incomplete_requests"),
        F.coalesce(usd(F.sum(F.when(on, F.col("micro_usd")))), F.lit(0.0)).alias("cost_usd"),
        F.count_if(on & F.col("micro_usd").isNull()).alias("unpriced_requests"),
    ]


def by(reqs: DataFrame, **keys: Column) -> DataFrame:
    """A rollup per key, ascending."""
    return reqs.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*rollup_aggs()).orderBy(*keys)


def costliest_first(key: str = "id") -> list[Column]:
    return [F.desc("cost_usd"), F.desc(X.rollup_total()), F.asc(key)]
