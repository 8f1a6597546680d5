"""Heads of an order, concentration, and bursts in time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerloom.functions import exprs as X

FRACTIONS = (0.01, 0.05, 0.10, 0.25)


def splitters(largest: str, cells: int = 64) -> Column:
    """Values that cut rows into ``cells`` of like size, for ``head_sums``."""
    return F.percentile_approx(largest, F.array(*[F.lit(i / cells) for i in range(1, cells)]), F.lit(10_000))


def head_sums(
    rows: DataFrame, largest: str, order: list[Column], n: int, sums: dict[str, str], fractions: tuple[float, ...] = FRACTIONS, found: list | None = None
) -> DataFrame:
    """For each fraction: how many rows it is (rounded up, 1 to n) and what the first so many sum to.

    ``order`` begins with ``largest`` descending. Splitters of it (``found``, else looked for) cut the rows into cells; cells
    are summed where rows lie, and a head is its whole cells and the beginning of one more. Only the
    cells that a head ends in are sorted.
    """
    spark = rows.sparkSession
    names = list(sums)
    schema = "fraction double, requests long, " + ", ".join(f"{k} {rows.select(F.sum(c)).dtypes[0][1]}" for k, c in sums.items())
    if not n:
        return spark.createDataFrame([], schema)
    found = rows.agg(splitters(largest)).head()[0] if found is None else found
    bounds = F.array(*[F.lit(x) for x in sorted(set(found), reverse=True)])
    placed = rows.withColumn("_cell", F.size(F.filter(bounds, lambda b: b > F.col(largest))))
    per = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(k) for k, c in sums.items()]).orderBy("_cell").collect()
    parts, ends = [], []
    for f in fractions:
        left = k = min(max(math.ceil(f * n), 1), n)
        for r in per:
            if r._n > left:
                ends.append((f, k, r._cell, left))
                break
            parts.append((f, k, *(r[x] for x in names)))
            left -= r._n
    whole = spark.createDataFrame(parts, schema)
    if ends := [x for x in ends if x[3]]:
        wanted = F.filter(F.array(*[F.struct(F.lit(f).alias("fraction"), F.lit(k).cast("long").alias("requests"), F.lit(c).alias("c"), F.lit(m).alias("m")) for f, k, c, m in ends]),
                          lambda x: x["c"] == F.col("_cell"))
        ranked = placed.where(F.col("_cell").isin([c for _, _, c, _ in ends])).withColumn("_rank", F.row_number().over(W.partitionBy("_cell").orderBy(*order)))
        rest = ranked.withColumn("_f", F.explode(wanted)).where(F.col("_rank") <= F.col("_f.m"))
        whole = whole.unionByName(rest.groupBy("_f.fraction", "_f.requests").agg(*[F.sum(c).alias(k) for k, c in sums.items()]))
    return whole.groupBy("fraction", "requests").agg(*[F.sum(k).alias(k) for k in names])


def bursts(rows: DataFrame, keys: list[str], ts: str, gap_s: int = 15, least: int = 5, aggs: list[Column] = ()) -> DataFrame:
    """Runs of rows of a key that follow each other within ``gap_s`` whole seconds, ``least`` rows or more.

    Gaps and islands: a row opens an island when the gap to the one before is larger.
    """
    order = W.partitionBy(*keys).orderBy(ts)
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    opens = seconds(ts) - F.lag(seconds(ts)).over(order) > gap_s
    marked = rows.where(F.col(ts).isNotNull()).withColumn("_open", F.coalesce(opens, F.lit(True)).cast("int"))
    runs = marked.withColumn("_run", F.sum("_open").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = runs.groupBy(*keys, "_run").agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("requests"), *aggs
    ).where(F.col("requests") >= least)
    return out.withColumn("span_seconds", seconds("end") - seconds("start")).drop("_run")


def carry_forward(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The last known value up to each row."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))
