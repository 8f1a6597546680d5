"""Attribution of results to the calls that asked for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X


def by_group(rows: DataFrame, key: str, size: str, *scope: str) -> DataFrame:
    """Sizes by key in each scope, without zeros: chars, est_tokens and share of the scope, largest first."""
    from pyspark.sql import Window as W

    sums = rows.groupBy(*scope, key).agg(F.sum(size).alias("chars")).where("chars > 0")
    whole = F.sum("chars").over(W.partitionBy(*(scope or [F.lit(1)])))
    return sums.withColumn("est_tokens", X.est_tokens(F.col("chars"))).withColumn("share", X.share(F.col("chars"), whole))


def attribute(calls: DataFrame, results: DataFrame, owner: DataFrame, group: str, default: str = X.BUILT_IN) -> DataFrame:
    """Per group: calls, call_bytes, result_chars and est_tokens.

    ``calls``: group, bytes. ``results``: ref, chars. ``owner``: ref (unique), group. Results whose
    ref is NULL or unknown go to ``default``.
    """
    own = owner.select(F.col("ref").alias("_ref"), F.col(group).alias("_group"))
    got = results.join(own, F.col("ref") == F.col("_ref"), "left").select(F.coalesce("_group", F.lit(default)).alias(group), "chars")
    zero = F.lit(0).cast("long")
    both = calls.select(group, F.lit(1).cast("long").alias("calls"), F.col("bytes").alias("call_bytes"), zero.alias("result_chars")).unionByName(
        got.select(group, zero.alias("calls"), zero.alias("call_bytes"), F.col("chars").alias("result_chars"))
    )
    out = both.groupBy(group).agg(*[F.sum(c).alias(c) for c in ("calls", "call_bytes", "result_chars")])
    return out.withColumn("est_tokens", X.est_tokens(F.col("call_bytes") + F.col("result_chars")))
