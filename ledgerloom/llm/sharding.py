"""Sharding by balanced label propagation, in DataFrame operations alone.

Documents with equal texts are linked. They start in shards by hash; in each round a document asks
to move to a shard where most of its neighbours are or will be, if that shard has room, and as many
may move as there is room for. Rounds go on as long as the wishes fall. Groups that are still split
then, for want of room or time, are taken out and placed whole, one after the other, into the room
that this makes. Documents without links then fill the shards up to equal counts.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, rank_within, spread_over


def shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16
) -> DataFrame:
    """Per row: ``doc_id``, ``size``, ``text_crc32``, ``law`` ('rows'), ``shard``, ``slot``, ``grown_shard`` (null).

    The counts of any two shards differ by one at most. ``size``: UTF-8 bytes plus 1 (null text: 1).
    Null texts are equal to each other and to the empty text. A group that is larger than a shard
    spreads over several; otherwise equal texts share a shard, but for at most ``n_shards - 1`` groups in
    all that lie across the end of a full shard. Rows are placed one
    by one, also those that repeat a ``doc_id``. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.unhex(F.md5(text)).alias("g"),
    )
    # ``row`` tells rows apart; the checkpoint fixes it. All that is decided follows from ``x``, which is what
    # the row holds and, among rows that repeat each other, its number: how rows lie in partitions has no effect.
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    alike = rows.groupBy("doc_id", "g").count().where("count > 1").select(F.col("doc_id").alias("ad"), F.col("g").alias("ag"))
    on = F.col("doc_id").eqNullSafe(F.col("ad")) & (F.col("g") == F.col("ag"))
    again = rank_within(rows.join(alike, on, "left_semi"), ["doc_id", "g"], [F.col("row")], spread_over(F.xxhash64("row")), "n")
    rows = cut(rows.join(alike, on, "left_anti").withColumn("n", F.lit(0).cast("long")).unionByName(again).withColumn("x", F.xxhash64("doc_id", "g", "n")).drop("n"))
    # cut, so that both sides of the joins below are dealt anew and Spark can split a large group
    groups = cut(rows.groupBy("g").count().where("count > 1").select(F.col("g").alias("h")))
    table = cut(rows.join(groups, rows.g == groups.h, "left").withColumn("linked", F.col("h").isNotNull()).drop("h"))
    n = table.count()
    cap = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    free = table.where("not linked").select("row", "x")
    placed = table.where("linked").select("row", "x", "g", F.pmod(F.xxhash64("x"), F.lit(n_shards)).cast("int").alias("shard"))

    nth, wishes = 0, None
    while True:
        placed = cut(placed)
        load = {r.shard: r["count"] for r in placed.groupBy("shard").count().collect()}
        room = [max(0, cap[s] - load.get(s, 0)) for s in range(n_shards)]
        room_of = F.element_at(F.array(*[F.lit(r) for r in room]), F.col("shard") + 1)
        counts = placed.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("c")).withColumn("room", room_of)
        # a group keeps to as few shards, those with most of it first, as have the room to take it in
        first = W.partitionBy("g").orderBy(F.desc("c"), F.xxhash64("g", "shard"))
        counts = counts.withColumn("upto", F.sum(F.col("c") + F.col("room")).over(first) - F.col("c") - F.col("room"))
        counts = counts.withColumn("keep", F.col("upto") < F.sum("c").over(W.partitionBy("g")))
        goals = counts.where("keep AND room > 0").groupBy(F.col("g").alias("gg")).agg(F.array_sort(F.collect_list(F.struct("shard", "room"))).alias("goals"))
        leave = counts.where("NOT keep").join(goals, F.col("g") == F.col("gg")).select(F.col("g").alias("wg"), F.col("shard").alias("ws"), "c", "goals")
        leave = cut(leave)
        asking = leave.agg(F.sum("c")).head()[0] or 0
        if not asking or (wishes is not None and asking > 0.9 * wishes):
            break
        wishes = asking
        wish = placed.join(leave, (placed.g == F.col("wg")) & (placed.shard == F.col("ws")))
        wish = wish.withColumn("at", F.expr(f"pmod(xxhash64(x, {nth}), aggregate(goals, 0L, (a, x) -> a + x.room))"))
        wish = wish.select("row", "x", "g", F.expr(
            "aggregate(goals, named_struct('left', at, 'to', -1), (a, x) -> CASE WHEN a.to >= 0 THEN a WHEN a.left < x.room "
            "THEN named_struct('left', a.left, 'to', x.shard) ELSE named_struct('left', a.left - x.room, 'to', a.to) END).to"
        ).alias("to"))
        asked = rank_within(wish, ["to"], [F.xxhash64("g"), F.col("x")], spread_over(F.col("x")), "nth")
        room_to = F.element_at(F.array(*[F.lit(r) for r in room]), F.col("to") + 1)
        moved = asked.where(F.col("nth") < room_to).select(F.col("row").alias("mr"), "to")
        placed = placed.join(moved, placed.row == moved.mr, "left").select("row", "x", "g", F.coalesce("to", "shard").alias("shard"))
        nth += 1
    placed = _settled(cut(placed), cap)

    load = {r.shard: r["count"] for r in placed.groupBy("shard").count().collect()}
    bounds, total = [], 0
    for s in range(n_shards):
        total += cap[s] - load.get(s, 0)
        bounds.append(total)
    ranks = rank_within(free, [], [F.col("x")], spread_over(F.col("x"), 4096), "nth")
    into = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("nth")))
    homes = placed.select("row", "shard").unionByName(ranks.select("row", into.alias("shard"))).withColumnRenamed("row", "r")
    out = table.join(homes, table.row == F.col("r")).select("doc_id", "size", "text_crc32", "shard", "x")
    out = rank_within(cut(out), ["shard"], [F.col("doc_id"), F.col("x")], spread_over(F.col("x")), "slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _settled(placed: DataFrame, cap: list[int]) -> DataFrame:
    """``placed`` (row, x, g, shard) with its split groups placed anew, and no shard over ``cap``.

    A group is split if it is in more shards than it needs; groups of a shard over its capacity go with
    them. They are laid end to end, the largest first, along the room that they leave, the shard with
    the most room first, so that each end of a shard cuts one group at most.
    """
    n_shards, size = len(cap), max(cap)
    counts = cut(placed.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("c")))
    groups = counts.groupBy("g").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("in"))
    split = groups.where(F.col("in") > F.ceil(F.col("n") / max(1, min(cap)))).select(F.col("g").alias("sg"))
    whole = counts.join(split, counts.g == split.sg, "left_anti")
    full = [r.shard for r in whole.groupBy("shard").agg(F.sum("c").alias("c")).collect() if r.c > cap[r.shard]]
    if full:
        split = split.unionByName(whole.where(F.col("shard").isin(full)).select(F.col("g").alias("sg"))).distinct()
    anew = cut(groups.join(split, groups.g == split.sg, "left_semi").select("g", "n"))
    if anew.isEmpty():
        return placed

    # where each group starts: the few large ones first, by size; the others by cells, so that they never meet in one task
    cell = F.when(F.col("n") * 4 > size, F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("g"), F.lit(4096))).cast("int")
    anew = anew.withColumn("cell", cell)
    cells = anew.groupBy(F.col("cell").alias("k")).agg(F.sum("n").alias("m"))
    cells = cells.withColumn("base", F.sum("m").over(W.orderBy("k")) - F.col("m")).select("k", "base")
    inner = F.sum("n").over(W.partitionBy("cell").orderBy(F.desc("n"), "g").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    starts = anew.withColumn("inner", inner).join(cells, F.col("cell") == F.col("k"))
    starts = cut(starts.select(F.col("g").alias("sg"), (F.col("base") + F.col("inner")).alias("start")))

    stay = cut(placed.join(starts, placed.g == starts.sg, "left_anti").select("row", "x", "g", "shard"))
    load = {r.shard: r["count"] for r in stay.groupBy("shard").count().collect()}
    room = sorted(((cap[s] - load.get(s, 0), s) for s in range(n_shards)), key=lambda x: (-x[0], x[1]))
    ends = list(accumulate(r for r, _ in room))
    moving = rank_within(placed.join(starts, placed.g == starts.sg).select("row", "x", "g", "start"), ["g"], [F.col("x")], spread_over(F.col("x")), "nth")
    at = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("start") + F.col("nth")))
    to = F.element_at(F.array(*[F.lit(s) for _, s in room]), at + 1)
    return cut(stay.unionByName(moving.select("row", "x", "g", to.alias("shard"))))
