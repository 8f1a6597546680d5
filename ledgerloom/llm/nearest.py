"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table's hash is the cell of a grid over a few Gaussian projections. A query visits cells in the
order of the estimated probability that a neighbour lies in them. What the visited cells of all
tables hold is compared exactly, in blocks, and a query's best are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

#: Cells along a projection; the outer ones have no end.
LEVELS = 4
#: Projections of a table, most: what is held for each cell then stays small, on the driver too. Larger cells are dealt over blocks.
MOST = 7
#: Comparisons that sending a query to a cell is worth, by time.
VISIT = 256
_erf = np.vectorize(math.erf, otypes=[float])


@dataclass
class Index:
    """Everything here is bounded: tables x LEVELS**functions cells."""

    dim: int
    largest: float
    planes: np.ndarray  # (tables, dim + 1, functions)
    middle: np.ndarray  # (tables, functions)
    width: np.ndarray
    spread: np.ndarray  # of a neighbour's projection around the query's
    share: float = 1.0
    visits: float = 0.0  # cells that a query visits
    count: np.ndarray | None = None  # (tables, cells)

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(tables, rows, functions). One more component makes all rows equally long, so that the
        largest inner product is the smallest distance; a query's length does not matter."""
        length = np.sqrt((x * x).sum(1))
        if query:
            x = np.column_stack([x * (self.largest / np.maximum(length, 1e-300))[:, None], np.zeros(len(x))])
        else:
            x = np.column_stack([x, np.sqrt(np.maximum(self.largest**2 - length**2, 0))])
        return np.einsum("nd,tdk->tnk", x, self.planes, optimize=True)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """(tables, rows): the cell of each row."""
        p = np.floor((self.project(x, False) - self.middle[:, None]) / self.width[:, None]) + LEVELS // 2
        p = np.clip(p, 0, LEVELS - 1).astype(np.int64)
        return (p * LEVELS ** np.arange(p.shape[2])).sum(2)

    def probes(self, x: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(table, query, cell, rows in the cells before it) of the visits: until the cells hold ``share`` of all rows and ``least`` rows."""
        z = self.project(x, True)
        k = z.shape[2]
        edges = np.concatenate(([-np.inf], np.arange(1, LEVELS) - LEVELS // 2, [np.inf]))
        for t in range(len(z)):
            at = np.flatnonzero(self.count[t])
            levels = at[:, None] // LEVELS ** np.arange(k) % LEVELS
            need = max(self.share * self.count[t].sum(), least)
            step = max(1, min(256, (1 << 20) // max(1, len(at))))
            for lo in range(0, z.shape[1], step):
                u = (z[t, lo:lo + step] - self.middle[t]) / self.width[t]
                s = (self.spread[t] / self.width[t])[None, :, None] * math.sqrt(2)
                cdf = 0.5 * (1 + _erf(np.clip((edges[None, None] - u[:, :, None]) / s, -9, 9)))
                log_p = np.log(np.maximum(np.diff(cdf, axis=2), 1e-12))
                chance = sum(log_p[:, j][:, levels[:, j]] for j in range(k))
                order = np.argsort(-chance, axis=1, kind="stable")
                held = np.cumsum(self.count[t][at][order], axis=1)
                held = np.concatenate([np.zeros((len(u), 1), np.int64), held[:, :-1]], axis=1)
                q, nth = np.nonzero(held < need)
                yield t, q + lo, at[order[q, nth]], held[q, nth]


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _nearest_rows(x: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` rows of ``x`` nearest to each of ``rows``, itself left out."""
    score = x[rows] @ x.T
    score[np.arange(len(rows)), rows] = -np.inf
    return np.argpartition(-score, min(k, score.shape[1]) - 1, axis=1)[:, :k]


def choose(x: np.ndarray, n: int, largest: float, top: int, tables: tuple[int, ...], queries: int, recall: float, block: int, seed: int) -> Index:
    """The index with the least work: first the number of functions, with the fewest tables, then that of tables."""

    def work(i: Index) -> float:
        return i.share * len(i.planes) * n + VISIT * (i.visits + i.share * len(i.planes) * n / block)

    most = min(MOST, max(3, round(math.log2(max(1, n / 800)))))
    best = min((fit(x, n, largest, top, tables[0], f, queries, recall, seed) for f in range(most, 2, -2)), key=work)
    functions = best.planes.shape[2]
    return min([best, *(fit(x, n, largest, top, t, functions, queries, recall, seed) for t in tables[1:])], key=work)


def fit(x: np.ndarray, n: int, largest: float, top: int, tables: int, functions: int, queries: int, recall: float, seed: int) -> Index:
    """Planes, cells and the share of rows to visit, from a sample ``x`` of ``n`` rows: the least share with which
    ``queries`` of its rows reach ``recall`` against brute force among the sample. Neighbours there are as many of the
    nearest as ``top`` of all rows come to."""
    rng = np.random.default_rng(seed)
    index = Index(x.shape[1], largest, rng.standard_normal((tables, x.shape[1] + 1, functions)), *[np.zeros((tables, functions))] * 3)
    p = index.project(x, False)
    index.width = np.maximum(2 * p.std(1), 1e-12)
    index.middle = p.mean(1) + (rng.random((tables, functions)) - 0.5) * index.width
    q = x[:queries]
    k = min(max(1, round(top * len(x) / n)), max(1, len(x) - 1))
    best = np.concatenate([_nearest_rows(x, np.arange(lo, min(lo + 128, len(q))), k) for lo in range(0, len(q), 128)])
    gap = np.take_along_axis(p, np.broadcast_to(best.ravel()[None, :, None], (tables, best.size, functions)), 1).reshape(tables, len(q), k, functions)
    index.spread = np.maximum(np.sqrt(((gap - index.project(q, True)[:, :, None]) ** 2).mean((1, 2))), 1e-12)
    cells = index.cells(x)
    index.count = np.array([np.bincount(c, minlength=LEVELS**functions) for c in cells])
    # how much of each table is visited before a neighbour's cell is
    index.share = 1.0
    before, visited = np.ones(best.shape), np.zeros(1001, np.int64)
    for t, qi, cell, held in index.probes(q, top + 1):
        part = held / max(1, len(x))
        visited += np.bincount((part * 1000).astype(np.int64), minlength=1001)
        lo, own = qi.min(), len(np.unique(qi))
        upto = np.full((own, LEVELS**functions), 2.0, np.float32)
        upto[qi - lo, cell] = part
        before[lo:lo + own] = np.minimum(before[lo:lo + own], np.take_along_axis(upto, cells[t][best[lo:lo + own]], 1))
    index.share = float(np.quantile(before, recall)) + 1e-6
    index.visits = visited[: math.ceil(max(index.share, (top + 1) / max(1, len(x))) * 1000)].sum() / max(1, len(q))
    return index


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """Each query's ``top`` best, each vector once, in order; and their ranks."""
    o = np.lexsort((vec, -score, query))
    query, vec, score = query[o], vec[o], score[o]
    _, first = np.unique(np.column_stack([query, vec]), axis=0, return_index=True) if len(query) else (None, np.zeros(0, int))
    first.sort()
    query, vec, score = query[first], vec[first], score[first]
    start = np.concatenate(([True], query[1:] != query[:-1])) if len(query) else np.zeros(0, bool)
    rank = np.arange(len(query)) - np.maximum.accumulate(np.where(start, np.arange(len(query)), 0))
    keep = rank < top
    return query[keep], vec[keep], score[keep], rank[keep] + 1


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], top: int) -> tuple[np.ndarray, ...]:
    return _best(*(np.concatenate(x) for x in zip(*parts, strict=True)), top)


def _block(q: np.ndarray, qi: np.ndarray, m: np.ndarray, mi: np.ndarray, least: np.ndarray, top: int, spare: int) -> tuple[np.ndarray, ...]:
    """The ``top`` best rows ``m`` of each query that score ``least`` or more. ``spare``: rows that repeat an id."""
    s = q @ m.T
    s[qi[:, None] == mi[None]] = -np.inf
    k = min(top + 4 + spare, s.shape[1])  # some more: the product may round equal vectors apart
    last = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    last = np.maximum(last, least)
    r, c = np.nonzero((s >= (last - np.abs(last) * 1e-12)[:, None]) & (s > -np.inf))
    score = np.concatenate([np.zeros(0), *((q[r[lo:lo + 65536]] * m[c[lo:lo + 65536]]).sum(1) for lo in range(0, len(r), 65536))])
    return _best(qi[r], mi[c], score, top)[:3]


def _some(rows: DataFrame, ids: int, sample: int, dim: int) -> np.ndarray:
    """The vectors of about ``sample`` ids, at most; those with the least hashes. Partitions send few more than are taken."""
    most = -(2**63) + min(2**64 - 1, int(2**64 * 1.2 * sample / max(1, ids)))
    few = rows.where(F.xxhash64("vec_id") <= F.lit(most)).groupBy("vec_id").agg(F.min("v").alias("v"))
    got = few.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    return _vectors(got["v"].combine_chunks(), dim)


def search(
    vectors: DataFrame, every: int = 20, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: tuple[int, ...] = (1, 2, 4), sample: int = 8192, queries: int = 1024, recall: float = 0.94, block: int = 4096, seed: int = 7,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (inner product, double).

    Queries are the rows whose id is divisible by ``every``; candidates all rows but the query's own.
    Every row is indexed; only the grid, the number of ``tables`` and of cells (those with the least work) and of
    visits are fitted, on at most ``sample`` rows, for the ``recall``. A query visits at least so many cells that they hold ``top`` rows besides it, so with fewer
    rows it gets all. Ties go to the smaller id. Ids or vectors that are null, and vectors that are
    zero, hold null or non-finite components or have another length than most, take no part. Rows
    that repeat an id count as one, at its best score. Cells with more than ``block`` rows (up to four times that in large
    tables) are dealt over several blocks. A task holds one block's rows; queries pass by.
    """
    spark = vectors.sparkSession
    kept = vectors.schema[vector_col].dataType.elementType
    kind, dtype = ("float", np.float32) if isinstance(kept, FloatType) else ("double", np.float64)  # as they are sent
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~odd)
    rows = rows.withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).where("square > 0")
    counts = (F.count(F.lit(1)).alias("n"), F.approx_count_distinct("vec_id").alias("ids"), F.max("square").alias("m"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(*counts).orderBy(F.desc("n"), "d").head(1)
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, n = sizes[0].d, sizes[0].n
    rows = rows.where(F.size("v") == dim).select("vec_id", "v")
    block = max(block, min(4 * block, n // 128))
    x = _some(rows, sizes[0].ids, max(1024, min(sample, (1 << 22) // dim)), dim)
    index = choose(x, n, math.sqrt(sizes[0].m), top, tables, queries, recall, block, seed)
    functions = index.planes.shape[2]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = index.cells(_vectors(b.column(1), dim))
                t = np.repeat(np.arange(len(c)), b.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(c.ravel().astype(np.int32))], ["t", "cell"])

    full = np.zeros((len(index.planes), LEVELS**functions), np.int64)
    held = rows.mapInArrow(place, "t int, cell int").groupBy("t", "cell").count().toArrow()
    full[held["t"].to_numpy(), held["cell"].to_numpy()] = held["count"].to_numpy()
    index.count = full
    blocks = np.maximum(1, -(-full // block))
    first = np.concatenate(([0], np.cumsum(blocks.ravel())))[:-1].reshape(full.shape)
    sent = n * len(full) + n // every * index.share * int(blocks.sum())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(sent * dim * dtype().itemsize // (64 << 20)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows, and queries for each block of the cells that they visit."""

        def out(to: np.ndarray, query: bool, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(to), 8192):
                s = slice(lo, lo + 8192)
                flat = pa.array(x[s].astype(dtype).ravel())
                v = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, dim), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(to[s]), pa.array(np.full(len(ids[s]), query)), pa.array(ids[s]), v], ["block", "query", "id", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), _vectors(b.column(1), dim)
            for t, c in enumerate(index.cells(x)):
                yield from out(first[t, c] + np.abs(ids * 2654435761 >> 7) % blocks[t, c], False, ids, x)
            mine = np.flatnonzero(ids % every == 0)
            for t, q, c, _ in index.probes(x[mine], top + 1) if len(mine) else ():
                rep = np.repeat(np.arange(len(q)), blocks[t, c])
                nth = np.arange(len(rep)) - np.repeat(np.cumsum(blocks[t, c]) - blocks[t, c], blocks[t, c])
                who = mine[q[rep]]
                yield from out(first[t, c[rep]] + nth, True, ids[who], x[who])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Block by block: the rows come first and are held, the queries pass by."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        known, bound = np.zeros(0, np.int64), np.zeros(0)  # queries, and the least of their ``top`` so far
        mine, parts_of_mine = -1, []
        m, mi, spare = np.zeros((0, dim)), np.zeros(0, np.int64), 0

        def out() -> pa.RecordBatch:
            qi, vi, sc = held.pop()
            return pa.RecordBatch.from_arrays([pa.array(qi), pa.array(vi), pa.array(sc)], ["query_id", "vec_id", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            to, query, ids = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            x = _vectors(b.column(3), dim)
            edge = np.concatenate(([0], np.flatnonzero((np.diff(to) != 0) | (query[1:] != query[:-1])) + 1, [len(to)]))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if not query[lo]:
                    if to[lo] != mine:
                        mine, parts_of_mine = to[lo], []
                    parts_of_mine.append((x[lo:hi], ids[lo:hi]))
                    continue
                if to[lo] != mine:  # a block without rows
                    continue
                if parts_of_mine:
                    m, mi = (np.concatenate(c) for c in zip(*parts_of_mine, strict=True))
                    parts_of_mine, spare = [], len(mi) - len(np.unique(mi))
                step = max(1, (1 << 21) // len(m))
                for a in range(lo, hi, step):
                    q, qi = x[a:min(hi, a + step)], ids[a:min(hi, a + step)]
                    least = np.full(len(qi), -np.inf)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, qi), len(known) - 1)
                        least = np.where(known[at] == qi, bound[at], -np.inf)
                    held.append(_block(q, qi, m, mi, least, top, spare))
                if sum(len(h[0]) for h in held) > 1_000_000:
                    qi, vi, sc, rank = _merged(held, top)
                    held = [(qi, vi, sc)]
                    if len(qi) > 600_000:
                        yield out()
                    known, bound = qi[rank == top], sc[rank == top]
        if held:
            held = [_merged(held, top)[:3]]
            yield out()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in batches:
            held.append(tuple(b.column(i).to_numpy() for i in range(3)))
            if sum(len(h[0]) for h in held) > 2_000_000:
                held = [_merged(held, top)[:3]]
        if held:
            qi, vi, sc, rank = _merged(held, top)
            yield pa.RecordBatch.from_arrays([pa.array(qi), pa.array(rank.astype(np.int32)), pa.array(vi), pa.array(sc)], ["query_id", "rank", "vec_id", "score"])

    dealt = rows.mapInArrow(deal, f"block long, query boolean, id long, v array<{kind}>")
    met = dealt.repartition(parts, "block").sortWithinPartitions("block", "query").mapInArrow(meet, "query_id long, vec_id long, score double")
    ends = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n // every // 50_000))
    return met.repartition(ends, "query_id").mapInArrow(finish, schema)


def recall_of(found: DataFrame, ids: np.ndarray, x: np.ndarray, every: int = 20, top: int = 20) -> float:
    """Share of the true neighbours among ``found``, by brute force; for tests."""
    got = {(r.query_id, r.vec_id) for r in found.select("query_id", "vec_id").collect()}
    hits = total = 0
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        s[i] = -np.inf
        for j in np.lexsort((ids, -s))[: min(top, len(ids) - 1)]:
            total += 1
            hits += (int(ids[i]), int(ids[j])) in got
    return hits / max(1, total)
