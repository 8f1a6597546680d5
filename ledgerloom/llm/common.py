"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_LIBC = ctypes.CDLL(None)
WORDS = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, now in use. Where none is set a folder is made, but only on a
    local master: executors of a cluster could not read it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir", "")
        if not shared and not re.fullmatch(r"local(\[[^]-]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="ledgerloom-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, which may not have it on its path. Once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerloom_shipped", False):
        return
    base = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="ledgerloom-"), "ledgerloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(base.rglob("*.py")):
            z.write(f, f.relative_to(base.parent))
    sc.addPyFile(str(path))
    sc._ledgerloom_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keyed_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` (long), ``text`` and ``th``, a hash of the text.

    Only these columns are taken, so extra columns of any name do no harm. ``(doc_id, th)`` is the
    row's key: rows that repeat both get the same result.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.col(text_col).cast("string")).alias("th"),
    )


def parts_for(spark: SparkSession, total_bytes: int, per_part: int, most: int = 400_000) -> int:
    """Partitions for so many bytes, at least ``spark.sql.shuffle.partitions``; beyond ``most`` they grow instead (250 MB at 100 TB)."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(most, -(-int(total_bytes) // per_part)))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).head()[0] or 0


def spread_over(key: Column, cells: int = 256) -> list[Column]:
    """One cell of ``cells`` that ``key`` decides, for ``rank_within``."""
    return [F.pmod(key, F.lit(cells)).cast("int")]


def rank_within(df: DataFrame, group: list[str], order: list[Column], cells: list[Column], name: str) -> DataFrame:
    """Adds ``name``: gapless ranks from 0 in each group, without bringing a group into one task.

    ``cells`` deals a group's rows to cells that follow each other in the order of their columns; rows are
    ranked by ``order`` inside a cell, and a cell starts where the counts of the group's earlier cells
    end. Only the counts (groups x cells) meet in one place.
    """
    names = [f"_cell{i}" for i in range(len(cells))]
    cell = df.withColumns(dict(zip(names, cells, strict=True)))
    counts = cell.groupBy(*group, *names).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(
        *[F.col(g).alias(f"_g_{g}") for g in [*group, *names]],
        (F.sum("_n").over(W.partitionBy(*group).orderBy(*names)) - F.col("_n")).alias("_start"),
    )
    inner = F.row_number().over(W.partitionBy(*group, *names).orderBy(*order))
    ranked = cell.withColumn("_in", inner)
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    for g in names:
        on = on & (F.col(g) == F.col(f"_g_{g}"))
    out = ranked.join(starts, on, "inner").withColumn(name, (F.col("_start") + F.col("_in") - 1).cast("long"))
    return out.select(*df.columns, name)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` at most, so that what is made of long texts stays small."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(_LIBC, "malloc_trim", None)) is not None:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, by doubling."""
    if len(h) < w:
        return h[:0]
    span = 1
    while span * 2 <= w:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    d = w - span
    return np.minimum(h[:-d], h[d:]) if d else h


class Rolling:
    """Hashes of substrings of one array of 64-bit symbols, from prefix sums modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15 | 1
    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    @classmethod
    def _powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._up) <= n:
            m = 1 << (n + 1).bit_length()
            for name, base in (("_up", cls.BASE), ("_down", pow(cls.BASE, -1, 2**64))):
                p = np.full(m, base, np.uint64)
                p[0] = 1
                setattr(cls, name, np.cumprod(p, dtype=np.uint64))
        return cls._up, cls._down

    def __init__(self, codes: np.ndarray):
        self.up, down = self._powers(len(codes))
        self.prefix = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * down[: len(codes)], out=self.prefix[1:])

    def every(self, k: int) -> np.ndarray:
        """The mixed hash of each ``k`` consecutive symbols."""
        n = len(self.prefix) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix64((self.prefix[k:] - self.prefix[:n]) * self.up[:n])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The mixed hash of symbols ``start`` to ``end`` (exclusive), elementwise."""
        return mix64((self.prefix[end] - self.prefix[start]) * self.up[start] + (end - start).astype(np.uint64))


#: A random 64-bit value for each byte.
BYTE_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=np.uint64)


def ranges_to_mask(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True at each of ``n`` places that some range [start, end) covers."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def mask_to_ranges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    d = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)

