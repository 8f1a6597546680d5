"""Document fingerprints from improbable features.

Every window of 64 bytes is a feature; texts under 512 bytes have shorter ones too, or only. A feature's rarity is
its self-information under the byte pairs of the whole corpus. A feature is chosen if it is the rarest of many of the stretches of features that hold
it. The chosen ones are put into Bloom filters, a new one whenever one is full, and fingerprints are
compared by the bits that their filters share beyond what chance gives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import BYTE_CODES, Rolling, cut, mix64, parts_for

#: Bytes of a feature, the lengths of text that have such features, the features of a stretch, and of how many
#: stretches a feature must be the rarest. Lengths overlap, so texts of almost one length share some kind.
KINDS = ((2, 0, 32, 1, 1), (8, 16, 512, 8, 2), (64, 64, 2**63, 64, 16))
FILTER_BITS, HASHES, PER_FILTER = 2048, 5, 160
_POWERS = np.cumprod(np.array([1, *[Rolling.BASE] * 63], np.uint64), dtype=np.uint64)
_SHIFTS = (np.arange(HASHES) * 11).astype(np.uint64)


def pair_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each pair of neighbouring bytes occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(65536, np.int64)
        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    x = np.frombuffer(t.as_buffer(), np.uint8)
                    for lo in range(0, max(0, len(x) - 1), 1 << 20):
                        y = x[lo:lo + (1 << 20) + 1]
                        n += np.bincount(y[:-1].astype(np.uint16) << 8 | y[1:], minlength=65536)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["pair", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "pair int, n long")
    out = np.zeros(65536, np.int64)
    for r in rows.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    return out


def surprise(counts: np.ndarray) -> np.ndarray:
    """Bits of the second byte given the first, in 1/64 bits, for each pair."""
    n = counts.reshape(256, 256) + 1.0
    return np.rint(-np.log2(n / n.sum(1, keepdims=True)) * 64).astype(np.int64).ravel()


def _sliding_max(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        x = np.maximum(x[:-span], x[span:])
        span *= 2
    d = w - span
    return np.maximum(x[:-d], x[d:]) if d else x


def _chosen(raw: np.ndarray, bits: np.ndarray, width: int, stretch: int, popular: int, chunk: int) -> np.ndarray:
    """Hashes of a text's chosen features of ``width`` bytes, in order."""
    total = len(raw) - width + 1
    stretch = min(stretch, total)
    votes = np.zeros(total, np.int32)
    for lo in range(0, total - stretch + 1, chunk):
        x = raw[lo:lo + chunk + stretch + width - 2]
        info = np.concatenate(([0], np.cumsum(bits[x[:-1].astype(np.uint16) << 8 | x[1:]])))
        rare = info[width - 1:] - info[: len(info) - width + 1]
        m = len(rare)
        best = _sliding_max(rare << 32 | np.arange(m - 1, -1, -1), stretch)[: chunk]
        at = m - 1 - (best & 0xFFFFFFFF)
        votes[lo:lo + m] += np.bincount(at, minlength=m).astype(np.int32)
    chosen = np.flatnonzero(votes >= min(popular, max(1, (total - stretch + 1) // 4)))
    out = [np.zeros(0, np.uint64)]
    for lo in range(0, len(chosen), 1 << 14):
        part = chosen[lo:lo + (1 << 14), None] + np.arange(width)
        out.append(mix64((BYTE_CODES[raw[part]] * _POWERS[:width]).sum(1, dtype=np.uint64) + np.uint64(width)))
    return np.concatenate(out)


def features(text: bytes, bits: np.ndarray, chunk: int = 1 << 20) -> np.ndarray:
    """Hashes of a text's chosen features in order, each once, short features first."""
    raw = np.frombuffer(text, np.uint8)
    kinds = [(min(w, len(raw)), *x) for w, least, most, *x in KINDS if least <= len(raw) < most] if len(raw) else []
    h = np.concatenate([np.zeros(0, np.uint64), *(_chosen(raw, bits, *k, chunk) for k in kinds)])
    _, first = np.unique(h, return_index=True)
    return h[np.sort(first)]


def filters(h: np.ndarray) -> np.ndarray:
    """Chained Bloom filters, packed: a row for each."""
    n = -(-len(h) // PER_FILTER)
    bits = np.zeros((n, FILTER_BITS), np.uint8)
    places = (h[:, None] >> _SHIFTS) & np.uint64(FILTER_BITS - 1)
    bits[np.repeat(np.arange(len(h)) // PER_FILTER, HASHES), places.ravel().astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def fingerprint(text: bytes, bits: np.ndarray) -> np.ndarray:
    return filters(features(text, bits))


def _one_way(common: np.ndarray, na: np.ndarray, nb: np.ndarray) -> float:
    chance = na[:, None] * nb[None] / FILTER_BITS
    most = np.minimum(na[:, None], nb[None])
    score = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(1)
    return float((score * na).sum() / na.sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: how much of the fingerprint with fewer filters the other one holds.

    Overlap is normalised: 0 is what two filters of so many bits share by chance, 1 the most that
    they can. Two empty fingerprints are alike, an empty one and another are not.
    """
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    x, y = (np.unpackbits(f, axis=1).astype(np.float32) for f in (a, b))
    common, na, nb = (x @ y.T).astype(np.float64), x.sum(1, dtype=np.float64), y.sum(1, dtype=np.float64)
    if len(a) == len(b):
        return (_one_way(common, na, nb) + _one_way(common.T, nb, na)) / 2
    return _one_way(common, na, nb) if len(a) < len(b) else _one_way(common.T, nb, na)


def edit(text: str, other: str) -> str:
    """The last third of ``text`` replaced by as much of the beginning of ``other``."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``fingerprint`` (hex digits of its filters; '' for null and empty texts)."""
    bits = surprise(pair_counts(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", bits).tobytes().hex() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def _bucket_of(k: np.ndarray, th: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """How many of the sorted ``bounds`` (k, th) are at or before each row."""
    a, b = (np.array([x[i] for x in bounds], np.int64) for i in (0, 1))
    lo, hi = np.searchsorted(a, k, "left"), np.searchsorted(a, k, "right")
    for i in np.flatnonzero(hi > lo):  # few rows: those of an id that is a bound
        lo[i] += np.searchsorted(b[lo[i]:hi[i]], th[i], "right")
    return lo


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 32 << 20) -> DataFrame:
    """Partitions of (doc_id, text, guest) in descending order of ``doc_id``, the last row a guest.

    A partition's guest is the row that comes next after its last: the next partition's first, and
    after all the very first. Splitters of the ids deal the rows, so texts are shuffled once and no
    order of all rows is needed in one place; an id (or null) with rows for more than a partition is split by
    the texts' hashes. Nulls come last, ties in the order of the texts' hashes.
    """
    # ``k`` ascends as doc_id descends
    rows = docs.select(
        F.coalesce(F.bitwise_not(F.col(id_col).cast("long")), F.lit(2**63 - 1)).alias("k"), F.col(text_col).cast("string").alias("text"),
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"),
    )
    keys = cut(rows.select("k", "th", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("b")))
    size = keys.agg(F.sum("b"), F.count(F.lit(1))).head()
    parts = parts_for(docs.sparkSession, size[0] or 0, bucket_bytes)

    def evenly(column: str, n: int) -> Column:
        return F.percentile_approx(column, F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(max(10_000, 20 * n)))

    bounds = {(x, -(2**63)) for x in (keys.agg(evenly("k", parts)).head()[0] or [] if parts > 1 else [])}
    for r in keys.groupBy("k").count().where(F.col("count") * parts > 2 * size[1]).collect() if parts > 1 else ():  # parts / 2 at most
        n = -(-r["count"] * parts // size[1])
        bounds |= {(r.k, x) for x in keys.where(F.col("k") == r.k).agg(evenly("th", n)).head()[0]}
    bounds = sorted(bounds)

    @F.pandas_udf("int")
    def bucket(k: pd.Series, th: pd.Series) -> pd.Series:
        return pd.Series(_bucket_of(k.to_numpy(), th.to_numpy(), bounds))

    firsts = keys.withColumn("bucket", bucket("k", "th")).groupBy("bucket").agg(F.min(F.struct("k", "th")).alias("f"))
    order = sorted(firsts.collect(), key=lambda r: r.bucket)  # a row for each partition
    guests = [(r.f.k, r.f.th, order[i - 1].bucket) for i, r in enumerate(order)]
    named = F.broadcast(docs.sparkSession.createDataFrame(guests, "gk long, gth long, host int"))
    met = rows.withColumn("bucket", bucket("k", "th")).join(named, (F.col("k") == F.col("gk")) & (F.col("th") == F.col("gth")), "left")
    own = F.struct(F.col("bucket").alias("to"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("host").alias("to"), F.lit(True).alias("guest"))
    sent = met.select("k", "doc_id", "text", "th", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("x"))
    dealt = sent.select("k", "doc_id", "text", "th", "x.to", "x.guest").repartitionById(len(bounds) + 1, F.col("to"))
    return dealt.sortWithinPartitions("guest", "k", "th").select("doc_id", "text", "guest")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The next document is the one with the next smaller ``doc_id``; nulls come last, rows that repeat a ``doc_id`` in the order
    of their texts' hashes. Null texts are empty; empty texts have the fingerprint ''. The only row of a table is its
    own next document; an empty table gives no rows.
    """
    bits = surprise(pair_counts(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (doc_id, text, fingerprint) that waits for the row after it
        ended = False
        for b in batches:
            rows = []
            for i, t, guest in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                if ended:
                    continue
                text = t.as_py() if t.is_valid else ""
                fp = fingerprint(text.encode("utf-8", "surrogatepass"), bits)
                if last is not None:
                    changed = edit(last[1], text).encode("utf-8", "surrogatepass")
                    other = fingerprint(changed, bits)
                    rows.append((
                        last[0], len(last[1]), hashlib.sha256(changed).hexdigest(), last[2].tobytes().hex(), other.tobytes().hex(),
                        likeness(last[2], other), likeness(last[2], fp),
                    ))
                last, ended = (i, text, fp), guest
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], _COLUMNS)

    return beside_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
