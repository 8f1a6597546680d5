"""What operators on repeated passages share: dealing packed strings to buckets, and taking away spans.

A document's task cuts its text into records (packed strings), settles among its own documents what
it can, and sends the rest to buckets in zstd blocks. A bucket compares its records and returns
spans (doc_id, th, start, end). Keys that would overfill a bucket (``hot``) go to many buckets first;
each of them passes on one record for each string, and these meet in a second step. The spans of a
document meet its text again at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, give_back

#: A null doc_id counts as the largest.
NO_ID = np.iinfo(np.int64).max
SPANS = "doc_id long, th long, span_start long, span_end long"
BLOCKS = "part int, block binary"
#: Columns of a record, all of 64 bits, besides its text: what repeats are found by, what it is dealt
#: by, its document, the first of its windows, their number, and whether it may repeat itself.
KEY, LEAD, DOC, TH, START, N, OWN = range(7)
#: Buckets that a hot key is spread over, at most.
SPREAD = 1024

Span = tuple[np.ndarray, np.ndarray, np.ndarray]
Rest = tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]
#: From columns, texts (as one array) and where each ends to spans (record, start, end) and to what has
#: to be compared with other buckets' records (record, start, number of windows, text).
Settle = Callable[[list[np.ndarray], np.ndarray, np.ndarray], tuple[Span, Rest]]


@dataclass
class Records:
    """Packed strings of documents, and spans that are settled already."""

    cols: list[list[np.ndarray]] = field(default_factory=list)
    text: list[bytes] = field(default_factory=list)
    spans: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    size: int = 0

    def add(self, key: np.ndarray, lead: np.ndarray, doc: np.ndarray, th: np.ndarray, start: np.ndarray, n: np.ndarray, own: np.ndarray, text: list[bytes]) -> None:
        self.cols.append([np.ascontiguousarray(x).astype(np.uint64 if i < 2 else np.int64).view(np.int64) for i, x in enumerate((key, lead, doc, th, start, n, own))])
        self.text += text
        self.size += sum(map(len, text)) + 64 * len(text)

    def add_spans(self, doc: np.ndarray, th: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        if len(doc):
            self.spans.append((doc, th, start.astype(np.int64), end.astype(np.int64)))
            self.size += 32 * len(doc)

    def table(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*self.cols, strict=True)] if self.cols else [np.zeros(0, np.int64)] * 7

    def clear(self) -> None:
        self.cols, self.text, self.spans, self.size = [], [], [], 0


def settled(r: Records, settle: Settle, batch: int = 1 << 20) -> Records:
    """The records with what repeats among them settled: spans, and the records that are left.

    Only records are compared whose key another one has too, or that may repeat themselves; about
    ``batch`` bytes at a time, one key at least.
    """
    out = Records(spans=r.spans, size=32 * sum(len(x[0]) for x in r.spans))
    cols = r.table()
    key = cols[KEY].view(np.uint64)
    order = np.argsort(key, kind="stable")
    twin = cols[OWN][order] > 0
    if len(key) > 1:
        eq = key[order][1:] == key[order][:-1]
        twin[1:] |= eq
        twin[:-1] |= eq
    alone, pick = order[~twin], order[twin]
    if len(alone):
        out.add(*(c[alone] for c in cols), [r.text[i] for i in alone.tolist()])
    lens = np.fromiter((len(r.text[i]) for i in pick.tolist()), np.int64, len(pick))
    edge = np.concatenate(([0], np.flatnonzero(np.diff(key[pick].view(np.int64))) + 1, [len(pick)])) if len(pick) else np.zeros(1, np.int64)
    lo, filled = 0, np.cumsum(lens)
    while lo < len(pick):
        base = filled[lo - 1] if lo else 0
        hi = int(edge[max(np.searchsorted(edge, lo, "right"), np.searchsorted(edge, np.searchsorted(filled, base + batch), "right") - 1)])
        mine = pick[lo:hi]
        own = [c[mine] for c in cols]
        (rec, start, end), (rest, first, n, text) = settle(own, np.frombuffer(b"".join([r.text[i] for i in mine.tolist()]), np.uint8), np.cumsum(lens[lo:hi]))
        out.add_spans(own[DOC][rec], own[TH][rec], start, end)
        if len(rest):
            out.add(own[KEY][rest], own[LEAD][rest], own[DOC][rest], own[TH][rest], first, n, np.zeros(len(rest)), text)
        lo = hi
    return out


def _blocks(r: Records, part: np.ndarray, parts: int) -> pa.RecordBatch | None:
    """The records by part, each part's in one compressed block."""
    press = zstandard.ZstdCompressor(level=1)
    pids, blocks = [], []
    spans = [np.concatenate(x) for x in zip(*r.spans, strict=True)] if r.spans else [np.zeros(0, np.int64)] * 4
    at, cols = np.abs(spans[0] % parts), r.table()
    order, s_order = np.argsort(part, kind="stable"), np.argsort(at, kind="stable")
    for p in np.union1d(part, at):
        mine = order[np.searchsorted(part, p, sorter=order):np.searchsorted(part, p, "right", sorter=order)]
        own = s_order[np.searchsorted(at, p, sorter=s_order):np.searchsorted(at, p, "right", sorter=s_order)]
        texts = [r.text[i] for i in mine.tolist()]
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = [np.array([len(mine), len(own)], np.int64), *(c[mine] for c in cols), lens, *(c[own] for c in spans)]
        blocks.append(press.compress(b"".join([*(np.ascontiguousarray(x).tobytes() for x in raw), *texts])))
        pids.append(int(p))
    if not pids:
        return None
    return pa.RecordBatch.from_arrays([pa.array(pids, pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])


def _unpack(block: bytes, into: Records) -> None:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    longs = np.frombuffer(raw, np.int64, 8 * n + 4 * m, 16)
    if n:
        ends = np.cumsum(longs[7 * n:8 * n]) + 16 + 8 * (8 * n + 4 * m)
        into.cols.append([longs[i * n:(i + 1) * n] for i in range(7)])
        into.text += [raw[b - k:b] for b, k in zip(ends.tolist(), longs[7 * n:8 * n].tolist(), strict=True)]
    if m:
        into.spans.append(tuple(longs[8 * n + i * m:8 * n + (i + 1) * m] for i in range(4)))


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    """doc, th and UTF-8 text of rows (doc_id, text, th); null texts left out."""
    for b in batches:
        ids, texts, ths = b.column(0), b.column(1), b.column(2).to_numpy(zero_copy_only=False)
        ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        for i in range(b.num_rows):
            if (t := texts[i]).is_valid:
                yield int(ids[i]), int(ths[i]), t.as_buffer().to_pybytes()


Cutter = Callable[[Iterator[tuple[int, int, bytes]], Records], Iterator[None]]


def sampled(docs: DataFrame, n_docs: int, parts: int, least: int = 2000, each: int = 64) -> DataFrame:
    """Documents to steer by: ``each`` for a bucket, so their number grows with the table. They decide where
    records meet, never which are found."""
    rows, want = docs.select("doc_id", "text", "th"), max(least, each * parts)
    return cut(rows if n_docs <= want else rows.sample(want / n_docs, 7))


def hot_keys(sample: DataFrame, cutter: Cutter, parts: int, share: float = 0.15) -> np.ndarray:
    """Keys that hold more than ``share`` of a bucket's records; parts / share at most. Sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Records()
        for _ in cutter(texts_of(batches), r):
            key, n = np.unique(r.table()[KEY], return_counts=True)
            r.clear()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["k", "n"])

    counts = cut(sample.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).head()[0] or 0
    found = counts.where(F.col("n") > max(8, share * total / parts)).select("k").collect()
    return np.sort(np.array([r.k for r in found], np.int64))


def deal(docs: DataFrame, cutter: Cutter, settle: Settle, part_of: Callable[[np.ndarray], np.ndarray], parts: int, hot: np.ndarray, flush: int = 16 << 20) -> DataFrame:
    """Spans of ``docs`` (columns doc_id, text, th).

    ``cutter`` takes (doc_id, th, UTF-8 text) of a task's documents and adds records, yielding now and
    then; ``part_of`` deals leads to buckets.
    """

    def is_hot(cols: list[np.ndarray]) -> np.ndarray:
        at = np.minimum(np.searchsorted(hot, cols[KEY]), max(0, len(hot) - 1))
        return hot[at] == cols[KEY] if len(hot) else np.zeros(len(cols[KEY]), bool)

    def home(cols: list[np.ndarray]) -> np.ndarray:
        return part_of(cols[LEAD].view(np.uint64)).astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            done = settled(r, settle)
            cols = done.table()
            part = home(cols)
            spread = (cols[DOC] ^ cols[DOC] >> 17 ^ cols[TH]) & (2**62 - 1)
            part = np.where(is_hot(cols), (part + spread % min(parts, SPREAD)) % parts, part)
            if (b := _blocks(done, part, parts)) is not None:
                yield b
            give_back()

        r = Records()
        for _ in cutter(texts_of(batches), r):
            if r.size >= flush:
                yield from out()
                r.clear()
        yield from out()

    def bucket(batches: Iterator[pa.RecordBatch]) -> Records:
        r = Records()
        for b in batches:
            for block in b.column(1):
                _unpack(block.as_buffer().to_pybytes(), r)
        return settled(r, settle)

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = bucket(batches)
        cols = done.table()
        keep = np.flatnonzero(is_hot(cols))
        done.cols, done.text = [[c[keep] for c in cols]], [done.text[i] for i in keep.tolist()]
        if (b := _blocks(done, home(done.cols[0]), parts)) is not None:
            yield b
        give_back()

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, th, start, end in bucket(batches).spans:
            for lo in range(0, len(doc), 200_000):
                s = slice(lo, lo + 200_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[s], mask=doc[s] == NO_ID), pa.array(th[s]), pa.array(start[s]), pa.array(end[s])],
                    ["doc_id", "th", "span_start", "span_end"],
                )
        give_back()

    sent = docs.select("doc_id", "text", "th").mapInArrow(send, BLOCKS)
    if len(hot):
        sent = sent.repartitionById(parts, F.col("part")).mapInArrow(pass_on, BLOCKS)
    return sent.repartitionById(parts, F.col("part")).mapInArrow(receive, SPANS)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, th and others) with ``spans``: an array of (span_start, span_end), or null.

    A document's spans are no more than its text has room for.
    """
    grouped = spans.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(
        F.collect_list(F.struct("span_start", "span_end")).alias("spans")
    )
    return docs.join(grouped, docs.doc_id.eqNullSafe(grouped.d) & docs.th.eqNullSafe(grouped.t), "left").drop("d", "t")


def span_arrays(column: pa.ListArray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of row ``i`` of a column of spans."""
    x = column[i].values if column[i].is_valid else None
    if x is None or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return x.field(0).to_numpy(zero_copy_only=False), x.field(1).to_numpy(zero_copy_only=False)
