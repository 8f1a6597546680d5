"""Windows of consecutive symbols (bytes or words), their minimisers, and which windows repeat.

A window's minimiser is the least hash of the grams inside it, so equal windows have equal
minimisers. Consecutive windows of a document that share one form a run; a run travels as one
packed string under its minimiser.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import BYTE_CODES, Rolling, mask_to_ranges, sliding_min
from ledgerloom.llm.repeats import LEAD, Records, Rest, Settle, Span, texts_of

#: Symbols that are worked on at a time; longer texts are cut into overlapping pieces.
CHUNK = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
TOP = np.uint64(1 << 63)


@dataclass
class Symbols:
    """Symbols of some texts, one after another: codes, and where each symbol's bytes begin and end."""

    buf: bytes
    codes: np.ndarray
    begin: np.ndarray | None = None
    end: np.ndarray | None = None
    raw_begin: np.ndarray | None = None

    def slice(self, a: int, b: int) -> bytes:
        """The bytes of symbols ``a`` to ``b`` (exclusive)."""
        return self.buf[a:b] if self.begin is None else self.buf[self.begin[a]:self.end[b - 1]]


def by_bytes(buf: bytes) -> Symbols:
    return Symbols(buf, BYTE_CODES[np.frombuffer(buf, np.uint8)])


def by_words(buf: bytes) -> Symbols:
    """Words are runs of other bytes than ASCII white space; in ``buf`` one space comes between them.

    A word's code depends on its bytes alone. ``raw_begin``: where words begin in the bytes given.
    """
    raw = np.frombuffer(buf, np.uint8)
    space = SPACE[raw]
    raw_begin, _ = mask_to_ranges(~space)
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    flat = np.where(space, np.uint8(0x20), raw)[keep]
    begin, end = mask_to_ranges(flat != 0x20)
    return Symbols(flat.tobytes(), Rolling(BYTE_CODES[flat]).at(begin, end), begin, end, raw_begin)


@dataclass
class Scheme:
    """k symbols a window, m a gram. Buckets are dealt by the leading bytes of the gram if ``by_lead``, else by its hash."""

    split: Callable[[bytes], Symbols]
    k: int
    m: int
    by_lead: bool
    common: np.ndarray

    def order(self, grams: np.ndarray) -> np.ndarray:
        """Grams known to be common come after all others, so that they gather few windows."""
        h = grams >> np.uint64(1)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
            h = np.where(self.common[at] == h, h | TOP, h)
        return h


def eight(raw: np.ndarray, at: np.ndarray, back: bool = False, step: int = 1 << 16) -> np.ndarray:
    """The eight bytes from places ``at`` on (``back``: before them, the nearest first) as one number; zeros outside."""
    out = np.zeros(len(at), np.uint64)
    way = -1 - np.arange(8) if back else np.arange(8)
    for lo in range(0, len(at), step):
        i = at[lo:lo + step, None] + way
        inside = (i >= 0) & (i < len(raw))
        out[lo:lo + step] = np.where(inside, raw[np.clip(i, 0, max(0, len(raw) - 1))], 0).astype(np.uint8).view(">u8").ravel()
    return out


def repeated(s: Symbols, roll: Rolling, pos: np.ndarray, doc: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of ``k`` symbols that start at ``pos``: which of them a smaller document has too, and which to pass on.

    Windows are sorted by hash; what ties is compared byte by byte with the group's first window (least
    document, then place), in whole runs. All of the first one's document's windows are passed on.
    """
    n = len(pos)
    hit = np.zeros(n, bool)
    v = roll.at(pos, pos + k)
    idx = np.argsort(v)
    v = v[idx]
    eq = v[1:] == v[:-1]
    keep = np.concatenate((eq, [False])) | np.concatenate(([False], eq)) if len(v) else np.zeros(0, bool)
    idx, group = idx[keep], v[keep]
    if not len(idx):
        return hit, ~hit
    ids = np.cumsum(np.concatenate(([0], (group[1:] != group[:-1]).astype(np.int64))))
    o = np.lexsort((place[idx], doc[idx], ids))
    idx = idx[o]
    first = np.concatenate(([True], ids[1:] != ids[:-1]))
    lead = idx[np.maximum.accumulate(np.where(first, np.arange(len(idx)), 0))]
    # byte comparison: windows that follow each other and whose leaders do too form one stretch
    o = np.argsort(pos[idx])
    idx, lead = idx[o], lead[o]
    p, q = pos[idx], pos[lead]
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(p) != 1) | (np.diff(q) != 1), [True])))
    bad = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if p[a] != q[a] and s.slice(int(p[a]), int(p[b - 1]) + k) != s.slice(int(q[a]), int(q[b - 1]) + k):
            bad += range(a, b)
    if bad:  # equal hashes of different strings: group those windows by their bytes
        by_text: dict[bytes, list[int]] = {}
        touched = set(lead[bad].tolist())
        for i in np.flatnonzero(np.isin(lead, list(touched))).tolist():
            by_text.setdefault(s.slice(int(p[i]), int(p[i]) + k), []).append(i)
        for same in by_text.values():
            lead[same] = min(idx[same].tolist(), key=lambda i: (doc[i], place[i]))
    hit[idx] = doc[lead] < doc[idx]
    return hit, ~hit


def runs(pos: np.ndarray, least: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last index of each run: consecutive places, one minimiser, one text."""
    if not len(pos):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate(([True], (np.diff(pos) != 1) | (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])))
    a = np.flatnonzero(new)
    return a, np.concatenate((a[1:], [len(pos)]))


def cutter(scheme: Scheme, chunk: int = CHUNK) -> Callable[[Iterator[tuple[int, int, bytes]], Records], Iterator[None]]:
    """For ``repeats.deal``: records are runs of windows, spans are in symbols."""

    def pieces(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, int, bytes]]:
        """doc, th, number of the first symbol, bytes; neighbours overlap by k - 1 symbols."""
        for doc, th, text in rows:
            if len(text) < scheme.k:
                continue
            if len(text) <= 2 * chunk:
                yield doc, th, 0, text
                continue
            if scheme.split is by_bytes:
                for lo in range(0, len(text) - scheme.k + 1, chunk):
                    yield doc, th, lo, text[lo:lo + chunk + scheme.k - 1]
                continue
            begin, end = (np.concatenate(x) for x in zip(*_word_bounds(text, chunk), strict=True))
            step = max(1, min(chunk // 8, len(begin) * chunk // len(text)))
            for lo in range(0, max(1, len(begin) - scheme.k + 1), step):
                hi = min(lo + step + scheme.k - 1, len(begin))
                if hi > lo:
                    yield doc, th, lo, text[begin[lo]:end[hi - 1]]

    def run(rows: Iterator[tuple[int, int, bytes]], out: Records) -> Iterator[None]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for piece in pieces(rows):
            held.append(piece)
            size += len(piece[3])
            if size >= chunk:
                work(held, out)
                held, size = [], 0
                yield
        if held:
            work(held, out)
            yield

    def work(held: list[tuple[int, int, int, bytes]], out: Records) -> None:
        gap = b"" if scheme.split is by_bytes else b"\n"
        s = scheme.split(gap.join([x[3] for x in held]))
        lens = np.fromiter((len(x[3]) for x in held), np.int64, len(held))
        if gap:
            ends = np.cumsum(lens + 1) - 1
            edges = np.concatenate(([0], np.searchsorted(s.raw_begin, ends)))
        else:
            edges = np.concatenate(([0], np.cumsum(lens)))
        owner = np.repeat(np.arange(len(held), dtype=np.int32), np.diff(edges))
        if len(owner) < scheme.k:
            return
        grams = scheme.order(Rolling(s.codes).every(scheme.m))
        least = sliding_min(grams, scheme.k - scheme.m + 1)
        pos = np.flatnonzero(owner[: len(least)] == owner[scheme.k - 1:])
        own, least = owner[pos], least[pos]
        docs = np.array([x[0] for x in held], np.int64)
        ths = np.array([x[1] for x in held], np.int64)
        shift = np.array([x[2] for x in held], np.int64) - edges[:-1]
        a, b = runs(pos, least, own)
        if not len(a):
            return
        goes = grams[pos] == least  # a run's gram that leaves before the run's end has come again
        goes[b - 1] = False
        lead = least[a]
        if scheme.by_lead:
            at = [p + np.argmin(grams[p[:, None] + np.arange(scheme.k - scheme.m + 1)], axis=1) for p in np.array_split(pos[a], len(a) // 4096 + 1)]
            lead = eight(np.frombuffer(s.buf, np.uint8), np.concatenate(at))
        w = own[a]
        first, last = pos[a], pos[b - 1]
        if s.begin is None:
            begin, end = first, last + scheme.k
        else:
            begin, end = s.begin[first], s.end[last + scheme.k - 1]
        text = [s.buf[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
        out.add(least[a], lead, docs[w], ths[w], first + shift[w], b - a, np.logical_or.reduceat(goes, a), text)

    return run


def _word_bounds(text: bytes, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of a long text's words, found piece by piece."""
    lo = 0
    while lo < len(text):
        hi = min(len(text), lo + chunk)
        while hi < len(text) and not SPACE[text[hi]]:
            hi += 1
        a, b = mask_to_ranges(~SPACE[np.frombuffer(text, np.uint8, hi - lo, lo)])
        yield a + lo, b + lo
        lo = hi
    yield np.zeros(0, np.int64), np.zeros(0, np.int64)


def spans_and_rest(rec: np.ndarray, k: np.ndarray, hit: np.ndarray, on: np.ndarray, start: np.ndarray, window: int, text_of: Callable[[np.ndarray, np.ndarray], list[bytes]]) -> tuple[Span, Rest]:
    """What a ``Settle`` returns, from each window's record, number in it, and what was found.

    ``text_of`` gives the texts from one window to another (indices into the windows).
    """
    h = np.flatnonzero(hit)
    a, b = runs(k[h], np.zeros(len(h), np.uint64), rec[h])
    spans = rec[h[a]], start[rec[h[a]]] + k[h[a]], start[rec[h[a]]] + k[h[b - 1]] + window
    h = np.flatnonzero(on)
    a, b = runs(k[h], np.zeros(len(h), np.uint64), rec[h])
    return spans, (rec[h[a]], start[rec[h[a]]] + k[h[a]], b - a, text_of(h[a], h[b - 1]))


def word_settler(scheme: Scheme) -> Settle:
    """Finds the windows of words that a smaller document has too."""

    def run(cols: list[np.ndarray], text: np.ndarray, ends: np.ndarray) -> tuple[Span, Rest]:
        _, _, doc, _, start, n, _ = cols
        lens = np.diff(ends, prepend=0)
        rooms = np.full(len(text) + len(lens), 0x0A, np.uint8)
        rooms[np.arange(len(text)) + np.repeat(np.arange(len(lens)), lens)] = text
        s = by_words(rooms.tobytes())
        first = np.cumsum(n + scheme.k - 1) - (n + scheme.k - 1)
        rec = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(rec)) - np.repeat(np.cumsum(n) - n, n)
        pos = first[rec] + k
        hit, on = repeated(s, Rolling(s.codes), pos, doc[rec], start[rec] + k, scheme.k)
        return spans_and_rest(rec, k, hit, on, start, scheme.k, lambda a, b: [
            s.buf[x:y] for x, y in zip(s.begin[pos[a]].tolist(), s.end[pos[b] + scheme.k - 1].tolist(), strict=True)])

    return run


def common_grams(sample: DataFrame, scheme: Scheme, share: float = 0.005, most: int = 4096) -> np.ndarray:
    """Grams in more than ``share`` of the ``sample`` (doc_id, text, th), at most ``most``; sorted.

    They only steer which bucket a window goes to, never whether it is found. Of all grams only those
    are looked at that a window would often choose, and of a text over 1 MB only the beginning.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                if t.is_valid and t.as_py():
                    h = Rolling(scheme.split(t.as_buffer().to_pybytes()[: 1 << 20]).codes).every(scheme.m) >> np.uint64(1)
                    h = np.unique(h[h < np.uint64(2**63 // 64)])
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64))], ["h"])

    found = sample.select("text").mapInArrow(run, "h long").groupBy("h").count()
    found = found.where(F.col("count") > max(8, int(share * sample.count()))).orderBy(F.desc("count"), "h").limit(most)
    return np.sort(np.array([r.h for r in found.collect()], np.uint64))


def splitters(sample: DataFrame, cut_up: Callable[[Iterator[tuple[int, int, bytes]], Records], Iterator[None]], parts: int) -> np.ndarray:
    """Leads that split the records of the ``sample`` (doc_id, text, th) into ``parts`` ranges of like size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Records()
        for _ in cut_up(texts_of(batches), r):
            yield pa.RecordBatch.from_arrays([pa.array((r.table()[LEAD].view(np.uint64) ^ TOP).view(np.int64))], ["lead"])
            r.clear()

    at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = sample.mapInArrow(run, "lead long").agg(F.percentile_approx("lead", at, F.lit(max(10_000, 20 * parts)))).head()[0] if parts > 1 else None
    return np.unique(np.array(found or [], np.int64).view(np.uint64) ^ TOP)
