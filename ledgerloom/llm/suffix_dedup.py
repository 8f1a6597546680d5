"""Exact deduplication of long byte strings by a sparse, distributed suffix array.

A full suffix array of the corpus has a suffix for each byte. Here suffixes start where a gram is the
least by hash in some window of ``length`` bytes (the leftmost, if it is there more than once): equal
windows choose equal starts, so a window is known by its suffix and by how far before it the window
begins. The windows that choose a start travel with it as one packed string.

Splitters sampled from the suffixes' leading bytes split them into ranges. A range's bucket sorts its
suffixes by multikey quicksort, eight bytes at a time and only ties further on, and likewise what
stands before them, read backwards; both orders come with the common lengths of neighbours. A window
that begins L bytes before its suffix is repeated if another suffix agrees with it in the ``length`` - L
bytes after and the L bytes before the start, that is if both lie in the same intervals of both
orders. Equal leading bytes lie on one side of a splitter. Where that would overfill a range, its suffixes
are dealt over several buckets, and each passes on one window of each kind, which are then compared
with the others across those boundaries.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import repeats, windows
from ledgerloom.llm.common import Rolling, keyed_docs, mask_to_ranges, parts_for, ranges_to_mask, slices


def multikey_sort(chunk: Callable[[np.ndarray, int], np.ndarray], n: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings 0 to n-1 in order, and how many bytes each has in common with the one before it.

    ``chunk`` gives the eight bytes of some strings from a place on, as numbers. Strings are split by
    their first eight bytes; those that tie are split by the next, up to ``depth`` bytes.
    """
    order, common = np.arange(n), np.zeros(n, np.int64)
    live, group = np.arange(n), np.zeros(n, np.int64)  # places of strings that still tie, and with which
    for at in range(0, depth, 8):
        if not len(live):
            break
        v = chunk(order[live], at)
        o = np.lexsort((v, group))
        order[live] = order[live[o]]
        v = v[o]
        old = np.concatenate(([False], group[1:] == group[:-1]))
        differs = np.concatenate(([0], v[1:] ^ v[:-1])).astype(np.uint64)
        same = sum((differs < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, 8)) + (differs == 0)
        common[live[old]] = np.minimum(at + same[old], depth)
        tied = old & (differs == 0)
        stay = tied | np.concatenate((tied[1:], [False]))
        group = np.cumsum(~tied)[stay]
        live = live[stay]
    return order, common


def _classes(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Numbers for the strings, equal where they agree in ``least`` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < least)
    return out


def _reach(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The most bytes that each string has in common with any other."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(common, np.concatenate((common[1:], [0])))
    return out


def periodic(text: np.ndarray, gap: int, k: int) -> np.ndarray:
    """For each window of ``k`` bytes whether it equals the one ``gap`` bytes before it."""
    out = np.zeros(len(text) - k + 1, bool)
    unlike = np.concatenate(([0], np.cumsum(text[gap:] != text[:-gap])))
    out[gap:] = unlike[k:] == unlike[:-k] if len(unlike) > k else False
    return out


def suffix_settler(scheme: windows.Scheme) -> repeats.Settle:
    """Finds the repeated windows among packed strings."""
    k, m = scheme.k, scheme.m

    def run(cols: list[np.ndarray], text: np.ndarray, ends: np.ndarray) -> tuple[repeats.Span, repeats.Rest]:
        doc, start, n = cols[repeats.DOC], cols[repeats.START], cols[repeats.N]
        buf, first = text.tobytes(), ends - (n + k - 1)
        # suffixes: where the key's gram stands, each with the windows that it is the leftmost of
        grams = scheme.order(Rolling(windows.BYTE_CODES[text]).every(m))
        owner = np.repeat(np.arange(len(n)), n + k - 1)[: len(grams)]
        a = np.flatnonzero(grams == cols[repeats.KEY].view(np.uint64)[owner])
        r = owner[a]
        inside = a + m <= ends[r]
        a, r = a[inside], r[inside]
        before = np.where(np.concatenate(([False], r[1:] == r[:-1])), np.concatenate(([0], a[:-1])) + 1, 0)
        lo, hi = np.maximum(np.maximum(before, first[r]), a - (k - m)), np.minimum(a, first[r] + n[r] - 1)
        a, r, lo, hi = (x[lo <= hi] for x in (a, r, lo, hi))
        width = np.cumsum(n) - n - first  # from a window's first byte to its number
        hit, on = np.zeros(int(n.sum()), bool), np.ones(int(n.sum()), bool)
        for i in np.flatnonzero(cols[repeats.OWN]).tolist():
            x, y = np.searchsorted(r, [i, i + 1])
            if y - x > 1:
                gap = int(np.median(np.diff(a[x:y])))
                again = periodic(text[first[i]:ends[i]], gap, k)
                mine = slice(width[i] + first[i], width[i] + first[i] + n[i])
                hit[mine] |= again | np.concatenate((again[gap:], np.zeros(min(gap, n[i]), bool)))
                on[mine] &= ~again
        left_out = np.concatenate(([0], np.cumsum(~on)))
        keep = left_out[hi + width[r] + 1] - left_out[lo + width[r]] <= hi - lo
        a, r, lo, hi = (x[keep] for x in (a, r, lo, hi))
        least, most = a - hi, a - lo  # bytes of the windows before the suffix
        right = multikey_sort(lambda i, at: windows.eight(text, a[i] + at), len(a), k)
        left = multikey_sort(lambda i, at: windows.eight(text, a[i] - at, back=True), len(a), k - m)
        least, most = np.maximum(least, k - _reach(*right)), np.minimum(most, _reach(*left))
        may = np.flatnonzero(least <= most)
        for length in range(int(least[may].min(initial=k)), int(most[may].max(initial=-1)) + 1):
            some = may[(least[may] <= length) & (length <= most[may])]
            if len(some) < 2:
                continue
            after, ahead = _classes(*right, k - length)[some], _classes(*left, length)[some]
            o = np.lexsort((start[r[some]] + a[some] - first[r[some]], doc[r[some]], ahead, after))
            some, after, ahead = some[o], after[o], ahead[o]
            eq = (after[1:] == after[:-1]) & (ahead[1:] == ahead[:-1])
            again, next_too = np.concatenate(([False], eq)), np.concatenate((eq, [False]))
            at = a[some] - length + width[r[some]]
            hit[at[again | next_too]] = True
            on[at[again]] = False
        rec = np.repeat(np.arange(len(n)), n)
        number = np.arange(len(rec)) - np.repeat(np.cumsum(n) - n, n)
        return windows.spans_and_rest(rec, number, hit, on, start, k, lambda x, y: [
            buf[i:j] for i, j in zip((first[rec[x]] + number[x]).tolist(), (first[rec[y]] + number[y] + k).tolist(), strict=True)])

    return run


def repeated_bytes(docs: DataFrame, length: int = 400, gram: int = 32, bucket_bytes: int = 8 << 20) -> DataFrame:
    """Spans (in bytes) of ``docs`` (doc_id, text, th) that a repeated ``length``-byte string covers."""
    size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).head()
    parts = parts_for(docs.sparkSession, size[1] or 0, bucket_bytes)
    scheme = windows.Scheme(windows.by_bytes, length, min(gram, length), True, np.zeros(0, np.uint64))
    sample = repeats.sampled(docs, size[0], parts)
    scheme.common = windows.common_grams(sample, scheme)
    cutter = windows.cutter(scheme)
    bounds, hot = windows.splitters(sample, cutter, parts), repeats.hot_keys(sample, cutter, parts)
    return repeats.deal(docs, cutter, suffix_settler(scheme), lambda lead: np.searchsorted(bounds, lead, "right"), parts, hot)


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (binary).

    Each byte is removed that a ``length``-byte string covers which also starts anywhere else, in the
    same document or another. Strings are judged on the input. Null texts are empty. Rows that repeat
    each other repeat each other's strings. Cuts may fall inside a character: ``kept`` is binary.
    """
    table = keyed_docs(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            text, spans = b.column(1), b.column(3)
            n, gone, runs, kept = [], [], [], []
            for i in range(b.num_rows):
                t = text[i].as_buffer().to_pybytes() if text[i].is_valid else b""
                s, e = repeats.span_arrays(spans, i)
                n.append(len(t))
                a = z = s
                if len(s):
                    a, z = mask_to_ranges(ranges_to_mask(len(t), s, e))
                    t = b"".join([t[x:y] for x, y in zip([0, *z.tolist()], [*a.tolist(), len(t)], strict=True)])
                gone.append(n[-1] - len(t))
                runs.append(len(a))
                kept.append(t)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    met = repeats.with_spans(table, repeated_bytes(table, length))
    return met.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``."""
    return dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute(rows: list[tuple[int, str | None]], length: int = 400) -> list[tuple[int, int, int, int, str]]:
    """What ``digest`` must return, for tests."""
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i:i + length] for _, t in raw for i in range(len(t) - length + 1))
    out = []
    for d, t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        a, _ = mask_to_ranges(gone)
        out.append((d, len(t), int(gone.sum()), len(a), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out
