"""Line deduplication by content-defined chunks of lines.

A rolling hash over a line's hash and the one before it decides whether a chunk ends after the line,
so that chunks fall into step again after lines are put in or taken out. Where lines come round again
at once, which gives the hash few values, chunks end with each round instead. A chunk of several lines
that occurs again is removed, but for its first occurrence; occurrences are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import repeats
from ledgerloom.llm.common import keyed_docs, parts_for, slices

_ODD = 0x9E3779B97F4A7C15


def _round(recent: list[int], h: int) -> bool:
    """Whether a line of hash ``h`` ends a round of lines that repeat; ``recent``: hashes of the lines before, latest last.

    A round is as many lines as lie between the line and its like. It ends where its greatest hash is,
    so that it ends at the same line wherever a text enters it. Rounds of over two lines need two
    lines in turn that come again.
    """
    for p in range(1, len(recent) + 1):
        if recent[-p] == h and (p <= 2 or (p < len(recent) and recent[-p - 1] == recent[-1])):
            return h >= max(recent[-p:])
    return False


def chunks(text: bytes, every: int = 3, longest: int = 16, look: int = 8) -> Iterator[tuple[int, int, int]]:
    """Start, end (in bytes, line ends included) and number of lines of each chunk.

    A chunk ends after a line for which the rolling hash of it and its predecessor is divisible by
    ``every``, or which ends a round of at most ``look`` lines (``_round``), if the chunk then has two
    lines at least; after ``longest`` lines; and with the text.
    """
    start = at = lines = before = 0
    recent: list[int] = []
    for line in text.splitlines(keepends=True) if b"\r" not in text and b"\x0b" not in text else _lines(text):
        at += len(line)
        lines += 1
        h = xxhash.xxh3_64_intdigest(line.rstrip(b"\n"))
        roll = ((before * _ODD + h) & (2**64 - 1)) >> 20
        if lines >= 2 and (roll % every == 0 or lines >= longest or (h in recent and _round(recent, h))):
            yield start, at, lines
            start, lines = at, 0
        before = h
        recent.append(h)
        if len(recent) > look:
            del recent[0]
    if lines:
        yield start, at, lines


def _lines(text: bytes) -> list[bytes]:
    """Lines end with a line feed alone."""
    parts = text.split(b"\n")
    return [x + b"\n" for x in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def _cut(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """What is left of a text without some spans that don't overlap."""
    if not len(starts):
        return text
    o = np.argsort(starts)
    return b"".join([text[x:y] for x, y in zip([0, *ends[o].tolist()], [*starts[o].tolist(), len(text)], strict=True)])


def repeated_chunks(docs: DataFrame, every: int = 3, bucket_bytes: int = 32 << 20, step: int = 1 << 20) -> DataFrame:
    """Spans (in bytes) of ``docs`` (doc_id, text, th): chunks of several lines but for their first occurrence."""
    size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).head()
    parts = parts_for(docs.sparkSession, size[1] or 0, bucket_bytes)
    many = np.uint64(parts)

    def cutter(rows: Iterator[tuple[int, int, bytes]], out: repeats.Records) -> Iterator[None]:
        held: list[tuple[int, int, int]] = []
        bodies: list[bytes] = []
        size = 0

        def work() -> None:
            if held:
                doc, th, start = np.array(held, np.int64).T
                key = np.fromiter(map(xxhash.xxh3_64_intdigest, bodies), np.uint64, len(bodies))
                out.add(key, key, doc, th, start, np.ones(len(held)), np.zeros(len(held)), bodies)

        for doc, th, text in rows:
            for start, end, lines in chunks(text, every):
                if lines > 1 and not (body := text[start:end]).isspace():
                    held.append((doc, th, start))
                    bodies.append(body)
                    size += end - start
            if size >= step:
                work()
                held, bodies, size = [], [], 0
                yield
        work()
        yield

    def settle(cols: list[np.ndarray], text: np.ndarray, ends: np.ndarray) -> tuple[repeats.Span, repeats.Rest]:
        doc, start = cols[repeats.DOC], cols[repeats.START]
        buf, begins = text.tobytes(), np.concatenate(([0], ends[:-1]))
        first: dict[bytes, int] = {}
        again = []
        for i in np.lexsort((start, cols[repeats.TH], doc)).tolist():
            if first.setdefault(buf[begins[i]:ends[i]], i) != i:
                again.append(i)
        a, on = np.array(again, np.int64), np.array(list(first.values()), np.int64)
        return (a, start[a], start[a] + (ends - begins)[a]), (on, start[on], np.ones(len(on)), list(first))

    hot = repeats.hot_keys(repeats.sampled(docs, size[0], parts), cutter, parts)
    return repeats.deal(docs, cutter, settle, lambda key: key % many, parts, hot)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 3) -> DataFrame:
    """Per row: ``doc_id``, ``n_lines``, ``n_removed`` (lines), ``kept`` (the text left), ``th``.

    Lines end with a line feed. Of equal chunks the one of the smallest ``doc_id`` (null last), then
    the earliest, stays; the lines of the others go with their line feeds. Chunks of one line and
    blank chunks stay. Null texts stay null and have no lines. Of rows that repeat each other's
    ``doc_id`` and text none is told apart from the others, so all of them lose the same lines.
    """
    table = keyed_docs(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            text, spans = b.column(1), b.column(3)
            n, gone, kept = [], [], []
            for i in range(b.num_rows):
                t = text[i].as_buffer().to_pybytes() if text[i].is_valid else None
                s, e = repeats.span_arrays(spans, i)
                n.append(t.count(b"\n") + (not t.endswith(b"\n")) if t else 0)
                if t is not None:
                    t = _cut(t, s, e)
                gone.append(n[-1] - (t.count(b"\n") + (not t.endswith(b"\n")) if t else 0))
                kept.append(t)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), b.column(2)],
                ["doc_id", "n_lines", "n_removed", "kept", "th"],
            )

    spans = repeated_chunks(table, every).distinct()
    return repeats.with_spans(table, spans).mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept string, th long")


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 3) -> DataFrame:
    """The rows and columns of ``docs`` with the texts that ``dedup_lines`` leaves. No row goes."""
    rest = [c for c in docs.columns if c != text_col]
    table = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            text, spans = b.column(0), b.column(1)
            kept = []
            for i in range(b.num_rows):
                s, e = repeats.span_arrays(spans, i)
                kept.append(_cut(text[i].as_buffer().to_pybytes(), s, e) if text[i].is_valid else None)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), b.column(2)], ["text", "rest"])

    met = repeats.with_spans(table, repeated_chunks(table, every).distinct()).select("text", "spans", "rest")
    out = met.mapInArrow(run, f"text string, rest {table.schema['rest'].dataType.simpleString()}")
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_removed``, ``kept_sha256`` (null text: of '')."""
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def brute(rows: list[tuple[int, str | None]], every: int = 3) -> list[tuple[int, int, int, str]]:
    """What ``digest`` must return for distinct doc_ids, for tests."""
    seen: set[bytes] = set()
    out = []
    for d, t in sorted(rows):
        raw = (t or "").encode()
        kept = b""
        for a, b, n in chunks(raw, every):
            body = raw[a:b]
            if n > 1 and not body.isspace() and body in seen:
                continue
            if n > 1:
                seen.add(body)
            kept += body
        count = [x.count(b"\n") + (not x.endswith(b"\n")) if x else 0 for x in (raw, kept)]
        out.append((d, count[0], count[0] - count[1], hashlib.sha256(kept).hexdigest()))
    return out
