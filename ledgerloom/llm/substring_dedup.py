"""Substring deduplication over windows of words, by super-k-mers.

Consecutive windows that share a minimiser travel as one packed string to the minimiser's bucket,
where sorting shows exactly which windows occur in a smaller document. A minimiser that would overfill
its bucket goes to many, which pass on what they can't settle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import repeats, windows
from ledgerloom.llm.common import keyed_docs, parts_for, ranges_to_mask, slices


def repeated_words(docs: DataFrame, window: int = 50, gram: int = 5, bucket_bytes: int = 8 << 20) -> DataFrame:
    """Spans (in words) of ``docs`` (doc_id, text, th) that windows of smaller documents cover."""
    size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).head()
    parts = parts_for(docs.sparkSession, size[1] or 0, bucket_bytes)
    scheme = windows.Scheme(windows.by_words, window, min(gram, window), False, np.zeros(0, np.uint64))
    sample = repeats.sampled(docs, size[0], parts)
    scheme.common = windows.common_grams(sample, scheme)
    cutter, many = windows.cutter(scheme), np.uint64(parts)
    hot = repeats.hot_keys(sample, cutter, parts)
    return repeats.deal(docs, cutter, windows.word_settler(scheme), lambda key: key % many, parts, hot)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words left, joined by one space).

    A word is removed if a window of ``window`` consecutive words that covers it also starts in a
    document with a smaller ``doc_id``. Windows are judged on the input. Null texts have no words and
    come out as ''. A null ``doc_id`` counts as larger than all others. Rows that repeat a ``doc_id``
    are not each other's smaller document. Texts shorter than a window stay as they are, but for
    white space.
    """
    table = keyed_docs(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            text, spans = b.column(1), b.column(3)
            n, gone, kept = [], [], []
            for i in range(b.num_rows):
                words = text[i].as_buffer().to_pybytes().split() if text[i].is_valid else []
                s, e = repeats.span_arrays(spans, i)
                n.append(len(words))
                if len(s):
                    out = ranges_to_mask(len(words), s, e)
                    words = [words[j] for j in np.flatnonzero(~out).tolist()]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    met = repeats.with_spans(table, repeated_words(table, window))
    return met.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``."""
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute(rows: list[tuple[int, str | None]], window: int = 50) -> list[tuple[int, int, int, str]]:
    """What ``digest`` must return, for tests."""
    split = {d: (t or "").encode().split() for d, t in rows}
    least: dict[tuple, int] = {}
    for d, w in split.items():
        for i in range(len(w) - window + 1):
            g = tuple(w[i:i + window])
            least[g] = min(least.get(g, d), d)
    out = []
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i:i + window])] < d:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
