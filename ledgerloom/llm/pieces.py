"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

The words of many texts lie one after another in flat arrays of symbols, cut further where two characters
meet that no piece holds side by side. In each round every such segment merges, from the left, all pairs of
its best rank; merged symbols are then compacted away and finished segments leave. The rounds end when no
segment has a pair that the vocabulary knows. Pairs of one rank may only merge together if no pair that they
can make ranks before them; where the vocabulary doesn't grant that, a segment merges the leftmost alone.

Decoding takes ids alone and strings together the bytes of their pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_WORD = re.compile(r" +[^ ]*")
NONE = np.int64(2**62)


class Pieces:
    """A BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(size)]
        self.bytes_of = {i: bytes([int(self.piece[i][3:5], 16)]) for i in range(size) if sp.is_byte(i)}
        self.byte_id = {b[0]: i for i, b in self.bytes_of.items()}
        self.unk = sp.unk_id()
        special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.special = special - self.bytes_of.keys()
        self.id_of = {p: i for i, p in enumerate(self.piece) if i not in special}
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("pieces that go on past a word's end are not supported")
        ranks = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in self.id_of.values()}, reverse=True))}
        # characters that only longer pieces hold get numbers of their own
        self.symbol = dict(self.id_of)
        for p in self.id_of:
            for c in p:
                self.symbol.setdefault(c, len(self.piece) + len(self.symbol))
        self.unknown = max(self.symbol.values()) + 1
        self.width = self.unknown + 1
        pairs: dict[int, tuple[int, int]] = {}
        for p, i in self.id_of.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (ranks[sp.get_score(i)], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.written = [str(i) for i in range(len(self.piece))]
        self.of_char = np.full(0x110000, self.unknown, np.int32)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        # ranks whose merges can make a pair of the same or a better rank
        own = np.full(self.width, -1, np.int64)
        own[self.made] = self.rank
        unsafe = [own[x][self.rank <= own[x]] for x in (self.keys // self.width, self.keys % self.width)]
        self.safe = np.ones(len(ranks) + 1, bool)
        self.safe[np.concatenate(unsafe)] = False
        self.inside = np.array(sorted({ord(x) << 21 | ord(y) for p in self.id_of for x, y in zip(p, p[1:])}), np.int64)
        #: What pieces decode to.
        self.shown = [self.bytes_of.get(i, " \u2047 ".encode() if i == self.unk else b"" if i in self.special else p.replace(SPACE, " ").encode()) for i, p in enumerate(self.piece)]
        self.is_byte = np.isin(np.arange(size), list(self.bytes_of))
        #: A word's ids, written out with commas.
        self.memo: dict[str, str] = {}

    def _ranked(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or none) and piece of the pairs that begin at places ``at``."""
        rank, made = np.full(len(at), 2**31 - 1, np.int64), np.zeros(len(at), np.int64)
        ok = np.flatnonzero(at < len(symbols) - 1)
        ok = ok[word[at[ok]] == word[at[ok] + 1]]
        i = at[ok]
        key = symbols[i] * self.width + symbols[i + 1]
        hit = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[hit] == key
        rank[ok[known]] = self.rank[hit[known]]
        made[ok[known]] = self.made[hit[known]]
        return rank, made

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of segments (numbered, in order) until no pair is left: symbols, segments.

        Only pairs next to a merge are looked up again.
        """
        none = 2**31 - 1
        done = []
        rank, made = self._ranked(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            long = np.diff(np.concatenate((start, [len(symbols)])))
            best = np.minimum.reduceat(rank, start)
            live = best < none
            left = np.flatnonzero((rank == np.repeat(best, long)) & (rank < none))
            # pairs that overlap: every other one of a row of neighbours, from the left
            row = np.concatenate(([True], np.diff(left) != 1)) if len(left) else np.zeros(0, bool)
            nth = np.arange(len(left)) - np.maximum.accumulate(np.where(row, np.arange(len(left)), 0))
            first = np.concatenate(([True], word[left[1:]] != word[left[:-1]])) if len(left) else row
            left = left[((nth % 2 == 0) & self.safe[rank[left]]) | first]
            symbols[left] = made[left]
            keep = np.ones(len(symbols), bool)
            keep[left + 1] = False
            if not live.all():
                going = np.repeat(live, long)
                done.append((symbols[~going], word[~going]))
                keep &= going
            left = (np.cumsum(keep) - 1)[left]
            symbols, word, rank, made = symbols[keep], word[keep], rank[keep], made[keep]
            again = np.concatenate((left, left[left > 0] - 1))
            if len(again):
                rank[again], made[again] = self._ranked(symbols, word, again)
        if not done:
            return symbols, word
        symbols, word = (np.concatenate(x) for x in zip(*done, strict=True))
        o = np.argsort(word, kind="stable")
        return symbols[o], word[o]

    def _learn(self, words: list[str]) -> None:
        """Put words into the memo; a word comes without the one space that each has in front."""
        flat = SPACE + SPACE.join(words).replace(" ", SPACE)
        codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin = np.zeros(len(codes), bool)
        begin[np.cumsum(lens) - lens] = True
        both = codes[:-1] << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.inside, both), len(self.inside) - 1)
        apart = begin.copy()
        apart[1:] |= self.inside[at] != both
        segment = np.cumsum(apart) - 1
        merged, segment = self.merge(self.of_char[codes].astype(np.int64), segment)
        word = (np.cumsum(begin) - 1)[apart][segment]
        bounds = np.searchsorted(word, np.arange(len(words) + 1))
        plain = merged < len(self.piece)
        fine = np.logical_and.reduceat(plain, bounds[:-1])
        ids = [self.written[i] for i in np.where(plain, merged, 0).tolist()]
        ends = bounds.tolist()
        self.memo.update(zip(words, [",".join(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], strict=True))
        for i in np.flatnonzero(~fine).tolist():
            self.memo[words[i]] = self._spelt(words[i], merged[ends[i]:ends[i + 1]].tolist())

    def _spelt(self, w: str, symbols: list[int]) -> str:
        """One word's ids, with characters that have no piece as bytes."""
        text, ids, at = SPACE + w.replace(" ", SPACE), [], 0
        for x in symbols:
            if x < len(self.piece):
                ids.append(x)
                at += len(self.piece[x])
            else:
                ids += [self.byte_id.get(c, self.unk) for c in text[at].encode("utf-8", "surrogatepass")]
                at += 1
        return ",".join(map(str, ids))

    def _spelt_out(self, ids: list[int]) -> bytes:
        """What ids with pieces of single bytes decode to: bytes in a row that aren't UTF-8 are replaced."""
        out, held = [], b""
        for i in ids:
            if i in self.bytes_of:
                held += self.bytes_of[i]
                continue
            out.append(held.decode("utf-8", "replace").encode())
            held = b""
            out.append(self.shown[i])
        return b"".join([*out, held.decode("utf-8", "replace").encode()])

    def decoded(self, ids: list[np.ndarray]) -> list[bytes]:
        """The UTF-8 text of each array of ids; the space that encoding put in front goes."""
        show = self.shown.__getitem__
        out = [self._spelt_out(x.tolist()) if self.is_byte[x].any() else b"".join(map(show, x.tolist())) for x in ids]
        return [t[1:] if t.startswith(b" ") else t for t in out]

    def decode(self, ids: list[int]) -> str:
        return self.decoded([np.array(ids, np.int64)])[0].decode()

    def words(self, text: str) -> list[str]:
        """Words without the one space in front; more spaces in front belong to the word."""
        text = text.replace(SPACE, " ")
        out = text.split(" ")
        return out if "" not in out else [w[1:] for w in _WORD.findall(" " + text)]

    def encoded(self, texts: list[str]) -> Iterator[str]:
        """For each text its ids, written out with commas."""
        if len(self.memo) > 400_000:
            self.memo.clear()
        split = [self.words(t) if t else [] for t in texts]
        new = set().union(*split) - self.memo.keys()
        if new:
            self._learn(list(new))
        for ws in split:
            yield ",".join(map(self.memo.__getitem__, ws))

    def encode(self, text: str) -> list[int]:
        return parsed(next(self.encoded([text]))).tolist()


def parsed(written: str) -> np.ndarray:
    """Ids that are written out with commas."""
    return np.fromstring(written, np.int32, sep=",") if written else np.zeros(0, np.int32)


@lru_cache(maxsize=2)
def pieces(model_file: str) -> Pieces:
    """One model a process."""
    return Pieces(model_file)


def _groups(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, list[str]]]:
    """First and last row and texts (null: '') of some rows, about ``size`` characters at a time."""
    lo, held, n = 0, [], 0
    for i in range(len(column)):
        t = column[i].as_py() or ""
        held.append(t)
        n += len(t)
        if n >= size:
            yield lo, i + 1, held
            lo, held, n = i + 1, [], 0
    if held:
        yield lo, len(column), held


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``ids``. Null and empty texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_file)
        for b in batches:
            for lo, hi, texts in _groups(b.column(1)):
                ids = [parsed(x) for x in model.encoded(texts)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: ``doc_id``, ``text``. Null gives ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_file)
        for b in batches:
            ids = [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.decoded(ids), pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of each row's ids and of what they decode to.

    Null texts are empty: no ids, and '' decoded. Rows that repeat come out repeated; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_file)
        for b in batches:
            for lo, hi, texts in _groups(b.column(1)):
                written = list(model.encoded(texts))
                ids = [parsed(x) for x in written]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo), pa.array(list(map(len, ids)), pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in written]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in model.decoded(ids)]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, ``ids``, and ``decoded_sha256`` of what the ids decode to. Nulls as in ``digest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_file)
        for b in batches:
            for lo, hi, texts in _groups(b.column(1)):
                ids = [parsed(x) for x in model.encoded(texts)]
                back = [hashlib.sha256(x).hexdigest() for x in model.decoded(ids)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(back)],
                    ["doc_id", "n_tokens", "ids", "decoded_sha256"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")
