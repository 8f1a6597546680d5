"""Toxicity by a learned lexicon.

Stems that occur in toxic texts and hardly elsewhere form a trie. Misspelt words are found by running
a Levenshtein automaton for the word along the trie. A hit counts less where its context is that of a
quotation. A small logistic model turns a text's hits into a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import BYTE_CODES, Rolling, cut

#: Characters written in place of letters. Fixed values.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
QUOTES = "\"'«»‘’‚“”„‹›"
#: Words that report what someone else has said. Fixed values.
REPORTING = frozenset(
    "said says quote quoted quotes wrote called calling word term phrase slur insult "
    "sagte nannte zitat wort begriff dit disait mot terme citation dijo palabra cita".split()
)
#: Marks around words that aren't part of them. Fixed values.
EDGE = ".,;:!?\"'`()[]{}<>«»‘’‚“”„‹›…-–—_*#%&/\\|~^+="
#: Inputs of the logistic model: plain hits, misspelt hits, hits in quotations (each a sum of the
#: stems' evidence, ``MOST`` at most). What is believed of their weights before any training.
PRIOR = np.array([-3.0, 1.2, 1.2, 0.2])
MOST = 12.0
#: Letters that a misspelt word may have after its stem.
ENDING = 2


def held_out(doc_id: str = "doc_id"):
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def plain(word: str) -> str:
    """A word in lower case without the marks around it; lookalikes stay."""
    return word.lower().strip(EDGE)


def shortened(word: str) -> list[str]:
    """A word, and it without each of its letters."""
    return [word, *[word[:i] + word[i + 1:] for i in range(len(word))]]


class Trie:
    """Stems as nested dicts; a whole stem stands under the key ''."""

    def __init__(self, stems: Iterable[str]):
        self.root: dict = {}
        for stem in stems:
            node = self.root
            for c in stem:
                node = node.setdefault(c, {})
            node[""] = stem

    def prefix(self, word: str) -> str | None:
        """The shortest stem that ``word`` begins with."""
        node = self.root
        for c in word:
            node = node.get(c)
            if node is None:
                return None
            if "" in node:
                return node[""]
        return None

    def near(self, word: str, most: int = 1, ending: int = 0) -> list[str]:
        """The stems within ``most`` edits of ``word``, or of it without up to ``ending`` last letters.

        The automaton's states are rows of edit distances; a branch of the trie is left as soon as
        none of its state's distances is within reach. Swapped neighbours count as one edit.
        """
        found = []
        stack = [(self.root, "", list(range(len(word) + 1)), None)]
        while stack:
            node, stem, row, older = stack.pop()
            if "" in node and min(row[max(0, len(word) - ending):]) <= most:
                found.append(stem)
            for c, kid in node.items():
                if not c:
                    continue
                new = [row[0] + 1]
                for j, w in enumerate(word, 1):
                    d = min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != w))
                    if older is not None and j > 1 and stem[-1] == w and c == word[j - 2]:
                        d = min(d, older[j - 2] + 1)
                    new.append(d)
                if min(new) <= most:
                    stack.append((kid, stem + c, new, row))
        return found


@dataclass
class Lexicon:
    """Finds hits. ``plain`` and ``misspelt``: a stem's evidence (log-odds) as written and near to it.

    Of a word one edit away from a stem either the first two letters are the stem's, or the stem's fourth and fifth
    stand where they should or next to that. And both become equal when each loses a letter at most. So only words
    that share letters, and such a shortened form, with a stem, as they are or without an ending of one or two letters,
    are taken to the automaton. Stems under 5 letters are only found as written. Words may be of any length.
    """

    plain: dict[str, float]
    misspelt: dict[str, float]
    memo: dict[str, tuple[int, str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.trie = Trie(self.plain)
        long = [s for s in self.misspelt if len(s) >= 5]
        self.long = Trie(long)
        self.reach = {x for stem in long for x in shortened(stem)}
        self.lengths = range(min(map(len, long), default=0) - 1, max(map(len, long), default=-2) + 2)
        self.firsts = {s[:4] for s in self.plain}
        self.begins, self.inner = {s[:2] for s in long}, {s[3:5] for s in long}

    def __reduce__(self) -> tuple:
        return _lexicon, (tuple(self.plain.items()), tuple(self.misspelt.items()))

    def look_up(self, raw: str) -> tuple[int, str]:
        """(0: no hit, 1: plain, 2: misspelt; stem)."""
        word = plain(raw)
        if len(word) < 4:
            return 0, ""
        if word[:4] in self.firsts and (stem := self.trie.prefix(word)):
            return 1, stem
        other = word if word.isalpha() else word.translate(LOOKALIKE)
        if other != word and other[:4] in self.firsts and (stem := self.trie.prefix(other)) in self.misspelt:
            return 2, stem
        inner = self.inner
        if other[:2] not in self.begins and other[3:5] not in inner and other[2:4] not in inner and other[4:6] not in inner:
            return 0, ""
        for cut_off in range(min(ENDING, len(other)) + 1):
            head = other[: len(other) - cut_off]
            if len(head) in self.lengths and not self.reach.isdisjoint(shortened(head)) and (stems := self.long.near(other, 1, ENDING)):
                return 2, max(stems, key=lambda s: (self.misspelt[s], s))
        return 0, ""

    def hits(self, text: str | None) -> tuple[list[str], dict[str, tuple[int, str]]]:
        """A text's words, and those that are hits."""
        if not text:
            return [], {}
        words = text.split()
        memo = self.memo
        if len(memo) > 400_000:
            memo.clear()
        found = {}
        for w in set(words):
            got = memo.get(w)
            if got is None:
                got = self.look_up(w)
                if len(w) < 100:
                    memo[w] = got
            if got[0]:
                found[w] = got
        return words, found

    def features(self, text: str | None, window: int = 3) -> np.ndarray:
        """The model's inputs but for the constant."""
        out = np.zeros(3)
        words, found = self.hits(text)
        if not found:
            return out
        for i, w in enumerate(words):
            if w not in found:
                continue
            kind, stem = found[w]
            near = words[max(0, i - window):i + window + 1]
            opened = any(x[0] in QUOTES for x in words[max(0, i - window):i + 1])
            closed = any(x.rstrip(".,;:!?")[-1:] in QUOTES and x.rstrip(".,;:!?") for x in words[i:i + window + 1])
            quoted = (opened and closed) or any(plain(x) in REPORTING for x in near)
            out[2 if quoted else kind - 1] += self.plain[stem] if kind == 1 else self.misspelt[stem]
        return np.minimum(out, MOST)


@lru_cache(maxsize=4)
def _lexicon(plain: tuple, misspelt: tuple) -> Lexicon:
    """One lexicon a process, so that its tasks share what has been looked up."""
    return Lexicon(dict(plain), dict(misspelt))


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, strength: float = 2.0) -> np.ndarray:
    """Logistic regression of rows that occur ``n`` times, by damped Newton steps, drawn towards ``PRIOR``."""
    x = np.column_stack([np.ones(len(x)), x])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + strength / 2 * ((w - PRIOR) ** 2).sum())

    w = PRIOR.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + strength * np.eye(x.shape[1])
        step = np.linalg.solve(hess, x.T @ (n * (y - p)) - strength * (w - PRIOR))
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        """0 to 1. Null and empty texts get the score of a text without hits."""
        z = float(self.weights[0] + self.weights[1:] @ self.lexicon.features(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _least(text: np.ndarray, window: int = 24, step: int = 1 << 22) -> int:
    """A number that near copies mostly share: two least hashes, under different orders, of a text's windows of bytes."""
    window = min(window, max(1, len(text)))
    least = [2**64 - 1] * 2
    for lo in range(0, max(1, len(text) - window + 1), step):
        h = Rolling(BYTE_CODES[text[lo:lo + step + window - 1]]).every(window)
        if len(h):
            least = [min(least[0], int(h.min())), min(least[1], int((h * np.uint64(0x9E3779B97F4A7C15)).min()))]
    return (least[0] * 31 + least[1]) % 2**64


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most_rows: int = 50_000, purity: float = 0.8, least: int = 4, longest: int = 32,
) -> Model:
    """Learn from labelled rows outside the held-out third.

    ``most_rows`` bounds the labelled rows that are used (chosen by a hash of the id), so their ids
    may be broadcast and all that follows from them is bounded too; they are read once and kept in a checkpoint. A
    stem is a beginning of words, of 4 to ``longest`` letters, that ``least`` toxic texts have and of whose texts the share
    ``purity`` is toxic (with one clean text added); of those that begin alike the shortest, drawn out as far as most of its
    texts go. Null ids and labels, and null texts, teach nothing; of rows that repeat, and of near copies under one
    label, one does. Without any toxic label the lexicon is empty and every score low.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y is not null")
    rows = rows.where(~held_out("i")).groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(most_rows)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = np.array([_least(np.frombuffer(t.as_buffer(), np.uint8)) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(least.view(np.int64))], ["i", "text", "y", "sketch"])

    # of near copies one speaks for all, else whatever a copied text says would look like a sign
    marked = text.join(F.broadcast(rows), text.doc_id == rows.i).select("i", "text", "y").mapInArrow(sketch, "i long, text string, y int, sketch long")
    marked = cut(marked)
    one = marked.groupBy(F.col("sketch").alias("s"), F.col("y").alias("sy")).agg(F.min("i").alias("si"))
    known = marked.join(F.broadcast(one), (F.col("sketch") == F.col("s")) & (F.col("y") == F.col("sy")) & (F.col("i") == F.col("si")), "left_semi").select("text", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        bad: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            words = list(n)
            cols = [pa.array(words, pa.string()), pa.array([n[w] for w in words], pa.int64()), pa.array([bad[w] for w in words], pa.int64())]
            n.clear()
            bad.clear()
            return pa.RecordBatch.from_arrays(cols, ["word", "n", "bad"])

        for b in batches:
            seen = set()
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if not t.is_valid or (x := t.as_py()) in seen:
                    continue
                seen.add(x)
                words = {p[:longest] for w in set(x.split()) if len(p := plain(w)) >= 4}
                n.update(words)
                if y:
                    bad.update(words)
                if len(n) > 200_000:
                    yield out()
        if n:
            yield out()

    words = known.mapInArrow(count, "word string, n long, bad long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    heads = words.select(F.explode(F.transform(F.sequence(F.lit(4), F.char_length("word")), lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("stem"), "n", "bad")
    pure = heads.groupBy("stem").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    pure = pure.where((F.col("bad") >= least) & (F.col("bad") / (F.col("n") + 1) >= purity))
    found = {r.stem: (r.n, r.bad) for r in pure.collect()}
    longer: dict[str, list[str]] = {}
    for x in found:
        longer.setdefault(x[:-1], []).append(x)
    stems: dict[str, float] = {}
    for x in sorted(found, key=len):
        if any(x[:k] in found for k in range(4, len(x))):
            continue
        while (best := max(longer.get(x, []), key=lambda y: found[y][1], default=None)) and found[best][1] >= 0.9 * found[x][1]:
            x = best  # as long a stem as its texts allow
        n, bad = found[x]
        stems[x] = math.log((bad + 0.5) / (n - bad + 0.5))
    draft = Lexicon(stems, dict.fromkeys(stems, 1.0))

    def misspelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter[tuple[str, int]] = Counter()
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                n.update({(stem, y) for kind, stem in draft.hits(t.as_py())[1].values() if kind == 2})
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in n], pa.string()), pa.array([y for _, y in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["stem", "y", "n"]
            )

    near: dict[str, list[int]] = {s: [0, 0] for s in stems}
    for r in known.mapInArrow(misspelt, "stem string, y int, n long").groupBy("stem", "y").agg(F.sum("n").alias("n")).collect():
        near[r.stem][int(r.y > 0)] += r.n
    # near a stem, words are taken for it (a little less) until clean texts speak against that
    trust = {s: math.log((bad + 0.5) / (clean + 0.5)) if clean else 0.9 * stems[s] for s, (clean, bad) in near.items()}
    lexicon = Lexicon(stems, {s: min(x, 0.9 * stems[s]) for s, x in trust.items() if x > 0.5})

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([lexicon.features(t.as_py()) for t in b.column(0)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(f[:, j].round(1)) for j in range(3)), b.column(1)], ["a", "b", "c", "y"])

    found = known.mapInArrow(look, "a double, b double, c double, y int").groupBy("a", "b", "c", "y").count().collect()
    x = np.array([[r.a, r.b, r.c] for r in found]).reshape(-1, 3)
    n = np.array([r["count"] for r in found], float)
    y = np.array([r.y for r in found], float)
    return Model(lexicon, fit(x, y, n) if len(x) else PRIOR.copy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and ``score``; nothing but the text goes into the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, unchanged and in their own columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t.as_py()) < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``."""
    return score(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
