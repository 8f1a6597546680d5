"""SimHash near-duplicates by similarity: candidates from the trie self-join, decided by exact comparison.

The Jaccard similarity of two sets of word shingles is bounded by the angle between them, and every
bit of a SimHash differs with a probability in proportion to that angle. Sets get wide fingerprints of
256 bits. The self-join of one trie with the error budget that a similarity of 0.8 takes (some 39 of
256 bits, and three standard deviations) could prune nothing before its nodes hold single texts, so the join
is done over several tries, each of other bits of the fingerprint: the first bits are taken exactly, which
is a trie's node and a bucket, and the node is joined with itself under a budget of errors. A pair with
a similarity of ``least`` meets in one of the tries with a probability of ``recall`` or more.

Of the pairs that a bucket finds, it returns a few minimum spanning forests by distance of the whole
fingerprints. Those edges are then compared exactly, set by set, and components follow from the ones that
hold. So no two texts are linked that aren't similar enough, and a group of copies never shows as pairs.
Buckets that left pairs out are joined once more: of those, every pair between different components is
compared exactly as well, in the task where it meets and in the first of the tries where it does. Rows with such
a pair bring their sets, and tasks return what links components: rows, never pairs. So each pair that meets is
compared, or lies in one component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, keyed_docs, mix64
from ledgerloom.llm.components import components, local_roots
from ledgerloom.llm.simhash import _BITS, keep_one, shingle_hashes, traverse

#: 64-bit words of a fingerprint; errors that are allowed among the bits below a bucket, and those bits.
WORDS, ERRORS, BELOW = 4, 3, 16
#: Spanning forests that a bucket returns, one after another of the edges that the ones before left.
FORESTS = 4
_RNG = np.random.Generator(np.random.PCG64(20240301))
_SALT = _RNG.integers(0, 2**64, WORDS, dtype=np.uint64)
_AT = np.arange(8 * WORDS) * 256


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(shingle_hashes(text, shingle))


def wide_fingerprint(grams: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """The SimHash of a set: a bit is 1 if it is set in over half of its members' hashes."""
    counts = np.zeros(2048 * WORDS, np.int64)
    for lo in range(0, len(grams), step):
        h = mix64(grams[lo:lo + step, None] ^ _SALT)
        counts += np.bincount((h.view(np.uint8).reshape(len(h), 8 * WORDS) + _AT).ravel(), minlength=len(counts))
    bits = 2 * (counts.reshape(-1, 256).astype(np.float64) @ _BITS) > len(grams)
    return np.packbits(bits).view(np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sorted arrays of distinct values; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


class Tries:
    """How the fingerprints of ``n`` sets are dealt: the deeper the buckets, the more tries."""

    def __init__(self, n: int, least: float, recall: float, bucket: int = 1024):
        self.least = least
        p = math.acos(2 * least / (1 + least)) / math.pi  # a bit differs, at sizes that are alike; less otherwise
        width, off = 64 * WORDS, math.sqrt(64 * WORDS * p * (1 - p))
        self.most, self.sure = math.ceil(width * p + 3 * off), max(0, math.floor(width * p - 4 * off))
        self.deep = max(0, math.ceil(math.log2(max(1, n) / bucket)))
        met = (1 - p) ** self.deep * sum(math.comb(BELOW, e) * p**e * (1 - p) ** (BELOW - e) for e in range(ERRORS + 1))
        self.tables = math.ceil(math.log(1 - recall) / math.log(1 - met))
        rng = np.random.Generator(np.random.PCG64(20240302))
        self.bits = np.array([rng.permutation(width)[: self.deep + BELOW] for _ in range(self.tables)])

    def deal(self, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tables, rows): bucket, and the bits below it at the top of a number."""
        bits, bucket, below = self._unpacked(wide), [], []
        for t in range(self.tables):
            value = self._value(bits, t)
            bucket.append(t * 2**self.deep + (value >> np.uint64(BELOW)).astype(np.int64))
            below.append((value << np.uint64(64 - BELOW)).view(np.int64))
        return np.array(bucket), np.array(below)

    def first(self, wide: np.ndarray, i: np.ndarray, j: np.ndarray, table: int) -> np.ndarray:
        """Which of the pairs (i, j) of rows of ``wide`` meet in none of the tries before ``table``."""
        left = np.arange(len(i))
        ends, at = np.unique(np.concatenate((i, j)), return_inverse=True)
        a, b = at[: len(i)], at[len(i):]
        bits = self._unpacked(wide[ends])
        for t in range(table):
            if not len(left):
                break
            value = self._value(bits, t)
            differ = value[a[left]] ^ value[b[left]]
            left = left[(differ >> np.uint64(BELOW) != 0) | (np.bitwise_count(differ) > ERRORS)]
        return left

    @staticmethod
    def _unpacked(wide: np.ndarray) -> np.ndarray:
        return np.unpackbits(wide.view(np.uint8).reshape(len(wide), -1), axis=1).astype(np.uint64)

    def _value(self, bits: np.ndarray, t: int) -> np.ndarray:
        """The bucket's bits and those below it in one number."""
        at = self.bits[t]
        return (bits[:, at] << np.arange(len(at) - 1, -1, -1).astype(np.uint64)).sum(1, dtype=np.uint64)


def _forest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which of the edges (i, j) of lengths ``d`` make a minimum spanning forest; rounds in which each component takes its shortest."""
    o = np.argsort(d, kind="stable")
    i, j = i[o], j[o]
    label, live, taken = np.arange(n), np.arange(len(o)), []
    while True:
        live = live[label[i[live]] != label[j[live]]]
        if not len(live):
            return o[np.concatenate(taken)] if taken else o[:0]
        best = np.full(n, len(o))
        np.minimum.at(best, label[i[live]], live)
        np.minimum.at(best, label[j[live]], live)
        new = np.unique(best[best < len(o)])
        taken.append(new)
        label = local_roots(n, label[i[new]], label[j[new]])[label]


def _forests(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, times: int = FORESTS) -> tuple[np.ndarray, bool]:
    """The edges of a minimum spanning forest, of another one among the rest, and so on; and whether some are left over."""
    _, rest = np.unique(i * n + j, return_index=True)
    taken = [rest[:0]]
    for _ in range(times):
        f = _forest(n, i[rest], j[rest], d[rest])
        taken.append(rest[f])
        rest = np.delete(rest, f)
    return np.concatenate(taken), len(rest) > 0


def _apart(wide: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(wide[i] ^ wide[j]).sum(1, dtype=np.int64)


def _bucket(below: np.ndarray, wide: np.ndarray, size: np.ndarray, tries: Tries, hold: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, bool]:
    """Spanning forests of the near pairs of a bucket, by rows; and whether there may be more pairs.

    Neighbours in the order of the bits are compared first: node pairs of the trie that those which are
    near beyond doubt have joined already are not gone down into.
    """
    order = np.argsort(below)
    below, wide, size = below[order], wide[order], size[order]
    n = len(order)

    def near(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fits = np.minimum(size[i], size[j]) >= np.maximum(size[i], size[j]) * (tries.least - 1e-9)
        i, j = i[fits], j[fits]
        d = _apart(wide, i, j)
        keep = d <= tries.most
        return i[keep], j[keep], d[keep]

    first = [near(np.arange(n - k), np.arange(k, n)) for k in range(1, min(5, n))]
    held = [tuple(np.concatenate(x) for x in zip(*first, strict=True))] if first else []
    close = held[0][2] <= tries.sure if held else np.zeros(0, bool)
    root = local_roots(n, held[0][0][close], held[0][1][close]) if close.any() else np.arange(n)
    changes = np.concatenate(([0], np.cumsum(root[1:] != root[:-1])))
    more = False

    def joined(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> np.ndarray:
        nonlocal more
        hit = (changes[ah - 1] == changes[al]) & (changes[bh - 1] == changes[bl]) & (root[al] == root[bl]) & ((ah > al + 1) | (bh > bl + 1))
        more = more or bool((hit & (np.maximum(ah, bh) - np.minimum(al, bl) > 5)).any())  # nearer neighbours have been compared
        return hit

    for i, j in traverse(below, below, True, ERRORS, BELOW, True, joined):
        held.append(near(i, j))
        if sum(len(x[0]) for x in held) > hold:
            i, j, d = (np.concatenate(x) for x in zip(*held, strict=True))
            f, over = _forests(n, i, j, d)
            held, more = [(i[f], j[f], d[f])], more or over
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), more
    i, j, d = (np.concatenate(x) for x in zip(*held, strict=True))
    f, over = _forests(n, i, j, d)
    return order[i[f]], order[j[f]], more or over


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, th): ``doc_id``, ``th``, ``s`` (hash of its set), ``n`` (its size), ``wide`` (its fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in b.column(1)]
            s = np.fromiter((xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets), np.uint64, len(sets))
            wide = [wide_fingerprint(x).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(s.view(np.int64)), pa.array([len(x) for x in sets], pa.int64()), pa.array(wide, pa.binary())],
                ["doc_id", "th", "s", "n", "wide"],
            )

    return docs.mapInArrow(run, "doc_id long, th long, s long, n long, wide binary")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``s`` and ``grams`` (the set's hashes as bytes) of ``docs`` (s, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [shingle_set(t.as_py(), shingle).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grams, pa.binary())], ["s", "grams"])

    return docs.mapInArrow(run, "s long, grams binary")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (u, v) whose sets have a similarity of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [
                jaccard(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= least
                for x, y in zip(b.column(2), b.column(3), strict=True)
            ]
            yield b.select(["u", "v"]).filter(pa.array(hit, pa.bool_()))

    left, right = (sets.select(F.col("s").alias(f"s{k}"), F.col("grams").alias(f"grams{k}")) for k in "uv")
    both = pairs.join(left, F.col("u") == F.col("su")).join(right, F.col("v") == F.col("sv"))
    return cut(both.select("u", "v", "gramsu", "gramsv").mapInArrow(run, "u long, v long"))


_ROWS = "bucket long, s long, n long, below long, wide binary"
_FOUND = "u long, v long, bucket long, c long"


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """bucket, s, n, below, wide of the rows of each bucket that a task holds."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got).combine_chunks()
    bucket, s, n, below = (table.column(i).to_numpy() for i in range(4))
    wide = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint64).reshape(-1, WORDS)
    o = np.argsort(bucket, kind="stable")
    for mine in np.split(o, np.flatnonzero(np.diff(bucket[o])) + 1):
        yield bucket[mine], s[mine], n[mine], below[mine].view(np.uint64), wide[mine]


def _dealt(nodes: DataFrame, tries: Tries) -> DataFrame:
    """A row of ``nodes`` for each bucket that it lies in."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(-1, WORDS)
            for bucket, below in zip(*tries.deal(wide), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(bucket), b.column(0), b.column(1), pa.array(below), b.column(2)], ["bucket", "s", "n", "below", "wide"])

    return nodes.select("s", "n", "wide").mapInArrow(deal, _ROWS)


def _parts(nodes: DataFrame, tries: Tries) -> int:
    return max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), tries.tables * 2**tries.deep // 256)


def near_pairs(nodes: DataFrame, tries: Tries, bucket_rows: int) -> DataFrame:
    """Candidate edges (u, v) over ``nodes`` (s, n, wide), u < v; and, with u and v null, each ``bucket`` of ``c`` rows
    that may hold more of them.

    A bucket with more than ``bucket_rows`` rows is dealt over several tasks first. There a row that is near another
    one beyond doubt is linked to it and goes; the others, and one of each such group, meet in the bucket.
    """

    def absorb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, s, n, below, wide in _columns(batches):
            rest, into = np.arange(len(s)), np.full(len(s), -1)
            for _ in range(64):  # as many groups; the rows of others simply pass on
                if not len(rest):
                    break
                pivot, others = rest[0], rest[1:]
                fits = np.minimum(n[others], n[pivot]) >= np.maximum(n[others], n[pivot]) * (tries.least - 1e-9)
                close = fits & (np.bitwise_count(wide[others] ^ wide[pivot]).sum(1, dtype=np.int64) <= tries.sure)
                into[others[close]] = pivot
                rest = others[~close]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array(s), pa.array(n), pa.array(below.view(np.int64)), pa.array([w.tobytes() for w in wide], pa.binary()), pa.array(s[into], mask=into < 0)],
                ["bucket", "s", "n", "below", "wide", "into"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, s, n, below, wide in _columns(batches):
            if len(s) > 1:
                i, j, more = _bucket(below, wide, n, tries)
                none, end = pa.nulls(len(i), pa.int64()), pa.array([None] * more, pa.int64())
                cols = [pa.array(np.minimum(s[i], s[j])), pa.array(np.maximum(s[i], s[j])), none, none]
                ends = [end, end, pa.array(bucket[:more]), pa.array([len(s)] * more, pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(cols, ends, strict=True)], ["u", "v", "bucket", "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64).reshape(-1, WORDS)
            bucket, c = np.unique(tries.deal(wide)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(c.astype(np.int64))], ["hb", "c"])

    parts, dealt = _parts(nodes, tries), _dealt(nodes, tries)
    hot = cut(nodes.select("wide").mapInArrow(count, "hb long, c long").groupBy("hb").agg(F.sum("c").alias("c")).where(F.col("c") > bucket_rows))
    if hot.isEmpty():
        return dealt.repartition(parts, "bucket").mapInArrow(meet, _FOUND).distinct()
    marked = dealt.join(hot, F.col("bucket") == F.col("hb"), "left")
    cell = F.pmod(F.xxhash64("s"), F.ceil(F.col("c") / bucket_rows))
    done = marked.where("hb IS NOT NULL").repartition(parts, "bucket", cell).select("bucket", "s", "n", "below", "wide")
    done = cut(done.mapInArrow(absorb, f"{_ROWS}, into long"))
    names = ["bucket", "s", "n", "below", "wide"]
    rest = marked.where("hb IS NULL").select(names).unionByName(done.where("into IS NULL").select(names))
    edges = done.where("into IS NOT NULL").select(F.least("s", "into").alias("u"), F.greatest("s", "into").alias("v"), F.lit(None).cast("long"), F.lit(None).cast("long"))
    found = rest.repartition(parts, "bucket").mapInArrow(meet, _FOUND).join(hot.select("hb"), F.col("bucket") == F.col("hb"), "left_anti")
    whole = hot.select(F.lit(None).cast("long"), F.lit(None).cast("long"), "hb", "c")
    return found.union(edges).union(whole).distinct()


_CELLS = "bucket long, one long, other long, cell long, s long, n long, below long, root long, wide binary"
_ENDS = "bucket long, s long, n long, below long, root long, wide binary"


def _celled(rows: DataFrame, cells: Column) -> DataFrame:
    """``rows``, each for every pair (``one``, ``other``) of its bucket's cells that its own ``cell`` is in."""
    dealt = rows.withColumn("cell", F.pmod(F.xxhash64("s"), cells)).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1)))
    return dealt.withColumn("one", F.least("cell", "to")).withColumn("other", F.greatest("cell", "to"))


def _meetings(table: pa.Table, tries: Tries) -> Iterator[tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """For each pair of cells in a ``table`` (columns of ``_CELLS``): its rows, and the pairs of them, in blocks, that have different
    roots, may be similar enough and meet in no trie before this one."""
    key = np.column_stack([table.column(i).to_numpy() for i in range(3)])
    cell, _, n, below, root = (table.column(i).to_numpy() for i in range(3, 8))
    wide = np.frombuffer(b"".join(table.column(8).to_pylist()), np.uint64).reshape(-1, WORDS)
    below = below.view(np.uint64)

    def pairs(bucket: int, work: list[tuple[np.ndarray, np.ndarray, bool]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b, same in work:
            if not len(a) or not len(b):
                continue
            for i, j in traverse(below[a], below[b], same, ERRORS, BELOW, True):
                i, j = a[i], b[j]
                i, j = (x[root[i] != root[j]] for x in (i, j))
                fits = np.minimum(n[i], n[j]) >= np.maximum(n[i], n[j]) * (tries.least - 1e-9)
                i, j = i[fits], j[fits]
                near = _apart(wide, i, j) <= tries.most
                i, j = i[near], j[near]
                if len(i):
                    here = tries.first(wide, i, j, bucket >> tries.deep)
                    yield i[here], j[here]

    o = np.lexsort((below, key[:, 2], key[:, 1], key[:, 0]))
    for mine in np.split(o, np.flatnonzero((np.diff(key[o], axis=0) != 0).any(1)) + 1):
        names, counts = np.unique(root[mine], return_counts=True)
        rest = root[mine] != names[counts.argmax()]  # the largest component has no pairs with itself to show
        if not rest.any():
            continue
        bucket, one, other = key[mine[0]].tolist()
        if one == other:
            work = [(mine[~rest], mine[rest], False), (mine[rest], mine[rest], True)]
        else:
            left, right = cell[mine] == one, cell[mine] == other
            work = [(mine[left & rest], mine[right], False), (mine[left & ~rest], mine[right & rest], False)]
        yield mine, pairs(bucket, work)


def ends_between(nodes: DataFrame, buckets: DataFrame, tries: Tries, bucket_rows: int) -> DataFrame:
    """The rows of ``nodes`` (s, n, wide, root) in ``buckets`` (b, c: rows) that have a candidate of another root there; one row a bucket.

    A bucket with more than ``bucket_rows`` rows is dealt to cells; each two cells, and each by itself, are a task's work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        del got
        hit = np.zeros(table.num_rows, bool)
        for _, pairs in _meetings(table, tries):
            for i, j in pairs:
                hit[i] = hit[j] = True
        yield from table.select(["bucket", "s", "n", "below", "root", "wide"]).filter(pa.array(hit)).to_batches()

    if buckets.count() <= 100_000:
        buckets = F.broadcast(buckets)
    dealt = _celled(_dealt(nodes, tries).join(buckets, F.col("bucket") == F.col("b")), F.ceil(F.col("c") / bucket_rows))
    dealt = dealt.select("bucket", "one", "other", "cell", "s", "n", "below", "wide")
    roots = nodes.select(F.col("s").alias("rs"), "root")
    dealt = dealt.join(roots, F.col("s") == F.col("rs")).select("bucket", "one", "other", "cell", "s", "n", "below", "root", "wide")
    return dealt.repartition(_parts(nodes, tries), "bucket", "one", "other").mapInArrow(run, _ENDS).dropDuplicates(["bucket", "s"])


def _joining(sets: list[np.ndarray], root: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], least: float) -> Iterator[tuple[int, int]]:
    """Those of the similar ``pairs`` that join components: rows' ``root`` at first, and what the ones before have joined."""
    label = np.unique(root, return_inverse=True)[1]
    size = np.array([len(x) for x in sets])
    names, number = np.unique(np.concatenate(sets), return_inverse=True)
    number = np.split(number.astype(np.int32), np.cumsum(size)[:-1])
    mark = np.zeros(len(names), bool)
    for i, j in pairs:
        o = np.argsort(i, kind="stable")
        i, j = i[o], j[o]
        for lo, hi in zip(*(x.tolist() for x in _runs(i)), strict=True):
            one = int(i[lo])
            apart = j[lo:hi]
            apart = apart[label[apart] != label[one]]
            if not len(apart):
                continue
            mark[number[one]] = True
            for x in np.split(apart, np.flatnonzero(np.diff(np.cumsum(size[apart]) >> 20)) + 1):
                x = x[label[x] != label[one]]
                if not len(x):
                    continue
                both = np.add.reduceat(mark[np.concatenate([number[k] for k in x])], np.cumsum(size[x]) - size[x], dtype=np.int64)
                like = x[both / (size[one] + size[x] - both) >= least]
                new, at = np.unique(label[like], return_index=True)
                if len(new):
                    yield from ((one, int(k)) for k in like[at])
                    label[np.isin(label, new)] = label[one]
            mark[number[one]] = False


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values start and end."""
    at = np.flatnonzero(np.diff(x)) + 1
    return np.concatenate(([0], at)) if len(x) else at, np.concatenate((at, [len(x)])) if len(x) else at


def links_between(ends: DataFrame, sets: DataFrame, tries: Tries, cell_grams: int) -> DataFrame:
    """Links (u, v) that join all components of ``ends`` (columns of ``_ENDS``) between which a candidate pair is similar enough.

    ``sets`` has ``s`` and ``grams``. A bucket whose sets have more than ``cell_grams`` members is dealt to cells, as in ``ends_between``.
    A task returns a spanning forest of what it finds, so no more rows than it holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        del got
        s, root = table.column("s").to_numpy(), table.column("root").to_numpy()
        grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("grams")]
        row = np.full(len(s), -1)
        for mine, pairs in _meetings(table, tries):
            row[mine] = np.arange(len(mine))
            near = ((row[i], row[j]) for i, j in pairs)
            found = np.array(list(_joining([grams[k] for k in mine], root[mine], near, tries.least)), np.int64).reshape(-1, 2)
            u, v = s[mine[found[:, 0]]], s[mine[found[:, 1]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    cells = cut(ends.groupBy(F.col("bucket").alias("b")).agg(F.sum("n").alias("size")).withColumn("cells", F.ceil(F.col("size") / cell_grams)))
    total = cells.agg(F.sum(F.col("size") * F.col("cells"))).head()[0] or 0
    parts = max(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // cell_grams)
    dealt = _celled(ends.join(cells.select("b", "cells"), F.col("bucket") == F.col("b")), F.greatest("cells", F.lit(1)))
    grams = sets.select(F.col("s").alias("gs"), "grams")
    dealt = dealt.join(grams, F.col("s") == F.col("gs")).select("bucket", "one", "other", "cell", "s", "n", "below", "root", "wide", "grams")
    return dealt.repartition(int(parts), "bucket", "one", "other").mapInArrow(run, "u long, v long").distinct()


def linked(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float, recall: float = 0.99, bucket_rows: int = 16384,
    cell_grams: int = 1 << 21,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``th`` (hash of the text), ``root`` (its component).

    Two rows are linked if their sets of shingles have a Jaccard similarity of ``least`` or more.
    Null texts and texts without words are linked with each other; a text with fewer words than a shingle has
    one, all its words. An empty table gives no rows.
    """
    texts = keyed_docs(docs, id_col, text_col)
    table = cut(_sketches(texts, shingle))
    nodes = cut(table.groupBy("s").agg(F.first("n").alias("n"), F.first("wide").alias("wide"), F.min(F.struct("doc_id", "th")).alias("k")))
    tries = Tries(nodes.count(), least, recall)

    def sets(ends: DataFrame) -> DataFrame:
        one = cut(nodes.join(ends, F.col("s") == F.col("e"), "left_semi").select("s", F.col("k.doc_id").alias("d"), F.col("k.th").alias("t")))
        return cut(_sets(texts.join(one, texts.doc_id.eqNullSafe(F.col("d")) & texts.th.eqNullSafe(F.col("t"))).select("s", "text").dropDuplicates(["s"]), shingle))

    found = cut(near_pairs(nodes, tries, bucket_rows))
    pairs = found.where("u <> v").select("u", "v")
    roots = components(_verified(pairs, sets(pairs.select(F.explode(F.array("u", "v")).alias("e")).distinct()), least))
    buckets = cut(found.where("u IS NULL").select(F.col("bucket").alias("b"), "c"))
    if not buckets.isEmpty():
        known = cut(nodes.join(roots, nodes.s == roots.v, "left").select("s", "n", "wide", F.coalesce("root", "s").alias("root")))
        ends = cut(ends_between(known, buckets, tries, bucket_rows))
        if not ends.isEmpty():
            more = links_between(ends, sets(ends.select(F.col("s").alias("e")).distinct()), tries, cell_grams)
            roots = components(roots.select(F.col("v").alias("u"), F.col("root").alias("v")).unionByName(more))
    return table.join(roots, table.s == roots.v, "left").select("doc_id", "th", F.coalesce("root", "s").alias("root"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each component of ``linked``, columns as they are: that of the smallest ``doc_id``, null last."""
    return keep_one(docs, cut(linked(docs, id_col, text_col, shingle, least)), id_col, text_col)
