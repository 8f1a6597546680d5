"""SimHash near-duplicates by a self-join of a binary trie.

Every text gets a 64-bit fingerprint of its word shingles. The distinct fingerprints form a binary
trie. Pairs of its nodes are traversed together: where the two go down on different bits the error
grows, and a pair is pruned when the error exceeds the budget. The driver traverses the few top
nodes (only nodes with more than ``leaf`` fingerprints are split, so their number is bounded by
fingerprints / leaf); each pair of subtrees that is left is a task's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, keyed_docs
from ledgerloom.llm.components import components, local_roots

#: Bits by which the top of the trie branches at once.
STEP = 4
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1).astype(np.int64)
_BYTE = np.arange(8) * 256


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """The XXH64 of each shingle: A-Z lower-cased, words split at ASCII white space.

    Fewer words than ``shingle`` are one shingle; no words, or null, give none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(b" ".join(words), seed)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    return np.fromiter(
        [h(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[shingle - 1:].tolist(), strict=True)],
        np.uint64, n,
    )


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half of ``shingle_hashes``; 0 without words."""
    hashes = shingle_hashes(text, shingle, seed)
    n = len(hashes)
    if n <= 1:
        return int(hashes[0]) if n else 0
    counts = np.bincount((hashes.view(np.uint8).reshape(n, 8) + _BYTE).ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (counts @ _BITS)[::-1] > n).astype(np.uint8)  # the last byte is the highest
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long), ``th`` (a hash of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2)], ["doc_id", "fp", "th"])

    return keyed_docs(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long, th long")


def _pairs(heavy: set[tuple[int, int]], budget: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Pairs of leaves (depth, prefix) that may hold fingerprints within the budget."""
    out, stack = [], [((0, 0), (0, 0))]
    while stack:
        a, b = stack.pop()
        kids = [
            [(x[0] + STEP, x[1] << STEP | i) for i in range(1 << STEP)] if x in heavy and x[0] < 64 else None for x in (a, b)
        ]
        if kids == [None, None]:
            out.append((a, b))
            continue
        if a == b:
            stack += [(x, y) for i, x in enumerate(kids[0]) for y in kids[0][i:] if (x[1] ^ y[1]).bit_count() <= budget]
            continue
        # the shallower goes down first, so that both keep the same depth as long as they can
        side = 1 if kids[0] is None or (kids[1] is not None and b[0] < a[0]) else 0
        for x in kids[side]:
            y = b if side == 0 else a
            d = min(x[0], y[0])
            if ((x[1] >> (x[0] - d)) ^ (y[1] >> (y[0] - d))).bit_count() <= budget:
                stack.append((x, y))
    return out


def traverse(
    a: np.ndarray, b: np.ndarray, same: bool, budget: int, bits: int = 64, equal: bool = False,
    skip: Callable[..., np.ndarray] | None = None, most: int = 1 << 19,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted arrays of fingerprints that differ in at most ``budget`` of the first ``bits`` bits.

    Node pairs are ranges of the arrays that share their leading bits; at most about ``most`` of them
    are held for a level, the rest wait on a stack. Pairs of equal fingerprints come only if ``equal``;
    node pairs for which ``skip`` (of the four ends) is true are left out.
    """
    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    seen = ~np.uint64(0) << np.uint64(64 - bits)

    def count(bit: int) -> tuple[np.ndarray, np.ndarray]:
        if bit not in ones:
            sh = np.uint64(63 - bit)
            one = np.uint64(1)
            ca = np.concatenate(([0], np.cumsum((a >> sh) & one, dtype=np.int64)))
            ones[bit] = (ca, ca if same else np.concatenate(([0], np.cumsum((b >> sh) & one, dtype=np.int64))))
        return ones[bit]

    z = np.zeros(1, np.int64)
    stack = [(0, z, z + len(a), z, z + len(b), z)]
    while stack:
        bit, al, ah, bl, bh, err = stack.pop()
        if len(al) > most:
            h = len(al) // 2
            stack += [(bit, al[h:], ah[h:], bl[h:], bh[h:], err[h:]), (bit, al[:h], ah[:h], bl[:h], bh[:h], err[:h])]
            continue
        if skip is not None:
            al, ah, bl, bh, err = (x[~skip(al, ah, bl, bh)] for x in (al, ah, bl, bh, err))
        na, nb = ah - al, bh - bl
        small = (na * nb <= 16) | ((bit == bits) & (na * nb <= most))
        if small.any():
            s = np.flatnonzero(small)
            part = np.cumsum(na[s] * nb[s]) // most
            for t in np.split(s, np.flatnonzero(np.diff(part)) + 1):
                n = na[t] * nb[t]
                rep = np.repeat(t, n)
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                i, j = al[rep] + k // nb[rep], bl[rep] + k % nb[rep]
                d = np.bitwise_count((a[i] ^ b[j]) & seen)
                keep = d <= budget if equal else (d <= budget) & (d > 0)
                if same:
                    keep &= i < j
                if keep.any():
                    yield i[keep], j[keep]
            r = np.flatnonzero(~small)
            al, ah, bl, bh, err = al[r], ah[r], bl[r], bh[r], err[r]
        if not len(al):
            continue
        if bit == bits:  # large node pairs without bits left: halves against halves
            am, bm = (al + ah) // 2, (bl + bh) // 2
        else:
            ca, cb = count(bit)
            am, bm = ah - (ca[ah] - ca[al]), bh - (cb[bh] - cb[bl])
        twin = (al == bl) & (ah == bh) if same else np.zeros(len(al), bool)
        parts = []
        for x, y, e in ((0, 0, 0), (1, 1, 0), (0, 1, int(bit < bits)), (1, 0, int(bit < bits))):
            cl, ch = (al, am) if x == 0 else (am, ah)
            dl, dh = (bl, bm) if y == 0 else (bm, bh)
            keep = (ch > cl) & (dh > dl) & (err + e <= budget)
            if (x, y) == (1, 0):
                keep &= ~twin  # a node with itself: the mirror image of (0, 1)
            parts.append((cl[keep], ch[keep], dl[keep], dh[keep], err[keep] + e))
        stack.append((min(bit + 1, bits), *(np.concatenate([p[i] for p in parts]) for i in range(5))))


def links(fps: DataFrame, budget: int, leaf: int = 16384, most_leaves: int = 4096) -> DataFrame:
    """Edges (u, v) over distinct fingerprints (column ``fp``) whose closure is that of all links.

    Every pair of fingerprints that differ in at most ``budget`` bits meets in exactly one task. A
    task returns a spanning forest of the pairs that it finds, not the pairs. (A fingerprint has at
    most sum C(64, i), i <= budget, partners, so the pairs grow in proportion to the rows.)

    A fingerprint is sent to every leaf within the budget of its own. Leaves hold n / ``most_leaves`` at least, so
    they are some 12 bits deep however many rows there are: at two bits 79 leaves at most, about half as many copies,
    since a pair of leaves meets once. That is some 500 bytes for each of 10**9 fingerprints, and 160,000 pairs of leaves.
    """
    n = fps.count()
    leaf = max(leaf, n // most_leaves)
    heavy: set[tuple[int, int]] = set()
    if n > leaf:
        heavy.add((0, 0))
        for top in range(STEP, 64, 4 * STEP):  # deeper only below nodes that are still too large
            depths = [d for d in range(top, min(top + 4 * STEP, 64), STEP)]
            found = (
                fps.select(F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.shiftrightunsigned("fp", 64 - d).alias("p")) for d in depths])).alias("x"))
                .groupBy("x.d", "x.p").count().where(F.col("count") > leaf).collect()
            )
            heavy |= {(r.d, r.p) for r in found}
            if not any(r.d == depths[-1] for r in found):
                break
    pairs = _pairs(heavy, budget)
    leaves = sorted({x for p in pairs for x in p})
    number = {x: i for i, x in enumerate(leaves)}
    of = [[] for _ in leaves]
    for k, (x, y) in enumerate(pairs):
        of[number[x]].append((k, 0))
        if x != y:
            of[number[y]].append((k, 1))
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in of])))
    flat = np.array([y for x in of for y in x], np.int64).reshape(-1, 2)
    by_depth: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in sorted({x[0] for x in leaves}):
        at = [(x[1], number[x]) for x in leaves if x[0] == d]
        by_depth[d] = (np.array([x for x, _ in at], np.uint64), np.array([y for _, y in at]))
    is_self = np.array([x == y for x, y in pairs])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            leaf_of = np.full(len(fp), -1)
            for d, (prefixes, ids) in by_depth.items():
                mine = fp >> np.uint64(64 - d) if d else np.zeros(len(fp), np.uint64)
                at = np.minimum(np.searchsorted(prefixes, mine), len(prefixes) - 1)
                hit = prefixes[at] == mine
                leaf_of[hit] = ids[at[hit]]
            n = (offsets[1:] - offsets[:-1])[leaf_of]
            rep = np.repeat(np.arange(len(fp)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            to = flat[offsets[leaf_of][rep] + k]
            for lo in range(0, len(rep), 500_000):
                s = slice(lo, lo + 500_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[s, 0].astype(np.int32)), pa.array(to[s, 1].astype(np.int8)), pa.array(fp[rep[s]].view(np.int64))],
                    ["pair", "side", "fp"],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)) for b in batches]
        if not got:
            return
        pair, side, fp = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        order = np.lexsort((fp, side, pair))
        pair, side, fp = pair[order], side[order], fp[order]
        cuts = np.flatnonzero(np.diff(pair)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(pair)], strict=True):
            mid = lo + int(np.searchsorted(side[lo:hi], 1))
            same = bool(is_self[pair[lo]])
            a, b = fp[lo:mid], fp[lo:mid] if same else fp[mid:hi]
            if not len(a) or not len(b):
                continue
            both = a if same else np.concatenate((a, b))
            root, wait = None, []
            for last, (i, j) in _with_last(traverse(a, b, same, budget)):
                wait.append((i, j if same else j + len(a)))
                if last or sum(len(x) for x, _ in wait) > 2_000_000:
                    if root is not None:
                        wait.append((np.arange(len(both)), root))
                    root = local_roots(len(both), *(np.concatenate(x) for x in zip(*wait, strict=True)))
                    wait = []
            if root is not None:
                child = np.flatnonzero(root != np.arange(len(both)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[child].view(np.int64)), pa.array(both[root[child]].view(np.int64))], ["u", "v"]
                )

    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(len(pairs), n // 50_000))
    dealt = fps.select("fp").mapInArrow(deal, "pair int, side tinyint, fp long")
    return dealt.repartition(parts, "pair").mapInArrow(meet, "u long, v long")


def _with_last(items: Iterator) -> Iterator[tuple[bool, object]]:
    """Each item, with whether it is the last."""
    held, have = None, False
    for x in items:
        if have:
            yield False, held
        held, have = x, True
    if have:
        yield True, held


def _linked(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, seed: int) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``th``, ``fp``, ``root`` (the component), ``component_id`` (its smallest doc_id)."""
    table = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    distinct = cut(table.groupBy("fp").agg(F.min("doc_id").alias("least_doc")))
    roots = components(links(distinct.select("fp"), max_bits))
    named = distinct.join(roots, distinct.fp == roots.v, "left").select(
        "fp", "least_doc", F.coalesce("root", "fp").alias("root")
    )
    names = named.groupBy(F.col("root").alias("r")).agg(F.min("least_doc").alias("component_id"))
    by_fp = named.join(names, named.root == names.r).select(F.col("fp").alias("f"), "root", "component_id")
    return table.join(by_fp, table.fp == by_fp.f).select("doc_id", "th", "fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, seed: int = 42
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    Two rows are linked if their fingerprints differ in at most ``max_bits`` bits; ``component_id``
    is the smallest ``doc_id`` that a row can reach. Null and empty texts, and texts without words,
    have fingerprint 0 and are linked like any other. A null ``doc_id`` is never a component's name
    unless the whole component has none. Repeated rows come out repeated. An empty table gives no
    rows.
    """
    return _linked(docs, id_col, text_col, shingle, max_bits, seed).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` of each component, columns as they are.

    ``found`` has ``doc_id``, ``th`` (hash of the text) and ``root`` (component) of each row. The row
    with the smallest ``doc_id`` (null last), then the smallest ``th`` stays; of rows that repeat both
    one does.
    """
    keys = found.groupBy("root", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    least = keys.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "n")).alias("k"))
    keep = cut(least.select(F.col("k.doc_id").alias("_kept_id"), F.col("k.th").alias("_kept_th"), F.col("k.n").alias("_kept_n")))
    doc, th = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))

    def rows(of: DataFrame) -> DataFrame:
        return docs.join(of, doc.eqNullSafe(F.col("_kept_id")) & th.eqNullSafe(F.col("_kept_th")), "left_semi")

    again = keep.where("_kept_n > 1")
    if again.isEmpty():
        return rows(keep)
    ties = rows(again).withColumn("_kept_id", doc).withColumn("_kept_th", th).dropDuplicates(["_kept_id", "_kept_th"])
    return rows(keep.where("_kept_n = 1")).unionByName(ties.drop("_kept_id", "_kept_th"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of each component of ``near_duplicates``: that of the smallest ``doc_id``, null last."""
    return keep_one(docs, cut(_linked(docs, id_col, text_col, shingle, max_bits, 42)), id_col, text_col)
