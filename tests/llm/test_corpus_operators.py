"""Operators against brute force, round trips and held-out labels; odd tables don't break them."""

import hashlib
import math
import random
import tracemalloc

import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import line_dedup, mixing, nearest, pieces, rarity, repeats, sharding, similar, simhash, substring_dedup, suffix_dedup, toxicity, windows
from ledgerloom.llm.common import BYTE_CODES, Rolling, mix64
from ledgerloom.llm.components import components, local_roots
from ledgerloom.llm.queries import model_path

from llm.conftest import words


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup, line_dedup])
def test_repeats_against_brute_force(op, docs, rows):
    assert tuples(op.digest(docs)) == sorted(op.brute(rows), key=repr)


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup, line_dedup])
def test_repeats_on_odd_tables(op, empty, doubled):
    assert op.digest(empty).count() == 0
    assert op.digest(doubled).count() == doubled.count()


def covered(records, k, n):
    """Which of ``n`` symbols of each document the settled spans cover."""
    out = {}
    for doc, _, start, end in records.spans:
        for d, x, y in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True):
            out.setdefault(d, np.zeros(n[d], bool))[x:y] = True
    return {d: int(m.sum()) for d, m in out.items() if m.any()}


@pytest.mark.parametrize("chunk", [1 << 20, 700])
def test_long_texts_are_worked_on_in_pieces(rows, chunk):
    """What is removed is what brute force removes, however small the pieces are that texts are cut into."""
    none = np.zeros(0, np.uint64)
    text = [(i, (t or "").encode()) for i, t in rows if i != 84]
    few = [(i, t) for i, t in rows if i != 84]
    for scheme, settle, brute, split in (
        (windows.Scheme(windows.by_bytes, 40, 8, True, none), suffix_dedup.suffix_settler, suffix_dedup.brute, bytes),
        (windows.Scheme(windows.by_words, 10, 3, False, none), windows.word_settler, substring_dedup.brute, bytes.split),
    ):
        out = repeats.Records()
        list(windows.cutter(scheme, chunk)(((i, 0, t) for i, t in text), out))
        got = covered(repeats.settled(out, settle(scheme)), scheme.k, {i: len(split(t)) for i, t in text})
        assert got == {x[0]: x[2] for x in brute(few, scheme.k) if x[2]}


def test_equal_hashes_of_different_strings():
    """With all hashes equal, the comparison of bytes alone must tell windows apart."""
    s = windows.by_bytes(b"abcdefgh" + b"abcdefgh" + b"12345678")

    class Flat:
        def at(self, a, b):
            return np.zeros(len(a), np.uint64)

    hit, on = windows.repeated(s, Flat(), np.array([0, 8, 16]), np.array([1, 2, 3]), np.array([0, 0, 0]), 8)
    assert hit.tolist() == [False, True, False] and on.tolist() == [True, False, True]


@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 + 1 for x in b)), max_size=30))
def test_multikey_sort(strings):
    buf = np.frombuffer(b"".join(s.ljust(48, b"\0") for s in strings), np.uint8)
    begin = np.arange(len(strings)) * 48
    order, common = suffix_dedup.multikey_sort(lambda i, at: windows.eight(buf, begin[i] + at), len(strings), 48)
    assert [strings[i] for i in order] == sorted(strings)
    for k in range(1, len(strings)):
        a, b = (strings[order[k - j]].ljust(48, b"\0") for j in (1, 0))
        assert common[k] == next((i for i in range(48) if a[i] != b[i]), 48)


def test_texts_that_repeat_themselves():
    """Texts of short periods, cut into pieces or not, against brute force; a long one costs no more than others."""
    rng = random.Random(3)

    def settle(rows, k, m, chunk):
        scheme, out = windows.Scheme(windows.by_bytes, k, m, True, np.zeros(0, np.uint64)), repeats.Records()
        list(windows.cutter(scheme, chunk)(((i, 0, t.encode()) for i, t in rows), out))
        return repeats.settled(out, suffix_dedup.suffix_settler(scheme))

    for _ in range(40):
        rows = []
        for i in range(rng.randint(1, 6)):
            unit = "".join(rng.choice("ab") for _ in range(rng.randint(1, 6)))
            rows.append((i, "".join(rng.choice([unit * rng.randint(1, 30), "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))]) for _ in range(5))))
        k = rng.choice([6, 12, 20])
        got = covered(settle(rows, k, rng.choice([2, 3, 5]), rng.choice([50, 1 << 20])), k, {i: len(t) for i, t in rows})
        assert got == {x[0]: x[2] for x in suffix_dedup.brute(rows, k) if x[2]}
    done = settle([(0, "x" * 300_000), (1, "ab " * 100_000)], 400, 32, 1 << 20)
    assert covered(done, 400, {0: 300_000, 1: 300_000}) == {0: 300_000, 1: 300_000} and sum(map(len, done.text)) < 2000


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup, line_dedup])
def test_keys_that_would_overfill_a_bucket(op, spark, monkeypatch):
    """One passage in every document: its keys are dealt to many buckets, and the result is that of brute force."""
    rng = random.Random(4)
    passage = "\n".join(words(rng, 12) for _ in range(8))
    rows = [(i, f"{words(rng, 20)}\n{passage}\n{words(rng, 20)}") for i in range(120)]
    found = []
    real = repeats.hot_keys
    monkeypatch.setattr(repeats, "hot_keys", lambda *a: found.append(real(*a)) or found[-1])
    got = op.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(12))
    assert tuples(got) == sorted(op.brute(rows), key=repr) and len(found[0])


def brute_fp(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i:i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def test_simhash_against_brute_force(docs, rows):
    fp = {i: brute_fp(t) for i, t in rows}
    ids = sorted(fp)
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if (fp[ids[a]] ^ fp[ids[b]]).bit_count() <= 2]
    root = local_roots(len(ids), *np.array(pairs).T)
    want = sorted(((i, f"{fp[i]:016x}", ids[root[k]]) for k, i in enumerate(ids)), key=repr)
    assert tuples(simhash.near_duplicates(docs)) == want


def test_trie_join_of_many_leaves(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near, near ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)), np.arange(300, dtype=np.uint64)]))
    for budget in (0, 1, 2, 3):
        a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= budget)
        want = local_roots(len(fps), a, b)
        df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
        got = simhash.links(df, budget, leaf=12).collect()
        at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
        assert (local_roots(len(fps), np.array([at[r.u] for r in got], int), np.array([at[r.v] for r in got], int)) == want).all()


def test_fingerprints_of_very_long_texts():
    rng = random.Random(14)
    long = " ".join(rng.choice(["alpha", "Beta", "gamma", "déjà", "x"]) + str(rng.randrange(50)) for _ in range(60_000))
    assert simhash.fingerprint(long) == brute_fp(long)
    bits = rarity.surprise(np.arange(65536) % 977)
    raw = long.encode()
    assert (rarity.features(raw, bits, chunk=5000) == rarity.features(raw, bits)).all() and len(rarity.fingerprint(raw, bits)) > 10
    grams = similar.shingle_set(long, 5)
    assert (similar.wide_fingerprint(grams, step=1000) == similar.wide_fingerprint(grams)).all()


def test_simhash_on_odd_tables(empty, doubled):
    assert simhash.near_duplicates(empty).count() == 0
    got = simhash.near_duplicates(doubled)
    assert got.count() == doubled.count() and got.where("doc_id IS NOT NULL AND component_id > doc_id").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7), (500, 400), (100, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {200: 100, 300: 100, 500: 400}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_mixing(docs, rows, empty, doubled):
    got = mixing.rates(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    per = got.groupby("source", dropna=False).agg(size=("source_size", "first"), target=("target", "first"))
    weight = dict(zip([*sorted(x for x in per.index if isinstance(x, str)), None], [3, 1, 2] * 9, strict=False))
    target, left, free = {}, 1.5 * per["size"].sum(), {k if isinstance(k, str) else None: v for k, v in per["size"].items()}
    while free:  # share by weight, cap, share the excess again
        level = left / sum(weight[k] for k in free)
        over = [k for k, size in free.items() if level * weight[k] > 2 * size]
        target |= {k: 2 * free[k] if k in over else level * weight[k] for k in (over or free)}
        left -= sum(2 * free[k] for k in over)
        free = {k: v for k, v in free.items() if k in over and False or k not in over} if over else {}
    for k, t in per["target"].items():
        assert math.isclose(t, target[k if isinstance(k, str) else None])
    assert (got.taken <= 2 * got["size"]).all() and (got["size"] == [len((dict(rows)[i] or "").encode().split()) for i in got.doc_id]).all()
    taken = got.groupby("source", dropna=False).taken.sum()
    assert (abs(taken - per["target"]) <= got["size"].max()).all()
    copies = mixing.mix(docs).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    assert copies == {r.doc_id: r.copies for r in got.itertuples() if r.copies}
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.rates(empty).count() == 0 and mixing.rates(doubled).count() == doubled.count()


def test_mixing_comes_near_its_targets(spark):
    got = mixing.digest(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id").toPandas()
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(per.taken / per.target - 1) < 0.02).all()


def test_sharding(docs, empty, doubled):
    for table in (docs, doubled):
        got = sharding.shards(table).toPandas()
        sizes = got.groupby("shard").size().reindex(range(16), fill_value=0)
        assert len(got) == table.count() and sizes.max() - sizes.min() <= 1
        assert all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("shard"))
    assert sharding.shards(empty).count() == 0


def test_sharding_keeps_equal_texts_together_and_splits_large_groups(spark):
    rows = [(i, "same") for i in range(60)] + [(100 + i, f"pair {i // 2}") for i in range(60)] + [(300 + i, f"own {i}") for i in range(200)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    got["text"] = got.doc_id.map(dict(rows))
    assert got.groupby("shard").size().tolist() == [20] * 16
    assert (got[got.text.str.startswith("pair")].groupby("text").shard.nunique() == 1).mean() > 0.9
    assert got[got.text == "same"].shard.nunique() <= 6  # it needs three at least


def test_nearest_recall_and_order(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 16))
    x[700:900] = x[3] + 0.01 * rng.standard_normal((200, 16))
    x[900:910] = x[20]
    rows = [(int(i), [float(v) for v in x[i]], 1) for i in range(len(x))]
    odd = [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [float("nan")] * 16, 1), (5060, [None] * 16, 1), (5080, [1.0], 1), (None, [1.0] * 16, 1), (5100, [float("inf")] * 16, 1)]
    got = nearest.search(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int"), block=100)
    assert nearest.recall_of(got, np.arange(len(x)), x) >= 0.9
    df = got.toPandas().sort_values(["query_id", "rank"])
    assert (df.groupby("query_id").size() == 20).all() and set(df.query_id) == set(range(0, 1500, 20))
    for _, g in df.groupby("query_id"):
        assert g["rank"].tolist() == list(range(1, 21)) and g.vec_id.is_unique
        key = list(zip(-g.score, g.vec_id, strict=True))
        assert key == sorted(key)
    np.testing.assert_allclose(df.score, (x[df.query_id] * x[df.vec_id]).sum(1), rtol=1e-12)


@pytest.mark.parametrize(("n", "clustered"), [(6000, True), (6000, False), (1000, False)])
def test_nearest_compares_fewer_than_all(n, clustered):
    """What queries visit, all tables together, is less than all rows, at a recall of 0.9 and more."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, 48)) + (4 * rng.standard_normal((30, 48))[rng.integers(0, 30, n)] if clustered else 0)
    index = nearest.fit(x[: min(n, 3000)], n, np.sqrt((x * x).sum(1)).max(), 20, 1, 4, 500, 0.94, 7)
    cells, q = index.cells(x), x[::20]
    index.count = np.array([np.bincount(c, minlength=nearest.LEVELS**4) for c in cells])
    score = q @ x.T
    score[np.arange(len(q)), np.arange(len(q)) * 20] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    seen, compared = np.zeros(best.shape, bool), 0
    for t, qi, c, _ in index.probes(q, 21):
        visit = np.zeros((len(q), nearest.LEVELS**4), bool)
        visit[qi, c] = True
        seen |= np.take_along_axis(visit, cells[t][best], 1)
        compared += index.count[t][c].sum() / len(q)
    assert seen.mean() >= 0.9 and compared < (0.4 if clustered else 0.95) * n


def test_nearest_is_fitted_in_little_memory():
    """What the driver holds does not grow with queries times cells; the sample stands for a table of any length."""
    x = np.random.default_rng(4).standard_normal((2000, 16))
    tracemalloc.start()
    index = nearest.fit(x, 600_000, np.sqrt((x * x).sum(1)).max(), 20, 1, 8, 1024, 0.94, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < index.share < 1 and peak < 200 << 20


def test_nearest_with_an_id_that_fills_a_block():
    """An id that repeats more often than a query has neighbours leaves room for the others."""
    x = np.random.default_rng(5).standard_normal((60, 8))
    m, ids = np.concatenate([x, np.repeat(9 * x[:1], 40, axis=0)]), np.concatenate([np.arange(60), np.full(40, 61)])
    query, vec, score = nearest._block(x[:1], np.zeros(1, np.int64), m, ids, np.full(1, -np.inf), 20, 39)
    assert query.tolist() == [0] * 20 and vec.tolist() == [61, *(1 + np.argsort(-(x[1:] @ x[0])))[:19].tolist()]


def test_nearest_with_clashing_names_repeated_ids_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    x[0] *= 10
    x[100:140] = x[0]  # more ties than a query's neighbours
    rows = [(i, [float(v) for v in x[i]], 1.0, "a", 3, True) for i in range(300)] + [(7, [float(v) for v in 2 * x[7]], 1.0, "b", 3, False)]
    names = "vec_id long, embedding array<double>, square double, block string, id long, query boolean"
    got = nearest.search(spark.createDataFrame(rows, names)).toPandas().sort_values(["query_id", "rank"])
    assert got[got.query_id == 0].vec_id.tolist() == list(range(100, 120))
    assert not got.duplicated(["query_id", "vec_id"]).any() and (got.groupby("query_id").size() == 20).all()
    sevens = got[got.vec_id == 7]
    np.testing.assert_allclose(sevens.score, [max(x[7] @ x[q], 2 * x[7] @ x[q]) for q in sevens.query_id])


def test_nearest_of_few(spark):
    rows = [(i, [float(i), 1.0]) for i in range(0, 50, 10)]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert got.count() == 3 * 4
    assert nearest.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_fingerprints(docs, rows, empty, doubled):
    got = {r.doc_id: r for r in rarity.digest(docs).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        changed = rarity.edit(t, after)
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[80].fingerprint == got[81].fingerprint != "" and got[0].fingerprint == got[1].fingerprint == ""
    assert got[84].near_edited > 0.5 > got[84].near_next and got[82].near_next > 0.9 and got[81].near_next == 1
    assert rarity.digest(empty).count() == 0 and rarity.digest(doubled).count() == doubled.count()


def brute_filters(text, bits):
    """A fingerprint by loops over windows, stretches and hash functions: sets of bits."""
    codes, base = [int(c) for c in BYTE_CODES], Rolling.BASE
    seen = []
    for width, least, most, stretch, popular in rarity.KINDS:
        if not text or not least <= len(text) < most:
            continue
        width = min(width, len(text))
        rare = [sum(int(bits[text[i + j] << 8 | text[i + j + 1]]) for j in range(width - 1)) for i in range(len(text) - width + 1)]
        stretch = min(stretch, len(rare))
        votes = [0] * len(rare)
        for i in range(len(rare) - stretch + 1):
            votes[max(range(i, i + stretch), key=lambda j: (rare[j], -j))] += 1
        for i, v in enumerate(votes):
            if v >= min(popular, max(1, (len(rare) - stretch + 1) // 4)):
                h = sum(codes[text[i + j]] * base**j for j in range(width)) + width
                h = int(mix64(np.array([h % 2**64], np.uint64))[0])
                if h not in seen:
                    seen.append(h)
    out = [set() for _ in range(-(-len(seen) // rarity.PER_FILTER))]
    for n, h in enumerate(seen):
        out[n // rarity.PER_FILTER] |= {(h >> 11 * k) % rarity.FILTER_BITS for k in range(rarity.HASHES)}
    return out


def brute_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0

    def one_way(x, y):
        best = []
        for f in x:
            own = []
            for g in y:
                chance, most = len(f) * len(g) / rarity.FILTER_BITS, min(len(f), len(g))
                own.append(min(1, max(0, (len(f & g) - chance) / max(most - chance, 1e-9))))
            best.append(max(own) * len(f))
        return sum(best) / sum(map(len, x))

    if len(a) == len(b):
        return (one_way(a, b) + one_way(b, a)) / 2
    return one_way(a, b) if len(a) < len(b) else one_way(b, a)


def test_fingerprints_against_brute_force(docs, rows):
    def as_hex(filters):
        return b"".join(np.packbits([i in f for i in range(rarity.FILTER_BITS)]).tobytes() for f in filters).hex()

    counts = np.zeros(65536, np.int64)
    for _, t in rows:
        raw = (t or "").encode()
        for x, y in zip(raw, raw[1:]):
            counts[x << 8 | y] += 1
    bits = rarity.surprise(counts)
    got = {r.doc_id: r for r in rarity.digest(docs).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        if len(t) > 4000 or len(after) > 4000:
            continue
        own, edited, other = (brute_filters(x.encode(), bits) for x in (t, rarity.edit(t, after), after))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (as_hex(own), as_hex(edited))
        assert math.isclose(got[i].near_edited, brute_likeness(own, edited), abs_tol=1e-9) and math.isclose(got[i].near_next, brute_likeness(own, other), abs_tol=1e-9)


def test_fingerprints_of_short_texts(spark):
    rng = random.Random(6)
    texts = [words(rng, n) for n in (2, 3, 4, 5, 7, 9, 12, 20, 40, 60, 100) for _ in range(6)]
    got = rarity.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    assert (got.near_edited > 0.25).mean() > 0.95 and (got.near_edited > got.near_next).mean() > 0.95


def test_partitions_of_one_id(spark):
    """Rows without an id, a third of all, are dealt over several partitions, and each row meets the next one."""
    rows = [(None if i % 3 == 0 else i, f"text {i} " + "x" * 50) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    parts = rarity.beside_next(docs, bucket_bytes=3000).rdd.glom().collect()
    assert max(len(p) for p in parts) < 100
    th = {t: h for t, h in docs.select("text", F.xxhash64("text")).collect()}
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), th[r[1]]))
    flat = [p for p in parts if p]
    assert [tuple(r)[:2] for p in flat for r in p if not r.guest] == want
    assert all(p[-1].guest and tuple(p[-1])[:2] == tuple(q[0])[:2] for p, q in zip(flat, flat[1:] + flat[:1]))


def test_pieces_equal_the_library(rows):
    path = model_path()
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(path)
    odd = ["  a  b ", "a\n\tb", " ", "▁x ▁", "<s>hi</s><0x0A> <unk>", "é \xa0x​z", "a\x00b", "﻿x", "ab" * 700, " " * 70 + "y", "y ", "12345 67!!"]
    texts = [t or "" for _, t in rows] + odd
    texts += ["the" * 3000 + "x" * 5000 + "Donaudampfschifffahrt" * 200, "ab" * 129 + " " + "9" * 300]
    written = list(own.encoded(texts))
    for t, x, back in zip(texts, written, own.decoded([pieces.parsed(x) for x in written]), strict=True):
        ids = [int(i) for i in x.split(",")] if x else []
        assert ids == lib.encode(t) and back.decode() == lib.decode(ids) == own.decode(ids)
    rng = random.Random(8)
    for _ in range(300):
        ids = [rng.randrange(len(own.piece)) if rng.random() < 0.8 else rng.choice(list(own.bytes_of)) for _ in range(rng.randint(0, 12))]
        ids = [i for i in ids if i not in own.special]
        assert own.decode(ids) == lib.decode(ids), ids


def test_pieces_where_a_merge_makes_a_better_pair(rows):
    """With every rank taken for unsafe, one pair a round, the ids are the same."""
    own, slow = pieces.Pieces(model_path()), pieces.Pieces(model_path())
    slow.safe[:] = False
    texts = [t or "" for _, t in rows if len(t or "") < 3000]
    assert list(own.encoded(texts)) == list(slow.encoded(texts))


def test_decoding_reads_the_ids(spark):
    docs, path = spark.createDataFrame([(1, "hello world")], "doc_id long, text string"), model_path()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert pieces.digest(docs, path).head().decoded_sha256 == sha("hello world")
    model = pieces.Pieces(path)
    ids = np.array(model.encode("hello world"))
    ids[0] = model.encode("other")[0]
    assert model.decoded([ids])[0] != b"hello world"


def test_pieces_round_trip(docs, rows, empty, doubled):
    path = model_path()
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, path), path).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert pieces.digest(empty, path).count() == 0 and pieces.digest(doubled, path).count() == doubled.count()
    assert pieces.tokenized(docs, path).where("n_tokens <> size(ids)").count() == 0


def test_automaton_finds_what_edit_distance_says():
    def distance(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    stems = ["moron", "moral", "idiot", "stupid"]
    trie = toxicity.Trie(stems)
    for w in ["moron", "moran", "mron", "omron", "mmoron", "idoit", "stupd", "stoopid", "xxxxx", "", "morl"]:
        assert sorted(trie.near(w)) == sorted(s for s in stems if distance(s, w) <= 1)
    for w in ["idoits", "morronic", "stupids", "sstupides", "moralss", "xx"]:
        assert sorted(trie.near(w, 1, 2)) == sorted(s for s in stems if min(distance(s, w[: len(w) - k]) for k in range(3)) <= 1)


def test_no_word_near_a_stem_is_passed_over():
    """What the lexicon looks at before it asks the automaton loses nothing."""
    rng = random.Random(2)
    stems = ["idiot", "worthless", "clown", "scumbag"]
    lexicon = toxicity.Lexicon(dict.fromkeys(stems, 3.0), dict.fromkeys(stems, 2.0))
    for _ in range(4000):
        w = list(rng.choice(stems))
        i = rng.randrange(len(w))
        edit = rng.randrange(4)
        if edit == 0:
            w[i] = rng.choice("abcdxyz")
        elif edit == 1:
            w.insert(i, rng.choice("abcdxyz"))
        elif edit == 2:
            del w[i]
        elif i:
            w[i - 1], w[i] = w[i], w[i - 1]
        word = "".join(w) + rng.choice(["", "s", "es"])
        assert lexicon.look_up(word)[0] or not lexicon.long.near(word, 1, toxicity.ENDING), word
        assert lexicon.look_up(word)[0] or len(word) < 4, word


def test_toxicity(spark, empty):
    rng = np.random.default_rng(2)
    vocab = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = list(rng.choice(vocab, 40))
        if bad:
            for b in ("zorvak", "quibble"):
                w.insert(int(rng.integers(0, 40)), b + rng.choice(["", ".", "s"]))
        rows.append((i, " ".join(w), "x"))
        labels.append((i, 1, int(bad)))
    rows += [(1000, "zorvk", "x"), (1001, None, "x"), (1002, "", "x"), (1003, " ".join(["z0rvak", "qu1bble", "zorvakk", *vocab[:20]]), "x")]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, y string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.digest(docs, lab).join(lab, "doc_id", "left").toPandas()
    held = got[got.held_out & got.toxic.notna()]
    assert ((held.predicted == 1) == (held.toxic == 1)).mean() > 0.97
    by = got.set_index("doc_id")
    assert by.predicted[1003] == 1 and by.predicted[1001] == by.predicted[1002] == 0 and 0 <= by.score[1001] <= 1
    model = toxicity.train(docs, lab)
    for glued in ("zorvak" + "x" * 70, "zorvak" * 4000, "zorvaks", "zrovaks"):
        assert model.score(f"you {glued} quibble there") > model.score("you there") + 0.3
    assert toxicity.digest(docs.unionByName(docs).unionByName(docs.limit(3).selectExpr("CAST(NULL AS long) AS doc_id", "text", "y")), lab).where("score IS NULL OR held_out IS NULL").count() == 0
    assert model.score("he said “zorvak” to them") < model.score("you zorvak there")
    assert toxicity.digest(empty, lab).count() == 0
    assert toxicity.digest(docs, lab.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns


def test_held_out_rows(spark):
    import zlib

    df = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", toxicity.held_out().alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in df.collect())
