"""The pipeline's near-duplicate stage against brute force over all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest
from ledgerloom.llm import common, components, similar
from ledgerloom.llm.components import local_roots

from llm.conftest import words


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = words(rng, 1) + "x"
    return " ".join(w)


def test_edited_copies_go_and_others_stay(spark):
    rng = random.Random(11)
    texts = [None, "", " \n", "one two", "one two", "One  Two"]
    for _ in range(60):
        base = words(rng, rng.randint(60, 300))
        texts += [base, *(edited(rng, base, n) for n in (1, 2, 4, 8, 12))]
    cluster = words(rng, 400)
    texts += [edited(rng, cluster, 3) for _ in range(40)]
    sets = [shingles(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if alike(sets[a], sets[b]) >= 0.8]
    apart = sum(0.3 < alike(sets[a], sets[b]) < 0.8 for a in range(len(texts)) for b in range(a))
    assert len(pairs) > 200 and apart > 200
    root = local_roots(len(texts), *np.array(pairs).T)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(root.tolist()))


def test_odd_tables(empty, doubled, rows):
    assert similar.one_of_each(empty).count() == 0
    got = similar.one_of_each(doubled)
    assert got.where("doc_id IS NULL").count() == 0 and got.count() == got.select("doc_id").distinct().count()
    assert got.where("text IS NULL OR trim(text) = ''").count() <= 1


def test_buckets_that_are_too_large_are_dealt_over_several_tasks(spark):
    """A group of copies that fills a bucket: those near beyond doubt go first, and the components stay the same."""
    rng = random.Random(12)
    base, other = words(rng, 400), words(rng, 300)
    texts = [edited(rng, base, 1) for _ in range(150)] + [edited(rng, other, 2) for _ in range(30)] + [words(rng, 80) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = []
    for rows in (16384, 20):
        got = similar.linked(docs, "doc_id", "text", 5, 0.8, bucket_rows=rows).toPandas()
        found.append({frozenset(g.doc_id) for _, g in got.groupby("root")})
    assert found[0] == found[1] == {frozenset(range(150)), frozenset(range(150, 180)), *(frozenset([i]) for i in range(180, 240))}


def test_forest_is_spanning_and_least():
    rng = np.random.default_rng(5)
    i, j, d = rng.integers(0, 60, 400), rng.integers(0, 60, 400), rng.integers(0, 9, 400)
    f = similar._forest(60, i, j, d)
    assert (local_roots(60, i[f], j[f]) == local_roots(60, i, j)).all() and len(f) == 60 - len(set(local_roots(60, i, j)))
    for most in range(9):  # so also among the edges of any length and less
        few, own = d <= most, f[d[f] <= most]
        assert (local_roots(60, i[own], j[own]) == local_roots(60, i[few], j[few])).all()


def test_pairs_meet_with_the_promised_probability():
    rng = np.random.default_rng(6)
    tries, met, met_all = similar.Tries(231_000, 0.8, 0.99), 0, 0
    for _ in range(300):
        base = rng.integers(0, 2**63, 360, dtype=np.uint64)
        twin = np.concatenate([base[:320], rng.integers(0, 2**63, 40, dtype=np.uint64)])
        wide = np.array([similar.wide_fingerprint(np.sort(x)) for x in (base, twin)])
        bucket, below = tries.deal(wide)
        met += any(b[0] == b[1] and bin(int(e[0] ^ e[1]) & (2**64 - 1)).count("1") <= similar.ERRORS for b, e in zip(bucket, below, strict=True))
        met_all += int(np.bitwise_count(wide[0] ^ wide[1]).sum()) <= tries.most
    assert met >= 0.97 * 300 and met_all >= 0.98 * 300


@pytest.mark.parametrize("bucket_rows", [16384, 40])
def test_no_link_is_lost_in_a_group_that_is_barely_alike(spark, bucket_rows):
    """Most near pairs of a bucket aren't similar enough, so forests of the nearest leave out many that are."""
    rng = random.Random(1)
    base = words(rng, 200)
    texts = [edited(rng, base, rng.choice([3, 4, 5])) for _ in range(150)]
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(150) for b in range(a) if alike(sets[a], sets[b]) >= 0.8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    root = {r.doc_id: r.root for r in similar.linked(docs, "doc_id", "text", 5, 0.8, bucket_rows=bucket_rows).collect()}
    true = local_roots(150, *np.array(links).T)
    assert links and all((root[a] == root[b]) == (true[a] == true[b]) for a in range(150) for b in range(a))


@pytest.mark.parametrize("limits", [{}, {"bucket_rows": 70, "cell_grams": 6000}])
def test_rows_grow_with_the_group_and_not_with_its_pairs(spark, monkeypatch, limits):
    """A group that is barely alike has very many candidates; no table is made of them, and no link is lost."""
    rng, n, made = random.Random(2), 300, []

    def counted(df):
        made.append((out := common.cut(df)).count())
        return out

    for module in (similar, components):
        monkeypatch.setattr(module, "cut", counted)
    base = words(rng, 200)
    texts = [edited(rng, base, rng.choice([3, 4, 5, 6])) for _ in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    root = {r.doc_id: r.root for r in similar.linked(docs, "doc_id", "text", 5, 0.8, **limits).collect()}
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(n) for b in range(a) if alike(sets[a], sets[b]) >= 0.8]
    true = local_roots(n, *np.array(links).T)
    assert 10 < len(set(true.tolist())) < n and all((root[a] == root[b]) == (true[a] == true[b]) for a in range(n) for b in range(a))
    assert max(made) <= similar.FORESTS * similar.Tries(n, 0.8, 0.99).tables * n < n * (n - 1) / 5


def test_pairs_join_only_what_is_similar_and_apart():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(40) < 0.93], rng.integers(0, 2**63, 2, dtype=np.uint64)])) for _ in range(60)]
    root = np.where(np.arange(60) < 20, 7, np.arange(60) + 100)
    i, j = np.triu_indices(60, 1)
    o = rng.permutation(len(i))
    got = np.array(list(similar._joining(sets, root, iter([(i[o[:900]], j[o[:900]]), (i[o[900:]], j[o[900:]])]), 0.8)))
    like = np.array([similar.jaccard(sets[a], sets[b]) >= 0.8 for a, b in zip(i, j, strict=True)])
    known = np.column_stack([np.zeros(20, int), np.arange(20)])
    want = local_roots(60, *np.concatenate([known, np.column_stack([i[like], j[like]])]).T)
    assert 0 < len(got) < 60 and all(similar.jaccard(sets[a], sets[b]) >= 0.8 for a, b in got)
    assert (local_roots(60, *np.concatenate([known, got]).T) == want).all() and len(got) == 41 - len(set(want.tolist()))
