"""One row of each component stays, also where ids are null or repeat."""

from ledgerloom.llm import simhash


def test_each_component_keeps_one_row(spark):
    texts = [f"{w} speaks of quite other things than anybody else does {w} {w}" for w in ("anna", "bert", "carl", "dora", "emil", "fritz")]
    fps = [simhash.fingerprint(t) for t in texts]
    assert min((a ^ b).bit_count() for i, a in enumerate(fps) for b in fps[:i]) > 2
    a, b, c, d, e, f = texts
    # two texts under one id; two unrelated rows without an id; a copy without an id of a row that has one; a row twice
    rows = [(1, a), (1, b), (None, c), (None, d), (None, a), (7, e), (7, e), (9, e), (None, f), (None, f)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, a), (1, b), (None, c), (None, d), (7, e), (None, f)], key=repr)
