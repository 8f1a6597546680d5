"""Equal texts share a shard however many rows have copies; where rows lie has no effect."""

import pytest

from ledgerloom.llm import sharding


def test_shards_do_not_depend_on_partitions(spark, docs, doubled):
    def of(table):
        return sorted((repr(tuple(r)) for r in sharding.shards(table).select("doc_id", "text_crc32", "shard", "slot").collect()))

    for table in (docs, doubled):
        assert of(table.repartition(7)) == of(table.coalesce(1).orderBy("text", "doc_id"))


@pytest.mark.parametrize(("linked", "size"), [(1.0, 10), (0.95, 10), (0.95, 2)])
def test_groups_stay_together_where_most_rows_have_copies(spark, linked, size):
    n = 3200
    texts = [f"group {i // size}" if i < linked * n else f"own {i}" for i in range(n)]
    got = sharding.shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    assert got.groupby("shard").size().tolist() == [n // 16] * 16
    shards = got.groupby(got.doc_id.map(dict(enumerate(texts)))).shard.nunique()
    assert (shards > 1).sum() <= 15 and shards.max() <= 2


def fewest_split(groups, caps):
    """By trying all placements: the least number of groups that can't be whole."""
    best = [len(groups)]

    def place(i, room, split):
        if split >= best[0]:
            return
        if i == len(groups):
            best[0] = split
            return
        for r in {r for r in room if r >= groups[i]}:
            at = room.index(r)
            place(i + 1, (*room[:at], r - groups[i], *room[at + 1:]), split)
        left, after = groups[i], []
        for r in sorted(room, reverse=True):  # split over the roomiest
            after.append(r - min(r, left))
            left -= min(r, left)
        place(i + 1, tuple(after), split + 1)

    place(0, tuple(caps), 0)
    return best[0]


@pytest.mark.parametrize("sizes", [[5, 4, 3, 3, 3, 2, 2, 2], [6, 6, 6, 6], [9, 2, 2, 2, 2, 2, 2, 2, 1], [4] * 6])
def test_splits_are_near_the_fewest(spark, sizes):
    """Against all placements of a few groups on four shards: at most one group more for each end of a shard."""
    texts = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)]
    got = sharding.shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n_shards=4).toPandas()
    counts = got.groupby("shard").size().reindex(range(4), fill_value=0)
    assert counts.max() - counts.min() <= 1
    split = (got.groupby(got.doc_id.map(dict(enumerate(texts)))).shard.nunique() > 1).sum()
    assert split <= fewest_split(sorted(sizes, reverse=True), [len(texts) // 4 + (s < len(texts) % 4) for s in range(4)]) + 3
