"""Runs of lines that repeat, found without chunks()."""

import random

from ledgerloom.llm import line_dedup

from llm.conftest import words


def again(lines, seen, n=6):
    """Which lines lie in a window of ``n`` lines that occurred before."""
    hit = [False] * len(lines)
    for i in range(len(lines) - n + 1):
        w = tuple(lines[i:i + n])
        if w in seen:
            hit[i:i + n] = [True] * n
        seen.add(w)
    return hit


def test_runs_of_few_different_lines_go(spark):
    rng = random.Random(9)
    rows, repeated = [], {}
    for i in range(60):
        few = [words(rng, 3) for _ in range(1 + i % 3)]
        run = few * (60 // len(few)) if i % 2 else [rng.choice(few[:2]) for _ in range(60)]
        lines = [words(rng, 6) for _ in range(3)] + run + [words(rng, 6) for _ in range(3)]
        rows.append((i, "\n".join(lines)))
        repeated[i] = sum(again(lines, set()))
    got = {r.doc_id: r for r in line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    periodic = [i for i in repeated if i % 2 or i % 3 == 0]
    assert all(got[i].n_removed >= 0.8 * repeated[i] > 20 for i in periodic)
    assert sum(got[i].n_removed for i in got) >= 0.8 * sum(repeated.values())
    assert all(got[i].n_lines - got[i].n_removed >= 7 for i in got)  # lines that don't repeat, and one of the others


def test_no_chunk_is_too_long():
    rng = random.Random(3)
    for text in ("a\n" * 500, "a\nb\n" * 300, "".join(f"{rng.random()}\n" for _ in range(2000)), "a\nb\nc\nd\ne\nf\ng\nh\ni\nj\n" * 90):
        cuts = list(line_dedup.chunks(text.encode()))
        assert max(n for _, _, n in cuts) <= 16 and sum(n for _, _, n in cuts) == text.count("\n")
        assert [b for _, b, _ in cuts[:-1]] == [a for a, _, _ in cuts[1:]]


def test_blocks_fall_into_step_wherever_they_stand(spark):
    """A block of lines put into many texts after other numbers of lines: most of it goes everywhere but in the first text."""
    rng = random.Random(21)
    block = [words(rng, 7) for _ in range(24)]
    rows, where = [], {}
    for i in range(40):
        head, tail = [[words(rng, 7) for _ in range(rng.randint(0, 9))] for _ in "ht"]
        rows.append((i, "\n".join([*head, *block, *tail])))
        where[i] = len(head) + len(tail)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0 and got[0].kept == rows[0][1]
    assert all(0.6 * 24 <= got[i].n_removed <= 24 for i in range(1, 40))
    for i in range(1, 40):  # what stays is the text without some lines of the block, in order
        left = got[i].kept.split("\n")
        own = [x for x in rows[i][1].split("\n") if x not in block]
        assert [x for x in left if x not in block and x] == [x for x in own if x]
