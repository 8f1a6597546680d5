import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, spans string, d string, row long, g string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, shared passages and lines, nulls, empty and long ones."""
    rng = random.Random(5)
    passage, lines = words(rng, 90), "\n".join(words(rng, 9) for _ in range(8))
    out = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "one two"), (5, "ha ha " * 150), (6, "x" * 1300)]
    for i in range(7, 60):
        out.append((i, words(rng, rng.randint(1, 200))))
    out += [(60 + i, f"{words(rng, 30)} {passage} {words(rng, 20)}") for i in range(6)]
    out += [(70 + i, f"{words(rng, 12)}\n{lines}\n{words(rng, 12)}") for i in range(4)]
    base = words(rng, 400)
    out += [(80, base), (81, base), (82, base + " tail"), (83, base.replace(" ", "  ", 3)), (84, words(rng, 6000)), (85, "日本語 テキスト 😀 " * 40)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with further columns whose names operators use inside."""
    full = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), i, "x", "y", 1, "z") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def doubled(spark, docs):
    """Every row twice, and rows without an id."""
    return docs.unionByName(docs).unionByName(docs.limit(9).selectExpr("CAST(NULL AS long) AS doc_id", *[c for c in docs.columns if c != "doc_id"]))
