import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.operators import flame, pricing, ranking

PRICED = [
    ("claude-sonnet-4-5-20250929", 3.0), ("anthropic/claude-sonnet-4-5", 3.0), ("us.anthropic.claude-opus-4-1@20250805", 15.0), (" CLAUDE-OPUS-4 ", 15.0),
    ("claude-opus-4-9", None), ("claude-opus-5-0", None), ("claude-fable-6", None), ("<synthetic>", None), ("gpt-yolo", None), (None, None),
]


def test_prices(spark):
    rows = spark.createDataFrame([(m,) for m, _ in PRICED], "model string")
    got = {r.model: r.p for r in pricing.with_prices(rows, pricing.price_table(spark)).select("model", F.col("price.input").cast("double").alias("p")).collect()}
    assert got == dict(PRICED)


def test_overrides_come_first(spark):
    rows = spark.createDataFrame([("claude-sonnet-4-5-20250929",), ("anthropic/x",)], "model string")
    over = {"Claude-Sonnet-4": (9.0,) * 5, " claude-sonnet-4-5 ": (7.0,) * 5, "anthropic/x": (1.0,) * 5}
    got = {r.model: r.p for r in pricing.with_prices(rows, pricing.price_table(spark, over)).select("model", F.col("price.input").cast("double").alias("p")).collect()}
    assert got == {"claude-sonnet-4-5-20250929": 7.0, "anthropic/x": None}


@pytest.mark.parametrize(("text", "want"), [("\n  \n  hello  \nx", "hello"), ("", None), (None, None), (" \t\r\n ", None), ("x" * 100, "x" * 80), ("a\r\nb", "a")])
def test_snippet(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(F.expr(X.snippet_sql("t"))).head()[0] == want


def test_less_keeps_unknown(spark):
    rows = spark.createDataFrame([(5, 3), (3, 5), (None, 5), (5, None)], "a long, b long")
    assert [r[0] for r in rows.select(F.expr(X.less_sql("a", "b"))).collect()] == [2, 0, None, 5]


def test_folded_line(spark):
    df = spark.createDataFrame([(["a;b", "c d"], 5)], "f array<string>, v long")
    assert df.select(flame.folded_line(F.col("f"), F.col("v"))).head()[0] == "a:b;c_d 5"


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 60), min_size=0, max_size=60))
def test_head_sums_against_sorting(spark, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long")
    got = {r.fraction: (r.requests, r.s) for r in ranking.head_sums(rows, "v", [F.desc("v"), F.asc("id")], len(values), {"s": "v"}).collect()}
    ordered = sorted(values, reverse=True)
    import math

    want = {f: (k := min(max(math.ceil(f * len(values)), 1), len(values)), sum(ordered[:k])) for f in ranking.FRACTIONS} if values else {}
    assert got == want


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 400), min_size=0, max_size=60))
def test_bursts_against_a_loop(spark, seconds):
    base = dt.datetime(2026, 1, 1)
    rows = spark.createDataFrame([("k", base + dt.timedelta(seconds=s)) for s in seconds], "k string, ts timestamp")
    got = sorted((r.requests, r.span_seconds) for r in ranking.bursts(rows, ["k"], "ts", 15, 5).collect())
    want, run = [], []
    for s in [*sorted(seconds), 10**9]:
        if run and s - run[-1] > 15:
            if len(run) >= 5:
                want.append((len(run), run[-1] - run[0]))
            run = []
        run.append(s)
    assert got == sorted(want)
