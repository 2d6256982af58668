"""Ranges: where they cut, and which range a key is in."""

import random

import pytest
from pyspark.sql import functions as F

from blotter.llm import ranges


def order(key):
    return [(k is not None, k or 0) for k in key]


def plain_cuts(rows, step):
    """First keys with a further multiple of the step below them."""
    out, below, last, before = [], 0, None, 0
    for *key, n in sorted(rows, key=lambda r: order(r[:-1])):
        if key != last:
            if below // step != before // step:
                out.append(key)
            before = below
        last, below = key, below + n
    return out


def table(seed, n=900):
    rng = random.Random(seed)
    a = [None, 0, -5, 3, 10 ** 15, -(1 << 63), (1 << 63) - 1, 7, 8]
    rows = [(rng.choice(a), rng.choice([None, 0, 1, rng.randrange(1 << 40)]), rng.randrange(1, 90)) for _ in range(n)]
    return rows + [(7, 7, 40)] * 200 + [(5, 5, 5000), (6, None, 12000)]


@pytest.mark.parametrize("seed,step", [(0, 1000), (1, 300), (2, 10 ** 9), (3, 7000), (4, 1)])
def test_exact_cuts(spark, seed, step):
    rows = table(seed)
    df = spark.createDataFrame(rows, "a long, b long, n long")
    got = [ranges.exact_cuts(df.repartition(p), ["a", "b"], "n", step) for p in (1, 5)]
    assert got[0] == got[1] == plain_cuts(rows, step)


def test_ranges_hold_their_rows(spark):
    rows = table(9)
    df = spark.createDataFrame(rows, "a long, b long, n long")
    for cuts in (ranges.cut_keys(df, ["a", "b"], "n", 2000), ranges.exact_cuts(df, ["a", "b"], "n", 2000)):
        assert len(cuts) > 10
        for r in df.select("*", ranges.range_of(cuts, "a", "b").alias("at")).collect():
            assert r.at == sum(order(c) <= order((r.a, r.b)) for c in cuts)
    big = df.select(ranges.range_of(cuts, "a", "b").alias("at"), "n").groupBy("at").agg(F.sum("n").alias("n")).collect()
    assert max(r.n for r in big) <= 2000 + 12000


def test_no_rows(spark):
    df = spark.createDataFrame([], "a long, n long")
    assert ranges.cut_keys(df, ["a"], "n", 10) == [] == ranges.exact_cuts(df, ["a"], "n", 10)
