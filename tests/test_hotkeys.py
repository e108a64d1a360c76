"""Sums by interval against a loop, on both of its ways."""

import random

import pytest

from basewise.operators.current import current_rows
from basewise.operators.hotkeys import heavy_intervals, sums_by_interval


def data(n=3000):
    rnd = random.Random(5)
    rows = []
    for _ in range(n):
        chrom = rnd.choice(["1", "1", "1", "2", None])
        pos = rnd.choice([100, 101, rnd.randint(1, 20000), None])
        rows.append((chrom, pos, rnd.choice([None, 1.0, 2.5, 10.0])))
    ivs = [(1, "1", 100, 100), (2, "1", 101, 5000), (3, "1", 5001, 9000), (4, "2", 1, 4095), (5, "2", 4096, 8191), (6, "3", 1, 9), (7, None, 1, 9), (8, "1", None, 5)]
    return rows, ivs


@pytest.mark.parametrize("limit", [200_000, 0])
def test_sums(spark, limit):
    rows, ivs = data()
    df = spark.createDataFrame(rows, "chrom string, pos bigint, value double")
    iv = spark.createDataFrame(ivs, "ignore_id bigint, chrom string, xstart int, xend int")
    got = {r["ignore_id"]: (r["n_rows"], r["total"]) for r in sums_by_interval(df, iv, limit=limit).collect()}
    want = {}
    for c, p, v in rows:
        i = next((i for i, ic, a, b in ivs if c is not None and ic == c and p is not None and a is not None and a <= p <= b), None)
        n, t = want.get(i, (0, 0.0))
        want[i] = (n + 1, t + (v or 0))
    assert got == want
    heavy = {r[0] for r in heavy_intervals(sums_by_interval(df, iv, limit=limit), "ignore_id", 0.02).collect()}
    assert heavy == {i for i, (n, _) in want.items() if i is not None and n >= 0.02 * len(rows)}


def test_empty(spark):
    df = spark.createDataFrame([], "chrom string, pos bigint, value double")
    iv = spark.createDataFrame([], "ignore_id bigint, chrom string, xstart int, xend int")
    assert sums_by_interval(df, iv).count() == 0


def test_current_rows(spark):
    rows = [(1, 1, 5, "a"), (1, 1, 6, "b"), (1, 1, 6, "b"), (1, 1, None, "z"), (None, 1, 1, "n"), (None, 1, None, "m"), (2, 1, 6, "a"), (2, 1, 6, "c")]
    df = spark.createDataFrame(rows, "k int, j int, loaded_at int, v string")
    got = {(r["k"], r["v"]) for r in current_rows(df, ["k", "j"], ["v"]).collect()}
    assert got == {(1, "b"), (None, "n"), (2, "c")}
