"""The best rows of each group against sorting."""

import random

import pytest

from basewise.llm.topn import top_rows


@pytest.mark.parametrize("n", [1, 3, 50])
def test_top(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.choice([1, 1, 1, 1, 2, None]) if i % 50 else i, rnd.choice([None, 0.0, 0.5, 0.25, float("nan"), rnd.random()]), rnd.choice([None, 1.0, 2.0]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, p double, hits double, id bigint").repartition(7)
    got = {(r["g"], r["id"], r["place"]) for r in top_rows(df, ["g"], {"p": True, "hits": False, "id": True}, n, "place").collect()}
    key = lambda r: (r[1] is None, r[1] != r[1], r[1] if r[1] is not None and r[1] == r[1] else 0, r[2] is None, -(r[2] or 0), r[3])
    want = set()
    for g in {r[0] for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=key)[:n], 1):
            want.add((g, r[3], k))
    assert got == want


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, 1.0, 5)] * 10, "g int, p double, id bigint")
    assert [r["rank"] for r in top_rows(df, ["g"], {"p": True, "id": True}, 3).orderBy("rank").collect()] == [1, 2, 3]
    assert top_rows(df.where("false"), ["g"], {"p": True}, 3).count() == 0
    with pytest.raises(ValueError):
        top_rows(df.withColumnRenamed("p", "rank"), ["g"], {"rank": True}, 3)
