"""Running totals, running maxima and islands against loops, with hot keys, ties and nulls."""

import random

from pyspark.sql import functions as F

from basewise.operators import intervals as iv
from basewise.operators.ordered import numbered, running_totals


def test_running_totals(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 1, 1, 1, 2, None]), rnd.choice([0.5, 0.5, 0.5, rnd.random()]), i, rnd.randint(0, 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, p double, id int, n int")
    order = [F.col("p").desc(), F.col("id")]
    got = {r["id"]: (r["upto"], r["all"], r["rows"]) for r in running_totals(df.repartition(5), ["k"], order, {"upto": F.col("n"), "rows": F.lit(1)}, {"upto": "all"}).collect()}
    want = {}
    for k in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))
        total = 0
        for place, r in enumerate(mine):
            total += r[3]
            want[r[2]] = (total, sum(x[3] for x in mine), place + 1)
    assert got == want
    got = {r["id"]: r["place"] for r in numbered(df, ["k"], order, "place").collect()}
    assert got == {i: w[2] for i, w in want.items()}
    assert running_totals(df.where("false"), ["k"], order, {"upto": F.col("n")}).count() == 0
    whole = {r["id"]: r["upto"] for r in running_totals(df, [], [F.col("id")], {"upto": F.lit(1)}).collect()}
    assert whole == {i: i + 1 for i in range(2000)}


def test_islands_over_many_tiles(spark, monkeypatch):
    rnd = random.Random(2)
    monkeypatch.setattr(iv, "TILE", 64)
    rows = []
    for c in "ab":
        for _ in range(300):
            s = rnd.randint(1, 3000)
            rows.append((c, s, s + rnd.choice([0, 1, 5, 5, 200])))
        rows += [(c, 700, 710)] * 50
    rows += [(None, 1, 2), ("a", None, 5), ("b", 5, None)]
    df = spark.createDataFrame(rows, "chrom string, rstart bigint, rend bigint")
    for touching in (0, 1, 7):
        want = []
        for c in "ab":
            for s, e in sorted(r[1:] for r in rows if r[0] == c and None not in r):
                if want and want[-1][0] == c and s <= want[-1][2] + touching:
                    want[-1] = (c, want[-1][1], max(want[-1][2], e), want[-1][3] + 1)
                else:
                    want.append((c, s, e, 1))
        assert sorted(map(tuple, iv.merge_overlapping(df, touching=touching).select("chrom", "rstart", "rend", "n").collect())) == want
    genome = spark.createDataFrame([("a", 5000), ("b", 3100), ("c", 10)], "chrom string, len bigint")
    held = {(c, p) for c, s, e in rows if None not in (c, s, e) for p in range(s, e + 1)}
    gaps = iv.complement(df.where("chrom is not null and rstart is not null and rend is not null"), genome).collect()
    free = [(r["chrom"], p) for r in gaps for p in range(r["gap_start"], r["gap_end"] + 1)]
    assert len(free) == len(set(free)) and set(free) == {(c, p) for c, n in (("a", 5000), ("b", 3100), ("c", 10)) for p in range(1, n + 1)} - held


def test_running_max(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), p, rnd.randint(0, 10_000)) for p in rnd.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "k string, p int, v int")
    for before in (False, True):
        got = {(r["k"], r["p"]): r["m"] for r in iv.running_max(df, ["k"], ["p"], F.col("v"), "m", before, tile=128).collect()}
        for k, p, v in rows:
            over = [x for j, q, x in rows if j == k and (q < p or q == p and not before)]
            assert got[(k, p)] == (max(over) if over else None)
