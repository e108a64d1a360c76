"""Radix selection and sketches against sorting."""

import math
import random
import struct

from pyspark.sql import functions as F

from basewise.llm.percentiles import DIGITS, exact_percentiles, from_ordered_bits, merge_sketches, ordered_bits, sketch_percentiles, sketches

SPECIAL = [0.0, -0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, 1.0, math.nextafter(1, 0), math.nextafter(2, 0), 2.0, math.nextafter(2, 3), 0.1, 1e-300, 3.5, 2.0**-1022, 2.0**1023]


def bits(x):
    k = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -k if x < 0 else k


def test_bits_keep_order_and_come_back(spark):
    rnd = random.Random(1)
    xs = SPECIAL + [rnd.uniform(-1, 1) * 10 ** rnd.randint(-320, 308) for _ in range(2000)] + [2.0**e for e in range(-1074, 1024, 7)]
    xs += [-x for x in xs]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ordered_bits(F.col("x")).alias("k"))
    for r in df.select("x", "k", from_ordered_bits(F.col("k")).alias("y")).collect():
        assert r["k"] == bits(r["x"]) and r["y"] == r["x"]


def nearest(values, q):
    s = sorted(values)
    return s[max(math.ceil(q * len(s)), 1) - 1]


def test_percentiles(spark):
    rnd = random.Random(2)
    rows = []
    for g in (1, 2, None):
        for day in range(3):
            for _ in range(400):
                rows.append((g, day, rnd.choice([None, float("nan"), float("inf"), -float("inf"), -3.0, 0.0, 7.0, rnd.lognormvariate(0, 3), rnd.lognormvariate(0, 3)]), rnd.gauss(0, 1), "clash"))
    rows += [(5, 0, None, -1.0, "x"), (6, 0, 4.0, None, "x")]
    df = spark.createDataFrame(rows, "g int, day int, a double, b double, metric_name string")
    qs = [0.01, 0.25, 0.5, 0.99, 1.0]
    for negative in (True, False):
        want = {}
        for g in (1, 2, None, 5, 6):
            for m, i in (("a", 2), ("b", 3)):
                v = [r[i] for r in rows if r[0] == g and r[i] is not None and math.isfinite(r[i]) and (negative or r[i] >= 0)]
                if v:
                    want |= {(g, m, q): (len(v), nearest(v, q)) for q in qs}
        got = {(r["g"], r["metric"], r["q"]): (r["n_values"], r["value"]) for r in exact_percentiles(df, ["g"], ["a", "b"], qs, negative).collect()}
        assert got == want
        daily = sketches(df, ["g", "day"], ["a", "b"], negative=negative)
        merged = merge_sketches(daily, ["g"])
        assert sorted(map(repr, merged.collect())) == sorted(map(repr, sketches(df, ["g"], ["a", "b"], negative=negative).collect()))
        error = 2.0 ** (12 - DIGITS[0])
        for r in sketch_percentiles(merged, ["g"], qs).collect():
            n, x = want[r["g"], r["metric"], r["q"]]
            assert r["n_values"] == n and abs(x - r["low"]) <= error * abs(x) * (1 + error) + 1e-300
    assert exact_percentiles(df.where("false"), ["g"], ["a"], [0.5]).count() == 0
