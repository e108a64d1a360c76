"""Pieces of oversized regions against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from basewise.llm import pieces as module
from basewise.llm.pieces import DEFAULT_LIMIT, LEVELS, oversized, pieces, separators


def brute_gaps(start, end, hits, least):
    inside = sorted({h for h in hits if start <= h <= end})
    return [(a + 1, b - 1) for a, b in zip(inside, inside[1:]) if b - a - 1 >= least]


def brute_pieces(start, end, limit, overlap, hits):
    """The recursion as words: at each step the last separator of the highest level within reach."""
    gaps, out, s = brute_gaps(start, end, hits, 1), [], start
    while end - s + 1 > limit:
        reach, best = s + limit - 1, None
        for name, width in LEVELS:
            ends = [(min(b, reach), name) for a, b in gaps if b - a + 1 >= width and a - 1 <= reach and min(b, reach) >= s + overlap]
            if ends:
                best = max(ends)
                break
        e, name = best or (reach, "base")
        out.append((s, e, name))
        s = e + 1 - overlap
    return [*out, (s, end, "end")]


@pytest.mark.parametrize("broadcast_rows,tile", [(200_000, 1 << 16), (0, 2500), (200_000, 5000)])
def test_pieces(spark, monkeypatch, broadcast_rows, tile):
    monkeypatch.setattr(module, "SPLIT_TILE", tile)
    rnd = random.Random(3)
    regions, hits = [], []
    for i in range(40):
        run = rnd.choice([1, 2, 3, 9])
        start = rnd.randint(1, 50_000)
        regions.append((i, run, "1", start, start + rnd.choice([10, 1999, 2000, 2500, 9000, 30_000])))
        p = start
        while p < start + 30_000:
            p += rnd.choice([1, 1, 1, 2, 30, 150, 1500] if i % 8 else [1, 9000])
            hits.append((run, "1", p))
    hits += hits[:500] + [(None, "1", 5), (1, None, 5), (1, "1", None)]
    runs = [(1, 2000, 100), (2, None, None), (3, 0, -5), (4, 50, 60)]
    r = spark.createDataFrame(regions, "region_id bigint, run_id int, chrom string, rstart bigint, rend bigint")
    h = spark.createDataFrame(hits, "run_id int, chrom string, pos int")
    big = oversized(r, spark.createDataFrame(runs, "run_id int, bm_analysis_window_max int, piece_overlap int"))
    cfg = {1: (2000, 100)}
    want_p, want_g = set(), set()
    for i, run, _, a, b in regions:
        limit, overlap = cfg.get(run, (DEFAULT_LIMIT, 0))
        if b - a + 1 > limit:
            mine = [p for q, c, p in hits if q == run and c == "1" and p is not None]
            want_p |= {(i, k, *x) for k, x in enumerate(brute_pieces(a, b, limit, overlap, mine))}
            want_g |= {(i, *g) for g in brute_gaps(a, b, mine, 100)}
    got = {tuple(x) for x in separators(big, h, 100, broadcast_rows).collect()}
    assert got == want_g
    rows = pieces(big, h, broadcast_rows).collect()
    got = [tuple(x)[:5] for x in rows]
    assert len(got) == len(set(got)) and set(got) == want_p
    # each separator of a paragraph or section belongs to one piece, the first that holds the base before it
    assert sorted((x["region_id"], b) for x in rows for b in x["boundaries"]) == sorted((i, a) for i, a, _ in want_g)
    assert all(x["piece_start"] <= b - 1 <= x["piece_end"] for x in rows for b in x["boundaries"])


def test_limits(spark):
    """Null, zero and unknown runs have the default limit; the overlap stays below the limit."""
    r = spark.createDataFrame([(1, 1, "1", 1, 3000), (2, None, "1", 1, 2000), (3, 4, "1", 1, 200)], "region_id bigint, run_id int, chrom string, rstart bigint, rend bigint")
    runs = spark.createDataFrame([(1, None, None), (4, 50, 60)], "run_id int, bm_analysis_window_max int, piece_overlap int")
    got = {x["region_id"]: (x["size_limit"], x["overlap"]) for x in oversized(r, runs).collect()}
    assert got == {1: (2000, 0), 3: (50, 49)}
    none = spark.createDataFrame([], "run_id int, chrom string, pos int")
    p = pieces(oversized(r, runs), none).where("region_id = 1").orderBy("piece").collect()
    assert [(x["piece_start"], x["piece_end"], x["cut"]) for x in p] == [(1, 2000, "base"), (2001, 3000, "end")]
    assert pieces(oversized(r.where("false"), runs), none).count() == 0


def test_small_steps_over_many_tiles(spark, monkeypatch):
    """An overlap of one base less than the limit moves one base at least; no state is lost between tiles or parts of them."""
    monkeypatch.setattr(module, "SPLIT_TILE", 64)
    monkeypatch.setattr(module, "MADE", 100)
    rnd = random.Random(9)
    hits = sorted({rnd.randint(1, 900) for _ in range(120)})
    regions = [(1, 1, "1", 5, 800, 40, 39), (2, 1, "1", 1, 900, 100, 0), (3, 1, "1", 100, 170, 7, 3)]
    big = spark.createDataFrame(regions, "region_id bigint, run_id int, chrom string, rstart bigint, rend bigint, size_limit bigint, overlap bigint")
    h = spark.createDataFrame([(1, "1", p) for p in hits], "run_id int, chrom string, pos int")
    want = {(i, k, *x) for i, _, _, a, z, limit, overlap in regions for k, x in enumerate(brute_pieces(a, z, limit, overlap, hits))}
    got = [tuple(x)[:5] for x in pieces(big, h).collect()]
    assert len(got) == len(set(got)) and set(got) == want
