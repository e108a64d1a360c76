"""Joins of points and intervals by bins, and set operations on intervals.

Coordinates are 1-based and closed. A range predicate alone would make Spark compare all
pairs; here both sides are keyed by (chromosome, bin), so the join is an equi-join with the
range as a residual condition.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewise.session import cut_lineage

#: An interval side of at most so many binned rows is broadcast; it is counted first.
BROADCAST_ROWS = 200_000


def with_bins(intervals: DataFrame, start: Column | str, end: Column | str, width: int, name: str = "_bin") -> DataFrame:
    """One row for each bin of ``width`` bases that an interval touches. Null or reversed bounds give none."""
    s, e = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    first, last = F.floor(s / width), F.floor(e / width)
    return intervals.where(s <= e).withColumn(name, F.explode(F.sequence(first, last)))


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within ``limit``, else unchanged (a shuffled join, split by AQE)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def points_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    equal: Sequence[str] = ("chrom",),
    pos: str = "pos",
    start: str = "rstart",
    end: str = "rend",
    width: int = 4096,
    how: str = "inner",
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Pairs of a point and each interval that holds it; ``how`` is ``inner`` or ``left`` (points without one are kept).

    Points with a null key or position are in no interval. Clashing column names other than
    ``equal`` must be resolved by the caller.
    """
    binned = small_side(with_bins(intervals, start, end, width), limit)
    p = points.withColumn("_bin", F.floor(F.col(pos) / width))
    on = [p[c] == binned[c] for c in equal] + [p["_bin"] == binned["_bin"], p[pos] >= binned[start], p[pos] <= binned[end]]
    joined = p.join(binned, on, how)
    return joined.select(*[p[c] for c in points.columns], *[binned[c] for c in intervals.columns if c not in equal])


def overlapping(left: DataFrame, right: DataFrame, start: str, end: str, rstart: str, rend: str, width: int = 4096, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs of intervals that share a base, each once: the pair is made in the first bin that both touch."""
    r = small_side(with_bins(right, rstart, rend, width), limit)
    l = with_bins(left, start, end, width)
    on = [l["chrom"] == r["chrom"], l["_bin"] == r["_bin"], l[start] <= r[rend], l[end] >= r[rstart]]
    first = F.floor(F.greatest(l[start], r[rstart]) / width) == l["_bin"]
    return l.join(r, on).where(first).select(*[l[c] for c in left.columns], *[r[c] for c in right.columns if c != "chrom"])


#: Bases of the tiles by which windows along a chromosome are taken.
TILE = 1 << 16


def running_max(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, before: bool = False, tile: int = TILE) -> DataFrame:
    """``rows`` with ``name``: the largest ``value`` of this row and those before it among equal ``keys``, or only of those ``before`` it; null where there is none.

    The first of ``order`` is a position. Rows are ordered tile by tile, and only the maximum
    of each tile is carried over the whole key, so one crowded chromosome is spread over its tiles.
    """
    t = rows.withColumn("_tile", F.floor(F.col(order[0]) / tile)).withColumn("_value", value)
    key = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    edges = t.groupBy(*keys, "_tile").agg(F.max("_value").alias("_most")).select(*keys, "_tile", F.max("_most").over(key).alias("_carried"))
    inner = Window.partitionBy(*keys, "_tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    j = t.withColumn("_inner", F.max("_value").over(inner)).join(edges, [*keys, "_tile"])
    return j.select(*rows.columns, F.greatest("_inner", "_carried").alias(name))


def merge_overlapping(intervals: DataFrame, keys: Sequence[str] = ("chrom",), start: str = "rstart", end: str = "rend", touching: int = 0, repeated: bool = True) -> DataFrame:
    """Islands of intervals that share a base; ``touching`` bases of distance still merge. ``keys, start, end, n``. Intervals with a null key or bound are in none.

    Equal intervals are counted before they move, unless the caller knows that none is
    ``repeated``, and each tile makes islands of those that begin in it. Only these are written
    and joined over tiles: an island begins where one lies behind the reach of all before it,
    and both this reach and the last beginning are running maxima.
    """
    known = [F.col(c).isNotNull() for c in (*keys, start, end)]
    each = intervals.where(functools.reduce(Column.__and__, known))
    each = each.groupBy(*keys, start, end).agg(F.count("*").alias("_n")) if repeated else each.withColumn("_n", F.lit(1).cast("bigint"))
    each = each.withColumn("_tile", F.floor(F.col(start) / TILE))
    inner = Window.partitionBy(*keys, "_tile").orderBy(start, end)
    begins = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + touching), F.col(start))
    each = each.withColumn("_reach", F.max(end).over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    each = each.withColumn("_island", F.max(begins).over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    local = cut_lineage(each.groupBy(*keys, "_tile", F.col("_island").alias("_a")).agg(F.max(end).alias("_z"), F.sum("_n").alias("_n")).drop("_tile"))
    reach = running_max(local, keys, ["_a"], F.col("_z"), "_reach", before=True)
    begins = F.when(F.col("_reach").isNull() | (F.col("_a") > F.col("_reach") + touching), F.col("_a"))
    island = running_max(reach, keys, ["_a"], begins, start)
    return island.groupBy(*keys, start).agg(F.max("_z").alias(end), F.sum("_n").alias("n"))


def complement(intervals: DataFrame, genome: DataFrame) -> DataFrame:
    """``chrom, gap_start, gap_end``: bases of the genome in no interval. Chromosomes without intervals come out whole."""
    merged = merge_overlapping(intervals.select("chrom", "rstart", "rend"), touching=1)
    # islands are apart, so the reach of those before is the end of the last
    reach = running_max(merged, ["chrom"], ["rstart"], F.col("rend"), "_before", before=True)
    before = reach.select("chrom", (F.coalesce("_before", F.lit(0)) + 1).alias("gap_start"), (F.col("rstart") - 1).alias("gap_end"))
    last = intervals.groupBy("chrom").agg(F.max("rend").alias("last"))
    after = genome.join(last, "chrom", "left").select("chrom", (F.coalesce("last", F.lit(0)) + 1).alias("gap_start"), F.col("len").alias("gap_end"))
    return before.unionByName(after).where("gap_start <= gap_end")


def subtract(intervals: DataFrame, excluded: DataFrame, id_column: str, width: int = 4096) -> DataFrame:
    """``id_column, chrom, rstart, rend``: what is left of each interval outside all ``excluded`` (``chrom, xstart, xend``)."""
    hit = overlapping(intervals.select(id_column, "chrom", "rstart", "rend"), excluded.select("chrom", "xstart", "xend"), "rstart", "rend", "xstart", "xend", width)
    islands = merge_overlapping(hit, [id_column, "chrom", "rstart", "rend"], "xstart", "xend", 1)
    reach = running_max(islands, [id_column], ["xstart"], F.col("xend"), "_before", before=True)
    before = reach.select(id_column, "chrom", F.greatest(F.coalesce(F.col("_before") + 1, F.col("rstart")), F.col("rstart")).alias("s"), (F.col("xstart") - 1).alias("e"))
    after = islands.groupBy(id_column, "chrom", "rend").agg((F.max("xend") + 1).alias("s")).select(id_column, "chrom", "s", F.col("rend").alias("e"))
    untouched = intervals.join(islands.select(id_column).distinct(), id_column, "left_anti").select(id_column, "chrom", F.col("rstart").alias("s"), F.col("rend").alias("e"))
    return before.unionByName(after).unionByName(untouched).where("s <= e").select(id_column, "chrom", F.col("s").alias("rstart"), F.col("e").alias("rend"))
