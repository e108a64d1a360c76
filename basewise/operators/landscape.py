"""Sliding-window coverage and enriched regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewise.functions.stats import poisson_threshold
from basewise.operators.intervals import merge_overlapping, points_in_intervals

#: width and step of the sliding bins in bases
WINDOW, STEP = 50, 25


def bin_range(pos: Column, window: int = WINDOW, step: int = STEP) -> tuple[Column, Column]:
    """First and last sliding bin that a 1-based position counts for. Division truncates toward 0."""
    off = pos - 1
    first = F.greatest(((off - window // 2) / step).cast("int"), F.lit(0))
    return first, (off / step).cast("int")


def hit_landscape(hits: DataFrame, keys: Sequence[str], window: int = WINDOW, step: int = STEP, strand: str | None = None) -> DataFrame:
    """``keys, chrom, bin, hits``: the sum of counts in each sliding bin that holds any.

    Counts are summed by base first where a base repeats in the keys, so each base expands
    into bins once; both sums combine before they move.
    """
    h = hits if strand is None else hits.where(F.col("strand") == strand)
    first, last = bin_range(F.col("pos"), window, step)
    return h.select(*keys, "chrom", "cnt", F.explode(F.sequence(first, last)).alias("bin")).groupBy(*keys, "chrom", "bin").agg(F.sum("cnt").alias("hits"))


def binned_starts(hits: DataFrame, keys: Sequence[str], width: int = STEP) -> DataFrame:
    """``keys, chrom, bin, hits``: counts in bins that don't overlap."""
    return hits.groupBy(*keys, "chrom", F.floor((F.col("pos") - 1) / width).alias("bin")).agg(F.sum("cnt").alias("hits"))


def scan_thresholds(hits: DataFrame, keys: Sequence[str], genome: DataFrame, log_conf: float = -6.0, window: int = WINDOW, mappable: float = 0.8) -> DataFrame:
    """``keys, reads, mean, threshold``: the least count of a window that a uniform background would rarely reach."""
    total = genome.agg(F.sum("len")).scalar()
    reads = hits.groupBy(*keys).agg(F.sum("cnt").alias("reads"))
    reads = reads.withColumn("mean", F.col("reads") * window / (total * mappable))
    return reads.withColumn("threshold", poisson_threshold(F.col("mean"), log_conf))


def potential_regions(landscape: DataFrame, thresholds: DataFrame, genome: DataFrame, keys: Sequence[str], window: int = WINDOW, step: int = STEP) -> DataFrame:
    """``keys, chrom, rstart, rend, n``: islands of bins at or over the threshold, widened by a window on each side and clipped to the chromosome."""
    passing = landscape.join(thresholds.select(*keys, "threshold"), list(keys)).where("hits >= threshold").join(genome, "chrom")
    i = F.col("bin").cast("bigint") * step + 1
    wide = passing.select(*keys, "chrom", F.greatest(i - window, F.lit(1)).alias("rstart"), F.least(i - 1 + window, F.col("len")).alias("rend"))
    return merge_overlapping(wide, [*keys, "chrom"], repeated=False)


def counts_in_and_out(hits: DataFrame, regions: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``by, inside, outside``: counts of hits in any region of their ``keys`` and outside all. Regions are disjoint."""
    marked = points_in_intervals(hits, regions.select(*keys, "chrom", F.col("rstart").alias("_rs"), F.col("rend").alias("_re")), [*keys, "chrom"], start="_rs", end="_re", how="left")
    isin = F.col("_rs").isNotNull()
    return marked.groupBy(*by).agg(
        F.sum(F.when(isin, F.col("cnt")).otherwise(0.0)).alias("inside"), F.sum(F.when(isin, 0.0).otherwise(F.col("cnt"))).alias("outside")
    )


def split_long(regions: DataFrame, landscape: DataFrame, keys: Sequence[str], longest: int = 2000, step: int = STEP) -> DataFrame:
    """``keys, chrom, rstart, rend, part``: regions wider than 1.5 times ``longest`` cut at their emptiest bins.

    From the start of what remains, a cut goes to the bin with the fewest hits within half of
    ``longest`` of its end, the first such; a remainder under 1.5 times ``longest`` stays
    whole. Each region is one group of the bins with hits in it, which its width bounds.
    """
    import numpy as np
    import pandas as pd

    names = [*keys, "chrom"]
    r = regions.select(*names, "rstart", "rend")
    wide = r.where(F.col("rend") - F.col("rstart") + 1 >= 1.5 * longest)
    bins = landscape.select(*names, (F.col("bin").cast("bigint") * step + 1).alias("at"), "hits")
    held = points_in_intervals(bins, wide, names, pos="at", how="inner")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        start, end = int(pdf.rstart.iloc[0]), int(pdf.rend.iloc[0])
        level = np.zeros((end - start) // step + 2)
        np.add.at(level, (pdf["at"].to_numpy() - start) // step, pdf.hits.to_numpy())
        ends, s = [], start
        while end - s + 1 >= 1.5 * longest:
            lo, hi = (s + longest // 2 - start) // step, (s + longest + longest // 2 - start) // step
            s = start + (lo + int(np.argmin(level[lo : hi + 1]))) * step
            ends.append(s)
        cuts = [start, *ends, end + 1]
        out = pd.DataFrame({"rstart": cuts[:-1], "rend": [c - 1 for c in cuts[1:]], "part": range(len(cuts) - 1)})
        for c in names:
            out[c] = pdf[c].iloc[0]
        return out

    kinds = dict(r.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", rstart bigint, rend bigint, part int"
    parts = held.groupBy(*names, "rstart", "rend").applyInPandas(cut, schema)
    whole = r.where(F.col("rend") - F.col("rstart") + 1 < 1.5 * longest).withColumn("part", F.lit(0))
    return parts.select(*names, "rstart", "rend", "part").unionByName(whole)


def with_neighbours(rows: DataFrame, keys: Sequence[str], pos: str = "pos", tile: int = 1 << 16) -> DataFrame:
    """``rows`` with ``before`` and ``after``: the nearest other row's ``pos`` on each side among equal ``keys``; null at the ends.

    A row at the same position is a neighbour at distance 0. Rows are ordered tile by tile and
    only the first and last position of each tile are ordered over the whole key, so one
    crowded chromosome is spread over its tiles.
    """
    t = rows.withColumn("_tile", F.floor(F.col(pos) / tile))
    edges = t.groupBy(*keys, "_tile").agg(F.min(pos).alias("_first"), F.max(pos).alias("_last"))
    w = Window.partitionBy(*keys).orderBy("_tile")
    edges = edges.select(*keys, "_tile", F.lag("_last").over(w).alias("_left"), F.lead("_first").over(w).alias("_right"))
    inner = Window.partitionBy(*keys, "_tile").orderBy(pos)
    t = t.withColumn("before", F.lag(pos).over(inner)).withColumn("after", F.lead(pos).over(inner))
    j = t.join(edges, [*keys, "_tile"])
    return j.withColumn("before", F.coalesce("before", "_left")).withColumn("after", F.coalesce("after", "_right")).select(*rows.columns, "before", "after")


def nearest_places(rows: DataFrame, places: DataFrame, keys: Sequence[str], pos: str = "pos", place: str = "place", tile: int = 1 << 16) -> DataFrame:
    """``rows`` with ``distance`` to the nearest ``place`` of equal ``keys``; null where there is none.

    Rows and places are ordered together tile by tile; only the first and last place of each
    tile are carried over the whole key.
    """
    p = places.where(F.col(place).isNotNull()).select(*keys, F.col(place).cast("bigint").alias(pos), F.col(place).cast("bigint").alias("_place")).distinct()
    both = rows.withColumn(pos, F.col(pos).cast("bigint")).withColumn("_row", F.lit(True)).unionByName(p, allowMissingColumns=True).withColumn("_tile", F.floor(F.col(pos) / tile))
    # frames begin at the first row in either direction, so each is kept up row by row
    w, back = Window.partitionBy(*keys).orderBy("_tile"), Window.partitionBy(*keys).orderBy(F.desc("_tile"))
    edges = both.groupBy(*keys, "_tile").agg(F.min("_place").alias("_first"), F.max("_place").alias("_last")).select(
        *keys,
        "_tile",
        F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_left"),
        F.last("_first", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("_right"),
    )
    inner = Window.partitionBy(*keys, "_tile")
    up, down = (inner.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.col(pos), F.col(pos).desc()))
    both = both.withColumn("_b", F.max("_place").over(up)).withColumn("_a", F.min("_place").over(down))
    j = both.where("_row").join(edges, [*keys, "_tile"])
    distance = F.least(F.col(pos) - F.coalesce("_b", "_left"), F.coalesce("_a", "_right") - F.col(pos))
    return j.select(*rows.columns, distance.alias("distance"))
