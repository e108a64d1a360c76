"""Results by key where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewise.operators.intervals import BROADCAST_ROWS, points_in_intervals, with_bins
from basewise.session import cut_lineage


def sums_by_interval(
    rows: DataFrame,
    intervals: DataFrame,
    value: str = "value",
    interval_id: str = "ignore_id",
    start: str = "xstart",
    end: str = "xend",
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """``interval_id, n_rows, total`` of ``rows`` (``chrom, pos, value``) by the interval that holds them.

    ``intervals`` are disjoint. One more row, with a null id, has the rows in no interval or
    without a point. Null values count as rows but add nothing.

    States are combined before anything moves. Rows meet the broadcast intervals where they
    are (their number is counted against ``limit`` first) and each partition's hash table then
    holds one count and one sum for each interval it saw, spilling when it must; only those
    partial states are shuffled, so a key with most of the rows costs no more than any other.
    Beyond ``limit`` rows of intervals, rows are first combined by point and only the states of
    points move to the bins.
    """
    states = rows.select("chrom", "pos", F.lit(1).cast("bigint").alias("_n"), F.col(value).alias("_v"))
    if with_bins(intervals, start, end, 4096).limit(limit + 1).count() > limit:
        states = states.groupBy("chrom", "pos").agg(F.sum("_n").alias("_n"), F.sum("_v").alias("_v"))
    placed = points_in_intervals(states, intervals.select(interval_id, "chrom", start, end), start=start, end=end, how="left", limit=limit)
    return placed.groupBy(interval_id).agg(F.sum("_n").alias("n_rows"), F.coalesce(F.sum("_v"), F.lit(0.0)).alias("total"))


def heavy_intervals(sums: DataFrame, interval_id: str, share: float) -> DataFrame:
    """The ids of ``sums_by_interval`` that hold at least ``share`` of all rows, those without an interval included in all.

    The sums, one row for each interval, are written once, so the rows behind them are added up once.
    """
    sums = cut_lineage(sums)
    all_rows = sums.agg(F.sum("n_rows")).scalar()
    return sums.where(F.col(interval_id).isNotNull() & (F.col("n_rows") >= share * all_rows)).select(interval_id)
