"""The N best rows of every group.

The N-th best row of a group within one partition is a bound: no row behind it can be among
the N best of the whole group. Each partition keeps its own N best of each group before
anything moves; the best of the bounds of a group then filters what the partitions kept, and
the survivors are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_rows(rows: DataFrame, groups: Sequence[str], order: dict[str, bool], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their ``rank`` from 1; smaller groups give all.

    ``order`` maps columns to True for ascending. They must tell all rows of a group apart for
    the tie rule to be one; nulls come last in either direction, and NaN counts as the largest
    number. Rows equal in all of ``order`` are kept in an unspecified order. Null groups are
    groups.

    A group with millions of rows sends at most ``n`` of them from each partition: the limit on
    the row number by partition and group is taken before the shuffle. The bounds come from
    the same shuffled rows; a group without a bound had fewer than ``n`` rows everywhere.
    """
    if n < 1:
        raise ValueError("n is at least 1")
    clash = {"_part", "_place", "_bound", rank} & set(rows.columns)
    if clash:
        raise ValueError(f"columns of these names stand in the way: {sorted(clash)}")
    by = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order.items()]
    local = Window.partitionBy("_part", *groups).orderBy(*by)
    kept = rows.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.row_number().over(local)).where(F.col("_place") <= n)

    # the best of the bounds: of the rows at place n of their partition, the first by the same order
    whole = Window.partitionBy(*groups).orderBy(*by)
    bounds = kept.where(F.col("_place") == n).select(*groups, *order).withColumn("_bound", F.row_number().over(whole)).where("_bound = 1")
    bounds = bounds.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], "_bound")

    # not behind the bound: equal in the first columns of the order and better, or equal in all
    not_behind = F.lit(True)
    for i, (c, up) in reversed(list(enumerate(order.items()))):
        x, b = F.col(c), F.col(f"_o{i}")
        better = x.isNotNull() & (b.isNull() | ((x < b) if up else (x > b)))
        not_behind = F.coalesce(better, F.lit(False)) | (x.eqNullSafe(b) & not_behind)
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(groups)]
    survivors = kept.join(bounds, same, "left").where(F.col("_bound").isNull() | not_behind)
    ranked = survivors.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= n)
    return ranked.select(*rows.columns, rank)
