"""Running totals and places within keys, of which a few may hold most of the rows.

A window over a whole key orders all its rows in one task. Here rows are cut into ranges of
about equal size over the keys and the order, ties included; a range is ordered by itself and
the totals of the ranges before it, a few numbers, are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewise.session import cut_lineage


def in_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``_range``, a number that grows with the order within each key. Written once, so a lost executor doesn't move the bounds."""
    return cut_lineage(rows.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()))


def running_totals(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, Column], totals: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with, for each of ``sums``, its total over this row and those of the key before it in ``order``.

    ``order`` must tell all rows of a key apart, or equal ones be interchangeable. ``totals``
    names columns for the sums over the whole key. Null keys are keys like any other. The
    column ``_range`` of the result grows with the order.
    """
    held = in_ranges(rows.withColumns({f"_s_{n}": c for n, c in sums.items()}), keys, order)
    parts = held.groupBy(*keys, "_range").agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums])
    key = Window.partitionBy(*keys)
    before = key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    given = {f"_b_{n}": F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)) for n in sums} | {name: F.sum(f"_t_{n}").over(key) for n, name in (totals or {}).items()}
    parts = parts.withColumns(given).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_k_range"), *given)
    inner = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = held.withColumns({f"_r_{n}": F.sum(f"_s_{n}").over(inner) for n in sums})
    on = [held[k].eqNullSafe(parts[f"_k_{k}"]) for k in keys] + [held["_range"] == parts["_k_range"]]
    joined = held.join(parts, on)
    return joined.select(*rows.columns, *[(F.col(f"_b_{n}") + F.col(f"_r_{n}")).alias(n) for n in sums], *(totals or {}).values(), "_range")


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with their place within their key, from 1."""
    return running_totals(rows, keys, order, {name: F.lit(1)}).withColumn(name, F.col(name).cast("int")).drop("_range")
