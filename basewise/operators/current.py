"""The latest version of each keyed row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str = "loaded_at") -> DataFrame:
    """One row for each value of ``keys``: the one with the largest ``order``.

    A null ``order`` is older than any other. Exact duplicates count once; among different
    rows of one ``order`` the greatest tuple of ``columns`` is kept, so the result doesn't
    depend on the partitioning. A null key is a key like any other. The maximum is combined
    within each input partition before the shuffle, so a key with a third of all rows sends
    one row from each partition. Other columns of ``df`` are dropped.
    """
    rest = [c for c in dict.fromkeys([order, *columns]) if c not in keys]
    latest = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_latest"))
    return latest.select(*keys, *[F.col(f"_latest.{c}").alias(c) for c in rest])
