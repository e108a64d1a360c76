"""Simulated reads around known events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def reads(events: DataFrame, genome: DataFrame, per_event: int, noise: float, model: np.ndarray, seed: int = 1000) -> DataFrame:
    """``cond_id, chrom, pos, strand``: ``per_event`` reads for each event, a share ``noise`` of them anywhere on the chromosome.

    Distances are drawn from the cumulated ``model`` (2 strands, distances) by its index in a
    sorted array. Draws are hashes of event, read number and ``seed``, so they don't depend on
    the partitioning. Reads beyond the chromosome's ends are left out.
    """
    cum = np.cumsum(model.ravel() / model.sum())
    n, reach = model.shape[1], model.shape[1] // 2
    e = events.join(genome, "chrom").withColumn("_read", F.explode(F.sequence(F.lit(0), F.lit(per_event - 1))))
    u = lambda salt: F.pmod(F.xxhash64("cond_id", "chrom", "point", "_read", F.lit(seed), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    e = e.withColumn("_u", u(1))

    @F.pandas_udf(T.IntegerType())
    def step(u: pd.Series) -> pd.Series:
        # place in the cumulated model: the number of steps at or below u
        return pd.Series(np.searchsorted(cum[:-1], u.to_numpy(), "right").astype(np.int32))

    e = e.withColumn("_k", step("_u"))
    distance = F.col("_k") % n - reach
    strand = F.when(F.col("_k") >= n, "-").otherwise("+")
    flipped = F.col("point_strand") == "-"
    pos = F.when(u(2) < noise, F.floor(u(3) * F.col("len")) + 1).otherwise(F.col("point") + F.when(flipped, -distance).otherwise(distance))
    strand = F.when(flipped, F.translate(strand, "+-", "-+")).otherwise(strand)
    return e.select("cond_id", "chrom", pos.cast("bigint").alias("pos"), strand.alias("strand"), "len").where("pos between 1 and len").drop("len")


def base_counts(reads: DataFrame) -> DataFrame:
    """``cond_id, chrom, pos, strand, cnt``."""
    return reads.groupBy("cond_id", "chrom", "pos", "strand").agg(F.count("*").cast("double").alias("cnt"))
