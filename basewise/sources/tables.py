"""Tables of a data folder, with chromosome names in one spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewise.functions.genome import plain_chrom
from basewise.operators.current import current_rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def genome(spark: SparkSession, folder: str) -> DataFrame:
    """``chrom, len``: the largest length given for each chromosome."""
    g = table(spark, folder, "genome_info")
    return g.groupBy(plain_chrom("chrom").alias("chrom")).agg(F.max("len").alias("len"))


def replicate_runs(spark: SparkSession, folder: str) -> DataFrame:
    """``rep_id, run_id, cond_id``: one row for each replicate of the design."""
    return table(spark, folder, "design").select("rep_id", "run_id", "cond_id").distinct()


def base_hits(spark: SparkSession, folder: str, channel: str | None = "signal") -> DataFrame:
    """``rep_id, channel, chrom, pos, strand, cnt``: one row for each base with a count above 0.

    Exact duplicates count once. Null, NaN, zero and negative counts are no hits.
    """
    b = table(spark, folder, "base_counts")
    if channel is not None:
        b = b.where(F.col("channel") == channel)
    return (
        b.where((F.col("cnt") > 0) & ~F.isnan("cnt"))
        .select("rep_id", "channel", plain_chrom("chrom").alias("chrom"), "pos", "strand", F.col("cnt").cast("double").alias("cnt"))
        .distinct()
    )


def current_regions(spark: SparkSession, folder: str, placed: bool = True) -> DataFrame:
    """``region_id, run_id, chrom, rstart, rend`` of current rows with both ends, in order; unless ``placed``, those without a chromosome too."""
    r = current_rows(
        table(spark, folder, "test_regions"), ["region_id"], ["run_id", "chrom", "rstart", "rend"]
    ).where("region_id is not null and rstart is not null and rend is not null")
    if placed:
        r = r.where("chrom is not null")
    return r.select(
        "region_id",
        "run_id",
        plain_chrom("chrom").alias("chrom"),
        F.least("rstart", "rend").cast("bigint").alias("rstart"),
        F.greatest("rstart", "rend").cast("bigint").alias("rend"),
    )


def current_events(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Current rows of ``event_cond``: ``event_id, cond_id, loaded_at`` and ``columns``."""
    return current_rows(table(spark, folder, "event_cond"), ["event_id", "cond_id"], list(columns))
