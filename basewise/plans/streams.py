"""Streaming counts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basewise.plans.sql_views import HITS
from basewise.sources.tables import table
from basewise.streaming.counts import append, binned, stream_hits


def stream_binned_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by bin of what a stream over ``base_counts`` has brought so far."""
    stream = stream_hits(spark, f"{folder}/base_counts.parque[t]", table(spark, folder, "base_counts").schema)
    return binned(spark.read.parquet(append(stream)))


QUERIES = {"stream_binned_counts": stream_binned_counts}
SQL = {
    "stream_binned_counts": f"WITH {HITS} SELECT rep_id, chrom, CAST(floor((pos - 1) / 25.0) AS BIGINT) AS bin, sum(cnt) AS hits FROM hits WHERE channel = 'signal' GROUP BY ALL"
}
