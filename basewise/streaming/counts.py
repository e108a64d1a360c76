"""Counts by bin over a stream of new base counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewise.functions.genome import plain_chrom
from basewise.session import new_path


def stream_hits(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A streaming table ``rep_id, chrom, pos, strand, cnt`` of the signal counts above 0 in the parquet files that arrive under ``path``."""
    b = spark.readStream.schema(schema).parquet(path).where((F.col("channel") == "signal") & (F.col("cnt") > 0) & ~F.isnan("cnt"))
    return b.select("rep_id", plain_chrom("chrom").alias("chrom"), "pos", "strand", F.col("cnt").cast("double").alias("cnt"))


def append(stream: DataFrame) -> str:
    """Take what has arrived and add it to a table of the shared folder, which keeps what a repeated row is told by; the path of that table.

    Nothing is held in the state of the stream. Each batch writes its own folder, so a batch
    that is run again leaves one copy and none is written twice.
    """
    out = new_path(stream.sparkSession, "stream")

    def save(batch: DataFrame, number: int) -> None:
        batch.distinct().write.mode("overwrite").parquet(f"{out}/hits/batch={number}")

    q = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{out}/hits"


def binned(hits: DataFrame, width: int = 25) -> DataFrame:
    """``rep_id, chrom, bin, hits`` of the table of ``append``; rows repeated within or over batches count once."""
    each = hits.select("rep_id", "chrom", "pos", "strand", "cnt").distinct()
    return each.groupBy("rep_id", "chrom", F.floor((F.col("pos") - 1) / width).alias("bin")).agg(F.sum("cnt").alias("hits"))
