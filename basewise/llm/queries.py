"""Queries of the training-data operators, by name: (spark, folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basewise.functions.genome import plain_chrom
from basewise.llm import bpe, leaks, lookalike, percentiles, pieces, topn
from basewise.sources.tables import current_events, current_regions, replicate_runs, table

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.9, 0.99)
METRICS = ("cond_sig_hits", "cond_sig_v_ctrl_fold")


def _oversized(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.oversized(current_regions(spark, folder, placed=False), table(spark, folder, "run_config"))


def _run_hits(spark: SparkSession, folder: str) -> DataFrame:
    """``run_id, chrom, pos`` of signal hits, repeated where replicates or strands share a base."""
    b = table(spark, folder, "base_counts").where((F.col("channel") == "signal") & (F.col("cnt") > 0) & ~F.isnan("cnt"))
    runs = replicate_runs(spark, folder).select("rep_id", "run_id").distinct()
    return b.select("rep_id", plain_chrom("chrom").alias("chrom"), "pos").join(runs, "rep_id").select("run_id", "chrom", "pos")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The paragraph and section separators of the pieces of each region; 0 for a region whose pieces have none."""
    p = pieces.pieces(_oversized(spark, folder), _run_hits(spark, folder))
    # a region's first piece stands for it if none of its pieces has a separator
    each = p.select("region_id", "piece", F.explode_outer("boundaries").alias("gap_start")).where("gap_start is not null or piece = 0")
    has = F.max(F.col("gap_start")).over(Window.partitionBy("region_id"))
    return each.withColumn("_has", has).where("gap_start is not null or _has is null").select("region_id", F.coalesce("gap_start", F.lit(0)).alias("gap_start"))


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.pieces(_oversized(spark, folder), _run_hits(spark, folder)).drop("boundaries")


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    events = current_events(spark, folder, *METRICS)
    return percentiles.exact_percentiles(events, ["cond_id"], METRICS, QUANTILES, negative=False)


def p4_daily(spark: SparkSession, folder: str) -> DataFrame:
    events = current_events(spark, folder, *METRICS).withColumn("day", F.to_date("loaded_at"))
    return percentiles.sketches(events, ["cond_id", "day"], METRICS, negative=False)


def p4_combined(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.sketch_percentiles(percentiles.merge_sketches(p4_daily(spark, folder), ["cond_id"]), ["cond_id"], QUANTILES)


def _ranked_events(spark: SparkSession, folder: str) -> DataFrame:
    p, hits = F.col("cond_sig_v_ctrl_p"), F.col("cond_sig_hits")
    e = current_events(spark, folder, "region_id", "cond_sig_v_ctrl_p", "cond_sig_hits")
    e = e.where(F.col("region_id").isNotNull() & p.between(0, 1))
    return e.select("cond_id", "region_id", "event_id", p.alias("p"), F.when((hits >= 0) & ~F.isnan(hits), hits).alias("hits"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    order = {"p": True, "hits": False, "event_id": True}
    return topn.top_rows(_ranked_events(spark, folder), ["cond_id", "region_id"], order, 3).select("cond_id", "region_id", "event_id")


def p5_by_region(spark: SparkSession, folder: str) -> DataFrame:
    order = {"p": True, "hits": False, "event_id": True, "cond_id": True}
    return topn.top_rows(_ranked_events(spark, folder), ["region_id"], order, 10).select("region_id", "rank", "cond_id", "event_id")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_texts(table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_passages(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, folder, "documents"), leaks.item_words(table(spark, folder, "eval_items")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, folder, "documents"))


def p8_texts(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.canonical_texts(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p4_percentiles, p4_daily, p4_combined, p5_found, p5_by_region, p6_ids, p7_found, p7_passages, p8_found, p8_texts)
}
