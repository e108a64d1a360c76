"""Mixture models, rounds of fitting, clusters and simulated reads. SQL can't say these; tests hold them against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basewise.operators import clustering as cl
from basewise.operators import mixture as mx
from basewise.operators import reports as rp
from basewise.operators import significance as sg
from basewise.operators import simulate
from basewise.operators.ordered import numbered
from basewise.operators.profiles import composite
from basewise.plans.profiles import label_means, m25_best_shift, points, stranded
from basewise.plans.regions import e06_noise_shares, m02_alphas
from basewise.plans.sequences import e13_motif_offsets
from basewise.session import cut_lineage
from basewise.sources.tables import base_hits, current_regions, genome, replicate_runs


#: two subtypes, narrow and wide, each as given and as its reverse complement
SUBTYPES = mx.with_reverse(np.concatenate([mx.normal_model(8, 15), mx.normal_model(30, 30)]))


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    return base_hits(spark, folder, None).join(replicate_runs(spark, folder), "rep_id").select("run_id", "cond_id", "channel", "chrom", "pos", "strand", "cnt")


def _counts(spark: SparkSession, folder: str, hits: DataFrame | None = None) -> DataFrame:
    """Counts of the parts of current regions with the share of noise of their region and condition (``e06``); ``hits`` are the written ones if they are at hand. Regions, parts and shares are written once, as each is counted before it is broadcast."""
    hits = cut_lineage(_hits(spark, folder)) if hits is None else hits
    regions = cut_lineage(current_regions(spark, folder))
    shares = cut_lineage(e06_noise_shares(spark, folder, hits.where("channel = 'signal'"), regions))
    return mx.region_counts(hits, cut_lineage(mx.bounded_parts(regions, hits)), shares)


def e01_components(spark: SparkSession, folder: str) -> DataFrame:
    """Components of each part and condition under one unstranded model."""
    return mx.fit_regions(_counts(spark, folder), mx.normal_model(), alpha=3.0, together=True).drop("tau", "form", "places")


def e02_subtypes(spark: SparkSession, folder: str) -> DataFrame:
    """Components with two subtypes, narrow and wide, each in both orientations."""
    return mx.fit_regions(_counts(spark, folder), SUBTYPES, alpha=3.0, together=True).drop("places")


def e03_subtypes_assigned(spark: SparkSession, folder: str, hits: DataFrame | None = None) -> DataFrame:
    """Signal and control counts of the components of ``e02`` by maximum likelihood, places and tau held; ``hits`` are the written ones if they are at hand."""
    return mx.fit_regions(_counts(spark, folder, hits), SUBTYPES, alpha=3.0, together=True, assigned=True)


def a14_read_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of each replicate around the components of ``e02`` that belong to them."""
    counts = cut_lineage(_counts(spark, folder))
    hits = base_hits(spark, folder).join(replicate_runs(spark, folder), "rep_id")
    profiles = mx.read_profiles(hits, counts, cut_lineage(mx.fit_regions(counts, SUBTYPES, alpha=3.0)), SUBTYPES)
    return profiles.withColumn("value", F.round("value", 6))


def _reported_subtypes(spark: SparkSession, folder: str) -> DataFrame:
    """Components of ``e03`` with their test against the control, those with a q-value of at most 0.01."""
    signal, control = (cut_lineage(base_hits(spark, folder, c).join(replicate_runs(spark, folder), "rep_id")) for c in ("signal", "control"))
    total = signal.groupBy("cond_id").agg(F.sum("cnt").alias("total"))
    share = 50.0 / genome(spark, folder).agg(F.sum("len").cast("double")).scalar()
    e = e03_subtypes_assigned(spark, folder, signal.unionByName(control)).join(F.broadcast(total), "cond_id").withColumn("_share", share)
    # written, as ranks by ranges look at their rows twice, and each time is a fit
    e = cut_lineage(e.withColumn("p", sg.p_value(F.col("sig"), F.col("ctrl"), F.col("total"), F.col("_share"))).drop("total", "_share"))
    return sg.benjamini_hochberg(e, ["cond_id"], "p", "sig", ["region_id", "part", "component"]).where("q <= 0.01")


def k06_subtype_table(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each reported event: counts, fold, q and for each subtype and strand its point and tau."""
    e = _reported_subtypes(spark, folder)
    cells = []
    for k in range(len(SUBTYPES)):
        name = f"subtype{k // 2}{'+-'[k % 2]}"
        cells += [F.get("places", F.lit(k)).alias(f"{name}_point"), F.round(F.get("tau", F.lit(k)), 2).alias(f"{name}_tau")]
    fold = F.when(F.col("ctrl") > 1, F.col("sig") / F.col("ctrl")).otherwise(F.col("sig"))
    return e.select(
        "region_id", "part", "cond_id", "component", "chrom", "position", F.round("sig", 1).alias("sig"), F.round("ctrl", 1).alias("ctrl"),
        rp.log2_column(fold).alias("log2_fold"), rp.log2_column(F.col("q")).alias("log2_q"), *cells,
    )


def k04_subtype_events(spark: SparkSession, folder: str) -> DataFrame:
    """Reported events with the point, tau and name of their dominant subtype over types and strands (P05), and by strands together (P06)."""
    tau = F.col("_tau")
    t, strand, share = rp.dominant_form(tau)
    both, both_strand, both_share = rp.dominant_type(tau)
    return _reported_subtypes(spark, folder).withColumnRenamed("tau", "_tau").select(
        "region_id", "part", "cond_id", "component", "chrom", F.get("places", F.array_position(tau, F.array_max(tau)).cast("int") - 1).alias("point"), strand.alias("strand"), t.alias("subtype"),
        F.round(share, 2).alias("tau"), both.alias("summed_subtype"), both_strand.alias("summed_strand"), F.round(both_share, 2).alias("summed_tau"), "plus", "minus",
    )


def k07_aligned_events(spark: SparkSession, folder: str) -> DataFrame:
    """Dominant points of reported events moved and turned by the motif of their subtype: the motifs of ``e13`` in order, one for each subtype."""
    e = k04_subtype_events(spark, folder).select("region_id", "part", "cond_id", "component", "chrom", "point", "strand", "subtype")
    # one row for each length of motif; subtypes beyond them have none and stay where they are
    motifs = e13_motif_offsets(spark, folder).withColumn("subtype", F.row_number().over(Window.orderBy("motif")) - 1)
    j = e.join(F.broadcast(motifs.select("subtype", "offset", "reverse")), "subtype", "left")
    pos, strand = rp.aligned_point(F.col("point"), F.col("strand"), F.coalesce("offset", F.lit(0)), F.coalesce("reverse", F.lit(False)))
    return j.select("region_id", "part", "cond_id", "component", "chrom", pos.alias("pos"), strand.alias("strand"), F.format_string("Subtype%d", "subtype").alias("subtype"))


def e04_assigned(spark: SparkSession, folder: str) -> DataFrame:
    """Signal and control counts of the components of ``e01``."""
    return mx.fit_regions(_counts(spark, folder), mx.normal_model(), alpha=3.0, together=True, assigned=True).select("region_id", "part", "cond_id", "chrom", "component", "position", "sig", "ctrl")


def o05_component_order(spark: SparkSession, folder: str) -> DataFrame:
    """Components of ``e02`` with their places in three orders of their condition: along the genome, by their counts and by the share of their dominant form."""
    e = cut_lineage(e02_subtypes(spark, folder).select("region_id", "part", "cond_id", "component", "chrom", "position", (F.col("plus") + F.col("minus")).alias("_n"), F.array_max("tau").alias("_tau")))
    tie = [F.col(c) for c in ("chrom", "position", "region_id", "part", "component")]
    e = numbered(e, ["cond_id"], tie, "by_location")
    e = numbered(e, ["cond_id"], [F.desc("_n"), *tie], "by_counts")
    return numbered(e, ["cond_id"], [F.desc("_tau"), *tie], "by_share").drop("_n", "_tau")


def e07_rounds(spark: SparkSession, folder: str, rounds: int = 3) -> DataFrame:
    """Events after round 0 and ``rounds`` more, with the sparseness of each condition.

    Round 0 fits, assigns and tests under one unstranded model; the reads around its significant
    events give the first stranded model. Each further round fits that model and its reverse
    complement, and reads around its components of over 3 alpha, in their direction, give the
    next model. The last round is assigned by its tau and tested. The packed parts are written
    once for all rounds, and what a round finds, which the next round and its model read there.
    """
    hits = cut_lineage(_hits(spark, folder))
    signal = hits.where("channel = 'signal'").select("cond_id", "chrom", "pos", "strand", "cnt")
    alphas = cut_lineage(m02_alphas(spark, folder).select("cond_id", "alpha"))
    packed = cut_lineage(mx.packed_parts(_counts(spark, folder, hits).join(F.broadcast(alphas), "cond_id"), alpha=None, together=True))
    totals = signal.groupBy("cond_id").agg(F.sum("cnt").alias("total"))
    share = 50.0 / genome(spark, folder).agg(F.sum("len").cast("double")).scalar()

    def tested(components: DataFrame, fold: float) -> DataFrame:
        e = components.join(totals, "cond_id").withColumn("_share", F.lit(share))
        return cut_lineage(e.withColumn("p", sg.p_value(F.col("sig"), F.col("ctrl"), F.col("total"), F.col("_share"), fold)).drop("_share", "total", "tau", "places"))

    events = tested(mx.fit_regions(packed, mx.normal_model(), alpha=None, assigned=True), 1.2 if rounds else 1.5)
    near = events.where("p <= 0.05").withColumn("strand", F.lit("+"))
    for k in range(rounds):
        at = near.select("cond_id", "chrom", F.col("position").alias("point"), F.col("strand").alias("point_strand"))
        model = mx.with_reverse(mx.model_from_profile(composite(signal, at, ["cond_id"])))
        last = k + 1 == rounds
        components = mx.fit_regions(packed, model, alpha=None, assigned=last)
        if last:
            events = tested(components, 1.5)
        else:
            near = cut_lineage(components).join(alphas, "cond_id").where("plus + minus > 3 * alpha").withColumn("strand", F.when(F.col("form") % 2 == 1, "-").otherwise("+"))
    return sg.benjamini_hochberg(events, ["cond_id"], "p", "sig", ["region_id", "part", "component"])


def e08_exemplars(spark: SparkSession, folder: str) -> DataFrame:
    """Affinity propagation over the 500 profiles with the highest peak; every profile has the exemplar nearest to it, with its shift and orientation."""
    s = stranded(spark, folder).withColumn("peak", F.array_max("profile"))
    return cl.cluster(s, "peak")


def j16_members(spark: SparkSession, folder: str) -> DataFrame:
    """Members of each exemplar and the mean of their profiles, each moved by its shift and turned as it fits (P11)."""
    m = cl.aligned(stranded(spark, folder), e08_exemplars(spark, folder))
    return m.groupBy("exemplar", "place").agg(F.avg("value").alias("value"), F.count("*").alias("members"))


def k12_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Each exemplar with its members, those turned, the range of their shifts and those of another label than its own."""
    s = stranded(spark, folder).select("vec_id", "label")
    m = e08_exemplars(spark, folder).join(s, "vec_id").join(s.select(F.col("vec_id").alias("exemplar"), F.col("label").alias("_own")), "exemplar")
    return m.groupBy("exemplar").agg(
        F.count("*").alias("members"), F.count_if("reverse").alias("turned"), F.min("shift").alias("least_shift"), F.max("shift").alias("most_shift"),
        F.count_if(~F.col("label").eqNullSafe(F.col("_own"))).alias("other_label"),
    )


def k23_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """How often each shift and orientation is the best of a pair (M25)."""
    return m25_best_shift(spark, folder).groupBy("shift", "reverse").agg(F.count("*").alias("pairs"))


def e12_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Labels whose mean profiles are alike, the closest first, merged into the larger; log divergence below -10."""
    s = stranded(spark, folder)
    sizes = s.groupBy(F.col("label").alias("model")).agg(F.count("*").alias("size"))
    return cl.merge_models(label_means(s), cut_lineage(sizes)).select(F.col("model").alias("label"), "merged_into")


def e14_k_means(spark: SparkSession, folder: str) -> DataFrame:
    return cl.k_means(stranded(spark, folder))


def m27_alignments(spark: SparkSession, folder: str) -> DataFrame:
    return cl.align(stranded(spark, folder))


def s21_simulated_reads(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts of reads drawn around the significant events of each condition, 20 each, with 10 % noise on their chromosome."""
    return simulate.base_counts(simulate.reads(points(spark, folder), genome(spark, folder), 20, 0.1, mx.normal_model(15, 20)[0]))


QUERIES = {
    f.__name__: f
    for f in (
        e01_components, e02_subtypes, e03_subtypes_assigned, e04_assigned, a14_read_profiles, k04_subtype_events, k06_subtype_table, k07_aligned_events, o05_component_order, e07_rounds, e08_exemplars, j16_members, k12_clusters, k23_offsets,
        e12_merged, e14_k_means, m27_alignments, s21_simulated_reads,
    )
}
SQL: dict[str, str] = {}
