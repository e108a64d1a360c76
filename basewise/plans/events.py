"""Counts, tests and result tables of events, with their SQL.

Two kinds of events are used: 50-base tiles of ``base_counts`` with a signal and a control
count for each replicate, and the current rows of ``event_cond``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basewise.functions.genome import counts_only, point_chrom, point_pos, point_strand
from basewise.operators import reports as rp
from basewise.operators import significance as sg
from basewise.operators.ordered import numbered
from basewise.operators.profiles import rank_percentile
from basewise.plans.regions import signal
from basewise.plans.sql_views import EVENTS, HITS, REGIONS, TILES
from basewise.session import cut_lineage
from basewise.sources.tables import base_hits, current_events, current_regions, genome, replicate_runs, table

TILE = ["chrom", "tile"]


def tiles(spark: SparkSession, folder: str) -> DataFrame:
    """``chrom, tile, cond_id, rep_id, sig, ctrl``."""
    h = base_hits(spark, folder, None).join(replicate_runs(spark, folder), "rep_id")
    side = lambda c: F.sum(F.when(F.col("channel") == c, F.col("cnt")).otherwise(0.0))
    return h.groupBy("chrom", F.floor(F.col("pos") / 50).alias("tile"), "cond_id", "rep_id").agg(side("signal").alias("sig"), side("control").alias("ctrl"))


def _totals(t: DataFrame) -> DataFrame:
    """``cond_id, rep_id, total, ctrl_total, fraction`` of ``tiles``; the fraction is that of tiles with at least 3 signal hits."""
    dense = F.sum(F.when(F.col("sig") >= 3, F.col("sig")).otherwise(0.0))
    return t.groupBy("cond_id", "rep_id").agg(F.sum("sig").alias("total"), F.sum("ctrl").alias("ctrl_total"), F.try_divide(dense, F.sum("sig")).alias("fraction"))


def a09_weights(spark: SparkSession, folder: str) -> DataFrame:
    return sg.replicate_weights(_totals(tiles(spark, folder))).select("cond_id", "rep_id", F.round("weight", 9).alias("weight"))


def m07_scaling(spark: SparkSession, folder: str) -> DataFrame:
    """Signal over control of each replicate from windows of 10,000 bases: by totals and by regression; 1 without control."""
    h = base_hits(spark, folder, None)
    side = lambda c: F.sum(F.when(F.col("channel") == c, F.col("cnt")).otherwise(0.0))
    w = h.groupBy("rep_id", "chrom", F.floor(F.col("pos") / 10_000).alias("w")).agg(side("signal").alias("s"), side("control").alias("c"))
    return w.groupBy("rep_id").agg(
        F.round(F.coalesce(F.sum("s") / F.nullif(F.sum("c"), F.lit(0.0)), F.lit(1.0)), 9).alias("by_total"),
        F.round(F.coalesce(F.sum(F.col("s") * F.col("c")) / F.nullif(F.sum(F.col("c") * F.col("c")), F.lit(0.0)), F.lit(1.0)), 9).alias("by_regression"),
    )


def m07_scaling_methods(spark: SparkSession, folder: str) -> DataFrame:
    """Signal over control of each replicate with a control, by three published methods over windows of 10,000 bases, null where one has no window to tell.

    ``ncis``: of windows in order of their counts together, the totals up to the first count,
    of those with at least three quarters of all windows of the genome, at which the ratio
    stops falling. ``median``: of the windows with counts of both. ``ses``: of windows in order
    of their signal, the totals at the largest lead of the control's share over the signal's.
    """
    h = base_hits(spark, folder, None)
    side = lambda c: F.sum(F.when(F.col("channel") == c, F.col("cnt")).otherwise(0.0))
    w = h.groupBy("rep_id", "chrom", F.floor(F.col("pos") / 10_000).alias("w")).agg(side("signal").alias("s"), side("control").alias("c"))
    w = cut_lineage(w.select("rep_id", "s", "c"))
    genome_windows = genome(spark, folder).agg(F.sum(F.floor(F.col("len") / 10_000) + 1)).scalar()
    reps = w.groupBy("rep_id").agg(F.sum("s").alias("all_s"), F.sum("c").alias("all_c"), F.count("*").alias("n")).where("all_c > 0")
    ncis = sg.running_ratio(w, ["rep_id"], F.col("s") + F.col("c")).join(reps.select("rep_id", "n"), "rep_id")
    ncis = ncis.where((F.col("upto_c") > 0) & (genome_windows - F.col("n") + F.col("upto") >= 0.75 * genome_windows)).withColumn("ratio", F.col("upto_s") / F.col("upto_c"))
    stops = F.coalesce(F.col("ratio") >= F.lag("ratio").over(Window.partitionBy("rep_id").orderBy("at")), F.lit(False))
    first = F.min(F.when(F.col("stops"), F.struct("at", "ratio")))
    ncis = ncis.withColumn("stops", stops).groupBy("rep_id").agg(F.coalesce(first, F.max(F.struct("at", "ratio")))["ratio"].alias("ncis"))
    median = rank_percentile(w.where("s > 0 and c > 0").select("rep_id", (F.col("s") / F.col("c")).alias("ratio")), ["rep_id"], "ratio", 0.5).withColumnRenamed("value", "median")
    ses = sg.running_ratio(w, ["rep_id"], F.col("s")).join(reps, "rep_id").where("upto_c > 0 and all_s > 0")
    lead = F.round(F.col("upto_c") / F.col("all_c") - F.col("upto_s") / F.col("all_s"), 12)
    ses = ses.groupBy("rep_id").agg(F.max(F.struct(lead.alias("lead"), (-F.col("at")).alias("at"), (F.col("upto_s") / F.col("upto_c")).alias("ses")))["ses"].alias("ses"))
    out = reps.select("rep_id").join(ncis, "rep_id", "left").join(median, "rep_id", "left").join(ses, "rep_id", "left")
    return out.select("rep_id", *[F.round(c, 9).alias(c) for c in ("ncis", "median", "ses")])


def _scaling(t: DataFrame) -> DataFrame:
    """``rep_id, scale, weight, total`` of ``tiles``."""
    w = sg.replicate_weights(_totals(t))
    return w.select("rep_id", F.coalesce(F.col("total") / F.nullif(F.col("ctrl_total"), F.lit(0.0)), F.lit(1.0)).alias("scale"), "weight", "total")


def _counts(t: DataFrame) -> DataFrame:
    return sg.condition_counts(t, _scaling(t), TILE)


def a10_condition_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(cut_lineage(tiles(spark, folder))).select(*TILE, "cond_id", "sig", F.round("ctrl", 6).alias("ctrl"), F.round("fold", 6).alias("fold"))


def _tested(spark: SparkSession, folder: str, t: DataFrame) -> DataFrame:
    total = t.groupBy("cond_id").agg(F.sum("sig").alias("total")).where("total > 0")
    share = 50.0 / genome(spark, folder).agg(F.sum("len").cast("double")).scalar()
    c = _counts(t).withColumn("ctrl", F.round("ctrl", 6)).join(total, "cond_id").withColumn("_share", share)
    return c.withColumn("p", sg.p_value(F.col("sig"), F.col("ctrl"), F.col("total"), F.col("_share")))


def m03_p_values(spark: SparkSession, folder: str) -> DataFrame:
    return _tested(spark, folder, cut_lineage(tiles(spark, folder))).select(*TILE, "cond_id", F.round("p", 8).alias("p"))


def w05_q_values(spark: SparkSession, folder: str) -> DataFrame:
    """Step-up q-values of events of ``event_cond`` with a valid P, by condition; ties by hits and id."""
    e = _valid_p(spark, folder)
    q = sg.benjamini_hochberg(e, ["cond_id"], "p", "hits", ["event_id"])
    return q.select("cond_id", "event_id", F.col("q"))


def w05_monotone_q(spark: SparkSession, folder: str) -> DataFrame:
    q = sg.benjamini_hochberg(_valid_p(spark, folder), ["cond_id"], "p", "hits", ["event_id"], monotone=True)
    return q.select("cond_id", "event_id", F.col("q"))


def _valid_p(spark: SparkSession, folder: str) -> DataFrame:
    e = current_events(spark, folder, "cond_sig_v_ctrl_p", "cond_sig_hits")
    return e.where(F.col("cond_sig_v_ctrl_p").between(0, 1)).select("cond_id", "event_id", F.col("cond_sig_v_ctrl_p").alias("p"), F.coalesce(counts_only("cond_sig_hits"), F.lit(0.0)).alias("hits"))


def m06_replicate_scaling(spark: SparkSession, folder: str) -> DataFrame:
    s = sg.replicate_scaling(tiles(spark, folder), TILE)
    return s.select("cond_id", "rep_a", "rep_b", F.round("scale", 9).alias("scale"))


def _consistency(t: DataFrame) -> DataFrame:
    return sg.consistent_pairs(t, cut_lineage(sg.replicate_scaling(t, TILE)), TILE)


def m04_consistency(spark: SparkSession, folder: str) -> DataFrame:
    return _consistency(cut_lineage(tiles(spark, folder)))


def _q_values(tested: DataFrame, keys: list[str]) -> DataFrame:
    return sg.benjamini_hochberg(tested.withColumn("p", F.round("p", 8)), keys, "p", "sig", TILE)


def m05_replicates(spark: SparkSession, folder: str, t: DataFrame | None = None) -> DataFrame:
    """``chrom, tile, cond_id, rep_id, sig, p, q``: each replicate's test against its scaled control, corrected by replicate; ``t`` are the tiles if they are at hand."""
    t = cut_lineage(tiles(spark, folder)) if t is None else t
    share = 50.0 / genome(spark, folder).agg(F.sum("len").cast("double")).scalar()
    r = t.where("sig > 0 or ctrl > 0").join(_scaling(t), "rep_id").withColumn("_share", share)
    r = r.withColumn("ctrl", F.round(F.col("ctrl") * F.col("scale"), 6))
    r = r.select(*TILE, "cond_id", "rep_id", "sig", "ctrl", sg.p_value(F.col("sig"), F.col("ctrl"), F.col("total"), F.col("_share")).alias("p"))
    return _q_values(r, ["cond_id", "rep_id"]).select(*TILE, "cond_id", "rep_id", "sig", F.col("p"), "q")


def _replicated(spark: SparkSession, folder: str) -> DataFrame:
    """``chrom, tile, cond_id, found, q, least_q, code``: the tests of a condition and of its replicates at each tile. A tile is found where it has signal."""
    t = cut_lineage(tiles(spark, folder))  # six steps read it
    cond = _q_values(_tested(spark, folder, t).select(*TILE, "cond_id", "sig", "p"), ["cond_id"]).select(*TILE, "cond_id", "sig", "q")
    reps = m05_replicates(spark, folder, t).groupBy(*TILE, "cond_id").agg(F.count_if(F.col("q") <= 0.01).alias("n_sig"), F.min("q").alias("least_q"))
    n = replicate_runs(spark, folder).groupBy("cond_id").agg(F.count("*").alias("n_reps"))
    j = cond.join(reps, [*TILE, "cond_id"], "left").join(_consistency(t), [*TILE, "cond_id"], "left").join(n, "cond_id")
    found = F.col("sig") > 0
    code = sg.replication_code(F.col("n_reps"), found, F.coalesce("n_sig", F.lit(0)), F.col("q"), F.coalesce("consistent", F.lit(True)))
    return j.select(*TILE, "cond_id", found.alias("found"), "q", "least_q", code.alias("code"))


def m05_replication_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of tiles from the q-values of their condition and replicates."""
    return _replicated(spark, folder).select(*TILE, "cond_id", "code")


def f06_reported(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles by report mode, from the q-values of their condition and replicates."""
    r = _replicated(spark, folder)
    modes = [rp.is_reported(F.col("found"), F.col("q"), F.col("least_q"), F.col("code"), mode=m).alias(m) for m in ("standard", "lenient", "lenientplus")]
    return r.select(*TILE, "cond_id", *modes)


def k08_replicate_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each replicate's table: tiles found in the condition and significant in the replicate (F07)."""
    return m05_replicates(spark, folder).where("sig > 0 and q <= 0.01").select(*TILE, "cond_id", "rep_id", "sig", F.col("p"))


def f09_non_zero(spark: SparkSession, folder: str) -> DataFrame:
    return tiles(spark, folder).groupBy(*TILE, "cond_id").agg(F.max("sig").alias("most")).where("most >= 1")


def j14_shared_controls(spark: SparkSession, folder: str) -> DataFrame:
    """Control files of each condition, each shared one counted once, with the replicates that use them."""
    d = table(spark, folder, "design").where("label = 'control'")
    return d.groupBy("cond_id", "file_name").agg(F.count_distinct("rep_id").alias("replicates")).groupBy("cond_id").agg(F.count("*").alias("controls"), F.sum("replicates").alias("uses"))


def s05_design(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each replicate with its signal and control files; a null replicate name counts as its number in the condition."""
    d = table(spark, folder, "design")
    r = d.groupBy("run_id", "cond_id", "cond", "rep_id").agg(
        F.max("rep").alias("rep"), F.max(F.when(F.col("label") == "signal", F.col("file_name"))).alias("signal"), F.max(F.when(F.col("label") == "control", F.col("file_name"))).alias("control")
    )
    n = F.row_number().over(Window.partitionBy("cond_id").orderBy("rep_id"))
    return r.select("run_id", "cond_id", "cond", "rep_id", F.coalesce("rep", n.cast("string")).alias("rep"), "signal", "control")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Current events with point, counts and tests under short names."""
    e = current_events(spark, folder, "event_point", "region_id", "found_in_cond", "cond_sig_hits", "cond_ctrl_hits", "cond_sig_v_ctrl_fold", "cond_sig_v_ctrl_p", "cond_sig_v_ctrl_q", "replicated")
    p = "event_point"
    return e.select(
        "event_id", "cond_id", "region_id", p, point_chrom(p).alias("chrom"), point_pos(p).alias("pos"), point_strand(p).alias("strand"), F.col("found_in_cond").alias("found"),
        F.col("cond_sig_hits").alias("sig"), F.col("cond_ctrl_hits").alias("ctrl"), F.col("cond_sig_v_ctrl_fold").alias("fold"), F.col("cond_sig_v_ctrl_p").alias("p"),
        F.col("cond_sig_v_ctrl_q").alias("q"), F.col("replicated").alias("code"),
    )


def f08_round0(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).where(F.col("found") & F.col("p").between(0, 0.05)).select("event_id", "cond_id", "region_id")


def j11_region_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events found in each current region; regions without any are kept."""
    n = events(spark, folder).where("found and region_id is not null").groupBy("region_id").agg(F.count_distinct("event_id").alias("events"), F.count("*").alias("rows"))
    return current_regions(spark, folder).select("region_id").join(n, "region_id", "left").select("region_id", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("rows", F.lit(0)).alias("rows"))


def j12_by_point(spark: SparkSession, folder: str) -> DataFrame:
    """Events of one condition at one point as one: the first event found there, with the counts of the last."""
    e = events(spark, folder).where("pos is not null")
    e = e.withColumn("hits", counts_only("sig"))
    first = F.min(F.when(F.col("found"), F.col("event_id")))
    last = F.max(F.when(F.col("found"), F.struct("event_id", "hits")))
    return e.groupBy("cond_id", "chrom", "pos").agg(first.alias("event_id"), last["hits"].alias("hits"), F.count("*").alias("n"))


def j12_consolidated(spark: SparkSession, folder: str) -> DataFrame:
    """Points at which any condition has a found event, one event each over all conditions: the first found there, with each condition's counts (``j12_by_point``), 0 where it isn't found."""
    each = j12_by_point(spark, folder)
    first = F.min("event_id").over(Window.partitionBy("chrom", "pos"))  # one row for each condition
    each = each.withColumn("hits", F.when(F.col("event_id").isNotNull(), F.col("hits")).otherwise(0.0)).withColumn("event_id", first)
    return each.where("event_id is not null").select("chrom", "pos", "event_id", "cond_id", "hits")


def j13_same_configurations(spark: SparkSession, folder: str) -> DataFrame:
    """Regions whose conditions share one set of found points: the sets are compared by digest."""
    e = events(spark, folder).where("found and region_id is not null and pos is not null").select("region_id", "cond_id", "chrom", "pos").distinct()
    # order-free digests of the set, so no list of a crowded region is collected
    h = F.xxhash64("chrom", "pos")
    sets = e.groupBy("region_id", "cond_id").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1_000_000_007))).alias("s"))
    return sets.groupBy("region_id", "n", "x", "s").agg(F.count("*").alias("conditions")).where("conditions > 1").groupBy("region_id").agg(F.count("*").alias("configurations"), F.sum("conditions").alias("conditions"))


def a15_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder)
    return e.groupBy("cond_id").agg(F.count_if("found").alias("found"), F.count_if(F.col("found") & (F.col("q") <= 0.01)).alias("significant"), F.count("*").alias("n"))


def p02_formatted(spark: SparkSession, folder: str) -> DataFrame:
    """Location, counts and logarithms as result tables show them."""
    e = events(spark, folder).where("pos is not null")
    return e.select(
        "event_id", "cond_id", F.concat_ws(":", "chrom", F.col("pos").cast("string")).alias("point"), F.round(counts_only("sig"), 1).alias("sig"), F.round("ctrl", 1).alias("ctrl"),
        rp.log2_column(F.col("fold")).alias("log2_fold"), rp.log2_column(F.col("q")).alias("log2_q"),
    )


def k05_bed(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder).where(F.col("found") & (F.col("q") <= 0.01) & F.col("pos").isNotNull())
    return rp.bed_rows(e)


def _conditions(spark: SparkSession, folder: str) -> list[int]:
    """Conditions of the design: a table of one row for each replicate."""
    return [r[0] for r in replicate_runs(spark, folder).select("cond_id").distinct().orderBy("cond_id").collect()]


def k03_all_events(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each event, with counts and logarithms of each condition and the conditions it is found in."""
    conds = _conditions(spark, folder)
    cells = {"sig": counts_only("sig"), "ctrl": F.col("ctrl"), "log2_fold": rp.log2_column(F.col("fold")), "log2_q": rp.log2_column(F.col("q")), "found": F.col("found").cast("int")}
    # flags as cells too: numbers alone are combined in each partition
    wide = rp.wide_table(events(spark, folder), ["event_id"], "cond_id", conds, cells)
    flags = [f"{c}_found" for c in conds]
    return wide.withColumn("found_in", F.concat_ws(",", *[F.col(f).cast("string") for f in flags])).drop(*flags)


def k04_condition_events(spark: SparkSession, folder: str) -> DataFrame:
    """Reported events with their place in their condition's table: by hits, the largest first."""
    e = events(spark, folder).where(rp.is_reported(F.col("found"), F.col("q"), F.lit(1.0), F.col("code")))
    e = e.select("cond_id", "event_id", "event_point", F.coalesce(counts_only("sig"), F.lit(-1.0)).alias("_hits"))
    return numbered(e, ["cond_id"], [F.col("_hits").desc(), F.col("event_id")], "place").select("cond_id", "place", "event_id", "event_point")


def k09_replicate_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Signal of each replicate by tile, one column for each replicate of the design."""
    reps = [r[0] for r in replicate_runs(spark, folder).select("rep_id").distinct().orderBy("rep_id").collect()]
    return rp.wide_table(tiles(spark, folder), TILE, "rep_id", reps, {"sig": F.col("sig")})


def k10_replication_table(spark: SparkSession, folder: str) -> DataFrame:
    return rp.wide_table(events(spark, folder), ["event_id"], "cond_id", _conditions(spark, folder), {"code": F.col("code")})


def o01_top_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """The 500 tiles with most signal, all conditions pooled."""
    t = tiles(spark, folder).groupBy(*TILE).agg(F.sum("sig").alias("sig"))
    return t.orderBy(F.desc("sig"), "chrom", "tile").limit(500)


def o03_event_order(spark: SparkSession, folder: str) -> DataFrame:
    """All events by P, then more hits."""
    return _valid_p(spark, folder).orderBy("p", F.desc("hits"), "event_id", "cond_id")


def o06_argmax(spark: SparkSession, folder: str) -> DataFrame:
    """The base with most signal of each condition and chromosome; the lowest coordinate wins ties."""
    h = signal(spark, folder).groupBy("cond_id", "chrom", "pos").agg(F.sum("cnt").alias("cnt"))
    best = h.groupBy("cond_id", "chrom").agg(F.max(F.struct("cnt", (-F.col("pos")).alias("n"))).alias("b"))
    return best.select("cond_id", "chrom", (-F.col("b.n")).alias("pos"), F.col("b.cnt").alias("cnt"))


QUERIES = {
    f.__name__: f
    for f in (
        a09_weights, m07_scaling, a10_condition_counts, m03_p_values, w05_q_values, w05_monotone_q, m06_replicate_scaling, m04_consistency, m05_replication_codes, f09_non_zero,
        j14_shared_controls, s05_design, f06_reported, f08_round0, j11_region_events, j12_by_point, j12_consolidated, j13_same_configurations, a15_event_counts, p02_formatted, k05_bed, k03_all_events,
        k04_condition_events, k09_replicate_counts, k10_replication_table, o01_top_tiles, o03_event_order, o06_argmax,
        k08_replicate_events, m05_replicates, m07_scaling_methods,
    )
} | {"o03_all_in_order": o03_event_order}

_EV = EVENTS + """,
e AS (SELECT event_id, cond_id, region_id, event_point, chrom, pos, found_in_cond AS found, cond_sig_hits AS sig, cond_ctrl_hits AS ctrl, cond_sig_v_ctrl_fold AS fold,
        cond_sig_v_ctrl_p AS p, cond_sig_v_ctrl_q AS q, replicated AS code,
        CASE WHEN cond_sig_hits >= 0 AND NOT isnan(cond_sig_hits) AND NOT isinf(cond_sig_hits) THEN cond_sig_hits END AS hits FROM evt)"""
_VALID = _EV + """,
v AS (SELECT cond_id, event_id, p, coalesce(hits, 0) AS hits FROM e WHERE NOT isnan(p) AND p BETWEEN 0 AND 1)"""
_TOT = TILES + """,
tot AS (SELECT cond_id, rep_id, sum(sig) AS total, sum(ctrl) AS ctrl_total, sum(CASE WHEN sig >= 3 THEN sig ELSE 0 END) / nullif(sum(sig), 0) AS fraction FROM tiles GROUP BY ALL),
wgt AS (SELECT *, coalesce(coalesce(fraction * total, 0) / nullif(sum(coalesce(fraction * total, 0)) OVER (PARTITION BY cond_id), 0), 1.0::DOUBLE / count(*) OVER (PARTITION BY cond_id)) AS weight FROM tot),
scl AS (SELECT rep_id, coalesce(total / nullif(ctrl_total, 0), 1) AS scale, weight FROM wgt),
cnd AS (
  SELECT chrom, tile, cond_id, sum(sig) AS sig, sum(ctrl * scale) AS ctrl, sum(CASE WHEN ctrl > 1 THEN coalesce(sig / nullif(ctrl * scale, 0), 0) ELSE sig END * weight) AS fold
  FROM tiles JOIN scl USING (rep_id) GROUP BY ALL)"""


#: conditions and replicates of the design, a table that doesn't grow
_IDS, _REP_IDS = (", ".join(map(str, range(1, n + 1))) for n in (35, 71))


def _binomial(k: str, n: str, p: str) -> str:
    """Sum of the pmf up to k, as a correlated list."""
    return f"""CASE WHEN {k} < 0 THEN 0.0 WHEN {k} >= {n} THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(0, CAST({k} AS BIGINT) + 1),
      lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))))) END"""


def _log2(x: str) -> str:
    return f"CASE WHEN {x} > 0 AND NOT isnan({x}) AND NOT isinf({x}) THEN round(log2({x}), 3) END"


_CONS = f"""
yy AS (SELECT cond_id, rep_id, sum(sig * sig) AS yy FROM tiles GROUP BY ALL),
up AS (
  SELECT a.cond_id, a.rep_id AS rep_a, b.rep_id AS rep_b, sum(a.sig * b.sig) / any_value(nullif(yy, 0)) AS scale FROM tiles a JOIN tiles b USING (chrom, tile, cond_id)
  JOIN yy ON yy.cond_id = a.cond_id AND yy.rep_id = b.rep_id WHERE a.rep_id < b.rep_id GROUP BY ALL),
rsc AS (SELECT * FROM up WHERE scale > 0 UNION ALL SELECT cond_id, rep_b, rep_a, 1 / scale FROM up WHERE scale > 0),
evc AS (SELECT DISTINCT chrom, tile, cond_id FROM tiles),
prb AS (
  SELECT evc.*, round(coalesce(a.sig, 0) + coalesce(b.sig, 0) * scale, 9) AS n, round(coalesce(b.sig, 0) * scale, 9) AS k FROM evc LEFT JOIN rsc ON rsc.cond_id = evc.cond_id
  LEFT JOIN tiles a ON a.chrom = evc.chrom AND a.tile = evc.tile AND a.cond_id = evc.cond_id AND a.rep_id = rep_a
  LEFT JOIN tiles b ON b.chrom = evc.chrom AND b.tile = evc.tile AND b.cond_id = evc.cond_id AND b.rep_id = rep_b),
con AS (SELECT chrom, tile, cond_id, min(coalesce(CASE WHEN n > 0 THEN {_binomial('ceil(k)', 'ceil(n)', '0.4')} > 0.01 END, true)) AS consistent FROM prb GROUP BY ALL)"""


def _p(sig: str, ctrl: str, total: str) -> str:
    """The larger of both tests."""
    mean = f"(1.5 * greatest({ctrl}, {total} * 50.0 / g))"
    bp = _binomial(f"ceil({ctrl})", f"ceil({sig} + {ctrl})", "0.4")
    pp = f"greatest(1 - CASE WHEN ceil({sig}) - 1 < 0 THEN 0.0 WHEN {mean} <= 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(0, CAST(ceil({sig}) AS BIGINT)), lambda i: exp(-{mean} + i * ln({mean}) - lgamma(i + 1))))) END, 0)"
    return f"round(CASE WHEN {sig} + {ctrl} <= 0 OR ({ctrl} > 0 AND {sig} <= 1.5 * {ctrl}) THEN 1.0 ELSE greatest({bp}, {pp}) END, 8)"


def _q(keys: str, source: str) -> str:
    return f"SELECT *, least(1.0, p * count(*) OVER (PARTITION BY {keys}) / row_number() OVER (PARTITION BY {keys} ORDER BY p, sig DESC, chrom, tile)) AS q FROM {source}"


_REPS = f"""{_TOT},
rct AS (SELECT chrom, tile, tiles.cond_id, tiles.rep_id, sig, round(ctrl * scale, 6) AS ctrl, tot.total, (SELECT CAST(sum(len) AS DOUBLE) FROM genome_info) AS g FROM tiles JOIN scl USING (rep_id) JOIN tot USING (rep_id) WHERE sig > 0 OR ctrl > 0),
rp AS (SELECT *, {_p('sig', 'ctrl', 'total')} AS p FROM rct),
rq AS ({_q('cond_id, rep_id', 'rp')})"""
_REPLICATED = f"""{_REPS}, {_CONS},
ct AS (SELECT cond_id, sum(cnt) AS total FROM sig GROUP BY 1),
cc AS (SELECT chrom, tile, cond_id, sig, round(ctrl, 6) AS ctrl, total, (SELECT CAST(sum(len) AS DOUBLE) FROM genome_info) AS g FROM cnd JOIN ct USING (cond_id)),
cp AS (SELECT *, {_p('sig', 'ctrl', 'total')} AS p FROM cc),
cq AS ({_q('cond_id', 'cp')}),
nr AS (SELECT cond_id, count(DISTINCT rep_id) AS n_reps FROM design GROUP BY 1),
rs AS (SELECT chrom, tile, cond_id, count(*) FILTER (WHERE q <= 0.01) AS n_sig, min(q) AS least_q FROM rq GROUP BY ALL),
rep AS (
  SELECT chrom, tile, cond_id, cq.sig > 0 AS found, q, least_q, CASE WHEN n_reps <= 1 THEN 'S' WHEN NOT cq.sig > 0 THEN 'X' WHEN n_sig >= 2 THEN CAST(n_sig AS VARCHAR)
    WHEN (coalesce(n_sig, 0) = 1 OR q <= 0.01) AND coalesce(consistent, true) THEN '1' WHEN coalesce(n_sig, 0) = 1 OR q <= 0.01 THEN 'D' ELSE 'X' END AS code
  FROM cq LEFT JOIN rs USING (chrom, tile, cond_id) LEFT JOIN con USING (chrom, tile, cond_id) JOIN nr USING (cond_id))"""

SQL = {
    "a09_weights": f"WITH {_TOT} SELECT cond_id, rep_id, round(weight, 9) AS weight FROM wgt",
    "m07_scaling": """WITH hits AS (SELECT DISTINCT rep_id, channel, regexp_replace(chrom, '^chr', '') AS chrom, pos, strand, CAST(cnt AS DOUBLE) AS cnt FROM base_counts WHERE cnt > 0 AND NOT isnan(cnt)),
w AS (SELECT rep_id, chrom, pos // 10000 AS w, sum(CASE WHEN channel = 'signal' THEN cnt ELSE 0 END) AS s, sum(CASE WHEN channel = 'control' THEN cnt ELSE 0 END) AS c FROM hits GROUP BY ALL)
SELECT rep_id, round(coalesce(sum(s) / nullif(sum(c), 0), 1), 9) AS by_total, round(coalesce(sum(s * c) / nullif(sum(c * c), 0), 1), 9) AS by_regression FROM w GROUP BY 1""",
    "m07_scaling_methods": f"""WITH {HITS}, w AS (SELECT rep_id, chrom, pos // 10000 AS w, sum(CASE WHEN channel = 'signal' THEN cnt ELSE 0 END) AS s, sum(CASE WHEN channel = 'control' THEN cnt ELSE 0 END) AS c FROM hits GROUP BY ALL),
gw AS (SELECT sum(len // 10000 + 1) AS gw FROM (SELECT max(len) AS len FROM genome_info GROUP BY regexp_replace(chrom, '^chr', ''))),
r AS (SELECT rep_id, sum(s) AS s_all, sum(c) AS c_all, count(*) AS n FROM w GROUP BY 1 HAVING sum(c) > 0),
a AS (SELECT rep_id, lv, sum(ns) OVER x AS us, sum(nc) OVER x AS uc, sum(k) OVER x AS u FROM (SELECT rep_id, s + c AS lv, sum(s) AS ns, sum(c) AS nc, count(*) AS k FROM w GROUP BY ALL) WINDOW x AS (PARTITION BY rep_id ORDER BY lv)),
b AS (SELECT rep_id, lv, us / uc AS ratio FROM a JOIN r USING (rep_id), gw WHERE uc > 0 AND gw - n + u >= 0.75 * gw),
d AS (SELECT *, coalesce(ratio >= lag(ratio) OVER (PARTITION BY rep_id ORDER BY lv), false) AS stops FROM b),
ncis AS (SELECT rep_id, coalesce(arg_min(ratio, lv) FILTER (WHERE stops), arg_max(ratio, lv)) AS ncis FROM d GROUP BY 1),
med AS (SELECT rep_id, quantile_cont(s / c, 0.5) AS median FROM w WHERE s > 0 AND c > 0 GROUP BY 1),
e AS (SELECT rep_id, lv, sum(ns) OVER x AS us, sum(nc) OVER x AS uc FROM (SELECT rep_id, s AS lv, sum(s) AS ns, sum(c) AS nc FROM w GROUP BY ALL) WINDOW x AS (PARTITION BY rep_id ORDER BY lv)),
f AS (SELECT rep_id, us / uc AS ses, row_number() OVER (PARTITION BY rep_id ORDER BY round(uc / c_all - us / s_all, 12) DESC, lv) AS k FROM e JOIN r USING (rep_id) WHERE uc > 0 AND s_all > 0)
SELECT r.rep_id, round(ncis, 9) AS ncis, round(median, 9) AS median, round(ses, 9) AS ses FROM r LEFT JOIN ncis USING (rep_id) LEFT JOIN med USING (rep_id) LEFT JOIN (SELECT * FROM f WHERE k = 1) f USING (rep_id)""",
    "a10_condition_counts": f"WITH {_TOT} SELECT chrom, tile, cond_id, sig, round(ctrl, 6) AS ctrl, round(fold, 6) AS fold FROM cnd",
    "m03_p_values": f"""WITH {_TOT}, gl AS (SELECT CAST(sum(len) AS DOUBLE) AS g FROM genome_info), ct AS (SELECT cond_id, sum(cnt) AS total FROM sig GROUP BY 1),
t AS (SELECT chrom, tile, cond_id, sig, round(ctrl, 6) AS ctrl, total, 1.5 * greatest(round(ctrl, 6), total * 50.0 / g) AS mean FROM cnd JOIN ct USING (cond_id), gl),
b AS (SELECT *, {_binomial('ceil(ctrl)', 'ceil(sig + ctrl)', '0.4')} AS bp,
  greatest(1 - CASE WHEN ceil(sig) - 1 < 0 THEN 0.0 WHEN mean <= 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(0, CAST(ceil(sig) AS BIGINT)), lambda i: exp(-mean + i * ln(mean) - lgamma(i + 1))))) END, 0) AS pp FROM t)
SELECT chrom, tile, cond_id, round(CASE WHEN sig + ctrl <= 0 OR (ctrl > 0 AND sig <= 1.5 * ctrl) THEN 1.0 ELSE greatest(bp, pp) END, 8) AS p FROM b""",
    "w05_q_values": f"""WITH {_VALID} SELECT cond_id, event_id, least(1.0, p * count(*) OVER (PARTITION BY cond_id) / row_number() OVER (PARTITION BY cond_id ORDER BY p, hits DESC, event_id)) AS q FROM v""",
    "w05_monotone_q": f"""WITH {_VALID}, r AS (SELECT *, row_number() OVER (PARTITION BY cond_id ORDER BY p, hits DESC, event_id) AS k, count(*) OVER (PARTITION BY cond_id) AS n FROM v)
SELECT cond_id, event_id, min(least(1.0, p * n / k)) OVER (PARTITION BY cond_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM r""",
    "m06_replicate_scaling": f"WITH {TILES}, {_CONS} SELECT cond_id, rep_a, rep_b, round(scale, 9) AS scale FROM rsc",
    "m04_consistency": f"WITH {TILES}, {_CONS} SELECT * FROM con",
    "m05_replicates": f"WITH {_REPS} SELECT chrom, tile, cond_id, rep_id, sig, p, q FROM rq",
    "m05_replication_codes": f"WITH {_REPLICATED} SELECT chrom, tile, cond_id, code FROM rep",
    "f06_reported": f"""WITH {_REPLICATED}, m AS (SELECT *, found AND q <= 0.01 AS st, coalesce(least_q <= 0.01, false) AS r FROM rep)
SELECT chrom, tile, cond_id, st AS standard, st OR r AS lenient, st OR (r AND code <> 'D') AS lenientplus FROM m""",
    "k08_replicate_events": f"WITH {_REPS} SELECT chrom, tile, cond_id, rep_id, sig, p FROM rq WHERE sig > 0 AND q <= 0.01",
    "f09_non_zero": f"WITH {TILES} SELECT chrom, tile, cond_id, max(sig) AS most FROM tiles GROUP BY ALL HAVING max(sig) >= 1",
    "j14_shared_controls": "WITH c AS (SELECT cond_id, file_name, count(DISTINCT rep_id) AS r FROM design WHERE label = 'control' GROUP BY ALL) SELECT cond_id, count(*) AS controls, CAST(sum(r) AS BIGINT) AS uses FROM c GROUP BY 1",
    "s05_design": """WITH r AS (SELECT run_id, cond_id, cond, rep_id, max(rep) AS rep, max(CASE WHEN label = 'signal' THEN file_name END) AS signal, max(CASE WHEN label = 'control' THEN file_name END) AS control FROM design GROUP BY ALL)
SELECT run_id, cond_id, cond, rep_id, coalesce(rep, CAST(row_number() OVER (PARTITION BY cond_id ORDER BY rep_id) AS VARCHAR)) AS rep, signal, control FROM r""",
    "f08_round0": f"WITH {_EV} SELECT event_id, cond_id, region_id FROM e WHERE found AND NOT isnan(p) AND p BETWEEN 0 AND 0.05",
    "j11_region_events": f"WITH {_EV}, {REGIONS} SELECT reg.region_id, count(DISTINCT event_id) AS events, count(event_id) AS rows FROM reg LEFT JOIN (SELECT * FROM e WHERE found) f USING (region_id) GROUP BY 1",
    "j12_by_point": f"""WITH {_EV} SELECT cond_id, chrom, pos, min(event_id) FILTER (WHERE found) AS event_id, last(hits ORDER BY event_id) FILTER (WHERE found) AS hits, count(*) AS n FROM e WHERE pos IS NOT NULL GROUP BY ALL""",
    "j12_consolidated": f"""WITH {_EV}, p AS (SELECT cond_id, chrom, pos, min(event_id) FILTER (WHERE found) AS ev, last(hits ORDER BY event_id) FILTER (WHERE found) AS hits FROM e WHERE pos IS NOT NULL GROUP BY ALL),
f AS (SELECT *, min(ev) OVER (PARTITION BY chrom, pos) AS event_id FROM p)
SELECT chrom, pos, event_id, cond_id, CASE WHEN ev IS NOT NULL THEN hits ELSE 0 END AS hits FROM f WHERE event_id IS NOT NULL""",
    "j13_same_configurations": f"""WITH {_EV}, d AS (SELECT DISTINCT region_id, cond_id, chrom, pos FROM e WHERE found AND region_id IS NOT NULL AND pos IS NOT NULL),
s AS (SELECT region_id, cond_id, list(chrom || ':' || pos ORDER BY chrom, pos) AS l FROM d GROUP BY ALL), c AS (SELECT region_id, l, count(*) AS n FROM s GROUP BY ALL HAVING count(*) > 1)
SELECT region_id, count(*) AS configurations, CAST(sum(n) AS BIGINT) AS conditions FROM c GROUP BY 1""",
    "a15_event_counts": f"WITH {_EV} SELECT cond_id, count(*) FILTER (WHERE found) AS found, count(*) FILTER (WHERE found AND q <= 0.01) AS significant, count(*) AS n FROM e GROUP BY 1",
    "p02_formatted": f"WITH {_EV} SELECT event_id, cond_id, chrom || ':' || pos AS point, round(hits, 1) AS sig, round(ctrl, 1) AS ctrl, {_log2('fold')} AS log2_fold, {_log2('q')} AS log2_q FROM e WHERE pos IS NOT NULL",
    "k05_bed": f"""WITH {_EV} SELECT 'chr' || chrom AS chrom, pos - 1 AS bstart, pos AS bend, chrom || ':' || pos AS name,
CASE WHEN q <= 0 THEN 1000 ELSE CAST(trunc(greatest(least(-10 * log2(q), 1000), 0)) AS INTEGER) END AS score FROM e WHERE found AND q <= 0.01 AND pos IS NOT NULL""",
    "k09_replicate_counts": f"""WITH {TILES}, w AS (PIVOT (SELECT chrom, tile, rep_id, sig FROM tiles) ON rep_id IN ({_REP_IDS}) USING max(sig) GROUP BY chrom, tile)
SELECT chrom, tile, {", ".join(f'"{i}" AS "{i}_sig"' for i in _REP_IDS.split(", "))} FROM w""",
    "k10_replication_table": f"""WITH {_EV}, w AS (PIVOT (SELECT event_id, cond_id, code FROM e) ON cond_id IN ({_IDS}) USING max(code) GROUP BY event_id)
SELECT event_id, {", ".join(f'"{i}" AS "{i}_code"' for i in _IDS.split(", "))} FROM w""",
    "k04_condition_events": f"""WITH {_EV} SELECT cond_id, CAST(row_number() OVER (PARTITION BY cond_id ORDER BY coalesce(hits, -1) DESC, event_id) AS INTEGER) AS place, event_id, event_point FROM e WHERE found AND q <= 0.01""",
    "k03_all_events": f"""WITH {_EV}, c AS (SELECT event_id, cond_id, hits AS sig, ctrl, {_log2('fold')} AS log2_fold, {_log2('q')} AS log2_q FROM e),
w AS (PIVOT c ON cond_id IN ({_IDS}) USING max(sig) AS sig, max(ctrl) AS ctrl, max(log2_fold) AS log2_fold, max(log2_q) AS log2_q GROUP BY event_id),
f AS (SELECT event_id, string_agg(CASE WHEN found THEN '1' ELSE '0' END, ',' ORDER BY cond_id) AS found_in FROM e WHERE found IS NOT NULL GROUP BY 1)
SELECT * FROM w LEFT JOIN f USING (event_id)""",
    "o01_top_tiles": f"WITH {TILES} SELECT chrom, tile, sum(sig) AS sig FROM tiles GROUP BY ALL ORDER BY sig DESC, chrom, tile LIMIT 500",
    "o03_event_order": f"WITH {_VALID} SELECT * FROM v ORDER BY p, hits DESC, event_id, cond_id",
    "o03_all_in_order": f"WITH {_VALID} SELECT * FROM v ORDER BY p, hits DESC, event_id, cond_id",
    "o06_argmax": """WITH hits AS (SELECT DISTINCT rep_id, regexp_replace(chrom, '^chr', '') AS chrom, pos, strand, CAST(cnt AS DOUBLE) AS cnt FROM base_counts WHERE cnt > 0 AND NOT isnan(cnt) AND channel = 'signal'),
h AS (SELECT cond_id, chrom, pos, sum(cnt) AS cnt FROM hits JOIN (SELECT DISTINCT rep_id, cond_id FROM design) USING (rep_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cond_id, chrom ORDER BY cnt DESC, pos) AS k FROM h) SELECT cond_id, chrom, pos, cnt FROM r WHERE k = 1""",
}
