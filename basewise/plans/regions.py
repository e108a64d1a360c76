"""Landscapes, enriched regions and interval operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewise.functions.genome import plain_chrom, point_chrom, point_pos
from basewise.operators import intervals as iv
from basewise.operators import landscape as ls
from basewise.plans.sql_views import EVENTS, GENOME, HITS, IGNORED, REGIONS, islands
from basewise.session import cut_lineage
from basewise.sources.tables import base_hits, current_events, current_regions, genome, replicate_runs, table


def signal(spark: SparkSession, folder: str) -> DataFrame:
    """Signal hits with the run and condition of their replicate."""
    return base_hits(spark, folder).join(replicate_runs(spark, folder), "rep_id")


def ignored(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "regions_to_ignore").select("ignore_id", plain_chrom("chrom").alias("chrom"), F.col("xstart").cast("bigint").alias("xstart"), F.col("xend").cast("bigint").alias("xend"))


def event_points(spark: SparkSession, folder: str) -> DataFrame:
    """``event_id, cond_id, chrom, pos, hits``: current events with a point."""
    e = current_events(spark, folder, "event_point", "cond_sig_hits")
    return e.select("event_id", "cond_id", point_chrom("event_point").alias("chrom"), point_pos("event_point").alias("pos"), F.col("cond_sig_hits").alias("hits")).where("pos is not null")


def a01_landscape(spark: SparkSession, folder: str) -> DataFrame:
    return ls.hit_landscape(signal(spark, folder), ["cond_id"])


def a01_landscape_plus(spark: SparkSession, folder: str) -> DataFrame:
    return ls.hit_landscape(signal(spark, folder), ["cond_id"], strand="+")


def a02_landscape_by_replicate(spark: SparkSession, folder: str) -> DataFrame:
    return ls.hit_landscape(signal(spark, folder), ["rep_id"])


def a03_binned_starts(spark: SparkSession, folder: str) -> DataFrame:
    return ls.binned_starts(signal(spark, folder), ["cond_id"])


def m01_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    t = ls.scan_thresholds(signal(spark, folder), ["cond_id"], genome(spark, folder))
    return t.select("cond_id", "reads", "threshold")


def m02_alphas(spark: SparkSession, folder: str) -> DataFrame:
    """The smaller threshold over the replicates of each condition, and that of the condition itself; alpha is at least 1."""
    h, g = signal(spark, folder), genome(spark, folder)
    rep = ls.scan_thresholds(h, ["cond_id", "rep_id"], g, -7.0).groupBy("cond_id").agg(F.min("threshold").alias("lenient"))
    return ls.scan_thresholds(h, ["cond_id"], g, -7.0).join(rep, "cond_id").select("cond_id", F.col("threshold").cast("double").alias("alpha"), F.col("lenient").cast("double").alias("lenient_alpha"))


def _potential(spark: SparkSession, folder: str, h: DataFrame | None = None) -> DataFrame:
    """Enriched regions of each condition; ``h`` is its signal if it is at hand."""
    h, g = signal(spark, folder) if h is None else h, genome(spark, folder)
    return ls.potential_regions(ls.hit_landscape(h, ["cond_id"]), ls.scan_thresholds(h, ["cond_id"], g), g, ["cond_id"])


def w01_potential_regions(spark: SparkSession, folder: str) -> DataFrame:
    return _potential(spark, folder)


def w02_split_regions(spark: SparkSession, folder: str) -> DataFrame:
    return ls.split_long(_potential(spark, folder), ls.hit_landscape(signal(spark, folder), ["cond_id"]), ["cond_id"], longest=500)


def j01_hits_in_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of each current region's run inside it; regions without hits are kept."""
    r = current_regions(spark, folder)
    h = signal(spark, folder).select("run_id", "chrom", "pos", "strand", "cnt")
    held = iv.points_in_intervals(h, r, ["run_id", "chrom"])
    sums = held.groupBy("region_id").agg(F.sum("cnt").alias("hits"), F.sum(F.when(F.col("strand") == "+", F.col("cnt")).otherwise(0.0)).alias("plus"))
    return r.select("region_id").join(sums, "region_id", "left").select("region_id", F.coalesce("hits", F.lit(0.0)).alias("hits"), F.coalesce("plus", F.lit(0.0)).alias("plus"))


def _inside(spark: SparkSession, folder: str, channel: str | None = "signal", potential: DataFrame | None = None) -> DataFrame:
    """``cond_id, rep_id, channel, inside, outside``; ``potential`` are the enriched regions if they are at hand."""
    h = base_hits(spark, folder, channel).join(replicate_runs(spark, folder), "rep_id")
    return ls.counts_in_and_out(h, _potential(spark, folder) if potential is None else potential, ["cond_id"], ["cond_id", "rep_id", "channel"])


def a04_counts_inside(spark: SparkSession, folder: str) -> DataFrame:
    return _inside(spark, folder).drop("channel")


def a04_control_inside(spark: SparkSession, folder: str) -> DataFrame:
    return _inside(spark, folder, "control").drop("channel")


def a05_signal_fraction(spark: SparkSession, folder: str) -> DataFrame:
    return _inside(spark, folder).select("rep_id", F.round(F.col("inside") / (F.col("inside") + F.col("outside")), 9).alias("fraction"))


def _lengths(potential: DataFrame) -> DataFrame:
    return potential.groupBy("cond_id").agg(F.sum(F.col("rend") - F.col("rstart") + 1).alias("bases"), F.count("*").alias("regions"))


def a06_region_length(spark: SparkSession, folder: str) -> DataFrame:
    return _lengths(_potential(spark, folder))


def a07_noise_per_base(spark: SparkSession, folder: str, h: DataFrame | None = None) -> DataFrame:
    """Hits outside the regions over the bases outside them, in hits a million bases; ``h`` is the signal if it is at hand."""
    total = genome(spark, folder).agg(F.sum("len")).scalar()
    h = signal(spark, folder) if h is None else h
    potential = cut_lineage(_potential(spark, folder, h))
    out = ls.counts_in_and_out(h, potential, ["cond_id"], ["cond_id"])
    return out.join(_lengths(potential), "cond_id", "left").select(
        "cond_id", F.round(F.col("outside") * 1e6 / (total - F.coalesce("bases", F.lit(0))), 9).alias("noise")
    )


def a08_control_noise(spark: SparkSession, folder: str) -> DataFrame:
    """Control against signal outside the regions; 1 where a condition has no control."""
    side = lambda c: F.sum(F.when(F.col("channel") == c, F.col("outside")))
    both = _inside(spark, folder, None).groupBy("cond_id").agg(side("signal").alias("s"), side("control").alias("c")).where("s is not null")
    return both.select("cond_id", F.round(F.coalesce(F.col("c") / F.nullif(F.col("s"), F.lit(0.0)), F.lit(1.0)), 9).alias("ratio"))


def a27_genome(spark: SparkSession, folder: str) -> DataFrame:
    """The largest length of each chromosome named in the genome or reached by a hit."""
    reached = base_hits(spark, folder, None).groupBy("chrom").agg(F.max("pos").cast("bigint").alias("len"))
    return genome(spark, folder).unionByName(reached).groupBy("chrom").agg(F.max("len").alias("len"))


def f01_without_ignored(spark: SparkSession, folder: str) -> DataFrame:
    r = current_regions(spark, folder)
    hit = iv.overlapping(r.select("region_id", "chrom", "rstart", "rend"), ignored(spark, folder), "rstart", "rend", "xstart", "xend")
    return r.join(hit.select("region_id").distinct(), "region_id", "left_anti").select("region_id", "chrom", "rstart", "rend")


def f02_clamped(spark: SparkSession, folder: str) -> DataFrame:
    """Regions widened by 500 bases, kept within their chromosome."""
    r = current_regions(spark, folder).join(genome(spark, folder), "chrom")
    clamp = lambda x: F.least(F.greatest(x, F.lit(1)), F.col("len"))
    return r.select("region_id", clamp(F.col("rstart") - 500).alias("rstart"), clamp(F.col("rend") + 500).alias("rend"))


def j02_fragments(spark: SparkSession, folder: str) -> DataFrame:
    return iv.subtract(current_regions(spark, folder), ignored(spark, folder), "region_id")


def j04_complement(spark: SparkSession, folder: str) -> DataFrame:
    return iv.complement(current_regions(spark, folder), genome(spark, folder))


def u04_merged(spark: SparkSession, folder: str) -> DataFrame:
    return iv.merge_overlapping(current_regions(spark, folder), ["run_id", "chrom"])


def j03_regions_by_chrom(spark: SparkSession, folder: str) -> DataFrame:
    r = current_regions(spark, folder).groupBy("chrom").agg(F.count("*").alias("regions"), F.sum(F.col("rend") - F.col("rstart") + 1).alias("bases"))
    return genome(spark, folder).join(r, "chrom", "left").select("chrom", "len", F.coalesce("regions", F.lit(0)).alias("regions"), F.coalesce("bases", F.lit(0)).alias("bases"))


def j05_hits_near_events(spark: SparkSession, folder: str) -> DataFrame:
    """Hits within 100 bases of the ends of current regions, by region, replicate and channel."""
    r = current_regions(spark, folder).select("region_id", "run_id", "chrom", (F.col("rstart") - 100).alias("rstart"), (F.col("rend") + 100).alias("rend"))
    h = base_hits(spark, folder, None).join(replicate_runs(spark, folder), "rep_id").select("run_id", "rep_id", "channel", "chrom", "pos", "cnt")
    return iv.points_in_intervals(h, r, ["run_id", "chrom"]).groupBy("region_id", "rep_id", "channel").agg(F.sum("cnt").alias("hits"), F.count("*").alias("bases"))


def j17_regions_with_peaks(spark: SparkSession, folder: str) -> DataFrame:
    """Regions that hold the point of an event."""
    p = event_points(spark, folder).select("chrom", "pos").distinct()
    return iv.points_in_intervals(p, current_regions(spark, folder).select("region_id", "chrom", "rstart", "rend")).select("region_id").distinct()


def _pairs_of_conditions(spark: SparkSession, folder: str) -> DataFrame:
    d = replicate_runs(spark, folder).select("run_id", "cond_id").distinct()
    first = d.groupBy("run_id").agg(F.min("cond_id").alias("first_cond"))
    return d.join(first, "run_id").where("cond_id <> first_cond").select("cond_id", "first_cond")


def j06_shared_peaks(spark: SparkSession, folder: str) -> DataFrame:
    """Events of other conditions within 30 bases of an event of their run's first condition.

    Points of the first condition become intervals, merged so that crowded places give each event one partner.
    """
    pairs = _pairs_of_conditions(spark, folder)
    e = event_points(spark, folder)
    near = e.select(F.col("cond_id").alias("first_cond"), "chrom", (F.col("pos") - 30).alias("rstart"), (F.col("pos") + 30).alias("rend")).distinct()
    near = iv.merge_overlapping(near, ["first_cond", "chrom"]).select("first_cond", "chrom", "rstart", "rend")
    right = e.join(pairs, "cond_id").select("event_id", "cond_id", "first_cond", "chrom", "pos")
    return iv.points_in_intervals(right, near, ["first_cond", "chrom"]).select("event_id", "cond_id").distinct()


def j06_peak_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a condition and its run's first one whose events lie within 30 bases of each other: distinct events of either side, where more than 25 of the condition do."""
    pairs = _pairs_of_conditions(spark, folder)
    e = cut_lineage(event_points(spark, folder).select("event_id", "cond_id", "chrom", "pos"))
    first = e.join(pairs.select(F.col("first_cond").alias("cond_id")).distinct(), "cond_id", "left_semi")
    right = j06_shared_peaks(spark, folder).join(pairs, "cond_id").groupBy("cond_id", "first_cond").agg(F.count("*").alias("events"))
    near = e.join(pairs, "cond_id").select("cond_id", "first_cond", "chrom", (F.col("pos") - 30).alias("rstart"), (F.col("pos") + 30).alias("rend"))
    near = iv.merge_overlapping(near, ["cond_id", "first_cond", "chrom"]).select(F.col("cond_id").alias("other"), F.col("first_cond").alias("cond_id"), "chrom", "rstart", "rend")
    left = iv.points_in_intervals(first, near, ["cond_id", "chrom"]).select("other", F.col("cond_id").alias("first_cond"), "event_id").distinct()
    left = left.groupBy(F.col("other").alias("cond_id"), "first_cond").agg(F.count("*").alias("first_events"))
    return right.where("events > 25").join(left, ["cond_id", "first_cond"]).select("cond_id", "first_cond", "events", "first_events")


def j07_nearest_event(spark: SparkSession, folder: str) -> DataFrame:
    """Distance from each event to the nearest other one of its condition; null for the only one on a chromosome."""
    n = ls.with_neighbours(event_points(spark, folder), ["cond_id", "chrom"])
    return n.select("event_id", "cond_id", F.least(F.col("pos") - F.col("before"), F.col("after") - F.col("pos")).alias("distance"))


def j08_nearest_in_first(spark: SparkSession, folder: str) -> DataFrame:
    """Distance from each event to the nearest one of its run's first condition."""
    e = event_points(spark, folder)
    right = e.join(_pairs_of_conditions(spark, folder), "cond_id").select("event_id", "cond_id", "first_cond", "chrom", "pos")
    places = e.select(F.col("cond_id").alias("first_cond"), "chrom", F.col("pos").alias("place"))
    return ls.nearest_places(right, places, ["first_cond", "chrom"]).select("event_id", "cond_id", "distance")


def j10_nearest_region(spark: SparkSession, folder: str) -> DataFrame:
    """For each ignored region the nearest start of a current region within 50,000 bases, with its signed distance."""
    x = ignored(spark, folder).select("ignore_id", "chrom", "xstart", (F.col("xstart") - 50_000).alias("rstart"), (F.col("xstart") + 50_000).alias("rend"))
    starts = current_regions(spark, folder).select("region_id", "chrom", F.col("rstart").alias("pos"))
    near = iv.points_in_intervals(starts, x, width=65_536)
    d = F.col("pos") - F.col("xstart")
    best = near.groupBy("ignore_id").agg(F.min(F.struct(F.abs(d).alias("a"), F.col("region_id").alias("region_id"), d.alias("d"))).alias("b"))
    return best.select("ignore_id", "b.region_id", F.col("b.d").alias("distance"))


def u02_starting_points(spark: SparkSession, folder: str) -> DataFrame:
    """Starting positions in each region: event points with flanks of 20 bases on each side inside it, else its middle."""
    r = current_regions(spark, folder).select("region_id", "chrom", "rstart", "rend")
    p = event_points(spark, folder).select("chrom", "pos").distinct()
    held = iv.points_in_intervals(p, r)
    around = held.select("region_id", "rstart", "rend", F.explode(F.array(F.col("pos"), F.col("pos") - 20, F.col("pos") + 20)).alias("position")).where("position between rstart and rend")
    places = around.select("region_id", "position").distinct()
    return r.join(places, "region_id", "left").select("region_id", F.coalesce("position", F.floor((F.col("rstart") + F.col("rend")) / 2)).alias("position"))


def e05_components(spark: SparkSession, folder: str) -> DataFrame:
    """A component every 30 bases of each region, of equal weight."""
    r = current_regions(spark, folder).withColumn("n", F.floor((F.col("rend") - F.col("rstart")) / 30) + 1)
    # in steps, so no row holds the components of a whole region
    at_once = 4096
    r = r.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(at_once).cast("bigint"))))
    r = r.withColumn("_k", F.explode(F.sequence("_from", F.least(F.col("_from") + at_once, "n") - 1)))
    return r.select("region_id", (F.col("rstart") + 30 * F.col("_k")).alias("position"), F.round(1 / F.col("n"), 9).alias("pi"))


def e06_noise_shares(spark: SparkSession, folder: str, h: DataFrame | None = None, r: DataFrame | None = None) -> DataFrame:
    """The share of noise among the signal of each current region: expected hits of its width over its hits, within 0.05 and 0.75; ``h`` is the signal and ``r`` the regions if they are at hand."""
    r = current_regions(spark, folder) if r is None else r
    h = (signal(spark, folder) if h is None else h).select("run_id", "cond_id", "chrom", "pos", "cnt")
    held = iv.points_in_intervals(h, r, ["run_id", "chrom"]).groupBy("region_id", "cond_id").agg(F.sum("cnt").alias("hits"), F.max(F.col("rend") - F.col("rstart") + 1).alias("width"))
    noise = a07_noise_per_base(spark, folder, h)
    share = F.col("noise") / 1e6 * F.col("width") / F.col("hits")
    return held.join(noise, "cond_id").select("region_id", "cond_id", F.round(F.greatest(F.least(share, F.lit(0.75)), F.lit(0.05)), 9).alias("share"))


def u01_all_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of all replicates of a condition at one base and strand."""
    return signal(spark, folder).groupBy("cond_id", "chrom", "pos", "strand").agg(F.sum("cnt").alias("cnt"))


def s19_windows(spark: SparkSession, folder: str) -> DataFrame:
    """A window of 60 bases at the middle of each million bases of the genome, begun ones included, that touches no ignored region."""
    million = F.lit(1_000_000).cast("bigint")
    g = genome(spark, folder).withColumn("_a", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest("len", F.lit(1)), million)))
    g = g.withColumn("_wide", F.least(million, F.col("len") - F.col("_a") + 1)).where("_wide >= 60")
    g = g.withColumn("rstart", F.col("_a") + F.floor((F.col("_wide") - 60) / 2))
    w = g.select(F.concat_ws(":", "chrom", F.col("rstart").cast("string")).alias("window_id"), "chrom", "rstart", (F.col("rstart") + 59).alias("rend"))
    hit = iv.overlapping(w, ignored(spark, folder), "rstart", "rend", "xstart", "xend")
    return w.join(hit.select("window_id").distinct(), "window_id", "left_anti")


QUERIES = {
    f.__name__: f
    for f in (
        a01_landscape, a01_landscape_plus, a02_landscape_by_replicate, a03_binned_starts, m01_thresholds, m02_alphas, w01_potential_regions, w02_split_regions,
        j01_hits_in_regions, a04_counts_inside, a04_control_inside, a05_signal_fraction, a06_region_length, a07_noise_per_base, a08_control_noise, a27_genome,
        f01_without_ignored, f02_clamped, j02_fragments, j03_regions_by_chrom, j04_complement, u04_merged, j05_hits_near_events, j17_regions_with_peaks,
        j06_shared_peaks, j06_peak_groups, j07_nearest_event, j08_nearest_in_first, j10_nearest_region, u02_starting_points, e05_components, e06_noise_shares, u01_all_counts, s19_windows,
    )
}


def _land(keys: str, where: str = "true") -> str:
    return f"""
SELECT {keys}, chrom, b AS bin, sum(cnt) AS hits FROM (
  SELECT *, unnest(range(greatest(CAST(trunc((pos - 1 - 25) / 25.0) AS INTEGER), 0), CAST(trunc((pos - 1) / 25.0) AS INTEGER) + 1)) AS b FROM sig WHERE {where})
GROUP BY {keys}, chrom, b"""


def _thresholds(keys: str, conf: str = "1e-6") -> str:
    return f"""
SELECT {keys}, reads, CAST(min(k) AS INTEGER) AS threshold FROM (
  SELECT *, 1 - coalesce(sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY {keys} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tail FROM (
    SELECT *, unnest(range(0, CAST(ceil(mean + 15 * sqrt(mean) + 60) AS INTEGER) + 1)) AS k FROM (
      SELECT {keys}, sum(cnt) AS reads, sum(cnt) * 50 / ((SELECT sum(len) FROM gen) * 0.8) AS mean FROM sig GROUP BY {keys})))
WHERE k >= 1 AND tail < {conf} GROUP BY {keys}, reads"""


_POT = f"""{HITS}, {GENOME},
land AS ({_land('cond_id')}),
thr AS ({_thresholds('cond_id')}),
wide AS (SELECT land.cond_id, land.chrom, greatest(bin::BIGINT * 25 + 1 - 50, 1) AS rstart, least(bin::BIGINT * 25 + 50, len) AS rend FROM land JOIN thr USING (cond_id) JOIN gen USING (chrom) WHERE hits >= threshold),
pot AS ({islands('wide', 'cond_id, chrom', 'rstart', 'rend')})"""


def _in(channel: str) -> str:
    return f"""
SELECT h.cond_id, h.rep_id, sum(CASE WHEN pot.rstart IS NOT NULL THEN cnt ELSE 0 END) AS inside, sum(CASE WHEN pot.rstart IS NULL THEN cnt ELSE 0 END) AS outside
FROM (SELECT hits.*, cond_id FROM hits JOIN des USING (rep_id) WHERE channel = '{channel}') h
LEFT JOIN pot ON pot.cond_id = h.cond_id AND pot.chrom = h.chrom AND h.pos BETWEEN pot.rstart AND pot.rend GROUP BY ALL"""


_FIRST = """
fst AS (SELECT run_id, min(cond_id) AS first_cond FROM design GROUP BY 1),
prs AS (SELECT DISTINCT cond_id, first_cond FROM design JOIN fst USING (run_id) WHERE cond_id <> first_cond)"""
_POINTS = EVENTS + ", pts AS (SELECT event_id, cond_id, chrom, pos FROM evt WHERE pos IS NOT NULL)"

SQL = {
    "a01_landscape": f"WITH {HITS} {_land('cond_id')}",
    "a01_landscape_plus": f"WITH {HITS} " + _land("cond_id", "strand = '+'"),
    "a02_landscape_by_replicate": f"WITH {HITS} {_land('rep_id')}",
    "a03_binned_starts": f"WITH {HITS} SELECT cond_id, chrom, CAST(floor((pos - 1) / 25.0) AS BIGINT) AS bin, sum(cnt) AS hits FROM sig GROUP BY ALL",
    "m01_thresholds": f"WITH {HITS}, {GENOME} {_thresholds('cond_id')}",
    "m02_alphas": f"""WITH {HITS}, {GENOME}, c AS ({_thresholds('cond_id', '1e-7')}), r AS ({_thresholds('cond_id, rep_id', '1e-7')})
SELECT cond_id, CAST(any_value(c.threshold) AS DOUBLE) AS alpha, CAST(min(r.threshold) AS DOUBLE) AS lenient_alpha FROM c JOIN r USING (cond_id) GROUP BY 1""",
    "w01_potential_regions": f"WITH {_POT} SELECT * FROM pot",
    "w02_split_regions": f"""WITH RECURSIVE {_POT},
rg AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY cond_id, chrom, rstart) AS id FROM pot),
lev AS MATERIALIZED (SELECT id, (bin::BIGINT * 25 + 1 - rstart) // 25 AS k, sum(hits) AS h FROM rg JOIN land USING (cond_id, chrom) WHERE bin::BIGINT * 25 + 1 BETWEEN rstart AND rend GROUP BY ALL),
walk AS (
  SELECT id, rstart AS s, CAST(0 AS BIGINT) AS part FROM rg
  UNION ALL
  SELECT id, rstart + 25 * arg_min(k, (h, k)), part + 1 FROM (
    SELECT c.id, c.rstart, c.part, c.k, coalesce(lev.h, 0) AS h
    FROM (SELECT w.id, w.part, r.rstart, CAST(unnest(range((w.s + 250 - r.rstart) // 25, (w.s + 750 - r.rstart) // 25 + 1)) AS BIGINT) AS k FROM walk w JOIN rg r ON r.id = w.id WHERE r.rend - w.s + 1 >= 750) c
    LEFT JOIN lev ON lev.id = c.id AND lev.k = c.k)
  GROUP BY id, rstart, part)
SELECT cond_id, chrom, s AS rstart, coalesce(lead(s) OVER (PARTITION BY id ORDER BY part) - 1, rend) AS rend, CAST(part AS INTEGER) AS part FROM walk JOIN rg USING (id)""",
    "j01_hits_in_regions": f"""WITH {HITS}, {REGIONS}, s AS (SELECT region_id, sum(cnt) AS hits, sum(CASE WHEN strand = '+' THEN cnt ELSE 0 END) AS plus
FROM reg JOIN sig ON sig.run_id = reg.run_id AND sig.chrom = reg.chrom AND pos BETWEEN rstart AND rend GROUP BY 1)
SELECT region_id, coalesce(hits, 0) AS hits, coalesce(plus, 0) AS plus FROM reg LEFT JOIN s USING (region_id)""",
    "a04_counts_inside": f"WITH {_POT} {_in('signal')}",
    "a04_control_inside": f"WITH {_POT} {_in('control')}",
    "a05_signal_fraction": f"WITH {_POT}, i AS ({_in('signal')}) SELECT rep_id, round(inside / (inside + outside), 9) AS fraction FROM i",
    "a06_region_length": f"WITH {_POT} SELECT cond_id, CAST(sum(rend - rstart + 1) AS BIGINT) AS bases, count(*) AS regions FROM pot GROUP BY 1",
    "a07_noise_per_base": f"""WITH {_POT}, i AS ({_in('signal')}), o AS (SELECT cond_id, sum(outside) AS outside FROM i GROUP BY 1),
l AS (SELECT cond_id, sum(rend - rstart + 1) AS bases FROM pot GROUP BY 1)
SELECT cond_id, round(outside * 1e6 / ((SELECT sum(len) FROM gen) - coalesce(bases, 0)), 9) AS noise FROM o LEFT JOIN l USING (cond_id)""",
    "a08_control_noise": f"""WITH {_POT}, i AS ({_in('signal')}), c AS ({_in('control')}), so AS (SELECT cond_id, sum(outside) AS s FROM i GROUP BY 1), co AS (SELECT cond_id, sum(outside) AS c FROM c GROUP BY 1)
SELECT cond_id, round(coalesce(c / nullif(s, 0), 1), 9) AS ratio FROM so LEFT JOIN co USING (cond_id)""",
    "a27_genome": f"WITH {HITS}, {GENOME} SELECT chrom, max(len) AS len FROM (SELECT chrom, len FROM gen UNION ALL SELECT chrom, CAST(pos AS BIGINT) FROM hits) GROUP BY 1",
    "f01_without_ignored": f"WITH {REGIONS}, {IGNORED} SELECT region_id, chrom, rstart, rend FROM reg WHERE NOT EXISTS (SELECT 1 FROM ign WHERE ign.chrom = reg.chrom AND rstart <= xend AND rend >= xstart)",
    "f02_clamped": f"WITH {REGIONS}, {GENOME} SELECT region_id, least(greatest(rstart - 500, 1), len) AS rstart, least(greatest(rend + 500, 1), len) AS rend FROM reg JOIN gen USING (chrom)",
    "j02_fragments": f"""WITH {REGIONS}, {IGNORED},
ov AS (SELECT region_id, reg.chrom, rstart, rend, xstart, xend, row_number() OVER (PARTITION BY region_id ORDER BY xstart) AS k FROM reg JOIN ign ON ign.chrom = reg.chrom AND rstart <= xend AND rend >= xstart),
fr AS (
  SELECT region_id, chrom, greatest(coalesce(lag(xend) OVER (PARTITION BY region_id ORDER BY xstart) + 1, rstart), rstart) AS s, xstart - 1 AS e FROM ov
  UNION ALL SELECT region_id, any_value(chrom), max(xend) + 1, any_value(rend) FROM ov GROUP BY region_id
  UNION ALL SELECT region_id, chrom, rstart, rend FROM reg WHERE region_id NOT IN (SELECT region_id FROM ov))
SELECT region_id, chrom, s AS rstart, e AS rend FROM fr WHERE s <= e""",
    "j03_regions_by_chrom": f"WITH {REGIONS}, {GENOME} SELECT gen.chrom, len, count(region_id) AS regions, CAST(coalesce(sum(rend - rstart + 1), 0) AS BIGINT) AS bases FROM gen LEFT JOIN reg USING (chrom) GROUP BY ALL",
    "j04_complement": f"""WITH {REGIONS}, {GENOME}, m AS ({islands('reg', 'chrom', 'rstart', 'rend', 1)}),
g AS (SELECT chrom, coalesce(lag(rend) OVER (PARTITION BY chrom ORDER BY rstart), 0) + 1 AS gap_start, rstart - 1 AS gap_end FROM m
UNION ALL SELECT gen.chrom, coalesce(max(rend), 0) + 1, any_value(len) FROM gen LEFT JOIN m USING (chrom) GROUP BY 1)
SELECT * FROM g WHERE gap_start <= gap_end""",
    "u04_merged": f"WITH {REGIONS} {islands('reg', 'run_id, chrom', 'rstart', 'rend')}",
    "j05_hits_near_events": f"""WITH {HITS}, {REGIONS} SELECT region_id, hits.rep_id, channel, sum(cnt) AS hits, count(*) AS bases
FROM reg JOIN des ON des.run_id = reg.run_id JOIN hits ON hits.rep_id = des.rep_id AND hits.chrom = reg.chrom AND pos BETWEEN rstart - 100 AND rend + 100 GROUP BY ALL""",
    "j17_regions_with_peaks": f"WITH {_POINTS}, {REGIONS}, d AS (SELECT DISTINCT chrom, pos FROM pts) SELECT DISTINCT region_id FROM reg JOIN d ON d.chrom = reg.chrom AND pos BETWEEN rstart AND rend",
    "j06_shared_peaks": f"""WITH {_POINTS}, {_FIRST}, a AS (SELECT DISTINCT cond_id AS first_cond, chrom, pos AS place FROM pts)
SELECT DISTINCT event_id, pts.cond_id FROM pts JOIN prs USING (cond_id) JOIN a ON a.first_cond = prs.first_cond AND a.chrom = pts.chrom AND pos BETWEEN place - 30 AND place + 30""",
    "j06_peak_groups": f"""WITH {_POINTS}, {_FIRST}, a AS (SELECT DISTINCT cond_id AS first_cond, event_id AS fe, chrom, pos AS place FROM pts),
m AS (SELECT pts.cond_id, prs.first_cond, event_id, fe FROM pts JOIN prs USING (cond_id) JOIN a ON a.first_cond = prs.first_cond AND a.chrom = pts.chrom AND pos BETWEEN place - 30 AND place + 30)
SELECT cond_id, first_cond, count(DISTINCT event_id) AS events, count(DISTINCT fe) AS first_events FROM m GROUP BY ALL HAVING count(DISTINCT event_id) > 25""",
    "j07_nearest_event": f"""WITH {_POINTS} SELECT event_id, cond_id,
least(pos - lag(pos) OVER (PARTITION BY cond_id, chrom ORDER BY pos), lead(pos) OVER (PARTITION BY cond_id, chrom ORDER BY pos) - pos) AS distance FROM pts""",
    "j08_nearest_in_first": f"""WITH {_POINTS}, {_FIRST}, f AS (SELECT DISTINCT cond_id AS fc, chrom, pos AS at FROM pts),
e AS (SELECT event_id, cond_id, first_cond, chrom, pos FROM pts JOIN prs USING (cond_id))
SELECT event_id, cond_id, least(pos - b.at, a.at - pos) AS distance FROM e ASOF LEFT JOIN f b ON b.fc = e.first_cond AND b.chrom = e.chrom AND e.pos >= b.at
ASOF LEFT JOIN f a ON a.fc = e.first_cond AND a.chrom = e.chrom AND e.pos <= a.at""",
    "j10_nearest_region": f"""WITH {REGIONS}, {IGNORED}, c AS (SELECT ignore_id, region_id, rstart - xstart AS d, row_number() OVER (PARTITION BY ignore_id ORDER BY abs(rstart - xstart), region_id) AS k
FROM ign JOIN reg ON ign.chrom = reg.chrom AND abs(rstart - xstart) <= 50000) SELECT ignore_id, region_id, d AS distance FROM c WHERE k = 1""",
    "u02_starting_points": f"""WITH {_POINTS}, {REGIONS}, d AS (SELECT DISTINCT chrom, pos FROM pts),
s AS (SELECT DISTINCT region_id, position FROM (SELECT region_id, rstart, rend, unnest([pos, pos - 20, pos + 20]) AS position FROM reg JOIN d ON d.chrom = reg.chrom AND pos BETWEEN rstart AND rend) WHERE position BETWEEN rstart AND rend)
SELECT region_id, coalesce(position, (rstart + rend) // 2) AS position FROM reg LEFT JOIN s USING (region_id)""",
    "e05_components": f"WITH {REGIONS} SELECT region_id, unnest(range(rstart, rend + 1, 30)) AS position, round(1.0::DOUBLE / len(range(rstart, rend + 1, 30)), 9) AS pi FROM reg",
    "e06_noise_shares": f"""WITH {_POT}, {REGIONS}, i AS ({_in('signal')}), o AS (SELECT cond_id, sum(outside) AS outside FROM i GROUP BY 1),
l AS (SELECT cond_id, sum(rend - rstart + 1) AS bases FROM pot GROUP BY 1),
n AS (SELECT cond_id, round(outside * 1e6 / ((SELECT sum(len) FROM gen) - coalesce(bases, 0)), 9) AS noise FROM o LEFT JOIN l USING (cond_id)),
h AS (SELECT region_id, cond_id, sum(cnt) AS hits, max(rend - rstart + 1) AS width FROM reg JOIN sig ON sig.run_id = reg.run_id AND sig.chrom = reg.chrom AND pos BETWEEN rstart AND rend GROUP BY ALL)
SELECT region_id, cond_id, round(greatest(least(noise / 1e6 * width / hits, 0.75), 0.05), 9) AS share FROM h JOIN n USING (cond_id)""",
    "u01_all_counts": f"WITH {HITS} SELECT cond_id, chrom, pos, strand, sum(cnt) AS cnt FROM sig GROUP BY ALL",
    "s19_windows": f"""WITH {GENOME}, {IGNORED}, b AS (SELECT chrom, len, unnest(range(1, len + 1, 1000000)) AS a FROM gen),
w AS (SELECT chrom, a + (least(1000000, len - a + 1) - 60) // 2 AS rstart FROM b WHERE len - a + 1 >= 60)
SELECT chrom || ':' || rstart AS window_id, chrom, rstart, rstart + 59 AS rend FROM w WHERE NOT EXISTS (SELECT 1 FROM ign WHERE ign.chrom = w.chrom AND rstart <= xend AND rstart + 59 >= xstart)""",
}
