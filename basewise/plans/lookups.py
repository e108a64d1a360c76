"""Filters, lookups and formatted columns of events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewise.functions.genome import counts_only
from basewise.operators import intervals as iv
from basewise.operators import landscape as ls
from basewise.operators import reports as rp
from basewise.operators.ordered import numbered
from basewise.plans.data_quality import _LINES
from basewise.plans.events import _EV, events
from basewise.plans.profiles import _COMP, _composite
from basewise.plans.regions import _POT, _potential, m02_alphas, signal
from basewise.plans.regions import SQL as REGION_SQL
from basewise.plans.sql_views import GENOME, HITS, REGIONS
from basewise.sources.lines import strict_load
from basewise.sources.tables import current_regions, genome, table


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder).where("pos is not null and region_id is not null").select("event_id", "cond_id", "region_id", "chrom", "pos")
    r = current_regions(spark, folder).select("region_id", F.col("chrom").alias("_c"), "rstart", "rend")
    return e.join(r, "region_id").where("chrom = _c").drop("_c")


def f04_away_from_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Events more than 25 bases from both ends of their region."""
    return _placed(spark, folder).where("pos - rstart > 25 and rend - pos > 25").select("event_id", "cond_id")


def f05_supported(spark: SparkSession, folder: str) -> DataFrame:
    """Events with more than 3 alpha of signal."""
    e = events(spark, folder).select("event_id", "cond_id", counts_only("sig").alias("hits"))
    return e.join(m02_alphas(spark, folder), "cond_id").where("hits > 3 * alpha").select("event_id", "cond_id")


def f12_contained(spark: SparkSession, folder: str) -> DataFrame:
    """Places of events whose window of 50 bases lies within one current region."""
    p = events(spark, folder).where("pos is not null").select("chrom", "pos").distinct()
    held = iv.points_in_intervals(p, current_regions(spark, folder).select("region_id", "chrom", "rstart", "rend"))
    return held.where("pos - 25 >= rstart and pos + 25 <= rend").select("chrom", "pos").distinct()


def f13_large_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Conditions with at least 50 reported events and 5 % of all."""
    n = events(spark, folder).where(F.col("found") & (F.col("q") <= 0.01)).groupBy("cond_id").agg(F.count("*").alias("n"))
    return n.where(F.col("n") >= F.greatest(F.lit(50.0), n.agg(F.sum("n") * 0.05).scalar()))


def p05_dominant(spark: SparkSession, folder: str) -> DataFrame:
    """The condition with most hits of each event; the first wins ties."""
    e = events(spark, folder).select("event_id", "cond_id", F.coalesce(counts_only("sig"), F.lit(0.0)).alias("hits"))
    return e.groupBy("event_id").agg(F.max(F.struct("hits", (-F.col("cond_id")).alias("c"))).alias("b")).select("event_id", (-F.col("b.c")).alias("cond_id"), F.col("b.hits").alias("hits"))


def p07_found_in(spark: SparkSession, folder: str) -> DataFrame:
    return rp.found_in(events(spark, folder), ["event_id"], "cond_id", "found")


def p09_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 60 bases around events, clipped to the chromosome, with their label."""
    e = events(spark, folder).where("pos is not null").join(genome(spark, folder), "chrom")
    a, z = F.greatest(F.col("pos") - 30, F.lit(1)), F.least(F.col("pos") + 29, F.col("len"))
    return e.select("event_id", "cond_id", F.format_string(">%s:%d-%d", "chrom", a, z).alias("label"))


def p10_aligned(spark: SparkSession, folder: str) -> DataFrame:
    """Points moved by a motif offset of 7 along their strand, which flips for a reverse motif (conditions of even number)."""
    e = events(spark, folder).where("pos is not null")
    minus = F.coalesce(F.col("strand"), F.lit("+")) == "-"
    strand = F.when(minus == (F.col("cond_id") % 2 == 0), "+").otherwise("-")
    return e.select("event_id", "cond_id", F.when(minus, F.col("pos") - 7).otherwise(F.col("pos") + 7).alias("pos"), strand.alias("strand"))


def j09_nearest_motif(spark: SparkSession, folder: str) -> DataFrame:
    """Distance from each event to the nearest middle of a motif region that loads."""
    m = strict_load(table(spark, folder, "region_lines").where("file_kind = 'motif'"), genome(spark, folder))
    places = m.select("chrom", F.floor((F.col("rstart") + F.col("rend")) / 2).alias("place"))
    return ls.nearest_places(events(spark, folder).where("pos is not null").select("event_id", "cond_id", "chrom", "pos"), places, ["chrom"]).select("event_id", "cond_id", "distance")


def a19_distinct_bases(spark: SparkSession, folder: str) -> DataFrame:
    h = signal(spark, folder)
    return h.select("cond_id", "chrom", "pos").distinct().groupBy("cond_id").agg(F.count("*").alias("bases"))


def u03_without_events(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder).where("found").select("region_id")
    return current_regions(spark, folder).join(e, "region_id", "left_anti").select("region_id")


def u05_distinct_points(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).where("pos is not null").select("chrom", "pos", F.coalesce("strand", F.lit("+")).alias("strand")).distinct()


def w09_half_height(spark: SparkSession, folder: str) -> DataFrame:
    """First and last offset of each condition's profile at half of its peak or more."""
    c = _composite(spark, folder)
    top = c.groupBy("cond_id").agg(F.max("value").alias("top"))
    return c.join(top, "cond_id").where("value >= top / 2").groupBy("cond_id").agg(F.min("offset").alias("first"), F.max("offset").alias("last"))


def w10_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each region and condition numbered along the region."""
    e = _placed(spark, folder).select("region_id", "cond_id", "event_id", "pos")
    return numbered(e, ["region_id", "cond_id"], [F.col("pos"), F.col("event_id")], "component").drop("pos")


def o04_by_location(spark: SparkSession, folder: str) -> DataFrame:
    """All events along the genome, chromosomes in order of their names."""
    return events(spark, folder).where("pos is not null").orderBy("chrom", "pos", "event_id", "cond_id").select("event_id", "cond_id", "chrom", "pos")


def k01_region_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Potential regions as lines of ``chrom:start-end``."""
    return _potential(spark, folder).select("cond_id", F.format_string("%s:%d-%d", "chrom", "rstart", "rend").alias("line"))


def k21_reads_around_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Signal around the middle of each run's regions in bins of 100 bases, up to 1,000 on each side."""
    r = current_regions(spark, folder).withColumn("mid", F.floor((F.col("rstart") + F.col("rend")) / 2))
    r = r.select("run_id", "chrom", "mid", (F.col("mid") - 1000).alias("a"), (F.col("mid") + 999).alias("z"))
    h = signal(spark, folder).groupBy("run_id", "chrom", "pos").agg(F.sum("cnt").alias("cnt"))
    j = iv.points_in_intervals(h, r, ["run_id", "chrom"], start="a", end="z")
    return j.groupBy("run_id", (F.floor((F.col("pos") - F.col("mid")) / 100) * 100).alias("bin")).agg(F.sum("cnt").alias("hits"))


QUERIES = {
    f.__name__: f
    for f in (
        f04_away_from_edges, f05_supported, f12_contained, f13_large_groups, p05_dominant, p07_found_in, p09_windows, p10_aligned, j09_nearest_motif, a19_distinct_bases, u03_without_events,
        u05_distinct_points, w09_half_height, w10_numbered, o04_by_location, k01_region_lines, k21_reads_around_regions,
    )
} | {"o04_all_by_location": o04_by_location}

_PLACED = f"{_EV}, {REGIONS}, pl AS (SELECT event_id, cond_id, e.region_id, pos, rstart, rend FROM e JOIN reg ON reg.region_id = e.region_id AND reg.chrom = e.chrom WHERE pos IS NOT NULL)"


SQL = {
    "f04_away_from_edges": f"WITH {_PLACED} SELECT event_id, cond_id FROM pl WHERE pos - rstart > 25 AND rend - pos > 25",
    "f05_supported": f"WITH {_EV}, al AS ({REGION_SQL["m02_alphas"]}) SELECT event_id, e.cond_id FROM e JOIN al USING (cond_id) WHERE hits > 3 * alpha",
    "f12_contained": f"WITH {_EV}, {REGIONS}, d AS (SELECT DISTINCT chrom, pos FROM e WHERE pos IS NOT NULL) SELECT DISTINCT d.chrom, pos FROM d JOIN reg ON reg.chrom = d.chrom AND pos - 25 >= rstart AND pos + 25 <= rend",
    "f13_large_groups": f"WITH {_EV}, n AS (SELECT cond_id, count(*) AS n FROM e WHERE found AND q <= 0.01 GROUP BY 1) SELECT * FROM n WHERE n >= greatest(50, (SELECT sum(n) * 0.05::DOUBLE FROM n))",
    "p05_dominant": f"WITH {_EV} SELECT event_id, cond_id, h AS hits FROM (SELECT *, coalesce(hits, 0) AS h, row_number() OVER (PARTITION BY event_id ORDER BY coalesce(hits, 0) DESC, cond_id) AS k FROM e) WHERE k = 1",
    "p07_found_in": f"WITH {_EV} SELECT event_id, string_agg(CASE WHEN found THEN '1' ELSE '0' END, ',' ORDER BY cond_id) AS found_in FROM e GROUP BY 1",
    "p09_windows": f"WITH {_EV}, {GENOME} SELECT event_id, cond_id, '>' || chrom || ':' || greatest(pos - 30, 1) || '-' || least(pos + 29, len) AS label FROM e JOIN gen USING (chrom) WHERE pos IS NOT NULL",
    "p10_aligned": f"""WITH {_EV}, s AS (SELECT e.event_id, e.cond_id, e.pos, coalesce(evt.strand, '+') = '-' AS minus FROM e JOIN evt USING (event_id, cond_id) WHERE e.pos IS NOT NULL)
SELECT event_id, cond_id, CASE WHEN minus THEN pos - 7 ELSE pos + 7 END AS pos, CASE WHEN minus = (cond_id % 2 = 0) THEN '+' ELSE '-' END AS strand FROM s""",
    "j09_nearest_motif": f"""WITH {_EV}, {_LINES}, m AS (SELECT DISTINCT gc AS chrom, CAST((ai + bi) // 2 AS BIGINT) AS place FROM chk WHERE valid AND file_kind = 'motif'),
x AS (SELECT event_id, cond_id, chrom, pos FROM e WHERE pos IS NOT NULL)
SELECT event_id, cond_id, least(pos - b.place, a.place - pos) AS distance FROM x ASOF LEFT JOIN m b ON b.chrom = x.chrom AND x.pos >= b.place ASOF LEFT JOIN m a ON a.chrom = x.chrom AND x.pos <= a.place""",
    "a19_distinct_bases": f"WITH {HITS}, d AS (SELECT DISTINCT cond_id, chrom, pos FROM sig) SELECT cond_id, count(*) AS bases FROM d GROUP BY 1",
    "u03_without_events": f"WITH {_EV}, {REGIONS} SELECT region_id FROM reg WHERE NOT EXISTS (SELECT 1 FROM e WHERE found AND e.region_id = reg.region_id)",
    "u05_distinct_points": f"WITH {_EV} SELECT DISTINCT e.chrom, e.pos, coalesce(evt.strand, '+') AS strand FROM e JOIN evt USING (event_id, cond_id) WHERE e.pos IS NOT NULL",
    "w09_half_height": f'WITH {_COMP}, t AS (SELECT *, max(value) OVER (PARTITION BY cond_id) AS top FROM cmp) SELECT cond_id, min("offset") AS first, max("offset") AS last FROM t WHERE value >= top / 2 GROUP BY 1',
    "w10_numbered": f"WITH {_PLACED} SELECT region_id, cond_id, event_id, CAST(row_number() OVER (PARTITION BY region_id, cond_id ORDER BY pos, event_id) AS INTEGER) AS component FROM pl",
    "o04_by_location": f"WITH {_EV} SELECT event_id, cond_id, chrom, pos FROM e WHERE pos IS NOT NULL ORDER BY chrom, pos, event_id, cond_id",
    "o04_all_by_location": f"WITH {_EV} SELECT event_id, cond_id, chrom, pos FROM e WHERE pos IS NOT NULL ORDER BY chrom, pos, event_id, cond_id",
    "k01_region_lines": f"WITH {_POT} SELECT cond_id, chrom || ':' || rstart || '-' || rend AS line FROM pot",
    "k21_reads_around_regions": f"""WITH {HITS}, {REGIONS}, m AS (SELECT run_id, chrom, (rstart + rend) // 2 AS mid FROM reg)
SELECT m.run_id, CAST(floor((pos - mid) / 100.0) * 100 AS BIGINT) AS bin, sum(cnt) AS hits FROM m JOIN sig ON sig.run_id = m.run_id AND sig.chrom = m.chrom AND pos BETWEEN mid - 1000 AND mid + 999 GROUP BY ALL""",
}
