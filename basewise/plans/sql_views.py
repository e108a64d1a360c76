"""Common table expressions of the SQL checks, the same views that ``sources.tables`` gives."""

HITS = """
hits AS (SELECT DISTINCT rep_id, channel, regexp_replace(chrom, '^chr', '') AS chrom, pos, strand, CAST(cnt AS DOUBLE) AS cnt
         FROM base_counts WHERE cnt > 0 AND NOT isnan(cnt)),
des AS (SELECT DISTINCT rep_id, run_id, cond_id FROM design),
sig AS (SELECT hits.*, run_id, cond_id FROM hits JOIN des USING (rep_id) WHERE channel = 'signal')"""

GENOME = """
gen AS (SELECT regexp_replace(chrom, '^chr', '') AS chrom, max(len) AS len FROM genome_info GROUP BY 1)"""

REGIONS = """
reg AS (
  SELECT region_id, run_id, regexp_replace(chrom, '^chr', '') AS chrom, CAST(least(rstart, rend) AS BIGINT) AS rstart, CAST(greatest(rstart, rend) AS BIGINT) AS rend
  FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY loaded_at DESC NULLS LAST) AS _r FROM test_regions)
  WHERE _r = 1 AND rstart IS NOT NULL AND rend IS NOT NULL AND chrom IS NOT NULL AND region_id IS NOT NULL)"""

IGNORED = """
ign AS (SELECT ignore_id, regexp_replace(chrom, '^chr', '') AS chrom, CAST(xstart AS BIGINT) AS xstart, CAST(xend AS BIGINT) AS xend FROM regions_to_ignore)"""

EVENTS = """
evt AS (
  SELECT *, regexp_replace(string_split(event_point, ':')[1], '^chr', '') AS chrom, TRY_CAST(string_split(event_point, ':')[2] AS BIGINT) AS pos,
    nullif(coalesce(string_split(event_point, ':')[3], ''), '') AS strand
  FROM (SELECT *, row_number() OVER (PARTITION BY event_id, cond_id ORDER BY loaded_at DESC NULLS LAST) AS _r FROM event_cond) WHERE _r = 1)"""

#: 50-base tiles with signal and control of each replicate
TILES = HITS + """,
tiles AS (
  SELECT hits.chrom, hits.pos // 50 AS tile, des.cond_id, des.rep_id,
    sum(CASE WHEN channel = 'signal' THEN cnt ELSE 0 END) AS sig, sum(CASE WHEN channel = 'control' THEN cnt ELSE 0 END) AS ctrl
  FROM hits JOIN des USING (rep_id) GROUP BY ALL)"""


def islands(source: str, keys: str, start: str, end: str, touching: int = 0) -> str:
    """A query for merged intervals of ``source``."""
    return f"""
SELECT {keys}, min({start}) AS rstart, max({end}) AS rend, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY {start}, {end} ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN {start} <= max({end}) OVER (PARTITION BY {keys} ORDER BY {start}, {end} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {touching} THEN 0 ELSE 1 END AS new
    FROM {source}))
GROUP BY {keys}, island"""
