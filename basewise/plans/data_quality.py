"""Queries on lines that fail to parse and on keys that hold most rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewise.functions.genome import counts_only, plain_chrom, point_chrom, point_pos
from basewise.operators.hotkeys import heavy_intervals, sums_by_interval
from basewise.sources.lines import rejected, strict_load
from basewise.sources.tables import current_events, genome, table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejected(table(spark, folder, "region_lines"), genome(spark, folder)).select("line_id", "reason")


def p2_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return strict_load(table(spark, folder, "region_lines"), genome(spark, folder)).drop("file_name", "line_no", "line")


def _event_sums(spark: SparkSession, folder: str) -> DataFrame:
    e = current_events(spark, folder, "event_point", "cond_sig_hits")
    points = e.select(point_chrom("event_point").alias("chrom"), point_pos("event_point").alias("pos"), counts_only("cond_sig_hits").alias("value"))
    ignored = table(spark, folder, "regions_to_ignore").select("ignore_id", plain_chrom("chrom").alias("chrom"), "xstart", "xend")
    return sums_by_interval(points, ignored)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_intervals(_event_sums(spark, folder), "ignore_id", 0.02)


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "regions_to_ignore").select("ignore_id")
    sums = ids.join(_event_sums(spark, folder), "ignore_id", "left")
    return sums.select("ignore_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("sig_hits"))


QUERIES = {f.__name__: f for f in (p2_found, p2_loaded, p3_found, p3_counts)}

_FIELD = r'"(?:[^"]|"")*"|[^\t"]*'
_SCORE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_LINES = f"""
s AS (SELECT *, rtrim(line, chr(13) || ' ') AS t FROM region_lines),
rec AS (SELECT * FROM s WHERE t <> '' AND NOT (starts_with(t, '#') OR starts_with(t, 'track ') OR starts_with(t, 'browser '))),
quo AS (SELECT *, regexp_full_match(t, '(?s)(?:{_FIELD})(?:\\t(?:{_FIELD}))*') AS ok FROM rec),
fld AS (
  SELECT *, CASE WHEN ok THEN list_transform(regexp_extract_all(chr(9) || t, '(?s)\\t({_FIELD})', 1),
    lambda f: CASE WHEN starts_with(f, '"') THEN replace(substr(f, 2, length(f) - 2), '""', '"') ELSE f END) END AS f FROM quo),
col AS (
  SELECT *, ok AND CASE file_kind WHEN 'exclude' THEN len(f) = 1 WHEN 'excludebed' THEN len(f) BETWEEN 3 AND 6 WHEN 'peak' THEN len(f) = 3 WHEN 'motif' THEN len(f) = 4 ELSE false END AS fits FROM fld),
place AS (SELECT *, string_split(f[1], ':') AS p FROM col),
val AS (
  SELECT *, string_split(p[2], '-') AS ab,
    CASE WHEN file_kind = 'excludebed' THEN f[1] ELSE p[1] END AS c,
    CASE file_kind WHEN 'excludebed' THEN f[2] WHEN 'peak' THEN p[2] ELSE string_split(p[2], '-')[1] END AS a,
    CASE file_kind WHEN 'excludebed' THEN f[3] WHEN 'peak' THEN p[2] ELSE string_split(p[2], '-')[2] END AS b,
    CASE WHEN file_kind = 'excludebed' THEN f[6] WHEN file_kind <> 'exclude' THEN p[3] END AS st,
    CASE WHEN file_kind = 'excludebed' THEN f[5] WHEN file_kind <> 'exclude' THEN f[3] END AS sc,
    CASE WHEN file_kind = 'excludebed' THEN f[4] WHEN file_kind <> 'exclude' THEN f[2] END AS nm,
    CASE WHEN file_kind = 'motif' THEN f[4] END AS sq
  FROM place),
num AS (
  SELECT *, CASE WHEN regexp_full_match(a, '[0-9]+') THEN TRY_CAST(a AS HUGEINT) END AS ai, CASE WHEN regexp_full_match(b, '[0-9]+') THEN TRY_CAST(b AS HUGEINT) END AS bi FROM val),
g AS (SELECT regexp_replace(chrom, '^chr', '') AS gc, max(len) AS len FROM genome_info GROUP BY 1),
chk AS (
  SELECT num.*, gc, coalesce(fits AND CASE file_kind
      WHEN 'exclude' THEN len(p) = 2 AND len(ab) = 2 AND 1 <= ai AND ai <= bi AND bi <= g.len
      WHEN 'peak' THEN (len(p) = 2 OR (len(p) = 3 AND st IN ('+', '-'))) AND regexp_matches(sc, '{_SCORE}') AND 1 <= ai AND ai <= g.len
      WHEN 'motif' THEN len(p) = 3 AND len(ab) = 2 AND st IN ('+', '-') AND regexp_matches(sc, '{_SCORE}') AND regexp_full_match(sq, '[ACGTNacgtn]+') AND 1 <= ai AND ai <= bi AND bi <= g.len
      WHEN 'excludebed' THEN (sc IS NULL OR sc = '.' OR regexp_matches(sc, '{_SCORE}')) AND (st IS NULL OR st IN ('+', '-', '.')) AND 0 <= ai AND ai < bi AND bi <= g.len
    END, false) AS valid
  FROM num LEFT JOIN g ON regexp_replace(c, '^chr', '') = gc)"""

_SUMS = """
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, cond_id ORDER BY loaded_at DESC NULLS LAST) AS _r FROM event_cond) WHERE _r = 1),
pts AS (
  SELECT regexp_replace(string_split(event_point, ':')[1], '^chr', '') AS chrom, TRY_CAST(string_split(event_point, ':')[2] AS BIGINT) AS pos,
    CASE WHEN cond_sig_hits >= 0 AND NOT isnan(cond_sig_hits) AND NOT isinf(cond_sig_hits) THEN cond_sig_hits END AS v
  FROM cur),
ign AS (SELECT ignore_id, regexp_replace(chrom, '^chr', '') AS chrom, xstart, xend FROM regions_to_ignore),
sums AS (SELECT ignore_id, count(*) AS n, sum(v) AS v FROM pts JOIN ign ON pts.chrom = ign.chrom AND pos BETWEEN xstart AND xend GROUP BY 1)"""

SQL = {
    "p2_found": f"WITH {_LINES} SELECT line_id, CASE WHEN NOT ok THEN 'quoting' WHEN NOT fits THEN 'columns' ELSE 'value' END AS reason FROM chk WHERE NOT valid",
    "p2_loaded": f"""WITH {_LINES} SELECT line_id, file_kind, gc AS chrom, CAST(CASE WHEN file_kind = 'excludebed' THEN ai + 1 ELSE ai END AS BIGINT) AS rstart,
      CAST(bi AS BIGINT) AS rend, nullif(st, '.') AS strand, nm AS name, TRY_CAST(sc AS DOUBLE) AS score, sq AS sequence FROM chk WHERE valid""",
    "p3_found": f"WITH {_SUMS} SELECT ignore_id FROM sums WHERE n >= 0.02 * (SELECT count(*) FROM cur)",
    "p3_counts": f"WITH {_SUMS} SELECT ign.ignore_id, coalesce(n, 0) AS n_rows, round(coalesce(v, 0), 2) AS sig_hits FROM ign LEFT JOIN sums USING (ignore_id)",
}
