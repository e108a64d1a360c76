"""SQL that DuckDB runs on the same tables, where SQL can say it."""

CURRENT = """
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, cond_id ORDER BY loaded_at DESC NULLS LAST) AS _r FROM event_cond) WHERE _r = 1)"""

VALUES = CURRENT + """,
vals AS (
  SELECT cond_id, loaded_at, 'cond_sig_hits' AS metric, cond_sig_hits AS x FROM cur
  UNION ALL SELECT cond_id, loaded_at, 'cond_sig_v_ctrl_fold', cond_sig_v_ctrl_fold FROM cur),
good AS (SELECT * FROM vals WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x) AND x >= 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cond_id, metric ORDER BY x) AS r, count(*) OVER (PARTITION BY cond_id, metric) AS n FROM good),
q AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.9, 0.99])::DOUBLE AS q),
exact AS (SELECT cond_id, metric, q, n AS n_values, x FROM ranked, q WHERE r = greatest(ceil(q * n), 1))"""

#: the number that has only the highest 20 bits of x, that is 8 bits of the mantissa
LOW = "CASE WHEN x = 0 THEN 0.0 ELSE floor(x / pow(2.0, floor(log2(x)) - 8)) * pow(2.0, floor(log2(x)) - 8) END"

RANKABLE = CURRENT + """,
good AS (SELECT cond_id, region_id, event_id, cond_sig_v_ctrl_p AS p, CASE WHEN cond_sig_hits >= 0 AND NOT isnan(cond_sig_hits) THEN cond_sig_hits END AS hits
         FROM cur WHERE region_id IS NOT NULL AND NOT isnan(cond_sig_v_ctrl_p) AND cond_sig_v_ctrl_p BETWEEN 0 AND 1)"""

BIG = """
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY loaded_at DESC NULLS LAST) AS _r FROM test_regions) WHERE _r = 1),
big AS (
  SELECT region_id, run_id, regexp_replace(chrom, '^chr', '') AS chrom, CAST(least(rstart, rend) AS BIGINT) AS a, CAST(greatest(rstart, rend) AS BIGINT) AS z,
    CAST(CASE WHEN bm_analysis_window_max > 0 THEN bm_analysis_window_max ELSE 2000 END AS BIGINT) AS lim, CAST(greatest(coalesce(piece_overlap, 0), 0) AS BIGINT) AS over
  FROM cur LEFT JOIN run_config USING (run_id)
  WHERE rstart IS NOT NULL AND rend IS NOT NULL
    AND greatest(rstart, rend) - least(rstart, rend) + 1 > CASE WHEN bm_analysis_window_max > 0 THEN bm_analysis_window_max ELSE 2000 END),
runs AS (SELECT DISTINCT rep_id, run_id FROM design),
hits AS (
  SELECT DISTINCT run_id, regexp_replace(chrom, '^chr', '') AS chrom, pos
  FROM base_counts JOIN runs USING (rep_id) WHERE channel = 'signal' AND cnt > 0 AND NOT isnan(cnt)),
inside AS (
  SELECT region_id, pos, lag(pos) OVER (PARTITION BY region_id ORDER BY pos) AS prev
  FROM big JOIN hits ON hits.run_id = big.run_id AND hits.chrom = big.chrom AND pos BETWEEN a AND z)"""

#: cuts of the pieces that begin at s, by level, the last one within reach
_CUT = ", ".join(f"max(least(gz, w.nxt + b.lim - 1)) FILTER (WHERE gz - ga + 1 >= {w}) AS c{w}" for w in (1000, 100, 20, 1))

SQL = {
    "p1_found": f"""
WITH {BIG},
gaps AS (SELECT region_id, prev + 1 AS gap_start FROM inside WHERE pos - prev - 1 >= 100)
SELECT big.region_id, CAST(coalesce(gap_start, 0) AS BIGINT) AS gap_start FROM big LEFT JOIN gaps USING (region_id)""",
    "p1_pieces": f"""
WITH RECURSIVE {BIG},
gaps AS MATERIALIZED (SELECT region_id, CAST(prev + 1 AS BIGINT) AS ga, CAST(pos - 1 AS BIGINT) AS gz FROM inside WHERE pos - prev > 1),
b AS MATERIALIZED (SELECT region_id, a, z, lim, least(over, lim - 1) AS over FROM big),
walk AS (
  SELECT region_id, CAST(0 AS BIGINT) AS piece, a AS s, a AS nxt, CAST(NULL AS BIGINT) AS e, CAST(NULL AS VARCHAR) AS cut FROM b
  UNION ALL
  SELECT region_id, piece + 1, nxt, CASE WHEN nxt + lim - 1 >= z THEN NULL ELSE coalesce(c1000, c100, c20, c1, nxt + lim - 1) + 1 - over END,
    CASE WHEN nxt + lim - 1 >= z THEN z ELSE coalesce(c1000, c100, c20, c1, nxt + lim - 1) END,
    CASE WHEN nxt + lim - 1 >= z THEN 'end' WHEN c1000 IS NOT NULL THEN 'section' WHEN c100 IS NOT NULL THEN 'paragraph' WHEN c20 IS NOT NULL THEN 'sentence' WHEN c1 IS NOT NULL THEN 'word' ELSE 'base' END
  FROM (SELECT w.region_id, w.piece, w.nxt, w.nxt AS s, b.lim, b.over, b.z, {_CUT}
        FROM (SELECT * FROM walk WHERE nxt IS NOT NULL) w JOIN b ON b.region_id = w.region_id
        LEFT JOIN gaps g ON g.region_id = w.region_id AND g.ga - 1 <= w.nxt + b.lim - 1 AND g.gz >= w.nxt + b.over
        GROUP BY ALL))
SELECT region_id, piece - 1 AS piece, s AS piece_start, e AS piece_end, cut FROM walk WHERE piece > 0""",
    "p4_percentiles": f"WITH {VALUES} SELECT cond_id, metric, q, n_values, x AS value FROM exact",
    "p4_daily": f"""WITH {VALUES} SELECT cond_id, CAST(loaded_at AS DATE) AS day, metric, CASE WHEN x = 0 THEN 0 ELSE CAST((floor(log2(x)) + 1023) * 256 + floor((x / pow(2.0, floor(log2(x))) - 1) * 256) AS BIGINT) END AS digit, count(*) AS n
FROM good GROUP BY ALL""",
    "p4_combined": f"WITH {VALUES} SELECT cond_id, metric, q, n_values, {LOW} AS low FROM exact",
    "p5_found": f"""
WITH {RANKABLE},
r AS (SELECT *, row_number() OVER (PARTITION BY cond_id, region_id ORDER BY p, hits DESC NULLS LAST, event_id) AS k FROM good)
SELECT cond_id, region_id, event_id FROM r WHERE k <= 3""",
    "p5_by_region": f"""
WITH {RANKABLE},
r AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY p, hits DESC NULLS LAST, event_id, cond_id) AS k FROM good)
SELECT region_id, CAST(k AS INTEGER) AS rank, cond_id, event_id FROM r WHERE k <= 10""",
}
