"""Sequences of motif lines and ROC areas, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewise.operators import sequences as sq
from basewise.operators.intervals import points_in_intervals
from basewise.operators.profiles import rank_percentile
from basewise.plans.data_quality import _LINES
from basewise.plans.events import _EV, events
from basewise.plans.sql_views import EVENTS
from basewise.sources.lines import strict_load
from basewise.sources.tables import genome, table

def motif_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """``line_id, sequence`` of the motif lines that load."""
    return strict_load(table(spark, folder, "region_lines").where("file_kind = 'motif'"), genome(spark, folder)).select("line_id", "sequence")


def f11_low_repeat(spark: SparkSession, folder: str) -> DataFrame:
    s = motif_sequences(spark, folder)
    return s.select("line_id", F.round(sq.repeat_fraction(F.col("sequence")), 9).alias("repeats")).where("repeats <= 0.2")


def o02_first_low_repeat(spark: SparkSession, folder: str) -> DataFrame:
    """The first 1000 low-repeat sequences in order."""
    return f11_low_repeat(spark, folder).orderBy("line_id").limit(1000)


def t05_reverse_complement(spark: SparkSession, folder: str) -> DataFrame:
    return motif_sequences(spark, folder).select("line_id", sq.reverse_complement(F.col("sequence")).alias("reversed"))


def t07_base_index(spark: SparkSession, folder: str) -> DataFrame:
    """How often each base index occurs; letters other than ACGT have -1."""
    l = sq.letters(motif_sequences(spark, folder), ["line_id"])
    return l.groupBy(sq.base_index(F.col("base")).alias("index")).agg(F.count("*").alias("n"))


def a25_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return sq.frequency_matrix(motif_sequences(spark, folder))


def a24_information(spark: SparkSession, folder: str) -> DataFrame:
    return sq.information(a25_frequencies(spark, folder)).select("position", F.round("bits", 9).alias("bits"))


def t06_consensus(spark: SparkSession, folder: str) -> DataFrame:
    return sq.consensus(a25_frequencies(spark, folder))


def _matched(spark: SparkSession, folder: str) -> DataFrame:
    s = motif_sequences(spark, folder)
    return sq.best_match(s, sq.motif_weights(s))


def t01_best_match(spark: SparkSession, folder: str) -> DataFrame:
    """The score of the best place of each motif in each sequence; a motif is the matrix of all sequences of one length."""
    return _matched(spark, folder).select("line_id", "motif", F.round("score", 6).alias("score"))


def t02_matched_words(spark: SparkSession, folder: str) -> DataFrame:
    return _matched(spark, folder).select("line_id", "motif", "start", "strand", "kmer")


def t04_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """For each motif the score that 5 % of random sequences of the same bases reach; one random sequence of 20 bases for each given one."""
    s = motif_sequences(spark, folder)
    r = sq.random_sequences(s.withColumnRenamed("line_id", "id"), sq.markov_model(s), 20)
    return rank_percentile(sq.best_match(r, sq.motif_weights(s)), ["motif"], "score", 0.95)


def t03_over_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences whose best place of a motif scores at least its threshold."""
    m = _matched(spark, folder).join(t04_threshold(spark, folder), "motif")
    return m.where("score >= value").select("line_id", "motif", "start", "strand")


def s03_markov(spark: SparkSession, folder: str) -> DataFrame:
    return sq.markov_model(motif_sequences(spark, folder)).withColumn("p", F.round("p", 9))


def s20_random_sequences(spark: SparkSession, folder: str) -> DataFrame:
    s = motif_sequences(spark, folder)
    return sq.random_sequences(s.withColumnRenamed("line_id", "id"), sq.markov_model(s), 60)


def e16_motif(spark: SparkSession, folder: str) -> DataFrame:
    """The motif fitted on all sequences, by position."""
    p, _ = sq.fit_motif(motif_sequences(spark, folder))
    return spark.createDataFrame([(k, *row) for k, row in enumerate(p)], "position int, a double, c double, g double, t double")


def e09_motifs(spark: SparkSession, folder: str) -> DataFrame:
    """Motifs found one after the other among the sequences that no motif before explains, by position; the last one tried may not be kept."""
    found = sq.discover_motifs(motif_sequences(spark, folder))
    rows = [(m, k, *row, d["auc"], d["references"], d["removed"], d["kept"]) for m, d in enumerate(found) for k, row in enumerate(d["p"])]
    return spark.createDataFrame(rows, "motif int, position int, a double, c double, g double, t double, auc double, references bigint, removed bigint, kept boolean")


def e13_motif_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Offset and orientation of the motif of each length against the shortest one (M30)."""
    return sq.align_motifs(sq.motif_frequencies(motif_sequences(spark, folder)))


def j18_motif_scores(spark: SparkSession, folder: str) -> DataFrame:
    """For each event inside a listed motif region the score of that region's sequence under the motif of its length, forward and reverse, by the event's offset in it."""
    lines = strict_load(table(spark, folder, "region_lines").where("file_kind = 'motif'"), genome(spark, folder)).select("line_id", "chrom", "rstart", "rend", "sequence")
    own = sq.best_match(lines.select("line_id", "chrom", "rstart", "rend", "sequence"), sq.motif_weights(lines), both=True).where(F.col("motif") == F.length("sequence"))
    e = events(spark, folder).where("pos is not null").select("event_id", "cond_id", "chrom", "pos")
    held = points_in_intervals(e, own.select("line_id", "chrom", "rstart", "rend", "plus", "minus"))
    return held.select("event_id", "cond_id", "line_id", (F.col("pos") - F.col("rstart")).alias("offset"), F.round("plus", 6).alias("plus"), F.round("minus", 6).alias("minus"))


def _graded(spark: SparkSession, folder: str) -> DataFrame:
    f = F.col("fold")
    return events(spark, folder).where((f >= 0) & ~F.isnan(f) & (f < float("inf"))).select("cond_id", "fold", "found")


def a23_auc(spark: SparkSession, folder: str) -> DataFrame:
    a = sq.roc_auc(_graded(spark, folder), ["cond_id"], "fold", F.col("found"))
    return a.withColumn("auc", F.round("auc", 9))


def w06_roc(spark: SparkSession, folder: str) -> DataFrame:
    return sq.roc_curve(_graded(spark, folder), ["cond_id"], "fold", F.col("found"))


QUERIES = {
    f.__name__: f
    for f in (
        f11_low_repeat, o02_first_low_repeat, t05_reverse_complement, t07_base_index, a25_frequencies, a24_information, t06_consensus, t01_best_match, t02_matched_words, t04_threshold,
        t03_over_threshold, s03_markov, s20_random_sequences, e09_motifs, e13_motif_offsets, j18_motif_scores, e16_motif, a23_auc, w06_roc,
    )
} | {"a25_all_frequencies": a25_frequencies, "a24_all_information": a24_information, "t06_whole_consensus": t06_consensus}

_SEQ = f"""{_LINES},
sqn AS (SELECT line_id, sq AS s FROM chk WHERE valid AND file_kind = 'motif'),
let AS (SELECT line_id, i - 1 AS position, upper(s[i]) AS b FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM sqn)),
frq AS (SELECT CAST(position AS INTEGER) AS position, count(*) FILTER (WHERE b = 'A') AS a, count(*) FILTER (WHERE b = 'C') AS c, count(*) FILTER (WHERE b = 'G') AS g, count(*) FILTER (WHERE b = 'T') AS t
        FROM let GROUP BY 1)"""
_REP = "round((length(s) - length(regexp_replace(s, '[a-zN]', '', 'g'))) / length(s)::DOUBLE, 9)"
_TERM = " + ".join(f"coalesce({b} / n * log2(nullif({b} / n, 0) / 0.25), 0)" for b in "acgt")
_PWM = f"""
lsq AS (SELECT let.*, length(s) AS n FROM let JOIN sqn USING (line_id)),
pwm AS (SELECT n AS motif, position, unnest(['A', 'C', 'G', 'T']) AS b, unnest([a, c, g, t]) AS k, a + c + g + t + 0.04 AS tot FROM (
  SELECT n, position, count(*) FILTER (WHERE b = 'A') AS a, count(*) FILTER (WHERE b = 'C') AS c, count(*) FILTER (WHERE b = 'G') AS g, count(*) FILTER (WHERE b = 'T') AS t FROM lsq GROUP BY ALL)),
lod AS (SELECT motif, position, b, log2((k + 0.01::DOUBLE) / tot / 0.25) AS w FROM pwm),
lo AS (SELECT motif, position, min(w) AS least FROM lod GROUP BY ALL),
cel AS (
  SELECT line_id, lo.motif, l.position - lo.position AS start, sum(coalesce(f.w, least)) AS plus
  FROM lsq l JOIN lo ON lo.motif <= l.n AND l.position - lo.position BETWEEN 0 AND l.n - lo.motif LEFT JOIN lod f ON f.motif = lo.motif AND f.position = lo.position AND f.b = l.b GROUP BY ALL),
cem AS (
  SELECT line_id, lo.motif, l.position - (lo.motif - 1 - lo.position) AS start, sum(coalesce(f.w, least)) AS minus
  FROM lsq l JOIN lo ON lo.motif <= l.n AND l.position - (lo.motif - 1 - lo.position) BETWEEN 0 AND l.n - lo.motif
  LEFT JOIN lod f ON f.motif = lo.motif AND f.position = lo.position AND f.b = translate(l.b, 'ACGT', 'TGCA') GROUP BY ALL),
bst AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line_id, motif ORDER BY sc DESC, start, strand) AS k
    FROM (SELECT line_id, motif, start, round(plus, 9) AS sc, '+' AS strand FROM cel UNION ALL SELECT line_id, motif, start, round(minus, 9), '-' FROM cem)) WHERE k = 1)"""
_EVENTS_ONLY = EVENTS + ", evp AS (SELECT * FROM evt WHERE pos IS NOT NULL)"
_GRADED = _EV + ", gr AS (SELECT cond_id, fold, found FROM e WHERE fold >= 0 AND NOT isnan(fold) AND NOT isinf(fold)), gs AS (SELECT cond_id, fold, count(*) FILTER (WHERE found) AS p, count(*) FILTER (WHERE NOT found) AS n FROM gr GROUP BY ALL)"

SQL = {
    "f11_low_repeat": f"WITH {_SEQ} SELECT line_id, {_REP} AS repeats FROM sqn WHERE {_REP} <= 0.2",
    "o02_first_low_repeat": f"WITH {_SEQ} SELECT line_id, {_REP} AS repeats FROM sqn WHERE {_REP} <= 0.2 ORDER BY line_id LIMIT 1000",
    "t05_reverse_complement": f"WITH {_SEQ} SELECT line_id, reverse(translate(s, 'ACGTacgt', 'TGCAtgca')) AS reversed FROM sqn",
    "t07_base_index": f"WITH {_SEQ} SELECT CAST(instr('ACGT', b) - 1 AS INTEGER) AS index, count(*) AS n FROM let GROUP BY 1",
    "a25_frequencies": f"WITH {_SEQ} SELECT * FROM frq",
    "a24_information": f"WITH {_SEQ}, x AS (SELECT *, (a + c + g + t)::DOUBLE AS n FROM frq) SELECT position, round({_TERM}, 9) AS bits FROM x",
    "t06_consensus": f"WITH {_SEQ} SELECT string_agg(CASE greatest(a, c, g, t) WHEN a THEN 'A' WHEN c THEN 'C' WHEN g THEN 'G' ELSE 'T' END, '' ORDER BY position) AS consensus FROM frq",
    "t01_best_match": f"WITH {_SEQ}, {_PWM} SELECT line_id, CAST(motif AS INTEGER) AS motif, round(sc, 6) AS score FROM bst",
    "t02_matched_words": f"""WITH {_SEQ}, {_PWM} SELECT line_id, CAST(motif AS INTEGER) AS motif, CAST(start AS INTEGER) AS start, strand,
CASE WHEN strand = '-' THEN reverse(translate(substr(s, start + 1, motif), 'ACGTacgt', 'TGCAtgca')) ELSE substr(s, start + 1, motif) END AS kmer FROM bst JOIN sqn USING (line_id)""",
    "j18_motif_scores": f"""WITH {_SEQ}, {_PWM}, {_EVENTS_ONLY}, l AS (SELECT line_id, gc, CAST(ai AS BIGINT) AS a, CAST(bi AS BIGINT) AS z, sq FROM chk WHERE valid AND file_kind = 'motif'),
o AS (SELECT line_id, gc, a, z, round(any_value(plus), 6) AS plus, round(any_value(minus), 6) AS minus FROM l JOIN cel USING (line_id) JOIN cem USING (line_id, motif, start) WHERE motif = length(sq) AND start = 0 GROUP BY ALL)
SELECT event_id, cond_id, line_id, pos - a AS "offset", plus, minus FROM evp JOIN o ON evp.chrom = gc AND pos BETWEEN a AND z""",
    "e13_motif_offsets": f"""WITH {_SEQ}, {_PWM},
fq AS (SELECT motif, position, list((k + 0.01) / tot ORDER BY b) AS f FROM pwm GROUP BY ALL),
ln AS (SELECT motif, CAST(max(position) + 1 AS BIGINT) AS n FROM fq GROUP BY 1),
rf AS (SELECT position AS lv, f AS rf FROM fq WHERE motif = (SELECT min(motif) FROM fq)),
tg AS (SELECT motif, n, position, f, false AS rev FROM fq JOIN ln USING (motif) UNION ALL SELECT motif, n, n - 1 - position, list_reverse(f), true FROM fq JOIN ln USING (motif)),
pl AS (SELECT motif, unnest(range(0, n - (SELECT min(n) FROM ln) + 1)) AS place FROM ln),
cr AS (SELECT motif, n, rev, place, list_transform(rf, lambda x: x - list_avg(rf)) AS a, list_transform(f, lambda x: x - list_avg(f)) AS b FROM pl JOIN tg USING (motif) JOIN rf ON lv = position - place),
sc AS (SELECT motif, n, rev, place, round(sum(coalesce(list_dot_product(a, b) / nullif(sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 0), 0)), 9) AS score FROM cr GROUP BY ALL),
bs AS (SELECT *, row_number() OVER (PARTITION BY motif ORDER BY score DESC, rev, place) AS k, (SELECT min(n) FROM ln) AS m FROM sc)
SELECT CAST(motif AS INTEGER) AS motif, CAST(place - (n - m) // 2 - CASE WHEN rev AND n % 2 = 0 AND m % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS "offset", rev AS reverse, score FROM bs WHERE k = 1""",
    "s03_markov": f"""WITH {_SEQ}, m AS (SELECT a.b AS context, z.b AS base FROM let a JOIN let z ON z.line_id = a.line_id AND z.position = a.position + 1 WHERE instr('ACGT', a.b) > 0 AND instr('ACGT', z.b) > 0),
c AS (SELECT context, base, count(*) AS n FROM m GROUP BY ALL) SELECT context, base, round(n / sum(n) OVER (PARTITION BY context), 9) AS p FROM c""",
    "a23_auc": f"""WITH {_GRADED}, r AS (SELECT *, sum(p) OVER (PARTITION BY cond_id ORDER BY fold DESC) - p AS before FROM gs)
SELECT cond_id, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, round(CASE WHEN sum(p) = 0 THEN 0 WHEN sum(n) = 0 THEN 1 ELSE sum(n * (before + p / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n)) END, 9) AS auc FROM r GROUP BY 1""",
    "w06_roc": f"WITH {_GRADED} SELECT cond_id, fold AS score, CAST(sum(p) OVER w AS BIGINT) AS true_positives, CAST(sum(n) OVER w AS BIGINT) AS false_positives FROM gs WINDOW w AS (PARTITION BY cond_id ORDER BY fold DESC)",
}
SQL |= {"a25_all_frequencies": SQL["a25_frequencies"], "a24_all_information": SQL["a24_information"], "t06_whole_consensus": SQL["t06_consensus"]}
