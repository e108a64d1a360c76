"""Composite profiles and profile similarity, with their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewise.operators import clustering as cl
from basewise.operators import profiles as pf
from basewise.operators import similarity as sm
from basewise.operators.landscape import hit_landscape, with_neighbours
from basewise.plans.events import _EV, events
from basewise.plans.regions import _land, event_points, signal
from basewise.plans.sql_views import EVENTS, HITS
from basewise.session import cut_lineage
from basewise.sources.tables import table

HALF = 100


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct places of significant events by condition."""
    e = events(spark, folder).where(F.col("found") & (F.col("q") <= 0.01) & F.col("pos").isNotNull())
    return e.select("cond_id", "chrom", F.col("pos").alias("point"), F.coalesce("strand", F.lit("+")).alias("point_strand")).distinct()


def _composite(spark: SparkSession, folder: str) -> DataFrame:
    return pf.composite(signal(spark, folder).select("cond_id", "chrom", "pos", "strand", "cnt"), points(spark, folder), ["cond_id"], HALF)


def p01_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return _composite(spark, folder)


def a12_composite(spark: SparkSession, folder: str) -> DataFrame:
    return pf.normalised(_composite(spark, folder), ["cond_id"]).withColumn("value", F.round("value", 9))


def a21_joint(spark: SparkSession, folder: str) -> DataFrame:
    """Both strands together, zeros lifted to a floor before they are scaled."""
    f = pf.filled(_composite(spark, folder), ["cond_id"], HALF).withColumn("value", F.greatest("value", F.lit(pf.FLOOR)))
    return pf.normalised(f, ["cond_id"], joint=True).withColumn("value", F.round("value", 9))


def a20_pseudo_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The read distribution of a condition's events with one pseudo-count at each offset."""
    f = pf.filled(_composite(spark, folder), ["cond_id"], HALF).withColumn("value", F.col("value") + 1)
    return pf.normalised(f, ["cond_id"], joint=True).withColumn("value", F.round("value", 9))


def a26_point_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Plus-strand tags in bins of 10 bases around the points of each condition."""
    c = _composite(spark, folder).where("strand = '+'")
    return c.groupBy("cond_id", F.floor(F.col("offset") / 10).alias("bin")).agg(F.sum("value").alias("value"))


def w03_moving_average(spark: SparkSession, folder: str) -> DataFrame:
    """Composites with a pseudo-count averaged over 50 offsets, as noise profiles are."""
    f = pf.filled(_composite(spark, folder), ["cond_id"], HALF).withColumn("value", F.col("value") + 1)
    return pf.moving_average(f, ["cond_id", "strand"], "offset", "value", 25, 24).withColumn("value", F.round("value", 9))


def w04_smoothed(spark: SparkSession, folder: str) -> DataFrame:
    return pf.smoothed(_composite(spark, folder), ["cond_id"], HALF).withColumn("value", F.round("value", 9))


def w04_spline(spark: SparkSession, folder: str) -> DataFrame:
    """Composites on a cubic spline through the mean of five offsets, every ten."""
    return pf.splined(pf.filled(_composite(spark, folder), ["cond_id"], HALF), ["cond_id"], HALF).withColumn("value", F.round("value", 9))


def w07_interval(spark: SparkSession, folder: str) -> DataFrame:
    return pf.central_interval(_composite(spark, folder), ["cond_id"])


def a18_mean_width(spark: SparkSession, folder: str) -> DataFrame:
    """The mean width of the conditions' profiles, weighted by their points, without its fraction."""
    n = points(spark, folder).groupBy("cond_id").agg(F.count("*").alias("n"))
    i = pf.central_interval(_composite(spark, folder), ["cond_id"]).join(n, "cond_id")
    return i.agg((F.try_divide(F.sum((F.col("right") - F.col("left")) * F.col("n")), F.sum("n"))).cast("int").alias("width"))


def w08_interpolated(spark: SparkSession, folder: str) -> DataFrame:
    return pf.interpolated(_composite(spark, folder), ["cond_id"]).withColumn("value", F.round("value", 9))


def m10_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    p = pf.probabilities(pf.filled(_composite(spark, folder), ["cond_id"], HALF).withColumn("value", F.col("value") + 0.5), ["cond_id"])
    return p.select("cond_id", "offset", "strand", *[F.round(c, 9).alias(c) for c in ("prob", "log2_prob", "background")])


def m11_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """log2 density of each condition's profile at distances up to twice its reach; the background beyond it."""
    p = pf.probabilities(pf.filled(_composite(spark, folder), ["cond_id"], HALF).withColumn("value", F.col("value") + 0.5), ["cond_id"])
    bg = p.groupBy("cond_id").agg(F.first("background").alias("bg"))
    d = bg.withColumn("offset", F.explode(F.sequence(F.lit(-2 * HALF), F.lit(2 * HALF), F.lit(5))))
    j = d.join(p.where("strand = '+'").select("cond_id", "offset", "log2_prob"), ["cond_id", "offset"], "left")
    return j.select("cond_id", F.col("offset").alias("distance"), F.round(F.coalesce("log2_prob", F.log2("bg")), 9).alias("log2_density"))


def m09_normal_model(spark: SparkSession, folder: str) -> DataFrame:
    """Normal densities with the mean and deviation of each condition's plus-strand offsets."""
    c = _composite(spark, folder).where("strand = '+'")
    v = F.col("value")
    s = c.groupBy("cond_id").agg(F.sum(v).alias("n"), (F.sum(v * F.col("offset")) / F.sum(v)).alias("mean"), (F.sum(v * F.col("offset") * F.col("offset")) / F.sum(v)).alias("square"))
    s = s.withColumn("sigma", F.greatest(F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))), F.lit(1.0)))
    x = s.withColumn("offset", F.explode(F.sequence(F.lit(-HALF), F.lit(HALF), F.lit(10))))
    z = (F.col("offset") - F.col("mean")) / F.col("sigma")
    return x.select("cond_id", "offset", F.round(F.exp(-z * z / 2) / (F.col("sigma") * math.sqrt(2 * math.pi)), 9).alias("density"))


def a16_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Histogram of the distances of ``j07``, in steps of 50 up to 250 bases."""
    n = with_neighbours(event_points(spark, folder), ["cond_id", "chrom"])
    d = n.select("cond_id", F.least(F.col("pos") - F.col("before"), F.col("after") - F.col("pos")).alias("distance"))
    return pf.histogram(d, ["cond_id"], "distance", 50, 0, 250).withColumn("bin", F.col("bin").cast("bigint"))


def a16_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Histogram of window counts, weighted by the counts."""
    return pf.histogram(hit_landscape(signal(spark, folder), ["cond_id"]), ["cond_id"], "hits", 5, 0, 1000, F.col("hits")).withColumn("bin", F.col("bin").cast("bigint"))


def a17_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """The 90th percentile of window counts, of rank p (n + 1)."""
    return pf.rank_percentile(hit_landscape(signal(spark, folder), ["cond_id"]), ["cond_id"], "hits", 0.9).withColumn("value", F.round("value", 6))


def stranded(spark: SparkSession, folder: str) -> DataFrame:
    """``vec_id, label, profile``: embeddings as stranded profiles."""
    return table(spark, folder, "embeddings").select("vec_id", "label", sm.to_profile(F.col("embedding"), 1e-9).alias("profile"))


def m20_squared(spark: SparkSession, folder: str) -> DataFrame:
    return sm.score_queries(stranded(spark, folder), {"score": sm.either_way(sm.np_squared, np.minimum)})


def m21_kl(spark: SparkSession, folder: str) -> DataFrame:
    return sm.score_queries(stranded(spark, folder), {"score": sm.either_way(sm.np_kl, np.minimum)})


def m22_pearson(spark: SparkSession, folder: str) -> DataFrame:
    return sm.score_queries(stranded(spark, folder), {"score": sm.either_way(sm.np_pearson, np.fmax)})


def m23_weighted_pearson(spark: SparkSession, folder: str) -> DataFrame:
    return sm.score_queries(stranded(spark, folder), {"score": sm.either_way(sm.np_weighted_pearson, np.fmax)})


def m24_cell_scores(spark: SparkSession, folder: str) -> DataFrame:
    return sm.score_queries(stranded(spark, folder), {n: sm.np_cell_score(n) for n in sm.CELL_SCORES}, digits=7)


def m25_best_shift(spark: SparkSession, folder: str) -> DataFrame:
    return sm.best_shift(stranded(spark, folder), 25, 1.0)


def m26_sliding_pearson(spark: SparkSession, folder: str) -> DataFrame:
    return sm.score_queries(stranded(spark, folder), {"score": sm.np_sliding_pearson})


def m28_symmetric_kl(spark: SparkSession, folder: str) -> DataFrame:
    """log of the symmetric divergence, the smaller of both orientations."""
    return sm.score_queries(stranded(spark, folder), {"score": sm.either_way(sm.np_log_symmetric_kl, np.minimum)})


def m28_sliding_kl(spark: SparkSession, folder: str) -> DataFrame:
    """As ``m28_symmetric_kl``, sliding the middle half of one profile over the other."""
    return sm.score_queries(stranded(spark, folder), {"score": sm.np_sliding_log_kl})


def m29_best_rotation(spark: SparkSession, folder: str) -> DataFrame:
    return sm.score_queries(stranded(spark, folder), {"score": sm.np_rotated_kl})


def m31_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Correlations as distances from the largest; those at or over the 10th percentile become the largest distance."""
    s = cut_lineage(m22_pearson(spark, folder))
    ends = s.agg(F.max("score").alias("top"), F.min("score").alias("low")).first()
    d = s.select("q_id", "id", (F.lit(ends["top"]) - F.col("score")).alias("d"))
    cut = pf.rank_percentile(d, [], "d", 0.1).select("value").scalar()
    return d.select("q_id", "id", F.round(F.when(F.col("d") < cut, F.col("d")).otherwise(F.lit(ends["top"]) - F.lit(ends["low"])), 8).alias("distance"))


def a22_exemplars(spark: SparkSession, folder: str) -> DataFrame:
    """The mean profile of each label, by place in the profile."""
    e = stranded(spark, folder).select("label", F.posexplode("profile").alias("place", "value"))
    return e.groupBy("label", "place").agg(F.round(F.avg("value"), 9).alias("value"), F.count("*").alias("n"))


def label_means(profiles: DataFrame) -> DataFrame:
    """``model, m``: the mean profile of each label."""
    means = profiles.select("label", F.posexplode("profile").alias("place", "value")).groupBy("label", "place").agg(F.avg("value").alias("value"))
    each = means.groupBy(F.col("label").alias("model")).agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("m"))
    return cut_lineage(each.select("model", F.transform("m", lambda x: x["value"]).alias("m")))


def e17_classified(spark: SparkSession, folder: str) -> DataFrame:
    """Each profile's label by the least symmetric divergence from the mean profiles of the labels, in either orientation."""
    s = stranded(spark, folder)
    return cl.nearest_models(s.select("vec_id", "profile"), label_means(s))


QUERIES = {
    f.__name__: f
    for f in (
        p01_offsets, a12_composite, a21_joint, a20_pseudo_counts, a26_point_profile, w03_moving_average, w04_smoothed, w04_spline, w07_interval, a18_mean_width, w08_interpolated, m10_probabilities,
        m11_lookup, m09_normal_model, a16_distances, a16_weighted, a17_percentiles, m20_squared, m21_kl, m22_pearson, m23_weighted_pearson, m24_cell_scores, m25_best_shift, m26_sliding_pearson,
        m28_symmetric_kl, m28_sliding_kl, m29_best_rotation, m31_distances, a22_exemplars, e17_classified,
    )
}

_COMP = f"""{HITS}, {_EV},
pt AS (SELECT DISTINCT cond_id, e.chrom, pos AS point, coalesce(strand, '+') AS ps FROM (SELECT e.*, evt.strand FROM e JOIN evt USING (event_id, cond_id)) e WHERE found AND q <= 0.01 AND pos IS NOT NULL),
hb AS (SELECT cond_id, chrom, pos, strand, sum(cnt) AS cnt FROM sig GROUP BY ALL),
cmp AS (
  SELECT hb.cond_id, CAST(CASE WHEN ps = '-' THEN point - pos ELSE pos - point END AS INTEGER) AS "offset", CASE WHEN strand = ps THEN '+' ELSE '-' END AS strand, sum(cnt) AS value
  FROM hb JOIN pt ON pt.cond_id = hb.cond_id AND pt.chrom = hb.chrom AND pos BETWEEN point - {HALF} AND point + {HALF} GROUP BY ALL),
grid AS (SELECT cond_id, o AS "offset", s AS strand FROM (SELECT DISTINCT cond_id FROM cmp), (SELECT unnest(range(-{HALF}, {HALF} + 1)) AS o), (SELECT unnest(['+', '-']) AS s)),
fil AS (SELECT grid.cond_id, CAST(grid."offset" AS INTEGER) AS "offset", grid.strand, coalesce(value, 0) AS value FROM grid LEFT JOIN cmp USING (cond_id, "offset", strand)),
prb AS (SELECT cond_id, "offset", strand, (value + 0.5) / sum(value + 0.5) OVER (PARTITION BY cond_id, strand) AS prob FROM fil)"""

_CDF = """run AS (SELECT cond_id, "offset", sum(v) OVER (PARTITION BY cond_id ORDER BY "offset") / sum(v) OVER (PARTITION BY cond_id) AS c FROM (SELECT cond_id, "offset", sum(value) AS v FROM cmp GROUP BY ALL)),
ivl AS (SELECT cond_id, min("offset") FILTER (WHERE c > 1 - 0.975) AS "left", min("offset") FILTER (WHERE c >= 0.975) AS "right" FROM run GROUP BY 1)"""

_PROF = """
raw AS (SELECT vec_id, label, list_transform(embedding, lambda v: greatest(abs(CAST(v AS DOUBLE)), 1e-9)) AS a FROM embeddings),
pro AS (SELECT vec_id, label, list_transform(a, lambda v: v / list_sum(a)) AS p FROM raw),
prs AS (SELECT q.vec_id AS q_id, pro.vec_id AS id, q.p AS q, pro.p AS p, list_reverse(pro.p) AS r FROM pro JOIN pro q ON q.vec_id % 50 = 0 AND q.vec_id <> pro.vec_id)"""


def _total(expr: str, a: str, b: str) -> str:
    """Sum over places i of ``expr`` in x and y, the values of lists ``a`` and ``b``."""
    e = expr.replace("{x}", f"{a}[i]").replace("{y}", f"{b}[i]")
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {e}))"


def _kl(a: str, b: str) -> str:
    return _total("{x} * ln(({x} + 1e-12) / ({y} + 1e-12))", a, b)


def _two(f, best: str) -> str:
    return f"WITH {_PROF} SELECT q_id, id, round({best}({f('q', 'p')}, {f('q', 'r')}), 8) AS score FROM prs"


def _pearson(a: str, b: str) -> str:
    ma, mb = f"list_avg({a})", f"list_avg({b})"
    return f"{_total(f'({{x}} - {ma}) * ({{y}} - {mb})', a, b)} / nullif(sqrt({_total(f'({{x}} - {ma}) * ({{x}} - {ma})', a, a)} * {_total(f'({{x}} - {mb}) * ({{x}} - {mb})', b, b)}), 0)"


def _cells() -> str:
    x1, y1, x2, y2 = "q[i]", "q[i + len(q) // 2]", "p[i]", "p[i + len(q) // 2]"
    dx, dy = f"abs({x1} - {x2})", f"abs({y1} - {y2})"
    forms = {
        "linear": f"({x1} + {x2}) / 2 + ({y1} + {y2}) / 2",
        "euclidean": f"1 - sqrt({dx} * {dx} + {dy} * {dy})",
        "sorensen": f"1 - ({dx} + {dy}) / ({x1} + {x2} + {y1} + {y2})",
        "soergel": f"1 - ({dx} + {dy}) / (greatest({x1}, {x2}) + greatest({y1}, {y2}))",
        "lorentzian": f"1 - (ln(1 + {dx}) + ln(1 + {dy}))",
        "pce": f"({x1} * {x2} + {y1} * {y2}) / ({x1} * {x1} + {y1} * {y1} + {x2} * {x2} + {y2} * {y2} - ({x1} * {x2} + {y1} * {y2}))",
        "squared_chi": f"1 - ({dx} * {dx} / ({x1} + {x2}) + {dy} * {dy} / ({y1} + {y2}))",
        "divergence": f"2 - 2 * ({dx} * {dx} / pow({x1} + {x2}, 2) + {dy} * {dy} / pow({y1} + {y2}, 2))",
        "clark": f"1 - sqrt(pow({dx} / ({x1} + {x2}), 2) + pow({dy} / ({y1} + {y2}), 2))",
        "akl": f"2 - ({x1} * ln({x1} / {x2}) + {x2} * ln({x2} / {x1})) / 2 + ({y1} * ln({y1} / {y2}) + {y2} * ln({y2} / {y1})) / 2",
    }
    cell = lambda e: f"CASE WHEN {x1} = {x2} AND {y1} = {y2} THEN 0.0 ELSE {e} - {dx} - {dy} END"
    sums = ", ".join(f"round(list_sum(list_transform(range(1, len(q) // 2 + 1), lambda i: {cell(e)})), 7) AS {n}" for n, e in forms.items())
    return f"{sums}, 0.0::DOUBLE AS allr"


_SLIDE = """
w AS (SELECT vec_id, s, len(p) // 4 AS h, list_concat(p[s + 1 : s + len(p) // 4], p[len(p) // 2 + s + 1 : len(p) // 2 + s + len(p) // 4]) AS v
      FROM (SELECT vec_id, p, unnest(range(0, len(p) // 2 - len(p) // 4 + 1)) AS s FROM pro)),
c AS (SELECT vec_id, s, list_transform(v, lambda x: x - list_avg(v)) AS v FROM w),
u AS (SELECT vec_id, s, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM c),
m AS (SELECT vec_id AS q_id, v AS q FROM u WHERE vec_id % 50 = 0 AND s = (SELECT max(s) // 2 FROM u))"""

_MEANS = """mn AS (SELECT label, i, avg(p[i]) AS v FROM (SELECT label, p, unnest(range(1, len(p) + 1)) AS i FROM pro) GROUP BY ALL),
mdl AS (SELECT label AS model, list(v ORDER BY i) AS m FROM mn GROUP BY 1)"""

# The weights of a spline are constants of its width; tests hold them against the conditions that make a spline.
_KNOTS = np.arange(-HALF, HALF + 1, 10)
_SPLINE = ", ".join(f"({k}, [{', '.join(f'{x:.17e}' for x in w)}])" for k, w in zip(_KNOTS, pf.spline_weights(_KNOTS, np.arange(-HALF, HALF + 1)).T))

SQL = {
    "w04_spline": f"""WITH {_COMP}, kn AS (SELECT * FROM (VALUES {_SPLINE}) AS t(knot, ws)),
kv AS (SELECT cond_id, strand, knot, avg(value) AS v, any_value(ws) AS ws FROM fil JOIN kn ON abs("offset" - knot) <= 2 GROUP BY cond_id, strand, knot)
SELECT cond_id, CAST(i - 1 - {HALF} AS INTEGER) AS "offset", strand, round(greatest(sum(v * ws[i]), 0), 9) AS value FROM (SELECT *, unnest(range(1, {2 * HALF + 2})) AS i FROM kv) GROUP BY ALL""",
    "p01_offsets": f"WITH {_COMP} SELECT * FROM cmp",
    "a12_composite": f'WITH {_COMP} SELECT cond_id, "offset", strand, round(value / sum(value) OVER (PARTITION BY cond_id, strand), 9) AS value FROM cmp',
    "a21_joint": f'WITH {_COMP} SELECT cond_id, "offset", strand, round(greatest(value, 1e-20) / sum(greatest(value, 1e-20)) OVER (PARTITION BY cond_id), 9) AS value FROM fil',
    "a20_pseudo_counts": f'WITH {_COMP} SELECT cond_id, "offset", strand, round((value + 1) / sum(value + 1) OVER (PARTITION BY cond_id), 9) AS value FROM fil',
    "a26_point_profile": f"""WITH {_COMP} SELECT cond_id, CAST(floor("offset" / 10.0) AS BIGINT) AS bin, sum(value) AS value FROM cmp WHERE strand = '+' GROUP BY ALL""",
    "w03_moving_average": f'WITH {_COMP} SELECT cond_id, "offset", strand, round(avg(value + 1) OVER (PARTITION BY cond_id, strand ORDER BY "offset" ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING), 9) AS value FROM fil',
    "w04_smoothed": f"""WITH {_COMP}, k AS (SELECT d, exp(-0.5 * (d / 3.0) * (d / 3.0)) AS w FROM (SELECT unnest(range(-12, 13)) AS d)), ks AS (SELECT d, w / (SELECT sum(w) FROM k) AS w FROM k)
SELECT cond_id, CAST("offset" + d AS INTEGER) AS "offset", strand, round(sum(value * w), 9) AS value FROM cmp, ks WHERE "offset" + d BETWEEN -{HALF} AND {HALF} GROUP BY cond_id, "offset" + d, strand""",
    "w07_interval": f"WITH {_COMP}, {_CDF} SELECT * FROM ivl",
    "a18_mean_width": f'WITH {_COMP}, {_CDF}, n AS (SELECT cond_id, count(*) AS n FROM pt GROUP BY 1) SELECT CAST(trunc(sum(("right" - "left") * n) / sum(n)) AS INTEGER) AS width FROM ivl JOIN n USING (cond_id)',
    "w08_interpolated": f"""WITH {_COMP}, seg AS (SELECT cond_id, strand, "offset" AS a, value AS va, lead("offset") OVER w AS b, lead(value) OVER w AS vb FROM cmp WINDOW w AS (PARTITION BY cond_id, strand ORDER BY "offset"))
SELECT cond_id, strand, CAST(o AS INTEGER) AS "offset", round(CASE WHEN o = a THEN va ELSE va + (o - a) / (b - a)::DOUBLE * (vb - va) END, 9) AS value FROM (SELECT *, unnest(range(a, coalesce(b, a + 1))) AS o FROM seg)""",
    "m10_probabilities": f'WITH {_COMP} SELECT cond_id, "offset", strand, round(prob, 9) AS prob, round(log2(prob), 9) AS log2_prob, round(greatest(min(prob) OVER (PARTITION BY cond_id) / 100, 1e-100), 9) AS background FROM prb',
    "m11_lookup": f"""WITH {_COMP}, bg AS (SELECT cond_id, greatest(min(prob) / 100, 1e-100) AS bg FROM prb GROUP BY 1), d AS (SELECT cond_id, bg, CAST(unnest(range(-{2 * HALF}, {2 * HALF} + 1, 5)) AS INTEGER) AS distance FROM bg)
SELECT d.cond_id, distance, round(log2(coalesce(prob, bg)), 9) AS log2_density FROM d LEFT JOIN (SELECT * FROM prb WHERE strand = '+') p ON p.cond_id = d.cond_id AND p."offset" = distance""",
    "m09_normal_model": f"""WITH {_COMP}, s AS (SELECT cond_id, sum(value * "offset") / sum(value) AS m, sum(value * "offset" * "offset") / sum(value) AS sq FROM cmp WHERE strand = '+' GROUP BY 1),
g AS (SELECT cond_id, m, greatest(sqrt(greatest(sq - m * m, 0)), 1) AS sd, CAST(unnest(range(-{HALF}, {HALF} + 1, 10)) AS INTEGER) AS "offset" FROM s)
SELECT cond_id, "offset", round(exp(-pow(("offset" - m) / sd, 2) / 2) / (sd * sqrt(2 * pi())), 9) AS density FROM g""",
    "a16_distances": f"""WITH {EVENTS}, pts AS (SELECT cond_id, chrom, pos FROM evt WHERE pos IS NOT NULL),
d AS (SELECT cond_id, least(pos - lag(pos) OVER w, lead(pos) OVER w - pos) AS d FROM pts WINDOW w AS (PARTITION BY cond_id, chrom ORDER BY pos))
SELECT cond_id, d // 50 * 50 AS bin, count(*) AS n FROM d WHERE d BETWEEN 0 AND 249 GROUP BY ALL""",
    "a16_weighted": f"""WITH {HITS}, l AS ({_land('cond_id')}) SELECT cond_id, CAST(floor(hits / 5) * 5 AS BIGINT) AS bin, sum(hits) AS n FROM l WHERE hits >= 0 AND hits < 1000 GROUP BY ALL""",
    "a17_percentiles": f"""WITH {HITS}, l AS ({_land('cond_id')}), r AS (SELECT *, row_number() OVER (PARTITION BY cond_id ORDER BY hits) AS k, count(*) OVER (PARTITION BY cond_id) AS n FROM l),
t AS (SELECT *, least(greatest(0.9::DOUBLE * (n + 1), 1), n) AS a FROM r)
SELECT cond_id, round(any_value(hits) FILTER (WHERE k = floor(a)) + any_value(a - floor(a)) * (any_value(hits) FILTER (WHERE k = ceil(a)) - any_value(hits) FILTER (WHERE k = floor(a))), 6) AS value FROM t GROUP BY 1""",
    "m20_squared": _two(lambda a, b: _total("pow({x} - {y}, 2)", a, b), "least"),
    "m21_kl": _two(_kl, "least"),
    "m22_pearson": _two(_pearson, "greatest"),
    "m24_cell_scores": f"WITH {_PROF} SELECT q_id, id, {_cells()} FROM prs",
    "m23_weighted_pearson": f"""WITH {_PROF}, o AS (SELECT q_id, id, q, unnest([p, r]) AS p FROM prs),
w AS (SELECT q_id, id, q, p, list_transform(list_zip(q, p), lambda z: (z[1] + z[2]) / 2) AS w FROM o),
m AS (SELECT *, list_dot_product(w, q) / list_sum(w) AS mq, list_dot_product(w, p) / list_sum(w) AS mp FROM w),
d AS (SELECT q_id, id, w, list_transform(q, lambda x: x - mq) AS a, list_transform(p, lambda x: x - mp) AS b FROM m),
s AS (SELECT q_id, id, list_sum(list_transform(range(1, len(w) + 1), lambda i: w[i] * a[i] * b[i])) / sqrt(list_sum(list_transform(range(1, len(w) + 1), lambda i: w[i] * a[i] * a[i]))
  * list_sum(list_transform(range(1, len(w) + 1), lambda i: w[i] * b[i] * b[i]))) AS s FROM d)
SELECT q_id, id, round(max(s), 8) AS score FROM s GROUP BY ALL""",
    "m26_sliding_pearson": f"""WITH {_PROF}, {_SLIDE}
SELECT q_id, vec_id AS id, round(max(greatest(list_dot_product(q, v), list_dot_product(q, list_reverse(v)))), 8) AS score FROM m JOIN u ON q_id <> vec_id GROUP BY ALL""",
    "m28_sliding_kl": f"""WITH {_PROF}, {_SLIDE},
n AS (SELECT vec_id, s, list_transform(v, lambda x: x / list_sum(v)) AS v FROM w),
a AS (SELECT vec_id AS q_id, v AS q FROM n WHERE vec_id % 50 = 0 AND s = (SELECT max(s) // 2 FROM n)),
b AS (SELECT q_id, vec_id AS id, q, unnest([v, list_reverse(v)]) AS v FROM a JOIN n ON q_id <> vec_id)
SELECT q_id, id, round(ln(min({_kl('q', 'v')} + {_kl('v', 'q')})), 8) AS score FROM b GROUP BY ALL""",
    "m29_best_rotation": f"""WITH {_PROF}, l AS (SELECT q_id, id, p, len(p) // 2 AS n, list_sum(list_transform(q, lambda x: x * ln(x + 1e-12))) AS own, q FROM prs),
t AS (SELECT q_id, id, own, q, n, list_transform(p, lambda x: ln(x + 1e-12)) AS g, unnest(range(-20, 21)) AS d FROM l),
k AS (SELECT q_id, id, own - list_sum(list_transform(range(0, n), lambda i: q[i + 1] * g[((i - d) % n + n) % n + 1] + q[n + i + 1] * g[n + ((i - d) % n + n) % n + 1])) AS k FROM t)
SELECT q_id, id, round(min(k), 8) AS score FROM k GROUP BY ALL""",
    "m31_distances": f"""WITH {_PROF}, s AS (SELECT q_id, id, round(greatest({_pearson('q', 'p')}, {_pearson('q', 'r')}), 8) AS score FROM prs),
d AS (SELECT q_id, id, (SELECT max(score) FROM s) - score AS d FROM s),
r AS (SELECT d, row_number() OVER (ORDER BY d) AS k, count(*) OVER () AS n FROM d),
a AS (SELECT any_value(least(greatest(0.1::DOUBLE * (n + 1), 1), n)) AS a FROM r),
c AS (SELECT min(d) FILTER (WHERE k = floor(a)) + any_value(a - floor(a)) * (min(d) FILTER (WHERE k = ceil(a)) - min(d) FILTER (WHERE k = floor(a))) AS c FROM r, a)
SELECT q_id, id, round(CASE WHEN d < (SELECT c FROM c) THEN d ELSE (SELECT max(d) FROM d) END, 8) AS distance FROM d""",
    "m28_symmetric_kl": _two(lambda a, b: f"ln({_kl(a, b)} + {_kl(b, a)})", "least"),
    "a22_exemplars": f"WITH {_PROF} SELECT label, CAST(i - 1 AS INTEGER) AS place, round(avg(p[i]), 9) AS value, count(*) AS n FROM (SELECT label, p, unnest(range(1, len(p) + 1)) AS i FROM pro) GROUP BY ALL",
    "e17_classified": f"""WITH {_PROF}, {_MEANS}, d AS (SELECT vec_id, model, round(least({_kl('p', 'm')} + {_kl('m', 'p')}, {_kl('r', 'm')} + {_kl('m', 'r')}), 8) AS d FROM (SELECT *, list_reverse(p) AS r FROM pro), mdl)
SELECT vec_id, model, d AS divergence FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, model) AS k FROM d) WHERE k = 1""",
}
