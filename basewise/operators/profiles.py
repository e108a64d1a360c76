"""Composite profiles around points and the densities made from them.

A profile is long: one row for each key, offset and strand. Offsets run from ``-half`` to
``half``; an offset is strand-aware, so the two strands of a minus point swap.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewise.operators.intervals import points_in_intervals
from basewise.operators.ordered import running_totals

FLOOR = 1e-20


def relative_offset(pos: Column, point: Column, point_strand: Column) -> Column:
    """Distance from a point in its own direction."""
    return F.when(point_strand == "-", point - pos).otherwise(pos - point)


def relative_strand(strand: Column, point_strand: Column) -> Column:
    """A strand as the point sees it: ``+`` for its own."""
    return F.when(strand == F.coalesce(point_strand, F.lit("+")), "+").otherwise("-")


def composite(hits: DataFrame, points: DataFrame, keys: Sequence[str], half: int = 100) -> DataFrame:
    """``keys, offset, strand, value``: counts summed over all points of a key by relative offset.

    ``hits``: ``keys, chrom, pos, strand, cnt``; ``points``: ``keys, chrom, point, point_strand``.
    Hits of one base and points of one place are summed before they meet, so repeated reads
    and events weigh more without being joined more often.
    """
    h = hits.groupBy(*keys, "chrom", "pos", "strand").agg(F.sum("cnt").alias("cnt"))
    p = points.groupBy(*keys, "chrom", "point", "point_strand").agg(F.count("*").alias("_times"))
    p = p.withColumn("_a", F.col("point") - half).withColumn("_z", F.col("point") + half)
    j = points_in_intervals(h, p, [*keys, "chrom"], start="_a", end="_z", width=1024)
    offset = relative_offset(F.col("pos"), F.col("point"), F.col("point_strand")).cast("int")
    strand = relative_strand(F.col("strand"), F.col("point_strand"))
    return j.groupBy(*keys, offset.alias("offset"), strand.alias("strand")).agg(F.sum(F.col("cnt") * F.col("_times")).alias("value"))


def normalised(profile: DataFrame, keys: Sequence[str], joint: bool = False) -> DataFrame:
    """``profile`` with values summing to 1 over each key and strand, or over both strands."""
    w = Window.partitionBy(*keys) if joint else Window.partitionBy(*keys, "strand")
    return profile.withColumn("value", F.try_divide(F.col("value"), F.sum("value").over(w)))


def filled(profile: DataFrame, keys: Sequence[str], half: int) -> DataFrame:
    """``profile`` with a row for every offset of both strands; those missing are 0."""
    grid = profile.select(*keys).distinct()
    grid = grid.withColumn("offset", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-"))))
    return grid.join(profile, [*keys, "offset", "strand"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def smoothed(profile: DataFrame, keys: Sequence[str], half: int, sigma: float = 3.0) -> DataFrame:
    """``profile`` convolved with a normal kernel of ``sigma``, cut at 4 sigma and at the ends of the profile."""
    reach = math.ceil(4 * sigma)
    weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    kernel = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w / sum(weights)).alias("w")) for d, w in zip(range(-reach, reach + 1), weights)])
    spread = profile.select(*keys, "strand", "offset", "value", F.explode(kernel).alias("_k"))
    moved = spread.select(*keys, "strand", (F.col("offset") + F.col("_k.d")).alias("offset"), (F.col("value") * F.col("_k.w")).alias("value"))
    return moved.where(F.col("offset").between(-half, half)).groupBy(*keys, "offset", "strand").agg(F.sum("value").alias("value"))


def spline_weights(knots: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The weight of each knot's value (columns) at each of ``places`` (rows) under the natural cubic spline; at least three knots, evenly spaced."""
    n, step = len(knots), knots[1] - knots[0]
    # second derivatives from values: those of the inner knots solve a band of 1, 4, 1
    second = np.zeros((n, n))
    band = 4 * np.eye(n - 2) + np.eye(n - 2, k=1) + np.eye(n - 2, k=-1)
    second[1:-1] = np.linalg.solve(band, (np.eye(n)[:-2] - 2 * np.eye(n)[1:-1] + np.eye(n)[2:]) * 6 / step**2)
    k = np.clip((places - knots[0]) // step, 0, n - 2).astype(int)
    b = ((places - knots[k]) / step)[:, None]
    a = 1 - b
    return a * np.eye(n)[k] + b * np.eye(n)[k + 1] + ((a**3 - a) * second[k] + (b**3 - b) * second[k + 1]) * step**2 / 6


def splined(profile: DataFrame, keys: Sequence[str], half: int, step: int = 10, average: int = 2) -> DataFrame:
    """A filled ``profile`` on a natural cubic spline through every ``step``-th offset from ``-half``, each the mean of ``average`` offsets to both sides; no value under 0.

    The weights of the knots depend on the width of a profile only and are a few rows.
    """
    if not 0 <= 2 * average < step or 2 * half < 2 * step:
        raise ValueError("a step is longer than what is averaged and fits twice into a profile")
    knots = np.arange(-half, half + 1, step)
    weights = spline_weights(knots, np.arange(-half, half + 1))
    table = profile.sparkSession.createDataFrame([(int(k), w.tolist()) for k, w in zip(knots, weights.T)], "_knot int, _weights array<double>")
    at = F.floor((F.col("offset") + half + step // 2) / step) * step - half
    v = profile.withColumn("_knot", at.cast("int")).where(F.abs(F.col("offset") - F.col("_knot")) <= average).groupBy(*keys, "strand", "_knot").agg(F.avg("value").alias("_v"))
    j = v.join(F.broadcast(table), "_knot").select(*keys, "strand", "_v", F.posexplode("_weights").alias("_at", "_w"))
    return j.groupBy(*keys, (F.col("_at") - half).alias("offset"), "strand").agg(F.greatest(F.sum(F.col("_v") * F.col("_w")), F.lit(0.0)).alias("value"))


def flattened(models: DataFrame, components: DataFrame, densities: DataFrame) -> DataFrame:
    """``model, offset, strand, value``: the densities of all components with weight around their places, each strand times its responsibility, summed over the width of the model.

    Tables as of ``read_composite_models``. Offsets count from the middle; places outside the
    width are left out, those no component reaches have no row.
    """
    c = components.where("pi > 0").join(densities, ["model", "density"]).join(models, "model")
    sides = [F.struct(F.lit(s).alias("strand"), F.col(f"{n}_density").alias("p"), F.col(n).alias("r")) for s, n in (("+", "plus"), ("-", "minus"))]
    c = c.select("model", "position", "width", F.explode(F.array(*sides)).alias("_s")).select("model", "position", "width", F.size("_s.p").alias("_n"), "_s.strand", F.col("_s.r").alias("_r"), F.posexplode("_s.p").alias("_at", "_p"))
    place = F.col("position") - F.floor(F.col("_n") / 2) + F.col("_at")
    c = c.withColumn("_place", place).where((F.col("_place") >= 0) & (F.col("_place") < F.col("width")))
    return c.groupBy("model", (F.col("_place") - F.floor(F.col("width") / 2)).cast("int").alias("offset"), "strand").agg(F.sum(F.col("_p") * F.col("_r")).alias("value"))


def moving_average(rows: DataFrame, keys: Sequence[str], order: str, value: str, before: int, after: int) -> DataFrame:
    """``rows`` with ``value`` averaged over the rows around each one."""
    return rows.withColumn(value, F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, after)))


def interpolated(profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every offset between the first and last of each key and strand, on straight lines between the given ones."""
    ends = profile.groupBy(*keys, "strand").agg(F.min("offset").alias("_a"), F.max("offset").alias("_z"))
    grid = ends.withColumn("offset", F.explode(F.sequence("_a", "_z"))).drop("_a", "_z")
    j = grid.join(profile.select(*keys, "strand", "offset", "value"), [*keys, "strand", "offset"], "left")
    w = Window.partitionBy(*keys, "strand").orderBy("offset")
    at = F.when(F.col("value").isNotNull(), F.struct("offset", "value"))
    j = j.withColumn("_l", F.last(at, ignorenulls=True).over(w)).withColumn("_r", F.last(at, ignorenulls=True).over(Window.partitionBy(*keys, "strand").orderBy(F.desc("offset"))))
    share = F.try_divide(F.col("offset") - F.col("_l.offset"), F.col("_r.offset") - F.col("_l.offset"))
    return j.select(*keys, "strand", "offset", F.coalesce("value", F.col("_l.value") + share * (F.col("_r.value") - F.col("_l.value"))).alias("value"))


def probabilities(profile: DataFrame, keys: Sequence[str], floor: float = 1e-100) -> DataFrame:
    """``keys, offset, strand, prob, log2_prob, background`` of a filled profile: per strand, zeros lifted to ``floor``; the background is a hundredth of the least, at least the floor."""
    v = F.greatest("value", F.lit(floor))
    w = Window.partitionBy(*keys, "strand")
    p = profile.select(*keys, "offset", "strand", (v / F.sum(v).over(w)).alias("prob"))
    least = F.min("prob").over(Window.partitionBy(*keys))
    return p.withColumn("log2_prob", F.log2("prob")).withColumn("background", F.greatest(least / 100, F.lit(floor)))


def central_interval(profile: DataFrame, keys: Sequence[str], share: float = 0.95) -> DataFrame:
    """``keys, left, right``: the offsets within which the middle ``share`` of a profile's total lies, both strands together."""
    both = profile.groupBy(*keys, "offset").agg(F.sum("value").alias("value"))
    w = Window.partitionBy(*keys)
    run = both.withColumn("_c", F.try_divide(F.sum("value").over(w.orderBy("offset")), F.sum("value").over(w)))
    low, high = (1 - share) / 2, 1 - (1 - share) / 2
    return run.groupBy(*keys).agg(F.min(F.when(F.col("_c") > low, F.col("offset"))).alias("left"), F.min(F.when(F.col("_c") >= high, F.col("offset"))).alias("right"))


def histogram(rows: DataFrame, keys: Sequence[str], value: str, width: float, low: float, high: float, weight: Column | None = None) -> DataFrame:
    """``keys, bin, n`` of values in [low, high); ``bin`` is the lower edge."""
    v = F.col(value)
    n = F.sum(weight) if weight is not None else F.count("*")
    return rows.where((v >= low) & (v < high)).groupBy(*keys, (F.floor((v - low) / width) * width + low).alias("bin")).agg(n.alias("n"))


def rank_percentile(rows: DataFrame, keys: Sequence[str], value: str, p: float) -> DataFrame:
    """``keys, value``: the percentile whose rank is p * (n + 1), between neighbours by straight line, within the ends.

    Values are counted by distinct value first, so ties and hot keys shrink, and ordered by ranges.
    """
    v = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    v = running_totals(v, keys, [F.col("_v")], {"_upto": F.col("_n")}, {"_upto": "_all"})
    at = F.least(F.greatest(F.lit(p) * (F.col("_all") + 1), F.lit(1.0)), F.col("_all").cast("double"))
    low = F.min(F.when(F.col("_upto") >= F.floor(at), F.col("_v")))
    high = F.min(F.when(F.col("_upto") >= F.ceil(at), F.col("_v")))
    part = F.first(at - F.floor(at))
    return v.groupBy(*keys).agg((low + part * (high - low)).alias("value"))
