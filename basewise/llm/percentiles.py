"""Percentiles of large columns by group: exact ones by radix selection, bounded ones from daily sketches.

A finite number becomes an integer of the same order (the bits of the double, negated for
negative numbers), whose digits are histogrammed from the highest. A percentile follows only
the digit that holds its rank, so each pass counts fewer rows. Histograms are sums, so those
of partitions and days add up.

Null, NaN and infinite numbers are no values; the caller says whether negative ones are.
A percentile q of n values is the value of rank ceil(q * n), at least 1, in ascending order.
A group without values has no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewise.operators.intervals import small_side
from basewise.session import cut_lineage

#: Widths of the digits, from the highest; 64 bits in all.
DIGITS = (20, 16, 14, 14)
MANTISSA = 1 << 52


def ordered_bits(x: Column) -> Column:
    """The bits of a finite double as a bigint of the same order; both zeros are 0."""
    a = F.abs(x)
    # log2 may be off by one at powers of two; the mantissa tells
    e0 = F.greatest(F.floor(F.log2(a)).cast("int"), F.lit(-1022))
    m0 = a / F.pow(F.lit(2.0), e0)
    e = F.greatest(F.when(m0 >= 2, e0 + 1).when(m0 < 1, e0 - 1).otherwise(e0), F.lit(-1022))
    m = a / F.pow(F.lit(2.0), e)
    # below the least normal number the exponent field is 0 and the mantissa has no leading one
    normal = (e + 1023).cast("bigint") * F.lit(MANTISSA) + ((m - 1) * F.lit(float(MANTISSA))).cast("bigint")
    key = F.when(a == 0, F.lit(0).cast("bigint")).when(m < 1, (m * F.lit(float(MANTISSA))).cast("bigint")).otherwise(normal)
    return F.when(x < 0, -key).otherwise(key)


def from_ordered_bits(key: Column) -> Column:
    """The double of ``ordered_bits``."""
    a = F.abs(key)
    field = F.shiftright(a, 52)
    m = (a - F.shiftleft(field, 52)).cast("double") / F.lit(float(MANTISSA))
    value = F.when(field == 0, m * F.pow(F.lit(2.0), F.lit(-1022))).otherwise((1 + m) * F.pow(F.lit(2.0), field.cast("double") - 1023))
    return F.when(key < 0, -value).otherwise(value)


def long_values(rows: DataFrame, groups: Sequence[str], metrics: Sequence[str], keep: Sequence[str] = (), negative: bool = True) -> DataFrame:
    """``groups, keep, metric, _key``: one row for each value of each metric."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])).alias("_v")
    x = F.col("_v.x")
    real = x.isNotNull() & ~F.isnan(x) & (x < float("inf")) & (x > float("-inf"))
    v = rows.select(*groups, *keep, each).where(real if negative else real & (x >= 0))
    return v.select(*groups, *keep, F.col("_v.metric").alias("metric"), ordered_bits(x).alias("_key"))


def _digit(key: Column, level: int) -> Column:
    below = 64 - sum(DIGITS[: level + 1])
    d = F.shiftright(key, below)  # the highest digit keeps the sign
    return d if level == 0 else d.bitwiseAND(F.lit((1 << DIGITS[level]) - 1))


def _follow(histogram: DataFrame, targets: DataFrame, at: list[str]) -> DataFrame:
    """``targets`` (``at, q, rank``) with the digit that holds each rank, and the rank within it."""
    w = Window.partitionBy(*at).orderBy("digit")
    reach = histogram.withColumn("upto", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"h.{c}")) for c in at]
    j = reach.alias("h").join(targets.alias("t"), [*same, (F.col("t.rank") > F.col("h.before")) & (F.col("t.rank") <= F.col("h.upto"))])
    return j.select(*[F.col(f"t.{c}").alias(c) for c in at], "q", "n_values", F.col("h.digit").alias("digit"), (F.col("rank") - F.col("before")).alias("rank"))


def exact_percentiles(rows: DataFrame, groups: Sequence[str], metrics: Sequence[str], qs: Sequence[float], negative: bool = True) -> DataFrame:
    """``groups, metric, q, n_values, value``: exact percentiles by radix selection.

    The values are written once to the shared folder, as a group and one integer for each. The
    first pass histograms the highest digit of all of them; the second keeps those within the
    digits that are followed, at most one for each group, metric and percentile (broadcast
    after a count, else a shuffled join on the rarely shared prefix), and writes them, equal
    ones as one with their count. Each later digit reads only what the one before it kept.
    Counts are combined in each partition first, so a group with most of the rows moves no
    more than its histogram.
    """
    if not qs or not all(0 < q <= 1 for q in qs):
        raise ValueError("percentiles are above 0 and at most 1")
    at = [*groups, "metric"]
    values = cut_lineage(long_values(rows, groups, metrics, negative=negative))
    first = values.groupBy(*at, _digit(F.col("_key"), 0).alias("digit")).agg(F.count("*").alias("n"))
    first = cut_lineage(first)
    sizes = first.groupBy(*at).agg(F.sum("n").alias("n_values"))
    quantiles = F.explode(F.array(*[F.lit(float(q)) for q in qs]))
    targets = sizes.select(*at, "n_values", quantiles.alias("q")).withColumn("rank", F.greatest(F.ceil(F.col("q") * F.col("n_values")), F.lit(1)))
    found = _follow(first, targets, at).withColumnRenamed("digit", "_prefix")
    values = values.withColumn("n", F.lit(1).cast("bigint"))
    for level in range(1, len(DIGITS)):
        found = cut_lineage(found)
        active = small_side(found.select(*[F.col(c).alias(f"_{c}") for c in at], F.col("_prefix").alias("_p")).distinct())
        prefix = F.shiftright(F.col("_key"), 64 - sum(DIGITS[:level]))
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in at] + [prefix == F.col("_p")]
        values = cut_lineage(values.join(active, on).groupBy(*at, "_key").agg(F.sum("n").alias("n")))
        hist = values.groupBy(*at, prefix.alias("_prefix"), _digit(F.col("_key"), level).alias("digit")).agg(F.sum("n").alias("n"))
        nxt = _follow(hist, found, [*at, "_prefix"])
        found = nxt.select(*at, "q", "n_values", "rank", F.shiftleft("_prefix", DIGITS[level]).bitwiseOR(F.col("digit")).alias("_prefix"))
    return found.select(*at, "q", "n_values", from_ordered_bits(F.col("_prefix")).alias("value"))


def sketches(rows: DataFrame, groups: Sequence[str], metrics: Sequence[str], bits: int = DIGITS[0], negative: bool = True) -> DataFrame:
    """``groups, metric, digit, n``: histograms of the highest ``bits`` bits. ``groups`` may hold a day.

    Values of one digit differ by less than 2 ** (12 - bits) of the smaller (bits > 12). Rows
    that a later version replaces are taken out by adding their sketch with negative ``n``.
    """
    v = long_values(rows, groups, metrics, negative=negative)
    return v.groupBy(*groups, "metric", F.shiftright("_key", 64 - bits).alias("digit")).agg(F.count("*").alias("n"))


def merge_sketches(parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The sketch of ``groups``: the sum of those of its parts."""
    return parts.groupBy(*groups, "metric", "digit").agg(F.sum("n").alias("n")).where("n <> 0")


def sketch_percentiles(sketch: DataFrame, groups: Sequence[str], qs: Sequence[float], bits: int = DIGITS[0]) -> DataFrame:
    """``groups, metric, q, n_values, low``: the least number of the digit that holds each percentile.

    The exact percentile is at least ``low`` and above it by less than 2 ** (12 - bits) of its
    size. Negative values are below ``low + 2 ** (12 - bits)`` of its size likewise.
    """
    at = [*groups, "metric"]
    sizes = sketch.groupBy(*at).agg(F.sum("n").alias("n_values"))
    targets = sizes.select(*at, "n_values", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")).withColumn(
        "rank", F.greatest(F.ceil(F.col("q") * F.col("n_values")), F.lit(1))
    )
    found = _follow(sketch, targets, at)
    return found.select(*at, "q", "n_values", from_ordered_bits(F.shiftleft("digit", 64 - bits)).alias("low"))
