"""Counts of events against a control, multiple testing and replication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewise.functions.stats import binomial_cdf, poisson_cdf
from basewise.operators.ordered import running_totals


def replicate_weights(totals: DataFrame, condition: str = "cond_id") -> DataFrame:
    """``totals`` (``cond, rep_id, total, fraction``) with ``weight``: the share of signal reads within the condition, equal shares where there are none."""
    x = F.coalesce(F.col("fraction") * F.col("total"), F.lit(0.0))
    w = Window.partitionBy(condition)
    return totals.withColumn("weight", F.coalesce(F.try_divide(x, F.sum(x).over(w)), 1 / F.count("*").over(w)))


def condition_counts(event_rep: DataFrame, scaling: DataFrame, event: Sequence[str]) -> DataFrame:
    """``event, cond_id, sig, ctrl, fold``: sums over replicates, controls scaled, and the weighted fold.

    ``event_rep``: ``event, cond_id, rep_id, sig, ctrl``; ``scaling``: ``rep_id, scale, weight``.
    The fold of a replicate is its signal over its scaled control where the control is above 1, else its signal.
    """
    j = event_rep.join(scaling, "rep_id")
    scaled = F.col("ctrl") * F.col("scale")
    fold = F.when(F.col("ctrl") > 1, F.coalesce(F.try_divide(F.col("sig"), scaled), F.lit(0.0))).otherwise(F.col("sig"))
    return j.groupBy(*event, "cond_id").agg(F.sum("sig").alias("sig"), F.sum(scaled).alias("ctrl"), F.sum(fold * F.col("weight")).alias("fold"))


def p_value(sig: Column, ctrl: Column, total: Column, background: Column, min_fold: float = 1.5) -> Column:
    """The larger of a binomial test of signal against control and a Poisson test against the background.

    All are columns of their own, as each is read many times. ``background`` is the window over the genome, as a share. 1 where there are no counts or the ratio isn't above ``min_fold``.
    """
    b = binomial_cdf(F.ceil(ctrl), F.ceil(sig + ctrl), F.lit(1.0 / (min_fold + 1)))
    mean = min_fold * F.greatest(ctrl, total * background)
    a = 1 - poisson_cdf(F.ceil(sig) - 1, mean)
    none = (sig + ctrl <= 0) | ((ctrl > 0) & (sig <= min_fold * ctrl))
    return F.when(none, F.lit(1.0)).otherwise(F.greatest(b, F.greatest(a, F.lit(0.0))))


def benjamini_hochberg(rows: DataFrame, keys: Sequence[str], p: str, counts: str, tie: Sequence[str], q: str = "q", monotone: bool = False) -> DataFrame:
    """``rows`` with ``q`` = min(1, p * n / rank) within ``keys``; n is all rows of the key.

    The order is p, then larger ``counts``, then ``tie``. Ranks are counted in ranges
    (``running_totals``), so no task orders a whole key or all rows of one p. With
    ``monotone`` the least q of all larger p is kept instead.
    """
    order = [F.col(p), F.col(counts).desc(), *[F.col(c) for c in tie]]
    t = running_totals(rows, keys, order, {"_rank": F.lit(1)}, {"_rank": "_all"})
    t = t.withColumn(q, F.least(F.lit(1.0), F.col(p) * F.col("_all") / F.col("_rank")))
    if monotone:
        behind = t.groupBy(*keys, "_range").agg(F.min(q).alias("_least"))
        back = Window.partitionBy(*keys).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
        behind = behind.withColumn("_later", F.min("_least").over(back)).drop("_least")
        t = t.join(behind, [*keys, "_range"])
        last_first = Window.partitionBy(*keys, "_range").orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        t = t.withColumn(q, F.least(F.min(q).over(last_first), F.coalesce("_later", F.lit(1.0))))
    return t.select(*rows.columns, q)


def running_ratio(windows: DataFrame, keys: Sequence[str], at: Column) -> DataFrame:
    """``keys, at, upto_s, upto_c, upto``: signal, control and number of ``windows`` (``s, c``) up to each distinct value of ``at``."""
    each = windows.groupBy(*keys, at.alias("at")).agg(F.sum("s").alias("_s"), F.sum("c").alias("_c"), F.count("*").alias("_n"))
    return running_totals(each, keys, [F.col("at")], {"upto_s": F.col("_s"), "upto_c": F.col("_c"), "upto": F.col("_n")}).select(*keys, "at", "upto_s", "upto_c", "upto")


def replicate_scaling(event_rep: DataFrame, event: Sequence[str]) -> DataFrame:
    """``cond_id, rep_a, rep_b, scale``: the factor that brings counts of b to those of a, for all ordered pairs of replicates of a condition.

    For a before b it is the slope through the origin of a's signal on b's over all events,
    an event without a count having 0; for the mirrored pair its inverse. Pairs without a
    slope (no counts of b, or no event with counts of both) have no scale.
    """
    reps = event_rep.groupBy("cond_id", "rep_id").agg(F.sum(F.col("sig") * F.col("sig")).alias("_yy"))
    # the replicates of one event and condition are as many as the design names
    each = event_rep.groupBy(*event, "cond_id").agg(F.collect_list(F.struct("rep_id", "sig")).alias("_r"))
    a, b = (each.select("cond_id", "_r", F.explode("_r").alias("_a")), F.filter("_r", lambda r: r["rep_id"] > F.col("_a.rep_id")))
    both = a.select("cond_id", "_a", F.explode(b).alias("_b"))
    xy = both.groupBy("cond_id", F.col("_a.rep_id").alias("rep_a"), F.col("_b.rep_id").alias("rep_b")).agg(F.sum(F.col("_a.sig") * F.col("_b.sig")).alias("_xy"))
    yy = reps.select(F.col("cond_id").alias("_c"), F.col("rep_id").alias("_rep"), "_yy")
    one = xy.join(yy, (F.col("cond_id") == F.col("_c")) & (F.col("rep_b") == F.col("_rep"))).select("cond_id", "rep_a", "rep_b", F.try_divide("_xy", "_yy").alias("scale"))
    one = one.where("scale > 0")
    return one.unionByName(one.select("cond_id", F.col("rep_b").alias("rep_a"), F.col("rep_a").alias("rep_b"), (1 / F.col("scale")).alias("scale")))


def consistent_pairs(event_rep: DataFrame, scaling: DataFrame, event: Sequence[str], q: float = 0.01, min_fold: float = 1.5) -> DataFrame:
    """``event, cond_id, consistent``: no ordered pair of replicates differs by more than ``min_fold`` significantly.

    Of a's count and b's scaled count (rounded up together), b's share must not be
    significantly under 1 / (min_fold + 1). A replicate without a count at an event has 0. An
    event without pairs (one replicate, no scale) is consistent.
    """
    each = event_rep.groupBy(*event, "cond_id").agg(F.map_from_entries(F.collect_list(F.struct("rep_id", "sig"))).alias("_sig"))
    j = each.join(scaling, "cond_id", "left")
    a = F.coalesce(F.try_element_at("_sig", F.col("rep_a")), F.lit(0.0))
    b = F.coalesce(F.try_element_at("_sig", F.col("rep_b")), F.lit(0.0)) * F.col("scale")
    # as columns of their own, which each step of the test reads
    j = j.withColumn("_k", F.round(b, 9)).withColumn("_n", F.ceil(F.round(a + F.col("_k"), 9))).withColumn("_k", F.ceil("_k"))
    p, n = binomial_cdf(F.col("_k"), F.col("_n"), F.lit(1.0 / (min_fold + 1))), F.col("_n")
    return j.groupBy(*event, "cond_id").agg(F.min(F.coalesce(F.when(n > 0, p > q), F.lit(True))).alias("consistent"))


def replication_code(n_reps: Column, found: Column, n_significant: Column, cond_q: Column, consistent: Column, q: float = 0.01) -> Column:
    """``S`` single replicate, whatever is found; ``X`` not found or not significant; the number of significant replicates from 2; else ``1`` or, in disagreement, ``D``."""
    one = (n_significant == 1) | (cond_q <= q)
    return (
        F.when(n_reps <= 1, "S")
        .when(~found, "X")
        .when(n_significant >= 2, n_significant.cast("string"))
        .when(one & consistent, "1")
        .when(one, "D")
        .otherwise("X")
    )
