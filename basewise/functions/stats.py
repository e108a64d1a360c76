"""Tail probabilities as column expressions.

Sums run over pmf terms in log space inside one higher-order ``aggregate``, so large means
neither underflow nor leave the JVM. Only terms that can matter to a double are summed: about
30 standard deviations of them, however large the counts are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1, by Stirling's series from x + 8 on."""
    z = x + 8.0
    below = x
    for k in range(1, 8):
        below = below * (x + float(k))
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * z * z * z * z * z * z * z)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - F.ln(below)


def _log_factorial(k: Column) -> Column:
    return F.when(k <= 1, F.lit(0.0)).otherwise(log_gamma(k + 1.0))


def _terms(k: Column, centre: Column, spread: Column) -> tuple[Column, Column]:
    """First and last term of a lower tail up to ``k`` that matter; those further below the smaller of k and the centre, or above the centre, add nothing."""
    reach = F.sqrt(F.greatest(F.least(k.cast("double"), centre), F.lit(0.0)))
    first = F.greatest(F.floor(F.least(k.cast("double"), centre) - 10 * reach - 30), F.lit(0))
    last = F.least(k.cast("bigint"), F.ceil(centre + 20 * spread + 100))
    return first.cast("bigint"), F.greatest(last.cast("bigint"), first.cast("bigint"))


def poisson_cdf(k: Column, mean: Column) -> Column:
    """P(X <= k) for a Poisson variable of ``mean`` >= 0; 0 for k < 0, 1 for mean 0."""
    top = F.greatest(k.cast("bigint"), F.lit(0))
    lo, hi = _terms(top, mean, F.sqrt(mean))
    start = F.when(lo == 0, -mean).otherwise(-mean + lo * F.ln(mean) - _log_factorial(lo))
    acc = F.aggregate(
        F.sequence(lo, hi),
        F.struct(start.alias("lt"), F.lit(0.0).alias("s"), F.ln(mean).alias("m")),
        lambda a, i: F.struct((a["lt"] + a["m"] - F.ln(i + 1)).alias("lt"), (a["s"] + F.exp(a["lt"])).alias("s"), a["m"].alias("m")),
        lambda a: F.least(a["s"], F.lit(1.0)),
    )
    return F.when(k < 0, F.lit(0.0)).when(mean <= 0, F.lit(1.0)).otherwise(acc)


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for n trials of probability 0 < p < 1; 0 for k < 0, 1 for k >= n."""
    n, k = n.cast("bigint"), k.cast("bigint")
    top = F.least(F.greatest(k, F.lit(0)), F.greatest(n, F.lit(0)))
    lo, hi = _terms(top, n * p, F.sqrt(n * p * (1 - p)))
    start = n * F.ln(1 - p)
    start = F.when(lo == 0, start).otherwise(_log_factorial(n) - _log_factorial(lo) - _log_factorial(n - lo) + lo * F.ln(p) + (n - lo) * F.ln(1 - p))
    acc = F.aggregate(
        F.sequence(lo, hi),
        F.struct(start.alias("lt"), F.lit(0.0).alias("s"), (F.ln(p) - F.ln(1 - p)).alias("o"), n.cast("double").alias("n")),
        # past the last trial no term is left
        lambda a, i: F.struct(
            (a["lt"] + F.coalesce(F.ln(F.nullif(a["n"] - i, F.lit(0.0)) / (i + 1)), F.lit(-1e9)) + a["o"]).alias("lt"),
            (a["s"] + F.exp(a["lt"])).alias("s"), a["o"].alias("o"), a["n"].alias("n"),
        ),
        lambda a: F.least(a["s"], F.lit(1.0)),
    )
    return F.when(k < 0, F.lit(0.0)).when(k >= n, F.lit(1.0)).otherwise(acc)


def poisson_threshold(mean: Column, log_conf: float) -> Column:
    """The least k >= 1 with P(X >= k) < 10 ** ``log_conf``."""
    last = F.ceil(mean + 15 * F.sqrt(mean) + 60).cast("int")
    acc = F.aggregate(
        F.sequence(F.lit(0), last),
        F.struct((-mean).alias("lt"), F.lit(0.0).alias("s"), F.lit(None).cast("int").alias("k")),
        lambda a, i: F.struct(
            (a["lt"] + F.ln(mean) - F.ln(i + 1)).alias("lt"),
            (a["s"] + F.exp(a["lt"])).alias("s"),
            F.coalesce(a["k"], F.when((i >= 1) & (1 - a["s"] < 10.0**log_conf), i)).alias("k"),
        ),
        lambda a: a["k"],
    )
    return F.when(mean <= 0, F.lit(1)).otherwise(acc)
