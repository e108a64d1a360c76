"""Expressions on chromosome names, points and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plain_chrom(c: Column | str) -> Column:
    """``chr7`` and ``7`` become ``7``."""
    return F.regexp_replace(_col(c), "^chr", "")


def point_chrom(c: Column | str) -> Column:
    """Chromosome of ``chrom:pos`` or ``chrom:pos:strand``, without its prefix."""
    return plain_chrom(F.split_part(_col(c), F.lit(":"), F.lit(1)))


def point_pos(c: Column | str) -> Column:
    """Position of a point as bigint; null where it isn't a number."""
    return F.split_part(_col(c), F.lit(":"), F.lit(2)).try_cast("bigint")


def point_strand(c: Column | str) -> Column:
    """``+``, ``-`` or null."""
    return F.nullif(F.split_part(_col(c), F.lit(":"), F.lit(3)), F.lit(""))


def is_count(c: Column | str) -> Column:
    """True for finite numbers of at least 0; never null."""
    c = _col(c)
    return F.coalesce((c >= 0) & ~F.isnan(c) & (c < float("inf")), F.lit(False))


def counts_only(c: Column | str) -> Column:
    """The number where it is a count, else null."""
    return F.when(is_count(c), _col(c))
