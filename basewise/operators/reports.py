"""Result tables of events: report predicates, formatted columns and wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_reported(found: Column, cond_q: Column, least_rep_q: Column, code: Column, q: float = 0.01, mode: str = "standard") -> Column:
    """Whether an event of a condition is reported.

    ``standard``: found and significant. ``lenient``: that, or any replicate significant,
    found or not. ``lenientplus``: as lenient, but not where the replicates disagree (code D).
    """
    standard = F.coalesce(found & (cond_q <= q), F.lit(False))
    lenient = standard | F.coalesce(least_rep_q <= q, F.lit(False))
    if mode == "standard":
        return standard
    if mode == "lenient":
        return lenient
    if mode == "lenientplus":
        return standard | (lenient & ~F.coalesce(code == "D", F.lit(False)))
    raise ValueError(f"unknown mode {mode}")


def log2_column(x: Column, digits: int = 3) -> Column:
    """log2 to ``digits`` places; null for 0 and what is no positive finite number."""
    real = (x > 0) & ~F.isnan(x) & (x < float("inf"))
    return F.when(real, F.round(F.log2(x), digits))


def bed_score(q: Column) -> Column:
    """min(-10 log2 q, 1000), at least 0, without its fraction; 1000 for q = 0."""
    return F.when(q <= 0, F.lit(1000)).otherwise(F.greatest(F.least(-10 * F.log2(q), F.lit(1000.0)), F.lit(0.0)).cast("int"))


def bed_rows(events: DataFrame) -> DataFrame:
    """``chrom, bstart, bend, name, score`` from ``chrom, pos, q``: 0-based half-open with the chromosome's prefix."""
    name = F.concat_ws(":", "chrom", F.col("pos").cast("string"))
    return events.select(
        F.concat(F.lit("chr"), "chrom").alias("chrom"), (F.col("pos") - 1).alias("bstart"), F.col("pos").alias("bend"), name.alias("name"), bed_score(F.col("q")).alias("score")
    )


def wide_table(rows: DataFrame, keys: Sequence[str], pivot: str, values: Sequence[int | str], columns: dict[str, Column]) -> DataFrame:
    """One row for each key with a group of ``columns`` for each of ``values`` of ``pivot``, named ``{value}_{column}``.

    The values are given, so the table is one conditional aggregate and its columns don't
    depend on the rows.
    """
    cells = [F.max(F.when(F.col(pivot) == v, c)).alias(f"{v}_{name}") for v in values for name, c in columns.items()]
    return rows.groupBy(*keys).agg(*cells)


def found_in(rows: DataFrame, keys: Sequence[str], condition: str, found: str, name: str = "found_in") -> DataFrame:
    """``keys, name``: the flag of each condition in order, as ``1,0,...``."""
    each = F.array_sort(F.collect_list(F.struct(condition, F.col(found).cast("int").alias("f"))))
    return rows.groupBy(*keys).agg(F.concat_ws(",", F.transform(each, lambda x: x["f"].cast("string"))).alias(name))


def dominant_form(tau: Column) -> tuple[Column, Column, Column]:
    """Type, strand and share of the largest of ``tau`` (for each type its plus, then its minus form); the first wins ties."""
    k = F.array_position(tau, F.array_max(tau)).cast("int") - 1
    return (F.floor(k / 2)).cast("int"), F.when(k % 2 == 0, "+").otherwise("-"), F.array_max(tau)


def dominant_type(tau: Column) -> tuple[Column, Column, Column]:
    """Type of the largest share of both strands together, the first among equals, its strand (plus only if it has more) and that share."""
    pairs = F.transform(F.sequence(F.lit(0), (F.size(tau) / 2).cast("int") - 1), lambda t: F.get(tau, 2 * t) + F.get(tau, 2 * t + 1))
    t = F.array_position(pairs, F.array_max(pairs)).cast("int") - 1
    return t, F.when(F.get(tau, 2 * t) > F.get(tau, 2 * t + 1), "+").otherwise("-"), F.array_max(pairs)


def aligned_point(pos: Column, strand: Column, offset: Column, reverse: Column) -> tuple[Column, Column]:
    """A point moved by its motif's offset in its own direction; against it, and with the strand turned, for a reversed motif."""
    moved = F.when((strand == "+") != reverse, pos + offset).otherwise(pos - offset)
    return moved, F.when(reverse, F.when(strand == "+", "-").otherwise("+")).otherwise(strand)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    """A folder of tab-separated files; an empty table still writes its header."""
    df.write.mode("overwrite").option("sep", "\t").option("header", header).option("nullValue", "").csv(path)


def write_bed(events: DataFrame, path: str) -> None:
    write_tsv(bed_rows(events), path, header=False)


def write_by_replicate(rows: DataFrame, path: str) -> None:
    """One folder for each condition and replicate. Slashes in names become dashes."""
    safe = rows.withColumns({c: F.replace(F.col(c).cast("string"), F.lit("/"), F.lit("-")) for c in ("cond", "rep")})
    safe.write.mode("overwrite").partitionBy("cond", "rep").option("sep", "\t").option("header", True).csv(path)
