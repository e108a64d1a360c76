"""Strict loading of region, peak and motif lines, with a reason for each line that fails.

The loader keeps the offset of each record, loads only records that conform to the format of
their file kind, subtracts the loaded offsets from the raw ones (an anti-join) and diagnoses
what remains. Formats:

- trailing carriage returns and blanks don't belong to a line; lines then empty, or beginning
  with ``#``, ``track `` or ``browser ``, are skipped, as are null lines;
- fields are separated by one tab; a field may stand in double quotes, with quotes doubled
  inside; quotes stand nowhere else;
- a failing line gets the first of ``quoting``, ``columns`` and ``value`` that applies. A line of
  an unknown or null file kind has no valid number of columns.

The patterns only repeat possessively, so they take time in proportion to a line's length and
no stack, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewise.functions.genome import plain_chrom
from basewise.operators.intervals import small_side

FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^\t"]*+)'
SCORE = r"^[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?$"
#: file kind: least and most columns
COLUMNS = {"exclude": (1, 1), "excludebed": (3, 6), "peak": (3, 3), "motif": (4, 4)}


def stripped(line: Column) -> Column:
    return F.rtrim(line, F.lit("\r "))


def is_record(line: Column) -> Column:
    """False for null, blank, comment and header lines."""
    s = stripped(line)
    skip = (s == "") | s.startswith("#") | s.startswith("track ") | s.startswith("browser ")
    return F.coalesce(~skip, F.lit(False))


def quoting_holds(line: Column) -> Column:
    return line.rlike(rf"\A{FIELD}(?:\t{FIELD})*+\z")


def fields(line: Column) -> Column:
    """Unquoted fields of a line whose quoting holds."""
    raw = F.regexp_extract_all(F.concat(F.lit("\t"), line), F.lit(rf"\t({FIELD})"), F.lit(1))
    return F.transform(raw, lambda f: F.when(f.startswith('"'), F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))


def number(digits: Column) -> Column:
    """Bigint of a string of digits 0-9 only, else null. Numbers over 18 digits, which no coordinate has, are null."""
    kept = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return F.when(digits.rlike(r"\A[0-9]++\z") & (F.length(kept) <= 18), kept.try_cast("bigint"))


def _columns_fit(kind: Column, n: Column) -> Column:
    fit = F.lit(False)
    for name, (least, most) in COLUMNS.items():
        fit = F.when(kind == name, n.between(least, most)).otherwise(fit)
    return F.coalesce(fit, F.lit(False))


def parsed(lines: DataFrame, genome: DataFrame) -> DataFrame:
    """``lines`` with ``_quoted``, ``_fits``, ``_valid`` and the typed columns of each record."""
    s, kind, f = F.col("_s"), F.col("file_kind"), F.col("_f")
    at = lambda i: F.get(f, F.lit(i))
    bed = kind == "excludebed"
    # chrom:start-end[:strand] or chrom:pos[:strand]; the chromosome is all before the first colon
    place = at(0)
    part = lambda i: F.get(F.col("_place"), F.lit(i))
    span = F.col("_span")
    parts = F.size("_place")
    typed = (
        lines.where(is_record(F.col("line")))
        .withColumn("_s", stripped(F.col("line")))
        .withColumn("_quoted", quoting_holds(s))
        .withColumn("_f", F.when(F.col("_quoted"), fields(s)))
        .withColumn("_fits", F.col("_quoted") & _columns_fit(kind, F.size(f)))
        .withColumn("_place", F.when(F.col("_fits"), F.split(place, ":")))
        .withColumn("_span", F.split(part(1), "-"))
        .withColumn("_chrom", F.when(bed, at(0)).otherwise(part(0)))
        .withColumn("_a", F.when(bed, number(at(1))).when(kind == "peak", number(part(1))).otherwise(number(F.get(span, F.lit(0)))))
        .withColumn("_b", F.when(bed, number(at(2))).when(kind == "peak", number(part(1))).otherwise(number(F.get(span, F.lit(1)))))
        .withColumn("_strand", F.when(bed, at(5)).when(kind == "peak", part(2)).when(kind == "motif", part(2)))
        .withColumn("_name", F.when(bed, at(3)).when(kind != "exclude", at(1)))
        .withColumn("_score", F.when(bed, at(4)).when(kind != "exclude", at(2)))
        .withColumn("_seq", F.when(kind == "motif", at(3)))
    )
    g = small_side(genome.select(F.col("chrom").alias("_gchrom"), F.col("len").alias("_len")))
    typed = typed.join(g, plain_chrom("_chrom") == F.col("_gchrom"), "left")
    a, b, n = F.col("_a"), F.col("_b"), F.col("_len")
    score = F.col("_score").rlike(SCORE)
    signed = F.col("_strand").isin("+", "-")
    shape = (
        F.when(kind == "exclude", (parts == 2) & (F.size(span) == 2))
        .when(kind == "peak", ((parts == 2) | ((parts == 3) & signed)) & score)
        .when(kind == "motif", (parts == 3) & (F.size(span) == 2) & signed & score & F.col("_seq").rlike(r"\A[ACGTNacgtn]++\z"))
        .when(
            bed,
            (F.col("_score").isNull() | score | (F.col("_score") == "."))
            & (F.col("_strand").isNull() | signed | (F.col("_strand") == ".")),
        )
    )
    range_holds = F.when(bed, (a >= 0) & (a < b) & (b <= n)).otherwise((a >= 1) & (a <= b) & (b <= n))
    return typed.withColumn("_valid", F.coalesce(F.col("_fits") & shape & range_holds, F.lit(False)))


def strict_load(lines: DataFrame, genome: DataFrame) -> DataFrame:
    """Typed rows of the conforming records.

    ``line_id, file_kind, file_name, line_no, line, chrom, rstart, rend, strand, name, score,
    sequence``: closed 1-based coordinates; ``strand`` and ``score`` are null where the line has
    none or ``.``.
    """
    ok = parsed(lines, genome).where("_valid")
    bed = F.col("file_kind") == "excludebed"
    return ok.select(
        "line_id",
        "file_kind",
        "file_name",
        "line_no",
        "line",
        F.col("_gchrom").alias("chrom"),
        F.when(bed, F.col("_a") + 1).otherwise(F.col("_a")).alias("rstart"),
        F.col("_b").alias("rend"),
        F.nullif(F.col("_strand"), F.lit(".")).alias("strand"),
        F.col("_name").alias("name"),
        F.col("_score").try_cast("double").alias("score"),
        F.col("_seq").alias("sequence"),
    )


def rejected(lines: DataFrame, genome: DataFrame) -> DataFrame:
    """``line_id, file_kind, line, reason`` of each record that the strict load left out.

    Offsets are subtracted null-safely together with kind and text, which alone decide whether
    a record conforms; so repeated, null and clashing offsets lose and invent no record.
    """
    loaded = strict_load(lines, genome).select(F.col("line_id").alias("_i"), F.col("file_kind").alias("_k"), F.col("line").alias("_l")).distinct()
    raw = lines.select("line_id", "file_kind", "line").where(is_record(F.col("line")))
    left = raw.join(
        loaded,
        raw["line_id"].eqNullSafe(loaded["_i"]) & raw["file_kind"].eqNullSafe(loaded["_k"]) & raw["line"].eqNullSafe(loaded["_l"]),
        "left_anti",
    )
    s = stripped(F.col("line"))
    n = F.when(quoting_holds(s), F.size(fields(s)))
    reason = F.when(~quoting_holds(s), "quoting").when(~_columns_fit(F.col("file_kind"), n), "columns").otherwise("value")
    return left.select("line_id", "file_kind", "line", reason.alias("reason"))
