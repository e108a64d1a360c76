"""Text formats: genome lengths, designs, reads, sequences, densities, motifs and settings."""

from __future__ import annotations

import math
import re
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basewise.functions.genome import plain_chrom
from basewise.operators.intervals import overlapping


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, len`` from a file of name and length; a name given twice has the larger length."""
    g = spark.read.schema("chrom string, len bigint").csv(path, sep="\t")
    return g.where("len is not null").groupBy(plain_chrom("chrom").alias("chrom")).agg(F.max("len").alias("len"))


def read_design(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, label, file_format, cond, rep``; comments are skipped, an empty replicate is null."""
    d = spark.read.schema("file_name string, label string, file_format string, cond string, rep string").csv(path, sep="\t", comment="#")
    return d.withColumn("label", F.lower("label")).withColumn("file_format", F.upper("file_format")).where(F.col("label").isin("signal", "control"))


def five_prime(start: Column, end: Column, strand: Column) -> Column:
    """1-based 5' position of a 0-based half-open read."""
    return F.when(strand == "-", end).otherwise(start + 1)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, pos, strand, cnt``: 5' counts by base and strand of a BED file. Lines without numbers or strand are left out."""
    b = spark.read.schema("chrom string, s bigint, e bigint, name string, score string, strand string").csv(path, sep="\t", comment="#")
    b = b.where("s is not null and e is not null and strand in ('+', '-')")
    return _counted(b.select(plain_chrom("chrom").alias("chrom"), five_prime(F.col("s"), F.col("e"), F.col("strand")).alias("pos"), "strand"))


def _counted(reads: DataFrame) -> DataFrame:
    return reads.groupBy("chrom", "pos", "strand").agg(F.count("*").cast("double").alias("cnt"))


def reference_length(cigar: Column) -> Column:
    """Bases of the reference that an alignment covers: the M, D, N, = and X of its CIGAR."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def read_sam(spark: SparkSession, path: str, unique: bool = False) -> DataFrame:
    """``chrom, pos, strand, cnt`` of a SAM text file. Unmapped, secondary and supplementary records are left out; with ``unique`` those of mapping quality 0 too."""
    f = F.split("value", "\t")
    r = spark.read.text(path).where(~F.col("value").startswith("@")).where(F.size(f) >= 11)
    flag = F.get(f, F.lit(1)).try_cast("int")
    r = r.select(flag.alias("flag"), F.get(f, F.lit(2)).alias("chrom"), F.get(f, F.lit(3)).try_cast("bigint").alias("start"), F.get(f, F.lit(4)).try_cast("int").alias("quality"), F.get(f, F.lit(5)).alias("cigar"))
    r = r.where((F.col("flag").bitwiseAND(F.lit(0x904)) == 0) & (F.col("start") > 0))
    if unique:
        r = r.where("quality > 0")
    minus = F.col("flag").bitwiseAND(F.lit(16)) != 0
    pos = F.when(minus, F.col("start") + reference_length(F.col("cigar")) - 1).otherwise(F.col("start"))
    return _counted(r.select(plain_chrom("chrom").alias("chrom"), pos.alias("pos"), F.when(minus, "-").otherwise("+").alias("strand")))


def capped(counts: DataFrame, most: float) -> DataFrame:
    """Counts of one base limited to ``most``."""
    return counts.withColumn("cnt", F.least("cnt", F.lit(float(most))))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, start, sequence``: the lines of FASTA files with their 1-based start on the chromosome.

    Files are read in blocks by many tasks. Lengths are summed along the lines of a block, and
    only each block's totals are carried to the next one of its file.
    """
    header = F.col("value").startswith(">")
    l = spark.read.text(path).select(
        F.rtrim(F.col("value")).alias("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")
    )
    l = l.withColumn("_name", F.when(header, plain_chrom(F.regexp_extract("value", r"^>(\S*)", 1)))).withColumn("_len", F.when(header, 0).otherwise(F.length("value")).cast("bigint"))
    within = Window.partitionBy("_file", "_block").orderBy("_at")
    l = l.withColumn("_part", F.count("_name").over(within)).withColumn("_named", F.last("_name", ignorenulls=True).over(within))
    l = l.withColumn("_upto", F.sum("_len").over(Window.partitionBy("_file", "_block", "_part").orderBy("_at")))
    blocks = l.groupBy("_file", "_block").agg(F.max("_part").alias("_parts"), F.max_by("_named", "_at").alias("_open"), F.max_by("_upto", "_at").alias("_tail"))
    along = Window.partitionBy("_file").orderBy("_block")
    blocks = blocks.withColumn("_group", F.sum((F.col("_parts") > 0).cast("int")).over(along))
    blocks = blocks.withColumn("_sum", F.sum("_tail").over(Window.partitionBy("_file", "_group").orderBy("_block")))
    blocks = blocks.select("_file", "_block", F.lag("_sum").over(along).alias("_carry"), F.last("_open", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    j = l.where((F.col("_len") > 0)).join(blocks, ["_file", "_block"])
    first = F.col("_part") == 0  # goes on with the sequence of the block before
    start = F.col("_upto") - F.col("_len") + 1 + F.when(first, F.coalesce("_carry", F.lit(0))).otherwise(0)
    return j.select(F.when(first, F.col("_before")).otherwise(F.col("_named")).alias("chrom"), start.alias("start"), F.col("value").alias("sequence"))


def windows(fasta: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """``points`` (``point_id, chrom, pos``) with ``start`` and ``sequence`` of the ``width`` bases around each, clipped to the chromosome."""
    half = width // 2
    p = points.select("point_id", "chrom", "pos", F.greatest(F.col("pos") - half, F.lit(1)).alias("_a"), (F.col("pos") + half - 1).alias("_z"))
    f = fasta.select("chrom", F.col("start").alias("_s"), (F.col("start") + F.length("sequence") - 1).alias("_e"), "sequence")
    j = overlapping(p, f, "_a", "_z", "_s", "_e", limit=0)
    first = F.greatest(F.col("_a") - F.col("_s"), F.lit(0))
    part = F.substr("sequence", (first + 1).cast("int"), (F.col("_z") - F.col("_s") - first + 1).cast("int"))
    g = j.groupBy("point_id", "chrom", "pos", "_a").agg(F.array_sort(F.collect_list(F.struct("_s", part.alias("t")))).alias("_parts"))
    return g.select("point_id", "chrom", "pos", F.col("_a").alias("start"), F.concat_ws("", F.transform("_parts", lambda x: x["t"])).alias("sequence"))


def read_settings(path: str, given: dict[str, str | bool]) -> dict[str, str | bool]:
    """Lines of a name and perhaps a value, with what is ``given`` on the command line on top. Comments and empty lines are skipped."""
    out: dict[str, str | bool] = {}
    for line in Path(path).read_text().splitlines():
        words = line.split()
        if words and not words[0].startswith("#"):
            out[words[0].lstrip("-")] = " ".join(words[1:]) or True
    return out | given


def read_density(path: str) -> np.ndarray:
    """Values from the first to the last distance of a file of distance and value, gaps on straight lines. Negative values and unsorted distances are errors."""
    rows = np.loadtxt(path, ndmin=2, comments="#")[:, :2]
    if (rows[:, 1] < 0).any() or (np.diff(rows[:, 0]) <= 0).any():
        raise ValueError(f"{path}: values must not be negative and distances must rise")
    d = np.arange(rows[0, 0], rows[-1, 0] + 1)
    return np.column_stack([d, np.interp(d, rows[:, 0], rows[:, 1])])


def write_density(path: str, density: np.ndarray) -> None:
    Path(path).write_text("".join(f"{int(d)}\t{float(v)!r}\n" for d, v in density))


def read_transfac(path: str) -> dict[str, np.ndarray]:
    """Matrices of base counts by name, positions in rows, in the order of the file."""
    out, name, rows = {}, None, []
    for line in Path(path).read_text().splitlines():
        words = line.split()
        if not words:
            continue
        if words[0] in ("DE", "ID", "NA") and name is None:
            name = words[1] if len(words) > 1 else f"motif{len(out) + 1}"
        elif words[0].isdigit():
            rows.append([float(x) for x in words[1:5]])
        elif words[0] in ("XX", "//"):
            if rows:
                out[name or f"motif{len(out) + 1}"] = np.array(rows)
            if words[0] == "//" or rows:
                name, rows = None, []
    if rows:
        out[name or f"motif{len(out) + 1}"] = np.array(rows)
    return out


def write_transfac(path: str, motifs: dict[str, np.ndarray]) -> None:
    parts = []
    for name, m in motifs.items():
        parts.append(f"DE\t{name}\n" + "".join(f"{k}\t" + "\t".join(f"{x:g}" for x in row) + "\n" for k, row in enumerate(m)) + "XX\n")
    Path(path).write_text("".join(parts))


def read_meme(path: str, pseudo: float = 0.001) -> tuple[dict[str, float], list[np.ndarray]]:
    """Background frequencies and letter-probability matrices of a MEME text file; ``pseudo`` is added and rows are scaled to 1."""
    text = Path(path).read_text()
    background: dict[str, float] = {}
    m = re.search(r"Background letter frequencies[^\n]*\n((?:[ACGT] [\d.]+ ?)+)", text)
    if m:
        words = m[1].split()
        background = {b: float(f) for b, f in zip(words[::2], words[1::2])}
    out = []
    for m in re.finditer(r"letter-probability matrix:[^\n]*w= *(\d+)[^\n]*\n", text):
        rows = text[m.end() :].splitlines()[: int(m[1])]
        p = np.array([[float(x) for x in r.split()[:4]] for r in rows]) + pseudo
        out.append(p / p.sum(axis=1, keepdims=True))
    return background, out


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """``gene, chrom, tss, strand`` of a tab-separated refGene table (bin, name, chrom, strand, start, end, ...)."""
    f = F.split("value", "\t")
    at = lambda k: F.get(f, F.lit(k))
    g = spark.read.text(path).where(~F.col("value").startswith("#"))
    s, e = at(4).try_cast("bigint"), at(5).try_cast("bigint")
    return g.select(at(1).alias("gene"), plain_chrom(at(2)).alias("chrom"), F.when(at(3) == "-", e).otherwise(s + 1).alias("tss"), at(3).alias("strand")).where("tss is not null")


def read_point_lists(spark: SparkSession, path: str) -> DataFrame:
    """``cluster, chrom, pos, strand`` of the files of points (``chrom:pos`` or ``chrom:pos:strand``, then any columns) that a file names, one a line; clusters count from 0 in its order.

    Only names come to the driver. A blank line names no file; a line that is no point is left out.
    """
    names = [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip()]
    out = None
    for k, name in enumerate(names):
        place = F.split(F.split_part("value", F.lit("\t"), F.lit(1)), ":")
        at = lambda i: F.get(place, F.lit(i))  # noqa: B023,E731
        p = spark.read.text(name).select(F.lit(k).alias("cluster"), plain_chrom(at(0)).alias("chrom"), at(1).try_cast("bigint").alias("pos"), at(2).alias("strand")).where("pos is not null")
        out = p if out is None else out.unionByName(p)
    return spark.createDataFrame([], "cluster int, chrom string, pos bigint, strand string") if out is None else out


def write_sequences(rows: DataFrame, path: str, label: str = "label", sequence: str = "sequence") -> None:
    """A folder of text files with two lines for each row: ``>label`` and its sequence."""
    rows.select(F.concat(F.lit(">"), F.col(label), F.lit("\n"), F.col(sequence)).alias("value")).write.mode("overwrite").text(path)


# How lines of a saved composite model begin.
MODEL_LINE, COMPONENT_LINE, DENSITY_LINE = "#ProteinDNAInteractionModel", "#CompositeModelComponent", "#TagProbabilityDensity"


def read_composite_models(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Saved composite models, one a file: ``model, width, centre``; ``model, component, label, position, pi, density, plus, minus``; ``model, density, left, right, plus_density, minus_density``.

    ``model`` is the name of the file. A density is two lines behind its heading, for plus and
    minus: its values, or the offset and deviation of a normal curve, which is taken from
    ``left`` on. Lines of another kind are passed by; one with a wrong number of fields is an error.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("model"), F.split("value", "\\r?\\n").alias("lines"))
    lines = whole.select("model", "lines", F.posexplode("lines").alias("_at", "_line")).withColumn("_f", F.split("_line", ","))

    def of(kind: str, fields: int) -> DataFrame:
        d = lines.where(F.get("_f", F.lit(0)) == kind)
        return d.withColumn("_f", F.when(F.size("_f") == fields, F.col("_f")).otherwise(F.raise_error(F.concat(F.lit("unexpected fields: "), F.col("_line"))).cast("array<string>")))

    at = lambda k, kind: F.get("_f", F.lit(k)).cast(kind)
    models = of(MODEL_LINE, 4).select("model", at(1, "int").alias("width"), at(2, "int").alias("centre"))
    components = of(COMPONENT_LINE, 10).select(
        "model", at(1, "int").alias("component"), at(2, "string").alias("label"), at(3, "int").alias("position"), at(4, "double").alias("pi"), at(5, "int").alias("density"), at(8, "double").alias("plus"), at(9, "double").alias("minus")
    )

    def values(behind: int) -> Column:
        f = F.split(F.get("lines", F.col("_at") + behind), ",")
        given = F.transform(F.slice(f, 2, F.col("_n")), lambda v: v.cast("double"))
        middle, sigma = F.get(f, F.lit(1)).cast("double"), F.get(f, F.lit(2)).cast("double")
        curve = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.exp(-0.5 * F.pow((F.col("left") + i - middle) / sigma, F.lit(2.0))) / (sigma * math.sqrt(2 * math.pi)))
        return F.when(F.get(f, F.lit(0)).startswith("Gaussian"), curve).otherwise(given)

    densities = of(DENSITY_LINE, 5).withColumn("left", at(2, "int")).withColumn("_n", at(4, "int"))
    densities = densities.select("model", at(1, "int").alias("density"), "left", at(3, "int").alias("right"), values(1).alias("plus_density"), values(2).alias("minus_density"))
    return models, components, densities


def save_model(path: str, model: np.ndarray) -> None:
    """A model (forms, strands, distances) as lines of comma-separated numbers under one heading a form."""
    parts = []
    for k, form in enumerate(model):
        parts.append(f"#form,{k},{form.shape[1] // 2}\n" + "".join(",".join(repr(float(x)) for x in strand) + "\n" for strand in form))
    Path(path).write_text("".join(parts))


def load_model(path: str) -> np.ndarray:
    """A model written by ``save_model``."""
    forms: list[list[list[float]]] = []
    for line in Path(path).read_text().splitlines():
        if line.startswith("#"):
            forms.append([])
        elif line:
            forms[-1].append([float(x) for x in line.split(",")])
    return np.array(forms)
