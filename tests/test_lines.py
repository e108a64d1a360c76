"""Strict loading against a plain reading of the format."""

import re

import pytest
from pyspark.sql import types as T

from basewise.sources.lines import rejected, strict_load

SCHEMA = "line_id bigint, file_kind string, file_name string, line_no int, line string, extra map<string,string>"
GENOME = [("chr1", 1000), ("2", 500)]
SCORE = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", re.A)


def fields(line):
    """Fields by a character machine; None if the rule on quotes is broken."""
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            cell, i = "", i + 1
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        cell, i = cell + '"', i + 2
                        continue
                    i += 1
                    break
                cell, i = cell + line[i], i + 1
            if i < len(line) and line[i] != "\t":
                return None
        else:
            j = line.find("\t", i)
            j = len(line) if j < 0 else j
            cell, i = line[i:j], j
            if '"' in cell:
                return None
        out.append(cell)
        if i >= len(line):
            return out
        i += 1


def reason(kind, line):
    lens = {c.removeprefix("chr"): n for c, n in GENOME}
    if line is None:
        return "skip"
    line = line.rstrip("\r ")
    if not line or line.startswith(("#", "track ", "browser ")):
        return "skip"
    f = fields(line)
    if f is None:
        return "quoting"
    if not {"exclude": len(f) == 1, "excludebed": 3 <= len(f) <= 6, "peak": len(f) == 3, "motif": len(f) == 4}.get(kind, False):
        return "columns"
    num = lambda s: int(s) if re.fullmatch("[0-9]+", s, re.A) else None
    size = lambda c: lens.get(c.removeprefix("chr"), -1)
    if kind == "excludebed":
        a, b = num(f[1]), num(f[2])
        ok = a is not None and b is not None and 0 <= a < b <= size(f[0])
        ok &= len(f) < 5 or f[4] == "." or bool(SCORE.fullmatch(f[4]))
        ok &= len(f) < 6 or f[5] in "+-." and len(f[5]) == 1
        return None if ok else "value"
    p = f[0].split(":")
    if kind == "peak":
        a = num(p[1]) if len(p) in (2, 3) else None
        ok = a is not None and 1 <= a <= size(p[0]) and (len(p) == 2 or p[2] in ("+", "-")) and bool(SCORE.fullmatch(f[2]))
        return None if ok else "value"
    want = 2 if kind == "exclude" else 3
    ab = p[1].split("-") if len(p) == want else []
    a, b = (num(ab[0]), num(ab[1])) if len(ab) == 2 else (None, None)
    ok = a is not None and b is not None and 1 <= a <= b <= size(p[0])
    if kind == "motif":
        ok = ok and p[2] in ("+", "-") and bool(SCORE.fullmatch(f[2])) and bool(re.fullmatch("[ACGTNacgtn]+", f[3]))
    return None if ok else "value"


LINES = [
    ("exclude", "chr1:1-10"), ("exclude", "1:1-1000"), ("exclude", "chr1:1-1001"), ("exclude", "chr1:0-5"), ("exclude", "chr1:9-5"), ("exclude", "Chr1:1-5"), ("exclude", "chrchr1:1-5"),
    ("exclude", '"chr1:1-10"'), ("exclude", 'chr1:1-10"'), ("exclude", "chr1:1-10\t"), ("exclude", "chr1:1-10 \r \r"), ("exclude", "chr1:1-٣"), ("exclude", "chr1:+1-5"), ("exclude", "chr1:1-5-6"),
    ("exclude", "chr1:1-5:+"), ("exclude", "9:1-5"), ("exclude", "chr1:" + "0" * 60 + "5-7"), ("exclude", "chr1:1-" + "9" * 60), ("exclude", ""), ("exclude", None), ("exclude", "   \r"), ("exclude", "# x"),
    ("exclude", "track x"), ("exclude", "tracker"), ("exclude", "browser y"), ("exclude", "\t"), ("exclude", " chr1:1-5"), ("exclude", '""'),
    ("excludebed", "chr1\t0\t5"), ("excludebed", "2\t0\t500\tname\t.\t."), ("excludebed", "2\t0\t501"), ("excludebed", "2\t5\t5"), ("excludebed", "2\t1\t5\tn\t1e5\t+"), ("excludebed", "2\t1\t5\tn\tNaN\t+"),
    ("excludebed", "2\t1\t5\tn\t1\t+\tx"), ("excludebed", "2\t1"), ("excludebed", '2\t1\t5\t"a\tb""c"\t-.5e-3\t-'), ("excludebed", '2\t1\t5\ta"b'), ("excludebed", '2\t1\t5\t"a"b'), ("excludebed", '2\t1\t5\t"a'),
    ("excludebed", "2\t1\t5\tn\t1\t"), ("excludebed", '"2"\t"1"\t"5"'), ("excludebed", "2\t\t5"), ("excludebed", "2\t1\t5\t\t5.\t+ "),
    ("peak", "chr1:5\tn\t1.5"), ("peak", "1:5:-\tn\t+1"), ("peak", "1:5:.\tn\t1"), ("peak", "1:5\tn"), ("peak", "1:5\tn\tx"), ("peak", "1:0\tn\t1"), ("peak", "1:5:+:+\tn\t1"), ("peak", "1:5\tn\t1e"),
    ("motif", "1:5-9:+\tn\t1\tACGTNacgtn"), ("motif", "1:5-9:+\tn\t1\t"), ("motif", "1:5-9:+\tn\t1\tACGU"), ("motif", "1:5-9\tn\t1\tA"), ("motif", "1:5-9:-\tn\t12%\tA"),
    ("other", "x"), (None, "x"), ("motif", '1:5-9:+\t"' + '""' * 20000 + '"\t1\tA'), ("motif", '1:5-9:+\t"' + '""' * 20000 + "\t1\tA"), ("exclude", "x" + " " * 50000 + "y"),
]


def test_reasons_match_a_plain_reading(spark):
    data = [(i, k, "f", i, line, {"a": "b"}) for i, (k, line) in enumerate(LINES)]
    lines = spark.createDataFrame(data, SCHEMA)
    genome = spark.createDataFrame(GENOME, "chrom string, len bigint")
    from pyspark.sql import functions as F

    from basewise.functions.genome import plain_chrom

    genome = genome.select(plain_chrom(F.col("chrom")).alias("chrom"), "len")
    expected = {i: reason(k, line) for i, k, _, _, line, _ in data}
    got = {r["line_id"]: r["reason"] for r in rejected(lines, genome).collect()}
    loaded = {r["line_id"] for r in strict_load(lines, genome).collect()}
    assert got == {i: r for i, r in expected.items() if r not in (None, "skip")}
    assert loaded == {i for i, r in expected.items() if r is None}


def test_null_and_repeated_offsets_lose_nothing(spark):
    rows = [(None, "exclude", "f", 1, "1:1-5"), (None, "exclude", "f", 2, "bad"), (None, "exclude", "f", 3, "bad"), (7, "exclude", "f", 4, "1:1-5"), (7, "exclude", "f", 5, "1:5-1")]
    lines = spark.createDataFrame(rows, "line_id bigint, file_kind string, file_name string, line_no int, line string")
    genome = spark.createDataFrame([("1", 100)], "chrom string, len bigint")
    assert sorted((r["line_id"] or 0, r["line"], r["reason"]) for r in rejected(lines, genome).collect()) == [(0, "bad", "value"), (0, "bad", "value"), (7, "1:5-1", "value")]
    assert strict_load(lines, genome).count() == 2


def test_empty_table(spark):
    lines = spark.createDataFrame([], "line_id bigint, file_kind string, file_name string, line_no int, line string")
    genome = spark.createDataFrame([], "chrom string, len bigint")
    assert rejected(lines, genome).count() == 0 and strict_load(lines, genome).count() == 0
