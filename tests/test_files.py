"""Readers and writers of text formats."""

import numpy as np
import pytest

from basewise.operators import reports as rp
from basewise.sources import files as fl


def test_reads(spark, tmp_path):
    (tmp_path / "r.bed").write_text("chr1\t9\t30\tr\t0\t+\nchr1\t9\t40\tr\t0\t+\n1\t5\t20\tr\t0\t-\nbad\tx\ty\n")
    got = {tuple(r) for r in fl.read_bed(spark, str(tmp_path / "r.bed")).collect()}
    assert got == {("1", 10, "+", 2.0), ("1", 20, "-", 1.0)}
    rec = lambda flag, pos, q, cigar: f"q\t{flag}\tchr2\t{pos}\t{q}\t{cigar}\t*\t0\t0\tA\tI\n"
    (tmp_path / "r.sam").write_text("@HD\tVN:1\n" + rec(0, 10, 60, "5M") + rec(16, 10, 60, "2S5M3D2M1I") + rec(4, 10, 60, "5M") + rec(256, 10, 60, "5M") + rec(0, 7, 0, "5M"))
    assert {tuple(r) for r in fl.read_sam(spark, str(tmp_path / "r.sam")).collect()} == {("2", 10, "+", 1.0), ("2", 19, "-", 1.0), ("2", 7, "+", 1.0)}
    assert fl.read_sam(spark, str(tmp_path / "r.sam"), unique=True).count() == 2
    assert fl.capped(fl.read_bed(spark, str(tmp_path / "r.bed")), 1).agg({"cnt": "max"}).first()[0] == 1.0


def test_tables(spark, tmp_path):
    (tmp_path / "g").write_text("chr1\t100\n1\t120\nchr2\t5\n")
    assert {tuple(r) for r in fl.read_genome(spark, str(tmp_path / "g")).collect()} == {("1", 120), ("2", 5)}
    (tmp_path / "d").write_text("#x\na.bed\tSignal\tbed\tA\t1\nb.bed\tcontrol\tsam\tA\n")
    assert sorted((r["file_name"], r["label"], r["file_format"], r["rep"]) for r in fl.read_design(spark, str(tmp_path / "d")).collect()) == [("a.bed", "signal", "BED", "1"), ("b.bed", "control", "SAM", None)]
    (tmp_path / "genes").write_text("#h\n0\tg1\tchr1\t+\t9\t50\n0\tg2\tchr1\t-\t9\t50\n")
    assert {(r["gene"], r["tss"]) for r in fl.read_genes(spark, str(tmp_path / "genes")).collect()} == {("g1", 10), ("g2", 50)}


def test_sequences(spark, tmp_path):
    (tmp_path / "f.fa").write_text(">chr1 x\nACGTAC\nGTAAAA\n>2\nGG\nCC\n")
    f = fl.read_fasta(spark, str(tmp_path / "f.fa"))
    assert [(r["chrom"], r["start"], r["sequence"]) for r in f.orderBy("chrom", "start").collect()] == [("1", 1, "ACGTAC"), ("1", 7, "GTAAAA"), ("2", 1, "GG"), ("2", 3, "CC")]
    p = spark.createDataFrame([(1, "1", 6), (2, "1", 1), (3, "1", 12), (4, "2", 3)], "point_id bigint, chrom string, pos bigint")
    assert {r["point_id"]: r["sequence"] for r in fl.windows(f, p, 6).collect()} == {1: "GTACGT", 2: "ACG", 3: "AAAA", 4: "GGCC"}


def test_sequences_over_many_blocks(spark, tmp_path):
    """Files cut anywhere give the same lines."""
    rng = np.random.default_rng(1)
    for name in ("a", "b"):
        text = ""
        for c in range(4):
            text += f">chr{name}{c}\n" + "".join("".join(rng.choice(list("ACGT"), int(rng.integers(1, 70)))) + "\n" for _ in range(int(rng.integers(0, 60))))
        (tmp_path / name).write_text(text)
    want = set()
    for name in ("a", "b"):
        for line in (tmp_path / name).read_text().splitlines():
            if line[0] == ">":
                chrom, at = line[4:], 1
            else:
                want.add((chrom, at, line))
                at += len(line)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        f = fl.read_fasta(spark, str(tmp_path))
        assert {tuple(r) for r in f.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_small_files(tmp_path):
    (tmp_path / "c").write_text("# x\n--round 3\nnomotifs\n\nq 0.01\n")
    assert fl.read_settings(str(tmp_path / "c"), {"q": "0.05"}) == {"round": "3", "nomotifs": True, "q": "0.05"}
    (tmp_path / "d").write_text("-2 1\n0 3\n2 5\n")
    d = fl.read_density(str(tmp_path / "d"))
    assert d[:, 1].tolist() == [1, 2, 3, 4, 5]
    fl.write_density(str(tmp_path / "e"), d)
    assert (fl.read_density(str(tmp_path / "e")) == d).all()
    (tmp_path / "bad").write_text("0 1\n1 -1\n")
    with pytest.raises(ValueError):
        fl.read_density(str(tmp_path / "bad"))
    m = {"a": np.arange(12.0).reshape(3, 4), "b": np.ones((2, 4))}
    fl.write_transfac(str(tmp_path / "t"), m)
    back = fl.read_transfac(str(tmp_path / "t"))
    assert list(back) == ["a", "b"] and all((back[k] == m[k]).all() for k in m)
    (tmp_path / "m").write_text("Background letter frequencies (from x):\nA 0.3 C 0.2 G 0.2 T 0.3\n\nletter-probability matrix: alength= 4 w= 2 nsites= 3 E= 1\n 1.0 0.0 0.0 0.0\n 0.25 0.25 0.25 0.25\n\n")
    bg, ms = fl.read_meme(str(tmp_path / "m"))
    assert bg == {"A": 0.3, "C": 0.2, "G": 0.2, "T": 0.3} and ms[0].shape == (2, 4) and ms[0].sum() == pytest.approx(2) and (ms[0] > 0).all()
    x = np.random.default_rng(0).random((2, 2, 5))
    fl.save_model(str(tmp_path / "model"), x)
    assert (fl.load_model(str(tmp_path / "model")) == x).all()


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([("1", 10, 0.01), ("1", 20, 1.0), ("2", 5, 2.0**-200), ("2", 6, 0.0)], "chrom string, pos bigint, q double")
    rp.write_bed(e, str(tmp_path / "bed"))
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "bed"), sep="\t").collect()) == [("chr1", "19", "20", "1:20", "0"), ("chr1", "9", "10", "1:10", "66"), ("chr2", "4", "5", "2:5", "1000"), ("chr2", "5", "6", "2:6", "1000")]
    rp.write_bed(e.where("false"), str(tmp_path / "none"))
    assert (tmp_path / "none" / "_SUCCESS").exists()
    r = spark.createDataFrame([("a/b", "1", 5)], "cond string, rep string, n int")
    rp.write_by_replicate(r, str(tmp_path / "rep"))
    assert (tmp_path / "rep" / "cond=a-b" / "rep=1").is_dir()


def test_point_lists_and_sequences(spark, tmp_path):
    (tmp_path / "a").write_text("chr1:5:+\tx\n#no point\n2:7\n")
    (tmp_path / "b").write_text("chr3:9:-\n")
    (tmp_path / "list").write_text(f"{tmp_path / 'a'}\n\n{tmp_path / 'b'}\n")
    assert sorted(map(tuple, fl.read_point_lists(spark, str(tmp_path / "list")).collect())) == [(0, "1", 5, "+"), (0, "2", 7, None), (1, "3", 9, "-")]
    (tmp_path / "none").write_text("")
    assert fl.read_point_lists(spark, str(tmp_path / "none")).count() == 0
    fl.write_sequences(spark.createDataFrame([("1:1-4", "ACGT"), ("1:5-6", "NN")], "label string, sequence string"), str(tmp_path / "seq"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "seq")).collect()} == {">1:1-4", "ACGT", ">1:5-6", "NN"}


SAVED = """#ProteinDNAInteractionModel,9,4,3
#CompositeWatson,9,1,2,3
#CompositeModelComponent,0,CS,4,0.5,0,true,true,2.0,3.0
#CompositeModelComponent,1,Back,4,0.0,0,false,true,1.0,1.0
#CompositeModelComponent,2,XL,1,0.5,1,false,true,1.0,4.0
#TagProbabilityDensity,0,-1,1,3
EmpiricalW,0.1,0.7,0.2
EmpiricalC,0.3,0.3,0.4
#TagProbabilityDensity,1,-2,2,5
GaussianW,0,1
GaussianC,1,2
"""


def test_saved_composite_models(spark, tmp_path):
    from basewise.operators.profiles import flattened

    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.model").write_text(SAVED)
    (tmp_path / "m" / "b.model").write_text(SAVED.replace("\n", "\r\n").replace("0.5,1,false", "0,1,false"))
    models, components, densities = fl.read_composite_models(spark, str(tmp_path / "m"))
    assert {tuple(r) for r in models.collect()} == {("a.model", 9, 4), ("b.model", 9, 4)}
    assert components.count() == 6 and densities.count() == 4
    normal = lambda d, m, s: np.exp(-0.5 * ((d - m) / s) ** 2) / (s * np.sqrt(2 * np.pi))
    d = np.arange(-2, 3)
    table = {0: ([0.1, 0.7, 0.2], [0.3, 0.3, 0.4]), 1: (normal(d, 0, 1), normal(d, 1, 2))}
    got = {(r["model"], r["offset"], r["strand"]): r["value"] for r in flattened(models, components, densities).collect()}
    want = {}
    for name, parts in (("a.model", [(4, 0, 2.0, 3.0), (1, 1, 1.0, 4.0)]), ("b.model", [(4, 0, 2.0, 3.0)])):
        for position, k, plus, minus in parts:
            for strand, p, r in zip("+-", table[k], (plus, minus)):
                for i, x in enumerate(p):
                    place = position - len(p) // 2 + i
                    if 0 <= place < 9:
                        key = name, place - 4, strand
                        want[key] = want.get(key, 0) + x * r
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    (tmp_path / "bad.model").write_text(SAVED.replace("2.0,3.0", "2.0"))
    with pytest.raises(Exception, match="unexpected fields"):
        fl.read_composite_models(spark, str(tmp_path / "bad.model"))[1].collect()
