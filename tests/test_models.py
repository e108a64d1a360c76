"""Clusters, alignments, shifts, motifs, simulation and tails against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewise.functions import stats
from basewise.operators import clustering as cl
from basewise.operators import landscape as ls
from basewise.operators import sequences as sq
from basewise.operators import significance as sg
from basewise.operators import similarity as sm
from basewise.operators import simulate


def test_tails(spark):
    rows = [(k, n, m) for k in (-1, 0, 1, 3, 10, 40) for n in (0, 1, 5, 40, 3000) for m in (0.0, 0.01, 1.0, 9.5, 900.0)]
    df = spark.createDataFrame(rows, "k int, n int, m double")
    p = lambda m, i: math.exp(-m + i * math.log(m) - math.lgamma(i + 1)) if m else float(i == 0)
    b = lambda n, q, i: math.comb(n, i) * math.exp(i * math.log(q) + (n - i) * math.log(1 - q))
    for r in df.select("*", stats.poisson_cdf(F.col("k"), F.col("m")).alias("p"), stats.binomial_cdf(F.col("k"), F.col("n"), F.lit(0.3)).alias("b")).collect():
        assert r["p"] == pytest.approx(sum(p(r["m"], i) for i in range(r["k"] + 1)), abs=1e-9)
        assert r["b"] == pytest.approx(1.0 if r["k"] >= r["n"] else sum(b(r["n"], 0.3, i) for i in range(r["k"] + 1)), abs=1e-9)
    for m, k in [(0.001, 2), (1.0, 10), (20.0, 46)]:
        got = spark.range(1).select(stats.poisson_threshold(F.lit(m), -6.0).alias("k")).first()["k"]
        want = next(k for k in range(1, 500) if 1 - sum(p(m, i) for i in range(k)) < 1e-6)
        assert got == want


def test_tails_of_deep_counts(spark):
    """Millions of counts take thousands of terms, not millions."""
    rows = [(k, n, m) for m, n in ((1_000_000.0, 3_000_000), (40_000.0, 90_000)) for k in (int(m) - 2500, int(m), int(m) + 1500)]
    df = spark.createDataFrame(rows, "k int, n int, m double")

    def tail(term, k, centre):
        return math.fsum(math.exp(term(i)) for i in range(max(0, int(centre) - 40_000), k + 1))

    for r in df.select("*", stats.poisson_cdf(F.col("k"), F.col("m")).alias("p"), stats.binomial_cdf(F.col("k"), F.col("n"), F.lit(1 / 3)).alias("b")).collect():
        k, n, m = r["k"], r["n"], r["m"]
        assert r["p"] == pytest.approx(tail(lambda i: -m + i * math.log(m) - math.lgamma(i + 1), k, m), rel=1e-6)
        choose = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)  # noqa: B023,E731
        assert r["b"] == pytest.approx(tail(lambda i: choose(i) + i * math.log(1 / 3) + (n - i) * math.log(2 / 3), min(k, n), n / 3), rel=1e-6)  # noqa: B023


def test_hit_landscape_by_hand(spark):
    """Position 61 counts for bins 1 and 2; position 11 for bin 0 only, since division truncates toward 0."""
    h = spark.createDataFrame([("1", 61, 1.0, "+"), ("1", 11, 2.0, "-")], "chrom string, pos int, cnt double, strand string")
    got = {(r["bin"], r["hits"]) for r in ls.hit_landscape(h, []).collect()}
    assert got == {(0, 2.0), (1, 1.0), (2, 1.0)}


def test_step_up_by_hand(spark):
    df = spark.createDataFrame([(0.01, 9, 1), (0.02, 8, 2), (0.02, 7, 3), (0.5, 1, 4)], "p double, n int, id int")
    q = {r["id"]: round(r["q"], 7) for r in sg.benjamini_hochberg(df.withColumn("c", F.lit(1)), ["c"], "p", "n", ["id"]).collect()}
    assert q == {1: 0.04, 2: 0.04, 3: 0.0266667, 4: 0.5}


def test_replication_codes_by_hand(spark):
    rows = [(1, True, 0, 1.0, True, "S"), (2, True, 2, 1.0, True, "2"), (2, True, 1, 1.0, True, "1"), (2, True, 0, 0.001, True, "1"), (2, True, 1, 1.0, False, "D"), (2, True, 0, 1.0, True, "X"), (2, False, 2, 0.0, True, "X"), (1, False, 0, 1.0, True, "S"), (3, True, 0, 0.001, False, "D")]
    df = spark.createDataFrame(rows, "n int, found boolean, s int, q double, c boolean, want string")
    code = sg.replication_code(F.col("n"), F.col("found"), F.col("s"), F.col("q"), F.col("c"))
    assert all(r["code"] == r["want"] for r in df.select("want", code.alias("code")).collect())


def test_affinity_propagation_finds_clear_groups():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 0.05, (12, 2)) for m in ((0, 0), (5, 0), (0, 5))])
    s = -((x[:, None] - x[None]) ** 2).sum(2)
    e = cl.affinity_propagation(s, preference=-1.0)
    assert len(set(e)) == 3 and all(len(set(e[k : k + 12])) == 1 for k in (0, 12, 24))


def test_alignment_against_plain_programming(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.random(12).tolist()) for k in (50, 1, 2, 3, 4)]
    got = {r["id"]: (r["score"], r["shift"], r["reverse"]) for r in cl.align(spark.createDataFrame(rows, "vec_id bigint, profile array<double>")).collect()}
    q = np.array(rows[0][1])
    for i, p in rows[1:]:
        ways = []
        for reverse in (False, True):
            x, y = (z / z.max() for z in (q, np.array(p)[::-1] if reverse else np.array(p)))
            x, y = x.reshape(2, -1), y.reshape(2, -1)
            for shift in range(-3, 4):  # no gaps: an overlap lies on one diagonal from an edge to the second half of the last row or column
                score = sum(1 - np.sqrt(((x[:, k] - y[:, k - shift]) ** 2).sum()) - abs(x[:, k] - y[:, k - shift]).sum() for k in range(6) if 0 <= k - shift < 6)
                ways.append((score, shift, reverse))
        best = max(ways)
        assert got[i] == (pytest.approx(best[0], abs=1e-8), best[1], best[2])


def test_cell_scores_by_hand():
    """Equal cells, cells that are 0 on one strand, and one cell of each score worked out."""
    for name in sm.CELL_SCORES:
        assert sm.cell_score(name, *np.array([0.3, 0.3, 0.2, 0.2])) == 0 and sm.cell_score(name, *np.zeros(4)) == 0
    one = lambda name, *c: float(sm.cell_score(name, *np.array(c)))
    assert one("linear", 0.4, 0.2, 0.1, 0.1) == pytest.approx(0.3 + 0.1 - 0.2)
    assert one("euclidean", 0.4, 0.1, 0.0, 0.4) == pytest.approx(1 - 0.5 - 0.7)
    assert one("sorensen", 0.4, 0.2, 0.1, 0.1) == pytest.approx(1 - 0.2 / 0.8 - 0.2)
    assert one("soergel", 0.4, 0.2, 0.1, 0.1) == pytest.approx(1 - 0.2 / 0.5 - 0.2)
    assert one("lorentzian", 0.4, 0.2, 0.1, 0.1) == pytest.approx(1 - np.log(1.2) - 0.2)
    assert one("pce", 0.4, 0.2, 0.1, 0.1) == pytest.approx(0.09 / (0.16 + 0.01 + 0.04 + 0.01 - 0.09) - 0.2)
    assert one("squared_chi", 0.0, 0.0, 0.3, 0.1) == pytest.approx(1 - 0.04 / 0.4 - 0.2)
    assert one("divergence", 0.0, 0.0, 0.3, 0.1) == pytest.approx(2 - 2 * 0.04 / 0.16 - 0.2)
    assert one("clark", 0.3, 0.1, 0.0, 0.0) == pytest.approx(1 - 0.5 - 0.2)
    assert one("akl", 0.4, 0.2, 0.1, 0.1) == pytest.approx(2 - (0.4 * np.log(2) - 0.2 * np.log(2)) / 2 - 0.2)
    assert one("allr", 0.4, 0.2, 0.1, 0.1) == 0


def test_blocks_of_queries_meet_all_profiles(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, rng.random(8).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, profile array<double>")
    import functools

    monkeypatch.setattr(sm, "meet", functools.partial(sm.meet, group=40, block=2))
    got = {(r["q_id"], r["id"]): r["score"] for r in sm.score_queries(df, {"score": sm.np_squared}).collect()}
    x = dict(rows)
    want = {(q, i): round(sum((a - b) ** 2 for a, b in zip(x[q], x[i])), 8) for q in range(0, 300, 50) for i in range(300) if i != q}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-8 for k in want)


def test_best_shift_against_loops(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random(16), rng.random(16)
    df = spark.createDataFrame([(0, a.tolist()), (1, b.tolist())], "vec_id bigint, profile array<double>")
    r = sm.best_shift(df, 4).first()
    best = []
    for rev, y in ((False, b), (True, b[::-1])):
        for d in range(-4, 5):
            k = 8 - abs(d)
            cut = lambda x, s: np.concatenate([x[s : s + k], x[8 + s : 8 + s + k]])  # noqa: B023,E731
            u, v = cut(a, max(d, 0)), cut(y, max(-d, 0))
            best.append((round(float(((u / u.sum() - v / v.sum()) ** 2).sum()), 12), abs(d), d, rev))
    assert (r["distance"], abs(r["shift"]), r["shift"], r["reverse"]) == min(best)


def test_every_profile_has_an_exemplar(spark):
    rng = np.random.default_rng(5)
    base = [np.roll(np.exp(-0.5 * ((np.arange(32) - 10) / w) ** 2), 0) for w in (1.0, 5.0)]
    rows = []
    for i in range(60):
        x = np.concatenate([base[i % 2], np.roll(base[i % 2], 6)]) + rng.random(64) * 0.01
        rows.append((i, float(i % 7), (x / x.sum()).tolist()))
    df = spark.createDataFrame(rows, "vec_id bigint, w double, profile array<double>")
    got = {r["vec_id"]: r["exemplar"] for r in cl.cluster(df, "w", most=20).collect()}
    assert got.keys() == set(range(60)) and all(e % 2 == i % 2 for i, e in got.items())
    assert all(got[e] == e for e in set(got.values()))
    cells = cl.aligned(df, spark.createDataFrame([(3, 1, 2, False), (4, 2, 0, True)], "vec_id bigint, exemplar bigint, shift int, reverse boolean")).collect()
    moved = {(r["vec_id"], r["place"]): r["value"] for r in cells}
    assert moved[(3, 2)] == rows[3][2][0] and (3, 0) not in moved and moved[(3, 34)] == rows[3][2][32] and moved[(4, 0)] == rows[4][2][63]


def test_merge_models(spark):
    """Against one merge after the other, the closest pair first."""
    rng = np.random.default_rng(6)
    x = np.exp(-0.5 * ((np.arange(40) - 20) / 3) ** 2)
    m = lambda k: (np.concatenate([np.roll(x, k), np.roll(x, -k)]) / (2 * x.sum())).tolist()
    data = [(1, m(0), 5), (2, np.roll(np.array(m(0)).reshape(2, -1), 3, axis=1).ravel().tolist(), 9), (3, m(9), 1)]
    y = np.array(m(9)) + 1e-6
    data += [(4, (y / y.sum()).tolist(), 1)]
    for k in range(5, 14):
        z = np.array(m(int(rng.integers(0, 3)))) + rng.random(80) * rng.choice([1e-5, 1e-3, 1e-2])
        data.append((k, (z / z.sum()).tolist(), int(rng.integers(1, 4))))
    df = spark.createDataFrame(data, "model int, m array<double>, size bigint")
    threshold = -6.0
    d = {(r["i"], r["j"]): r["d"] for r in cl.model_divergences(df.select("model", "m")).collect()}
    assert len(d) == 13 * 12 // 2 and d[(1, 2)] < -20
    live, into, size = {r[0] for r in data}, {r[0]: r[0] for r in data}, {r[0]: r[2] for r in data}
    while True:
        low = min(((v, *k) for k, v in d.items() if k[0] in live and k[1] in live), default=(0,))
        if low[0] >= threshold:
            break
        _, i, j = low
        keep, drop = (i, j) if size[i] >= size[j] else (j, i)
        live.discard(drop)
        into = {k: keep if v == drop else v for k, v in into.items()}
    got = {r["model"]: r["merged_into"] for r in cl.merge_models(df.select("model", "m"), df.select("model", "size"), threshold).collect()}
    assert got == into and len(live) < 11


def test_motif_fit_finds_a_planted_word(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(210):
        s = "".join(rnd.choice("ACGT") for _ in range(30))
        k = rnd.randint(0, 22)
        rows.append((i, s[:k] + "TTGACGCA" + s[k + 8 :]))
    p, _ = sq.fit_motif(spark.createDataFrame(rows, "id bigint, sequence string"), 8, 40, seed_word="TTGACTCA")
    assert "".join("ACGT"[int(np.argmax(r))] for r in p) == "TTGACGCA"


def test_best_match_against_loops(spark):
    rnd = random.Random(5)
    seqs = ["".join(rnd.choice("ACGTN") for _ in range(rnd.randint(0, 20))) for _ in range(60)]
    pwms = {w: [[rnd.uniform(-2, 2) for _ in range(4)] for _ in range(w)] for w in (3, 5)}
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, sequence string")
    motifs = spark.createDataFrame([(w, [[min(r), *r] for r in p]) for w, p in pwms.items()], "motif int, weights array<array<double>>")
    comp = str.maketrans("ACGT", "TGCA")
    got = {(r["id"], r["motif"]): (r["score"], r["start"], r["strand"], r["kmer"]) for r in sq.best_match(df, motifs).collect()}
    want = {}
    for i, s in enumerate(seqs):
        for w, pwm in pwms.items():
            score = lambda x: sum(pwm[k]["ACGT".index(c)] if c in "ACGT" else min(pwm[k]) for k, c in enumerate(x))  # noqa: B023,E731
            best = [(-round(score(x), 9), z, strand, x) for z in range(len(s) - w + 1) for strand, x in (("+", s[z : z + w]), ("-", s[z : z + w].translate(comp)[::-1]))]
            if best:
                b = min(best)
                want[(i, w)] = (-b[0], b[1], b[2], b[3])
    assert got == want


def test_simulated_reads_recover_their_events(spark):
    e = spark.createDataFrame([(1, "1", 5000, "+"), (1, "1", 9000, "-")], "cond_id int, chrom string, point bigint, point_strand string")
    g = spark.createDataFrame([("1", 20_000)], "chrom string, len bigint")
    d = np.arange(-50, 51)
    model = np.stack([np.exp(-0.5 * ((d + 20) / 4.0) ** 2), np.exp(-0.5 * ((d - 20) / 4.0) ** 2)])
    r = simulate.reads(e, g, 500, 0.1, model).collect()
    near = [x for x in r if abs(x["pos"] - 5000) <= 50]
    plus = [x["pos"] for x in near if x["strand"] == "+"]
    assert len(r) <= 1000 and 400 < len(near) < 520 and abs(np.mean(plus) - 4980) < 5
    assert sorted(map(tuple, r)) == sorted(map(tuple, simulate.reads(e.repartition(3), g, 500, 0.1, model).collect()))


def test_long_windows_are_cut_at_their_emptiest_bin(spark):
    r = spark.createDataFrame([(1, "1", 1, 1000), (1, "2", 1, 100)], "cond_id int, chrom string, rstart bigint, rend bigint")
    land = spark.createDataFrame([(1, "1", b, 0.0 if b == 19 else 5.0) for b in range(40)], "cond_id int, chrom string, bin int, hits double")
    got = [(x["chrom"], x["rstart"], x["rend"]) for x in ls.split_long(r, land, ["cond_id"], longest=400).orderBy("chrom", "rstart").collect()]
    assert got == [("1", 1, 475), ("1", 476, 1000), ("2", 1, 100)]


def test_roc_ends(spark):
    df = spark.createDataFrame([(1, 0.9, True), (1, 0.8, True), (1, 0.1, False), (2, 0.5, False), (3, 0.5, True), (4, 0.5, True), (4, 0.5, False)], "g int, s double, y boolean")
    assert {r["g"]: r["auc"] for r in sq.roc_auc(df, ["g"], "s", F.col("y")).collect()} == {1: 1.0, 2: 0.0, 3: 1.0, 4: 0.5}


def test_every_position_is_counted(spark):
    m = sq.frequency_matrix(spark.createDataFrame([("ACGTACGTA",), ("ACGTACG",)], "sequence string"))
    assert [(r["position"], r["a"]) for r in m.orderBy("position").collect() if r["a"]] == [(0, 2), (4, 2), (8, 1)] and m.count() == 9


def test_motif_query_has_the_survey_width(spark):
    from basewise.plans import sequences as plan

    assert plan.e16_motif(spark, "/root/testdata/sf0.001").count() == 10


def test_full_sorts_keep_every_event(spark):
    from basewise.plans import events, lookups

    folder = "/root/testdata/sf0.01"
    rows = events.o03_event_order(spark, folder).collect()
    assert len(rows) == events._valid_p(spark, folder).count() > 1000
    assert all((a["p"], -a["hits"]) <= (b["p"], -b["hits"]) for a, b in zip(rows, rows[1:]))
    places = [(r["chrom"], r["pos"]) for r in lookups.o04_by_location(spark, folder).collect()]
    assert len(places) > 1000 and places == sorted(places)


def test_shifts_of_up_to_25_are_found(spark):
    """Profiles 18 cells apart match, alone and when they are clustered."""
    from basewise.plans import profiles

    def one(k):
        x = np.zeros((2, 32))
        x[0, k : k + 4], x[1, k + 2 : k + 6] = [1, 5, 2, 1], [3, 1, 4, 2]
        return (x.ravel() / x.sum()).tolist()

    df = spark.createDataFrame([(50, one(4)), (1, one(22))], "vec_id bigint, profile array<double>")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(profiles, "stranded", lambda *_: df)
        r = profiles.m25_best_shift(spark, "").first()
    assert abs(r["shift"]) == 18 and not r["reverse"] and r["distance"] < 1e-3
    d = sm.shifted_distances(np.array([one(4), one(22)]), 25, 1.0)
    assert d[0, 1] < 1e-3 and (d == d.T).all()


def test_motifs_are_found_one_after_the_other(spark):
    rng = np.random.default_rng(21)
    planted = ["TTGACTCAGC", "GGCCAATCTA"]
    rows = []
    for i in range(210):
        t = "".join(rng.choice(list("ACGT"), 30))
        if i < 200:
            at = int(rng.integers(0, 20))
            t = t[:at] + planted[i >= 150] + t[at + 10 :]
        rows.append((i, t))
    rows += [(300, None), (301, "ACG"), (302, ""), (303, "NNNNNNNNNNNNN"), (304, "acgtnacgtnacgtn")]
    tried = sq.discover_motifs(spark.createDataFrame(rows, "line_id bigint, sequence string"))
    found = [d for d in tried if d["kept"]]
    assert len(found) >= len(tried) - 1 and all(d["removed"] == 0 for d in tried if not d["kept"])
    words = ["".join("ACGT"[int(np.argmax(r))] for r in d["p"]) for d in found]
    # each planted motif by at least its eight middle bases, the commoner one first
    assert any(planted[0][k : k + 8] in words[0] for k in range(3)) and any(planted[1][k : k + 8] in words[1] for k in range(3))
    assert found[0]["references"] >= 140 and found[1]["references"] >= 40 and all(d["auc"] >= 0.7 and d["removed"] >= d["references"] for d in found)
    assert sq.discover_motifs(spark.createDataFrame(rows[-5:], "line_id bigint, sequence string")) == []


def test_common_core(spark):
    df = spark.createDataFrame([("ACGTAC",), ("acgtac",), ("TTTTTTTT",), ("NNNNNN",), (None,), ("",)], "sequence string")
    assert sq.common_core(df, 4) == "ACGT" and sq.common_core(df, 9) is None


def test_spline(spark):
    from basewise.operators import profiles as pf

    places = np.arange(-100, 101)
    knots = np.arange(-100, 101, 10)
    w = pf.spline_weights(knots, places)
    y = np.random.default_rng(2).random(len(knots))
    curve = w @ y
    assert np.allclose(curve[::10], y) and np.allclose(w @ (3 * knots + 7.0), 3 * places + 7.0)
    # first and second derivatives agree on both sides of a knot, and the second is 0 at the ends
    fine = lambda x: (pf.spline_weights(knots.astype(float), np.asarray(x, float)) @ y)
    e = 1e-3
    for k in knots[1:-1].astype(float):
        left, right = fine([k - 2 * e, k - e, k]), fine([k, k + e, k + 2 * e])
        assert abs((left[2] - left[1]) - (right[1] - right[0])) < 1e-5
        assert abs((left[0] - 2 * left[1] + left[2]) - (right[0] - 2 * right[1] + right[2])) < 1e-8
    ends = fine([-100, -100 + e, -100 + 2 * e])
    assert abs(ends[0] - 2 * ends[1] + ends[2]) < 1e-8
    v = {(o, s): float(i % 7) for i, (o, s) in enumerate((o, s) for o in range(-30, 31) for s in "+-")}
    df = spark.createDataFrame([(1, o, s, x) for (o, s), x in v.items()], "k int, offset int, strand string, value double")
    got = {(r["offset"], r["strand"]): r["value"] for r in pf.splined(df, ["k"], 30).collect()}
    k = np.arange(-30, 31, 10)
    for s in "+-":
        means = [np.mean([v[o, s] for o in range(a - 2, a + 3) if abs(o) <= 30]) for a in k]
        want = np.maximum(pf.spline_weights(k, np.arange(-30, 31)) @ means, 0)
        assert np.allclose([got[o, s] for o in range(-30, 31)], want)
    with pytest.raises(ValueError):
        pf.splined(df, ["k"], 30, step=4, average=2)
