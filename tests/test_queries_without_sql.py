"""Registered queries that SQL can't say, whole tables against plain versions or against what must hold for every row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewise.operators import similarity as sm
from basewise.plans import models, profiles, sequences
from basewise.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
CHECKED = {}


def checks(name):
    def keep(f):
        CHECKED[name] = f
        return f

    return keep


def query(spark, name):
    return QUERIES[name](spark, FOLDER)


@pytest.fixture(scope="module")
def vectors(spark):
    rows = profiles.stranded(spark, FOLDER).orderBy("vec_id").collect()
    return np.array([r["vec_id"] for r in rows]), np.array([r["profile"] for r in rows])


@pytest.fixture(scope="module")
def signal(spark):
    """Signal of each part and condition."""
    rows = models._counts(spark, FOLDER).groupBy("region_id", "part", "cond_id").agg(F.sum("sig").alias("sig"), F.min("rstart").alias("a"), F.max("rend").alias("z")).collect()
    return {(r["region_id"], r["part"], r["cond_id"]): (r["sig"], r["a"], r["z"]) for r in rows}


def test_every_query_without_sql_is_checked():
    assert set(QUERIES) - set(SQL) == set(CHECKED)


@checks("m25_best_shift")
def test_m25(spark, vectors):
    ids, x = vectors
    q = ids % 50 == 0
    d, _, _ = sm.shifted_matrix(x[q], x, 25, 1.0)
    got = {(r["q_id"], r["id"]): r["distance"] for r in query(spark, "m25_best_shift").collect()}
    want = {(a, b): d[i, j] for i, a in enumerate(ids[q]) for j, b in enumerate(ids) if a != b}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@checks("m27_alignments")
def test_m27(spark, vectors):
    ids, x = vectors
    n = x.shape[1] // 2
    x = x / x.max(axis=1, keepdims=True)
    got = {(r["q_id"], r["id"]): r["score"] for r in query(spark, "m27_alignments").collect()}
    best = {}
    for turned in (x, x[:, ::-1]):
        for k in np.flatnonzero(ids % 50 == 0):
            for d in range(-n // 2, n // 2 + 1):
                a, b = slice(max(d, 0), n + min(d, 0)), slice(max(-d, 0), n - max(d, 0))
                dx, dy = abs(x[k, :n][a] - turned[:, :n][:, b]), abs(x[k, n:][a] - turned[:, n:][:, b])
                cell = np.where((dx == 0) & (dy == 0), 0.0, 1 - np.sqrt(dx**2 + dy**2) - dx - dy)
                for i, s in zip(ids, cell.sum(axis=1)):
                    best[(ids[k], i)] = max(best.get((ids[k], i), -np.inf), s)
    want = {k: v for k, v in best.items() if k[0] != k[1]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


@checks("t04_threshold")
@checks("t03_over_threshold")
def test_thresholds(spark):
    """One threshold for each length of motif; every score at or over it is listed, and no other."""
    t = {r["motif"]: r["value"] for r in query(spark, "t04_threshold").collect()}
    assert t.keys() == {r["motif"] for r in query(spark, "t01_best_match").select("motif").distinct().collect()}
    s = sequences._matched(spark, FOLDER).collect()
    got = sorted((r["line_id"], r["motif"]) for r in query(spark, "t03_over_threshold").collect())
    assert got == sorted((r["line_id"], r["motif"]) for r in s if r["score"] >= t[r["motif"]])


@checks("s20_random_sequences")
def test_s20(spark):
    rows = query(spark, "s20_random_sequences").collect()
    assert len(rows) == sequences.motif_sequences(spark, FOLDER).count() and all(len(r["sequence"]) == 60 and set(r["sequence"]) <= set("ACGT") for r in rows)
    assert sorted(rows) == sorted(query(spark, "s20_random_sequences").collect())


@checks("e09_motifs")
@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_e09(spark, folder):
    """Motifs are whole matrices, all but the last tried are kept, and together they remove no more sequences than there are; fewer than 25 sequences have none."""
    rows = QUERIES["e09_motifs"](spark, folder).collect()
    n = sequences.motif_sequences(spark, folder).where("length(sequence) >= 10").count()
    assert bool(rows) == (n >= 25)
    each, last = {}, max((r["motif"] for r in rows), default=None)
    for r in rows:
        assert r["a"] + r["c"] + r["g"] + r["t"] == pytest.approx(1)
        assert r["auc"] >= 0.7 and 25 < r["references"] <= r["removed"] if r["kept"] else r["motif"] == last and (r["auc"] < 0.7 or r["references"] <= 25)
        each.setdefault(r["motif"], []).append(r)
    assert sorted(each) == list(range(len(each))) and all(sorted(r["position"] for r in m) == list(range(10)) for m in each.values())
    assert sum(m[0]["removed"] for m in each.values()) <= n


def test_w04_spline(spark):
    """Every condition has the whole profile of both strands, through the means at its knots."""
    rows = query(spark, "w04_spline").collect()
    given = {(r["cond_id"], r["offset"], r["strand"]): r["value"] for r in profiles._composite(spark, FOLDER).collect()}
    got = {(r["cond_id"], r["offset"], r["strand"]): r["value"] for r in rows}
    conds = {c for c, _, _ in given}
    assert got.keys() == {(c, o, s) for c in conds for o in range(-100, 101) for s in "+-"}
    for (c, o, s), x in got.items():
        if o % 10 == 0:
            near = [given.get((c, q, s), 0.0) for q in range(o - 2, o + 3) if abs(q) <= 100]
            assert x == pytest.approx(np.mean(near), abs=1e-8)


@checks("k12_clusters")
def test_k12(spark, vectors):
    rows = query(spark, "k12_clusters").collect()
    assert sum(r["members"] for r in rows) == len(vectors[0])
    assert all(r["other_label"] < r["members"] and r["turned"] < r["members"] and r["least_shift"] <= 0 <= r["most_shift"] for r in rows)


@checks("k23_offsets")
def test_k23(spark):
    rows = query(spark, "k23_offsets").collect()
    pairs = query(spark, "m25_best_shift").groupBy("shift", "reverse").count().collect()
    assert {(r["shift"], r["reverse"]): r["pairs"] for r in rows} == {(r["shift"], r["reverse"]): r["count"] for r in pairs}
    assert all(abs(r["shift"]) <= 25 for r in rows)


@checks("e16_motif")
def test_e16(spark):
    rows = query(spark, "e16_motif").orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(10)) and all(r["a"] + r["c"] + r["g"] + r["t"] == pytest.approx(1) for r in rows)


def parts_hold(rows, signal):
    """Components lie in their part, in order, and share no more than its signal."""
    sums = {}
    for r in rows:
        k = (r["region_id"], r["part"], r["cond_id"])
        assert signal[k][1] <= r["position"] <= signal[k][2]
        sums.setdefault(k, []).append(r)
    for k, group in sums.items():
        group.sort(key=lambda r: r["component"])
        assert [r["component"] for r in group] == list(range(len(group))) and [r["position"] for r in group] == sorted(r["position"] for r in group)
        for total in (lambda r: r["plus"] + r["minus"], lambda r: r["sig"] if "sig" in r else 0):
            assert sum(map(total, group)) <= signal[k][0] * (1 + 1e-9)
    return sums


@checks("e01_components")
@checks("e04_assigned")
def test_components(spark, signal):
    rows = query(spark, "e01_components").collect()
    parts_hold(rows, signal)
    # alpha is 3: parts with less have none, and those with much have some
    assert not any(signal[(r["region_id"], r["part"], r["cond_id"])][0] <= 3 for r in rows)
    busy = {k for k, v in signal.items() if v[0] >= 40}
    assert len(busy & {(r["region_id"], r["part"], r["cond_id"]) for r in rows}) >= 0.9 * len(busy) > 0
    assigned = {(r["region_id"], r["part"], r["cond_id"], r["component"]): r for r in query(spark, "e04_assigned").collect()}
    assert assigned.keys() == {(r["region_id"], r["part"], r["cond_id"], r["component"]) for r in rows} and all(r["sig"] >= 0 and r["ctrl"] >= 0 for r in assigned.values())


@checks("e02_subtypes")
@checks("e03_subtypes_assigned")
@checks("a14_read_profiles")
def test_subtypes(spark, signal):
    rows = query(spark, "e03_subtypes_assigned").collect()
    sums = parts_hold(rows, signal)
    assert sums and all(sum(r["tau"]) == pytest.approx(1) and len(r["places"]) == 4 and r["position"] == r["places"][r["form"]] for r in rows)
    plain = {(r["region_id"], r["part"], r["cond_id"], r["component"], r["position"]) for r in query(spark, "e02_subtypes").collect()}
    assert plain == {(r["region_id"], r["part"], r["cond_id"], r["component"], r["position"]) for r in rows}
    # profiles over replicates, offsets and strands add up to what a component has; parts with a margin share with components outside
    total = {}
    for r in query(spark, "a14_read_profiles").collect():
        assert abs(r["offset"]) <= 250 and r["value"] >= 0
        k = (r["region_id"], r["part"], r["cond_id"], r["component"])
        total[k] = total.get(k, 0) + r["value"]
    cut = {r["region_id"] for r in rows if r["part"] > 0}
    whole = [r for r in rows if r["region_id"] not in cut and r["part"] == 0]
    assert whole and all(total[(r["region_id"], 0, r["cond_id"], r["component"])] == pytest.approx(r["plus"] + r["minus"], abs=1e-3) for r in whole)


@checks("k04_subtype_events")
@checks("k06_subtype_table")
@checks("k07_aligned_events")
def test_subtype_tables(spark, monkeypatch):
    """Every component is taken as reported, as few tables of this size have one that is."""
    all_of_them = models.cut_lineage(models.e03_subtypes_assigned(spark, FOLDER).withColumn("q", F.lit(0.001)))
    monkeypatch.setattr(models, "_reported_subtypes", lambda *_: all_of_them)
    key = lambda r: (r["region_id"], r["part"], r["cond_id"], r["component"])
    given = {key(r): r for r in all_of_them.collect()}
    events = {key(r): r for r in query(spark, "k04_subtype_events").collect()}
    wide = {key(r): r for r in query(spark, "k06_subtype_table").collect()}
    aligned = {key(r): r for r in query(spark, "k07_aligned_events").collect()}
    assert given.keys() == events.keys() == wide.keys() == aligned.keys() and given
    motifs = {k: (r["offset"], r["reverse"]) for k, r in enumerate(query(spark, "e13_motif_offsets").orderBy("motif").collect())}
    for k, g in given.items():
        tau = g["tau"]
        best = tau.index(max(tau))
        e = events[k]
        assert (e["subtype"], e["strand"], e["point"]) == (best // 2, "+-"[best % 2], g["places"][best])
        sums = [tau[0] + tau[1], tau[2] + tau[3]]
        t = sums.index(max(sums))
        assert (e["summed_subtype"], e["summed_strand"]) == (t, "+" if tau[2 * t] > tau[2 * t + 1] else "-")
        assert wide[k]["subtype1-_point"] == g["places"][3] and wide[k]["subtype0+_tau"] == round(tau[0], 2)
        offset, reverse = motifs[best // 2]
        step = offset if e["strand"] == "+" else -offset
        a = aligned[k]
        assert (a["pos"], a["strand"]) == ((e["point"] - step, "-" if e["strand"] == "+" else "+") if reverse else (e["point"] + step, e["strand"]))


@checks("o05_component_order")
def test_o05(spark):
    rows = query(spark, "o05_component_order").collect()
    n = {(r["region_id"], r["part"], r["cond_id"], r["component"]): r["plus"] + r["minus"] for r in query(spark, "e02_subtypes").collect()}
    for c in {r["cond_id"] for r in rows}:
        mine = [r for r in rows if r["cond_id"] == c]
        for order in ("by_location", "by_counts", "by_share"):
            assert sorted(r[order] for r in mine) == list(range(1, len(mine) + 1))
        counts = [n[(r["region_id"], r["part"], c, r["component"])] for r in sorted(mine, key=lambda r: r["by_counts"])]
        assert counts == sorted(counts, reverse=True)
        places = [(r["chrom"], r["position"]) for r in sorted(mine, key=lambda r: r["by_location"])]
        assert places == sorted(places)


@checks("e07_rounds")
def test_e07(spark):
    rows = query(spark, "e07_rounds").collect()
    assert rows and all(0 <= r["p"] <= r["q"] + 1e-12 and r["q"] <= 1 for r in rows)


@checks("e08_exemplars")
@checks("j16_members")
def test_exemplars(spark, vectors):
    ids, x = vectors
    e = {r["vec_id"]: r for r in query(spark, "e08_exemplars").collect()}
    assert e.keys() == set(ids)
    heads = sorted({r["exemplar"] for r in e.values()})
    assert all(e[h]["exemplar"] == h and e[h]["shift"] == 0 and not e[h]["reverse"] for h in heads) and len(heads) > 1
    d, _, _ = sm.shifted_matrix(x, x[np.isin(ids, heads)], 25, 1.0)
    for k, i in enumerate(ids):
        if i not in heads:
            assert d[k, heads.index(e[i]["exemplar"])] == pytest.approx(d[k].min(), abs=1e-9)
    n = x.shape[1] // 2
    members = {(r["exemplar"], r["place"]): r["members"] for r in query(spark, "j16_members").collect()}
    want = {(h, p): sum(r["exemplar"] == h and 0 <= p % n - r["shift"] < n for r in e.values()) for h in heads for p in range(2 * n)}
    assert members == {k: v for k, v in want.items() if v}


@checks("e12_merged")
def test_e12(spark):
    rows = {r["label"]: r["merged_into"] for r in query(spark, "e12_merged").collect()}
    assert rows and set(rows.values()) <= rows.keys() and all(rows[v] == v for v in rows.values())


@checks("e14_k_means")
def test_e14(spark, vectors):
    rows = {r["vec_id"]: r["cluster"] for r in query(spark, "e14_k_means").collect()}
    assert rows.keys() == set(vectors[0]) and set(rows.values()) == set(range(5))


@checks("s21_simulated_reads")
def test_s21(spark):
    n, worst = query(spark, "s21_simulated_reads").agg(F.count("*"), F.min("cnt")).first()
    assert n > 0 and worst >= 1
