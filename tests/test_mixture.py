"""Mixture fits: invariants, planted events, symmetry, and the shares against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewise.operators import compiled
from basewise.operators import mixture as mx


def planted(places, n, rng, start, end, noise=10):
    x, minus = [], []
    for p in places:
        for _ in range(n):
            m = rng.random() < 0.5
            d = rng.normal(0, 12)
            x.append(int(round(p + d)))
            minus.append(m)
    for _ in range(noise):
        x.append(int(rng.integers(start, end + 1)))
        minus.append(rng.random() < 0.5)
    x = np.clip(np.array(x), start, end)
    key, count = np.unique(np.stack([x, np.array(minus, int)]), axis=1, return_counts=True)
    return key[0], key[1].astype(bool), count.astype(float)


MODEL = mx.normal_model(15)


def test_planted_events_are_found():
    rng = np.random.default_rng(3)
    x, minus, count = planted([400, 900, 1500], 60, rng, 1, 1900)
    out = mx.fit(x, minus, count, 1, 1900, MODEL, alpha=10.0)
    assert len(out) == 3 and np.abs(np.sort(out.position.to_numpy()) - [400, 900, 1500]).max() <= 8
    assert out.pi.sum() == pytest.approx(0.9)
    assert (out.plus + out.minus).sum() <= count.sum() + 1e-9


def test_one_component_three_hits():
    x, minus, count = np.array([50, 52, 55]), np.array([False, True, False]), np.array([2.0, 3.0, 1.0])
    out = mx.fit(x, minus, count, 1, 100, MODEL, alpha=0.0, at=np.array([52]))
    assert len(out) == 1 and out.pi.iloc[0] == pytest.approx(0.9)


def test_mirror():
    rng = np.random.default_rng(5)
    x, minus, count = planted([300, 700], 40, rng, 1, 1000)
    model = mx.normal_model(10, 12)
    a = mx.fit(x, minus, count, 1, 1000, model, 8.0, at=np.arange(101, 1000, 100))
    b = mx.fit(1001 - x, ~minus, count, 1, 1000, model, 8.0, at=1001 - np.arange(101, 1000, 100))
    assert np.abs(np.sort(a.position) - np.sort(1001 - b.position)).max() <= 2
    assert np.allclose(np.sort(a.pi), np.sort(b.pi), atol=0.02)


def test_table_and_direct_ways_agree(monkeypatch):
    rng = np.random.default_rng(6)
    x, minus, count = planted([200, 600], 30, rng, 1, 900)
    models = mx.with_reverse(np.concatenate([mx.normal_model(8, 15), mx.normal_model(25)]))
    a = mx.fit(x, minus, count, 1, 900, models, 6.0)
    monkeypatch.setattr(mx, "KEPT", 0)
    b = mx.fit(x, minus, count, 1, 900, models, 6.0)
    assert a.position.tolist() == b.position.tolist() and np.allclose(a.pi, b.pi, atol=1e-6)
    assert all(abs(sum(t) - 1) < 1e-9 for t in a.tau)


def test_forms_are_told_apart():
    """Hits laid out by the reverse complement of a form give that form."""
    rng = np.random.default_rng(7)
    d = np.arange(-100, 101)
    lopsided = np.stack([np.exp(-0.5 * ((d + 30) / 6) ** 2), 0.2 * np.exp(-0.5 * ((d - 10) / 20) ** 2)])
    models = mx.with_reverse((lopsided / lopsided.sum())[None])
    form = models[1].ravel() / models[1].sum()
    draw = rng.choice(len(form), 300, p=form)
    x, minus = 500 + draw % 201 - 100, draw >= 201
    key, count = np.unique(np.stack([x, minus.astype(int)]), axis=1, return_counts=True)
    out = mx.fit(key[0], key[1].astype(bool), count.astype(float), 1, 1000, models, 20.0)
    best = out.loc[out.pi.idxmax()]
    assert best.form == 1 and abs(best.position - 500) <= 5


def test_assign_against_a_loop():
    rng = np.random.default_rng(8)
    x, minus, sig = planted([300, 360], 20, rng, 1, 700)
    ctrl = rng.integers(0, 3, len(x)).astype(float)
    mu, tau, noise, width = np.array([300, 360]), np.ones((2, 1)), 0.1, 700
    pi = np.array([0.45, 0.45])
    s, c = mx.assign(x, minus, sig, ctrl, mu, pi.copy(), tau, MODEL, width, noise)
    p = pi.tolist()

    def density(j, i):
        d = x[i] - mu[j]
        return MODEL[0, int(minus[i]), d + 100] if abs(d) <= 100 else 0.0

    def shares(i):
        w = [p[j] * density(j, i) for j in (0, 1)]
        total = sum(w) + noise / width / 2
        return [v / total for v in w]

    for _ in range(50):
        sums = [sum(shares(i)[j] * sig[i] for i in range(len(x))) for j in (0, 1)]
        p = [v / sum(sums) * (1 - noise) for v in sums]
    assert s == pytest.approx([sum(shares(i)[j] * sig[i] for i in range(len(x))) for j in (0, 1)])
    assert c == pytest.approx([sum(shares(i)[j] * ctrl[i] for i in range(len(x))) for j in (0, 1)])
    none = mx.assign(x, minus, sig, ctrl * 0, mu, pi.copy(), tau, MODEL, width, noise)[1]
    assert none == pytest.approx(p)


def test_regions_are_cut_at_their_emptiest_bins(spark):
    r = spark.createDataFrame([(1, 1, "1", 1, 5000), (2, 1, "1", 7, 7), (3, 1, "1", 1, 2999), (4, 2, "1", 1, 4100)], "region_id bigint, run_id int, chrom string, rstart bigint, rend bigint")
    # a hit in every bin of run 1 but one near 2,000
    hits = spark.createDataFrame([(1, "signal", "1", 25 * b, 1.0) for b in range(0, 240) if b != 85] + [(1, "control", "1", 2130, 9.0)], "run_id int, channel string, chrom string, pos int, cnt double")
    rows = mx.bounded_parts(r, hits).orderBy("region_id", "part").collect()
    assert all(x["rend"] - x["rstart"] + 1 <= 3500 for x in rows)
    got = [(x["region_id"], x["part"], x["rstart"], x["rend"], x["fit_start"], x["fit_end"]) for x in rows]
    assert got == [(1, 0, 1, 2124, 1, 2324), (1, 1, 2125, 5000, 1925, 5000), (2, 0, 7, 7, 7, 7), (3, 0, 1, 2999, 1, 2999), (4, 0, 1, 1524, 1, 1724), (4, 1, 1525, 4100, 1325, 4100)]


def test_an_event_at_a_cut_is_found_once_with_all_its_hits(spark):
    """Hits everywhere but around one event that stands at the only place to cut."""
    rng = np.random.default_rng(12)
    x, minus, count = planted([2000], 60, rng, 1, 4000, noise=0)
    rows = [(1, 5, "signal", "1", int(a), "-" if m else "+", float(c)) for a, m, c in zip(x, minus, count)]
    hits = spark.createDataFrame(rows, "run_id int, cond_id int, channel string, chrom string, pos int, strand string, cnt double")
    regions = spark.createDataFrame([(7, 1, "1", 1, 4000)], "region_id bigint, run_id int, chrom string, rstart bigint, rend bigint")
    for a in (1950, 2000, 2050):
        parts = spark.createDataFrame([(7, 0, 1, "1", 1, a, 1, a + 200), (7, 1, 1, "1", a + 1, 4000, a - 199, 4000)], "region_id bigint, part int, run_id int, chrom string, rstart bigint, rend bigint, fit_start bigint, fit_end bigint")
        got = mx.fit_regions(mx.region_counts(hits, parts), mx.normal_model(), alpha=5.0, assigned=True).collect()
        assert len(got) == 1 and abs(got[0]["position"] - 2000) <= 10 and got[0]["sig"] > 0.85 * count.sum()
    assert mx.bounded_parts(regions, hits).count() == 2


def test_spark_equals_the_kernel(spark):
    rng = np.random.default_rng(9)
    rows = []
    for region in (1, 2):
        x, minus, count = planted([300, 700], 30, rng, 1, 1000)
        rows += [(region, 0, 5, 1, 1000, 1, 1000, "1", int(a), "-" if m else "+", float(c), 0.0) for a, m, c in zip(x, minus, count)]
    counts = spark.createDataFrame(rows, "region_id bigint, part int, cond_id int, rstart bigint, rend bigint, fit_start bigint, fit_end bigint, chrom string, pos int, strand string, sig double, ctrl double")
    fitted = mx.fit_regions(counts, MODEL, 5.0)
    got = fitted.collect()
    assert {r["region_id"] for r in got} == {1, 2}
    assigned = mx.fit_regions(counts, MODEL, 5.0, assigned=True).collect()
    assert len(assigned) == len(got) and all(r["sig"] > 0 for r in assigned)


def test_parts_with_little_signal_are_fitted(spark, monkeypatch):
    """A part with 4 counts, over alpha, has its component in ``e01`` and ``e04``."""
    from basewise.plans import models

    hits = spark.createDataFrame([(1, 5, "signal", "1", 500, s, 2.0) for s in "+-"], "run_id int, cond_id int, channel string, chrom string, pos int, strand string, cnt double")
    regions = spark.createDataFrame([(7, 1, "1", 1, 1000)], "region_id bigint, run_id int, chrom string, rstart bigint, rend bigint")
    monkeypatch.setattr(models, "_hits", lambda *_: hits)
    monkeypatch.setattr(models, "current_regions", lambda *_: regions)
    monkeypatch.setattr(models, "e06_noise_shares", lambda *_: spark.createDataFrame([(7, 5, 0.1)], "region_id bigint, cond_id int, share double"))
    assert [(r["region_id"], r["cond_id"], r["position"]) for r in models.e01_components(spark, "").collect()] == [(7, 5, 500)]
    (r,) = models.e04_assigned(spark, "").collect()
    assert 3.0 < r["sig"] <= 4.0


def test_rounds_use_alphas_and_both_directions(spark, monkeypatch):
    """One round of an unstranded form and three of a form and its reverse complement, each by the alpha of its condition."""
    from basewise.plans import models

    x, minus, count = planted([400], 60, np.random.default_rng(11), 1, 1000, noise=0)
    few = [(400, "+", 3.0), (401, "-", 3.0)]
    rows = [(1, 5, "signal", "1", int(a), "-" if m else "+", float(c)) for a, m, c in zip(x, minus, count)] + [(1, 6, "signal", "1", a, m, c) for a, m, c in few]
    hits = spark.createDataFrame(rows, "run_id int, cond_id int, channel string, chrom string, pos int, strand string, cnt double")
    monkeypatch.setattr(models, "_hits", lambda *_: hits)
    monkeypatch.setattr(models, "current_regions", lambda *_: spark.createDataFrame([(7, 1, "1", 1, 1000)], "region_id bigint, run_id int, chrom string, rstart bigint, rend bigint"))
    monkeypatch.setattr(models, "e06_noise_shares", lambda *_: spark.createDataFrame([(7, 5, 0.1), (7, 6, 0.1)], "region_id bigint, cond_id int, share double"))
    monkeypatch.setattr(models, "genome", lambda *_: spark.createDataFrame([("1", 1_000_000)], "chrom string, len bigint"))
    monkeypatch.setattr(models, "m02_alphas", lambda *_: spark.createDataFrame([(5, 4.0), (6, 9.0)], "cond_id int, alpha double"), raising=False)
    forms, fit_regions = [], mx.fit_regions
    monkeypatch.setattr(mx, "fit_regions", lambda c, model, **k: forms.append(len(model)) or fit_regions(c, model, **k))
    got = models.e07_rounds(spark, "").collect()
    assert forms == [1, 2, 2, 2]
    assert {r["cond_id"] for r in got} == {5}  # 6 counts are over a constant 3, not over the alpha of condition 6
    assert any(abs(r["position"] - 400) <= 10 for r in got)


def test_parts_side_by_side_equal_each_alone():
    """Parts share rounds but nothing else, whatever their size, noise and alpha; one without enough signal has no component."""
    rng = np.random.default_rng(21)
    models = mx.with_reverse(np.concatenate([mx.normal_model(8, 15), mx.normal_model(25)]))
    given = []
    for k, (places, n) in enumerate([([200, 600], 30), ([50], 8), ([120, 160, 900], 20), ([400], 1), ([700], 60)]):
        x, minus, count = planted(places, n, rng, 1, 1000, noise=3 * k)
        given.append((x, minus, count, 1, 1000, 3.0 + k, 0.05 + 0.02 * k))
    one = lambda v: np.array([v])
    parts = [mx.Parts(np.zeros(len(x), int), x, m, c, c * 0, one(i), one(a), one(z), one(noise), one(alpha)) for i, (x, m, c, a, z, alpha, noise) in enumerate(given)]
    seen = []
    for p, found in mx.fit_many(iter([mx.Parts.joined(parts[:3]), mx.Parts.joined(parts[3:])]), models):
        out = mx._fitted(p, found, models)
        for j, k in enumerate(p.part.tolist()):
            x, m, c, a, z, alpha, noise = given[k]
            alone, mine = mx.fit(x, m, c, a, z, models, alpha, noise), out["of"] == j
            assert out["position"][mine].tolist() == alone.position.tolist() and out["form"][mine].tolist() == alone.form.tolist()
            assert np.allclose(out["pi"][mine], alone.pi) and np.allclose(out["plus"][mine], alone.plus) and np.allclose(out["tau"][mine], np.array(alone.tau.tolist()).reshape(-1, 4))
            seen.append(k)
    assert sorted(seen) == [0, 1, 2, 3, 4]


def _many_parts(spark, n):
    rng = np.random.default_rng(22)
    rows, given = [], {}
    for k in range(n):
        x, minus, count = planted([300, 700], 15, rng, 1, 1000)
        given[k] = (x, minus, count)
        rows += [(k, 0, 5, 1, 600, 1, 1000, "1", int(a), "-" if m else "+", float(c), 1.0) for a, m, c in zip(x, minus, count)]
        rows += [(k, 0, 5, 1, 600, 1, 1000, "1", 990, "+", 0.0, 2.0)]  # control only
    return given, spark.createDataFrame(rows, "region_id bigint, part int, cond_id int, rstart bigint, rend bigint, fit_start bigint, fit_end bigint, chrom string, pos int, strand string, sig double, ctrl double")


def test_parts_are_fitted_in_batches_and_not_one_by_one(spark):
    """No group of its own for each part, also where a part lies over two batches; margins are left out."""
    given, counts = _many_parts(spark, 6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        fitted = mx.fit_regions(counts, MODEL, 5.0, assigned=True)
        assert "InPandas" not in fitted._jdf.queryExecution().toString()
        got = fitted.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, (x, minus, count) in given.items():
        alone = mx.fit(x, minus, count, 1, 1000, MODEL, 5.0)
        rows = sorted((r for r in got if r["region_id"] == k), key=lambda r: r["component"])
        assert [r["position"] for r in rows] == alone[alone.position <= 600].position.tolist() and [r["component"] for r in rows] == list(range(len(rows)))
        order = np.argsort(np.append(x, 990), kind="stable")
        x, minus, sig, ctrl = np.append(x, 990)[order], np.append(minus, False)[order], np.append(count, 0.0)[order], np.append(np.ones(len(count)), 2.0)[order]
        s, c = mx.assign(x, minus, sig, ctrl, alone.position.to_numpy(), alone.pi.to_numpy(), np.stack(alone.tau.to_numpy()), MODEL, 1000)
        inside = (alone.position <= 600).to_numpy()
        assert [r["sig"] for r in rows] == pytest.approx(s[inside]) and [r["ctrl"] for r in rows] == pytest.approx(c[inside])


def test_read_profiles_share_rows_and_not_groups(spark):
    """The share of a hit is that of a plain loop over the components; no group of its own for each part."""
    given, counts = _many_parts(spark, 2)
    components = mx.fit_regions(counts, MODEL, 5.0)
    hits = counts.where("sig > 0 and region_id = 0").selectExpr("cond_id", "3 as rep_id", "chrom", "pos", "strand", "sig as cnt")
    profiles = mx.read_profiles(hits, counts, components, MODEL, noise=0.1)
    assert "InPandas" not in profiles._jdf.queryExecution().toString()
    kept = [r for r in components.collect() if r["region_id"] == 0]
    got = {(r["component"], r["offset"], r["strand"]): r["value"] for r in profiles.collect() if r["region_id"] == 0}
    want = {}
    for x, minus, count in zip(*given[0]):
        h = [r["pi"] * (MODEL[0, int(minus), x - r["position"] + 100] if abs(x - r["position"]) <= 100 else 0.0) for r in kept]
        for r, v in zip(kept, h):
            if v > 0:
                want[r["component"], int(x - r["position"]), "-" if minus else "+"] = v / (sum(h) + 0.1 / 1000 / 2) * count
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("model", [MODEL, mx.with_reverse(np.concatenate([mx.normal_model(8, 15), mx.normal_model(30, 30)]))])
def test_rounds_of_the_jvm_are_those_of_numpy(spark, model):
    rng = np.random.default_rng(11)
    given = [planted(rng.integers(50, 900, rng.integers(1, 5)), int(rng.integers(1, 40)), rng, 1, 1000, noise=int(rng.integers(0, 30))) for _ in range(60)] + [planted([], 0, rng, 1, 1000, noise=2)]
    rows = [(k, 0, 5, 1, 1000, 1, 1000, "1", int(a), "-" if m else "+", float(c), 0.0, 0.1) for k, g in enumerate(given) for a, m, c in zip(*g)]
    counts = spark.createDataFrame(rows, "region_id bigint, part int, cond_id int, rstart int, rend int, fit_start int, fit_end int, chrom string, pos int, strand string, sig double, ctrl double, noise double")
    fitted = mx.fit_regions(counts, model, alpha=3.0)
    assert compiled.NAME in fitted._jdf.queryExecution().toString()
    got = sorted((r.region_id, r.position, r.form, round(r.pi, 9), *np.round(r.tau, 9)) for r in fitted.collect())
    want = sorted((k, r.position, r.form, round(r.pi, 9), *np.round(r.tau, 9)) for k, g in enumerate(given) for r in mx.fit(*g, 1, 1000, model, 3.0).itertuples())
    assert got == want and len(want) > 60


def test_parts_without_components_beside_others(spark):
    rows = [(k, 0, 5, 1, 1000, 1, 1000, "1", 500, "+", 1.0, 0.0) for k in range(3)]
    counts = spark.createDataFrame(rows, "region_id bigint, part int, cond_id int, rstart int, rend int, fit_start int, fit_end int, chrom string, pos int, strand string, sig double, ctrl double")
    assert mx.fit_regions(counts, MODEL, alpha=3.0, assigned=True).collect() == []


def test_moves_are_scored_again_only_where_weights_changed(spark):
    """Most places stay where they are for most rounds; the components are those of numpy all the same."""
    rng = np.random.default_rng(31)
    x, minus, count = planted([200, 330, 700], 60, rng, 1, 1000, noise=20)
    order = np.argsort(x, kind="stable")
    one = lambda v: np.array([v])
    p = mx.Parts(np.zeros(len(x), int), x[order], minus[order], count[order], np.zeros(len(x)), one(0), one(1), one(1000), one(0.1), one(3.0))
    loader, given = compiled._object(spark).getClass().getClassLoader(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.Object, 1)
    given[0] = mx._settings(MODEL, mx.BETA)
    work = loader.loadClass(f"{compiled.CLASS}$Work").getConstructors()[0].newInstance(given)
    _, (_, mu, pi, _) = mx._unpacked(mx._packed(p), bytes(work.fit(mx._packed(p))), 1)
    alone = mx.fit(x, minus, count, 1, 1000, MODEL, 3.0, 0.1)
    assert sorted((mu[:, 0] + 1).tolist()) == alone.position.tolist() and sorted(pi.round(9)) == sorted(alone.pi.round(9))
    count_of = lambda name: work.getClass().getField(name).get(work)
    assert 0 < count_of("scored") < 0.5 * count_of("looked")


def test_reported_subtypes_are_fitted_once(spark, monkeypatch, tmp_path):
    """Ranks by ranges read the tested components twice; the fit must not run for each."""
    from basewise.plans import models

    seen = tmp_path / "fits"

    def fitted(*_):
        def run(batches):
            with seen.open("a") as f:
                f.write("x")
            yield from batches

        rows = spark.createDataFrame([(1, 0, 5, k, 30.0, 0.0) for k in range(4)], "region_id bigint, part int, cond_id int, component int, sig double, ctrl double")
        return rows.coalesce(1).mapInArrow(run, rows.schema)

    monkeypatch.setattr(models, "e03_subtypes_assigned", fitted)
    monkeypatch.setattr(models, "base_hits", lambda *_: spark.sql("SELECT 1 AS rep_id, 100D AS cnt"))
    monkeypatch.setattr(models, "replicate_runs", lambda *_: spark.sql("SELECT 1 AS rep_id, 1 AS run_id, 5 AS cond_id"))
    monkeypatch.setattr(models, "genome", lambda *_: spark.createDataFrame([("1", 1_000_000)], "chrom string, len bigint"))
    assert len(models._reported_subtypes(spark, "").collect()) == 4
    assert seen.read_text() == "x"


def test_rounds_read_the_hits_once(spark, monkeypatch, tmp_path):
    """Counts, totals, noise and the models of all rounds come from hits that are written once."""
    from basewise.plans import models

    x, minus, count = planted([400], 60, np.random.default_rng(11), 1, 1000, noise=0)
    rows = [(1, 5, "signal", "1", int(a), "-" if m else "+", float(c)) for a, m, c in zip(x, minus, count)]
    seen = tmp_path / "reads"

    def hits(*_):
        def run(batches):
            with seen.open("a") as f:
                f.write("x")
            yield from batches

        h = spark.createDataFrame(rows, "run_id int, cond_id int, channel string, chrom string, pos int, strand string, cnt double")
        return h.coalesce(1).mapInArrow(run, h.schema)

    given = []
    monkeypatch.setattr(models, "_hits", hits)
    monkeypatch.setattr(models, "current_regions", lambda *_: spark.createDataFrame([(7, 1, "1", 1, 1000)], "region_id bigint, run_id int, chrom string, rstart bigint, rend bigint"))
    monkeypatch.setattr(models, "e06_noise_shares", lambda *a: given.append(a[2].count()) or spark.createDataFrame([(7, 5, 0.1)], "region_id bigint, cond_id int, share double"))
    monkeypatch.setattr(models, "genome", lambda *_: spark.createDataFrame([("1", 1_000_000)], "chrom string, len bigint"))
    monkeypatch.setattr(models, "m02_alphas", lambda *_: spark.createDataFrame([(5, 4.0)], "cond_id int, alpha double"))
    assert any(abs(r["position"] - 400) <= 10 for r in models.e07_rounds(spark, "").collect())
    assert seen.read_text() == "x" and given == [len(rows)]


def test_rounds_pack_their_parts_once(spark, monkeypatch):
    """The fits of all rounds read the parts as they are packed once, with their control for those that are assigned."""
    from basewise.plans import models

    x, minus, count = planted([400], 60, np.random.default_rng(11), 1, 1000, noise=0)
    rows = [(1, 5, c, "1", int(a), "-" if m else "+", float(n)) for a, m, n in zip(x, minus, count) for c in ("signal", "control")[: 1 + (a < 380)]]
    monkeypatch.setattr(models, "_hits", lambda *_: spark.createDataFrame(rows, "run_id int, cond_id int, channel string, chrom string, pos int, strand string, cnt double"))
    monkeypatch.setattr(models, "current_regions", lambda *_: spark.createDataFrame([(7, 1, "1", 1, 1000)], "region_id bigint, run_id int, chrom string, rstart bigint, rend bigint"))
    monkeypatch.setattr(models, "e06_noise_shares", lambda *_: spark.createDataFrame([(7, 5, 0.1)], "region_id bigint, cond_id int, share double"))
    monkeypatch.setattr(models, "genome", lambda *_: spark.createDataFrame([("1", 1_000_000)], "chrom string, len bigint"))
    monkeypatch.setattr(models, "m02_alphas", lambda *_: spark.createDataFrame([(5, 4.0)], "cond_id int, alpha double"))
    packed, given, packed_parts, fit_regions = [], [], mx.packed_parts, mx.fit_regions
    monkeypatch.setattr(mx, "packed_parts", lambda *a, **k: packed.append(1) or packed_parts(*a, **k))
    monkeypatch.setattr(mx, "fit_regions", lambda c, *a, **k: given.append(c.columns) or fit_regions(c, *a, **k))
    got = models.e07_rounds(spark, "").collect()
    assert packed == [1] and given == [["parts", "about"]] * 4
    assert any(abs(r["position"] - 400) <= 10 and r["ctrl"] > 0 for r in got)


def test_counts_of_a_part_are_together(spark):
    """One partition has all rows of a part, so they are packed where they are summed, without another shuffle."""
    hits = spark.createDataFrame([(1, 5, c, "1", p, s, 1.0) for p in range(100, 400, 3) for s in "+-" for c in ("signal", "control")], "run_id int, cond_id int, channel string, chrom string, pos int, strand string, cnt double")
    parts = spark.createDataFrame([(7, k, 1, "1", a, a + 99, a, a + 99) for k, a in enumerate((100, 200, 300))], "region_id bigint, part int, run_id int, chrom string, rstart bigint, rend bigint, fit_start bigint, fit_end bigint")
    shares = spark.createDataFrame([(7, 5, 0.2)], "region_id bigint, cond_id int, share double")
    counts = mx.region_counts(hits, parts, shares)
    got = counts.withColumn("at", F.spark_partition_id()).groupBy("part").agg(F.count_distinct("at"), F.count("*"), F.sum("sig"), F.sum("ctrl"), F.min("noise")).collect()
    assert len(got) == 3 and all(r[1] == 1 and r[2] == r[3] == r[4] and r[5] == 0.2 for r in got) and sum(r[2] for r in got) == 200
    assert len(mx.packed_parts(counts, together=True).collect()) <= 3


def test_reported_subtypes_read_the_hits_once(spark, monkeypatch):
    """Totals and fits take the hits of each channel from one table that is written once."""
    from basewise.plans import models

    asked, given = [], []
    h = spark.createDataFrame([(1, c, "1", 500, "+", n) for c, n in (("signal", 90.0), ("control", 7.0))], "rep_id int, channel string, chrom string, pos int, strand string, cnt double")
    rows = spark.createDataFrame([(1, 0, 5, k, 30.0, 0.0) for k in range(4)], "region_id bigint, part int, cond_id int, component int, sig double, ctrl double")
    monkeypatch.setattr(models, "base_hits", lambda _, __, channel="signal": asked.append(channel) or h.where(F.col("channel") == channel))
    monkeypatch.setattr(models, "replicate_runs", lambda *_: spark.sql("SELECT 1 AS rep_id, 1 AS run_id, 5 AS cond_id"))
    monkeypatch.setattr(models, "e03_subtypes_assigned", lambda _, __, hits: given.extend(sorted((r["run_id"], r["cond_id"], r["channel"], r["cnt"]) for r in hits.collect())) or rows)
    monkeypatch.setattr(models, "genome", lambda *_: spark.createDataFrame([("1", 1_000_000)], "chrom string, len bigint"))
    assert len(models._reported_subtypes(spark, "").collect()) == 4
    assert asked == ["signal", "control"] and given == [(1, 5, "control", 7.0), (1, 5, "signal", 90.0)]
