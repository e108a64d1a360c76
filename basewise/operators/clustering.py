"""Clusters of profiles and alignments of pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewise.operators.similarity import cell_score, meet, np_kl, score_pairs, shifted_distances, shifted_matrix
from basewise.session import cut_lineage


def affinity_propagation(s: np.ndarray, preference: float = -0.1, damping: float = 0.9, rounds: int = 2000, stable: int = 200) -> np.ndarray:
    """The exemplar of each item, by messages between all pairs, until exemplars hold for ``stable`` rounds."""
    n = len(s)
    if n == 1:
        return np.zeros(1, int)
    s = s.copy()
    np.fill_diagonal(s, preference)
    r, a, rows, held, last = np.zeros((n, n)), np.zeros((n, n)), np.arange(n), 0, None
    for _ in range(rounds):
        m = a + s
        top = m.argmax(axis=1)
        first = m[rows, top]
        m[rows, top] = -np.inf
        new = s - first[:, None]
        new[rows, top] = s[rows, top] - m.max(axis=1)
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        np.fill_diagonal(p, r.diagonal())
        new = p.sum(axis=0) - p
        own = new.diagonal().copy()
        new = np.minimum(new, 0)
        np.fill_diagonal(new, own)
        a = damping * a + (1 - damping) * new
        now = (a + r).diagonal() > 0
        held = held + 1 if last is not None and (now == last).all() and now.any() else 0
        last = now
        if held >= stable:
            break
    centres = np.flatnonzero(last)
    if not len(centres):
        centres = np.array([int(s.sum(axis=0).argmax())])
    out = centres[s[:, centres].argmax(axis=1)]
    out[centres] = centres
    return out


def cluster(profiles: DataFrame, weight: str, most: int = 500, preference: float = -0.1, reach: int = 25, sigma: float = 1.0) -> DataFrame:
    """``vec_id, exemplar, shift, reverse``: exemplars by affinity propagation over the ``most`` items of largest ``weight``, and for every item the nearest of them.

    The ``most`` items are the size of the model, not of the data. Their similarity is 1 for
    equal profiles and 0 for the farthest pair, by squared distance at the best shift and
    orientation of smoothed profiles; distances over 1 count as 1. All profiles then meet the
    exemplars in blocks; ties go to the smaller exemplar.
    """
    top = profiles.orderBy(F.desc(weight), "vec_id").limit(most).select("vec_id", "profile")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        d = np.minimum(shifted_distances(np.stack(pdf.profile.to_numpy()), reach, sigma), 1.0)
        own = affinity_propagation(1 - d / max(d.max(), 1e-12), preference)
        return pdf.iloc[np.unique(own)][["vec_id", "profile"]].rename(columns={"vec_id": "exemplar", "profile": "q"})

    exemplars = cut_lineage(top.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda pdf: run(pdf), "exemplar bigint, q array<double>"))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("exemplar")
        d, shift, reverse = shifted_matrix(np.stack(left["profile"].to_numpy()), np.stack(right["q"].to_numpy()), reach, sigma)
        d = np.where(left["vec_id"].to_numpy()[:, None] == right["exemplar"].to_numpy(), -1.0, np.round(d, 12))
        k, rows = d.argmin(axis=1), np.arange(len(left))
        own = d[rows, k] < 0
        return pd.DataFrame({
            "vec_id": left["vec_id"].to_numpy(), "exemplar": right["exemplar"].to_numpy()[k], "d": d[rows, k],
            "shift": np.where(own, 0, shift[rows, k]), "reverse": reverse[rows, k] & ~own,
        })

    each = meet(profiles.select("vec_id", "profile"), exemplars, nearest, "vec_id bigint, exemplar bigint, d double, shift int, reverse boolean", block=512)
    best = each.groupBy("vec_id").agg(F.min(F.struct("d", "exemplar", "shift", "reverse")).alias("b"))
    return best.select("vec_id", "b.exemplar", "b.shift", "b.reverse")


def aligned(profiles: DataFrame, members: DataFrame) -> DataFrame:
    """``exemplar, vec_id, place, value``: profiles of members turned and moved as they fit their exemplar; cells that leave a strand are lost."""
    j = profiles.join(members, "vec_id")
    turned = F.when(F.col("reverse"), F.reverse("profile")).otherwise(F.col("profile"))
    n = (F.size("profile") / 2).cast("int")
    cells = j.select("exemplar", "vec_id", "shift", n.alias("_n"), F.posexplode(turned).alias("_at", "value"))
    inside = F.pmod("_at", "_n") + F.col("shift")
    return cells.where((inside >= 0) & (inside < F.col("_n"))).select("exemplar", "vec_id", (F.col("_at") + F.col("shift")).alias("place"), "value")


def k_means(profiles: DataFrame, k: int = 5, seed: int = 10_000) -> DataFrame:
    """``vec_id, cluster``: k-means over all profiles."""
    v = profiles.withColumn("features", array_to_vector("profile"))
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(v).transform(v).select("vec_id", "cluster")


def align(profiles: DataFrame, gap: float = 10_000.0, score: str = "euclidean", every: int = 50) -> DataFrame:
    """``q_id, id, score, shift, reverse``: overlap alignment of two profiles by dynamic programming, in the better orientation.

    Both are scaled to a largest value of 1; cells score as in ``CELL_SCORES``; a gap costs
    ``gap``. The best end lies in the second half of the last column or row, the first such;
    forward wins ties. ``shift`` is where the second profile begins in the first.
    """

    def one(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = q.shape[2]
        cell = cell_score(score, q[:, 0, :, None], p[:, 0, None, :], q[:, 1, :, None], p[:, 1, None, :])
        m = np.zeros((len(q), n + 1, n + 1))
        began = np.zeros((len(q), n + 1, n + 1), int)
        began[:, :, 0] = np.arange(n + 1)
        began[:, 0, :] = -np.arange(n + 1)
        rows = np.arange(len(q))
        for i in range(1, n + 1):
            for j in range(1, n + 1):
                ways = np.stack([m[:, i - 1, j - 1] + cell[:, i - 1, j - 1], m[:, i, j - 1] - gap, m[:, i - 1, j] - gap])
                way = ways.argmax(axis=0)
                m[:, i, j] = ways[way, rows]
                began[:, i, j] = np.choose(way, [began[:, i - 1, j - 1], began[:, i, j - 1], began[:, i - 1, j]])
        ends = np.round(np.concatenate([m[:, n // 2 :, n], m[:, n, n // 2 :]], axis=1), 9)
        starts = np.concatenate([began[:, n // 2 :, n], began[:, n, n // 2 :]], axis=1)
        best = ends.argmax(axis=1)
        return ends[rows, best], starts[rows, best]

    def run(q: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray]:
        n = q.shape[1] // 2
        q, p = (x / np.maximum(x.max(axis=1, keepdims=True), 1e-300) for x in (q, p))
        turned = p[:, ::-1].reshape(len(p), 2, n)
        q, p = q.reshape(len(q), 2, n), p.reshape(len(p), 2, n)
        (s, at), (t, back) = one(q, p), one(q, turned)
        return {"score": np.maximum(s, t), "shift": np.where(t > s, back, at).astype(np.int32), "reverse": t > s}

    return score_pairs(profiles, run, "score double, shift int, reverse boolean", every, at_once=2048)


def nearest_models(profiles: DataFrame, models: DataFrame) -> DataFrame:
    """``vec_id, model, divergence``: the model (``model, m``) of least symmetric divergence from each profile, in either orientation; the smaller number among equals."""
    schema = "vec_id bigint, model int, divergence double"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("model")
        p, m = np.stack(left["profile"].to_numpy()), np.stack(right["m"].to_numpy())
        best = []
        for lo in range(0, len(p), 128):
            d = [np_kl(x, m) + np_kl(m, x).T for x in (p[lo : lo + 128], p[lo : lo + 128, ::-1])]
            best.append(np.round(np.minimum(*d), 8))
        d = np.concatenate(best)
        k = d.argmin(axis=1)
        return pd.DataFrame({"vec_id": left["vec_id"].to_numpy(), "model": right["model"].to_numpy()[k], "divergence": d[np.arange(len(d)), k]})

    each = meet(profiles, models, run, schema, block=512)
    best = each.groupBy("vec_id").agg(F.min(F.struct("divergence", "model")).alias("b"))
    return best.select("vec_id", "b.model", "b.divergence")


def model_divergences(models: DataFrame, reach: int = 30) -> DataFrame:
    """``i, j, d`` (i < j): log of the least symmetric divergence of two models (``model, m``) over rotations of up to ``reach`` and both orientations."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = np.stack(left["m"].to_numpy()), np.stack(right["q"].to_numpy())
        n, best = b.shape[1] // 2, np.full((len(a), len(b)), np.inf)
        for form in (b, b[:, ::-1]):
            for d in range(-reach, reach + 1):
                y = np.concatenate([np.roll(form[:, :n], d, axis=1), np.roll(form[:, n:], d, axis=1)], axis=1)
                best = np.minimum(best, np_kl(a, y) + np_kl(y, a).T)
        x, y = np.nonzero(left["model"].to_numpy()[:, None] < right["j"].to_numpy())
        return pd.DataFrame({"i": left["model"].to_numpy()[x], "j": right["j"].to_numpy()[y], "d": np.round(np.log(np.maximum(best[x, y], 1e-300)), 9)})

    return meet(models, models.select(F.col("model").alias("j"), F.col("m").alias("q")), run, "i int, j int, d double", block=512)


def merge_models(models: DataFrame, sizes: DataFrame, threshold: float = -10.0, reach: int = 30) -> DataFrame:
    """``model, merged_into``: the closest pair below ``threshold`` is merged into the larger (the first if equal), then the closest of those left, and so on.

    Pairs that are the closest of both their models don't depend on each other, so each round
    merges all of them; a model that goes takes its pairs along.
    """
    big, small = (sizes.select(F.col("model").alias(x), F.col("size").alias(f"_{x}")) for x in "ij")
    pairs = cut_lineage(model_divergences(models, reach).where(F.col("d") < threshold).join(big, "i").join(small, "j").select("d", "i", "j", "_i", "_j"))
    gone = None
    while not pairs.isEmpty():
        e = F.struct("d", "i", "j")
        ends = pairs.select(F.col("i").alias("v"), e.alias("e")).unionByName(pairs.select(F.col("j").alias("v"), e.alias("e")))
        both = ends.groupBy("v").agg(F.min("e").alias("e")).groupBy("e").agg(F.count("*").alias("n")).where("n = 2").select("e.*")
        keep_i = F.col("_i") >= F.col("_j")
        drop = cut_lineage(pairs.join(both, ["d", "i", "j"]).select(F.when(keep_i, F.col("j")).otherwise(F.col("i")).alias("model"), F.when(keep_i, F.col("i")).otherwise(F.col("j")).alias("merged_into")))
        gone = drop if gone is None else gone.unionByName(drop)
        for end in "ij":
            pairs = pairs.join(drop.select(F.col("model").alias(end)), end, "left_anti")
        pairs = cut_lineage(pairs.select("d", "i", "j", "_i", "_j"))
    into = models.select("model", F.col("model").alias("merged_into"))
    if gone is not None:
        step = gone.select(F.col("model").alias("_from"), F.col("merged_into").alias("_to"))
        into = cut_lineage(into)
        while True:  # each round follows one merge further
            moved = cut_lineage(into.join(step, F.col("merged_into") == F.col("_from"), "left").select("model", F.coalesce("_to", "merged_into").alias("merged_into"), F.col("_to").isNotNull().alias("_moved")))
            into = moved.drop("_moved")
            if moved.where("_moved").isEmpty():
                break
    return into
