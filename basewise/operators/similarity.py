"""Similarity of stranded profiles held as arrays.

A profile is one array: the values of the watson strand, then those of the crick strand, both
of one length. Its reverse complement is the whole array reversed, which mirrors both strands
and swaps them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def to_profile(x: Column, floor: float = 0.0) -> Column:
    """Absolute values, at least ``floor``, scaled to sum 1."""
    a = F.transform(x, lambda v: F.greatest(F.abs(v.cast("double")), F.lit(floor)))
    return F.transform(a, lambda v: F.try_divide(v, total(a)))


def _sum2(a: Column, b: Column, f) -> Column:
    return total(F.zip_with(a, b, f))


def kl_divergence(a: Column, b: Column) -> Column:
    """Of positive profiles, in nats."""
    return _sum2(a, b, lambda x, y: x * F.ln((x + TINY) / (y + TINY)))


def _wide(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return q[:, None, :], p[None, :, :]


def np_squared(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    a, b = _wide(q, p)
    return ((a - b) ** 2).sum(axis=2)


def np_kl(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    a, b = _wide(q, p)
    return (a * np.log((a + TINY) / (b + TINY))).sum(axis=2)


def np_log_symmetric_kl(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):  # a profile and itself
        return np.log(np_kl(q, p) + np_kl(p, q).T)


def np_rotated_kl(q: np.ndarray, p: np.ndarray, reach: int = 20) -> np.ndarray:
    """The least divergence over rotations of both strands by up to ``reach``."""
    n = p.shape[1] // 2
    turn = lambda d: np.concatenate([np.roll(p[:, :n], d, axis=1), np.roll(p[:, n:], d, axis=1)], axis=1)
    return np.min([np_kl(q, turn(d)) for d in range(-reach, reach + 1)], axis=0)


def np_pearson(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """NaN where either is constant."""
    a, b = q - q.mean(axis=1, keepdims=True), p - p.mean(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return a @ b.T / np.sqrt((a * a).sum(axis=1)[:, None] * (b * b).sum(axis=1))


def np_weighted_pearson(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Pearson correlation weighted by the mean of the two profiles."""
    a, b = _wide(q, p)
    w = (a + b) / 2
    total_w = w.sum(axis=2)
    x = a - ((w * a).sum(axis=2) / total_w)[:, :, None]
    y = b - ((w * b).sum(axis=2) / total_w)[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return (w * x * y).sum(axis=2) / np.sqrt((w * x * x).sum(axis=2) * (w * y * y).sum(axis=2))


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where both are 0."""
    return np.where((a == 0) & (b == 0), 0.0, a / np.where(b == 0, 1.0, b))


def _xlog(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a ln(a / b), 0 for a of 0."""
    return np.where(a == 0, 0.0, a * np.log(np.where(a == 0, 1.0, a) / b))


#: Scores of two cells (x1, x2 the watson and y1, y2 the crick values of both profiles), larger for more alike ones; equal cells score 0.
#: Each takes off the plain differences, so that it falls below 0 for cells far apart.
CELL_SCORES = {
    "linear": lambda x1, x2, y1, y2: (x1 + x2) / 2 + (y1 + y2) / 2 - _apart(x1, x2, y1, y2),
    "euclidean": lambda x1, x2, y1, y2: 1 - np.sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) - _apart(x1, x2, y1, y2),
    "sorensen": lambda x1, x2, y1, y2: 1 - _ratio(_apart(x1, x2, y1, y2), x1 + x2 + y1 + y2) - _apart(x1, x2, y1, y2),
    "soergel": lambda x1, x2, y1, y2: 1 - _ratio(_apart(x1, x2, y1, y2), np.maximum(x1, x2) + np.maximum(y1, y2)) - _apart(x1, x2, y1, y2),
    "lorentzian": lambda x1, x2, y1, y2: 1 - np.log(1 + abs(x1 - x2)) - np.log(1 + abs(y1 - y2)) - _apart(x1, x2, y1, y2),
    "pce": lambda x1, x2, y1, y2: _ratio(x1 * x2 + y1 * y2, x1**2 + y1**2 + x2**2 + y2**2 - x1 * x2 - y1 * y2) - _apart(x1, x2, y1, y2),
    "squared_chi": lambda x1, x2, y1, y2: 1 - _ratio((x1 - x2) ** 2, x1 + x2) - _ratio((y1 - y2) ** 2, y1 + y2) - _apart(x1, x2, y1, y2),
    "divergence": lambda x1, x2, y1, y2: 2 - 2 * (_ratio((x1 - x2) ** 2, (x1 + x2) ** 2) + _ratio((y1 - y2) ** 2, (y1 + y2) ** 2)) - _apart(x1, x2, y1, y2),
    "clark": lambda x1, x2, y1, y2: 1 - np.sqrt(_ratio(x1 - x2, x1 + x2) ** 2 + _ratio(y1 - y2, y1 + y2) ** 2) - _apart(x1, x2, y1, y2),
    "akl": lambda x1, x2, y1, y2: 2 - (_xlog(x1, x2) + _xlog(x2, x1)) / 2 + (_xlog(y1, y2) + _xlog(y2, y1)) / 2 - _apart(x1, x2, y1, y2),
    "allr": lambda x1, x2, y1, y2: 0 * x1,
}


def _apart(x1: np.ndarray, x2: np.ndarray, y1: np.ndarray, y2: np.ndarray) -> np.ndarray:
    return abs(x1 - x2) + abs(y1 - y2)


def cell_score(name: str, x1: np.ndarray, x2: np.ndarray, y1: np.ndarray, y2: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((x1 == x2) & (y1 == y2), 0.0, CELL_SCORES[name](x1, x2, y1, y2))


def np_cell_score(name: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The cells of two profiles at the same places, summed over the length of a strand."""

    def score(q: np.ndarray, p: np.ndarray) -> np.ndarray:
        n = q.shape[1] // 2
        (x1, x2), (y1, y2) = _wide(q[:, :n], p[:, :n]), _wide(q[:, n:], p[:, n:])
        return cell_score(name, x1, x2, y1, y2).sum(axis=2)

    return score


def _slides(q: np.ndarray, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The middle half of ``q`` with each window of ``p`` of that length, as it is and turned."""
    n = q.shape[1] // 2
    w = n // 2
    window = lambda x, s: np.concatenate([x[:, s : s + w], x[:, n + s : n + s + w]], axis=1)
    middle = window(q, (n - w) // 2)
    for s in range(n - w + 1):
        v = window(p, s)
        yield middle, v
        yield middle, v[:, ::-1]


def np_sliding_pearson(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The largest correlation of the middle half of ``q`` with any window of ``p`` of that length, in either orientation. Scaling a window to its maximum, as composites are drawn, doesn't change it."""
    best = None
    for a, v in _slides(q, p):
        r = np_pearson(a, v)
        best = r if best is None else np.fmax(best, r)
    return best


def np_sliding_log_kl(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log of the least symmetric divergence of the middle half of ``q`` and any window of ``p`` of that length, in either orientation, each scaled to sum 1."""
    best = None
    with np.errstate(divide="ignore"):
        for a, v in _slides(q, p):
            a, v = a / a.sum(axis=1, keepdims=True), v / v.sum(axis=1, keepdims=True)
            d = np_kl(a, v) + np_kl(v, a).T
            best = d if best is None else np.fmin(best, d)
        return np.log(best)


def either_way(score: Callable, best: Callable) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The better of a score with a profile and with its reverse complement."""
    return lambda q, p: best(score(q, p), score(q, p[:, ::-1]))


#: Profiles and queries that meet in one task at a time.
GROUP, BLOCK = 1024, 2048


def meet(profiles: DataFrame, queries: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """``run(profiles, queries)`` for each group of about ``group`` profiles and block of about ``block`` queries, a stated set.

    Both sides are cut by hash into parts of a size that doesn't grow, and each part is sent to
    the tasks where it meets those of the other side; nothing goes to the driver.
    """
    n_p, n_q = (max(-(-df.count() // size), 1) for df, size in ((profiles, group), (queries, block)))
    part = lambda df, n: F.pmod(F.xxhash64(df.columns[0]), F.lit(n)).cast("int")
    p = profiles.withColumn("_g", part(profiles, n_p)).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    q = queries.withColumn("_b", part(queries, n_q)).withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(n_p - 1))))

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return run(left, right) if len(left) and len(right) else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    return p.groupBy("_g", "_b").cogroup(q.groupBy("_g", "_b")).applyInPandas(both, schema)


def _queries(profiles: DataFrame, every: int, id_column: str) -> DataFrame:
    return profiles.where(F.col(id_column) % every == 0).select(F.col(id_column).alias("q_id"), F.col("profile").alias("q"))


def score_queries(profiles: DataFrame, scores: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]], every: int = 50, id_column: str = "vec_id", digits: int = 8) -> DataFrame:
    """``q_id, id`` and ``scores``: each profile whose id is divisible by ``every`` against all others.

    Groups of profiles meet blocks of queries as matrices (``meet``). NaN becomes null.
    """
    schema = "q_id bigint, id bigint, " + ", ".join(f"{n} double" for n in scores)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        p, i = np.stack(left["profile"].to_numpy()), left[id_column].to_numpy()
        q, q_ids = np.stack(right["q"].to_numpy()), right["q_id"].to_numpy()
        out = []
        for lo in range(0, len(p), 256):
            for k in range(0, len(q), 64):
                other = q_ids[k : k + 64, None] != i[lo : lo + 256]
                a, c = np.nonzero(other)
                columns = {n: np.round(f(q[k : k + 64], p[lo : lo + 256])[other], digits) for n, f in scores.items()}
                out.append(pd.DataFrame({"q_id": q_ids[k : k + 64][a], "id": i[lo : lo + 256][c], **columns}))
        return pd.concat(out)

    found = meet(profiles.select(id_column, "profile"), _queries(profiles, every, id_column), run, schema)
    return found.select("q_id", "id", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in scores])


def score_pairs(profiles: DataFrame, run: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], columns: str, every: int = 50, id_column: str = "vec_id", at_once: int = 8192) -> DataFrame:
    """``q_id, id`` and ``columns`` of ``run`` on rows of pairs: each profile whose id is divisible by ``every`` against all others. Pairs whose column ``_none`` is true have no row."""
    schema = f"q_id bigint, id bigint, {columns}"
    names = [c.split()[0] for c in schema.split(", ")]

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        p, i = np.stack(left["profile"].to_numpy()), left[id_column].to_numpy()
        q, q_ids = np.stack(right["q"].to_numpy()), right["q_id"].to_numpy()
        a, c = np.nonzero(q_ids[:, None] != i)
        out = [pd.DataFrame(columns=names)]
        for lo in range(0, len(a), at_once):
            x, y = a[lo : lo + at_once], c[lo : lo + at_once]
            found = pd.DataFrame({"q_id": q_ids[x], "id": i[y], **run(q[x], p[y])})
            out.append(found[~found["_none"]][names] if "_none" in found else found)
        return pd.concat(out[1:] or out)

    return meet(profiles.select(id_column, "profile"), _queries(profiles, every, id_column), both, schema)


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Each strand of profiles (rows) averaged with normal weights; the weights inside the strand sum to 1. Without ``sigma``, as given."""
    if not sigma:
        return x
    n = x.shape[1] // 2
    d = np.arange(n)
    k = np.exp(-0.5 * ((d[:, None] - d) / sigma) ** 2)
    k /= k.sum(axis=1, keepdims=True)
    return np.concatenate([x[:, :n] @ k.T, x[:, n:] @ k.T], axis=1)


def shifted_matrix(x: np.ndarray, y: np.ndarray, reach: int = 25, sigma: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least squared distance of all rows of ``x`` and ``y``, compared as in ``best_shift``, with the shift and orientation of y; infinite where nothing overlaps."""
    x, y = smooth(x, sigma), smooth(y, sigma)
    n = x.shape[1] // 2
    best, shift, reverse = np.full((len(x), len(y)), np.inf), np.zeros((len(x), len(y)), np.int32), np.zeros((len(x), len(y)), bool)
    for d in sorted(range(-min(reach, n - 1), min(reach, n - 1) + 1), key=lambda d: (abs(d), d)):
        k = n - abs(d)
        cut = lambda z, s: np.concatenate([z[:, s : s + k], z[:, n + s : n + s + k]], axis=1)  # noqa: B023,E731
        with np.errstate(divide="ignore", invalid="ignore"):
            v = cut(y, max(d, 0))
            v = v / v.sum(axis=1, keepdims=True)
            for rev, z in ((False, x), (True, x[:, ::-1])):
                u = cut(z, max(-d, 0))
                u = u / u.sum(axis=1, keepdims=True)
                e = np.round(np.maximum((u * u).sum(axis=1)[:, None] + (v * v).sum(axis=1) - 2 * u @ v.T, 0), 12)
                better = e < best
                best[better], shift[better], reverse[better] = e[better], d, rev
    return best, shift, reverse


def shifted_distances(x: np.ndarray, reach: int = 25, sigma: float = 0.0) -> np.ndarray:
    """``shifted_matrix`` of all pairs of rows, in the better of both directions."""
    d = shifted_matrix(x, x, reach, sigma)[0]
    return np.minimum(d, d.T)


def best_shift(profiles: DataFrame, reach: int = 25, sigma: float = 0.0, every: int = 50) -> DataFrame:
    """``q_id, id, distance, shift, reverse``: the least squared distance over shifts of ``reach`` and both orientations, of profiles smoothed by ``sigma``.

    A shift moves both strands; cells that leave a strand are lost and what remains of both is
    scaled to sum 1. Ties go to the smaller shift, then the lower one, then forward. A pair
    without overlap has no row. Pairs are compared together, one shift at a time.
    """

    def run(q: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray]:
        q, p = smooth(q, sigma), smooth(p, sigma)
        n = q.shape[1] // 2
        best = np.full(len(q), np.inf)
        shift, reverse = np.zeros(len(q), np.int32), np.zeros(len(q), bool)
        for d in sorted(range(-min(reach, n - 1), min(reach, n - 1) + 1), key=lambda d: (abs(d), d)):
            k = n - abs(d)
            cut = lambda x, s: np.concatenate([x[:, s : s + k], x[:, n + s : n + s + k]], axis=1)  # noqa: B023,E731
            u = cut(q, max(d, 0))
            for rev in (False, True):
                v = cut(p[:, ::-1] if rev else p, max(-d, 0))
                with np.errstate(divide="ignore", invalid="ignore"):
                    e = np.round(((u / u.sum(axis=1, keepdims=True) - v / v.sum(axis=1, keepdims=True)) ** 2).sum(axis=1), 12)
                better = e < best
                best[better], shift[better], reverse[better] = e[better], d, rev
        return {"distance": best, "shift": shift, "reverse": reverse, "_none": ~np.isfinite(best)}

    return score_pairs(profiles, run, "distance double, shift int, reverse boolean", every)
