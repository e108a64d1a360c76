"""Sparse mixtures of binding components, fitted region by region.

Spark brings the counts of one region and condition together; a numpy kernel fits them. A
region is one group, so wide ones are cut at their emptiest bins (``bounded_parts``), which
bounds a group by its bases, not by its reads: counts of one base and strand are one row. Where
a region is cut, both parts are fitted with a ``MARGIN`` over the cut and keep the components
inside the part proper, so an event near a cut has all its hits in one fit and comes out of it.

A model is an array of shape (forms, 2, 2 * reach + 1): the density of a plus and of a minus
hit at each distance from the component, for each form. Without subtypes there is one form;
with subtypes each has two, as given and as its reverse complement.
"""

from __future__ import annotations

import dataclasses
import itertools
import pickle
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basewise.operators import compiled
from basewise.operators.intervals import points_in_intervals, small_side

LONGEST, SPACING, MOVE = 2000, 30, 30
#: what names a part of a condition
PART = ["region_id", "part", "cond_id"]
#: bases over a cut that are fitted with a part: twice the reach of a model
MARGIN = 200
#: iterations without sparseness, until it is fully on, and at most; equal states that end a fit
PLAIN, ANNEALED, MOST, EQUAL = 50, 100, 2000, 3
TINY = 1e-300
#: share of a component by which its forms are thinned
BETA = 0.05
#: scores of moves that are held at once, but at least those of one form of a component; pairs of a hit and a form with which a round has work enough
KEPT, PAIRS = 250000, 200_000


def normal_model(sigma: float = 20.0, shift: float = 0.0, reach: int = 100) -> np.ndarray:
    """One unstranded form: plus hits around ``-shift``, minus hits mirrored."""
    d = np.arange(-reach, reach + 1)
    plus = np.exp(-0.5 * ((d + shift) / sigma) ** 2)
    return np.array([[plus / plus.sum(), plus[::-1] / plus.sum()]]) / 2


def with_reverse(models: np.ndarray) -> np.ndarray:
    """Each form and its reverse complement: strands swapped, both mirrored."""
    return np.concatenate([[m, m[::-1, ::-1]] for m in models])


def bounded_parts(regions: DataFrame, hits: DataFrame, longest: int = LONGEST, step: int = 25, margin: int = MARGIN) -> DataFrame:
    """``region_id, part, run_id, chrom, rstart, rend, fit_start, fit_end``: regions of 1.5 times ``longest`` or more in parts of at most 1.75 times it.

    A cut goes to the emptiest bin of ``step`` bases of the run's signal within a quarter of
    ``longest`` around each multiple of it, the first such. ``hits``: ``run_id, channel, chrom,
    pos, cnt``. Bins meet the counts by equality, so a region as wide as a chromosome is many
    rows and no group. The fitted stretch has a margin over each cut.
    """
    width = F.col("rend") - F.col("rstart") + 1
    r = regions.select("region_id", "run_id", "chrom", "rstart", "rend")
    cuts = r.where(width >= 1.5 * longest).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.floor((width - 1 - longest // 2) / longest))))
    at = F.col("rstart") + F.col("_k") * longest
    bins = cuts.withColumn("_bin", F.explode(F.sequence(F.ceil((at - longest // 4) / step), F.floor((at + longest // 4) / step))))
    level = hits.where("channel = 'signal'").select("run_id", "chrom", F.floor(F.col("pos") / step).alias("_bin"), "cnt")
    # only counts near a cut are summed
    level = level.join(small_side(bins.select("run_id", "chrom", "_bin").distinct()), ["run_id", "chrom", "_bin"], "left_semi")
    level = level.groupBy(F.col("run_id").alias("_run"), F.col("chrom").alias("_chrom"), F.col("_bin").alias("_at")).agg(F.sum("cnt").alias("_hits"))
    on = (bins["run_id"] == level["_run"]) & (bins["chrom"] == level["_chrom"]) & (bins["_bin"] == level["_at"])
    best = bins.join(level, on, "left").groupBy("region_id", "_k").agg(F.min(F.struct(F.coalesce("_hits", F.lit(0.0)).alias("h"), F.col("_bin").alias("b"))).alias("_best"))
    starts = best.select("region_id", "_k", (F.col("_best.b") * step).alias("_a")).unionByName(r.select("region_id", F.lit(0).cast("bigint").alias("_k"), F.col("rstart").alias("_a")))
    # one row for each cut of a region
    w = Window.partitionBy("region_id").orderBy("_k")
    parts = starts.withColumn("_z", F.lead("_a").over(w) - 1).join(r, "region_id")
    end = F.coalesce("_z", "rend")
    return parts.select(
        "region_id", F.col("_k").cast("int").alias("part"), "run_id", "chrom", F.col("_a"), end.alias("_e"),
        F.when(F.col("_k") > 0, F.col("_a") - margin).otherwise(F.col("_a")).alias("fit_start"), F.when(F.col("_z").isNotNull(), F.col("_z") + margin).otherwise(F.col("rend")).alias("fit_end"),
    ).withColumnsRenamed({"_a": "rstart", "_e": "rend"})


def spread_groups(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` in a fixed number of partitions by ``keys``, without them row by row: groups are few bytes but long work, so AQE must not pack them by size."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def region_counts(hits: DataFrame, parts: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """``region_id, part, cond_id, rstart, rend, fit_start, fit_end, chrom, pos, strand, sig, ctrl``: counts of each base of the fitted stretch of each part, those of a part in one partition.

    ``hits``: ``run_id, cond_id, channel, chrom, pos, strand, cnt``; ``parts`` as ``bounded_parts``.
    With ``shares`` (``region_id, cond_id, share``), which are written, ``noise`` is that share, 0.05 where there is none.
    """
    side = lambda c: F.sum(F.when(F.col("channel") == c, F.col("cnt")).otherwise(0.0))
    own = hits.select("run_id", "cond_id", "channel", "chrom", "pos", "strand", "cnt")
    held = points_in_intervals(own, parts, ["run_id", "chrom"], start="fit_start", end="fit_end", width=LONGEST)
    noise = []
    if shares is not None:
        held = held.join(small_side(shares), ["region_id", "cond_id"], "left").withColumn("noise", F.coalesce("share", F.lit(0.05)))
        noise = ["noise"]
    # parts move once: their counts are summed where they are fitted
    base = spread_groups(held, PART).groupBy(*PART, "rstart", "rend", "fit_start", "fit_end", "chrom", "pos", "strand", *noise)
    return base.agg(side("signal").alias("sig"), side("control").alias("ctrl"))


def _density(model: np.ndarray, minus: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Density by form of hits (last axis) at distances of shape (..., forms, hits)."""
    reach = model.shape[2] // 2
    inside = np.abs(distance) <= reach
    form = np.arange(model.shape[0])[:, None]
    return np.where(inside, model[form, minus.astype(int), np.clip(distance + reach, 0, 2 * reach)], 0.0)


@dataclasses.dataclass
class Parts:
    """Counts of several parts side by side, sorted by part and place: ``x, minus, sig, ctrl`` of each hit and its part in ``of``; of each part its number in ``part``, ``start``, ``end``, ``noise`` and ``alpha``."""

    of: np.ndarray
    x: np.ndarray
    minus: np.ndarray
    sig: np.ndarray
    ctrl: np.ndarray
    part: np.ndarray
    start: np.ndarray
    end: np.ndarray
    noise: np.ndarray
    alpha: np.ndarray

    def __len__(self) -> int:
        return len(self.part)

    def hits(self, keep: np.ndarray) -> Parts:
        each = {f: getattr(self, f)[keep] for f in ("of", "x", "minus", "sig", "ctrl")}
        return dataclasses.replace(self, **each)

    def parts(self, keep: np.ndarray) -> Parts:
        """The parts that a mask keeps, numbered anew."""
        number = np.cumsum(keep) - 1
        inside = keep[self.of]
        each = {f: getattr(self, f)[inside] for f in ("x", "minus", "sig", "ctrl")}
        return Parts(of=number[self.of[inside]], **each, **{f: getattr(self, f)[keep] for f in ("part", "start", "end", "noise", "alpha")})

    @staticmethod
    def joined(all_: list[Parts]) -> Parts:
        shift = np.cumsum([0] + [len(p) for p in all_[:-1]])
        rest = {f.name: np.concatenate([getattr(p, f.name) for p in all_]) for f in dataclasses.fields(Parts) if f.name != "of"}
        return Parts(of=np.concatenate([p.of + s for p, s in zip(all_, shift)]), **rest)


#: keys of places: far more than the bases of a part
_APART = 1 << 33


class _Reach:
    """Finds the hits within reach of places; hits and places count from the start of their part."""

    def __init__(self, p: Parts, model: np.ndarray) -> None:
        self.reach, self.span = model.shape[2] // 2, model.shape[2]
        at = p.x - p.start[p.of]
        self.key = p.of * _APART + at
        self.code = at + p.minus * self.span
        self.flat = np.ascontiguousarray(model).ravel()

    def pairs(self, of: np.ndarray, form: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, hit and cell of the model for every pair within reach, ordered by place."""
        k = of * _APART + place
        low = np.searchsorted(self.key, k - self.reach)
        n = np.searchsorted(self.key, k + self.reach, "right") - low
        row = np.repeat(np.arange(len(k)), n)
        hit = np.arange(len(row)) + (low - np.cumsum(n) + n)[row]
        return row, hit, self.code[hit] + (form * 2 * self.span + self.reach - place)[row]


def _log_density(model: np.ndarray) -> np.ndarray:
    """Log density of a hit at each distance, of up to ``MOVE`` beyond the reach too."""
    return np.log2(np.maximum(np.pad(model, [(0, 0), (0, 0), (MOVE, MOVE)]), TINY))


class _Fits:
    """Fits of many parts at once, each as ``fit`` has it: one ``step`` is a round of every part that is not done."""

    def __init__(self, model: np.ndarray, beta: float) -> None:
        self.model, self.beta, self.forms = model, beta, len(model)
        moved = np.lib.stride_tricks.sliding_window_view(_log_density(model), 2 * MOVE + 1, axis=2)[..., ::-1]
        self.scores = np.ascontiguousarray(moved).reshape(-1, 2 * MOVE + 1)
        self.pairs_before = 0
        self.p = self.reach = None

    def add(self, p: Parts, at: np.ndarray | None = None) -> None:
        """Start to fit ``p``, parts with signal only, from a component every ``SPACING`` bases or ``at`` places of the only part."""
        n = np.maximum((p.end - p.start) // SPACING + 1, 0) if at is None else np.array([len(at)])
        n = np.where(np.bincount(p.of, p.sig, len(p)) <= p.alpha, 0, n)  # all would go, one by one
        of = np.repeat(np.arange(len(p)), n)
        place = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * SPACING if at is None else (at - p.start[0])[: len(of)]
        new = {
            "of": of, "mu": np.repeat(place[:, None], self.forms, axis=1), "pi": ((1 - p.noise) / np.maximum(n, 1))[of], "tau": np.full((len(of), self.forms), 1.0 / self.forms),
            "t": np.zeros(len(p), np.int64), "equal": np.zeros(len(p), np.int64), "rounds": np.zeros(len(p), np.int64),
        }
        new["was"] = (new["mu"], np.full(len(of), np.nan), new["tau"])
        if self.p is not None and len(self.p):
            new["of"] = of + len(self.p)
            p = Parts.joined([self.p, p])
            new = {k: tuple(np.concatenate(z) for z in zip(getattr(self, k), v)) if k == "was" else np.concatenate([getattr(self, k), v]) for k, v in new.items()}
        self.__dict__.update(new)
        self._place(p)

    def _place(self, p: Parts) -> None:
        self.p = p
        own = p.hits(p.sig > 0)
        self.hit_of, self.count = own.of, own.sig
        self.reach = _Reach(own, self.model)
        self.width = p.end - p.start + 1
        self.floor = (p.noise / self.width / 2)[own.of]

    def _take(self, keep: np.ndarray) -> None:
        self.of, self.mu, self.pi, self.tau = self.of[keep], self.mu[keep], self.pi[keep], self.tau[keep]
        self.was = tuple(x[keep] for x in self.was)

    def done(self) -> tuple[Parts, tuple[np.ndarray, ...]] | None:
        """Parts that have ended, with ``of, mu, pi, tau`` of their components; they are let go."""
        live = np.bincount(self.of, minlength=len(self.p)) > 0
        ended = ~live | (self.rounds >= MOST) | ((self.t > ANNEALED) & (self.equal >= EQUAL))
        if not ended.any():
            return None
        mine = ended[self.of]
        out = self.p.parts(ended), ((np.cumsum(ended) - 1)[self.of[mine]], self.mu[mine], self.pi[mine], self.tau[mine])
        self._take(~mine)
        self.of = (np.cumsum(~ended) - 1)[self.of]
        self.t, self.equal, self.rounds = self.t[~ended], self.equal[~ended], self.rounds[~ended]
        self._place(self.p.parts(~ended))
        return out

    def _best_moves(self, row: np.ndarray, cell: np.ndarray, weighted: np.ndarray, place: np.ndarray, width: np.ndarray) -> np.ndarray:
        """The best move for each row, of ``place`` in a part of ``width``; no move for rows without pairs. Scores of at most ``KEPT`` numbers are held at once, or of one row."""
        best = np.full(len(place), MOVE)
        n = np.bincount(row, minlength=len(place))
        first = np.cumsum(n) - n
        rows = np.argsort(n, kind="stable")
        rows = rows[np.searchsorted(n[rows], 1) :]
        moves, i = 2 * MOVE + 1, 0
        while i < len(rows):
            # rows of about as many pairs; those of fewer have a weight of 0 for the rest
            k = i + max(KEPT // (int(n[rows[i]]) * moves), 1)
            k = i + max(KEPT // (int(n[rows[min(k, len(rows)) - 1]]) * moves), 1)
            r = rows[i:k]
            place_in = np.arange(n[r[-1]])
            own = place_in < n[r, None]
            at = np.where(own, first[r, None] + place_in, 0)
            score = np.matmul(np.where(own, weighted[at], 0.0)[:, None], self.scores.take(cell[at], axis=0))[:, 0]
            score *= 1e9
            np.rint(score, out=score)
            edge = np.flatnonzero((place[r] < MOVE) | (place[r] >= width[r] - MOVE))
            to = place[r[edge], None] + np.arange(-MOVE, MOVE + 1)
            score[edge] = np.where((to < 0) | (to >= width[r[edge], None]), -np.inf, score[edge])
            best[r] = np.argmax(score, axis=1)
            i = k
        return best - MOVE

    def step(self) -> None:
        """One round; every part has a component."""
        forms, parts = self.forms, len(self.p)
        noise, alpha = self.p.noise, self.p.alpha
        ease = np.clip((self.t - PLAIN) / (ANNEALED - PLAIN), 0.0, 1.0)
        sizes = np.bincount(self.of, minlength=parts)
        self.rounds += 1
        # share hits
        live = np.flatnonzero(self.tau.ravel() > 0)
        c, form = live // forms, live % forms
        place = self.mu[c, form]
        row, hit, cell = self.reach.pairs(self.of[c], form, place)
        self.pairs_before = len(row)
        h = self.reach.flat[cell] * (self.pi[c] * self.tau[c, form])[row]
        weighted = h / (np.bincount(hit, h, len(self.count)) + self.floor)[hit] * self.count[hit]
        r = np.zeros(self.mu.size)
        r[live] = np.bincount(row, weighted, len(live))
        # move
        held = np.flatnonzero(weighted > 0)
        self.mu[c, form] = place + self._best_moves(row[held], cell[held], weighted[held], place, self.width[self.of[c]])
        r = r.reshape(-1, forms)
        reached = r.sum(axis=1) > 0
        if not reached.all():  # no hit within reach, now or later
            self._take(reached)
            r = r[reached]
        if not len(self.of):
            return
        # merge
        key = self.of * _APART + (self.mu[:, 0] if forms == 1 else np.rint(((self.mu + self.p.start[self.of][:, None]) * self.tau).sum(axis=1)).astype(np.int64))
        order = np.argsort(key, kind="stable")
        new = np.append(True, np.diff(key[order]) > 0)
        if not new.all():
            r = self._merge(r, order, new)
        total = r.sum(axis=1)
        # weights
        first = np.flatnonzero(np.append(True, np.diff(self.of) > 0))
        there = self.of[first]  # parts that have components left
        least = np.zeros(parts)
        least[there] = np.minimum.reduceat(total, first)
        gone = np.zeros(parts, bool)
        gone[there] = least[there] <= (alpha * ease)[there]
        weakest = np.flatnonzero((total == least[self.of]) & gone[self.of])
        weakest = weakest[np.append(True, np.diff(self.of[weakest]) > 0)] if len(weakest) else weakest
        if len(weakest):
            keep = np.ones(len(total), bool)
            keep[weakest] = False
            self._take(keep)
            r, total = r[keep], total[keep]
        pi = np.where(gone[self.of], total, total - (alpha * ease)[self.of])
        self.pi = pi / np.bincount(self.of, pi, parts)[self.of] * (1 - noise)[self.of]
        # forms
        if forms > 1 and len(self.of):
            shares = np.where(self.tau > 0, r, np.inf)
            weak, each = np.argmin(shares, axis=1), np.arange(len(self.of))
            thin = self.beta * total * ease[self.of]
            out = (shares[each, weak] <= thin) & ((self.tau > 0).sum(axis=1) > 1)
            tau = np.where(self.tau > 0, np.where(out[:, None], r, np.maximum(r - thin[:, None], 0)), 0.0)
            tau[np.flatnonzero(out), weak[out]] = 0.0
            sums = tau.sum(axis=1, keepdims=True)
            self.tau = np.where(sums > 0, tau / np.where(sums > 0, sums, 1), 1.0 / forms)
        # states
        state = self.mu, np.round(self.pi, 10), np.round(self.tau, 10)
        same = (state[0] == self.was[0]).all(axis=1) & (state[1] == self.was[1]) & (state[2] == self.was[2]).all(axis=1)
        same = (np.bincount(self.of, minlength=parts) == sizes) & (np.bincount(self.of, ~same, parts) == 0)
        self.equal = np.where((self.t > ANNEALED) & same, self.equal + 1, 0)
        self.was = (state[0].copy(), *state[1:])
        self.t += ~gone

    def _merge(self, r: np.ndarray, order: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Components at one place become the strongest of them, with the hits of all; those of a part in which some merge are ordered by place."""
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        merged = np.zeros((int(new.sum()), self.forms))
        np.add.at(merged, number, r)
        ranked = np.lexsort((-r.sum(axis=1), number))  # stable: the first among equals
        strongest = ranked[new]
        whole = np.bincount(self.of[strongest], minlength=len(self.p)) == np.bincount(self.of, minlength=len(self.p))
        old = whole[self.of[strongest]]
        # parts without a merger keep the order they have
        strongest[old] = np.sort(strongest[old])
        self._take(strongest)
        return merged[number[strongest]]


def _fitted(p: Parts, found: tuple[np.ndarray, ...], model: np.ndarray) -> dict[str, np.ndarray]:
    """``of, position, form, pi, plus, minus, tau, places`` of the components ``of, mu, pi, tau``, by part and position."""
    of, mu, pi, tau = found
    own = p.hits(p.sig > 0)
    near = _Reach(own, model)
    live = np.flatnonzero(tau.ravel() > 0)
    c, form = live // len(model), live % len(model)
    row, hit, cell = near.pairs(of[c], form, mu[c, form])
    h = near.flat[cell] * (pi[c] * tau[c, form])[row]
    w = h / (np.bincount(hit, h, len(own.x)) + (p.noise / (p.end - p.start + 1) / 2)[own.of])[hit] * own.sig[hit]
    minus = own.minus[hit]
    chosen = tau.argmax(axis=1)
    places = mu + p.start[of][:, None]
    position = places[np.arange(len(of)), chosen]
    out = {
        "of": of, "position": position, "form": chosen, "pi": pi, "plus": np.bincount(c[row[~minus]], w[~minus], len(of)), "minus": np.bincount(c[row[minus]], w[minus], len(of)),
        "tau": tau, "places": places,
    }
    order = np.lexsort((position, of))
    return {k: v[order] for k, v in out.items()}


def _assigned(p: Parts, of: np.ndarray, position: np.ndarray, pi: np.ndarray, tau: np.ndarray, model: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """``assign`` for the components of many parts."""
    near = _Reach(p, model)
    c, hit, cell = near.pairs(of, np.zeros(len(of), np.int64), position - p.start[of])
    h = np.zeros(len(c))
    for k in range(len(model)):
        h += near.flat[cell + k * 2 * near.span] * tau[c, k]
    floor = (p.noise / (p.end - p.start + 1) / 2)[p.of]
    sig = p.sig[hit]

    def shares(pi: np.ndarray) -> np.ndarray:
        w = h * pi[c]
        return w / (np.bincount(hit, w, len(p.x)) + floor)[hit]

    for _ in range(rounds):
        s = np.bincount(c, shares(pi) * sig, len(of))
        total = np.bincount(of, s, len(p))[of]
        pi = np.where(total > 0, s / np.where(total > 0, total, 1) * (1 - p.noise[of]), pi)
    share = shares(pi)
    held = np.bincount(p.of, p.ctrl, len(p))[of] > 0
    return np.bincount(c, share * sig, len(of)), np.where(held, np.bincount(c, share * p.ctrl[hit], len(of)), pi)


def fit_many(source: Iterator[Parts], model: np.ndarray, beta: float = BETA, at: np.ndarray | None = None) -> Iterator[tuple[Parts, tuple[np.ndarray, ...]]]:
    """Parts with ``of, mu, pi, tau`` of their components, as they end. New parts join as others end, so that a round has work enough; ``source`` gives few hits at a time."""
    fits, more = _Fits(model, beta), True
    while more or len(fits.p):
        while more and (fits.p is None or not len(fits.p) or fits.pairs_before < PAIRS // 2):
            p = next(source, None)
            more = p is not None
            if more:
                fits.add(p, at)
                # about as many pairs as the first round will have
                fits.pairs_before += int((p.sig > 0).sum()) * (2 * fits.reach.reach // SPACING + 1) * len(model)
        if fits.p is None:
            return
        if ended := fits.done():
            yield ended
        if len(fits.p):
            fits.step()


def _together(ended: Iterator[tuple[Parts, tuple[np.ndarray, ...]]], least: int = 200) -> Iterator[tuple[Parts, tuple[np.ndarray, ...]]]:
    """What ends round by round, at least ``least`` parts at a time."""
    kept: list[tuple[Parts, tuple[np.ndarray, ...]]] = []
    for e in itertools.chain(ended, [None]):
        if e is not None:
            kept.append(e)
        if kept and (e is None or sum(len(p) for p, _ in kept) >= least):
            shift = np.cumsum([0] + [len(p) for p, _ in kept[:-1]])
            of = np.concatenate([f[0] + s for (_, f), s in zip(kept, shift)])
            yield Parts.joined([p for p, _ in kept]), (of, *(np.concatenate([f[k] for _, f in kept]) for k in (1, 2, 3)))
            kept = []


def _settings(model: np.ndarray, beta: float) -> bytes:
    """What ``MixtureRounds`` knows besides the parts."""
    numbers = struct.pack("<5q3d", len(model), model.shape[2] // 2, MOST, EQUAL, SPACING, PLAIN, ANNEALED, beta)
    return numbers + model.astype("<f8").tobytes() + _log_density(model).astype("<f8").tobytes()


def _packed(p: Parts) -> bytes:
    """Parts for ``MixtureRounds``, which reads them up to ``sig``."""
    first = np.append(0, np.cumsum(np.bincount(p.of, minlength=len(p))))
    all_ = [[len(p), len(p.x)], p.alpha, p.noise, p.start, p.end, first, p.x, p.minus, p.sig, p.ctrl]
    return b"".join(np.asarray(x, "<f8" if k in (1, 2, 8, 9) else "<i8").tobytes() for k, x in enumerate(all_))


def _parts(packed: bytes) -> Parts:
    """Parts, numbered from 0."""
    n, hits = np.frombuffer(packed, "<i8", 2).tolist()
    ends = np.cumsum([2, n, n, n, n, n + 1, hits, hits, hits, hits])
    words = np.split(np.frombuffer(packed, "<i8"), ends[:-1])
    alpha, noise, sig, ctrl = (words[k].view("<f8") for k in (1, 2, 8, 9))
    return Parts(np.repeat(np.arange(n), np.diff(words[5])), words[6], words[7] > 0, sig, ctrl, np.arange(n), words[3], words[4], noise, alpha)


def _unpacked(packed: bytes, fits: bytes, forms: int) -> tuple[Parts, tuple[np.ndarray, ...]]:
    """Parts, numbered from 0, with ``of, mu, pi, tau`` of the components that ``MixtureRounds`` gives."""
    p = _parts(packed)
    n = len(p)
    found = np.frombuffer(fits, [("pi", "<f8"), ("mu", "<i8", (forms,)), ("tau", "<f8", (forms,))], offset=8 * n)
    return p, (np.repeat(np.arange(n), np.frombuffer(fits, "<i8", n)), *(np.ascontiguousarray(found[c]) for c in ("mu", "pi", "tau")))


def fit(x: np.ndarray, minus: np.ndarray, count: np.ndarray, start: int, end: int, model: np.ndarray, alpha: float, noise: float = 0.1, beta: float = BETA, at: np.ndarray | None = None) -> pd.DataFrame:
    """Components of one region: ``position, form, pi, plus, minus, tau, places``; the last two by form.

    Starts with a component every ``SPACING`` bases (or ``at``), all forms equal. Each round
    shares every hit among components and uniform noise, moves each form of a component by up
    to ``MOVE`` bases to its best place (the lowest among equals), merges components at one
    place, and sets weights to the shares less ``alpha``. A component with no more than
    ``alpha`` goes, the weakest only, and such a round doesn't count. Forms within a component
    are thinned alike by ``beta`` of its share. Both are off for ``PLAIN`` rounds and full
    after ``ANNEALED``. Counts of no more than ``alpha`` in all leave no component.
    """
    order = np.argsort(x, kind="stable")
    one = lambda v: np.array([v])
    p = Parts(np.zeros(len(x), np.int64), x[order], minus[order], count[order], np.zeros(len(x)), one(0), one(start), one(end), one(noise), one(float(alpha)))
    ((p, found),) = fit_many(iter([p]), model, beta, None if at is None else np.asarray(at))
    out = _fitted(p, found, model)
    lists = {k: pd.Series(out.pop(k).tolist(), dtype=object) for k in ("tau", "places")}
    return pd.DataFrame({k: v for k, v in out.items() if k != "of"}).assign(**lists)


def assign(x: np.ndarray, minus: np.ndarray, sig: np.ndarray, ctrl: np.ndarray, mu: np.ndarray, pi: np.ndarray, tau: np.ndarray, model: np.ndarray, width: int, noise: float = 0.1, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Signal and control counts of components at fixed places: ``rounds`` of weights from the signal, then the control by the last weights; without control a count of 1 is shared by weight."""
    order = np.argsort(x, kind="stable")
    one = lambda v: np.array([v])
    p = Parts(np.zeros(len(x), np.int64), x[order], minus[order], sig[order], ctrl[order], one(0), one(0), one(width - 1), one(noise), one(0.0))
    return _assigned(p, np.zeros(len(mu), np.int64), mu, pi, tau, model, rounds)


COMPONENTS = "region_id bigint, part int, cond_id int, chrom string, component int, position bigint, form int, pi double, plus double, minus double, tau array<double>, places array<bigint>"


def fit_regions(counts: DataFrame, model: np.ndarray, alpha: float | None = 5.0, noise: float = 0.1, assigned: bool = False, together: bool = False) -> DataFrame:
    """Components of every part and condition of ``region_counts``, numbered along the part; those of a margin serve the fit and are left out.

    Without ``alpha``, that of the column ``alpha``; a column ``noise`` goes before ``noise``.
    With ``assigned``, ``sig`` and ``ctrl`` are the counts of each component by maximum
    likelihood (``assign``), taken in the same group as the fit. ``together`` as ``packed_parts``,
    whose written rows may be given instead of counts; then they have their alpha and noise.
    """
    packed = spread_groups(counts) if "parts" in counts.columns else packed_parts(counts, alpha, noise, assigned, together)
    return _fit_packed(packed, model, assigned)


def packed_parts(counts: DataFrame, alpha: float | None = 5.0, noise: float = 0.1, control: bool = True, together: bool = False) -> DataFrame:
    """``parts, about``: the parts of ``region_counts`` for ``fit_regions``, many in a row; unless ``control``, without bases of control only. ``together``: the rows of a part are in one partition already."""
    own = [*PART, "chrom", "rstart", "rend"]
    values = {"noise": None if "noise" in counts.columns else noise, "alpha": alpha}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole parts, with what their components carry; the last of a batch waits for the next."""
        rest = None
        for b in itertools.chain(batches, [None]):
            t = rest if b is None else pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if t is None or not t.num_rows:
                continue
            keys = np.stack([t[c].fill_null(-1).to_numpy().astype(np.int64) for c in PART])
            first = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            upto = t.num_rows if b is None else int(first[-1])
            rest, t, first = t.slice(upto), t.slice(0, upto), first[first < upto]
            if not upto:
                continue
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, upto)))
            n = lambda c: t[c].to_numpy().astype(float)  # noqa: E731,B023
            each = {k: np.full(len(first), v) if (v := values.get(k)) is not None else n(k)[first] for k in ("noise", "alpha")}  # noqa: B023
            sig = n("sig")
            p = Parts(of, t["pos"].to_numpy().astype(np.int64), pc.equal(t["strand"], "-").to_numpy(), sig, n("ctrl"), np.arange(len(first)), t["fit_start"].to_numpy()[first].astype(np.int64), t["fit_end"].to_numpy()[first].astype(np.int64), **each)
            p = p if control else p.hits(sig > 0)
            p = p.parts(np.bincount(p.of, p.sig > 0, len(p)) > 0)
            about = pickle.dumps(list(zip(*[t[c].take(pa.array(first[p.part])).to_pylist() for c in own])))
            yield pa.RecordBatch.from_arrays([pa.array([_packed(p)], pa.binary()), pa.array([about], pa.binary())], names=["parts", "about"])

    grouped = counts if together else spread_groups(counts, PART)
    return grouped.sortWithinPartitions(*PART, "pos", "strand").mapInArrow(packed, "parts binary, about binary")


def _fit_packed(packed: DataFrame, model: np.ndarray, assigned: bool = False) -> DataFrame:
    """``fit_regions`` of ``packed_parts``, which must have their ``control`` if ``assigned``."""
    schema = COMPONENTS + (", sig double, ctrl double" if assigned else "")
    columns = [c.split()[0] for c in schema.split(", ")]
    own = [*PART, "chrom"]

    def parts(batches: Iterator[pa.RecordBatch], about: dict[int, tuple]) -> Iterator[Parts]:
        """``about``: what a part's components carry, by its number."""
        number = 0
        for b in batches:
            for p, given in zip(b["parts"], b["about"]):
                p = _parts(p.as_py())
                p = dataclasses.replace(p, part=p.part + number)
                about.update(zip(p.part.tolist(), pickle.loads(given.as_py())))
                number += len(p)
                yield p

    def rows(p: Parts, found: tuple[np.ndarray, ...], given: list[tuple]) -> pa.RecordBatch:
        out = _fitted(p, found, model)
        of = out.pop("of")
        if assigned:
            out["sig"], out["ctrl"] = _assigned(p, of, out["position"], out["pi"], out["tau"], model)
        rstart, rend = (np.array([g[k] for g in given], np.int64) for k in (4, 5))
        keep = np.flatnonzero((out["position"] >= rstart[of]) & (out["position"] <= rend[of]))
        of, out = of[keep], {k: v[keep] for k, v in out.items()}
        first = np.append(True, np.diff(of) > 0)[: len(of)]
        out["component"] = np.arange(len(of)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(of) else of
        out |= {c: pa.array([given[k][i] for k in of.tolist()], kind) for i, (c, kind) in enumerate(zip(own, (pa.int64(), pa.int32(), pa.int32(), pa.string())))}
        lists = pa.array(np.arange(len(of) + 1) * len(model), pa.int32())
        out |= {k: pa.ListArray.from_arrays(lists, pa.array(out[k].ravel())) for k in ("tau", "places")}
        out |= {k: pa.array(out[k], pa.int32()) for k in ("component", "form")}
        out["position"] = pa.array(out["position"], pa.int64())
        # sums of no components at all are whole numbers to numpy
        return pa.RecordBatch.from_arrays([out[c] if isinstance(out[c], pa.Array) else pa.array(out[c], pa.float64()) for c in columns], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about: dict[int, tuple] = {}
        for p, found in _together(fit_many(parts(batches, about), model)):
            yield rows(p, found, [about.pop(k) for k in p.part.tolist()])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, about, fits in zip(b["parts"], b["about"], b["fits"]):
                yield rows(*_unpacked(p.as_py(), fits.as_py(), len(model)), pickle.loads(about.as_py()))

    rounds = compiled.registered(packed.sparkSession)
    if rounds is None:
        return packed.mapInArrow(run, schema)
    return packed.withColumn("fits", F.call_function(rounds, "parts", F.lit(_settings(model, BETA)))).mapInArrow(unpacked, schema)


def read_profiles(hits: DataFrame, counts: DataFrame, components: DataFrame, model: np.ndarray, noise: float = 0.1, half: int = 250) -> DataFrame:
    """``region_id, part, cond_id, component, rep_id, offset, strand, value``: counts of each replicate that belong to a component, by distance from its place.

    The share of a component in a base is that of its forms under the last weights, held
    against all components of the part and the noise; a replicate's counts are shared alike.
    ``hits``: ``cond_id, rep_id, chrom, pos, strand, cnt``.
    """
    names = ["region_id", "part", "cond_id"]
    schema = "region_id bigint, part int, cond_id int, component int, at bigint, chrom string, pos int, strand string, share double"
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = b["_held"].flatten()
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b["_held"]).to_numpy())
            n = lambda c: each.field(c).to_numpy()  # noqa: E731,B023
            wide = lambda c: each.field(c).flatten().to_numpy().reshape(len(row), -1)  # noqa: E731,B023
            x, minus = b["pos"].to_numpy().astype(np.int64), pc.equal(b["strand"], "-").to_numpy(zero_copy_only=False)
            # densities by form, then hit
            h = _density(model, minus[row], (x[row, None] - wide("places")).T).T * wide("tau")
            h = h.sum(axis=1) * n("pi")
            share = h / (np.bincount(row, h, b.num_rows) + b["_floor"].to_numpy())[row]
            keep = np.flatnonzero((share > 0) & (np.abs(x[row] - n("position")) <= half))
            at = pa.array(row[keep])
            out = {c: b[c].take(at) for c in (*names, "chrom", "pos", "strand")} | {"component": each.field("component").take(pa.array(keep)), "at": each.field("position").take(pa.array(keep)), "share": pa.array(share[keep])}
            yield pa.RecordBatch.from_arrays([out[c] for c in columns], names=columns)

    # a hit meets the components of its part, and goes on with those that reach it
    held = components.groupBy(*names).agg(F.collect_list(F.struct("component", "position", "pi", "tau", "places")).alias("_all"))
    reaches = lambda c: F.exists(c["places"], lambda p: F.abs(F.col("pos") - p) <= model.shape[2] // 2)
    floor = (F.col("noise") if "noise" in counts.columns else F.lit(noise)) / (F.col("fit_end") - F.col("fit_start") + 1) / 2
    own = counts.where("sig > 0").select(*names, "chrom", "pos", "strand", floor.alias("_floor"))
    j = own.join(held, names).withColumn("_held", F.filter("_all", reaches)).drop("_all").where(F.size("_held") > 0)
    shares = j.mapInArrow(run, schema)
    reps = hits.groupBy("cond_id", "rep_id", "chrom", "pos", "strand").agg(F.sum("cnt").alias("cnt"))
    j = shares.join(reps, ["cond_id", "chrom", "pos", "strand"])
    return j.groupBy(*names, "component", "rep_id", (F.col("pos") - F.col("at")).cast("int").alias("offset"), "strand").agg(F.sum(F.col("share") * F.col("cnt")).alias("value"))


def model_from_profile(profile: DataFrame, reach: int = 100) -> np.ndarray:
    """A stranded form from a composite (``offset, strand, value``) with a pseudo-count of 1; at most two rows an offset come to the driver."""
    m = np.ones((2, 2 * reach + 1))
    for r in profile.groupBy("offset", "strand").agg(F.sum("value").alias("value")).collect():
        if abs(r["offset"]) <= reach:
            m[int(r["strand"] == "-"), r["offset"] + reach] += r["value"]
    return (m / m.sum())[None]
