"""Oversized regions in pieces, cut where there are no hits.

A region is a text whose visible characters are the bases with a hit. Its separators are the
stretches without hits between two hits, in a hierarchy by their length (``LEVELS``, from
sections to words); below the last one a cut may stand at any base. Splitting goes down the
hierarchy only where the level above leaves too much: a piece takes as much as fits, up to
the last separator of the highest level that has one within reach, and the next piece begins
with the last ``overlap`` bases of it.

Where a piece begins depends on where the one before it ends. So that a region as wide as a
chromosome isn't one task, it is taken by tiles: a tile tells, for each place at which its
first piece may begin (as many as the limit), where its last piece leaves off and how many
pieces it makes. These answers are few distinct ones, as pieces from different beginnings soon
end at the same separators. Going through a region's tiles gives each its true beginning, and
then all tiles are split side by side (``tile_starts``, ``pieces``).

Regions with both ends, in either order, take part; a limit that is null or not positive is
``DEFAULT_LIMIT``, a null or negative overlap is 0 and an overlap of a whole piece is one base
less. A region without hits is cut at the limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basewise.operators.intervals import BROADCAST_ROWS, points_in_intervals
from basewise.session import cut_lineage

DEFAULT_LIMIT = 2000
#: name and least length of the separators, from the highest level
LEVELS = (("section", 1000), ("paragraph", 100), ("sentence", 20), ("word", 1))
CUTS = [name for name, _ in LEVELS] + ["base", "end"]
#: separators of this level or a higher one are reported with the piece they end in or follow
REPORTED = dict(LEVELS)["paragraph"]
TILE = 4096
#: least width of the tiles in which regions are split; never less than the limit
SPLIT_TILE = 1 << 16
#: beginnings or pieces that a task works on at once, unless one tile makes more
MADE = 1 << 20


def oversized(regions: DataFrame, runs: DataFrame) -> DataFrame:
    """``region_id, run_id, chrom, rstart, rend, size_limit, overlap`` of the regions wider than the limit of their run.

    ``runs`` has ``run_id, bm_analysis_window_max, piece_overlap``; a region of an unknown run has the defaults.
    """
    r = runs.groupBy(F.col("run_id").alias("_run")).agg(F.max("bm_analysis_window_max").alias("_max"), F.max("piece_overlap").alias("_over"))
    j = regions.join(r, regions["run_id"] == r["_run"], "left")
    limit = F.when(F.col("_max") > 0, F.col("_max")).otherwise(DEFAULT_LIMIT).cast("bigint")
    j = j.withColumn("size_limit", limit).withColumn("overlap", F.least(F.greatest(F.coalesce("_over", F.lit(0)), F.lit(0)).cast("bigint"), limit - 1))
    return j.where(F.col("rend") - F.col("rstart") + 1 > F.col("size_limit")).select("region_id", "run_id", "chrom", "rstart", "rend", "size_limit", "overlap")


def separators(regions: DataFrame, hits: DataFrame, least: int = 1, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``region_id, gap_start, gap_end``: stretches of at least ``least`` bases between two hits of a region.

    ``hits`` has ``run_id, chrom, pos``, repeated or not, and meets the regions by bins. Gaps
    inside a tile of ``TILE`` bases are found tile by tile, those between tiles from the first
    and last hit of each; so no task sorts a whole chromosome-wide region.
    """
    inside = points_in_intervals(hits.select("run_id", "chrom", "pos"), regions.select("region_id", "run_id", "chrom", "rstart", "rend"), ("run_id", "chrom"), limit=broadcast_rows)
    # a base that repeats makes no gap
    p = inside.select("region_id", F.col("pos").cast("bigint").alias("pos")).withColumn("_tile", F.floor(F.col("pos") / TILE))
    tile = Window.partitionBy("region_id", "_tile")
    p = p.withColumn("_prev", F.lag("pos").over(tile.orderBy("pos"))).withColumn("_last", F.max("pos").over(tile))
    region = Window.partitionBy("region_id").orderBy("_tile")
    edges = p.where("_prev is null").withColumn("_prev", F.lag("_last").over(region))
    both = p.where("_prev is not null").select("region_id", "_prev", "pos").unionByName(edges.where("_prev is not null").select("region_id", "_prev", "pos"))
    return both.where(F.col("pos") - F.col("_prev") > least).select("region_id", (F.col("_prev") + 1).alias("gap_start"), (F.col("pos") - 1).alias("gap_end"))


def _tiles(regions: DataFrame) -> DataFrame:
    """``region_id, tile, t0, t1, rstart, rend, size_limit, overlap, entry, n_before``: the tiles of each region; the first piece of tile 0 begins at ``rstart``."""
    wide = F.greatest(F.lit(SPLIT_TILE), "size_limit")
    t = regions.withColumn("_wide", wide).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rend") - F.col("rstart")) / F.col("_wide")))))
    t = t.withColumn("t0", F.col("rstart") + F.col("tile") * F.col("_wide"))
    first = F.col("tile") == 0
    return t.select(
        "region_id", "tile", "t0", F.least(F.col("t0") + F.col("_wide"), F.col("rend") + 1).alias("t1"), "rstart", "rend", "size_limit", "overlap",
        F.when(first, F.col("rstart")).alias("entry"), F.when(first, F.lit(0).cast("bigint")).alias("n_before"),
    )


def _with_gaps(tiles: DataFrame, gaps: DataFrame) -> DataFrame:
    """Each tile followed by the separators that its pieces may meet, in order: rows of one (``region_id, tile``) are together in a partition."""
    head = tiles.withColumn("a", F.lit(-1).cast("bigint")).withColumn("z", F.lit(-1).cast("bigint"))
    of = tiles.select("region_id", "tile", "t0", "t1", "size_limit")
    one = of.groupBy("region_id").agg(F.min("t0").alias("_from"), F.max(F.greatest(F.lit(SPLIT_TILE), "size_limit")).alias("_wide"), F.max("size_limit").alias("_limit"), F.max("tile").alias("_last"))
    g = gaps.join(one, "region_id")
    # a piece that begins in a tile ends less than the limit behind it
    reached = F.floor((F.col("gap_start") - F.col("_limit") - F.col("_from")) / F.col("_wide"))
    upto = F.floor((F.col("gap_end") - F.col("_from")) / F.col("_wide"))
    g = g.select("region_id", F.explode(F.sequence(F.greatest(reached, F.lit(0)), F.least(upto, "_last"))).alias("tile"), F.col("gap_start").alias("a"), F.col("gap_end").alias("z"))
    both = head.unionByName(g, allowMissingColumns=True)
    return both.repartition("region_id", "tile").sortWithinPartitions("region_id", "tile", "a")


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut so that no tile is divided between two."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        heads = np.flatnonzero(b["a"].to_numpy() < 0)
        if len(heads) and (held or heads[-1] > 0):
            done = pd.concat([*held, b.iloc[: heads[-1]]])
            held = []
            if len(done):
                yield done
            b = b.iloc[heads[-1] :]
        held.append(b)
    if held:
        yield pd.concat(held)


def _in_parts(rows: pd.DataFrame, weight: np.ndarray) -> Iterator[pd.DataFrame]:
    """Whole tiles of ``rows`` in parts, so that what each tile (in order) makes adds up to about ``MADE`` at most, or is of one tile."""
    heads = np.flatnonzero(rows["a"].to_numpy() < 0)
    part = np.cumsum(weight) // MADE
    first = heads[np.flatnonzero(np.diff(part, prepend=-1))]
    for a, z in zip(first, [*first[1:], len(rows)]):
        yield rows.iloc[a:z]


class _Separators:
    """The separators of several tiles on one line: each tile has a stretch of its own, so one search serves all."""

    def __init__(self, rows: pd.DataFrame) -> None:
        a, z = rows["a"].to_numpy(np.int64), rows["z"].to_numpy(np.int64)
        is_head = a < 0
        head = rows[is_head]
        self.region, self.tile = head["region_id"].to_numpy(), head["tile"].to_numpy(np.int64)
        self.t0, self.t1, self.rstart, self.rend, self.limit, self.overlap = (head[c].to_numpy(np.int64) for c in ("t0", "t1", "rstart", "rend", "size_limit", "overlap"))
        self.head = head
        span = self.t1 - self.t0 + self.limit + 4
        self.shift = np.cumsum(span) - span - self.t0 + 2  # from a position to its place on the line
        group = np.cumsum(is_head)[~is_head] - 1
        self.group, self.a, self.z = group, a[~is_head], z[~is_head]
        on_line = np.maximum(self.a, self.t0[group] - 1) + self.shift[group]
        width = self.z - self.a + 1
        self.levels = []
        for _, least in LEVELS:
            k = np.flatnonzero(width >= least)
            self.levels.append((on_line[k], self.z[k], group[k]))

    def cut(self, start: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces of the tiles ``of`` that begin at ``start`` end, and the level of the cut: the last separator of the highest level that has one within reach."""
        reach, least = start + self.limit[of] - 1, start + self.overlap[of]
        end, level, open_ = reach.copy(), np.full(len(start), len(LEVELS)), np.ones(len(start), bool)
        for k, (a, z, group) in enumerate(self.levels):
            if not len(a):
                continue
            # a piece may end before the first or at any base of a stretch
            j = np.searchsorted(a, reach + 1 + self.shift[of], "right") - 1
            at = np.minimum(z[j], reach)
            ok = open_ & (j >= 0) & (group[j] == of) & (at >= least)
            end[ok], level[ok] = at[ok], k
            open_ &= ~ok
        return end, level


def _tasks(batches: Iterator[pd.DataFrame], weight: Callable[[pd.DataFrame], pd.Series]) -> Iterator[_Separators]:
    for rows in _whole_groups(batches):
        for part in _in_parts(rows, weight(rows[rows["a"] < 0]).to_numpy()):
            yield _Separators(part)


def _exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``region_id, tile, entry_from, exit, n``: from which beginnings on a tile is left at ``exit`` (null: the region ends) after ``n`` pieces."""
    for s in _tasks(batches, lambda h: np.minimum(h["size_limit"], h["t1"] - h["t0"])):
        count = np.where(s.tile == 0, 1, np.minimum(s.limit, s.t1 - s.t0))
        of = np.repeat(np.arange(len(count)), count)
        entry = s.t0[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        at, n, live = entry.copy(), np.zeros(len(of), np.int64), np.arange(len(of))
        ended = np.zeros(len(of), bool)
        while len(live):
            o = of[live]
            last = at[live] + s.limit[o] - 1 >= s.rend[o]
            ended[live[last]] = True
            n[live] += 1
            live, o = live[~last], o[~last]
            at[live] = s.cut(at[live], o)[0] + 1 - s.overlap[o]
            live = live[at[live] < s.t1[o]]
        at[ended] = -1
        new = np.ones(len(of), bool)
        new[1:] = (np.diff(of) != 0) | (np.diff(at) != 0) | (np.diff(n) != 0)
        k = np.flatnonzero(new)
        yield pd.DataFrame({"region_id": s.region[of[k]], "tile": s.tile[of[k]], "entry_from": entry[k], "exit": at[k], "n": n[k]})


def tile_starts(tiles: DataFrame, gaps: DataFrame) -> DataFrame:
    """``tiles`` with ``entry`` and ``n_before``: where the first piece that begins in a tile does, and how many pieces precede it; null where none begins.

    Regions of one tile need no search. For the others one group holds the answers of a
    region's tiles, a few for each.
    """
    several = tiles.where("tile = 1").select("region_id")
    wide = tiles.join(several, "region_id", "left_semi")
    answers = _with_gaps(wide, gaps.join(several, "region_id", "left_semi")).mapInPandas(_exits, "region_id bigint, tile bigint, entry_from bigint, exit bigint, n bigint")
    bounds = wide.select("region_id", "tile", "t1", "rstart")

    def follow(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(["tile", "entry_from"]), b.sort_values("tile")
        out, at, n = [], int(b["rstart"].iloc[0]), 0
        first = np.searchsorted(a["tile"].to_numpy(), np.append(b["tile"].to_numpy(), b["tile"].iloc[-1] + 1))
        begin, leave, count = (a[c].to_numpy() for c in ("entry_from", "exit", "n"))
        for k, (tile, t1) in enumerate(zip(b["tile"], b["t1"])):
            if at < 0:
                break
            if at >= t1:
                continue
            out.append((b["region_id"].iloc[0], tile, at, n))
            j = first[k] + np.searchsorted(begin[first[k] : first[k + 1]], at, "right") - 1
            at, n = int(leave[j]), n + int(count[j])
        return pd.DataFrame(out, columns=["region_id", "tile", "entry", "n_before"])

    starts = answers.groupBy("region_id").cogroup(bounds.groupBy("region_id")).applyInPandas(follow, "region_id bigint, tile bigint, entry bigint, n_before bigint")
    known = wide.drop("entry", "n_before").join(starts, ["region_id", "tile"], "left")
    return tiles.join(several, "region_id", "left_anti").unionByName(known)


PIECES = "region_id bigint, piece bigint, piece_start bigint, piece_end bigint, cut string, boundaries array<bigint>"


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pieces that begin in each tile, all tiles of a batch step by step together."""
    for s in _tasks(batches, lambda h: (h["t1"] - h["t0"]) / (h["size_limit"] - h["overlap"]) + 1):
        begins = s.head["entry"].notna().to_numpy()
        at, n = (s.head[c].fillna(0).to_numpy(np.int64) for c in ("entry", "n_before"))
        live, found = np.flatnonzero(begins), []
        if not len(live):
            continue
        while len(live):
            last = at[live] + s.limit[live] - 1 >= s.rend[live]
            end, level = s.cut(at[live], live)
            end[last], level[last] = s.rend[live[last]], len(LEVELS) + 1
            found.append((live, n[live].copy(), at[live].copy(), end, level))
            n[live] += 1
            at[live] = end + 1 - s.overlap[live]
            live = live[~last]
            live = live[at[live] < s.t1[live]]
        of, piece, start, end, level = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((piece, of))
        of, piece, start, end, level = (x[order] for x in (of, piece, start, end, level))
        # the last hit before a reported separator lies in the part of one piece that no piece before it has
        own = np.where(piece == 0, start, start + s.overlap[of])
        k = np.flatnonzero(s.z - s.a + 1 >= REPORTED)
        hit = np.maximum(s.a[k] - 1, s.t0[s.group[k]] - 1)
        j = np.searchsorted(end + s.shift[of], hit + s.shift[s.group[k]], "left")
        inside = j < len(of)
        k, hit, j = k[inside], hit[inside], j[inside]
        inside = (of[j] == s.group[k]) & (hit >= own[j]) & (s.a[k] - 1 == hit)
        k, j = k[inside], j[inside]
        boundaries = np.split(s.a[k], np.searchsorted(j, np.arange(1, len(of))))
        yield pd.DataFrame({"region_id": s.region[of], "piece": piece, "piece_start": start, "piece_end": end, "cut": np.array(CUTS, object)[level], "boundaries": boundaries})


def pieces(regions: DataFrame, hits: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``region_id, piece, piece_start, piece_end, cut, boundaries`` of oversized ``regions`` (as from ``oversized``).

    Pieces cover the region in order, none is wider than the limit, and consecutive ones share
    ``overlap`` bases. ``cut`` names the level of the separator at the end of a piece.
    ``boundaries`` are the first bases of the separators of paragraphs and sections that begin
    right behind a base of the piece which no piece before it has: each of a region's once.
    """
    regions = cut_lineage(regions)
    tiles = _tiles(regions)
    gaps = separators(regions, hits, 1, broadcast_rows)
    if not tiles.where("tile = 1").isEmpty():
        gaps = cut_lineage(gaps)  # three steps read them
        tiles = tile_starts(tiles, gaps)
    return _with_gaps(tiles, gaps).mapInPandas(_split, PIECES)
