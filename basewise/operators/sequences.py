"""Short nucleotide sequences: composition, weight matrices and scans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewise.operators.intervals import small_side
from basewise.operators.ordered import running_totals
from basewise.operators.profiles import rank_percentile
from basewise.session import cut_lineage

BASES = "ACGT"


def reverse_complement(s: Column) -> Column:
    """Case is kept; letters other than ACGT stay as they are."""
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def repeat_fraction(s: Column) -> Column:
    """Share of lower-case letters and N; null for an empty sequence."""
    return (F.length(s) - F.length(F.regexp_replace(s, "[a-zN]", ""))) / F.nullif(F.length(s), F.lit(0))


def base_index(b: Column) -> Column:
    """0 to 3 for A, C, G, T in either case, else -1."""
    return F.instr(F.lit(BASES), F.upper(b)) - 1


def letters(sequences: DataFrame, keys: Sequence[str], sequence: str = "sequence") -> DataFrame:
    """``keys, position, base``: one row for each letter, positions from 0, bases in upper case."""
    return sequences.where(F.length(sequence) > 0).select(*keys, F.posexplode(F.split(F.upper(sequence), "")).alias("position", "base"))


def frequency_matrix(sequences: DataFrame, sequence: str = "sequence") -> DataFrame:
    """``position, a, c, g, t``: counts of each base at every position of aligned sequences; other letters count for none."""
    count = lambda b: F.count_if(F.col("base") == b.upper()).alias(b)
    return letters(sequences, [], sequence).groupBy("position").agg(*[count(b) for b in "acgt"])


def information(matrix: DataFrame, pseudo: float = 0.0) -> DataFrame:
    """``position, bits`` against equal bases; a base that never occurs adds nothing."""
    n = sum((F.col(b) + pseudo for b in "acgt"), F.lit(0.0))
    bits = F.lit(0.0)
    for b in "acgt":
        f = F.try_divide(F.col(b) + pseudo, n)
        bits = bits + F.coalesce(f * F.log2(F.nullif(f, F.lit(0.0)) / 0.25), F.lit(0.0))
    return matrix.select("position", bits.alias("bits"))


def consensus(matrix: DataFrame) -> DataFrame:
    """``consensus``: the commonest base of each position, the first of ACGT among equals."""
    top = F.greatest(*[F.col(b) for b in "acgt"])
    base = F.coalesce(*[F.when(F.col(b) == top, b.upper()) for b in "acgt"])
    each = F.array_sort(F.collect_list(F.struct("position", base.alias("base"))))
    return matrix.agg(F.concat_ws("", F.transform(each, lambda x: x["base"])).alias("consensus"))


def motif_weights(sequences: DataFrame, pseudo: float = 0.01, sequence: str = "sequence") -> DataFrame:
    """``motif, weights``: for each length of ``sequences`` the log2 odds of the sequences of that length, aligned: for each position the least, then A, C, G, T."""
    l = letters(sequences.withColumn("motif", F.length(sequence)), ["motif"], sequence)
    count = lambda b: F.count_if(F.col("base") == b).cast("double") + pseudo
    m = l.groupBy("motif", "position").agg(*[count(b).alias(b) for b in BASES])
    n = sum((F.col(b) for b in BASES), F.lit(0.0))
    odds = [F.log2(F.col(b) / n / 0.25) for b in BASES]
    m = m.select("motif", "position", F.array(F.least(*odds), *odds).alias("w"))
    return m.groupBy("motif").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "w"))), lambda x: x["w"]).alias("weights"))


def best_match(sequences: DataFrame, motifs: DataFrame, sequence: str = "sequence", both: bool = False) -> DataFrame:
    """``sequences`` with ``motif, score, start, strand, kmer``: the best place of each of ``motifs`` (as ``motif_weights``) that fits, on either strand.

    Letters other than ACGT score the position's least. Ties go to the smaller start, then to
    the plus strand; minus k-mers are reverse complements. A motif longer than a sequence has
    no row. The matrices, one a length, are joined by their length. With ``both``, ``plus`` and
    ``minus`` are the best scores of each strand.
    """
    lengths = motifs.agg(F.min("motif").alias("_least"), F.max("motif").alias("_most"))
    fits = sequences.join(F.broadcast(lengths), F.length(sequence) >= F.col("_least"))  # one row
    fits = fits.withColumn("motif", F.explode(F.sequence("_least", F.least(F.length(sequence), "_most")))).drop("_least", "_most")
    j = fits.join(small_side(motifs), "motif")
    table, w, n = F.col("weights"), F.col("motif"), F.length(sequence)
    code = F.transform(F.split(F.upper(sequence), ""), lambda b: F.instr(F.lit(BASES), b))
    # complement of the code: 0 stays, 1..4 mirrored
    back = F.transform(F.reverse(code), lambda c: F.when(c == 0, 0).otherwise(5 - c))

    def scores(c: Column, strand: str) -> Column:
        one = lambda z: F.aggregate(F.zip_with(table, F.slice(c, z + 1, w), lambda t, x: F.get(t, x)), F.lit(0.0), lambda s, x: s + x)
        start = lambda z: z if strand == "+" else n - w - z
        return F.transform(F.sequence(F.lit(0), n - w), lambda z: F.struct((-F.round(one(z), 9)).alias("neg"), start(z).alias("start"), F.lit(strand).alias("strand")))

    d = j.withColumn("_plus", F.array_min(scores(code, "+"))).withColumn("_minus", F.array_min(scores(back, "-")))
    d = d.withColumn("_b", F.least("_plus", "_minus"))
    kmer = F.substr(F.col(sequence), F.col("_b.start") + 1, w)
    return d.select(
        *sequences.columns, "motif", (-F.col("_b.neg")).alias("score"), F.col("_b.start").alias("start"), F.col("_b.strand").alias("strand"),
        F.when(F.col("_b.strand") == "-", reverse_complement(kmer)).otherwise(kmer).alias("kmer"),
        *([(-F.col(f"_{x}.neg")).alias(x) for x in ("plus", "minus")] if both else []),
    )


def motif_frequencies(sequences: DataFrame, pseudo: float = 0.01, sequence: str = "sequence") -> DataFrame:
    """``motif, position, f``: for each length of ``sequences`` the shares of A, C, G and T at each position of those of that length."""
    l = letters(sequences.withColumn("motif", F.length(sequence)), ["motif"], sequence)
    m = l.groupBy("motif", "position").agg(*[(F.count_if(F.col("base") == b).cast("double") + pseudo).alias(b) for b in BASES])
    n = sum((F.col(b) for b in BASES), F.lit(0.0))
    return m.select("motif", "position", F.array(*[F.col(b) / n for b in BASES]).alias("f"))


def column_correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two columns of a matrix (arrays of 4); 0 where either is flat."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / 4
    part = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: (u - mean(x)) * (v - mean(y))), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(part(a, b), F.sqrt(part(a, a) * part(b, b))), F.lit(0.0))


def align_motifs(motifs: DataFrame) -> DataFrame:
    """``motif, offset, reverse, score``: each motif (``motif, position, f``) against the shortest one, without gaps.

    The score is the sum of column correlations over the whole shortest motif at its best place
    in the other one, the first such, as given or as reverse complement (only if better).
    ``offset`` is from middle to middle: the place less half of the difference in length,
    which for a reversed motif of even length is one more.
    """
    lengths = motifs.groupBy("motif").agg((F.max("position") + 1).alias("n"))
    reference = lengths.agg(F.min("motif").alias("_r"), F.min("n").alias("_m"))
    r = motifs.join(F.broadcast(reference), F.col("motif") == F.col("_r")).select(F.col("position").alias("_at"), F.col("f").alias("_f"), "_m")
    t = motifs.join(lengths, "motif")
    back = t.select("motif", "n", (F.col("n") - 1 - F.col("position")).alias("position"), F.reverse("f").alias("f"), F.lit(True).alias("reverse"))
    t = t.select("motif", "n", "position", "f", F.lit(False).alias("reverse")).unionByName(back)
    places = lengths.join(F.broadcast(reference.select("_m"))).select("motif", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("_m"))).alias("place"))
    j = places.join(t, "motif").withColumn("_at", F.col("position") - F.col("place")).join(F.broadcast(r), "_at")
    scores = j.groupBy("motif", "n", "_m", "reverse", "place").agg(F.round(F.sum(column_correlation(F.col("_f"), F.col("f"))), 9).alias("score"))
    best = scores.groupBy("motif").agg(F.max(F.struct("score", (~F.col("reverse")).alias("forward"), (-F.col("place")).alias("before"), "n", "_m")).alias("b"))
    apart = F.floor((F.col("b.n") - F.col("b._m")) / 2)
    even = ~F.col("b.forward") & (F.col("b.n") % 2 == 0) & (F.col("b._m") % 2 == 0)
    return best.select("motif", (-F.col("b.before") - apart - F.when(even, 1).otherwise(0)).cast("int").alias("offset"), (~F.col("b.forward")).alias("reverse"), F.col("b.score").alias("score"))


def markov_model(sequences: DataFrame, order: int = 1, sequence: str = "sequence") -> DataFrame:
    """``context, base, p``: probability of each base after the ``order`` bases before it, from counts of k-mers of ACGT."""
    k = order + 1
    s = F.upper(sequence)
    mers = sequences.where(F.length(sequence) >= k).select(F.explode(F.transform(F.sequence(F.lit(1), F.length(sequence) - order), lambda i: F.substr(s, i, F.lit(k)))).alias("mer"))
    n = mers.where(F.col("mer").rlike("^[ACGT]+$")).groupBy("mer").agg(F.count("*").alias("n"))
    n = n.select(F.substring("mer", 1, order).alias("context"), F.substring("mer", k, 1).alias("base"), "n")
    return n.select("context", "base", (F.col("n") / F.sum("n").over(Window.partitionBy("context"))).alias("p"))


def random_sequences(ids: DataFrame, model: DataFrame, length: int, seed: int = 1000, id_column: str = "id") -> DataFrame:
    """``id, sequence``: for each id a sequence of ``length`` bases from a first-order model. A sequence depends on seed and id only."""
    p = np.full((4, 4), 0.0)
    for r in model.collect():  # 16 rows
        p[BASES.index(r["context"]), BASES.index(r["base"])] = r["p"]
    p[p.sum(axis=1) == 0] = 0.25
    cum = np.cumsum(p / p.sum(axis=1, keepdims=True), axis=1)
    alphabet = np.array(list(BASES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            u = np.array([np.random.default_rng([seed, int(i)]).random(length) for i in b[id_column]]).reshape(-1, length)
            state = np.minimum((u[:, 0] * 4).astype(int), 3) if length else None
            out = np.empty((len(b), length), int)
            for k in range(length):
                if k:
                    state = np.minimum((u[:, [k]] > cum[state]).sum(axis=1), 3)
                out[:, k] = state
            yield pd.DataFrame({id_column: b[id_column], "sequence": ["".join(alphabet[r]) for r in out]})

    return ids.select(id_column).mapInPandas(run, f"{id_column} bigint, sequence string")


def fit_motif(sequences: DataFrame, width: int = 10, iterations: int = 100, epsilon: float = 0.01, seed_word: str | None = None, sequence: str = "sequence", occupied: float | None = None) -> tuple[list[list[float]], int]:
    """A motif that occurs once in each sequence, by expectation maximisation: probabilities by position, and the rounds taken.

    With ``occupied`` it may also be absent: that is the share of sequences that have it at
    first, which each round sets anew; absence is as likely as equal bases.

    Each round is one pass: partitions sum expected counts under the current matrix and only
    ``width`` times 4 numbers a partition come back. Ends when no probability moves by
    ``epsilon`` or more.
    """
    first = seed_word or sequences.where(F.length(sequence) >= width).agg(F.min(F.upper(F.substring(sequence, 1, width)))).first()[0]
    if first is None:
        return [[0.25] * 4 for _ in range(width)], 0
    p = np.full((width, 4), 0.5 / 3)
    for k, b in enumerate(first):
        p[k] = [0.5 if b == x else 0.5 / 3 for x in BASES] if b in BASES else 0.25
    kept = sequences.where(F.length(sequence) >= width).select(F.upper(sequence).alias("s"))
    for turn in range(1, iterations + 1):
        table = np.log(np.column_stack([p, np.full(width, 0.25)]))

        def run(batches: Iterator[pd.DataFrame], table=table, occupied=occupied) -> Iterator[pd.DataFrame]:
            total, held = np.zeros((width, 5)), np.zeros(2)
            place = np.arange(width)
            lookup = np.full(128, 4)
            for i, b in enumerate(BASES):
                lookup[ord(b)] = i
            for batch in batches:
                longest = int(batch["s"].str.len().max()) if len(batch) else 0
                step = max(4_000_000 // max(longest * width, 1), 1)
                for lo in range(0, len(batch), step):
                    part = batch["s"].iloc[lo : lo + step]
                    n = part.str.len().to_numpy()
                    # letters behind the end of a sequence are spaces, and no window reaches over it
                    text = np.frombuffer("".join(part.str.ljust(longest)).encode("ascii", "replace"), np.uint8).reshape(len(part), longest)
                    windows = np.lib.stride_tricks.sliding_window_view(lookup[np.minimum(text, 127)], width, axis=1)
                    ll = table[place, windows].sum(axis=2)
                    ll[np.arange(ll.shape[1]) > (n - width)[:, None]] = -np.inf
                    if occupied is None:
                        z = np.exp(ll - ll.max(axis=1, keepdims=True))
                        z /= z.sum(axis=1, keepdims=True)
                    else:
                        z = np.exp(ll - width * np.log(0.25)) * (occupied / (n - width + 1))[:, None]
                        z /= 1 - occupied + z.sum(axis=1, keepdims=True)
                    held += [z.sum(), len(z)]
                    for k in range(width):
                        total[k] += np.bincount(windows[:, :, k].ravel(), z.ravel(), 5)
            # behind the positions one more: sequences that have the motif, and all
            yield pd.DataFrame({"k": np.r_[np.repeat(place, 4), width, width], "b": np.r_[np.tile(np.arange(4), width), 0, 1], "n": np.r_[total[:, :4].ravel(), held]})

        sums = kept.mapInPandas(run, "k int, b int, n double").groupBy("k", "b").agg(F.sum("n").alias("n")).collect()
        new = np.full((width + 1, 4), 0.01)
        for r in sums:
            new[r["k"], r["b"]] += r["n"]
        if occupied is not None:
            occupied = min(new[width, 0] / new[width, 1], 0.99)
        new = new[:width]
        new /= new.sum(axis=1, keepdims=True)
        moved = np.abs(new - p).max()
        p = new
        if moved < epsilon:
            break
    return p.tolist(), turn


def roc_curve(rows: DataFrame, keys: Sequence[str], score: str, positive: Column) -> DataFrame:
    """``keys, score, true_positives, false_positives``: running counts at each distinct score, the largest first, taken by ranges of the score."""
    c = rows.groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    c = running_totals(c, keys, [F.desc("score")], {"true_positives": F.col("_p"), "false_positives": F.col("_n")})
    return c.select(*keys, "score", "true_positives", "false_positives")


def roc_auc(rows: DataFrame, keys: Sequence[str], score: str, positive: Column) -> DataFrame:
    """``keys, positives, negatives, auc``: the area under the curve over descending ``score``; 0 without positives, 1 without negatives.

    Rows are counted by distinct score first; equal scores share their area, so their order doesn't matter.
    """
    c = rows.groupBy(*keys, F.col(score).alias("_s")).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    c = running_totals(c, keys, [F.desc("_s")], {"_upto": F.col("_p")})
    half = F.col("_upto") - F.col("_p") / 2
    a = c.groupBy(*keys).agg(F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"), F.sum(F.col("_n") * half).alias("_a"))
    area = F.when(F.col("positives") == 0, 0.0).when(F.col("negatives") == 0, 1.0).otherwise(F.try_divide(F.col("_a"), F.col("positives").cast("double") * F.col("negatives")))
    return a.select(*keys, "positives", "negatives", area.alias("auc"))


def common_core(sequences: DataFrame, length: int = 6, sequence: str = "sequence") -> str | None:
    """The word of ``length`` bases that most sequences have, the first in order among equals."""
    s = F.upper(sequence)
    words = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(sequence) - length + 1), lambda i: F.substr(s, i, F.lit(length))))
    w = sequences.where(F.length(sequence) >= length).select(F.explode(words).alias("word")).where(F.col("word").rlike("^[ACGT]+$"))
    top = w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").first()
    return top and top["word"]


def discover_motifs(
    sequences: DataFrame, id_column: str = "line_id", width: int = 10, least_auc: float = 0.7, found_share: float = 0.05, removed_share: float = 0.1, least: int = 25, repeats: float = 0.2, sequence: str = "sequence"
) -> list[dict]:
    """Motifs tried one after the other: ``p`` (probabilities by position), ``auc``, ``references``, ``removed``, ``kept``.

    Each round fits a motif that sequences may or may not have on the low-repeat sequences left,
    beginning with their ``common_core`` in its middle, and scores all that are left, and random ones of the same lengths from their Markov model. A motif is kept if its area under
    the curve is at least ``least_auc`` and more than ``least`` sequences (its references) score
    over all but ``found_share`` of the random ones; sequences over all but ``removed_share``
    leave. Ends with the first motif that isn't kept, which is the last one told, or with fewer
    than ``least`` left.
    Sequences shorter than ``width``, or null, take no part. What a round leaves is written once.
    """
    left = cut_lineage(sequences.where(F.length(sequence) >= width).select(F.col(id_column).alias("id"), F.col(sequence).alias("sequence")))
    n, longest = left.agg(F.count("*"), F.max(F.length("sequence"))).first()
    if n < least:
        return []
    lengths = left.groupBy("id").agg(F.max(F.length("sequence")).alias("_n"))
    random = random_sequences(lengths, markov_model(left), longest).join(lengths, "id").select(F.substr("sequence", F.lit(1), F.col("_n")).alias("sequence"))
    random = cut_lineage(random)
    out = []
    while n >= least:
        fitted = left.where(repeat_fraction(F.col("sequence")) <= repeats)
        core = common_core(fitted, min(6, width))
        p, _ = fit_motif(fitted, width, seed_word=core and core.center(width, "N"), occupied=0.5)
        odds = np.log2(np.array(p) / 0.25)
        motif = left.sparkSession.createDataFrame([(width, np.column_stack([odds.min(axis=1), odds]).tolist())], "motif int, weights array<array<double>>")
        own = cut_lineage(best_match(left, motif).select("id", "sequence", "motif", "score"))
        other = cut_lineage(best_match(random, motif).select("motif", "score"))
        both = own.select("motif", "score", F.lit(True).alias("own")).unionByName(other.withColumn("own", F.lit(False)))
        auc = roc_auc(both, ["motif"], "score", F.col("own")).first()["auc"]
        bounds = [rank_percentile(other, ["motif"], "score", 1 - share).first()["value"] for share in (found_share, removed_share)]
        references, removed = own.agg(F.count_if(F.col("score") >= bounds[0]), F.count_if(F.col("score") >= bounds[1])).first()
        kept = auc >= least_auc and references > least
        out.append({"p": p, "auc": auc, "references": references, "removed": removed if kept else 0, "kept": kept})
        if not kept:
            break
        left, n = own.where(F.col("score") < bounds[1]).select("id", "sequence"), n - removed
    return out
