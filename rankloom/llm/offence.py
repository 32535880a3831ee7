"""One ranking from pairwise comparisons by offence-defence scaling.

W[i, j] counts the comparisons i won against j, a tie as half for each. Offence o[i] = sum_j W[i, j] / d[j] and defence
d[j] = sum_i W[i, j] / o[i] are rescaled in turn (Sinkhorn iterations); the strength of an item is o / d. If a pair's expected wins are
in the proportion of two strengths, W is a symmetric matrix with rows multiplied by the strengths, and scaling returns them whatever
the numbers of comparisons: uneven numbers do not bias the ranking. Smoothing keeps that form: each pair that met gets `share` of its
comparisons as wins for both, so that undefeated and winless items stay finite, and the diagonal a tenth of an item's comparisons, so that the
iteration converges on any graph. Strengths of items that no chain of comparisons links are not comparable.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotConvergedError
from ..operators.skew import balanced_join, label_key
from ..session import cut


def valid_comparisons(log: DataFrame, items: DataFrame, most_sent: int = 200_000) -> DataFrame:
    """(ord, i, j, score) of each comparison once: item ids of left and right, score of the left side 1, 0 or 0.5.

    Dropped: invalid winners, labels not in `items` (letter case and outer blanks aside; null included), an item against itself, null ord.
    Up to `most_sent` items (counted) are sent to every task; more are joined by fragment and replicate, as one label may hold a third of the rows.
    """
    names = items.select(label_key("item").alias("key"), F.col("item_id").cast("bigint").alias("id")).dropDuplicates(["key"])
    outcome = F.lower(F.btrim("winner", F.lit(" \t")))
    score = F.when(outcome == "left", 2).when(outcome == "right", 0).when(outcome == "tie", 1)
    rows = log.select("ord", label_key("left").alias("l"), label_key("right").alias("r"), score.alias("s")).filter("s is not null and ord is not null and l <> r")
    few = names.limit(most_sent + 1).count() <= most_sent
    for side, number in (("l", "i"), ("r", "j")):
        of = names.select(F.col("key").alias(side), F.col("id").alias(number))
        rows = rows.join(F.broadcast(of), side) if few else balanced_join(cut(rows), of, [side], "inner")
    known = rows
    return known.select("ord", "i", "j", "s").dropDuplicates(["ord"]).select("ord", "i", "j", (F.col("s") / 2).alias("score"))


def win_edges(comparisons: DataFrame) -> DataFrame:
    """(i, j, w, n): of each pair that met, in both directions, the comparisons i won against j, ties as halves, and all; combined map-side."""
    half = comparisons.groupBy("i", "j").agg(F.sum("score").alias("w"), F.count("*").alias("n"))
    both = half.select(F.inline(F.array(F.struct("i", "j", "w", "n"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("n") - F.col("w")).alias("w"), "n"))))
    return both.groupBy("i", "j").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))


def smoothed(edges: DataFrame, share: float) -> DataFrame:
    """(i, j, w) of the smoothed matrix with its diagonal."""
    own = edges.groupBy("i").agg((F.sum("n") * F.lit(DIAGONAL)).alias("w")).select("i", F.col("i").alias("j"), "w")
    return edges.select("i", "j", (F.col("w") + F.lit(share) * F.col("n")).alias("w")).unionByName(own)


#: share of an item's comparisons on the diagonal
DIAGONAL = 0.1


def _newton(i: np.ndarray, p: np.ndarray, j: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The Newton step in the logarithms of 1 / offence for a matrix with column sums 1, by conjugate gradients (the step is free up to a shift a component)."""
    x, residual = np.zeros(k), 1 - rows
    scale = 1 / np.where(rows > 0, rows, 1.0)
    z = residual * scale
    direction, rho = z.copy(), residual @ z
    for _ in range(4 * k + 50):
        if np.abs(residual).max() < 1e-14:
            break
        image = rows * direction - np.bincount(i, p * np.bincount(j, p * direction[i], k)[j], k)
        bend = direction @ image
        if bend <= 0:
            break
        x += rho / bend * direction
        residual = residual - rho / bend * image
        z = residual * scale
        rho, before = residual @ z, rho
        direction = z + rho / before * direction
    return x


def scale_edges(i: np.ndarray, j: np.ndarray, w: np.ndarray, k: int, tolerance: float, limit: int, newton_every: int = 50) -> tuple[np.ndarray, np.ndarray, int]:
    """Offence and defence of items 0..k-1 of a smoothed matrix, and the number of iterations; 1 and 1 for an item without entries.

    Done when every row and column of the scaled matrix adds up to 1 within `tolerance`; NotConvergedError after `limit` iterations. Long chains of
    items that met their neighbours only converge in as many steps as the square of their length, so one step in `newton_every` is a Newton step
    towards the same fixed point.
    """
    o, d, step = np.ones(k), np.ones(k), 0
    known = np.bincount(i, minlength=k) > 0

    def columns(o: np.ndarray) -> tuple[np.ndarray, float]:
        d = np.where(known, np.bincount(j, w / o[i], k), 1.0)
        return d, float(np.log(d[known]).sum() + np.log(o[known]).sum())

    while known.any():
        step += 1
        d, height = columns(o)
        rows = np.where(known, np.bincount(i, w / d[j], k) / o, 1.0)
        if np.abs(rows - 1).max() < tolerance:
            break
        if step >= limit:
            raise NotConvergedError(f"offence and defence did not reach {tolerance} in {limit} iterations")
        if step % newton_every:
            o = o * rows
            continue
        move, length = _newton(i, w / (o[i] * d[j]), j, rows, k), 1.0
        slope = float((rows - 1) @ move)
        while length > 1e-6:
            tried = o * np.exp(np.clip(-length * move, -50, 50))
            if columns(tried)[1] <= height + 1e-4 * length * slope:
                o = tried
                break
            length /= 2
        else:
            o = o * rows
    level = np.exp(np.log(o / d)[known].mean() / 2) if known.any() else 1.0
    return np.where(known, o / level, 1.0), np.where(known, d * level, 1.0), step


def strengths(edges: DataFrame, items: DataFrame, share: float = 0.01, tolerance: float = 1e-11, limit: int = 5000, local_edges: int = 2_000_000) -> DataFrame:
    """(id, offence, defence, strength): one row for each id of `items`; the strengths of items with comparisons have geometric mean 1.

    The edges are counted; up to `local_edges` are scaled in one task (24 bytes each and a few vectors), more by joins and
    group-bys over all of them, with a checkpoint an iteration. Either way raises NotConvergedError rather than give strengths that have not come to
    rest. An item without comparisons has strength 1; no items, no rows.
    """
    edges = cut(edges)
    ids = items.select(F.col("item_id").cast("bigint").alias("id")).filter("id is not null").distinct()
    matrix = smoothed(edges, share)
    if edges.count() > local_edges:
        return scale_distributed(cut(matrix), ids, tolerance, limit)
    rows = matrix.unionByName(ids.select(F.col("id").alias("i"), F.lit(None).cast("bigint").alias("j"), F.lit(0.0).alias("w"))).withColumn("all", F.lit(1))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        known = np.sort(pdf.loc[pdf["j"].isna(), "i"].to_numpy(np.int64))
        e = pdf[pdf["j"].notna()].sort_values(["i", "j"])
        a, b = np.searchsorted(known, e["i"].to_numpy(np.int64)), np.searchsorted(known, e["j"].to_numpy(np.int64))
        o, d, _ = scale_edges(a, b, e["w"].to_numpy(), len(known), tolerance, limit)
        return pd.DataFrame({"id": known, "offence": o, "defence": d, "strength": o / d})

    return rows.groupBy("all").applyInPandas(solve, "id bigint, offence double, defence double, strength double")


def scale_distributed(matrix: DataFrame, ids: DataFrame, tolerance: float, limit: int) -> DataFrame:
    """The same iteration with the matrix left in place: each half step is a join and a map-side combined group-by.

    NotConvergedError after `limit` iterations, as with long chains of items that met their neighbours only.
    """
    one = F.lit(1.0)
    state, done = cut(ids.withColumn("o", one)), False
    for _ in range(limit):
        met = matrix.join(state.select(F.col("id").alias("i"), "o"), "i").groupBy(F.col("j").alias("id")).agg(F.sum(F.col("w") / F.col("o")).alias("d"))
        out = cut(state.join(met, "id", "left").select("id", "o", F.coalesce("d", one).alias("d"), F.col("d").isNotNull().alias("known")))
        own = matrix.join(out.select(F.col("id").alias("j"), "d"), "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("w") / F.col("d")).alias("n"))
        new = cut(out.join(own, "id", "left").withColumn("n", F.coalesce("n", one)))
        change, mean = new.agg(F.max(F.when(F.col("known"), F.abs(F.col("n") / F.col("o") - 1))), F.avg(F.when(F.col("known"), F.ln(F.col("o") / F.col("d"))))).first()
        if done := (change or 0.0) < tolerance:
            break
        state = new.select("id", F.col("n").alias("o"))
    if not done:
        raise NotConvergedError(f"offence and defence did not reach {tolerance} in {limit} iterations")
    level = F.when(F.col("known"), F.lit(float(np.exp((mean or 0.0) / 2)))).otherwise(one)
    return new.select("id", (F.col("o") / level).alias("offence"), (F.col("d") * level).alias("defence"), (F.col("o") / F.col("d") / level / level).alias("strength"))


def ranking(log: DataFrame, items: DataFrame, **options: float) -> DataFrame:
    """(item, offence, defence, strength) of all items of `items`."""
    scaled = strengths(win_edges(valid_comparisons(log, items)), items, **options)
    return scaled.join(items.select(F.col("item_id").cast("bigint").alias("id"), "item").dropDuplicates(["id"]), "id").select("item", "offence", "defence", "strength")
