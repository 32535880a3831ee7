"""Matrices over items, kept as edge lists: win and tie matrix, their combination, win fractions, pairwise scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ScoreShapeError
from ..functions.ieee import divide, nan_to_num
from ..session import cut
from .log import Log, edges, item_index


def win_tie_grid(log: Log, index: DataFrame | None = None) -> DataFrame:
    """(by..., i, j, win, tie) for every pair of items of the index, with zeros: K x K rows by definition of the result."""
    index = item_index(log) if index is None else index
    a, b = index.select(*log.by, F.col("item").alias("i")), index.select(*log.by, F.col("item").alias("j"))
    grid = a.join(b, list(log.by)) if log.by else a.join(b)
    return grid.join(edges(log), [*log.by, "i", "j"], "left").fillna(0.0, ["win", "tie"])


def combined(log: Log, win_weight: float = 1.0, tie_weight: float = 0.5, fill: float = 0.0) -> DataFrame:
    """(by..., i, j, a): win_weight * win + tie_weight * tie."""
    a = F.lit(win_weight) * nan_to_num(F.col("win"), fill) + F.lit(tie_weight) * nan_to_num(F.col("tie"), fill)
    return edges(log).select(*log.by, "i", "j", nan_to_num(a, fill).alias("a"))


def win_fractions(log: Log, win_weight: float = 1.0, tie_weight: float = 0.0) -> DataFrame:
    """(by..., i, j, fraction): what i won of what either won against the other, for pairs with anything to divide."""
    a = cut(combined(log, win_weight, tie_weight))
    back = a.select(*log.by, F.col("i").alias("j"), F.col("j").alias("i"), F.col("a").alias("b"))
    both = a.join(back, [*log.by, "i", "j"], "left")
    return both.select(*log.by, "i", "j", F.try_divide("a", F.col("a") + F.coalesce("b", F.lit(0.0))).alias("fraction")).filter("fraction is not null")


def restrict(matrix: DataFrame, items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and columns of an edge list whose items are in `items`."""
    for side in ("i", "j"):
        matrix = matrix.join(items.select(*by, F.col("item").alias(side)), [*by, side], "left_semi")
    return matrix


def pairwise_scores(scores: DataFrame, by: Sequence[str] = (), item: str = "item", score: str = "score") -> DataFrame:
    """(by..., winner, loser, p): s_i / (s_i + s_j) for every pair of scored items; 0/0 is 0, x/0 the largest double.

    K x K rows by definition of the result. No scores give no rows.
    """
    if {item, score} - {*scores.columns}:
        raise ScoreShapeError(f"scores need {item} and {score}")
    a = scores.select(*by, F.col(item).alias("winner"), F.col(score).cast("double").alias("__a"))
    b = scores.select(*by, F.col(item).alias("loser"), F.col(score).cast("double").alias("__b"))
    pairs = a.join(b, list(by)) if by else a.join(b)
    return pairs.select(*by, "winner", "loser", nan_to_num(divide(F.col("__a"), F.col("__a") + F.col("__b"))).alias("p"))


def pivot_scores(pairs: DataFrame, losers: Sequence[str]) -> DataFrame:
    """One row a winner and a column for each of `losers`, which are given so that no job is needed to find them."""
    return pairs.groupBy("winner").pivot("loser", list(losers)).agg(F.first("p"))
