"""Leaderboards and reports as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .log import Log
from .numbering import ONE_TASK, numbered


def pair_counts(log: Log) -> DataFrame:
    """(by..., item, pairs): appearances on either side; an item against itself appears twice."""
    return log.pairs.select(*log.by, "n", F.explode(F.array("left", "right")).alias("item")).groupBy(*log.by, "item").agg(F.sum("n").alias("pairs"))


def with_rank(scores: DataFrame, by: Sequence[str] = (), score: str = "score", one_task: int = ONE_TASK) -> DataFrame:
    """`rank`: 1 for the highest; equal scores share the mean of their ranks, cut to a whole number; NaN and null come last.

    Without `by`, more than `one_task` rows (counted) are ranked in sorted ranges.
    """
    known = F.when(~F.isnan(score), F.col(score))
    if not by:
        scores = cut(scores)
        if scores.count() > one_task:
            rows = numbered(scores, {"__lost": known.isNull(), "__down": -known}, (), one_task)
            ties = rows.groupBy(known.alias("__known")).agg(F.floor((F.min("row") + F.max("row")) / 2 + 1).cast("int").alias("rank"))
            return rows.join(ties, known.eqNullSafe(F.col("__known"))).select(*scores.columns, "rank")
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ordered = window.orderBy(known.desc_nulls_last())
    same = Window.partitionBy(*by, known)
    return scores.withColumn("rank", F.floor(F.rank().over(ordered) + (F.count("*").over(same) - 1) / 2).cast("int"))


def leaderboard(log: Log, scores: DataFrame) -> DataFrame:
    """(by..., item, score, pairs, rank)."""
    joined = scores.select(*log.by, "item", "score").join(pair_counts(log), [*log.by, "item"], "left").fillna(0, ["pairs"])
    return with_rank(joined, log.by)


def ends(board: DataFrame, n: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """The first and last n of a leaderboard of different items, each once; equal scores in order of item."""
    if not by:
        board = cut(board)
        both = board.orderBy(F.desc("score"), "item").limit(n).unionAll(board.orderBy("score", F.desc("item")).limit(n))
        return both.dropDuplicates(["item"])
    window = Window.partitionBy(*by)
    best, worst = window.orderBy(F.desc("score"), "item"), window.orderBy("score", F.desc("item"))
    return board.withColumns({"__a": F.row_number().over(best), "__b": F.row_number().over(worst)}).filter((F.col("__a") <= n) | (F.col("__b") <= n)).drop("__a", "__b")


def top(scores: DataFrame, n: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "item").limit(n)


def alpha_report(result: DataFrame, places: int = 6) -> DataFrame:
    """(metric, value) rows of a result of alpha or alpha_bootstrap."""
    names = [c for c in ("alpha", "observed", "expected", "low", "high") if c in result.columns]
    return result.select(*(F.round(F.col(c).cast("double"), places).alias(c) for c in names)).unpivot([], names, "metric", "value")


def histogram(values: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, low, high, n) of the bins that have values, from 1; the greatest value is in the last bin. No values, no rows."""
    span = values.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    number = F.when(F.col("b") == F.col("a"), 1).otherwise(F.least(F.floor(F.try_divide(F.col(column) - F.col("a"), width)).cast("int") + 1, F.lit(bins)))
    binned = values.join(F.broadcast(span)).select(number.alias("bin"), "a", width.alias("w"))
    return binned.filter("bin is not null").groupBy("bin", "a", "w").agg(F.count("*").alias("n")).select("bin", (F.col("a") + (F.col("bin") - 1) * F.col("w")).alias("low"), (F.col("a") + F.col("bin") * F.col("w")).alias("high"), "n")


def median_order(distribution: DataFrame) -> DataFrame:
    """(item, median, low, high, place): items by the median of their resamples, with their 95 % interval, for error bars."""
    p = F.percentile("score", F.array(*map(F.lit, (0.025, 0.5, 0.975))))
    told = distribution.groupBy("item").agg(p.alias("p")).select("item", F.col("p")[1].alias("median"), F.col("p")[0].alias("low"), F.col("p")[2].alias("high"))
    return numbered(told, {"__down": -F.col("median"), "__item": F.col("item")}).select("item", "median", "low", "high", (F.col("row") + 1).cast("int").alias("place"))


def box_frame(distribution: DataFrame) -> DataFrame:
    """(item, least, q1, median, q3, most): a box plot of each item's resamples."""
    p = F.percentile("score", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    told = distribution.groupBy("item").agg(p.alias("p"))
    return told.select("item", *(F.col("p")[k].alias(n) for k, n in enumerate(("least", "q1", "median", "q3", "most"))))


def scatter_frame(a: DataFrame, b: DataFrame) -> DataFrame:
    """(item, x, y): the scores of two methods against each other, for items that have both."""
    return a.select("item", F.col("score").alias("x")).join(b.select("item", F.col("score").alias("y")), "item")
