"""The seven ranking operators. Each takes a Log and gives (by..., item, score, ...) with every item of the index.

Counting and average win rate are plain aggregations of the log's pairs. The iterative ones work on the pairs too, in one task for each
leaderboard of up to `max_edges` of them, and over all executors (`distributed`) for larger ones. Elo is a fold in the order of the
log: rows are shuffled by leaderboard, sorted (spilling as needed) and streamed past the ratings in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import MissingColumnError
from ..functions.ieee import nan_mean, nan_to_num
from ..session import cut
from . import distributed, kernels
from .log import DRAW, LEFT, RIGHT, Log, first_places
from .matrices import combined

MAX_EDGES = 5_000_000


def counting(log: Log, index: DataFrame | None = None, win_weight: float = 1.0, tie_weight: float = 0.5, **_: object) -> DataFrame:
    """(by..., item, score): weighted number of wins, and of ties for both sides; 0 for an item of the index that is not in the log."""
    if log.df.isStreaming:
        w = F.col("weight")
        points = lambda side: F.when(F.col("winner") == side, w * win_weight).when(F.col("winner") == DRAW, w * tie_weight).otherwise(0.0)
        source, left, right = log.df, points(LEFT), points(RIGHT)
    else:
        tie = F.col("t") * tie_weight
        source, left, right = log.pairs, F.col("l") * win_weight + tie, F.col("r") * win_weight + tie
    sides = source.select(*log.by, F.inline(F.array(F.struct(F.col("left").alias("item"), left.alias("s")), F.struct(F.col("right").alias("item"), right.alias("s")))))
    return _on_index(log, sides.groupBy(*log.by, "item").agg(nan_to_num(F.sum("s")).alias("score")), index)


def _on_index(log: Log, scored: DataFrame, index: DataFrame | None) -> DataFrame:
    if index is None:
        return scored
    return index.select(*log.by, "item").join(scored, [*log.by, "item"], "left").fillna(0.0, ["score"])


def average_win_rate(log: Log, index: DataFrame | None = None, win_weight: float = 1.0, tie_weight: float = 0.5, **_: object) -> DataFrame:
    """(by..., item, score): mean over opponents of the share of points won against each; 0 without opponents, an item against itself counts a half."""
    a = cut(combined(log, win_weight, tie_weight))
    back = a.select(*log.by, F.col("i").alias("j"), F.col("j").alias("i"), F.col("a").alias("b"))
    rate = a.join(back, [*log.by, "i", "j"], "left").select(*log.by, F.col("i").alias("item"), F.try_divide("a", F.col("a") + F.coalesce("b", F.lit(0.0))).alias("r"))
    return _on_index(log, rate.groupBy(*log.by, "item").agg(nan_mean(F.col("r")).alias("score")), index)


def read_edges(pdf: pd.DataFrame) -> tuple[pd.Series, kernels.Edges]:
    """The items in order of k, and the edges numbered by them. Rows without j are the items; a pair of labels has one row with both directions."""
    items = pdf[pdf["j"].isna()].sort_values(["side", "at", "i"], kind="stable")["i"].reset_index(drop=True)
    e = pdf[pdf["j"].notna()]
    number = pd.Series(np.arange(len(items)), index=items)
    i, j = number.reindex(e["i"]).to_numpy(np.int64), number.reindex(e["j"]).to_numpy(np.int64)
    both = lambda a, b: np.concatenate([e[a].to_numpy(), e[b].to_numpy()])
    return items, kernels.symmetric(len(items), np.concatenate([i, j]), np.concatenate([j, i]), both("l", "r"), both("t", "t"))


def solve(log: Log, index: DataFrame | None, kernel: Callable[[kernels.Edges], tuple[np.ndarray, float, int]], beyond: Callable[[Log, DataFrame | None], DataFrame], max_edges: int = MAX_EDGES) -> DataFrame:
    """(by..., item, score, v, iterations) of a kernel run once for each leaderboard.

    The pairs of each leaderboard are counted first. Leaderboards of up to `max_edges` pairs are solved in a task each, the others (there are fewer of them
    than pairs / `max_edges`) one after the other by `beyond`, over all executors.
    """
    keys = list(log.by)
    sizes = log.pairs.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > max_edges) if keys else log.pairs.agg(F.count("*").alias("__n")).filter(F.col("__n") > max_edges)
    large = sizes.collect()
    if large and not keys:
        return _shaped(beyond(log, index), [])
    is_large = F.lit(False)
    for row in large:
        is_large = is_large | _is(row, keys)
    pairs = log.pairs.filter(~is_large)
    if index is None:
        order = (F.col("first.side"), F.col("first.at").cast("string" if not log.ordered else log.df.schema["ord"].dataType))
        items = first_places(log).filter(~is_large).select(*keys, F.col("item").alias("i"), order[0].alias("side"), order[1].alias("at"))
        if not log.ordered:
            items = items.withColumns({"side": F.lit(0), "at": F.lit("0")})
    else:
        items = index.filter(~is_large).select(*keys, F.col("item").alias("i"), F.lit(0).alias("side"), F.col("k").cast("bigint").alias("at"))
    numbers = pairs.select(*keys, F.col("left").alias("i"), F.col("right").alias("j"), "l", "r", "t")
    rows = numbers.unionByName(items, allowMissingColumns=True)
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items, e = read_edges(pdf)
        score, v, iterations = kernel(e)
        out = {c: pdf[c].iloc[0] for c in keys}
        return pd.DataFrame({**{c: [x] * len(items) for c, x in out.items()}, "item": items, "score": score, "v": float(v), "iterations": int(iterations)})

    grouped = rows.groupBy(*keys) if keys else rows.withColumn("__all", F.lit(0)).groupBy("__all")
    found = grouped.applyInPandas(run, f"{kinds}item string, score double, v double, iterations int")
    for row in large:
        one = Log(log.df.filter(_is(row, keys)).drop(*keys), (), log.ordered)
        own = None if index is None else index.filter(_is(row, keys)).drop(*keys)
        found = found.unionByName(_shaped(beyond(one, own).withColumns({c: F.lit(row[c]).cast(log.df.schema[c].dataType) for c in keys}), keys))
    return found


def _is(row: Row, keys: list[str]) -> Column:
    out = F.lit(True)
    for c in keys:
        out = out & F.col(f"`{c}`").eqNullSafe(F.lit(row[c]))
    return out


def _shaped(scores: DataFrame, keys: list[str]) -> DataFrame:
    v = F.col("v") if "v" in scores.columns else F.lit(math.nan)
    return scores.select(*keys, "item", "score", v.alias("v"), F.col("iterations").cast("int").alias("iterations"))


def bradley_terry(log: Log, index: DataFrame | None = None, win_weight: float = 1.0, tie_weight: float = 0.5, tolerance: float = 1e-6, limit: int = 100, max_edges: int = MAX_EDGES, **_: object) -> DataFrame:
    """(by..., item, score, iterations): strengths with geometric mean 1. An undefeated or winless item degenerates to `tolerance`, as do all then."""

    def kernel(e: kernels.Edges) -> tuple[np.ndarray, float, int]:
        p, n = kernels.bradley_terry(e, win_weight, tie_weight, tolerance, limit)
        return p, math.nan, n

    return solve(log, index, kernel, lambda one, own: distributed.bradley_terry(one, own, win_weight, tie_weight, tolerance, max(limit, 500)), max_edges).drop("v")


def newman(log: Log, index: DataFrame | None = None, v_init: float = 0.5, win_weight: float = 1.0, tie_weight: float = 1.0, tolerance: float = 1e-6, limit: int = 100, max_edges: int = MAX_EDGES, **_: object) -> DataFrame:
    """(by..., item, score, v, iterations): strengths with a draw parameter v, the one the last step used."""
    return solve(log, index, lambda e: kernels.newman(e, win_weight, tie_weight, tolerance, limit, v_init), lambda one, own: distributed.newman(one, own, v_init, win_weight, tie_weight, tolerance, limit), max_edges)


def eigen(log: Log, index: DataFrame | None = None, win_weight: float = 1.0, tie_weight: float = 0.5, tolerance: float = 1e-6, limit: int = 100, max_edges: int = MAX_EDGES, **_: object) -> DataFrame:
    """(by..., item, score, iterations): eigenvector scores; they flow from winners to losers, so weak items come first."""

    def kernel(e: kernels.Edges) -> tuple[np.ndarray, float, int]:
        p, n = kernels.eigen(e, win_weight, tie_weight, tolerance, limit)
        return p, math.nan, n

    return solve(log, index, kernel, lambda one, own: distributed.eigen(one, own, win_weight, tie_weight, tolerance, limit), max_edges).drop("v")


def pagerank(log: Log, index: DataFrame | None = None, damping: float = 0.85, win_weight: float = 1.0, tie_weight: float = 0.5, tolerance: float = 1e-6, limit: int = 100, max_edges: int = MAX_EDGES, **_: object) -> DataFrame:
    """(by..., item, score, iterations): PageRank of the losses, adding up to 1."""

    def kernel(e: kernels.Edges) -> tuple[np.ndarray, float, int]:
        p, n = kernels.pagerank(e, win_weight, tie_weight, damping, tolerance, limit)
        return p, math.nan, n

    return solve(log, index, kernel, lambda one, own: distributed.pagerank(one, own, damping, win_weight=win_weight, tie_weight=tie_weight, tolerance=tolerance, limit=limit), max_edges).drop("v")


def _finite(x: float) -> float:
    return 0.0 if x != x else max(-1.7976931348623157e308, min(1.7976931348623157e308, x))


class EloRatings:
    """Ratings of one leaderboard."""

    def __init__(self, initial: float = 1000.0, base: float = 10.0, scale: float = 400.0, k: float = 4.0, win_weight: float = 1.0, tie_weight: float = 0.5) -> None:
        self.initial, self.scale, self.k = initial, scale, k
        self.log_base, self.win, self.tie = math.log(base), win_weight, tie_weight
        self.score: dict[str, float] = {}

    def play(self, left: Iterable[str], right: Iterable[str], winner: Iterable[int], weight: Iterable[float]) -> None:
        """One comparison after the other; the loop holds plain floats only."""
        score, initial, k, exp = self.score, self.initial, self.k, math.exp
        rate = self.log_base / self.scale
        points = {LEFT: (self.win, 0.0), RIGHT: (0.0, self.win), DRAW: (self.tie, self.tie)}
        for x, y, outcome, w in zip(left, right, winner, weight):
            a, b = score.get(x, initial), score.get(y, initial)
            # the expectation of the left side is 1 / (1 + base ** ((b - a) / scale)), which stays finite where the powers do not
            z = (b - a) * rate
            expected = 1 / (1 + exp(z)) if z < 700 else 0.0
            won, lost = points[outcome]
            if x == y:
                score[x] = a + k * (w * (won + lost) - 1)
            else:
                score[x] = a + k * (w * won - expected)
                score[y] = b + k * (w * lost - 1 + expected)

    def finite(self) -> list[float]:
        return [_finite(x) for x in self.score.values()]


def elo(log: Log, index: DataFrame | None = None, initial: float = 1000.0, base: float = 10.0, scale: float = 400.0, k: float = 4.0, win_weight: float = 1.0, tie_weight: float = 0.5, **_: object) -> DataFrame:
    """(by..., item, score): ratings after the log in its order; items of the index that never played keep `initial`.

    `weight` scales the points won, not the step. The log must have been prepared with an order; equal orders are taken by labels, outcome and weight.
    A leaderboard is inherently one sequence, so it is one task's, but in bounded memory: sorted rows stream past the ratings.
    """
    if not log.ordered:
        raise MissingColumnError("Elo needs a log prepared with an order")
    keys = list(log.by)
    kinds = "".join(f"`{c}` {log.df.schema[c].dataType.simpleString()}, " for c in keys)
    fields = [*keys, "left", "right", "winner", "weight"]
    spread = log.df.repartition(*keys) if keys else log.df.repartition(1)
    rows = spread.sortWithinPartitions(*keys, "ord", "left", "right", "winner", "weight").select(*fields)
    arguments = (initial, base, scale, k, win_weight, tie_weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ratings = None, EloRatings(*arguments)

        def out() -> pa.RecordBatch:
            n = len(ratings.score)
            columns = [pa.array([x] * n, t) for x, t in zip(current, key_types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(list(ratings.score), pa.string()), pa.array(ratings.finite(), pa.float64())], [*keys, "item", "score"])

        for batch in batches:
            key_types = [batch.schema.field(c).type for c in keys]
            columns = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
            groups = list(zip(*columns[: len(keys)])) if keys else []
            starts = [0, *(n for n in range(1, len(groups)) if groups[n] != groups[n - 1]), batch.num_rows]
            for low, high in zip(starts, starts[1:]):
                if low == high:
                    continue
                key = groups[low] if keys else ()
                if key != current:
                    if current is not None:
                        yield out()
                    current, ratings = key, EloRatings(*arguments)
                ratings.play(*(c[low:high] for c in columns[len(keys) :]))
        if current is not None:
            yield out()

    scored = rows.mapInArrow(run, f"{kinds}item string, score double")
    if index is None:
        return scored
    return index.select(*log.by, "item").join(scored, [*log.by, "item"], "left").fillna(initial, ["score"])


METHODS: dict[str, Callable[..., DataFrame]] = {
    "counting": counting, "average_win_rate": average_win_rate, "bradley_terry": bradley_terry, "newman": newman, "elo": elo, "eigen": eigen, "pagerank": pagerank,
}
