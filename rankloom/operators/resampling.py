"""Bootstraps: of pairwise scores, and of Krippendorff's alpha.

A resample of a log influences the order-free methods only through how often each different comparison (left, right, winner, weight) was
drawn, and those counts are multinomial. So the log is reduced once to its cells, and each resample is a draw of counts and a
solution over K x K edges, in parallel over resamples: the cost does not depend on the length of the log. The cells go to every task;
their number is checked against `max_cells`. Elo depends on order, and of any other callable nothing is known: there the drawn rows
themselves are taken in the order drawn, all resamples as one log of as many leaderboards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InsufficientRatingsError, TooLargeError
from ..functions.hashing import hash_draw, hash_number
from ..session import cut
from . import kernels, ranking
from . import reliability as rel
from .log import DRAW, LEFT, Log, cells, first_places, item_index
from .numbering import row_numbers

MAX_CELLS = 1_000_000
#: rows that are left out one by one, which copies the log as often
MAX_LEFT_OUT = 10_000
#: a ranking of a Log: (log, **options) -> (by..., item, score)
Method = Callable[..., DataFrame]
MAX_COUNTED = 200


def _kernel(method: str, win_weight: float, tie_weight: float, options: dict) -> Callable[[kernels.Edges], np.ndarray]:
    run = {
        "counting": kernels.counting,
        "average_win_rate": kernels.average_win_rate,
        "bradley_terry": lambda e, w, t, **o: kernels.bradley_terry(e, w, t, **o)[0],
        "newman": lambda e, w, t, **o: kernels.newman(e, w, t, **o)[0],
        "eigen": lambda e, w, t, **o: kernels.eigen(e, w, t, **o)[0],
        "pagerank": lambda e, w, t, **o: kernels.pagerank(e, w, t, **o)[0],
    }[method]
    return lambda e: run(e, win_weight, tie_weight, **options)


class CellLog:
    """The cells of a log as arrays over item numbers; `scores` solves for given counts of each."""

    def __init__(self, pdf: pd.DataFrame, items: Sequence[str], kernel: Callable[[kernels.Edges], np.ndarray]) -> None:
        number = {x: k for k, x in enumerate(items)}
        self.k, self.kernel = len(items), kernel
        self.left, self.right = (np.array([number[x] for x in pdf[c]], np.int64) for c in ("left", "right"))
        self.winner, self.weight, self.n = pdf["winner"].to_numpy(), pdf["weight"].to_numpy(), pdf["n"].to_numpy()

    def scores(self, counts: np.ndarray) -> np.ndarray:
        w = counts * self.weight
        zero = np.zeros(len(w))
        tie = np.where(self.winner == DRAW, w, zero)
        left, right = np.where(self.winner == LEFT, w, zero), np.where((self.winner != DRAW) & (self.winner != LEFT), w, zero)
        i, j = np.concatenate([self.left, self.right]), np.concatenate([self.right, self.left])
        return self.kernel(kernels.symmetric(self.k, i, j, np.concatenate([left, right]), np.concatenate([tie, tie])))

    def draw(self, resample: int, seed: int, draws: str) -> np.ndarray:
        """Counts of the cells in a resample: multinomial, or draw by draw from hashes so that any engine can repeat them."""
        total = int(self.n.sum())
        if draws == "multinomial":
            return np.random.default_rng([seed, resample]).multinomial(total, self.n / total)
        ends = np.cumsum(self.n)
        at = np.array([hash_number(total, seed, resample, d) for d in range(total)], np.int64)
        return np.bincount(np.searchsorted(ends, at, side="right"), minlength=len(ends))


def _collect(log: Log, index: DataFrame | None, max_cells: int) -> tuple[pd.DataFrame, list[str]]:
    if log.by:
        raise ValueError("bootstrap one leaderboard at a time")
    rows = cells(log).orderBy("left", "right", "winner", "weight").limit(max_cells + 1).toPandas()
    if len(rows) > max_cells:
        raise TooLargeError(f"more than {max_cells} different comparisons")
    if rows["n"].sum() < 2:
        raise ValueError("a bootstrap needs at least two comparisons")
    items = (item_index(log) if index is None else index).orderBy("k").limit(max_cells + 1).toPandas()["item"].tolist()
    if len(items) > max_cells:
        raise TooLargeError(f"more than {max_cells} items")
    return rows, items


def distribution(
    log: Log, method: str | Method, index: DataFrame | None = None, n_resamples: int = 1000, seed: int = 0, win_weight: float = 1.0, tie_weight: float = 0.5, draws: str = "multinomial", max_cells: int = MAX_CELLS, **options: float
) -> DataFrame:
    """(resample, item, score) with resample from 0; every item of the index in each.

    `method` is a named one or any callable of a Log by `resample` that gives (resample, item, score), as those of `ranking` do; it is given the drawn
    rows in the order drawn, as Elo is. An item it gives no score has that of `missing` (0; for Elo, where it began).
    """
    if callable(method) or method == "elo":
        missing = options.pop("missing", options.get("initial", 1000.0) if method == "elo" else 0.0)
        scores = _run(method, resampled_log(log, n_resamples, seed), win_weight, tie_weight, options)
        every = log.df.sparkSession.range(n_resamples).withColumnRenamed("id", "resample").join(F.broadcast(_items(log, index, max_cells)))
        return every.join(scores, ["resample", "item"], "left").fillna(missing, ["score"])
    rows, items = _collect(log, index, max_cells)
    kernel = _kernel(method, win_weight, tie_weight, options)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log_cells = CellLog(rows, items, kernel)
        for pdf in frames:
            for r in pdf["id"]:
                yield pd.DataFrame({"resample": r, "item": items, "score": log_cells.scores(log_cells.draw(int(r), seed, draws))})

    spark = log.df.sparkSession
    return spark.range(0, n_resamples, numPartitions=min(n_resamples, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "resample bigint, item string, score double")


def _run(method: str | Method, log: Log, win_weight: float, tie_weight: float, options: dict) -> DataFrame:
    """(by..., item, score) of a method that goes over rows."""
    call = method if callable(method) else ranking.METHODS[method]
    return call(log, win_weight=win_weight, tie_weight=tie_weight, **options).select(*log.by, "item", "score")


def _items(log: Log, index: DataFrame | None, most: int) -> DataFrame:
    """The items of the index or the log; more than `most` (counted) are refused, as each resample has them all."""
    items = cut((first_places(log) if index is None else index).select("item"))
    if items.count() > most:
        raise TooLargeError(f"more than {most} items")
    return items


def resampled_log(log: Log, n_resamples: int, seed: int = 0) -> Log:
    """Rows drawn with replacement, as many as there are, once a resample: a log by `resample` in the order drawn."""
    numbered = cut(row_numbers(log.df, "ord") if log.ordered else row_numbers(log.df, "left", "right", "winner", "weight"))
    n = numbered.count()
    if n < 2:
        raise ValueError("a bootstrap needs at least two comparisons")
    spark = log.df.sparkSession
    draws = spark.range(n_resamples * n).select(F.floor(F.col("id") / n).cast("bigint").alias("resample"), (F.col("id") % n).alias("d"))
    drawn = draws.withColumn("row", hash_draw(n, seed, F.col("resample"), F.col("d")))
    rows = drawn.join(numbered.drop("ord"), "row").select("resample", "left", "right", "winner", "weight", F.col("d").alias("ord"))
    return Log(rows, ("resample",), True)


def sample_rows(df: DataFrame, order: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """(d, ...): exactly n rows drawn with replacement, reproducibly; an empty table gives none."""
    numbered = cut(row_numbers(df, *order))
    total = numbered.count()
    if not total:
        return numbered.withColumn("d", F.lit(0).cast("bigint")).drop("row")
    drawn = df.sparkSession.range(n).select(F.col("id").alias("d"), hash_draw(total, seed, F.col("id")).alias("row"))
    return drawn.join(numbered, "row").drop("row")


def quantiles(scores: DataFrame, confidence: float = 0.95, keys: Sequence[str] = ("item",)) -> DataFrame:
    """(keys, low, high, stderr): percentile interval by linear quantiles, and standard deviation, of each item's resamples."""
    tail = (1 - confidence) / 2
    p = F.percentile("score", F.array(F.lit(tail), F.lit(1 - tail)))
    return scores.groupBy(*keys).agg(p.alias("p"), F.stddev_samp("score").alias("stderr")).select(*keys, F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), "stderr")


def _bca_levels(distribution_: np.ndarray, estimate: float, jackknife: np.ndarray, times: np.ndarray, confidence: float) -> tuple[float, float]:
    """Percentiles of the bias-corrected and accelerated interval; `times` is how often each left-out comparison occurs."""
    normal = NormalDist()
    below = (np.sum(distribution_ < estimate) + np.sum(distribution_ <= estimate)) / (2 * len(distribution_))
    if not 0 < below < 1:
        return (float("nan"),) * 2
    z0 = normal.inv_cdf(below)
    mean = np.average(jackknife, weights=times)
    off = mean - jackknife
    spread = np.sum(times * off**2) ** 1.5
    a = np.sum(times * off**3) / (6 * spread) if spread else 0.0
    out = []
    for tail in ((1 - confidence) / 2, 1 - (1 - confidence) / 2):
        z = z0 + normal.inv_cdf(tail)
        out.append(normal.cdf(z0 + z / (1 - a * z)))
    return out[0], out[1]


def without_each(log: Log, groups: int | None, max_rows: int = MAX_LEFT_OUT) -> tuple[Log, int]:
    """The log once without each row or, with `groups`, without each of so many shares of rows: a log by `resample`, and how many there are.

    That is rows x rows, so more than `max_rows` rows (counted) need `groups`.
    """
    numbered = cut(row_numbers(log.df, "ord") if log.ordered else row_numbers(log.df, "left", "right", "winner", "weight"))
    n = numbered.count()
    if n < 2:
        raise ValueError("a bootstrap needs at least two comparisons")
    if groups is None and n > max_rows:
        raise TooLargeError(f"leaving out each of {n} rows; the bound is {max_rows}: give jackknife_groups")
    times = min(n, groups or n)
    left_out = F.pmod(F.col("row"), F.lit(times)).cast("int")
    copies = numbered.drop("ord").withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).filter(F.col("resample") != left_out)
    rows = copies.select(F.col("resample").cast("bigint").alias("resample"), "left", "right", "winner", "weight", F.col("row").alias("ord"))
    return Log(rows, ("resample",), True), times


def bootstrap(
    log: Log, method: str | Method, index: DataFrame | None = None, n_resamples: int = 1000, confidence: float = 0.95, kind: str = "bca", seed: int = 0, win_weight: float = 1.0, tie_weight: float = 0.5, draws: str = "multinomial", max_cells: int = MAX_CELLS, jackknife_groups: int | None = None, **options: float
) -> DataFrame:
    """(item, score, low, high, stderr): point estimate and interval of each item.

    `method` is the name of a ranking or any callable of a Log and keywords that gives (by..., item, score), see `distribution`. `kind`: percentile,
    basic (reflected about the estimate) or bca. The jackknife of bca leaves out each comparison; named methods other than Elo leave out each different one
    once and count it as often as it occurs, Elo and callables leave out each row, or each of `jackknife_groups` shares of rows, which a
    log of more than `MAX_LEFT_OUT` rows needs. Fewer than two comparisons raise ValueError.
    """
    if kind not in ("percentile", "basic", "bca"):
        raise ValueError(f"no {kind} interval")
    over_rows = callable(method) or method == "elo"
    options = dict(options)
    missing = options.get("missing", options.get("initial", 1000.0) if method == "elo" else 0.0)
    if over_rows:
        called = {k: v for k, v in options.items() if k != "missing"}
        items = _items(log, index, max_cells)
        estimate = cut(items.join(_run(method, log, win_weight, tie_weight, called), "item", "left").fillna(missing, ["score"]))
    else:
        estimate = ranking.METHODS[method](log, index if index is not None else item_index(log), win_weight=win_weight, tie_weight=tie_weight, **options).select("item", "score")
    drawn = distribution(log, method, index, n_resamples, seed, win_weight, tie_weight, draws, max_cells, **options)
    if kind != "bca":
        out = estimate.join(quantiles(drawn, confidence), "item")
        if kind == "percentile":
            return out
        return out.select("item", "score", (2 * F.col("score") - F.col("high")).alias("low"), (2 * F.col("score") - F.col("low")).alias("high"), "stderr")
    spark = log.df.sparkSession
    drawn = cut(drawn)
    if over_rows:
        copies, times = without_each(log, jackknife_groups)
        scores = _run(method, copies, win_weight, tie_weight, called)
        every = spark.range(times).withColumnRenamed("id", "resample").join(F.broadcast(items))
        left_out = cut(every.join(scores, ["resample", "item"], "left").fillna(missing, ["score"]).select("item", "score", F.lit(1).cast("bigint").alias("times")))
    else:
        rows, names = _collect(log, index, max_cells)
        kernel = _kernel(method, win_weight, tie_weight, options)

        def leave_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            log_cells = CellLog(rows, names, kernel)
            for pdf in frames:
                for g in pdf["id"]:
                    counts = log_cells.n.copy()
                    counts[g] -= 1
                    yield pd.DataFrame({"item": names, "score": log_cells.scores(counts), "times": log_cells.n[g]})

        left_out = spark.range(0, len(rows), numPartitions=min(len(rows), 4 * spark.sparkContext.defaultParallelism)).mapInPandas(leave_out, "item string, score double, times bigint")

    def levels(key: tuple, one: pd.DataFrame, jack: pd.DataFrame) -> pd.DataFrame:
        """`one` holds the resamples with the estimate, at most n_resamples rows; `jack` at most a row a cell, row or group left out."""
        values = one["score"].to_numpy()
        low, high = _bca_levels(values, one["estimate"].iloc[0], jack["score"].to_numpy(), jack["times"].to_numpy(), confidence)
        bounds = np.quantile(values, [low, high]) if low == low else (np.nan, np.nan)
        return pd.DataFrame({"item": [key[0]], "score": one["estimate"].iloc[:1], "low": [bounds[0]], "high": [bounds[1]], "stderr": [np.std(values, ddof=1)]})

    both = drawn.join(estimate.withColumnRenamed("score", "estimate"), "item")
    return both.groupBy("item").cogroup(left_out.groupBy("item")).applyInPandas(levels, "item string, score double, low double, high double, stderr double")


def pair_errors(rated: DataFrame, distance: str | rel.Distance = "nominal", max_values: int = rel.MAX_VALUES) -> tuple[pd.DataFrame, pd.DataFrame, dict[str, float]]:
    """Bounded summaries for the bootstrap of alpha: pooled pair errors (error, n) by pair of values, units by number of ratings (m, units), and alpha.

    The pairs of values are at most max_values squared / 2, whatever the number of units.
    """
    counts = cut(rel.unit_counts(rated))
    co = cut(rel.coincidence(counts))
    pairs = cut(rel.expected_pairs(rel.marginals(counts, rel.factorize(counts)), distance, max_values))
    a, b = counts.select("unit", F.col("value").alias("c"), F.col("n").alias("nc")), counts.select("unit", F.col("value").alias("k"), F.col("n").alias("nk"))
    same = F.col("c") == F.col("k")
    n = F.when(same, F.col("nc") * (F.col("nc") - 1) / 2).otherwise(F.col("nc") * F.col("nk"))
    pooled = a.join(b, "unit").filter("c <= k").groupBy("c", "k").agg(F.sum(n).cast("bigint").alias("n")).filter("n > 0")
    told = pairs.join(co, ["c", "k"], "left").agg(F.sum(F.coalesce("o", F.lit(0.0)) * F.col("delta")).alias("observed"), F.sum(F.col("e") * F.col("delta")).alias("expected")).first()
    if told is None or told["expected"] is None:
        raise InsufficientRatingsError("no unit has at least two ratings")
    if told["expected"] <= 0:
        raise ValueError("the bootstrap of alpha is not defined where no disagreement is expected")
    errors = pooled.join(pairs.select("c", "k", "delta"), ["c", "k"]).select("c", "k", (2 * F.col("delta") / F.lit(told["expected"])).alias("error"), "n").orderBy("c", "k").limit(MAX_CELLS + 1).toPandas()
    if len(errors) > MAX_CELLS:
        raise TooLargeError(f"more than {MAX_CELLS} pairs of values")
    units = counts.select("unit", "m").distinct().groupBy("m").agg(F.count("*").alias("units")).orderBy("m").toPandas()
    return errors, units, {"alpha": 1 - told["observed"] / told["expected"], "observed": told["observed"], "expected": told["expected"]}


def alpha_distribution(rated: DataFrame, distance: str | rel.Distance = "nominal", n_resamples: int = 5000, seed: int = 0, draws: str = "random", block: int = 1 << 20) -> tuple[DataFrame, dict[str, float]]:
    """(resample, alpha) and the point estimate.

    A resample starts at 1; each unit of m ratings draws m (m - 1) / 2 of the pooled pair errors with replacement and takes each / (m - 1) off;
    a second draw that hits the first one's pair is drawn once more; the result is at least -1. Random draws from up to `MAX_COUNTED` pairs of
    values are counts, of the same distribution, whose cost does not depend on the units; others are made `block` units at a time.
    """
    if n_resamples <= 0:
        raise ValueError("n_resamples must be positive")
    errors, units, point = pair_errors(rated, distance)
    ends, error = np.cumsum(errors["n"].to_numpy()), errors["error"].to_numpy()
    total = int(ends[-1])
    groups = list(units.itertuples(index=False, name=None))

    def counted(resample: int) -> float:
        rng, left, n = np.random.default_rng([seed, resample]), 1.0, errors["n"].to_numpy(dtype=float)
        share, apart = n / total, np.outer(n, n) - np.diag(n)
        for m, of_m in groups:
            each, hit = m * (m - 1) // 2, 0
            counts = np.zeros(len(n), np.int64)
            if each > 1:
                # a second draw that hit the first one's pair is drawn once more, so both are free; the others are two different pairs
                hit = int(rng.binomial(of_m, 1 / total))
                if of_m > hit:
                    two = rng.multinomial(of_m - hit, (apart / apart.sum()).ravel()).reshape(apart.shape)
                    counts += two.sum(0) + two.sum(1)
            counts += rng.multinomial(of_m * (each - 2) + 2 * hit if each > 1 else of_m, share)
            left -= counts @ error / (m - 1)
        return max(left, -1.0)

    def one(resample: int) -> float:
        if draws != "hash" and len(error) <= MAX_COUNTED:
            return counted(resample)
        rng, left = np.random.default_rng([seed, resample]), 1.0
        for m, n in groups:
            each = m * (m - 1) // 2
            step = max(1, block // each)
            for start in range(0, n, step):
                size = min(step, n - start)
                if draws == "hash":
                    at = np.array([[hash_number(total, seed, resample, m, start + u, d) for d in range(each)] for u in range(size)], np.int64)
                else:
                    at = rng.integers(0, total, (size, each))
                if each > 1:
                    again = np.flatnonzero(at[:, 0] == at[:, 1])
                    at[again, 1] = [hash_number(total, seed, resample, m, start + u, "again") for u in again] if draws == "hash" else rng.integers(0, total, len(again))
                left -= error[np.searchsorted(ends, at, side="right")].sum() / (m - 1)
        return max(left, -1.0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"resample": pdf["id"], "alpha": [one(int(r)) for r in pdf["id"]]})

    spark = rated.sparkSession
    return spark.range(0, n_resamples, numPartitions=min(n_resamples, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "resample bigint, alpha double"), point


def alpha_bootstrap(rated: DataFrame, distance: str | rel.Distance = "nominal", n_resamples: int = 5000, confidence: float = 0.95, seed: int = 0, draws: str = "random") -> DataFrame:
    """One row (alpha, observed, expected, low, high, n_resamples, confidence_level)."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must be between 0 and 1")
    drawn, point = alpha_distribution(rated, distance, n_resamples, seed, draws)
    tail = (1 - confidence) / 2
    p: Column = F.percentile("alpha", F.array(F.lit(tail), F.lit(1 - tail)))
    return drawn.agg(p.alias("p")).select(*(F.lit(float(point[c])).alias(c) for c in ("alpha", "observed", "expected")), F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), F.lit(n_resamples).alias("n_resamples"), F.lit(confidence).alias("confidence_level"))
