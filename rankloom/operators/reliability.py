"""Krippendorff's alpha over long ratings (unit, rater, value).

Nominal, ordinal and interval distances are sums of squares, so disagreement, observed and expected, comes from sums over units and values; no two
values are ever paired. Ratio and custom distances have no such form: there pairs of values are made, of which `max_values` squared is the
bound, counted before. Missing ratings are absent rows or null values. If all values are numbers, their numeric order and distance count,
else the order of the texts; interval and ratio distances of texts use their positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InsufficientRatingsError, MissingColumnError, TooLargeError, UnknownDistanceError
from ..session import cut
from .numbering import numbered, running_sums
from .skew import balanced_join

Distance = Callable[[Column, Column], Column]
#: different values of which pairs are made, and of which a table is sent to all tasks
MAX_VALUES, MAX_SENT = 50_000, 500_000


def ratings(df: DataFrame, unit: str = "unit", rater: str = "rater", value: str = "value") -> DataFrame:
    """(unit, rater, value) of any table; rows without unit or value are missing ratings. Each row is a rating, repeated ones too."""
    if lost := [c for c in (unit, rater, value) if c not in df.columns]:
        raise MissingColumnError(f"no column {', '.join(lost)}")
    return df.select(F.col(f"`{unit}`").alias("unit"), F.col(f"`{rater}`").alias("rater"), F.col(f"`{value}`").cast("string").alias("value")).filter("unit is not null and value is not null")


def unit_counts(rated: DataFrame) -> DataFrame:
    """(unit, value, n, m) of units with two ratings or more: n ratings of that value, m in all."""
    n = rated.groupBy("unit", "value").agg(F.count("*").alias("n"))
    return n.withColumn("m", F.sum("n").over(Window.partitionBy("unit"))).filter("m > 1")


def factorize(counts: DataFrame) -> DataFrame:
    """(value, code, x): values of pairable units numbered in text order, and the number each stands for: itself if all are numbers, else its code."""
    values = cut(counts.select("value").distinct().withColumn("number", F.col("value").try_cast("double")))
    all_numbers = values.filter("number is null").limit(1).count() == 0
    coded = numbered(values, {"__value": F.col("value")})
    return coded.select("value", F.col("row").cast("int").alias("code"), (F.col("number") if all_numbers else F.col("row").cast("double")).alias("x"))


def coincidence(counts: DataFrame) -> DataFrame:
    """(c, k, o): coincidences of values within units, n_c (n_k - [c = k]) / (m - 1) summed over units.

    Pairs are formed between the different values of a unit, of which there are at most as many as values.
    """
    a = counts.select("unit", F.col("value").alias("c"), F.col("n").alias("nc"), "m")
    b = counts.select("unit", F.col("value").alias("k"), F.col("n").alias("nk"))
    pair = F.col("nc") * (F.col("nk") - F.when(F.col("c") == F.col("k"), 1).otherwise(0)) / (F.col("m") - 1)
    return a.join(b, "unit").groupBy("c", "k").agg(F.sum(pair).alias("o"))


def marginals(counts: DataFrame, values: DataFrame) -> DataFrame:
    """(value, code, x, n, place): frequency of each value in pairable units and its middle place in the order of codes, for ordinal distance."""
    n = counts.groupBy("value").agg(F.sum("n").cast("double").alias("n")).join(values, "value")
    return running_sums(n, {"__code": F.col("code")}, "n").select("value", "code", "x", "n", (F.col("before") + F.col("n") / 2).alias("place"))


def nominal(a: Column, b: Column) -> Column:
    return F.when(a["code"] == b["code"], 0.0).otherwise(1.0)


def ordinal(a: Column, b: Column) -> Column:
    return F.pow(a["place"] - b["place"], 2)


def interval(a: Column, b: Column) -> Column:
    return F.pow(a["x"] - b["x"], 2)


def ratio(a: Column, b: Column) -> Column:
    """0 where the sum of the two is 0."""
    return F.coalesce(F.pow(F.try_divide(a["x"] - b["x"], a["x"] + b["x"]), 2), F.lit(0.0))


DISTANCES: dict[str, Distance] = {"nominal": nominal, "ordinal": ordinal, "interval": interval, "ratio": ratio}


def resolve(distance: str | Distance) -> Distance:
    """A named distance, or a custom one of the two numbers (a, b) -> Column, which is 0 on the diagonal whatever it says."""
    if callable(distance):
        return lambda a, b: F.when(a["code"] == b["code"], 0.0).otherwise(distance(a["x"], b["x"]).cast("double"))
    if distance not in DISTANCES:
        raise UnknownDistanceError(f"unknown distance: {distance}")
    return DISTANCES[distance]


def expected_pairs(marg: DataFrame, distance: str | Distance | DataFrame = "nominal", max_values: int = MAX_VALUES) -> DataFrame:
    """(c, k, e, delta): expected coincidences and distance of every pair of values; nothing is expected of fewer than two ratings.

    `distance` may also be a table (c, k, delta) of values; pairs that are not in it have distance 0. Values x values rows by definition of the
    matrix: more than `max_values` values (counted) are refused.
    """
    marg = cut(marg)
    n_values, total = marg.agg(F.count("*"), F.sum("n")).first()
    if n_values > max_values:
        raise TooLargeError(f"pairs of {n_values} values; the bound is {max_values}")
    a, b = marg.select(F.struct("*").alias("a"), F.lit(0).alias("__k")), marg.select(F.struct("*").alias("b"), F.lit(0).alias("__k"))
    pairs = a.join(F.broadcast(b), "__k")
    n = F.col("a.n") * F.col("b.n") - F.when(F.col("a.code") == F.col("b.code"), F.col("a.n")).otherwise(0.0)
    e = n / (total - 1) if total and total > 1 else F.lit(0.0)
    if isinstance(distance, DataFrame):
        cells = pairs.select(F.col("a.value").alias("c"), F.col("b.value").alias("k"), e.alias("e"))
        return cells.join(distance.select("c", "k", F.col("delta").cast("double").alias("d")), ["c", "k"], "left").select("c", "k", "e", F.when(F.col("c") == F.col("k"), 0.0).otherwise(F.coalesce("d", F.lit(0.0))).alias("delta"))
    return pairs.select(F.col("a.value").alias("c"), F.col("b.value").alias("k"), e.alias("e"), resolve(distance)(F.col("a"), F.col("b")).alias("delta"))


SQUARES = ("nominal", "interval", "ordinal")


def square_sums(counts: DataFrame, distance: str) -> tuple[float, float]:
    """(observed, expected) disagreement under a distance of `SQUARES`, without pairs of values.

    Of values v with frequencies n, the sum of n n' (v - v')² over all pairs is 2 (sum n) (sum n v²) - 2 (sum n v)²; so it is in units and over all. Values are
    moved by their mean first, which changes no difference and keeps the subtraction exact.
    """
    n = F.col("n")
    marg = cut(counts.groupBy("value").agg(F.sum("n").cast("double").alias("n")).withColumn("number", F.col("value").try_cast("double")))
    n_values, total, n_numbers, same = marg.agg(F.count("*"), F.sum("n"), F.count("number"), F.sum(n * n)).first()
    if not n_values:
        return 0.0, 0.0
    if distance == "nominal":
        units = counts.groupBy("unit").agg(F.first("m").alias("m"), F.sum(n * n).alias("s"))
        observed = units.agg(F.sum((F.col("m") * F.col("m") - F.col("s")) / (F.col("m") - 1))).first()[0]
        return float(observed or 0), (total * total - same) / (total - 1) if total > 1 else 0.0
    if distance == "ordinal":
        marg = cut(running_sums(marg, {"__value": F.col("value")}, "n").withColumn("v", F.col("before") + n / 2))
    elif n_numbers == n_values:
        marg = marg.withColumn("v", F.col("number"))
    else:
        marg = cut(numbered(marg, {"__value": F.col("value")}).withColumn("v", F.col("row").cast("double")))
    mean = marg.agg(F.try_divide(F.sum(n * F.col("v")), F.sum("n"))).first()[0]
    v = F.col("v") - F.lit(mean)
    square, first = marg.agg(F.sum(n * v * v), F.sum(n * v)).first()
    values = marg.select("value", v.alias("v"))
    placed = counts.join(F.broadcast(values), "value") if n_values <= MAX_SENT else balanced_join(counts, values, ["value"], "inner")
    v = F.col("v")
    units = placed.groupBy("unit").agg(F.first("m").alias("m"), F.sum(n * v * v).alias("s2"), F.sum(n * v).alias("s1"))
    observed = units.agg(F.sum(2 * (F.col("m") * F.col("s2") - F.col("s1") * F.col("s1")) / (F.col("m") - 1))).first()[0]
    return max(0.0, float(observed or 0)), max(0.0, 2 * (total * square - first * first) / (total - 1)) if total > 1 and n_values > 1 else 0.0


def disagreement(counts: DataFrame, distance: str | Distance | DataFrame, max_values: int = MAX_VALUES) -> tuple[float, float]:
    """(observed, expected) sums of coincidences times distance, of cut counts of values in units."""
    if isinstance(distance, str) and distance in SQUARES:
        return square_sums(counts, distance)
    pairs = expected_pairs(marginals(counts, factorize(counts)), distance, max_values).join(coincidence(counts), ["c", "k"], "left")
    told = pairs.agg(F.sum(F.coalesce("o", F.lit(0.0)) * F.col("delta")), F.sum(F.col("e") * F.col("delta"))).first()
    return float(told[0] or 0.0), float(told[1] or 0.0)


def alpha(rated: DataFrame, distance: str | Distance | DataFrame = "nominal", check: bool = True, max_values: int = MAX_VALUES) -> DataFrame:
    """One row (alpha, observed, expected): 1 - observed / expected; where nothing else is expected, 1 if nothing else is observed, else 0.

    With `check`, ratings without a pairable unit raise InsufficientRatingsError; without it they give an alpha of 1 from nothing.
    """
    if isinstance(distance, str):
        resolve(distance)
    # the counts of values in units are read for the check, the disagreement and the values, so the ratings are read once
    counts = cut(unit_counts(rated))
    if check and not counts.take(1):
        raise InsufficientRatingsError("no unit has at least two ratings")
    observed, expected = disagreement(counts, distance, max_values)
    value = 1 - observed / expected if expected else float(observed == 0)
    return rated.sparkSession.createDataFrame([(value, observed, expected)], "alpha double, observed double, expected double")


def squared_difference(a: Column, b: Column) -> Column:
    """A custom distance, for `alpha(..., distance=squared_difference)`."""
    return F.pow(a - b, 2)


def absolute_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b)
