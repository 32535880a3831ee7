"""Rows numbered in an order without one task that has to sort them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: up to so many rows (counted) one task sorts them all; the numbers are the same either way
ONE_TASK = 1_000_000


def row_numbers(df: DataFrame, *order: str) -> DataFrame:
    """`df` with `row` from 0 in the given order, without a single-task window: sorted ranges, and the number of rows before each."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order, *(c for c in df.columns if c not in order)).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33).cast("int")
    sizes = sorted((r.p, r.n) for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, rows = 0, []
    for p, n in sizes:
        rows.append((p, before))
        before += n
    starts = df.sparkSession.createDataFrame(rows, "__p int, __before bigint")
    return ranged.withColumn("__p", part).join(F.broadcast(starts), "__p").withColumn("row", F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__m", "__before")


def numbered(df: DataFrame, order: dict[str, Column], by: Sequence[str] = (), one_task: int = ONE_TASK) -> DataFrame:
    """`df` with `row` from 0 in ascending order of the expressions in `order` (nulls first, NaN last), within each group of `by`.

    A group of `by` is one sequence and numbered in one task; a table without `by` is numbered in ranges if it has more than `one_task` rows.
    """
    df = df.withColumns(order)
    if not by:
        df = cut(df)
        if df.count() > one_task:
            return row_numbers(df, *order).drop(*order)
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return df.withColumn("row", F.row_number().over(window.orderBy(*order)) - 1).drop(*order)


def running_sums(df: DataFrame, order: dict[str, Column], value: str, one_task: int = ONE_TASK) -> DataFrame:
    """`df` with `before`: the sum of `value` over the rows before, in ascending order of the expressions in `order`, which must differ between rows.

    More than `one_task` rows (counted) are summed up in ranges.
    """
    df = cut(df.withColumns(order))
    until = lambda w: F.coalesce(F.sum(value).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if df.count() <= one_task:
        return df.withColumn("before", until(Window.partitionBy(F.lit(0)))).drop(*order)
    ranged = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    total, rows = 0.0, []
    firsts = {r["__p"]: r["s"] for r in ranged.groupBy("__p").agg(F.sum(value).cast("double").alias("s")).collect()}
    for p in sorted(firsts):
        rows.append((p, total))
        total += firsts[p] or 0.0
    starts = df.sparkSession.createDataFrame(rows, "__p int, __start double")
    return ranged.withColumn("before", until(Window.partitionBy("__p"))).join(F.broadcast(starts), "__p").withColumn("before", F.col("before") + F.col("__start")).drop("__p", "__start", *order)
