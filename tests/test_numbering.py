import pytest
from pyspark.sql import functions as F

from rankloom.operators import log as lg
from rankloom.operators import ranking, report
from rankloom.operators.numbering import numbered, running_sums

from test_ranking import FOOD, log_of


@pytest.mark.parametrize("one_task", [0, 1000])
def test_numbers_and_sums_are_the_same_in_ranges(spark, one_task):
    df = spark.range(100).select(((F.col("id") * 37) % 100).alias("a"), F.lit("x").alias("row_"))
    assert {r["a"]: r["row"] for r in numbered(df, {"__a": -F.col("a")}, one_task=one_task).collect()} == {a: 99 - a for a in range(100)}
    assert {r["a"]: r["before"] for r in running_sums(df, {"__a": F.col("a")}, "a", one_task=one_task).collect()} == {a: a * (a - 1) // 2 for a in range(100)}
    assert numbered(df.limit(0), {"__a": F.col("a")}, one_task=one_task).count() == 0
    assert running_sums(df.limit(0), {"__a": F.col("a")}, "a", one_task=one_task).count() == 0


def test_ranks_are_the_same_in_ranges(spark):
    scores = spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", 5.0), ("d", None), ("e", float("nan")), ("f", 1.0), ("g", 3.0)], "item string, score double")
    key = lambda df: sorted((r["item"], r["rank"]) for r in df.collect())
    assert key(report.with_rank(scores, one_task=0)) == key(report.with_rank(scores)) == [("a", 3), ("b", 3), ("c", 1), ("d", 6), ("e", 6), ("f", 5), ("g", 3)]


def test_leaderboards_past_a_tasks_pairs_are_solved_over_all_executors(spark):
    """Step by step the same, so few steps tell."""
    log = log_of(spark, FOOD)
    for method in ("newman", "pagerank"):
        whole = {r["item"]: r["score"] for r in ranking.METHODS[method](log, limit=3).collect()}
        spread = {r["item"]: r["score"] for r in ranking.METHODS[method](log, limit=3, max_edges=1).collect()}
        assert spread == pytest.approx(whole, rel=1e-9)


def test_only_the_large_one_of_several_leaderboards_is_spread(spark):
    food = log_of(spark, FOOD).df
    small = spark.createDataFrame([("a", "b", 1, 1.0, 1), ("b", "a", 1, 1.0, 2), ("a", "b", 1, 1.0, 3)], "left string, right string, winner int, weight double, ord bigint")
    rows = food.withColumn("g", F.lit("large")).unionByName(small.select(*food.columns).withColumn("g", F.lit(None).cast("string")))
    log = lg.prepare(rows, weight="weight", order="ord", by=("g",))
    key = lambda df: {(r["g"], r["item"]): r["score"] for r in df.collect()}
    assert key(ranking.eigen(log, limit=2, max_edges=3)) == pytest.approx(key(ranking.eigen(log, limit=2)), rel=1e-9)
