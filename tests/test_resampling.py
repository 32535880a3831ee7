import pytest
from pyspark.sql import functions as F
from test_ranking import FOOD, log_of, scores

import rankloom as R
from rankloom.functions.hashing import hash_draw, hash_number
from rankloom.errors import TooLargeError
from rankloom.operators import ranking, report, resampling


@pytest.mark.parametrize("method", ["counting", "average_win_rate", "bradley_terry", "newman", "eigen", "pagerank"])
def test_percentile_interval_holds_the_median(spark, method):
    log = log_of(spark, FOOD)
    rows = R.bootstrap(log, method, n_resamples=60, kind="percentile", seed=1).collect()
    assert {r["item"] for r in rows} == {"Tacos", "Sushi", "Burger", "Pasta", "Pizza"}
    # a resample without ties or with an undefeated item may send Newman's strengths to the largest double
    assert method == "newman" or all(r["low"] <= r["high"] and r["stderr"] > 0 for r in rows)
    assert {r["item"]: r["score"] for r in rows} == pytest.approx(scores(R.METHODS[method](log, tie_weight=0.5)))


def test_basic_reflects_percentile(spark):
    log = log_of(spark, FOOD)
    a = {r["item"]: r for r in R.bootstrap(log, "counting", n_resamples=40, kind="percentile").collect()}
    for r in R.bootstrap(log, "counting", n_resamples=40, kind="basic").collect():
        p = a[r["item"]]
        assert (r["low"], r["high"]) == pytest.approx((2 * p["score"] - p["high"], 2 * p["score"] - p["low"]))


def test_bca(spark):
    rows = R.bootstrap(log_of(spark, FOOD), "counting", n_resamples=300).collect()
    assert len(rows) == 5 and all(r["low"] < r["score"] < r["high"] for r in rows)


def test_bca_of_a_mean_agrees_with_the_plain_formula():
    import numpy as np

    x = np.array([1.0, 2, 2, 3, 9])
    values, times = np.unique(x, return_counts=True)
    boot = np.random.default_rng(0).choice(x, (4000, 5)).mean(1)
    one_by_one = np.array([np.delete(x, k).mean() for k in range(5)])
    each = np.array([(x.sum() - v) / 4 for v in values])
    assert resampling._bca_levels(boot, x.mean(), each, times, 0.9) == pytest.approx(resampling._bca_levels(boot, x.mean(), one_by_one, np.ones(5), 0.9))


def test_draws_of_both_kinds_have_the_size_of_the_log(spark):
    log = log_of(spark, FOOD)
    for draws in ("multinomial", "hash"):
        total = resampling.distribution(log, "counting", n_resamples=3, draws=draws).groupBy("resample").agg(F.sum("score").alias("s")).collect()
        assert [r["s"] for r in total] == [30.0] * 3


def test_elo_resamples_rows_in_drawn_order(spark):
    log = log_of(spark, FOOD)
    drawn = resampling.resampled_log(log, 3, seed=4)
    assert [r["count"] for r in drawn.df.groupBy("resample").count().collect()] == [30] * 3
    rows = R.bootstrap(log, "elo", n_resamples=4, kind="percentile").collect()
    assert len(rows) == 5 and all(r["low"] <= r["high"] for r in rows)
    assert R.bootstrap(log, "elo", n_resamples=4).count() == 5


def test_too_few_comparisons(spark):
    with pytest.raises(ValueError):
        R.bootstrap(log_of(spark, "a,b,left"), "counting", n_resamples=2)
    with pytest.raises(ValueError):
        R.bootstrap(log_of(spark, FOOD), "counting", kind="studentized")
    with pytest.raises(R.TooLargeError):
        R.bootstrap(log_of(spark, FOOD), "counting", n_resamples=2, max_cells=3)


def test_hash_draw_is_the_same_in_both_languages(spark):
    got = [r["h"] for r in spark.range(50).select(hash_draw(17, "s", F.col("id")).alias("h")).orderBy("id").collect()]
    assert got == [hash_number(17, "s", k) for k in range(50)]


def test_row_numbers_and_sampling(spark):
    df = spark.createDataFrame([(k % 7, str(k)) for k in range(100)], "a int, b string")
    rows = resampling.row_numbers(df, "a", "b").orderBy("row").collect()
    assert [r["row"] for r in rows] == list(range(100)) and [(r["a"], r["b"]) for r in rows] == sorted((r["a"], r["b"]) for r in rows)
    assert resampling.sample_rows(df, ["a", "b"], 250, seed=1).count() == 250
    assert resampling.sample_rows(df.limit(0), ["a"], 5).count() == 0


def test_median_order(spark):
    drawn = resampling.distribution(log_of(spark, FOOD), "counting", n_resamples=50)
    rows = report.median_order(drawn).orderBy("place").collect()
    assert rows[0]["item"] == "Tacos" and [r["median"] for r in rows] == sorted((r["median"] for r in rows), reverse=True)


def points(log, win_weight=1.0, tie_weight=0.5, bonus=0.0, **_):
    """A ranking of one's own: points by item, and a bonus."""
    scores = ranking.counting(log, None, win_weight, tie_weight)
    return scores.withColumn("score", F.col("score") + bonus)


def test_any_callable_can_be_bootstrapped(spark):
    log = log_of(spark, FOOD)
    own = {r["item"]: r for r in R.bootstrap(log, points, kind="percentile", n_resamples=60, seed=3, bonus=2.0).collect()}
    told = {r["item"]: r["score"] for r in R.counting(log).collect()}
    assert {i: r["score"] - 2 for i, r in own.items()} == pytest.approx(told)
    assert all(r["low"] <= r["score"] <= r["high"] and r["stderr"] > 0 for r in own.values())
    drawn = R.distribution(log, points, n_resamples=5, seed=3).groupBy("resample").agg(F.sum("score").alias("s")).collect()
    assert [r["s"] for r in drawn] == [30.0] * 5


def test_bca_leaves_out_each_row_of_what_depends_on_order(spark):
    log = log_of(spark, FOOD)
    copies, times = resampling.without_each(log, None)
    assert times == 30 and copies.df.count() == 30 * 29 and copies.df.groupBy("resample").agg(F.countDistinct("ord").alias("n")).filter("n <> 29").count() == 0
    grouped, times = resampling.without_each(log, 10)
    assert times == 10 and grouped.df.count() == 10 * 27
    for row in R.bootstrap(log, "elo", n_resamples=200, seed=1).collect():
        assert row["low"] < row["score"] < row["high"]
    with pytest.raises(TooLargeError):
        resampling.without_each(log, None, max_rows=29)


def test_bca_of_a_callable_is_that_of_the_named_method(spark):
    """Leaving out rows one by one or each different comparison with its number is the same."""
    log = log_of(spark, FOOD)
    a = {r["item"]: r for r in R.bootstrap(log, points, n_resamples=400, seed=5).collect()}
    b = {r["item"]: r for r in R.bootstrap(log, "counting", n_resamples=400, seed=5).collect()}
    for item in a:
        assert a[item]["low"] == pytest.approx(b[item]["low"], abs=1.5) and a[item]["high"] == pytest.approx(b[item]["high"], abs=1.5)
