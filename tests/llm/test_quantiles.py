import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import quantiles as Q

SHAPE = Q.Shape()


def sketch_of(values, shape=SHAPE):
    v = np.asarray(values, float)
    size = np.clip(np.floor(np.log(np.abs(v)) / shape.resolution), -shape.limit(), shape.limit()) + shape.limit() + 1
    return Q.Sketch(shape).add(((1 << (shape.bits - 1)) + np.sign(v) * size).astype(np.int64), np.ones(len(v), np.int64))


@pytest.mark.parametrize("seed", range(6))
def test_rank_error_is_small_and_within_what_an_answer_says(seed):
    rng = np.random.default_rng(seed)
    v = np.sort(rng.lognormal(rng.normal(0, 3), rng.uniform(0.1, 2), 30_000))
    s = sketch_of(v)
    for q in (0.05, 0.25, 0.5, 0.75, 0.95, 0.99):
        value, bound = s.quantile(q)
        low, high = np.searchsorted(v, [value * np.exp(-0.51 * SHAPE.resolution), value * np.exp(0.51 * SHAPE.resolution)]) / len(v)
        error = max(low - q, q - high, 0)
        assert error <= bound < 0.1 and error < 0.01


def test_groups_with_few_codes_say_that_they_are_exact():
    assert sketch_of([0.5, 1.0, 1.0, 40.0]).quantile(0.5)[1] == 0


def test_large_weights_are_counted_exactly():
    s = Q.Sketch(SHAPE).add(np.array([5, 5, 9]), np.array([(1 << 53) + 1, 1 << 53, -3]))
    assert s.n == (1 << 54) - 2 and s.count(SHAPE.bits, 5)[0] == float((1 << 54) + 1)


def test_few_values_are_exact_up_to_resolution():
    s = sketch_of([0.5, 1.0, 1.0, 40.0])
    assert [s.quantile(q)[0] for q in (0, 0.25, 0.5, 0.75, 1)] == pytest.approx([0.5, 0.5, 1, 1, 40], rel=SHAPE.resolution)
    assert np.isnan(Q.Sketch(SHAPE).quantile(0.5)).all()


def test_sums_and_deletions():
    a, b = sketch_of([1.0, 2.0, 3.0] * 50), sketch_of([10.0, 20.0] * 40)
    both = sketch_of([1.0, 2.0, 3.0] * 50 + [10.0, 20.0] * 40)
    assert (Q.Sketch.from_bytes(a.to_bytes()).merge(b).cells == both.cells).all()
    b.cells *= -1
    assert (both.merge(b).cells == a.cells).all()
    with pytest.raises(ValueError):
        a.merge(Q.Sketch(Q.Shape(width=256)))


def test_tables(spark):
    rows = [("a", 1, 2.0, "x"), ("a", 1, 4.0, "x"), ("a", 2, 6.0, None), (None, 1, 1.0, "x"), ("a", 1, None, "x"), ("a", 1, float("nan"), "x"), ("a", 2, float("inf"), "x"), ("b", 1, float("nan"), "x"), ("c", 1, -3.0, "x"), ("c", 1, 0.0, "x")]
    df = spark.createDataFrame(rows, "g string, d int, v double, sketch string")
    days = Q.sketch_groups(df, ["g", "d"], "v")
    got = {(r["g"], r["d"]): r["value"] for r in Q.percentiles(days, ["g", "d"], [50]).collect()}
    assert got == pytest.approx({("a", 1): 2.0, ("a", 2): 6.0, (None, 1): 1.0, ("c", 1): -3.0}, rel=0.01)
    all_days = Q.merge_sketches(days, ["g"])
    got = {(r["g"], r["pct"]): (r["value"], r["n"]) for r in Q.percentiles(all_days, ["g"], [50, 100]).collect()}
    assert got["a", 50.0][1] == 3 and got["a", 50.0][0] == pytest.approx(4, rel=0.01) and got["c", 100.0][0] == 0.0
    direct = Q.sketch_groups(df, ["g"], "v")
    key = lambda r: str(r["g"])
    assert [(r["g"], Q.Sketch.from_bytes(r["sketch"]).cells.tolist()) for r in sorted(all_days.collect(), key=key)] == [(r["g"], Q.Sketch.from_bytes(r["sketch"]).cells.tolist()) for r in sorted(direct.collect(), key=key)]
    assert Q.sketch_groups(df.limit(0), ["g"], "v").count() == 0
    taken = Q.sketch_groups(df.withColumn("w", F.when(F.col("v") == 4, -1).otherwise(1)).unionByName(df.withColumn("w", F.lit(1))), ["g", "d"], "v", "w")
    assert {(r["g"], r["d"]): r["n"] for r in Q.percentiles(taken, ["g", "d"], [50]).collect()}["a", 1] == 2


def test_runs_count_once_and_weeks_are_iso(spark):
    runs = spark.sql("select * from values (1L,'e','n',1D,timestamp_ntz'2016-01-03 23:59:59'),(1L,'e','n',1D,timestamp_ntz'2016-01-03 23:59:59'),(2L,'e','n',-1D,timestamp_ntz'2016-01-03 00:00:00'),(3L,'e','n',double('nan'),timestamp_ntz'2016-01-03 00:00:00'),(4L,'e','n',double('inf'),timestamp_ntz'2016-01-03 00:00:00'),(5L,'e','n',null,timestamp_ntz'2016-01-03 00:00:00') t(run_id,algorithm,solver,time,started_at)")
    rows = Q.timings_once(runs).withColumn("week", Q.iso_week(F.to_date("day"))).collect()
    assert [(r["day"], r["week"], r["time"]) for r in rows] == [("2016-01-03", "2015-W53", 1.0)]


def test_rows_without_run_id_count_each(spark):
    runs = spark.sql("select * from values (null,'e','n',1D,timestamp_ntz'2016-01-03 00:00:00'),(null,'e','n',1D,timestamp_ntz'2016-01-03 00:00:00'),(7L,'e','n',2D,timestamp_ntz'2016-01-03 00:00:00'),(7L,'e','n',2D,timestamp_ntz'2016-01-03 00:00:00') t(run_id,algorithm,solver,time,started_at)")
    assert sorted(r["time"] for r in Q.timings_once(runs).collect()) == [1.0, 1.0, 2.0]
