import pytest
from pyspark.sql import functions as F

from rankloom.operators import skew as S


def big(spark):
    """A third of the rows have one key, a sixth another, the rest many; some keys are null."""
    key = F.when(F.col("id") % 6 < 2, "hot").when(F.col("id") % 6 == 2, "warm").when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    return spark.range(6000).select(key.alias("key"), F.col("id").alias("v"))


def test_heavy_keys_are_split_and_tasks_even(spark):
    plan = S.plan_loads(big(spark), ["key"], tasks=8)
    heavy = {r["key"]: len(r["__tasks"]) for r in plan.heavy.collect()}
    assert heavy["hot"] == 8 and heavy["warm"] >= 5 and len(heavy) <= 8 / 0.25
    placed = S.place(S.fragment(big(spark), plan), plan).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in placed) == 6000
    assert max(r["count"] for r in placed) < 1.5 * 6000 / 8
    assert sum(plan.loads) == pytest.approx(6000)


def test_join_equals_plain_join(spark):
    other = spark.createDataFrame([("hot", 1), ("warm", 2), ("k3", 3), ("k3", 4), (None, 5), ("absent", 6)], "key string, w int")
    for how in ("inner", "left"):
        got = S.balanced_join(big(spark), other, ["key"], how)
        want = big(spark).join(other, "key", how)
        assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    with pytest.raises(ValueError):
        S.balanced_join(big(spark), other.withColumnRenamed("w", "v"), ["key"])
    with pytest.raises(ValueError):
        S.balanced_join(big(spark), other, ["key"], "full")


def test_join_needs_no_exchange_after_placement(spark):
    other = spark.createDataFrame([("hot", 1)], "key string, w int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = S.balanced_join(big(spark), other, ["key"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange shufflepartitionidpassthrough") == 2 and "Exchange hashpartitioning(__task" not in plan


def test_aggregate_equals_group_by(spark):
    got = S.balanced_aggregate(big(spark), ["key"], {"n": F.count("*"), "s": F.sum("v")}, {"n": F.sum("n"), "s": F.sum("s")})
    want = big(spark).groupBy("key").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_empty_tables_and_single_key(spark):
    none = big(spark).limit(0)
    assert S.balanced_join(none, none.select("key", F.col("v").alias("w")), ["key"]).count() == 0
    one = spark.range(100).select(F.lit("x").alias("key"), "id")
    assert S.balanced_join(one, spark.createDataFrame([("x", 1)], "key string, w int"), ["key"], "inner").count() == 100


def test_two_keys(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("a"), F.when(F.col("id") % 4 > 0, "z").alias("b"), F.col("id"))
    got = S.balanced_aggregate(df, ["a", "b"], {"n": F.count("*")}, {"n": F.sum("n")})
    assert {(r["a"], r["b"]): r["n"] for r in got.collect()} == {(0, None): 100, (0, "z"): 100, (1, "z"): 200}


def test_label_results(spark):
    items = spark.createDataFrame([(1, "Leek Pie"), (2, 'Oat "Bran"')], "item_id long, item string")
    rows = [("LEEK PIE ", 'oat "bran"', "left"), ("\tleek pie", "n/a", " Tie"), ("Leek Pie", None, None), (None, "Leek Pie", "right"), ("n/a", "Leek Pie", "oops")] * 10
    log = spark.createDataFrame([(*r, "extra") for r in rows], "left string, right string, winner string, n string")
    got = {(r["side"], r["item"]): (r["n"], r["wins"], r["ties"], r["opponents"]) for r in S.label_results(log, items).collect()}
    assert got["left", "Leek Pie"] == (30, 10, 10, 2)
    assert got["right", "Leek Pie"] == (20, 10, 0, 1)
    assert got["left", None] == (10, 0, 0, 1) and got["right", "n/a"] == (10, 0, 10, 1)
    found = {(r["side"], r["item"]) for r in S.heavy_labels(S.label_results(log, items), 0.3).collect()}
    assert found == {("left", "Leek Pie"), ("right", "Leek Pie")}
    assert S.label_results(log.limit(0), items).count() == 0


def test_packing_is_balanced():
    where, loads = S.pack([(5.0, "a"), (4.0, "b"), (3.0, "c"), (3.0, "d"), (3.0, "e")], 2)
    assert sorted(loads) == [8.0, 10.0] and len(where) == 5
