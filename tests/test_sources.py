import pytest
from pyspark.sql import functions as F
from test_ranking import FOOD, FOOD_SCORES, scores

import rankloom as R
from rankloom import cli
from rankloom.functions import ieee
from rankloom.sources import io
from rankloom.streaming import live


@pytest.fixture()
def food_csv(tmp_path):
    path = tmp_path / "food.csv"
    path.write_text("left,right,winner\n" + "\n".join(FOOD.split()) + "\nTacos,Pizza,none\n")
    return str(path)


def test_command_line(spark, food_csv, tmp_path, capsys):
    out = cli.run(spark, ["-i", food_csv, "pairwise", "bradley-terry"])
    assert [(r["item"], r["rank"]) for r in out.collect()] == [("Tacos", 1), ("Sushi", 2), ("Burger", 3), ("Pasta", 4), ("Pizza", 5)]
    assert capsys.readouterr().out.splitlines()[0] == "item,score,rank"
    cli.run(spark, ["-i", food_csv, "-o", str(tmp_path / "out"), "pairwise", "elo"])
    back = spark.read.csv(str(tmp_path / "out"), header=True, inferSchema=True)
    assert scores(back) == pytest.approx(FOOD_SCORES["elo"], rel=1e-6)
    codings = tmp_path / "codings.csv"
    codings.write_text("1,2,3,3,2,1,4,1,2,,,\n1,2,3,3,2,2,4,1,2,5,,3\n,3,3,3,2,3,4,2,2,5,1,\n1,2,3,3,2,4,4,1,2,5,1,\n")
    told = {r["metric"]: r["value"] for r in cli.run(spark, ["-i", str(codings), "alpha"]).collect()}
    assert told["alpha"] == pytest.approx(904 / 1216) and told["observed"] == pytest.approx(8)


def test_arena_dump(spark, tmp_path):
    path = tmp_path / "battles.json"
    path.write_text('[{"model_a":"x","model_b":"y","winner":"model_a","anony":true,"dedup_tag":{"sampled":true},"tstamp":1},{"model_a":"x","model_b":"y","winner":"tie (bothbad)","anony":true,"dedup_tag":{"sampled":false},"tstamp":2},{"model_a":"x","model_b":"y","winner":"model_b","anony":false,"tstamp":3}]')
    assert io.read_arena_json(spark, str(path)).df.count() == 1
    assert io.read_arena_json(spark, str(path), sampled_only=False).df.count() == 2


def test_lists_of_different_lengths(spark):
    with pytest.raises(ValueError):
        io.from_rows(spark, ["a"], ["b"], ["left", "right"])


def test_parquet_round_trip(spark, tmp_path):
    df = R.counting(io.from_rows(spark, ["a"], ["b"], [1]))
    io.write_parquet(df, str(tmp_path / "x"))
    assert scores(spark.read.parquet(str(tmp_path / "x"))) == {"a": 1.0, "b": 0.0}


def play(df, name, mode):
    run = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return df.sparkSession.table(name)


def test_streams_in_two_batches(spark, tmp_path):
    rows = [(*x.split(","), k) for k, x in enumerate(FOOD.split())]
    df = spark.createDataFrame(rows, "left string, right string, winner string, k long").withColumns({"board": F.lit("b"), "t": F.timestamp_seconds(F.col("k") * 3600)})
    df.filter("k < 17").coalesce(1).write.parquet(str(tmp_path / "s"))
    df.filter("k >= 17").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    assert scores(play(live.live_counting(stream()), "t_counting", "complete")) == FOOD_SCORES["counting"]
    days = play(live.windowed_counting(stream(), "t", once="k"), "t_days", "append")
    assert {r["start"].day for r in days.collect()} <= {1, 2}
    elo = play(live.live_elo(stream(), "board", "k"), "t_elo", "update").collect()
    assert {r["item"]: r["score"] for r in elo[-5:]} == pytest.approx(FOOD_SCORES["elo"], rel=1e-6)


def test_ieee(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (-1.0, 0.0), (4.0, 2.0), (nan, 1.0)], "a double, b double")
    got = [repr(r[0]) for r in df.select(ieee.divide(F.col("a"), F.col("b"))).collect()]
    assert got == [repr(x) for x in (nan, inf, -inf, 2.0, nan)]
    df = spark.createDataFrame([(nan,), (inf,), (-inf,), (1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(ieee.nan_to_num(F.col("x"), 7.0)).collect()] == [7.0, ieee.LARGEST, -ieee.LARGEST, 1.5, None]
    assert df.agg(ieee.nan_mean(F.when(F.abs("x") < 9, F.col("x")))).first()[0] == 1.5
    one = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    assert one.agg(ieee.geometric_mean(F.col("x")), ieee.l1_norm(F.col("x")), ieee.l2_norm(F.col("x"))).first() == (0.0, 2.0, 2.0)
