import os

import pytest
from pyspark.sql import functions as F

from rankloom import session
from rankloom.errors import NotConvergedError, TooLargeError
from rankloom.functions.hashing import hash_draw, hash_number
from rankloom.operators import distributed

from test_ranking import FOOD, log_of


def test_distributed_bradley_terry_does_not_stop_silently(spark):
    with pytest.raises(NotConvergedError):
        distributed.bradley_terry(log_of(spark, FOOD), limit=2)
    assert distributed.bradley_terry(log_of(spark, FOOD), tolerance=1e-2).first()["iterations"] > 2


def test_hash_draws_reach_every_row_of_a_large_table(spark):
    n = 1 << 40
    rows = spark.range(64).select(hash_draw(n, "s", F.col("id")).alias("h"), hash_draw(F.lit(n), "s", F.col("id")).alias("c")).collect()
    assert {r["h"] for r in rows} == {r["c"] for r in rows} == {hash_number(n, "s", k) for k in range(64)}
    assert max(r["h"] for r in rows) > 1 << 39
    with pytest.raises(TooLargeError):
        hash_number(1 << 53, "s")


def test_a_cluster_must_name_its_checkpoint_folder():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Inner:
                    @staticmethod
                    def getCheckpointDir():
                        class Nothing:
                            @staticmethod
                            def isDefined():
                                return False

                        return Nothing

                return Inner

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session)


def test_discarded_checkpoints_are_gone(spark):
    df = session.cut(spark.range(10))
    where = df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(where)
    session.discard(df)
    assert not os.path.exists(where)
