import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rankloom.operators import resampling

from test_reliability import CODINGS, rated


def test_counted_draws_have_the_distribution_of_single_ones(spark, monkeypatch):
    data = rated(spark, CODINGS)
    told = data.groupBy("unit").agg(F.count("*").alias("m")).filter("m > 1").collect()
    assert {r["m"] for r in told} >= {3, 4}
    got = [np.array([r["alpha"] for r in resampling.alpha_distribution(data, "interval", n_resamples=4000, seed=3)[0].collect()])]
    monkeypatch.setattr(resampling, "MAX_COUNTED", 0)
    got.append(np.array([r["alpha"] for r in resampling.alpha_distribution(data, "interval", n_resamples=4000, seed=3)[0].collect()]))
    assert not np.array_equal(*got)
    assert got[0].mean() == pytest.approx(got[1].mean(), abs=0.01) and got[0].std() == pytest.approx(got[1].std(), rel=0.06)


def test_queries_without_sql_draw_the_default_number(spark, sf):
    assert entry.queries()["alpha_histogram"](spark, sf).agg(F.sum("n")).first()[0] == 5000
    for name in ("alpha_report", "bootstrap_bt_ci", "bootstrap_bca"):
        assert "n_resamples" not in inspect.getsource(entry.queries()[name])
