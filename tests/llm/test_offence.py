import numpy as np
import pytest

from rankloom.errors import NotConvergedError
from rankloom.llm import offence as O


def test_recovers_strengths_whatever_the_numbers_of_comparisons():
    rng = np.random.default_rng(3)
    s = np.exp(rng.normal(0, 1, 12))
    n = rng.integers(1, 400, (12, 12))
    n = np.triu(n, 1) + np.triu(n, 1).T
    w = n * s[:, None] / (s[:, None] + s[None, :])
    w += np.diag(n.sum(1) * O.DIAGONAL)
    i, j = np.nonzero(w)
    o, d, steps = O.scale_edges(i, j, w[i, j], 12, 1e-12, 5000)
    r = o / d
    assert steps < 500
    assert r / r[0] == pytest.approx(s / s[0], rel=1e-3)


ROWS = [(1, "A", "b ", "left"), (1, "A", "b ", "left"), (2, "b", "A", "LEFT"), (3, "a", "C", "tie"), (4, "a", "a", "left"), (5, "a", "n/a", "left"), (6, None, "a", "left"), (7, "a", "b", None), (8, "a", "b", "x"), (None, "a", "b", "left"), (9, "C", "B", " left")]


def tables(spark):
    items = spark.createDataFrame([(1, "a"), (2, "B"), (3, "c"), (4, "never")], "item_id long, item string")
    return spark.createDataFrame([(*r, "z") for r in ROWS], "ord long, left string, right string, winner string, id string"), items


def test_what_counts(spark):
    log, items = tables(spark)
    got = {r["ord"]: (r["i"], r["j"], r["score"]) for r in O.valid_comparisons(log, items).collect()}
    assert got == {1: (1, 2, 1.0), 2: (2, 1, 1.0), 3: (1, 3, 0.5), 9: (3, 2, 1.0)}


def test_ranking_local_and_distributed_agree(spark):
    log, items = tables(spark)
    a = {r["item"]: r["strength"] for r in O.ranking(log, items).collect()}
    b = {r["item"]: r["strength"] for r in O.ranking(log, items, local_edges=0, tolerance=1e-4, limit=60).collect()}
    assert b == pytest.approx(a, rel=0.01)
    assert a["never"] == 1 and a["c"] > a["a"] > a["B"]


def test_empty_tables(spark):
    log, items = tables(spark)
    assert O.ranking(log, items.limit(0)).count() == 0
    assert {r["strength"] for r in O.ranking(log.limit(0), items).collect()} == {1.0}


def chain(n, won=0.6, games=10.0):
    """Items that met their neighbours only, 0 the strongest: smoothed wins, and the strengths that make them."""
    i, j = np.concatenate([np.arange(n - 1), np.arange(1, n)]), np.concatenate([np.arange(1, n), np.arange(n - 1)])
    w = np.where(i < j, games * won, games * (1 - won))
    own = np.bincount(i, np.full(len(i), games), n) * O.DIAGONAL
    return np.concatenate([i, np.arange(n)]), np.concatenate([j, np.arange(n)]), np.concatenate([w, own])


def test_a_long_chain_comes_to_rest():
    """Each item beats the next with odds of 3 to 2, so the strengths fall by that ratio all along."""
    o, d, steps = O.scale_edges(*chain(400), 400, 1e-11, 5000)
    assert np.diff(np.log(o / d)) == pytest.approx(np.full(399, np.log(0.4 / 0.6)), rel=1e-4)
    assert steps < 1500


def test_strengths_that_do_not_come_to_rest_are_refused(spark):
    with pytest.raises(NotConvergedError):
        O.scale_edges(*chain(400), 400, 1e-11, 40)
    log, items = tables(spark)
    with pytest.raises(NotConvergedError):
        O.ranking(log, items, local_edges=0, limit=2)


def test_many_items_are_joined_by_fragment_and_replicate(spark):
    log, items = tables(spark)
    key = lambda df: sorted(map(tuple, df.select("ord", "i", "j", "score").collect()))
    assert key(O.valid_comparisons(log, items, most_sent=0)) == key(O.valid_comparisons(log, items))
