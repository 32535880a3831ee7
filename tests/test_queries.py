import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = ["item_index", "win_tie_edges_food", "counting_weighted", "average_win_rate_food", "bradley_terry", "newman", "eigen", "pagerank", "elo_by_group", "leaderboard_truncated", "alpha_ordinal", "bootstrap_basic", "p4_found", "p4_loaded", "p5_results", "unit_filter", "io_comparisons_csv", "io_arena_json", "bootstrap_own_method", "alpha_distance_table"]


def rows(df):
    columns = sorted(df.columns)
    cell = lambda v: "~" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(float(v)) if isinstance(v, (int, float)) else str(v)
    return columns, sorted(tuple(cell(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf, duck, name):
    assert rows(entry.queries()[name](spark, sf).toPandas()) == rows(duck.execute(entry.oracle_sql()[name]).df())


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, sf):
    assert entry.entry(spark).count() == 25
