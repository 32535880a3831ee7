import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

CELLS = ", ".join(f"c{k} string" for k in range(12))


def test_codes_in_every_notation_are_ratings(spark, tmp_path):
    """Units c0 to c4: two ratings each, in different notations; c5 to c7: one rating and what is no code."""
    sheets = [["3", "03", "3.0", "（４）", " 5 ", "2", "1", "4"], ["(3)", "3.", "３", "[4]", "+5", "6", "x", None]]
    rows = [(1, f"r{k}", 1, 1, *values, None, None, None, None) for k, values in enumerate(sheets)]
    spark.createDataFrame(rows, f"sheet_id bigint, rater string, coded_at bigint, received_at bigint, {CELLS}").write.parquet(str(tmp_path / "codings.parquet"))
    units = entry.queries()["unit_filter"](spark, str(tmp_path)).collect()
    assert sorted((r["unit"], r["n"]) for r in units) == [(f"1:c{k}", 2) for k in range(5)]
    cells = entry.queries()["coincidence"](spark, str(tmp_path)).collect()
    assert sorted((str(r["c"]), str(r["k"]), r["o"]) for r in cells) == [("3", "3", 6.0), ("4", "4", 2.0), ("5", "5", 2.0)]


@pytest.mark.parametrize("distance", ["nominal", "ordinal", "interval"])
def test_alpha_equals_the_sql_that_reads_every_notation(spark, sf, distance):
    con = duckdb.connect()
    con.execute(f"create view codings as select * from '{sf}/codings.parquet'")
    alpha = con.execute(f"select alpha from ({entry.oracle_sql()[f'alpha_{distance}']})").fetchone()[0]
    ratings = con.execute(f"select sum(n) from ({entry.oracle_sql()['unit_filter']})").fetchone()[0]
    assert entry.queries()[f"alpha_{distance}"](spark, sf).first()["alpha"] == pytest.approx(alpha, abs=2e-6)
    assert entry.queries()["unit_filter"](spark, sf).agg(F.sum("n")).first()[0] == ratings
