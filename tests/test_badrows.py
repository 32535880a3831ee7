import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.operators import badrows as B

GOOD = '7,Leek Pie,"Oat, Bran ""Wild""",left,0.5,2016-02-29 23:59:59'
CASES = {
    GOOD: None,
    '7,a,b,LEFT,,2016-01-01 00:00:00\r': None,
    ' 7 , "a" ,"b" , tie , 1 , 2016-01-01 00:00:00 ': None,
    '7,"a\nb",c,right,12.25,2016-01-01 00:00:00': None,
    '"7","a","b","tie","1","2016-01-01 00:00:00"': None,
    '7,a\nb,c,right,1,2016-01-01 00:00:00': None,
    '7,“a”,b\\,right,1,2016-01-01 00:00:00': None,
    '7,a "x",b,left,1,2016-01-01 00:00:00': "quoting",
    '7,"a" x,b,left,1,2016-01-01 00:00:00': "quoting",
    '7,"a,b,left,1,2016-01-01 00:00:00': "quoting",
    '"': "quoting",
    '7,"a" x,b': "quoting",
    "": "column_count",
    "7": "column_count",
    "7,a,b,left,1,2016-01-01 00:00:00,": "column_count",
    "7,a,b,left,1": "column_count",
    "x,a,b,left,1,2016-01-01 00:00:00": "value",
    "٧,a,b,left,1,2016-01-01 00:00:00": "value",
    "7,,b,left,1,2016-01-01 00:00:00": "value",
    '7,"  ",b,left,1,2016-01-01 00:00:00': "value",
    "7,a,b,lеft,1,2016-01-01 00:00:00": "value",
    "7,a,b,left,1.,2016-01-01 00:00:00": "value",
    "7,a,b,left,-1,2016-01-01 00:00:00": "value",
    "7,a,b,left,1,2015-02-29 00:00:00": "value",
    "7,a,b,left,1,2016-01-01 24:00:00": "value",
    "7,a,b,left,1,2016-01-01": "value",
    "﻿7,a,b,left,1,2016-01-01 00:00:00": "value",
    "7,a,b,left\n,1,2016-01-01 00:00:00": "value",
    '7,"","",left,1,2016-01-01 00:00:00': "value",
    None: "column_count",
}


def test_reasons_alone_and_among_others(spark):
    rows = list(CASES) * 3 + [GOOD] * 500
    df = spark.createDataFrame([(k, r, "x") for k, r in enumerate(rows)], "id long, raw string, reason string")
    got = {r["id"]: r["reason"] for r in B.parse_records(df, "raw", ["id"]).collect()}
    assert len(got) == len(rows)
    assert [got[k] for k in range(len(CASES))] == list(CASES.values())
    assert all(got[k] == CASES[r] for k, r in enumerate(rows))


def test_fields_are_unquoted_and_trimmed():
    assert B.split_strictly(GOOD) == ["7", "Leek Pie", 'Oat, Bran "Wild"', "left", "0.5", "2016-02-29 23:59:59"]
    assert B.split_strictly(' "a\tb " ,, c ') == ["a\tb", "", "c"]
    assert B.split_strictly("") == [""] and B.split_strictly('""') == [""] and B.split_strictly(",") == ["", ""]


# any text at all: the columnar path must say what the strict parser says
pieces = st.sampled_from(["7", "left", "tie", ",", '"', '""', " ", "\t", "\n", "\r", "a", "1.5", "2016-01-01 00:00:00", "é", "\x00", "'"])
fields = st.sampled_from(["7", "left", '"left"', ' "a,b"', "", '""', '"a""b"', "1.5", "2016-01-01 00:00:00", '"x', "\r"])
records = st.one_of(st.lists(pieces, max_size=14).map("".join), st.lists(fields, min_size=6, max_size=6).map(",".join), st.just(GOOD))


@settings(max_examples=150, deadline=None)
@given(st.lists(records, max_size=30), st.sampled_from([1, 3, 4096]))
def test_columnar_path_agrees_with_the_strict_one(rows, block):
    grammar = B.Grammar(B.COMPARISON_RECORD.rules, block=block)
    columns, reasons = B.read_batch(pa.array(rows, pa.string()), grammar)
    for k, row in enumerate(rows):
        fields, reason = B.diagnose(row, grammar)
        assert reasons[k].as_py() == reason
        assert [c[k].as_py() for c in columns] == (fields or [None] * 6)


def test_typed_and_rejected_share_all_rows(spark):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(CASES)], "id long, raw string")
    parsed = B.parse_records(df, "raw", ["id"])
    assert B.typed(parsed).count() + B.rejected(parsed).count() == len(CASES)
    one = B.typed(parsed).filter("id = 0").first()
    assert (one["ord"], one["right"], one["weight"], str(one["judged_at"])) == (7, 'Oat, Bran "Wild"', 0.5, "2016-02-29 23:59:59")
    assert B.parse_records(df.limit(0), "raw", ["id"]).count() == 0
    long = B.typed(B.parse_records(df.limit(1).select("id", F.regexp_replace("raw", "^7", "9" * 20).alias("raw")), "raw", ["id"])).first()
    assert (long["ord"], long["ord_text"]) == (None, "9" * 20)
    with pytest.raises(ValueError):
        B.parse_records(df.withColumnRenamed("id", "left"), "raw", ["left"])


def test_a_very_long_record_and_a_table_of_bad_ones(spark):
    long = "7," + "a" * 300_000 + ",b,left,1,2016-01-01 00:00:00"
    df = spark.createDataFrame([(0, long), (1, '"' + "x" * 300_000)], "id long, raw string")
    assert {r["id"]: r["reason"] for r in B.parse_records(df, "raw", ["id"]).select("id", "reason").collect()} == {0: None, 1: "quoting"}
    bad = spark.range(3000).select("id", F.lit("x").alias("raw"))
    assert B.parse_records(bad, "raw", ["id"]).filter("reason = 'column_count'").count() == 3000


def test_column_check(spark):
    values = ["left", " RIGHT\t", "tie", None, "", " ", "lefft", "left\n", "left​", "lеft"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "ord long, winner string")
    assert {r["ord"] for r in B.check_column(df, "winner", ["ord"]).collect()} == set(range(3, 10))
    assert B.check_column(df.limit(0), "winner", ["ord"]).count() == 0


@pytest.mark.parametrize("n_bad", [0, 1, 5, 40])
def test_bad_records_are_isolated_by_halving(n_bad):
    """Nothing is read record by record but what halving leaves: n bad of 4,096 cost about n log n reads and at most 8 strict records each."""
    at = {(k * 997 + 5) % 4096 for k in range(n_bad)}
    rows = pa.array(["7,a" if k in at else GOOD for k in range(4096)])
    sizes, strict = [], []

    def read(records, grammar):
        sizes.append(len(records))
        return B.read_block(records, grammar)

    _, reasons = B.read_batch(rows, B.COMPARISON_RECORD, read)
    assert {k for k, r in enumerate(reasons.to_pylist()) if r} == at
    assert sizes[0] == 4096 and len(sizes) <= 1 + 2 * n_bad * 10
    assert len(sizes) == 1 or sum(sizes) <= 4096 * (2 + 10)


def test_blocks_shrink_and_grow_with_what_was_refused():
    rows = pa.array(["7,a" if k < 2048 and k % 16 == 3 else GOOD for k in range(16384)])
    sizes = []
    list(B.bisect_all(len(rows), lambda i, j: (sizes.append(j - i), B.read_block(rows.slice(i, j - i), B.COMPARISON_RECORD))[1], 1024, 4))
    assert sum(sizes) < 2.2 * len(rows) and max(sizes[-3:]) == 1024
