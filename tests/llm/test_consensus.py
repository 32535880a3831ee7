import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import consensus as C


def test_codes(spark):
    good = {"3": 3, " 3 ": 3, "03": 3, "3.": 3, "3.0": 3, "3.00": 3, "(3)": 3, "３": 3, "（２）": 2, "[4]": 4, "+5": 5, "①": 1}
    bad = [None, "", " ", "-", "0", "6", "9", "35", "2.5", "3-4", "2/3", "-1", "x", "n/a", "(3", "3)", "1 2"]
    df = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string")
    assert [r["c"] for r in df.select(C.code_of("t").alias("c")).collect()] == [*good.values(), *[None] * len(bad)]


def test_digamma():
    assert C.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525890], abs=1e-9)


def simulate(spark, seed=1, sheets=250):
    """Good coders, one whose scale is reversed, one shifted, one always 3, two at random."""
    rng = np.random.default_rng(seed)
    truth = rng.integers(1, 6, (sheets, 2))
    kinds = {"good1": 0.9, "good2": 0.85, "good3": 0.85, "reversed": 0.9, "shifted": 0.9, "always3": 0, "random1": 0, "random2": 0}
    rows = []
    for s in range(sheets):
        for name in rng.choice(list(kinds), 5, replace=False):
            codes = []
            for t in truth[s]:
                base = {"reversed": 6 - t, "shifted": min(5, t + 1), "always3": 3}.get(name, t)
                codes.append(str(base) if name == "always3" or rng.random() < kinds[name] else str(rng.integers(1, 6)))
            rows.append((s, str(name), *codes, s))
    return truth, spark.createDataFrame(rows, "sheet_id long, rater string, c0 string, c1 string, coded_at long").withColumns({"received_at": F.lit(0), "label": F.lit("clash")})


def test_beats_the_majority_and_knows_the_raters(spark):
    truth, codings = simulate(spark)
    labels, model = C.consensus(codings, ["c0", "c1"])
    rows = labels.collect()
    right = np.mean([r["label"] == truth[r["sheet_id"]][r["unit"]] for r in rows])
    assert len(rows) == truth.size and right > 0.88
    told = {r["rater"]: (r["reliability"], r["low"], r["high"]) for r in C.raters_frame(codings, model).collect()}
    assert min(told[g][1] for g in ("good1", "good2", "good3")) > max(told[g][2] for g in ("reversed", "shifted", "always3", "random1", "random2"))
    assert all(low <= mean <= high for mean, low, high in told.values())


def test_latest_sheet_counts(spark):
    rows = [(1, "r", "2", "1", 5, 9), (1, "r", "3", None, 7, 8), (1, "r", "3", None, 7, 9), (1, None, "4", "4", 9, 9), (None, "r", "4", "4", 9, 9), (2, "q", "x", None, 1, 1)]
    df = spark.createDataFrame(rows, "sheet_id long, rater string, c0 string, c1 string, coded_at long, received_at long")
    got = {(r["sheet"], r["rater"]): r["codes"] for r in C.latest_sheets(df, ["c0", "c1"]).collect()}
    assert got == {(1, "r"): [3, None], (2, "q"): [None, None]}
    labels, _ = C.consensus(df, ["c0", "c1"])
    assert [(r["sheet_id"], r["unit"], r["label"], r["codes"]) for r in labels.collect()] == [(1, 0, 3, 1)]


def test_empty(spark):
    df = spark.createDataFrame([], "sheet_id long, rater string, c0 string, coded_at long, received_at long")
    labels, model = C.consensus(df, ["c0"])
    assert labels.count() == 0 and model.raters == [] and C.raters_frame(df, model).count() == 0
    with pytest.raises(ValueError):
        C.pack_sheets(C.latest_sheets(simulate(spark)[1], ["c0", "c1"]), 2, max_raters=3)


def test_krippendorff_agrees_with_the_core_operator(spark):
    from rankloom.operators import reliability as rel

    _, codings = simulate(spark, seed=2, sheets=40)
    _, model = C.consensus(codings, ["c0", "c1"])
    long = codings.unpivot(["sheet_id", "rater"], ["c0", "c1"], "cell", "value").withColumn("unit", F.concat_ws(":", "sheet_id", "cell"))
    for d in ("nominal", "ordinal", "interval"):
        assert C.krippendorff(model.coincidence, d)[0] == pytest.approx(rel.alpha(rel.ratings(long), d).first()["alpha"], abs=1e-9)


def test_parameters_in_a_table_give_the_same(spark):
    """More annotators than the driver may hold: the same model by joins."""
    _, codings = simulate(spark, seed=5, sheets=40)
    near, model = C.consensus(codings, ["c0", "c1"])
    far, joined = C.consensus(codings, ["c0", "c1"], max_raters=3)
    key = lambda df: {(r["sheet_id"], r["unit"]): (r["label"], r["codes"], r["different"], round(r["confidence"], 6)) for r in df.collect()}
    assert key(near) == key(far) and joined.iterations == model.iterations
    assert joined.coincidence == pytest.approx(model.coincidence)
    a, b = ({r["rater"]: r for r in C.raters_frame(codings, m).collect()} for m in (model, joined))
    assert {r: b[r]["reliability"] for r in b} == pytest.approx({r: a[r]["reliability"] for r in a})
    assert all(b[r]["low"] == pytest.approx(a[r]["low"], abs=0.02) and b[r]["codes"] == pytest.approx(a[r]["codes"]) for r in b)
