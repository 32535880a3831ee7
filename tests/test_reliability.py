import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import rankloom as R
from rankloom.errors import TooLargeError
from rankloom.operators import numbering
from rankloom.operators import reliability as rel
from rankloom.operators import report, resampling

# fixed values: two rating matrices (raters x units, dots are missing) and published results
CODINGS = """1 2 3 3 2 1 4 1 2 . . .
1 2 3 3 2 2 4 1 2 5 . 3
. 3 3 3 2 3 4 2 2 5 1 .
1 2 3 3 2 4 4 1 2 5 1 ."""
GCL = """NN NN VBP VBP
. VBP VBP NN
NN VBP VBP NN
NN NN NN VBP"""


def rated(spark, text):
    rows = [(u, r, None if v == "." else v) for r, line in enumerate(text.split("\n")) for u, v in enumerate(line.split())]
    return R.ratings(spark.createDataFrame(rows, "unit int, rater int, value string"))


@pytest.mark.parametrize(
    "text, distance, expected",
    [
        (CODINGS, "nominal", 904 / 1216), (CODINGS, "ordinal", 0.8153875), (CODINGS, "interval", 0.8491071), (CODINGS, "ratio", 0.7974028), (GCL, "nominal", 0.0833333),
        ("1 2 3\n2 3 4", "nominal", -0.1538462), ("1 2 3\n2 3 4", "interval", 0.5454545), ("1 2\n2 4", "ratio", 0.1712707),
    ],
)
def test_alpha(spark, text, distance, expected):
    assert R.alpha(rated(spark, text), distance).first()["alpha"] == pytest.approx(expected, abs=1e-6)


def test_observed_and_expected(spark):
    r = R.alpha(rated(spark, CODINGS)).first()
    assert (r["observed"], r["expected"]) == (pytest.approx(8.0), pytest.approx(31.1794872))


def test_custom_distance_as_function_and_as_table(spark):
    data = rated(spark, "1 2 3\n2 3 4")
    assert R.alpha(data, rel.squared_difference).first()["alpha"] == pytest.approx(0.5454545, abs=1e-6)
    values = spark.createDataFrame([(str(a), str(b), float((a - b) ** 2)) for a in range(1, 5) for b in range(1, 5)], "c string, k string, delta double")
    assert R.alpha(data, values).first()["alpha"] == pytest.approx(0.5454545, abs=1e-6)
    with pytest.raises(R.UnknownDistanceError):
        R.alpha(data, "euclidean").collect()


def test_ordinal_and_interval_agree_on_two_steps(spark):
    data = rated(spark, "1 2\n2 3")
    assert R.alpha(data, "ordinal").first()["alpha"] == pytest.approx(R.alpha(data, "interval").first()["alpha"])


def test_nothing_to_compare(spark):
    with pytest.raises(R.InsufficientRatingsError):
        R.alpha(rated(spark, "1 .\n. 2"))
    with pytest.raises(R.InsufficientRatingsError):
        R.alpha(rated(spark, "1 .\n. 2").limit(0))
    r = R.alpha(rated(spark, "A A\nA A")).first()
    assert (r["alpha"], r["expected"]) == (1.0, 0.0)
    with pytest.raises(ValueError):
        resampling.alpha_bootstrap(rated(spark, "A A\nA A"), n_resamples=5)
    with pytest.raises(R.InsufficientRatingsError):
        resampling.alpha_bootstrap(rated(spark, "1 .\n. 2"), n_resamples=5)


def test_single_ratings_do_not_count_and_extra_columns_do_not_clash(spark):
    a = R.alpha(rated(spark, CODINGS)).first()["alpha"]
    more = rated(spark, CODINGS).unionByName(spark.createDataFrame([(99, 0, "7")], "unit int, rater int, value string")).withColumns({"n": F.lit(1), "m": F.lit("x"), "code": F.lit(2)})
    assert R.alpha(R.ratings(more)).first()["alpha"] == pytest.approx(a)
    with pytest.raises(R.MissingColumnError):
        R.ratings(more, value="code2")


def test_text_order_of_numbers_and_codes_of_texts(spark):
    values = {r["value"]: (r["code"], r["x"]) for r in rel.factorize(rel.unit_counts(rated(spark, "10 2\n2 10"))).collect()}
    assert values == {"10": (0, 10.0), "2": (1, 2.0)}
    values = {r["value"]: r["x"] for r in rel.factorize(rel.unit_counts(rated(spark, "b a\na b"))).collect()}
    assert values == {"a": 0.0, "b": 1.0}


def test_ratio_of_zeros_is_zero_distance(spark):
    assert math.isfinite(R.alpha(rated(spark, "0 -1\n0 1"), "ratio").first()["alpha"])


def test_alpha_bootstrap_band(spark):
    r = R.alpha_bootstrap(rated(spark, CODINGS), n_resamples=2000, seed=5).first()
    assert 0.5 < r["low"] < 0.68 and 0.82 < r["high"] < 0.92 and r["alpha"] == pytest.approx(904 / 1216)
    with pytest.raises(ValueError):
        R.alpha_bootstrap(rated(spark, CODINGS), n_resamples=0)
    with pytest.raises(ValueError):
        R.alpha_bootstrap(rated(spark, CODINGS), confidence=1.0)


def test_hash_draws_repeat(spark):
    a, b = ([r["alpha"] for r in resampling.alpha_distribution(rated(spark, CODINGS), n_resamples=5, seed=2, draws="hash", block=n)[0].orderBy("resample").collect()] for n in (1 << 20, 3))
    assert a == pytest.approx(b)


def test_report_and_histogram(spark):
    out = {r["metric"]: r["value"] for r in report.alpha_report(R.alpha(rated(spark, CODINGS))).collect()}
    assert set(out) == {"alpha", "observed", "expected"}
    values = spark.createDataFrame([(float(x),) for x in range(11)], "v double")
    bins = report.histogram(values, "v", 5).orderBy("bin").collect()
    assert [r["n"] for r in bins] == [2, 2, 2, 2, 3]
    assert [r["n"] for r in report.histogram(spark.createDataFrame([(3.0,)] * 2, "v double"), "v").collect()] == [2]
    assert report.histogram(values.limit(0), "v").count() == 0


@pytest.mark.parametrize("distance", ["nominal", "ordinal", "interval"])
def test_sums_equal_pairs_of_values(spark, distance):
    """The sums of squares against the same distance over pairs, with units of many ratings, repeated values and ties; and with texts."""
    rng = np.random.default_rng(3)
    for values in (["1", "2", "3.5", "10", "-4"], ["a", "b", "bb", "c"]):
        rows = [(int(u), int(r), str(rng.choice(values))) for u in range(60) for r in range(rng.integers(1, 9))]
        data = rel.ratings(spark.createDataFrame(rows, "unit int, rater int, value string"))
        counts = rel.cut(rel.unit_counts(data))
        pairs = rel.expected_pairs(rel.marginals(counts, rel.factorize(counts)), distance).join(rel.coincidence(counts), ["c", "k"], "left").fillna(0.0)
        told = pairs.agg(F.sum(F.col("o") * F.col("delta")), F.sum(F.col("e") * F.col("delta"))).first()
        assert rel.square_sums(counts, distance) == pytest.approx(tuple(told), rel=1e-9)


def test_many_different_values(spark, monkeypatch):
    """100,000 different values in 150,000 units: no pairs of values; in ranges and by fragment and replicate where they are too many for one task or to send."""
    data = rel.ratings(spark.range(300_000).select(F.expr("id div 2").alias("unit"), F.col("id").alias("rater"), ((F.col("id") * 7919) % 100_003).alias("value")))
    whole = {d: tuple(rel.alpha(data, d).first()) for d in ("nominal", "ordinal")}
    assert whole["nominal"][0] == pytest.approx(0, abs=0.01)
    monkeypatch.setattr(rel, "MAX_SENT", 10)
    monkeypatch.setattr(numbering.running_sums, "__defaults__", (1000,))
    assert tuple(rel.alpha(data, "ordinal").first()) == pytest.approx(whole["ordinal"], rel=1e-9)
    with pytest.raises(TooLargeError):
        rel.alpha(data, "ratio")
