"""Reading and writing logs, ratings and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.log import ARENA_WINNERS, Log, prepare


def read_comparisons_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A comparison CSV with a header (left, right, winner, ...), all strings; quoted fields may hold line breaks, empty ones are null."""
    return spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=True, escape='"')


def with_file_order(df: DataFrame) -> DataFrame:
    """`ord` in the order of a file read in one piece or in order of its splits."""
    return df.withColumn("ord", F.monotonically_increasing_id())


def read_ratings_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(unit, rater, value) of a CSV without header, a row for each rater and a column for each unit; empty is missing."""
    wide = spark.read.csv(path, header=False, sep=sep, inferSchema=False, escape='"').withColumn("rater", F.monotonically_increasing_id())
    return melt_ratings(wide, "rater")


def melt_ratings(wide: DataFrame, rater: str) -> DataFrame:
    """(unit, rater, value) of a wide table; units are numbered by column, from 0."""
    units = [c for c in wide.columns if c != rater]
    strings = wide.select(F.col(rater).alias("rater"), *(F.col(f"`{c}`").cast("string").alias(str(k)) for k, c in enumerate(units)))
    return strings.unpivot(["rater"], [str(k) for k in range(len(units))], "unit", "value").select(F.col("unit").cast("int").alias("unit"), "rater", "value").filter("value is not null")


def read_arena_json(spark: SparkSession, path: str, sampled_only: bool = True) -> Log:
    """A dump of anonymous battles (model_a, model_b, winner, anony, dedup_tag.sampled): anonymous ones, and of repeated ones those sampled."""
    schema = "model_a string, model_b string, winner string, anony boolean, dedup_tag struct<sampled: boolean>, tstamp double"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).filter("anony")
    if sampled_only:
        rows = rows.filter(F.coalesce("dedup_tag.sampled", F.lit(False)))
    return prepare(rows, "model_a", "model_b", "winner", order="tstamp", spellings=ARENA_WINNERS)


def write_csv(df: DataFrame, path: str) -> None:
    """One table as CSV files with a header, in the order of the table; blanks and quotes within fields stay as they are."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def from_rows(spark: SparkSession, left: list, right: list, winners: list, weights: list | None = None) -> Log:
    """A log of parallel lists of one length, in their order; winners as spelled (left, right, tie) or coded (1, 2, 0)."""
    if not len(left) == len(right) == len(winners) == len(weights if weights is not None else left):
        raise ValueError("lists of different lengths")
    code = {"left": 1, "right": 2, "tie": 0}
    rows = [(str(a), str(b), code.get(w, w) if isinstance(w, str) else int(w), float(1 if weights is None else weights[k]), k) for k, (a, b, w) in enumerate(zip(left, right, winners))]
    df = spark.createDataFrame(rows, "left string, right string, winner int, weight double, ord bigint")
    return prepare(df, weight="weight", order="ord")
