"""Comparison logs and ratings derived from the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.notation import FROM, TO, code_of
from ..operators.log import Log, prepare, winner_code
from ..operators.reliability import ratings
from ..operators.skew import label_key
from ..session import table


def events_log(spark: SparkSession, sf_dir: str, weighted: bool = False, by: tuple[str, ...] = ()) -> Log:
    """Each event against the user's next of another type; the greater value wins, the same value class is a draw."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.lead("event_type").over(w).alias("nt"), F.lead("value").over(w).alias("nv"))
    winner = F.when(F.floor(F.col("value") / 25) == F.floor(F.col("nv") / 25), 0).when(F.col("value") > F.col("nv"), 1).otherwise(2)
    rows = e.filter("nt <> event_type").select(F.col("event_type").alias("left"), F.col("nt").alias("right"), winner.alias("winner"), ((1 + F.col("event_id") % 4) / 2).alias("w"), F.col("event_id").alias("ord"), (F.col("user_id") % 3).alias("grp"))
    return prepare(rows, weight="w" if weighted else None, order="ord", by=by)


def brand_log(spark: SparkSession, sf_dir: str) -> Log:
    """Brands of two lines of an order; the greater quantity wins."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    lines = lines.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    a = lines.select("l_orderkey", F.col("l_linenumber").alias("na"), F.col("p_brand").alias("left"), F.col("l_quantity").alias("qa"))
    b = lines.select("l_orderkey", F.col("l_linenumber").alias("nb"), F.col("p_brand").alias("right"), F.col("l_quantity").alias("qb"))
    pairs = a.join(b, "l_orderkey").filter("na < nb and `left` <> `right`")
    return prepare(pairs.select("left", "right", F.when(F.col("qa") == F.col("qb"), 0).when(F.col("qa") > F.col("qb"), 1).otherwise(2).alias("winner")))


def food_log(spark: SparkSession, sf_dir: str) -> Log:
    """The log of dishes: each number once, labels without letter case and outer blanks, valid outcomes only, unusable weights as 1.

    Nearly every number is different, so combining before the shuffle would only cost: rows go to their number's partition as they are, and labels are
    cleaned and repeated deliveries told apart there. Of deliveries that differ, the least in (labels, outcome, weight) counts.
    """
    rows = table(spark, sf_dir, "food").select("ord", "left", "right", "winner", "weight").repartition("ord")
    code = winner_code(F.btrim("winner", F.lit(" \t")))
    clean = rows.select("ord", label_key("left").alias("left"), label_key("right").alias("right"), code.alias("winner"), F.when(F.isnan("weight"), 1.0).otherwise(F.coalesce("weight", F.lit(1.0))).alias("w"))
    once = clean.filter("winner is not null").groupBy("ord").agg(F.min(F.struct("left", "right", "winner", "w")).alias("r")).select("ord", "r.*")
    return prepare(once, weight="w", order="ord")


def coding_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes 1 to 5 in any notation, as digits, of the latest sheet of each rater; a unit is a cell of a sheet."""
    w = Window.partitionBy("sheet_id", "rater").orderBy(F.desc("coded_at"), F.desc("received_at"))
    last = table(spark, sf_dir, "codings").withColumn("n", F.row_number().over(w)).filter("n = 1")
    cells = [f"c{k}" for k in range(12)]
    long = last.unpivot(["sheet_id", "rater"], cells, "cell", "value")
    return ratings(long.select(F.concat_ws(":", "sheet_id", "cell").alias("unit"), "rater", code_of("value").alias("value")))


def order_ratings(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """Lines of an order as ratings of it."""
    return ratings(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("rater"), F.col(column).cast("string").alias("value")))


_OUTCOME = "CASE WHEN {0} THEN 0 WHEN {1} THEN 1 ELSE 2 END AS winner"

EVENTS_SQL = f"""
 nexts AS (SELECT event_id, user_id, event_type, value, lead(event_type) OVER w AS nt, lead(value) OVER w AS nv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 log AS (SELECT event_type AS "left", nt AS "right", {_OUTCOME.format('floor(value / 25) = floor(nv / 25)', 'value > nv')}, {{weight}} AS weight, event_id AS ord, user_id % 3 AS grp FROM nexts WHERE nt <> event_type)"""
EVENTS, EVENTS_WEIGHTED = EVENTS_SQL.format(weight="1.0::DOUBLE"), EVENTS_SQL.format(weight="(1 + event_id % 4) / 2.0::DOUBLE")
BRANDS = f"""
 lines AS (SELECT l_orderkey, l_linenumber, l_quantity, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
 log AS (SELECT a.p_brand AS "left", b.p_brand AS "right", {_OUTCOME.format('a.l_quantity = b.l_quantity', 'a.l_quantity > b.l_quantity')}, 1.0::DOUBLE AS weight, 0 AS ord
  FROM lines a JOIN lines b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.p_brand <> b.p_brand)"""
_TRIM = "lower(trim({0}, ' ' || chr(9)))"
FOOD = f"""
 log AS (SELECT {_TRIM.format('"left"')} AS "left", {_TRIM.format('"right"')} AS "right", CASE {_TRIM.format('winner')} WHEN 'left' THEN 1 WHEN 'right' THEN 2 ELSE 0 END AS winner,
   CASE WHEN weight IS NULL OR isnan(weight) THEN 1.0 ELSE weight END AS weight, ord
  FROM (SELECT DISTINCT ON (ord) * FROM food) WHERE {_TRIM.format('winner')} IN ('left', 'right', 'tie') AND "left" IS NOT NULL AND "right" IS NOT NULL)"""
#: a code in any notation, of a column v: a whole number that is alone, or in round or square brackets
_READ = "translate(v, '" + FROM + "', '" + TO + "')"
_NUMBER = "[+]?0*([1-5])(?:[.,]0*)?"
CODE = "try_cast(coalesce(" + ", ".join(f"nullif(regexp_extract({_READ}, '^\\s*{shape.format(_NUMBER)}\\s*$', 1), '')" for shape in ("{0}", "[(]\\s*{0}\\s*[)]", "\\[\\s*{0}\\s*\\]")) + ") AS BIGINT)"
CODINGS = f"""
 last AS (SELECT DISTINCT ON (sheet_id, rater) * FROM codings ORDER BY sheet_id, rater, coded_at DESC, received_at DESC),
 rated AS (SELECT sheet_id || ':' || cell AS unit, rater, cast(code AS VARCHAR) AS value FROM
  (SELECT *, {CODE} AS code FROM (UNPIVOT last ON c0, c1, c2, c3, c4, c5, c6, c7, c8, c9, c10, c11 INTO NAME cell VALUE v)) WHERE code IS NOT NULL)"""
ORDERS = " rated AS (SELECT l_orderkey AS unit, l_linenumber AS rater, cast({0} AS VARCHAR) AS value FROM lineitem WHERE {0} IS NOT NULL)"
