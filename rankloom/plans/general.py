"""Queries of the general data-preparation problems: rows that fail to parse (p4) and keys that hold most records (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import badrows, skew
from ..session import table


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return badrows.parse_records(table(spark, sf_dir, "food_raw"), "raw_line", ["raw_id"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = badrows.rejected(_parsed(spark, sf_dir)).select(F.lit("food_raw").alias("origin"), F.col("raw_id").alias("row_id"), "reason")
    log = badrows.check_column(table(spark, sf_dir, "food"), "winner", ["ord"]).select(F.lit("food").alias("origin"), F.col("ord").alias("row_id"), "reason")
    return raw.unionAll(log).distinct()


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return badrows.typed(_parsed(spark, sf_dir))


def p4_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = badrows.parse_records(table(spark, sf_dir, "food_raw"), "raw_line", ["feed"])
    return parsed.groupBy("feed", F.coalesce("reason", F.lit("loaded")).alias("outcome")).agg(F.count("*").alias("n"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.heavy_labels(p5_results(spark, sf_dir))


def p5_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.label_results(table(spark, sf_dir, "food"), table(spark, sf_dir, "food_items"))


def p5_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the log matched with its left dish, without a combinable step before: rows by course and side of the winner."""
    log = table(spark, sf_dir, "food").select(skew.label_key("left").alias("key"), F.lower(F.btrim("winner", F.lit(" \t"))).alias("outcome"))
    items = table(spark, sf_dir, "food_items").select(skew.label_key("item").alias("key"), "course").dropDuplicates(["key"])
    joined = skew.balanced_join(log, items, ["key"])
    return joined.groupBy("course").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "left").alias("wins"))


QUERIES = {f.__name__: f for f in (p4_found, p4_loaded, p4_reasons, p5_found, p5_results, p5_courses)}

_BLANKS = "' ' || chr(9)"
_KEY = "lower(trim({0}, " + _BLANKS + "))"
_BAD_WINNER = f"(winner IS NULL OR lower(trim(winner, {_BLANKS})) NOT IN ('left', 'right', 'tie'))"
#: A field of a record with nothing wrong in its quoting, and the whole record: any number of such fields.
_FIELD = r"""[ \t]*("([^"]|"")*"[ \t]*|[^",]*)"""
_PARSED = rf"""
 base AS (SELECT raw_id, feed, raw_line, regexp_replace(raw_line, '\r\z', '') AS line FROM food_raw),
 shaped AS (SELECT *, regexp_full_match(line, '{_FIELD}(,{_FIELD})*') AS quoted_well FROM base),
 cells AS (SELECT *, list_transform(regexp_extract_all(',' || line, ',({_FIELD})', 1), lambda f: trim(f, {_BLANKS})) AS raw_cells FROM shaped),
 split AS (SELECT *, list_transform(raw_cells, lambda f: trim(CASE WHEN starts_with(f, '"') THEN replace(f[2:-2], '""', '"') ELSE f END, {_BLANKS})) AS f FROM cells),
 told AS (SELECT *, CASE WHEN NOT quoted_well THEN 'quoting' WHEN len(f) <> 6 THEN 'column_count'
   WHEN regexp_full_match(f[1], '[0-9]+') AND f[2] <> '' AND f[3] <> '' AND lower(f[4]) IN ('left', 'right', 'tie')
    AND regexp_full_match(f[5], '([0-9]+([.][0-9]+)?)?') AND regexp_full_match(f[6], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}')
    AND try_cast(f[6] AS TIMESTAMP) IS NOT NULL THEN NULL ELSE 'value' END AS reason FROM split)"""
_LABELS = f"""
 names AS (SELECT {_KEY.format('item')} AS key, item FROM food_items),
 sides AS (SELECT 'left' AS side, "left" AS label, "right" AS opponent, winner FROM food UNION ALL SELECT 'right', "right", "left", winner FROM food),
 res AS (SELECT side, coalesce(item, label) AS item, count(*) AS n,
   cast(sum(CASE WHEN lower(trim(winner, {_BLANKS})) = side THEN 1 ELSE 0 END) AS BIGINT) AS wins, cast(sum(CASE WHEN lower(trim(winner, {_BLANKS})) = 'tie' THEN 1 ELSE 0 END) AS BIGINT) AS ties,
   count(DISTINCT {_KEY.format('opponent')}) AS opponents
  FROM sides LEFT JOIN names ON {_KEY.format('label')} = key GROUP BY ALL)"""

ORACLES = {
    "p4_found": f"WITH {_PARSED} SELECT 'food_raw' AS origin, raw_id AS row_id, reason FROM told WHERE reason IS NOT NULL UNION SELECT 'food', ord, 'value' FROM food WHERE {_BAD_WINNER}",
    "p4_loaded": f"WITH {_PARSED} SELECT raw_id, try_cast(f[1] AS BIGINT) AS ord, f[1] AS ord_text, f[2] AS \"left\", f[3] AS \"right\", lower(f[4]) AS winner, try_cast(f[5] AS DOUBLE) AS weight, try_cast(f[6] AS TIMESTAMP) AS judged_at FROM told WHERE reason IS NULL",
    "p4_reasons": f"WITH {_PARSED} SELECT feed, coalesce(reason, 'loaded') AS outcome, count(*) AS n FROM told GROUP BY ALL",
    "p5_found": f"WITH {_LABELS} SELECT side, item FROM res JOIN (SELECT count(*) AS total FROM food) ON true WHERE item IS NOT NULL AND n >= 0.02 * total",
    "p5_results": f"WITH {_LABELS} SELECT * FROM res",
    "p5_courses": f"SELECT course, count(*) AS n, count(*) FILTER (lower(trim(winner, {_BLANKS})) = 'left') AS wins FROM food LEFT JOIN (SELECT {_KEY.format('item')} AS key, course FROM food_items) ON {_KEY.format(chr(34)+'left'+chr(34))} = key GROUP BY ALL",
}
