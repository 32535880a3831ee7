"""Queries of the llm problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import views
from ..session import cut, table
from . import consensus, leakage, offence, packing, quantiles, stuffing


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "time_limits").select("algorithm", "solver", F.col("pct").cast("bigint").alias("pct"), "limit_s")


def _day_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.sketch_groups(quantiles.timings_once(table(spark, sf_dir, "rust_python")), ["algorithm", "solver", "day"], "time")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and 95th percentiles of days, and of weeks from the sketches of their days."""
    keys = ["algorithm", "solver", "run_span"]
    days = cut(_day_sketches(spark, sf_dir))
    weeks = quantiles.merge_sketches(days.select("algorithm", "solver", quantiles.iso_week(F.to_date("day")).alias("run_span"), "sketch"), keys)
    spans = days.withColumnRenamed("day", "run_span").unionByName(weeks)
    return quantiles.percentiles(spans, keys, [50, 95]).withColumn("pct", F.col("pct").cast("bigint"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = p2_percentiles(spark, sf_dir)
    return read.join(_limits(spark, sf_dir), ["algorithm", "solver", "pct"]).filter("value > limit_s").select("algorithm", "solver", "run_span", "pct")


def p3_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_ranking(spark, sf_dir).select("item", *(F.round(c, 4).alias(c) for c in ("offence", "defence", "strength")))


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offence.ranking(table(spark, sf_dir, "food"), table(spark, sf_dir, "food_items"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report is the twelve strongest."""
    return p3_ranking(spark, sf_dir).orderBy(F.desc("strength"), "item").limit(12).select("item")


def _consensus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, consensus.Model]:
    codings = table(spark, sf_dir, "codings")
    return codings, *consensus.consensus(codings, consensus.unit_columns(codings))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, labelled, _ = _consensus(spark, sf_dir)
    return labelled.filter("codes >= 3 and different > 1").select("sheet_id", "unit", "label")


def p1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir)[1]


def p1_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    codings, _, model = _consensus(spark, sf_dir)
    return consensus.raters_frame(codings, model)


def p1_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Krippendorff's alpha of all units under three distances."""
    _, _, model = _consensus(spark, sf_dir)
    pairable = int(round(model.coincidence.sum()))
    rows = [(d, round(consensus.krippendorff(model.coincidence, d)[0], 6), pairable) for d in ("nominal", "ordinal", "interval")]
    return spark.createDataFrame(rows, "distance string, alpha double, pairable bigint")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any packing: no container overfull, every token of every text placed once."""
    return packing.audit(cut(p6_containers(spark, sf_dir)), "doc_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.split_texts(p6_containers(spark, sf_dir), "doc_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.judge(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.found(p8_words(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_labels, p1_raters, p1_agreement, p2_found, p2_percentiles, p3_found, p3_ranking, p3_strengths,
        p6_found, p6_containers, p6_audit, p7_found, p7_leaks, p8_found, p8_words,
    )
}

_RUNS = """
 good AS (SELECT * FROM rust_python WHERE time > 0 AND isfinite(time)),
 runs AS (SELECT DISTINCT ON (run_id) * FROM good WHERE run_id IS NOT NULL UNION ALL SELECT * FROM good WHERE run_id IS NULL),
 spans AS (SELECT algorithm, solver, time, strftime(started_at, '%Y-%m-%d') AS run_span FROM runs
  UNION ALL SELECT algorithm, solver, time, strftime(started_at, '%G-W%V') FROM runs)"""

_UNITS = f"""
 latest AS (SELECT DISTINCT ON (sheet_id, rater) * FROM codings ORDER BY sheet_id, rater, coded_at DESC, received_at DESC),
 long AS (SELECT sheet_id, name AS unit, {views.CODE} AS c FROM (UNPIVOT latest ON c0, c1, c2, c3, c4, c5, c6, c7, c8, c9, c10, c11 INTO NAME name VALUE v)),
 kept AS (SELECT * FROM long WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY sheet_id, unit) > 1),
 n AS (SELECT sheet_id, unit, c, count(*) AS n, any_value(m) AS m FROM (SELECT *, count(*) OVER (PARTITION BY sheet_id, unit) AS m FROM kept) GROUP BY ALL),
 co AS (SELECT a.c AS c, b.c AS k, sum(a.n * (b.n - CASE WHEN a.c = b.c THEN 1 ELSE 0 END) / (a.m - 1.0)) AS o FROM n a JOIN n b USING (sheet_id, unit) GROUP BY ALL),
 marg AS (SELECT c, sum(o) AS n, sum(sum(o)) OVER (ORDER BY c) - sum(o) / 2 AS place FROM co GROUP BY c),
 tot AS (SELECT sum(n) AS t FROM marg),
 pairs AS (SELECT a.c AS c, b.c AS k, (a.n * b.n - CASE WHEN a.c = b.c THEN a.n ELSE 0 END) / (t - 1) AS e, a.place AS pc, b.place AS pk FROM marg a, marg b, tot),
 dist AS (SELECT 'nominal' AS distance, c, k, e, CASE WHEN c = k THEN 0.0 ELSE 1.0 END AS d FROM pairs UNION ALL SELECT 'ordinal', c, k, e, power(pc - pk, 2) FROM pairs UNION ALL SELECT 'interval', c, k, e, power(c - k, 2) FROM pairs)"""

_KEY = "lower(trim({0}, ' ' || chr(9)))"
#: the scaling as lists of rows and columns, a thousand iterations from ones, which is far beyond where it comes to rest on these tables
_SCALED = f"""
 names AS (SELECT {_KEY.format('item')} AS key, min(item_id) AS id FROM food_items GROUP BY 1),
 cmp AS (SELECT DISTINCT ON (ord) a.id AS i, b.id AS j, CASE {_KEY.format('winner')} WHEN 'left' THEN 1.0::DOUBLE WHEN 'right' THEN 0.0 ELSE 0.5 END AS s
  FROM food JOIN names a ON a.key = {_KEY.format('"left"')} JOIN names b ON b.key = {_KEY.format('"right"')} WHERE ord IS NOT NULL AND a.id <> b.id AND {_KEY.format('winner')} IN ('left', 'right', 'tie')),
 half AS (SELECT i, j, sum(s) AS w, count(*) AS n FROM cmp GROUP BY ALL UNION ALL SELECT j, i, sum(1 - s), count(*) FROM cmp GROUP BY ALL),
 pairs AS (SELECT i, j, sum(w) + 0.01::DOUBLE * sum(n) AS w, sum(n) AS n FROM half GROUP BY ALL),
 k AS (SELECT i AS id, row_number() OVER (ORDER BY i) AS k, 0.1::DOUBLE * sum(n) AS own FROM pairs GROUP BY i),
 cells AS (SELECT a.k AS i, b.k AS j, CASE WHEN a.k = b.k THEN a.own ELSE coalesce(w, 0) END AS w FROM k a CROSS JOIN k b LEFT JOIN pairs p ON p.i = a.id AND p.j = b.id),
 m AS (SELECT list(r ORDER BY i) AS mr, (SELECT list(c ORDER BY j) FROM (SELECT j, list(w ORDER BY i) AS c FROM cells GROUP BY j)) AS mc, count(*) AS n FROM (SELECT i, list(w ORDER BY j) AS r FROM cells GROUP BY i)),
 st AS (SELECT 0 AS step, list_transform(range(n), lambda x: 1.0::DOUBLE) AS o, list_transform(range(n), lambda x: 1.0::DOUBLE) AS d FROM m
  UNION ALL SELECT step + 1, list_transform(mr, lambda r: list_sum(list_transform(list_zip(r, e), lambda z: z[1] / z[2]))), e
  FROM (SELECT step, m.mr, list_transform(mc, lambda c: list_sum(list_transform(list_zip(c, o), lambda z: z[1] / z[2]))) AS e FROM st, m WHERE step < 1000)),
 last AS (SELECT o, d, exp(list_avg(list_transform(list_zip(o, d), lambda z: ln(z[1] / z[2]))) / 2) AS level FROM st ORDER BY step DESC LIMIT 1),
 told AS (SELECT item, coalesce(o[k.k] / level, 1) AS offence, coalesce(d[k.k] * level, 1) AS defence, coalesce(o[k.k] / d[k.k] / level / level, 1) AS strength
  FROM (SELECT DISTINCT ON (item_id) item_id, item FROM food_items) LEFT JOIN k ON id = item_id, last)"""

ORACLES = {
    "p3_strengths": f"WITH RECURSIVE {_SCALED} SELECT item, round(offence, 4) AS offence, round(defence, 4) AS defence, round(strength, 4) AS strength FROM told",
    "p3_found": f"WITH RECURSIVE {_SCALED} SELECT item FROM told ORDER BY strength DESC, item LIMIT 12",
    "p6_audit": "SELECT count(DISTINCT doc_id) AS keys, 0::BIGINT AS overfull, 0::BIGINT AS gaps FROM documents",
    "p1_agreement": f"""WITH {_UNITS} SELECT distance, round(1 - sum(coalesce(o, 0) * d) / sum(e * d), 6) AS alpha, cast(round(any_value(t)) AS BIGINT) AS pairable
 FROM dist LEFT JOIN co USING (c, k), tot GROUP BY distance""",
    "p2_found": f"""WITH {_RUNS}, q AS (SELECT algorithm, solver, run_span, 50 AS pct, quantile_disc(time, 0.5) AS v FROM spans GROUP BY ALL
  UNION ALL SELECT algorithm, solver, run_span, 95, quantile_disc(time, 0.95) FROM spans GROUP BY ALL)
 SELECT algorithm, solver, run_span, cast(pct AS BIGINT) AS pct FROM q JOIN time_limits USING (algorithm, solver, pct) WHERE v > limit_s""",
}
