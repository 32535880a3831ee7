"""Queries of the ranking, reliability and resampling operators over the tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import log as lg
from ..operators import distributed, matrices, ranking, reliability, report, resampling
from ..session import shared_folder, table
from ..sources import io
from ..streaming import live
from . import solver_sql as sql
from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(text: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if text:
            ORACLES[f.__name__] = "WITH RECURSIVE " + text
        return f

    return keep


def scored(df: DataFrame, places: int = 6, by: Sequence[str] = ()) -> DataFrame:
    return df.select(*by, "item", F.round("score", places).alias("score"))


_CELLS = ", ".join(f"c{k}" for k in range(12))
E, W, B, D = views.EVENTS, views.EVENTS_WEIGHTED, views.BRANDS, views.FOOD
_SCORE = "SELECT item, round(score, 6) AS score FROM "


@query(f"{E}, {sql.BY_ORDER} SELECT item, k FROM idx")
def item_index(s: SparkSession, d: str) -> DataFrame:
    return lg.item_index(views.events_log(s, d))


@query(f"{E}, {sql.BY_ORDER} SELECT a.k AS x, b.k AS y, winner, weight, ord FROM log JOIN idx a ON a.item = \"left\" JOIN idx b ON b.item = \"right\"")
def encode_log(s: SparkSession, d: str) -> DataFrame:
    log = views.events_log(s, d)
    return lg.encode(log, lg.item_index(log))


@query(f"{D} SELECT DISTINCT item FROM (SELECT \"left\" AS item FROM log UNION ALL SELECT \"right\" FROM log) WHERE item NOT IN (SELECT {views._TRIM.format('item')} FROM food_items)")
def unknown_items(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "food_items").select(F.lower("item").alias("item"))
    return lg.unknown_items(views.food_log(s, d), items)


def _edge_query(view: str) -> str:
    return f"{view}, {sql.EDGES} SELECT i, j, round(win, 6) AS win, round(tie, 6) AS tie FROM sums WHERE win > 0 OR tie > 0"


def _edges(log: lg.Log) -> DataFrame:
    return lg.edges(log).filter("win > 0 or tie > 0").select("i", "j", F.round("win", 6).alias("win"), F.round("tie", 6).alias("tie"))


@query(_edge_query(E))
def win_tie_edges(s: SparkSession, d: str) -> DataFrame:
    return _edges(views.events_log(s, d))


@query(_edge_query(B))
def win_tie_edges_brands(s: SparkSession, d: str) -> DataFrame:
    return _edges(views.brand_log(s, d))


@query(_edge_query(D))
def win_tie_edges_food(s: SparkSession, d: str) -> DataFrame:
    return _edges(views.food_log(s, d))


@query(f"{D}, {sql.EDGES}, {sql.BY_ORDER} SELECT a.item AS i, b.item AS j, round(coalesce(win, 0), 6) AS win, round(coalesce(tie, 0), 6) AS tie FROM idx a CROSS JOIN idx b LEFT JOIN sums s ON s.i = a.item AND s.j = b.item")
def win_tie_grid(s: SparkSession, d: str) -> DataFrame:
    return matrices.win_tie_grid(views.food_log(s, d)).select("i", "j", F.round("win", 6).alias("win"), F.round("tie", 6).alias("tie"))


@query(f"{W}, {sql.EDGES} SELECT i, j, round(2 * win + 0.25 * tie, 6) AS a FROM sums WHERE win > 0 OR tie > 0")
def combined_matrix(s: SparkSession, d: str) -> DataFrame:
    return matrices.combined(views.events_log(s, d, weighted=True), 2.0, 0.25).filter("a > 0").select("i", "j", F.round("a", 6).alias("a"))


_FRACTION = "fr AS (SELECT a.i, a.j, a.win / (a.win + coalesce(b.win, 0)) AS fraction FROM (SELECT x.i, x.j, coalesce(s.win, 0) AS win FROM (SELECT i, j FROM sums UNION SELECT j, i FROM sums) x LEFT JOIN sums s ON s.i = x.i AND s.j = x.j) a LEFT JOIN sums b ON a.i = b.j AND a.j = b.i WHERE a.win + coalesce(b.win, 0) > 0)"


@query(f"{B}, {sql.EDGES}, {_FRACTION} SELECT i, j, round(fraction, 6) AS fraction FROM fr")
def win_fraction(s: SparkSession, d: str) -> DataFrame:
    return matrices.win_fractions(views.brand_log(s, d)).select("i", "j", F.round("fraction", 6).alias("fraction"))


@query(f"{B}, {sql.EDGES}, {_FRACTION}, {sql.COUNTING}, best AS (SELECT item FROM counted ORDER BY score DESC, item LIMIT 15) SELECT i, j, round(fraction, 6) AS fraction FROM fr WHERE i IN (FROM best) AND j IN (FROM best)")
def top_k_matrix(s: SparkSession, d: str) -> DataFrame:
    log = views.brand_log(s, d)
    best = report.top(ranking.counting(log), 15)
    return matrices.restrict(matrices.win_fractions(log), best).select("i", "j", F.round("fraction", 6).alias("fraction"))


for _name, _view, _make in (
    ("", E, lambda s, d: views.events_log(s, d)),
    ("_weighted", W, lambda s, d: views.events_log(s, d, weighted=True)),
    ("_brands", B, lambda s, d: views.brand_log(s, d)),
    ("_food", D, lambda s, d: views.food_log(s, d)),
):

    def _counting(s: SparkSession, d: str, make: Callable = _make) -> DataFrame:
        return scored(ranking.counting(make(s, d)))

    def _awr(s: SparkSession, d: str, make: Callable = _make) -> DataFrame:
        return scored(ranking.average_win_rate(make(s, d)))

    _counting.__name__, _awr.__name__ = f"counting{_name}", f"average_win_rate{_name}"
    query(f"{_view}, {sql.COUNTING} {_SCORE} counted")(_counting)
    query(f"{_view}, {sql.AWR} {_SCORE} awr")(_awr)

_NO_TIES = E.replace("WHERE nt <> event_type)", "WHERE nt <> event_type AND floor(value / 25) <> floor(nv / 25))")


@query(f"{_NO_TIES}, {sql.COUNTING} {_SCORE} counted")
def counting_no_ties(s: SparkSession, d: str) -> DataFrame:
    return scored(ranking.counting(lg.without_ties(views.events_log(s, d))))


@query(f"{_NO_TIES}, {sql.AWR} {_SCORE} awr")
def average_win_rate_no_ties(s: SparkSession, d: str) -> DataFrame:
    return scored(ranking.average_win_rate(lg.without_ties(views.events_log(s, d))))


for _name, _view, _index, _make in (
    ("", E, sql.BY_ORDER, lambda s, d: views.events_log(s, d)),
    ("_brands", B, sql.BY_LABEL, lambda s, d: views.brand_log(s, d)),
):
    for _method, _text in (("bradley_terry", sql.bradley_terry()), ("newman", sql.newman()), ("eigen", sql.eigen()), ("pagerank", sql.pagerank())):

        def _solved(s: SparkSession, d: str, make: Callable = _make, method: str = _method) -> DataFrame:
            return scored(ranking.METHODS[method](make(s, d)), 4 if method == "newman" else 6)

        _solved.__name__ = f"{_method}{_name}"
        query(f"{_view}, {_index}, {_text}")(_solved)


@query(f"{D}, {sql.BY_ORDER}, {sql.pagerank()}")
def pagerank_food(s: SparkSession, d: str) -> DataFrame:
    return scored(ranking.pagerank(views.food_log(s, d)))


@query(f"{D}, {sql.BY_ORDER}, {sql.eigen()}")
def eigen_food(s: SparkSession, d: str) -> DataFrame:
    return scored(ranking.eigen(views.food_log(s, d)))


@query(f"{D}, {sql.BY_ORDER}, {sql.bradley_terry()}")
def bradley_terry_food(s: SparkSession, d: str) -> DataFrame:
    return scored(ranking.bradley_terry(views.food_log(s, d)))


@query(f"{E}, {sql.BY_ORDER}, {sql.bradley_terry('item, round(p[k + 1] / list_sum(p), 6) AS score')}")
def bradley_terry_normalised(s: SparkSession, d: str) -> DataFrame:
    scores = ranking.bradley_terry(views.events_log(s, d))
    total = scores.agg(F.sum("score").alias("t"))
    return scores.join(F.broadcast(total)).select("item", F.round(F.col("score") / F.col("t"), 6).alias("score"))


@query(f"{E}, {sql.BY_ORDER}, {sql.newman('DISTINCT round(v, 4) AS v, step::INT AS iterations')}")
def newman_v(s: SparkSession, d: str) -> DataFrame:
    return ranking.newman(views.events_log(s, d)).select(F.round("v", 4).alias("v"), "iterations").distinct()


@query(
    f"{E}, {sql.BY_ORDER}, bt AS (WITH RECURSIVE {E}, {sql.BY_ORDER}, {sql.bradley_terry('DISTINCT its AS iterations')}), ei AS (WITH RECURSIVE {E}, {sql.BY_ORDER}, {sql.eigen('DISTINCT step AS iterations')}), "
    f"pr AS (WITH RECURSIVE {E}, {sql.BY_ORDER}, {sql.pagerank('DISTINCT step AS iterations')}) SELECT 'bradley_terry' AS method, iterations::INT AS iterations FROM bt UNION ALL SELECT 'eigen', iterations FROM ei UNION ALL SELECT 'pagerank', iterations FROM pr"
)
def solver_iterations(s: SparkSession, d: str) -> DataFrame:
    log, out = views.events_log(s, d), None
    for method in ("bradley_terry", "eigen", "pagerank"):
        one = ranking.METHODS[method](log).select(F.lit(method).alias("method"), "iterations").distinct()
        out = one if out is None else out.unionAll(one)
    return out


@query(f"{E}, {sql.BY_ORDER}, {sql.elo()} {_SCORE} elo_scores")
def elo(s: SparkSession, d: str) -> DataFrame:
    return scored(ranking.elo(views.events_log(s, d)))


@query(f"{W}, {sql.BY_ORDER}, {sql.elo()} {_SCORE} elo_scores")
def elo_weighted(s: SparkSession, d: str) -> DataFrame:
    return scored(ranking.elo(views.events_log(s, d, weighted=True)))


@query(f"{E}, {sql.BY_ORDER}, {sql.elo('grp')} SELECT g AS grp, item, round(score, 6) AS score FROM elo_scores")
def elo_by_group(s: SparkSession, d: str) -> DataFrame:
    return scored(ranking.elo(views.events_log(s, d, by=("grp",))), by=["grp"])


@query(f"{D}, {sql.BY_ORDER}, {sql.elo()} {_SCORE} elo_scores")
def elo_food(s: SparkSession, d: str) -> DataFrame:
    return scored(ranking.elo(views.food_log(s, d)))


@query(f"{E}, {sql.BY_ORDER}, sc AS (WITH RECURSIVE {E}, {sql.BY_ORDER}, {sql.bradley_terry('item, p[k + 1] AS score')}) SELECT a.item AS winner, b.item AS loser, round(a.score / (a.score + b.score), 6) AS p FROM sc a CROSS JOIN sc b")
def pairwise_scores_bt(s: SparkSession, d: str) -> DataFrame:
    return matrices.pairwise_scores(ranking.bradley_terry(views.events_log(s, d))).withColumn("p", F.round("p", 6))


@query(f"{E}, {sql.BY_ORDER}, {sql.elo()} SELECT a.item AS winner, b.item AS loser, round(a.score / (a.score + b.score), 6) AS p FROM elo_scores a CROSS JOIN elo_scores b")
def pairwise_scores_elo(s: SparkSession, d: str) -> DataFrame:
    return matrices.pairwise_scores(ranking.elo(views.events_log(s, d))).withColumn("p", F.round("p", 6))


_TYPES = ("click", "error", "purchase", "signup", "view")


@query(f"{E}, {sql.COUNTING} SELECT a.item AS winner, " + ", ".join(f"round(max(CASE WHEN b.item = '{t}' THEN a.score / (a.score + b.score) END), 6) AS \"{t}\"" for t in _TYPES) + " FROM counted a CROSS JOIN counted b GROUP BY a.item")
def pairwise_pivot(s: SparkSession, d: str) -> DataFrame:
    pairs = matrices.pairwise_scores(ranking.counting(views.events_log(s, d)))
    return matrices.pivot_scores(pairs.withColumn("p", F.round("p", 6)), _TYPES)


_PAIRS = 'pc AS (SELECT item, count(*) AS pairs FROM (SELECT "left" AS item FROM log UNION ALL SELECT "right" FROM log) GROUP BY item)'
_BOARD = f"{B}, {sql.COUNTING}, {_PAIRS}, bd AS (SELECT item, score, pairs, floor(rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2.0)::INT AS rank FROM counted JOIN pc USING (item))"


@query(f"{_BOARD} SELECT item, round(score, 6) AS score, pairs, rank FROM bd")
def leaderboard(s: SparkSession, d: str) -> DataFrame:
    log = views.brand_log(s, d)
    return report.leaderboard(log, ranking.counting(log)).withColumn("score", F.round("score", 6))


@query(f"{_BOARD} SELECT item, round(score, 6) AS score, pairs, rank FROM bd QUALIFY row_number() OVER (ORDER BY score DESC, item) <= 5 OR row_number() OVER (ORDER BY score, item DESC) <= 5")
def leaderboard_truncated(s: SparkSession, d: str) -> DataFrame:
    log = views.brand_log(s, d)
    return report.ends(report.leaderboard(log, ranking.counting(log))).withColumn("score", F.round("score", 6))


@query(f"{D}, {_PAIRS} SELECT item, pairs FROM pc")
def pair_counts(s: SparkSession, d: str) -> DataFrame:
    return report.pair_counts(views.food_log(s, d))


@query("x AS (SELECT lower(winner) AS w FROM food WHERE \"left\" IS NOT NULL AND \"right\" IS NOT NULL) SELECT CASE w WHEN 'left' THEN 1 WHEN 'right' THEN 2 ELSE 0 END AS winner, count(*) AS n FROM x WHERE w IN ('left', 'right', 'tie') GROUP BY ALL")
def winner_lenient(s: SparkSession, d: str) -> DataFrame:
    return lg.prepare(table(s, d, "food")).df.groupBy("winner").agg(F.count("*").alias("n"))


@query("x AS (SELECT winner FROM food WHERE winner IS NULL OR winner NOT IN ('left', 'right', 'tie')) SELECT winner, count(*) AS n FROM x GROUP BY winner")
def winner_strict_violations(s: SparkSession, d: str) -> DataFrame:
    return lg.strict_violations(table(s, d, "food"))


@query("x AS (SELECT event_type, cast(json_extract_string(props, '$.k') AS INT) AS k FROM events) SELECT event_type, count(*) AS n FROM x WHERE coalesce(k >= 50, false) GROUP BY event_type")
def nested_filter(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_type", F.from_json("props", "k int").alias("props"))
    return e.filter(F.coalesce(F.col("props.k") >= 50, F.lit(False))).groupBy("event_type").agg(F.count("*").alias("n"))


def _rated(s: SparkSession, d: str) -> DataFrame:
    return views.coding_ratings(s, d)


@query(f"{views.CODINGS} SELECT unit, count(*) AS n FROM rated GROUP BY unit HAVING count(*) > 1")
def unit_filter(s: SparkSession, d: str) -> DataFrame:
    return reliability.unit_counts(_rated(s, d)).groupBy("unit").agg(F.sum("n").alias("n"))


@query(f"{views.ORDERS.format('l_quantity')}, {sql.ALPHA.format(delta='1.0')} SELECT value, code::INT AS code, x FROM vals")
def factorize(s: SparkSession, d: str) -> DataFrame:
    return reliability.factorize(reliability.unit_counts(views.order_ratings(s, d, "l_quantity"))).select("value", F.col("code").cast("int").alias("code"), "x")


@query(f"{views.CODINGS}, {sql.ALPHA.format(delta='1.0')} SELECT c, k, round(o, 6) AS o FROM co")
def coincidence(s: SparkSession, d: str) -> DataFrame:
    return reliability.coincidence(reliability.unit_counts(_rated(s, d))).select("c", "k", F.round("o", 6).alias("o"))


@query(f"{views.CODINGS}, {sql.ALPHA.format(delta='1.0')} SELECT c, k, round(e, 4) AS e FROM pairs")
def expected_matrix(s: SparkSession, d: str) -> DataFrame:
    counts = reliability.unit_counts(_rated(s, d))
    return reliability.expected_pairs(reliability.marginals(counts, reliability.factorize(counts))).select("c", "k", F.round("e", 4).alias("e"))


def _alpha_queries() -> None:
    for name, view, distance, delta, make in (
        ("nominal", views.CODINGS, "nominal", sql.DELTAS["nominal"], _rated),
        ("ordinal", views.CODINGS, "ordinal", sql.DELTAS["ordinal"], _rated),
        ("interval", views.CODINGS, "interval", sql.DELTAS["interval"], _rated),
        ("ratio", views.CODINGS, "ratio", sql.DELTAS["ratio"], _rated),
        ("custom", views.CODINGS, reliability.absolute_difference, sql.DELTAS["absolute"], _rated),
        ("orders_interval", views.ORDERS.format("l_quantity"), "interval", sql.DELTAS["interval"], lambda s, d: views.order_ratings(s, d, "l_quantity")),
        ("orders_ratio", views.ORDERS.format("l_quantity"), "ratio", sql.DELTAS["ratio"], lambda s, d: views.order_ratings(s, d, "l_quantity")),
        ("orders_nominal", views.ORDERS.format("l_returnflag"), "nominal", sql.DELTAS["nominal"], lambda s, d: views.order_ratings(s, d, "l_returnflag")),
    ):

        def run(s: SparkSession, d: str, distance: object = distance, make: Callable = make) -> DataFrame:
            return reliability.alpha(make(s, d), distance).select(F.round("alpha", 6).alias("alpha"), F.round(F.try_divide("observed", "expected"), 6).alias("share"))

        run.__name__ = f"alpha_{name}"
        query(f"{view}, {sql.ALPHA.format(delta=delta)} SELECT round(alpha, 6) AS alpha, round(observed / expected, 6) AS share FROM al")(run)


_alpha_queries()

_PAIR_ERRORS = """
 pool AS (SELECT c, k, delta, cast(sum(n) AS BIGINT) AS n FROM (SELECT a.value AS c, b.value AS k, CASE WHEN a.value = b.value THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS n FROM n a JOIN n b USING (unit) WHERE a.value <= b.value) JOIN pairs USING (c, k) WHERE n > 0 GROUP BY ALL),
 errs AS (SELECT 2 * delta / expected AS error, sum(n) OVER (ORDER BY c, k) - n AS start, sum(n) OVER () AS total FROM pool, al),
 units AS (SELECT m, count(*) AS units FROM (SELECT DISTINCT unit, m FROM n) GROUP BY m),
 slots AS (SELECT r, m, u, d FROM range(RESAMPLES) t1(r), units, range(units.units) t2(u), range(m * (m - 1) // 2) t3(d)),
 hashed AS (SELECT *, (concat('0x', substr(md5('3:' || r || ':' || m || ':' || u || ':' || d), 1, 8))::BIGINT) % (SELECT any_value(total) FROM errs) AS spot FROM slots),
 drawn AS (SELECT r, m, CASE WHEN d = 1 AND spot = max(CASE WHEN d = 0 THEN spot END) OVER (PARTITION BY r, m, u) THEN (concat('0x', substr(md5('3:' || r || ':' || m || ':' || u || ':again'), 1, 8))::BIGINT) % (SELECT any_value(total) FROM errs) ELSE spot END AS spot FROM hashed),
 boot AS (SELECT r AS resample, greatest(-1, 1 - sum(error / (m - 1))) AS alpha FROM drawn ASOF JOIN errs ON spot >= start GROUP BY r)"""
_RESAMPLES = 8
_ALPHA_BOOT = f"{views.CODINGS}, {sql.ALPHA.format(delta='1.0')}, {_PAIR_ERRORS.replace("RESAMPLES", str(_RESAMPLES))}"


@query(f"{_ALPHA_BOOT} SELECT resample, round(alpha, 6) AS alpha FROM boot")
def alpha_bootstrap_dist(s: SparkSession, d: str) -> DataFrame:
    drawn, _ = resampling.alpha_distribution(_rated(s, d), n_resamples=_RESAMPLES, seed=3, draws="hash")
    return drawn.select("resample", F.round("alpha", 6).alias("alpha"))


@query(f"{_ALPHA_BOOT} SELECT round(any_value(al.alpha), 6) AS alpha, round(quantile_cont(boot.alpha, 0.025), 6) AS low, round(quantile_cont(boot.alpha, 0.975), 6) AS high FROM boot, al")
def alpha_bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    return resampling.alpha_bootstrap(_rated(s, d), n_resamples=_RESAMPLES, seed=3, draws="hash").select(*(F.round(c, 6).alias(c) for c in ("alpha", "low", "high")))


@query()
def alpha_report(s: SparkSession, d: str) -> DataFrame:
    return report.alpha_report(resampling.alpha_bootstrap(_rated(s, d), seed=1))


@query()
def alpha_histogram(s: SparkSession, d: str) -> DataFrame:
    return report.histogram(resampling.alpha_distribution(_rated(s, d), seed=1)[0], "alpha")


_BOOT = f"""{E}, {sql.BY_ORDER},
 cells AS (SELECT "left", "right", winner, count(*) AS n FROM log GROUP BY ALL),
 ends AS (SELECT *, sum(n) OVER (ORDER BY "left", "right", winner) - n AS start, sum(n) OVER () AS total FROM cells),
 draws AS (SELECT r, (concat('0x', substr(md5('7:' || r || ':' || d), 1, 8))::BIGINT) % total AS spot FROM range(30) t1(r), (SELECT any_value(total) AS total FROM ends), range(total::BIGINT) t2(d)),
 drawn AS (SELECT r, "left", "right", winner, count(*) AS n FROM draws ASOF JOIN ends ON spot >= start GROUP BY ALL),
 pts AS (SELECT r, "left" AS item, n * CASE winner WHEN 1 THEN 1.0 WHEN 0 THEN 0.5 ELSE 0.0 END AS s FROM drawn UNION ALL SELECT r, "right", n * CASE winner WHEN 2 THEN 1.0 WHEN 0 THEN 0.5 ELSE 0.0 END FROM drawn),
 boot AS (SELECT r AS resample, item, sum(s)::DOUBLE AS score FROM pts GROUP BY ALL), {sql.COUNTING},
 ci AS (SELECT item, any_value(c.score) AS score, quantile_cont(boot.score, 0.025) AS low, quantile_cont(boot.score, 0.975) AS high, stddev_samp(boot.score) AS stderr FROM boot JOIN counted c USING (item) GROUP BY item)"""


def _boot(s: SparkSession, d: str, kind: str) -> DataFrame:
    out = resampling.bootstrap(views.events_log(s, d), "counting", n_resamples=30, kind=kind, seed=7, draws="hash")
    return out.select("item", *(F.round(c, 6).alias(c) for c in ("score", "low", "high", "stderr")))


@query(f"{_BOOT} SELECT item, round(score, 6) AS score, round(low, 6) AS low, round(high, 6) AS high, round(stderr, 6) AS stderr FROM ci")
def bootstrap_counting_ci(s: SparkSession, d: str) -> DataFrame:
    return _boot(s, d, "percentile")


@query(f"{_BOOT} SELECT item, round(score, 6) AS score, round(2 * score - high, 6) AS low, round(2 * score - low, 6) AS high, round(stderr, 6) AS stderr FROM ci")
def bootstrap_basic(s: SparkSession, d: str) -> DataFrame:
    return _boot(s, d, "basic")


def _drawn(s: SparkSession, d: str) -> DataFrame:
    return resampling.distribution(views.events_log(s, d), "counting", n_resamples=30, seed=7, draws="hash")


@query(f"{_BOOT} SELECT resample, item, round(score, 6) AS score FROM boot")
def bootstrap_melted(s: SparkSession, d: str) -> DataFrame:
    return _drawn(s, d).withColumn("score", F.round("score", 6))


@query(f"{_BOOT}, o AS (SELECT item, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.025) AS low, quantile_cont(score, 0.975) AS high FROM boot GROUP BY item) SELECT item, round(median, 6) AS median, round(low, 6) AS low, round(high, 6) AS high, row_number() OVER (ORDER BY median DESC, item)::INT AS place FROM o")
def bootstrap_median_order(s: SparkSession, d: str) -> DataFrame:
    return report.median_order(_drawn(s, d)).select("item", *(F.round(c, 6).alias(c) for c in ("median", "low", "high")), "place")


@query()
def bootstrap_bt_ci(s: SparkSession, d: str) -> DataFrame:
    return resampling.bootstrap(views.events_log(s, d), "bradley_terry", kind="percentile")


@query()
def bootstrap_bca(s: SparkSession, d: str) -> DataFrame:
    return resampling.bootstrap(views.events_log(s, d), "bradley_terry")


@query()
def bootstrap_elo(s: SparkSession, d: str) -> DataFrame:
    """The default interval, with 40 resamples and the rows left out in 40 shares."""
    return resampling.bootstrap(views.events_log(s, d), "elo", n_resamples=40, jackknife_groups=40)


def _strength(log: lg.Log, win_weight: float = 1.0, tie_weight: float = 0.5, **_: object) -> DataFrame:
    """A ranking of a user's own: the share of points in comparisons, (by..., item, score)."""
    points = ranking.counting(log, None, win_weight, tie_weight).join(report.pair_counts(log), [*log.by, "item"])
    return points.select(*log.by, "item", (F.col("score") / F.col("pairs")).alias("score"))


_OWN = f"""{E},
 num AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS row, count(*) OVER () AS total FROM log),
 dr AS (SELECT r, (concat('0x', substr(md5('9:' || r || ':' || d), 1, 8))::BIGINT) % total AS row FROM range(20) t1(r), (SELECT any_value(total) AS total FROM num), range(total::BIGINT) t2(d)),
 boot AS (SELECT r, item, sum(s) / count(*) AS score FROM
  (SELECT r, unnest([{{'item': "left", 's': CASE winner WHEN 1 THEN 1.0 WHEN 0 THEN 0.5 ELSE 0.0 END}}, {{'item': "right", 's': CASE winner WHEN 2 THEN 1.0 WHEN 0 THEN 0.5 ELSE 0.0 END}}], recursive := true) FROM dr JOIN num USING (row)) GROUP BY r, item),
 est AS (SELECT item, sum(s) / count(*) AS score FROM (SELECT "left" AS item, CASE winner WHEN 1 THEN 1.0 WHEN 0 THEN 0.5 ELSE 0.0 END AS s FROM log UNION ALL SELECT "right", CASE winner WHEN 2 THEN 1.0 WHEN 0 THEN 0.5 ELSE 0.0 END FROM log) GROUP BY item)"""


@query(f"{_OWN} SELECT item, round(any_value(est.score), 6) AS score, round(quantile_cont(boot.score, 0.025), 6) AS low, round(quantile_cont(boot.score, 0.975), 6) AS high, round(stddev_samp(boot.score), 6) AS stderr FROM boot JOIN est USING (item) GROUP BY item")
def bootstrap_own_method(s: SparkSession, d: str) -> DataFrame:
    """Any callable of a log is a method; 20 resamples, which the SQL repeats."""
    out = resampling.bootstrap(views.events_log(s, d), _strength, n_resamples=20, kind="percentile", seed=9)
    return out.select("item", *(F.round(c, 6).alias(c) for c in ("score", "low", "high", "stderr")))


@query()
def bootstrap_own_bca(s: SparkSession, d: str) -> DataFrame:
    return resampling.bootstrap(views.events_log(s, d), _strength, n_resamples=20, jackknife_groups=20, seed=9)


_NUMBERED = "num AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS row, count(*) OVER () AS total FROM log)"


@query(f"{E}, {_NUMBERED}, dr AS (SELECT d, (concat('0x', substr(md5('5:' || d), 1, 8))::BIGINT) % (SELECT any_value(total) FROM num) AS row FROM range(1000) t(d)) SELECT d, \"left\", \"right\", winner, weight, ord FROM dr JOIN num USING (row)")
def sample_with_replacement(s: SparkSession, d: str) -> DataFrame:
    return resampling.sample_rows(views.events_log(s, d).df, ["ord"], 1000, seed=5)


@query(f"x AS (UNPIVOT (SELECT sheet_id, {_CELLS} FROM codings) ON {_CELLS} INTO NAME cell VALUE value) SELECT cell, value, count(*) AS n FROM x GROUP BY ALL")
def ratings_unpivot(s: SparkSession, d: str) -> DataFrame:
    wide = table(s, d, "codings").select("sheet_id", *(f"c{k}" for k in range(12)))
    return io.melt_ratings(wide, "sheet_id").groupBy(F.concat(F.lit("c"), F.col("unit")).alias("cell"), "value").agg(F.count("*").alias("n"))


@query("x AS (SELECT algorithm, unnest([time, 2 * time]) AS t FROM rust_python WHERE isfinite(time)) SELECT algorithm, count(*) AS n, round(sum(t), 4) AS total FROM x GROUP BY algorithm")
def timings_explode(s: SparkSession, d: str) -> DataFrame:
    runs = table(s, d, "rust_python").filter(~F.isnan("time") & (F.abs("time") < float("inf")))
    long = runs.select("algorithm", F.explode(F.array(F.col("time"), 2 * F.col("time"))).alias("t"))
    return long.groupBy("algorithm").agg(F.count("*").alias("n"), F.round(F.sum("t"), 4).alias("total"))


def _stream(s: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    known = s.read.parquet(path)
    reader = s.readStream.schema(known.schema)
    # a file source reads folders: the table's own, or that of its single file
    single = [f for f in known.inputFiles() if f.endswith(f"/{name}.parquet")]
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d) if single else reader.parquet(path)


def _played(df: DataFrame, name: str, mode: str) -> DataFrame:
    """The sink of a stream run over what there is: as many rows as items, windows or updates."""
    run = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return df.sparkSession.table(name)


@query("pts AS (SELECT \"left\" AS item, CASE lower(winner) WHEN 'left' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0 END AS s FROM food WHERE lower(winner) IN ('left', 'right', 'tie') UNION ALL SELECT \"right\", CASE lower(winner) WHEN 'right' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0 END FROM food WHERE lower(winner) IN ('left', 'right', 'tie')) SELECT item, sum(s)::DOUBLE AS score FROM pts GROUP BY item")
def stream_counting(s: SparkSession, d: str) -> DataFrame:
    return _played(live.live_counting(_stream(s, d, "food")), "rankloom_stream_counting", "complete")


@query("pts AS (SELECT strftime(judged_at, '%Y-%m-%d') AS start, \"left\" AS item, CASE lower(winner) WHEN 'left' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0 END AS s FROM food WHERE lower(winner) IN ('left', 'right', 'tie') UNION ALL SELECT strftime(judged_at, '%Y-%m-%d'), \"right\", CASE lower(winner) WHEN 'right' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0 END FROM food WHERE lower(winner) IN ('left', 'right', 'tie')) SELECT start, item, sum(s)::DOUBLE AS score FROM pts GROUP BY ALL")
def stream_days(s: SparkSession, d: str) -> DataFrame:
    food = _stream(s, d, "food").withColumn("judged_at", F.col("judged_at").cast("timestamp"))
    days = _played(live.windowed_counting(food, "judged_at", late="365 days"), "rankloom_stream_days", "complete")
    return days.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "item", "score")


@query()
def stream_elo(s: SparkSession, d: str) -> DataFrame:
    events = _stream(s, d, "events").select(F.col("event_type").alias("left"), F.lit("baseline").alias("right"), F.when(F.col("value") > 50, "left").otherwise("right").alias("winner"), "event_id", (F.col("user_id") % 3).alias("grp"))
    return _played(live.live_elo(events, "grp", "event_id"), "rankloom_stream_elo", "update")


@query()
def distributed_bradley_terry(s: SparkSession, d: str) -> DataFrame:
    return scored(distributed.bradley_terry(views.events_log(s, d)), 4)


ORACLES["distributed_bradley_terry"] = ORACLES["bradley_terry"].replace("round(p[k + 1], 6)", "round(p[k + 1], 4)")


@query()
def distributed_pagerank(s: SparkSession, d: str) -> DataFrame:
    return scored(distributed.pagerank(views.events_log(s, d)))


ORACLES["distributed_pagerank"] = ORACLES["pagerank"]


@query("x AS (SELECT nullif(\"left\", '') AS \"left\", nullif(\"right\", '') AS \"right\", nullif(winner, '') AS winner FROM food) SELECT \"left\", \"right\", winner, count(*) AS n FROM x GROUP BY ALL")
def io_comparisons_csv(s: SparkSession, d: str) -> DataFrame:
    """The log written as CSV and read again: labels with commas, quotes and blanks come back as they were, an empty field as a missing one."""
    path = shared_folder(s, "comparisons")
    io.write_csv(table(s, d, "food").select("left", "right", "winner"), path)
    return io.read_comparisons_csv(s, path).groupBy("left", "right", "winner").agg(F.count("*").alias("n"))


@query(f"x AS (UNPIVOT (SELECT {_CELLS} FROM codings) ON {_CELLS} INTO NAME cell VALUE value) SELECT cast(substr(cell, 2) AS INT) AS unit, value, count(*) AS n FROM x WHERE value <> '' GROUP BY ALL")
def io_ratings_csv(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s, "ratings")
    table(s, d, "codings").select(*(f"c{k}" for k in range(12))).write.csv(path, header=False, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return io.read_ratings_csv(s, path).groupBy("unit", "value").agg(F.count("*").alias("n"))


@query(f"{E}, {sql.COUNTING} SELECT item, round(score, 6) AS score, floor(rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2.0)::INT AS rank FROM counted")
def io_scores_csv(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s, "scores")
    io.write_csv(report.with_rank(ranking.counting(views.events_log(s, d))), path)
    return s.read.schema("item string, score double, rank int").csv(path, header=True, escape='"').withColumn("score", F.round("score", 6))


_ARENA = """
 log AS (SELECT "left", "right", CASE lower(winner) WHEN 'left' THEN 1 WHEN 'right' THEN 2 ELSE 0 END AS winner, 1.0::DOUBLE AS weight FROM food
  WHERE lower(winner) IN ('left', 'right', 'tie') AND ord % 3 > 0 AND ord % 2 = 0 AND "left" IS NOT NULL AND "right" IS NOT NULL)"""


@query(f"{_ARENA}, {sql.COUNTING} {_SCORE} counted")
def io_arena_json(s: SparkSession, d: str) -> DataFrame:
    """The log written as dumps of battles, 5,000 numbers each, a third not anonymous and half of them repeated; what is read counts."""
    path, winner = shared_folder(s, "arena"), F.lower("winner")
    spelled = F.when(winner == "left", "model_a").when(winner == "right", "model_b").when(winner == "tie", F.when(F.col("ord") % 4 == 0, "tie").otherwise("tie (bothbad)"))
    battle = F.struct(F.col("left").alias("model_a"), F.col("right").alias("model_b"), spelled.alias("winner"), (F.col("ord") % 3 > 0).alias("anony"), F.struct((F.col("ord") % 2 == 0).alias("sampled")).alias("dedup_tag"), F.col("ord").cast("double").alias("tstamp"))
    dumps = table(s, d, "food").groupBy(F.floor(F.col("ord") / 5000).alias("part")).agg(F.collect_list(battle).alias("b"))
    dumps.select("part", F.to_json("b").alias("value")).write.partitionBy("part").text(path)
    return scored(ranking.counting(io.read_arena_json(s, f"{path}/*")))


@query(f"{views.CODINGS}, {sql.ALPHA.format(delta=sql.DELTAS['absolute'])} SELECT round(alpha, 6) AS alpha, round(observed / expected, 6) AS share FROM al")
def alpha_distance_table(s: SparkSession, d: str) -> DataFrame:
    """A distance given as a table of pairs of values."""
    table_ = s.createDataFrame([(str(a), str(b), float(abs(a - b))) for a in range(1, 6) for b in range(1, 6)], "c string, k string, delta double")
    return reliability.alpha(_rated(s, d), table_).select(F.round("alpha", 6).alias("alpha"), F.round(F.try_divide("observed", "expected"), 6).alias("share"))


@query(f"{_BOOT} SELECT item, " + ", ".join(f"round(quantile_cont(score, {q}), 6) AS {n}" for q, n in ((0, "least"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "most"))) + " FROM boot GROUP BY item")
def bootstrap_box(s: SparkSession, d: str) -> DataFrame:
    return report.box_frame(_drawn(s, d)).select("item", *(F.round(c, 6).alias(c) for c in ("least", "q1", "median", "q3", "most")))


@query(f"{B}, {sql.COUNTING}, {sql.AWR} SELECT item, round(c.score, 6) AS x, round(a.score, 6) AS y FROM counted c JOIN awr a USING (item)")
def score_scatter(s: SparkSession, d: str) -> DataFrame:
    log = views.brand_log(s, d)
    return report.scatter_frame(ranking.counting(log), ranking.average_win_rate(log)).select("item", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
