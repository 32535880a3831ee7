"""SQL of the ranking methods, as text for a second engine: recursive queries over lists. They follow the definitions, not this library's plans."""

EDGES = """
 sums AS (SELECT i, j, sum(win) AS win, sum(tie) AS tie FROM (
   SELECT CASE WHEN winner = 2 THEN "right" ELSE "left" END AS i, CASE WHEN winner = 2 THEN "left" ELSE "right" END AS j, weight AS win, 0.0::DOUBLE AS tie FROM log WHERE winner <> 0
   UNION ALL SELECT "left", "right", 0.0, weight FROM log WHERE winner = 0 UNION ALL SELECT "right", "left", 0.0, weight FROM log WHERE winner = 0) GROUP BY i, j)"""
INDEX = """
 sides AS (SELECT "left" AS item, ord AS spot FROM log UNION ALL SELECT "right", ord + 1000000000000 FROM log),
 idx AS (SELECT item, row_number() OVER (ORDER BY min({order})) - 1 AS k FROM sides GROUP BY item)"""
BY_ORDER, BY_LABEL = INDEX.format(order="spot"), INDEX.format(order="item")
MATRIX = EDGES + """,
 grid AS (SELECT a.k AS i, b.k AS j, coalesce(win, 0.0) AS win, coalesce(tie, 0.0) AS tie FROM idx a CROSS JOIN idx b LEFT JOIN sums s ON s.i = a.item AND s.j = b.item),
 lines_ AS (SELECT i, list(win ORDER BY j) AS w, list(tie ORDER BY j) AS t, list({ww} * win + {tw} * tie ORDER BY j) AS a FROM grid GROUP BY i),
 m AS (SELECT list(w ORDER BY i) AS mw, list(t ORDER BY i) AS mt, list(a ORDER BY i) AS ma, count(*) AS n FROM lines_)"""
_NEAR = "sqrt(list_sum(list_transform(list_zip(q, {old}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) < 1e-6"
_LAST = "(SELECT * FROM {0} ORDER BY step DESC LIMIT 1)"


def bradley_terry(select: str = "item, round(p[k + 1], 6) AS score", ww: float = 1, tw: float = 0.5) -> str:
    """CTEs and a final select over idx and the last state (p, its)."""
    return f"""{MATRIX.format(ww=ww, tw=tw)},
 st AS (SELECT 0 AS step, 1 AS i, 1 AS its, list_transform(range(n), lambda x: 1.0::DOUBLE) AS p, list_transform(range(n), lambda x: 1.0::DOUBLE) AS old, false AS done FROM m
  UNION ALL SELECT step + 1, CASE WHEN lst THEN 1 ELSE i + 1 END, CASE WHEN lst AND NOT fin THEN its + 1 ELSE its END, q, CASE WHEN lst THEN q ELSE old END, fin
  FROM (SELECT *, lst AND {_NEAR.format(old='old')} AS fin FROM
   (SELECT *, CASE WHEN lst THEN list_transform(r, lambda x: x / exp(list_avg(list_transform(r, lambda y: ln(y))))) ELSE r END AS q FROM
    (SELECT *, i = n AS lst, list_transform(range(1, n + 1), lambda c: CASE WHEN c = i THEN v ELSE p[c] END) AS r FROM
     (SELECT st.*, m.n, list_sum(list_transform(range(1, n + 1), lambda c: ma[i][c] * p[c] / (p[i] + p[c]))) / list_sum(list_transform(range(1, n + 1), lambda c: ma[c][i] / (p[i] + p[c]))) AS v
      FROM st, m WHERE NOT done AND its <= 100)))))
 SELECT {select} FROM idx, (SELECT p, least(its, 100) AS its FROM {_LAST.format('st')})"""


def newman(select: str = "item, round(p[k + 1], 4) AS score", tw: float = 1) -> str:
    return f"""{MATRIX.format(ww=1, tw=1)},
 st AS (SELECT 0 AS step, list_transform(range(n), lambda x: 1.0::DOUBLE) AS p, 0.5::DOUBLE AS v, 0.5::DOUBLE AS following, false AS done FROM m
  UNION ALL SELECT step + 1, q, w, f, {_NEAR.format(old='p')} FROM
   (SELECT *, list_transform(range(1, n + 1), lambda a:
      list_sum(list_transform(range(1, n + 1), lambda b: (mw[a][b] + {tw} * mt[a][b] / 2) * (p[b] + w * sqrt(p[a] * p[b])) / (p[a] + p[b] + 2 * w * sqrt(p[a] * p[b]))))
      / list_sum(list_transform(range(1, n + 1), lambda b: (mw[b][a] + {tw} * mt[b][a] / 2) * (1 + w * sqrt(p[b] / p[a])) / (p[a] + p[b] + 2 * w * sqrt(p[a] * p[b]))))) AS q,
     (list_sum(list_transform(range(1, n + 1), lambda a: list_sum(list_transform(range(1, n + 1), lambda b: {tw} * mt[a][b] * (p[a] + p[b]) / (p[a] + p[b] + 2 * w * sqrt(p[a] * p[b])))))) / 2)
      / (2 * list_sum(list_transform(range(1, n + 1), lambda a: list_sum(list_transform(range(1, n + 1), lambda b: mw[a][b] * sqrt(p[a] * p[b]) / (p[a] + p[b] + 2 * w * sqrt(p[a] * p[b]))))))) AS f
    FROM (SELECT st.step, st.p, st.following AS w, m.* FROM st, m WHERE NOT done AND step < 100)))
 SELECT {select} FROM idx, (SELECT p, v, step FROM {_LAST.format('st')})"""


def _power(matrix: str, select: str) -> str:
    return f"""{MATRIX.format(ww=1, tw=0.5)}, g AS (SELECT n, {matrix} AS mg FROM m),
 st AS (SELECT 0 AS step, list_transform(range(n), lambda x: 1.0::DOUBLE / n) AS p, false AS done FROM g
  UNION ALL SELECT step + 1, q, {_NEAR.format(old='p')} FROM
   (SELECT *, list_transform(r, lambda x: x / sqrt(list_sum(list_transform(r, lambda y: y * y)))) AS q FROM
    (SELECT st.step, st.p, list_transform(range(1, n + 1), lambda a: list_sum(list_transform(range(1, n + 1), lambda b: mg[a][b] * p[b]))) AS r FROM st, g WHERE NOT done AND step < 100)))
 SELECT {select} FROM idx, (SELECT p, step FROM {_LAST.format('st')})"""


def eigen(select: str = "item, round(p[k + 1], 6) AS score") -> str:
    return _power("list_transform(range(1, n + 1), lambda a: list_transform(range(1, n + 1), lambda b: ma[b][a]))", select)


def pagerank(select: str = "item, round(p[k + 1] / list_sum(p), 6) AS score") -> str:
    lost = "list_sum(list_transform(range(1, n + 1), lambda z: ma[z][b]))"
    return _power(f"list_transform(range(1, n + 1), lambda a: list_transform(range(1, n + 1), lambda b: 0.85 * CASE WHEN {lost} = 0 THEN 1.0 / n ELSE ma[a][b] / {lost} END + 0.15 / n))", select)


def elo(by: str = "0") -> str:
    """Ratings by group, one step a comparison of each group."""
    return f"""
 seq AS (SELECT {by} AS g, row_number() OVER (PARTITION BY {by} ORDER BY ord) AS n, a.k + 1 AS x, b.k + 1 AS y, winner, weight FROM log JOIN idx a ON a.item = "left" JOIN idx b ON b.item = "right"),
 size AS (SELECT count(*) AS items FROM idx), lasts AS (SELECT g, max(n) AS n FROM seq GROUP BY g),
 st AS (SELECT g, 0::BIGINT AS n, list_transform(range(items), lambda c: 1000.0::DOUBLE) AS s FROM lasts, size
  UNION ALL SELECT g, n, list_transform(range(1, len(s) + 1), lambda c: CASE WHEN c = x AND c = y THEN s[c] + 4 * (sx + sy - 1) WHEN c = x THEN s[x] + 4 * (sx - ex) WHEN c = y THEN s[y] + 4 * (sy - (1 - ex)) ELSE s[c] END)
  FROM (SELECT st.g, seq.n, s, x, y, 1 / (1 + power(10, (s[y] - s[x]) / 400)) AS ex, weight * CASE winner WHEN 1 THEN 1.0 WHEN 0 THEN 0.5 ELSE 0.0 END AS sx, weight * CASE winner WHEN 2 THEN 1.0 WHEN 0 THEN 0.5 ELSE 0.0 END AS sy
   FROM st JOIN seq ON seq.g = st.g AND seq.n = st.n + 1)),
 fin AS (SELECT st.g, s FROM st JOIN lasts ON st.g = lasts.g AND st.n = lasts.n),
 elo_scores AS (SELECT g, item, s[k + 1] AS score FROM fin, idx)"""


COUNTING = """
 points AS (SELECT "left" AS item, weight * CASE winner WHEN 1 THEN 1.0 WHEN 0 THEN 0.5 ELSE 0.0 END AS s FROM log UNION ALL SELECT "right", weight * CASE winner WHEN 2 THEN 1.0 WHEN 0 THEN 0.5 ELSE 0.0 END FROM log),
 counted AS (SELECT item, sum(s) AS score FROM points GROUP BY item)"""
AWR = EDGES + """,
 rates AS (SELECT a.i AS item, (a.win + a.tie / 2) / (a.win + a.tie / 2 + coalesce(b.win + b.tie / 2, 0)) AS r FROM
   (SELECT x.i, x.j, coalesce(s.win, 0) AS win, coalesce(s.tie, 0) AS tie FROM (SELECT i, j FROM sums UNION SELECT j, i FROM sums) x LEFT JOIN sums s ON s.i = x.i AND s.j = x.j) a
   LEFT JOIN sums b ON a.i = b.j AND a.j = b.i WHERE a.win + a.tie / 2 + coalesce(b.win + b.tie / 2, 0) > 0),
 awr AS (SELECT item, avg(r) AS score FROM rates GROUP BY item)"""
ALPHA = """
 m AS (SELECT *, count(*) OVER (PARTITION BY unit) AS m FROM rated),
 n AS (SELECT unit, value, count(*) AS n, any_value(m) AS m FROM m WHERE m > 1 GROUP BY unit, value),
 vals AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code, CASE WHEN bool_and(try_cast(value AS DOUBLE) IS NOT NULL) OVER () THEN try_cast(value AS DOUBLE) ELSE row_number() OVER (ORDER BY value) - 1 END AS x FROM (SELECT DISTINCT value FROM n)),
 co AS (SELECT a.value AS c, b.value AS k, sum(a.n * (b.n - CASE WHEN a.value = b.value THEN 1 ELSE 0 END) / (a.m - 1.0::DOUBLE)) AS o FROM n a JOIN n b USING (unit) GROUP BY a.value, b.value),
 marg AS (SELECT *, sum(n) OVER (ORDER BY code) - n / 2 AS place, sum(n) OVER () AS t FROM (SELECT value, code, x, sum(o) AS n FROM co JOIN vals ON c = value GROUP BY value, code, x)),
 pairs AS (SELECT a.value AS c, b.value AS k, (a.n * b.n - CASE WHEN a.code = b.code THEN a.n ELSE 0 END) / (a.t - 1) AS e, CASE WHEN a.code = b.code THEN 0.0 ELSE {delta} END AS delta FROM marg a CROSS JOIN marg b),
 al AS (SELECT 1 - sum(coalesce(o, 0) * delta) / sum(e * delta) AS alpha, sum(coalesce(o, 0) * delta) AS observed, sum(e * delta) AS expected FROM pairs LEFT JOIN co USING (c, k))"""
DELTAS = {"nominal": "1.0", "ordinal": "power(a.place - b.place, 2)", "interval": "power(a.x - b.x, 2)", "ratio": "power((a.x - b.x) / (a.x + b.x), 2)", "absolute": "abs(a.x - b.x)"}
