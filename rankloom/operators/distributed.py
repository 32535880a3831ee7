"""The iterative rankings for more edges than one task may hold: each step is joins and group-bys over all edges.

Only two or three sums a step come to the driver. The state (a row an item) is written to the checkpoint folder every step and the one
before deleted, so lineage stays short and a lost executor costs one step. Bradley-Terry updates all items at once here (Jacobi), so it takes more iterations than in
`ranking`; if it converges within its limit it ends at the same strengths, else it raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotConvergedError
from ..functions.ieee import geometric_mean, l1_norm, l2_norm
from ..session import cut, discard
from .log import Log, edges, first_places


def both_ways(log: Log, win_weight: float, tie_weight: float) -> DataFrame:
    """(i, j, a, b, win, tie): weight of each edge and of its reverse; every reverse is there already."""
    if log.by:
        raise ValueError("one leaderboard at a time")
    e = edges(log).withColumn("a", win_weight * F.col("win") + tie_weight * F.col("tie"))
    back = e.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("a").alias("b"))
    return cut(e.join(back, ["i", "j"]).select("i", "j", "a", "b", "win", "tie"))


def _start(log: Log, index: DataFrame | None, value: float | None) -> tuple[DataFrame, int]:
    items = cut((first_places(log) if index is None else index).select("item"))
    n = items.count()
    return items.withColumn("p", F.lit(1.0 / max(n, 1) if value is None else value)), n


def _distance(new: DataFrame, old: DataFrame) -> float:
    both = new.join(old.select("item", F.col("p").alias("q")), "item")
    return both.agg(l2_norm(F.col("p") - F.col("q"))).first()[0] or 0.0


def _on_edges(e: DataFrame, state: DataFrame) -> DataFrame:
    return e.join(state.select(F.col("item").alias("i"), F.col("p").alias("pi")), "i").join(state.select(F.col("item").alias("j"), F.col("p").alias("pj")), "j")


def bradley_terry(log: Log, index: DataFrame | None = None, win_weight: float = 1.0, tie_weight: float = 0.5, tolerance: float = 1e-6, limit: int = 200) -> DataFrame:
    """(item, score, iterations); NotConvergedError if `limit` steps do not reach `tolerance`, as with an undefeated or winless item."""
    e, (state, n) = both_ways(log, win_weight, tie_weight), _start(log, index, 1.0)
    step, near = 0, not n
    while n and step < limit:
        step += 1
        total = F.col("pi") + F.col("pj")
        sums = _on_edges(e, state).groupBy(F.col("i").alias("item")).agg(F.sum(F.col("a") * F.col("pj") / total).alias("won"), F.sum(F.col("b") / total).alias("lost"))
        raw = cut(state.select("item").join(sums, "item", "left").select("item", F.coalesce(F.try_divide("won", "lost"), F.lit(tolerance)).alias("p")))
        mean = raw.agg(geometric_mean(F.when(F.col("p") > 0, F.col("p")))).first()[0] or 1.0
        new = cut(raw.select("item", (F.col("p") / mean).alias("p")))
        near = _distance(new, state) < tolerance
        discard(raw, *([state] if step > 1 else []))
        state = new
        if near:
            break
    if not near:
        raise NotConvergedError(f"Bradley-Terry did not reach {tolerance} in {limit} steps")
    return state.select("item", F.col("p").alias("score"), F.lit(step).alias("iterations"))


def newman(log: Log, index: DataFrame | None = None, v_init: float = 0.5, win_weight: float = 1.0, tie_weight: float = 1.0, tolerance: float = 1e-6, limit: int = 100) -> DataFrame:
    """(item, score, v, iterations)."""
    base, (state, n) = both_ways(log, win_weight, tie_weight / 2), _start(log, index, 1.0)
    v = following = v_init
    step = 0
    while n and step < limit:
        step += 1
        v = following
        pi, pj = F.col("pi"), F.col("pj")
        root = F.sqrt(pi * pj)
        under = pi + pj + 2 * v * root
        on = _on_edges(base, state)
        sums = on.groupBy(F.col("i").alias("item")).agg(
            F.sum(F.col("a") * (pj + v * root) / under).alias("won"),
            F.sum(F.col("b") * (1 + v * F.sqrt(pj / pi)) / under).alias("lost"),
            F.sum(tie_weight * F.col("tie") * (pi + pj) / under).alias("t"),
            F.sum(win_weight * F.col("win") * root / under).alias("w"),
        )
        new = cut(state.select("item").join(sums, "item", "left").select("item", F.coalesce(F.try_divide("won", "lost"), F.lit(tolerance)).alias("p"), "t", "w"))
        t, w = new.agg(F.sum("t"), F.sum("w")).first()
        following = (t or 0.0) / 2 / (2 * w) if w else tolerance
        near = _distance(new, state) < tolerance
        if step > 1:
            discard(kept)
        state, kept = new.select("item", "p"), new
        if near:
            break
    return state.select("item", F.col("p").alias("score"), F.lit(float(v)).alias("v"), F.lit(step).alias("iterations"))


def eigen(log: Log, index: DataFrame | None = None, win_weight: float = 1.0, tie_weight: float = 0.5, tolerance: float = 1e-6, limit: int = 100, damping: float | None = None) -> DataFrame:
    """(item, score, iterations) by power iteration; with `damping`, of the PageRank matrix."""
    e, (state, n) = both_ways(log, win_weight, tie_weight), _start(log, index, None)
    lost = cut(e.groupBy(F.col("j").alias("item")).agg(F.sum("a").alias("lost")).filter("lost > 0")) if damping is not None else None
    if lost is not None:
        e = cut(e.join(lost.select(F.col("item").alias("j"), "lost"), "j").select("i", "j", (F.col("a") / F.col("lost")).alias("a")))
    step = 0
    while n and step < limit:
        step += 1
        source, target = ("i", "j") if lost is None else ("j", "i")
        flow = e.join(state.select(F.col("item").alias(source), "p"), source).groupBy(F.col(target).alias("item")).agg(F.sum(F.col("a") * F.col("p")).alias("f"))
        new = state.select("item").join(flow, "item", "left").select("item", F.coalesce("f", F.lit(0.0)).alias("p"))
        if lost is not None:
            total = state.agg(F.sum("p")).first()[0]
            stuck = state.join(lost, "item", "left_anti").agg(F.sum("p")).first()[0] or 0.0
            new = new.select("item", (damping * (F.col("p") + F.lit(stuck / n)) + F.lit((1 - damping) / n * total)).alias("p"))
        new = cut(new)
        norm = new.agg(l2_norm(F.col("p"))).first()[0] or 1.0
        scaled = new.select("item", (F.col("p") / norm).alias("p"))
        near = _distance(scaled, state) < tolerance
        if step > 1:
            discard(kept)
        state, kept = scaled, new
        if near:
            break
    if damping is not None and n:
        total = state.agg(l1_norm(F.col("p"))).first()[0] or 1.0
        state = state.select("item", (F.col("p") / total).alias("p"))
    return state.select("item", F.col("p").alias("score"), F.lit(step).alias("iterations"))


def pagerank(log: Log, index: DataFrame | None = None, damping: float = 0.85, **options: float) -> DataFrame:
    """(item, score, iterations)."""
    return eigen(log, index, damping=damping, **options)
