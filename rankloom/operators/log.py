"""The comparison log: validation, item index, win and tie edges.

Operators work on a `Log`, a table of (by..., left, right, winner, weight[, ord]) with winner 1 for left, 2 for right, 0 for a draw. Only
the columns named are carried, so other columns may have any name. Everything after `edges` is as large as the number of
different pairs, not as the log.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MissingColumnError, UnknownItemError
from ..session import cut
from .numbering import numbered

DRAW, LEFT, RIGHT = 0, 1, 2
#: spellings of outcomes; fixed values
WINNERS = {"left": LEFT, "right": RIGHT, "tie": DRAW}
ARENA_WINNERS = {"model_a": LEFT, "model_b": RIGHT, "tie": DRAW, "tie (bothbad)": DRAW}


def winner_code(column: Column, spellings: dict[str, int] | None = None) -> Column:
    """The code of a spelling, letter case aside; null for any other text."""
    out = F.lit(None).cast("int")
    for text, code in (spellings or WINNERS).items():
        out = F.when(F.lower(column) == text, F.lit(code)).otherwise(out)
    return out


@dataclass(frozen=True)
class Log:
    """A prepared log; `by` names the columns of separate leaderboards, `ordered` tells whether there is an `ord`."""

    df: DataFrame
    by: tuple[str, ...] = ()
    ordered: bool = False

    @property
    def keys(self) -> list[str]:
        return list(self.by)

    @cached_property
    def pairs(self) -> DataFrame:
        """(by..., left, right, l, r, t, n, first): of each left and right label the weight of wins of either and of draws, the comparisons, and the least `ord`.

        Read from the log once, combined map-side, and kept in the checkpoint folder: edges, items and counts all come from it.
        """
        w = F.col("weight")
        sums = (F.sum(F.when(F.col("winner") == code, w).otherwise(0.0)).alias(name) for code, name in ((LEFT, "l"), (RIGHT, "r"), (DRAW, "t")))
        first = F.min("ord") if self.ordered else F.lit(0)
        return cut(self.df.groupBy(*self.by, "left", "right").agg(*sums, F.count("*").alias("n"), first.alias("first")))


def prepare(
    df: DataFrame, left: str = "left", right: str = "right", winner: str = "winner", weight: str | None = None, order: str | None = None, by: Sequence[str] = (), spellings: dict[str, int] | None = None
) -> Log:
    """A log from any table.

    Rows with a null label or an outcome that is none of the spellings (or, for a numeric column, of 0, 1, 2) are left out. A null weight
    counts 1; NaN and infinite weights raise when the log is read. Labels are compared as they are; repeated rows count each time.
    """
    wanted = [left, right, winner, *([weight] if weight else []), *([order] if order else []), *by]
    if lost := [c for c in wanted if c not in df.columns]:
        raise MissingColumnError(f"no column {', '.join(lost)}")
    code = winner_code(F.col(f"`{winner}`"), spellings) if df.schema[winner].dataType.simpleString() == "string" else F.when(F.col(f"`{winner}`").isin(0, 1, 2), F.col(f"`{winner}`").cast("int"))
    w = F.lit(1.0) if weight is None else F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(1.0))
    finite = F.when(F.isnan(w) | (F.abs(w) == float("inf")), F.raise_error(F.lit("weights must be finite"))).otherwise(w)
    columns = [*(F.col(f"`{b}`").alias(b) for b in by), F.col(f"`{left}`").cast("string").alias("left"), F.col(f"`{right}`").cast("string").alias("right"), code.alias("winner"), (w if weight is None else finite).alias("weight")]
    if order:
        columns.append(F.col(f"`{order}`").alias("ord"))
    rows = df.select(*columns).filter("left is not null and right is not null and winner is not null")
    return Log(rows, tuple(by), order is not None)


def strict_violations(df: DataFrame, winner: str = "winner", allowed: Sequence[str] = tuple(WINNERS)) -> DataFrame:
    """(winner, n): outcomes not spelled exactly as allowed, null included."""
    if winner not in df.columns:
        raise MissingColumnError(f"no column {winner}")
    c = F.col(f"`{winner}`").cast("string").alias("winner")
    return df.select(c).filter(~F.coalesce(F.col("winner").isin(*allowed), F.lit(False))).groupBy("winner").agg(F.count("*").alias("n"))


def without_ties(log: Log) -> Log:
    return Log(log.df.filter(F.col("winner") != DRAW), log.by, log.ordered)


def first_places(log: Log) -> DataFrame:
    """(by..., item, first): of each item its first appearance (side, order), all left sides before all right sides."""
    sides = log.pairs.select(*log.by, F.inline(F.array(F.struct(F.col("left").alias("item"), F.lit(0).alias("side"), F.col("first").alias("at")), F.struct(F.col("right").alias("item"), F.lit(1).alias("side"), F.col("first").alias("at")))))
    return sides.groupBy(*log.by, "item").agg(F.min(F.struct("side", "at")).alias("first"))


def item_index(log: Log) -> DataFrame:
    """(by..., item, k): items numbered from 0 by first appearance, all left sides before all right sides.

    Without an order column the numbers follow the labels. First appearances come from the pairs; numbering sees the items only.
    """
    order = {"__first": F.col("first"), "__item": F.col("item")} if log.ordered else {"__item": F.col("item")}
    return numbered(first_places(log), order, log.by).select(*log.by, "item", F.col("row").cast("int").alias("k"))


def encode(log: Log, index: DataFrame) -> DataFrame:
    """(by..., x, y, winner, weight[, ord]) with the numbers of an index; labels it lacks raise UnknownItemError."""
    if unknown_items(log, index).limit(1).count():
        raise UnknownItemError("the log has labels that are not in the index")
    x = index.select(*log.by, F.col("item").alias("left"), F.col("k").alias("x"))
    y = index.select(*log.by, F.col("item").alias("right"), F.col("k").alias("y"))
    return log.df.join(x, [*log.by, "left"]).join(y, [*log.by, "right"]).select(*log.by, "x", "y", "winner", "weight", *(["ord"] if log.ordered else []))


def unknown_items(log: Log, index: DataFrame) -> DataFrame:
    """(by..., item): labels of the log that the index lacks."""
    labels = log.df.select(*log.by, F.explode(F.array("left", "right")).alias("item")).distinct()
    return labels.join(index.select(*log.by, "item"), [*log.by, "item"], "left_anti")


def cells(log: Log) -> DataFrame:
    """(by..., left, right, winner, weight, n): different comparisons and how often each occurs."""
    return log.df.groupBy(*log.by, "left", "right", "winner", "weight").agg(F.count("*").alias("n"))


def edges(log: Log) -> DataFrame:
    """(by..., i, j, win, tie): weight of i beating j and of i and j drawing.

    A draw counts for both directions, so a draw of an item with itself counts twice. Made from the pairs.
    """
    both = log.pairs.select(*log.by, F.inline(F.array(F.struct(F.col("left").alias("i"), F.col("right").alias("j"), F.col("l").alias("win"), F.col("t").alias("tie")), F.struct(F.col("right").alias("i"), F.col("left").alias("j"), F.col("r").alias("win"), F.col("t").alias("tie")))))
    return both.groupBy(*log.by, "i", "j").agg(F.sum("win").alias("win"), F.sum("tie").alias("tie"))
