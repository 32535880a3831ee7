"""Leaderboards over streams of comparisons."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import ranking
from ..operators.log import Log, prepare


def live_counting(stream: DataFrame, win_weight: float = 1.0, tie_weight: float = 0.5, **columns: str) -> DataFrame:
    """(item, score) of everything so far, for update or complete mode: state is one row an item."""
    return ranking.counting(prepare(stream, **columns), None, win_weight, tie_weight)


def windowed_counting(stream: DataFrame, event_time: str, window: str = "1 day", late: str = "2 days", once: str | None = None) -> DataFrame:
    """(start, item, score) by tumbling windows of event time; comparisons later than `late` are left out.

    With `once`, a comparison delivered again within `late` counts once: its key and event time are remembered that long.
    """
    timed = stream.withWatermark(event_time, late)
    if once:
        timed = timed.dropDuplicatesWithinWatermark([once])
    # grouped by the window itself, which carries the watermark, so that append mode can let go of windows that are over
    log = prepare(timed.withColumn("__w", F.window(event_time, window)), by=("__w",))
    return ranking.counting(log).select(F.col("__w.start").alias("start"), "item", "score")


def live_elo(stream: DataFrame, by: str, order: str, initial: float = 1000.0, base: float = 10.0, scale: float = 400.0, k: float = 4.0) -> DataFrame:
    """(by, item, score) updates of Elo ratings, a leaderboard for each value of `by`, in order within each batch.

    State is a rating an item and leaderboard; a batch is sorted before it is played.
    """
    log: Log = prepare(stream, order=order, by=(by,))
    kind = log.df.schema[by].dataType.simpleString()

    def play(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ratings = ranking.EloRatings(initial, base, scale, k)
        if state.exists:
            ratings.score = dict(zip(*state.get))
        rows = pd.concat(list(frames)).sort_values(["ord", "left", "right", "winner", "weight"])
        ratings.play(*(rows[c].tolist() for c in ("left", "right", "winner", "weight")))
        state.update((list(ratings.score), list(ratings.score.values())))
        yield pd.DataFrame({by: key[0], "item": list(ratings.score), "score": ratings.finite()})

    return log.df.groupBy(by).applyInPandasWithState(play, f"`{by}` {kind}, item string, score double", "items array<string>, scores array<double>", "update", GroupStateTimeout.NoTimeout)
