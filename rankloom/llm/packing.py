"""Filling containers of fixed capacity: bounded-space online packing.

In each partition a fixed number of windows is open. A text goes into the window it fits best, that is, leaves least room in; if
it fits none, the fullest window is closed and a new one opened. A text longer than a container is cut into full pieces and a rest. The windows
still open at the end are merged afterwards: those of up to `fan_in` partitions at a time are packed best-fit, fullest first, the
emptiest go on to the next level, until one group is left. Only windows (number and fill) move there, not texts.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
CAPACITY = 2048
#: how byte-level BPE splits text before merging: a fixed value of the vocabulary
# fixed value: Unicode white space
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: white space that the splitting pattern would step back through: a run but for the character before a word
_RUN = re.compile(f"[{_SPACE}]{{10000,}}(?=[{_SPACE}]|\\Z)")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Callable[[str], int]:
    """Counts the tokens of whole texts; a file of ranks (.tiktoken), read once a worker: at this path there or, failing that, as sent by `SparkContext.addFile`."""
    import tiktoken

    path = vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary))
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(text: str) -> int:
        # such a run is one piece of the pattern, which overflows its stack on the longest; what is around it splits as before
        n = at = 0
        for run in _RUN.finditer(text):
            n += len(coder.encode_ordinary(text[at : run.start()])) + len(coder._encode_single_piece(run[0]))
            at = run.end()
        return n + len(coder.encode_ordinary(text[at:]))

    return count


class OpenWindows:
    """At most `most` open windows of one partition. `put` returns the window of a piece."""

    def __init__(self, capacity: int, most: int, first: int) -> None:
        self.capacity, self.most, self.next = capacity, most, first
        self.ids: list[int] = []
        self.room: list[int] = []

    def put(self, size: int) -> int:
        best, room = -1, self.capacity + 1
        for k, r in enumerate(self.room):
            if size <= r < room:
                best, room = k, r
        if best < 0:
            if len(self.ids) >= self.most:
                full = min(range(len(self.room)), key=self.room.__getitem__)
                del self.ids[full], self.room[full]
            self.ids.append(self.next)
            self.room.append(self.capacity)
            self.next += 1
            best = len(self.ids) - 1
        self.room[best] -= size
        window, left = self.ids[best], self.room[best]
        if left == 0:
            del self.ids[best], self.room[best]
        return window

    def full(self) -> int:
        """A window for a piece that fills it alone."""
        self.next += 1
        return self.next - 1


def open_packing(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, windows: int = 16, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, piece, first_token, n_tokens, container, open) before leftovers are merged; null and empty texts are one piece of 0 tokens."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, first = encoder(vocabulary), TaskContext.get().partitionId() << 36
        state = OpenWindows(capacity, windows, first)
        names = ["key", "piece", "first_token", "n_tokens", "container"]
        # rows leave as they come; which windows stayed open is told at the end by a row without key for each
        for batch in batches:
            keys, rows = batch.column(0), []
            for at, value in enumerate(batch.column(1).to_pylist()):
                n, piece = count(value) if value else 0, 0
                for start in range(0, n - capacity + 1, capacity) if n > capacity else ():
                    rows.append((at, piece, start, capacity, state.full()))
                    piece += 1
                rest = n - piece * capacity
                if rest or not piece:
                    rows.append((at, piece, piece * capacity, rest, state.put(rest)))
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(c[0])), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64()), pa.array([False] * len(rows))], [*names, "open"])
        if state.ids:
            m = len(state.ids)
            held = [capacity - r for r in state.room]
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa_type(kind)), pa.array([-1] * m, pa.int32()), pa.array([0] * m, pa.int64()), pa.array(held, pa.int64()), pa.array(state.ids, pa.int64()), pa.array([True] * m)], [*names, "open"])

    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, piece int, first_token bigint, n_tokens bigint, container bigint, open boolean")


def pa_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def best_fit(fills: np.ndarray, capacity: int) -> np.ndarray:
    """Window numbers 0.. of fills given fullest first: each into the fullest window with room. Windows are kept by room, one list of windows for each."""
    from bisect import bisect_left, insort

    rooms: list[tuple[int, int]] = []
    out, made = np.empty(len(fills), np.int64), 0
    for k, fill in enumerate(fills.tolist()):
        at = bisect_left(rooms, (fill, -1))
        if at < len(rooms):
            room, window = rooms.pop(at)
        else:
            room, window, made = capacity, made, made + 1
        out[k] = window
        insort(rooms, (room - fill, window))
    return out


def merge_leftovers(leftovers: DataFrame, capacity: int, keep: int, fan_in: int = 64) -> DataFrame:
    """(container, merged) for windows (container, fill) left open: the window each is emptied into, itself included.

    A task packs the windows of `fan_in` partitions, at most `fan_in * keep` of them, and hands on the `keep` emptiest.
    """
    found = leftovers.agg(F.max(F.shiftright("container", 36))).first()[0]
    if found is None:
        return leftovers.select("container", F.col("container").alias("merged"))
    groups, level = int(found) + 1, leftovers.select(F.shiftright("container", 36).alias("g"), "container", "fill")
    links = None
    while True:

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["fill", "container"], ascending=[False, True]).reset_index(drop=True)
            window = best_fit(pdf["fill"].to_numpy(), capacity)
            head = pdf.groupby(window)["container"].transform("first")
            total = pdf.groupby(window)["fill"].transform("sum")
            sizes = total[~head.duplicated()].sort_values(kind="stable")
            on = set(head[sizes.index[:keep]])
            return pd.DataFrame({"g": pdf["g"], "container": pdf["container"], "merged": head, "fill": total, "on": head.isin(on)})

        grouped = level.withColumn("g", F.floor(F.col("g") / F.lit(fan_in)).cast("bigint"))
        packed = cut(grouped.groupBy("g").applyInPandas(pack, "g bigint, container bigint, merged bigint, fill bigint, `on` boolean"))
        step = packed.select("container", "merged")
        links = step if links is None else links.withColumnRenamed("merged", "m").join(step.select(F.col("container").alias("m"), F.col("merged").alias("n")), "m", "left").select("container", F.coalesce("n", "m").alias("merged"))
        groups = -(-groups // fan_in)
        if groups == 1:
            return links
        level = packed.filter("`on`").select("g", F.col("merged").alias("container"), "fill").distinct()


def pack(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, windows: int = 16, vocabulary: str = VOCABULARY, fan_in: int = 64) -> DataFrame:
    """(key, piece, first_token, n_tokens, container): a row for each text, or for each piece of a text longer than `capacity`.

    No container holds more than `capacity` tokens. Every row of `df` comes out, repeated and null keys too; a null or empty text takes no room.
    Placement is written to the checkpoint folder before leftovers are merged, so that both see the same.
    """
    placed = cut(open_packing(df, key, text, capacity, windows, vocabulary))
    leftovers = placed.filter("open").select("container", F.col("n_tokens").alias("fill"))
    merged = merge_leftovers(leftovers, capacity, windows, fan_in)
    rows = placed.filter("not open").drop("open").join(merged, "container", "left")
    return rows.select(F.col("key").alias(key), "piece", "first_token", "n_tokens", F.coalesce("merged", "container").alias("container"))


def split_texts(packed: DataFrame, key: str) -> DataFrame:
    """The texts in more than one piece."""
    return packed.filter("piece = 1").select(key).distinct()


def audit(packed: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """One row (keys, overfull, gaps): different keys, containers beyond `capacity`, and keys whose pieces do not follow each other from token 0 with all but the last full."""
    held = packed.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("overfull"))
    wrong = (F.col("first_token") != F.col("piece") * capacity) | (F.col("n_tokens") > capacity) | (F.col("n_tokens") < 0)
    texts = packed.groupBy(key).agg(F.max("piece").alias("last"), F.count("*").alias("n"), F.count_if(wrong).alias("wrong"), F.count_if(F.col("n_tokens") < capacity).alias("short"))
    bad = (F.col("wrong") > 0) | (F.col("n") != F.col("last") + 1) | (F.col("short") > 1)
    told = texts.agg(F.count("*").alias("keys"), F.count_if(bad).alias("gaps"))
    return told.join(F.broadcast(held)).select("keys", "overfull", "gaps")
