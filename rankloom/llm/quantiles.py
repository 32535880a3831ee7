"""Percentiles of very large numeric columns from dyadic Count-sketches.

A value is encoded as one of 2**bits ordered codes (logarithmic, so that a code stands for values within `resolution` of each
other, relatively). For each binary resolution of the codes there is one signed sketch: plain counters while they fit in a
row, Count-sketch rows (bucket and sign by hash) below. A sketch is linear: sketches of partitions or days add up to the
sketch of all, and a negative weight takes a value out again. A percentile is found by descending the levels.

Error: in value at most half a code, `resolution / 2` relatively; in rank what each answer says (`rank_error`): three standard errors. The signs
of a row are random, so its error is as likely positive as negative and the spread of the `depth` rows' estimates tells that of their median;
levels add up as independent. It is zero where no codes collide, as in groups with few different ones, shrinks with the root of
`width`, and holds for merged sketches as for any other. Values that share a code share a rank.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """`bits`: levels; `resolution`: width of a code in natural logarithms; `width` (a power of two) and `depth` of the sketch rows."""

    bits: int = 20
    resolution: float = 0.01
    width: int = 512
    depth: int = 7

    @property
    def exact(self) -> int:
        """The last level with a counter for each node."""
        return self.width.bit_length() - 1

    @property
    def size(self) -> int:
        return (2 << self.exact) - 1 + (self.bits - self.exact) * self.depth * self.width

    def limit(self) -> int:
        """Codes of positive values are centre + 1 + limit + floor(ln v / resolution), cut off at both ends of the double range."""
        return (1 << (self.bits - 2)) - 1

    def code(self, value: Column) -> Column:
        """The ordered code of a finite double; 0.0 has the one in the middle."""
        centre, lim = 1 << (self.bits - 1), self.limit()
        size = F.greatest(F.lit(-lim), F.least(F.lit(lim), F.floor(F.ln(F.abs(value)) / F.lit(self.resolution)).cast("int"))) + F.lit(lim + 1)
        return (F.when(value > 0, F.lit(centre) + size).when(value < 0, F.lit(centre) - size).otherwise(F.lit(centre))).cast("int")

    def decode(self, code: np.ndarray) -> np.ndarray:
        """The middle of a code's values."""
        off = code.astype(np.int64) - (1 << (self.bits - 1))
        return np.sign(off) * np.where(off == 0, 0.0, np.exp((np.abs(off) - self.limit() - 1 + 0.5) * self.resolution))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser of multiply and xor-shift steps."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Sketch:
    """The counters of all levels in one vector; level l counts the first l bits of a code."""

    def __init__(self, shape: Shape, cells: np.ndarray | None = None) -> None:
        self.shape = shape
        self.cells = np.zeros(shape.size, dtype=np.int64) if cells is None else cells

    def _places(self, level: int, row: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.shape
        h = _mix(nodes, level * 64 + row)
        base = (2 << s.exact) - 1 + ((level - s.exact - 1) * s.depth + row) * s.width
        return base + (h & np.uint64(s.width - 1)).astype(np.int64), 1 - 2 * ((h >> np.uint64(63)).astype(np.int64))

    def add(self, codes: np.ndarray, weights: np.ndarray) -> "Sketch":
        s = self.shape
        for level in range(s.bits + 1):
            nodes = codes.astype(np.int64) >> (s.bits - level)
            if level <= s.exact:
                self._count((1 << level) - 1, nodes, weights, 1 << level)
            else:
                for row in range(s.depth):
                    at, sign = self._places(level, row, nodes)
                    base = (2 << s.exact) - 1 + ((level - s.exact - 1) * s.depth + row) * s.width
                    self._count(base, at - base, sign * weights, s.width)
        return self

    def _count(self, base: int, at: np.ndarray, weights: np.ndarray, size: int) -> None:
        """Add to `size` cells from `base`; in halves, so that sums of doubles are exact."""
        for part, unit in ((weights >> 31, 1 << 31), (weights & 0x7FFFFFFF, 1)):
            if part.any():
                self.cells[base : base + size] += np.bincount(at, part, size).astype(np.int64) * unit

    def merge(self, other: "Sketch") -> "Sketch":
        if other.shape != self.shape:
            raise ValueError("sketches of different shapes")
        self.cells += other.cells
        return self

    @property
    def n(self) -> int:
        return int(self.cells[0])

    def count(self, level: int, node: int) -> tuple[float, float]:
        """The estimated count of a node, the median of its rows, and the variance of that median."""
        if level <= self.shape.exact:
            return float(self.cells[(1 << level) - 1 + node]), 0.0
        nodes, found = np.array([node]), []
        for row in range(self.shape.depth):
            at, sign = self._places(level, row, nodes)
            found.append(float(sign[0] * self.cells[at[0]]))
        found.sort()
        # the spread of the rows without the outermost two: the median does not feel a row where a large count collides
        spread = (found[-2] - found[1]) / 1.5 if len(found) > 3 else found[-1] - found[0]
        return float(np.median(found)), spread**2 * (np.pi / 2) / len(found)

    def quantile(self, q: float) -> tuple[float, float]:
        """The value of rank ceil(q n), and three standard errors of its rank as a share of n; NaN for an empty sketch."""
        if self.n <= 0:
            return float("nan"), float("nan")
        rank, node, inside, variance = max(1.0, float(np.ceil(q * self.n))), 0, float(self.n), 0.0
        for level in range(1, self.shape.bits + 1):
            # the two children share what the parent holds, so each is also what the other leaves
            (a, var_a), (b, var_b) = self.count(level, 2 * node), self.count(level, 2 * node + 1)
            left = min(inside, max(0.0, (a + inside - b) / 2))
            variance += (var_a + var_b) / 4
            if rank <= left:
                node, inside = 2 * node, left
            else:
                node, rank, inside = 2 * node + 1, rank - left, inside - left
        return float(self.shape.decode(np.array([node]))[0]), min(1.0, 3 * math.sqrt(variance) / self.n)

    def to_bytes(self) -> bytes:
        s = self.shape
        return struct.pack("<iidii", 1, s.bits, s.resolution, s.width, s.depth) + zlib.compress(self.cells.tobytes(), 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> "Sketch":
        version, bits, resolution, width, depth = struct.unpack_from("<iidii", data)
        if version != 1:
            raise ValueError(f"sketch version {version}")
        return cls(Shape(bits, resolution, width, depth), np.frombuffer(zlib.decompress(data[struct.calcsize("<iidii") :]), dtype=np.int64).copy())


def _schema(df: DataFrame, keys: Sequence[str], rest: str) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), rest])


def sketch_groups(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, shape: Shape = Shape()) -> DataFrame:
    """(keys, sketch): one sketch for each group of `keys` (null is a group like any other).

    Null, NaN and infinite values don't count; a group without others has no row. `weight` is a whole number, negative to take a value
    out; null is 0. Rows are counted by group and code before anything moves, so a group brings at most its different codes to
    its task, however many rows it has.
    """
    if "sketch" in keys:
        raise ValueError("a key named sketch")
    v = F.col(value).cast("double")
    good = df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    counts = good.groupBy(*keys, shape.code(v).alias("__code")).agg(F.sum(F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))).cast("bigint").alias("__n"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        sketch = Sketch(shape).add(pdf["__code"].to_numpy(), pdf["__n"].to_numpy())
        return pdf.loc[:0, list(keys)].iloc[:1].assign(sketch=[sketch.to_bytes()])

    return counts.groupBy(*keys).applyInPandas(build, _schema(df, keys, "sketch binary"))


def merge_sketches(sketches: DataFrame, keys: Sequence[str], salts: int = 16, held: int = 64) -> DataFrame:
    """(keys, sketch): the sums of the sketches of each group of `keys`.

    Sketches are added up within partitions (at most `held` groups open at a time), then in `salts` shares of each group, then
    the shares: no task holds a group's sketches all at once. All must have one shape.
    """
    schema = _schema(sketches, keys, "sketch binary")

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened: dict[tuple, Sketch] = {}

        def out() -> pd.DataFrame:
            rows = [(*k, s.to_bytes()) for k, s in opened.items()]
            opened.clear()
            return pd.DataFrame(rows, columns=[*keys, "sketch"])

        for pdf in frames:
            for *key, data in pdf[[*keys, "sketch"]].itertuples(index=False, name=None):
                key, sketch = tuple(None if k is None or k != k else k for k in key), Sketch.from_bytes(data)
                if key in opened:
                    opened[key].merge(sketch)
                else:
                    opened[key] = sketch
                if len(opened) > held:
                    yield out()
        if opened:
            yield out()

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = Sketch.from_bytes(pdf["sketch"].iloc[0])
        for data in pdf["sketch"].iloc[1:]:
            sums.merge(Sketch.from_bytes(data))
        return pdf[list(pdf.columns)].iloc[:1].assign(sketch=[sums.to_bytes()])

    parts = sketches.select(*keys, "sketch").mapInPandas(partial, schema).withColumn("__salt", F.pmod(F.xxhash64("sketch"), F.lit(salts)).cast("int"))
    shares = parts.groupBy(*keys, "__salt").applyInPandas(total, _schema(parts, keys, "sketch binary, __salt int")).drop("__salt")
    return shares.groupBy(*keys).applyInPandas(total, schema)


def percentiles(sketches: DataFrame, keys: Sequence[str], pcts: Sequence[float]) -> DataFrame:
    """(keys, pct, value, rank_error, n): a row for each sketch and percentile (0 to 100).

    The share of values up to `value` is within `rank_error` of pct / 100 (see above), give or take the values of its own code. NaN where nothing is
    left to count.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for *key, data in pdf[[*keys, "sketch"]].itertuples(index=False, name=None):
                sketch = Sketch.from_bytes(data)
                rows += [(*key, float(p), *sketch.quantile(p / 100), sketch.n) for p in pcts]
            yield pd.DataFrame(rows, columns=[*keys, "pct", "value", "rank_error", "n"])

    return sketches.mapInPandas(read, _schema(sketches, keys, "pct double, value double, rank_error double, n bigint"))


def timings_once(runs: DataFrame) -> DataFrame:
    """(algorithm, solver, day, time) of each run once; only finite positive times. Rows without run_id cannot be told to repeat another, so each counts.

    What a day and a time are is fixed before runs are told apart, so the rows that move are narrow.
    """
    good = runs.filter((F.col("time") > 0) & (F.col("time") < float("inf"))).select("run_id", "algorithm", "solver", F.to_date("started_at").alias("day"), "time")
    one = good.filter("run_id is not null").dropDuplicates(["run_id"]).unionAll(good.filter("run_id is null"))
    return one.select("algorithm", "solver", F.date_format("day", "yyyy-MM-dd").alias("day"), "time")


def iso_week(day: Column) -> Column:
    """ISO week, as 2016-W04, of a day."""
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), day).cast("int"), F.weekofyear(day))
