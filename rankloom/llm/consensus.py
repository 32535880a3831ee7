"""Consensus of several annotators' labels: mean-field variational confusion model.

Each annotator has a row of a confusion matrix for each true class, with a Dirichlet prior, and the classes have a Dirichlet prior.
Updates alternate: the class posterior of a unit is the softmax of expected log probabilities (digammas) of its codes, and
the Dirichlet counts of an annotator are sums of those posteriors, by group-by. Annotators who err in a consistent way (a shifted or
reversed scale) are used by what their codes say about the true class; those who code at random weigh nothing.

Units of a sheet stay together in one row, so an iteration reads them in place; what moves is at most
annotators x classes x codes partial sums from each task. Those parameters are the only thing the driver holds; with more annotators than it may hold they
stay in a table (`fit_joined`), and sheets and parameters are joined by fragment and replicate, as one annotator may have a third of the sheets.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotConvergedError, TooLargeError
from ..functions.notation import code_of
from ..operators.skew import balanced_join, plan_loads
from ..session import cut, discard


def latest_sheets(codings: DataFrame, units: Sequence[str], sheet: str = "sheet_id", rater: str = "rater", version: Sequence[str] = ("coded_at", "received_at")) -> DataFrame:
    """(sheet, rater, codes): of each rater and sheet the row with the greatest `version`, codes as an array with null for what is no code.

    Rows without sheet or rater are left out. Equal versions: the greatest contents, so the result does not depend on order.
    """
    codes = F.array(*(code_of(u) for u in units))
    rows = codings.select(F.col(sheet).cast("bigint").alias("sheet"), F.col(rater).cast("string").alias("rater"), F.struct(*(F.col(v) for v in version), codes.alias("codes")).alias("v"))
    return rows.filter("sheet is not null and rater is not null").groupBy("sheet", "rater").agg(F.max("v").alias("v")).select("sheet", "rater", "v.codes")


def digamma(x: np.ndarray) -> np.ndarray:
    """Digamma of positive numbers: recurrence up to 6, then the asymptotic series."""
    x, shift = np.array(x, dtype=float), 0.0
    shift = np.zeros_like(x)
    for _ in range(6):
        shift -= 1 / x
        x = x + 1
    f = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


@dataclass
class Model:
    """Dirichlet parameters: `classes` (K) and `confusion` (raters, K, K), the last axis being the code given."""

    raters: list[str]
    classes: np.ndarray
    confusion: np.ndarray
    iterations: int
    coincidence: np.ndarray

    def expected_logs(self) -> tuple[np.ndarray, np.ndarray]:
        return digamma(self.classes) - digamma(self.classes.sum()), digamma(self.confusion) - digamma(self.confusion.sum(2, keepdims=True))

    def reliability(self, level: float = 0.95, draws: int = 2000, seed: int = 7, seeds: Sequence[int] | None = None) -> list[tuple[str, float, float, float, float]]:
        """(rater, codes, mean, low, high): the posterior of the share of right codes, classes as frequent as in the whole.

        Draws from the Dirichlet marginals of the diagonals; a rater at a time.
        """
        share, out = self.classes / self.classes.sum(), []
        for k, rater in enumerate(self.raters):
            a = self.confusion[k]
            right, rest = a.diagonal(), a.sum(1) - a.diagonal()
            drawn = np.random.default_rng([seed, k if seeds is None else seeds[k]]).beta(right, rest, (draws, len(right))) @ share
            low, high = np.quantile(drawn, [(1 - level) / 2, (1 + level) / 2])
            out.append((rater, float(a.sum() - self.prior_weight()), float((right / a.sum(1)) @ share), float(low), float(high)))
        return out

    def prior_weight(self) -> float:
        return float(_prior(len(self.classes)).sum())


def _prior(k: int) -> np.ndarray:
    return np.full((k, k), 0.5) + 2.0 * np.eye(k)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Units of a batch of packed sheets: of each code its unit (row number x units of a sheet + position), rater and code (0 based)."""
    codes = batch.column(2)
    per = batch.column(3)
    width = int(per[0].as_py()) if batch.num_rows else 0
    raters = batch.column(1)
    counts = pa.compute.list_value_length(raters).to_numpy(zero_copy_only=False)
    r = raters.flatten().to_numpy(zero_copy_only=False)
    c = codes.flatten().to_numpy(zero_copy_only=False).reshape(len(r), width) if len(r) else np.zeros((0, width), np.int8)
    unit = np.repeat(np.arange(batch.num_rows), counts)[:, None] * width + np.arange(width)
    known = c > 0
    return unit[known], np.broadcast_to(r[:, None], c.shape)[known], c[known].astype(np.int64) - 1, batch.num_rows * width


def _posterior(unit: np.ndarray, rater: np.ndarray, code: np.ndarray, n: int, k: int, logs: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Class posteriors of n units; without parameters, the shares of votes."""
    if logs is None:
        votes = np.bincount(unit * k + code, minlength=n * k).reshape(n, k).astype(float)
        return votes / np.maximum(votes.sum(1, keepdims=True), 1)
    score = np.tile(logs[0], (n, 1))
    for c in range(k):
        score[:, c] += np.bincount(unit, logs[1][rater, c, code], n)
    score = np.exp(score - score.max(1, keepdims=True))
    return score / score.sum(1, keepdims=True)


MAX_RATERS = 50_000


def pack_sheets(latest: DataFrame, width: int, max_raters: int = MAX_RATERS) -> tuple[DataFrame, list[str]]:
    """(sheet, raters, codes, width) with one row a sheet, in the checkpoint folder, and the raters by number.

    A sheet holds each rater once, so a row is bounded by `max_raters`. More raters than that raise TooLargeError, as the parameters would not
    fit the driver: those are for `fit_joined`.
    """
    names = [r.rater for r in latest.select("rater").distinct().limit(max_raters + 1).collect()]
    if len(names) > max_raters:
        raise TooLargeError(f"more than {max_raters} raters")
    names.sort()
    spark = latest.sparkSession
    numbers = spark.createDataFrame([(r, k) for k, r in enumerate(names)], "rater string, number int")
    coded = latest.join(F.broadcast(numbers), "rater").select("sheet", "number", F.transform("codes", lambda c: F.coalesce(c, F.lit(0).cast("tinyint"))).alias("codes"))
    rows = coded.groupBy("sheet").agg(F.sort_array(F.collect_list(F.struct("number", "codes"))).alias("s"))
    return cut(rows.select("sheet", F.col("s.number").alias("raters"), F.flatten("s.codes").alias("codes"), F.lit(width).alias("width"))), names


def fit(packed: DataFrame, names: list[str], k: int = 5, tolerance: float = 1e-3, limit: int = 500) -> Model:
    """Iterate until no annotator's row of mean confusion moves by more than `tolerance`; NotConvergedError if `limit` iterations do not do."""
    prior, model = _prior(k), None
    coincidence = np.zeros((k, k))
    for step in range(1, limit + 1):
        logs = model.expected_logs() if model else None
        raters = len(names)

        def sums(batches: Iterator[pa.RecordBatch], logs: tuple | None = logs, first: bool = model is None) -> Iterator[pa.RecordBatch]:
            total, classes, co = np.zeros(raters * k * k), np.zeros(k), np.zeros((k, k))
            for batch in batches:
                unit, rater, code, n = _flat(batch)
                if not len(unit):
                    continue
                post = _posterior(unit, rater, code, n, k, logs)
                counts = np.bincount(unit * k + code, minlength=n * k).reshape(n, k).astype(float)
                m = counts.sum(1)
                classes += post[m > 0].sum(0)
                for c in range(k):
                    total += np.bincount((rater * k + c) * k + code, post[unit, c], raters * k * k)
                if first:
                    pairable = counts[m > 1] / (m[m > 1] - 1)[:, None]
                    co += pairable.T @ counts[m > 1] - np.diag(pairable.sum(0))
            for kind, values in ((0, total), (1, classes), (2, co.ravel())):
                at = np.flatnonzero(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int64()), pa.array(values[at])], ["kind", "cell", "v"])

        found = packed.mapInArrow(sums, "kind int, cell bigint, v double").groupBy("kind", "cell").agg(F.sum("v").alias("v")).toPandas()
        part = {kind: g for kind, g in found.groupby("kind")}

        def dense(kind: int, size: int) -> np.ndarray:
            out = np.zeros(size)
            if kind in part:
                out[part[kind]["cell"].to_numpy()] = part[kind]["v"].to_numpy()
            return out

        if model is None:
            coincidence = dense(2, k * k).reshape(k, k)
        new = Model(names, 1.0 + dense(1, k), prior + dense(0, raters * k * k).reshape(raters, k, k), step, coincidence)
        share = lambda m: m.confusion / m.confusion.sum(2, keepdims=True)
        done = model is not None and (not raters or np.abs(share(new) - share(model)).max() < tolerance)
        model = new
        if done:
            return model
    raise NotConvergedError(f"the confusion model moved by more than {tolerance} after {limit} iterations")


def units(packed: DataFrame, model: Model) -> DataFrame:
    """(sheet_id, unit, label, confidence, codes, different): each unit with at least one code; label 1.. is the most probable class, the lower of equal ones."""
    k, logs = len(model.classes), model.expected_logs()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, rater, code, n = _flat(batch)
            if not len(unit):
                continue
            post = _posterior(unit, rater, code, n, k, logs)
            counts = np.bincount(unit * k + code, minlength=n * k).reshape(n, k)
            width = n // batch.num_rows
            sheet = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), width)
            some = np.flatnonzero(counts.sum(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sheet[some], pa.int64()), pa.array(some % width, pa.int64()), pa.array(post[some].argmax(1) + 1, pa.int64()), pa.array(post[some].max(1)), pa.array(counts[some].sum(1), pa.int64()), pa.array((counts[some] > 0).sum(1), pa.int64())],
                ["sheet_id", "unit", "label", "confidence", "codes", "different"],
            )

    return packed.mapInArrow(read, "sheet_id bigint, unit bigint, label bigint, confidence double, codes bigint, different bigint")


def krippendorff(coincidence: np.ndarray, distance: str) -> tuple[float, float, float]:
    """(alpha, observed, expected) of a coincidence matrix of classes 1.. under nominal, ordinal or interval distance; 1 if nothing varies."""
    n_c, k = coincidence.sum(1), len(coincidence)
    n = n_c.sum()
    if n <= 1:
        return float("nan"), 0.0, 0.0
    at = {"nominal": None, "ordinal": np.cumsum(n_c) - n_c / 2, "interval": np.arange(1, k + 1.0)}[distance]
    delta = 1 - np.eye(k) if at is None else (at[:, None] - at[None, :]) ** 2
    observed = float((coincidence * delta).sum())
    expected = float(((np.outer(n_c, n_c) - np.diag(n_c)) / (n - 1) * delta).sum())
    return (1 - observed / expected if expected else float(observed == 0)), observed, expected


@dataclass
class JoinedModel:
    """The fitted model with its annotators in a table (rater, m), m the sums of class posteriors by class and code."""

    table: DataFrame
    classes: np.ndarray
    iterations: int
    coincidence: np.ndarray

    def raters_frame(self) -> DataFrame:
        classes, co = self.classes, self.coincidence

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k, names = len(classes), batch.column(0).to_pylist()
                m = _prior(k) + _rows(batch.column(1), k * k).reshape(-1, k, k)
                told = Model(names, classes, m, 0, co).reliability(seeds=[zlib.crc32(n.encode()) for n in names])
                yield pa.RecordBatch.from_pandas(pd.DataFrame(told, columns=["rater", "codes", "reliability", "low", "high"]), preserve_index=False)

        return self.table.mapInArrow(read, "rater string, codes double, reliability double, low double, high double")


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _arrays(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))


def _per_batch(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    return df.mapInArrow(lambda batches: (work(b) for b in batches if b.num_rows), schema)


def _sum_arrays(df: DataFrame, key: str, column: str, width: int) -> DataFrame:
    """(key, column): arrays of one length added up by key, combined map-side."""
    sums = df.groupBy(key).agg(*(F.sum(F.col(column)[n]).alias(f"s{n}") for n in range(width)))
    return sums.select(key, F.array(*(f"s{n}" for n in range(width))).alias(column))


def fit_joined(latest: DataFrame, width: int, k: int = 5, tolerance: float = 1e-3, limit: int = 500) -> tuple[DataFrame, JoinedModel]:
    """The labels of the units, as `units` gives them, and the model, with any number of annotators.

    An iteration joins the sheets with their annotators' parameters, adds up the evidence of each sheet, joins the posteriors back and adds
    up the counts of each annotator. The driver sees the counts of classes and the greatest change.
    """
    rows = cut(latest.select("sheet", "rater", F.transform("codes", lambda c: F.coalesce(c, F.lit(0).cast("tinyint"))).alias("codes")))
    by_rater, by_sheet = plan_loads(rows, ["rater"]), plan_loads(rows, ["sheet"])
    size, unit = width * k, np.arange(width)

    def votes_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = _rows(batch.column(1), width).astype(np.int64)
        out = np.zeros((len(c), width, k))
        row, at = np.nonzero(c)
        out[row, at, c[row, at] - 1] = 1
        return pa.RecordBatch.from_arrays([batch.column(0), _arrays(out.reshape(len(c), size))], ["sheet", "v"])

    votes = cut(_sum_arrays(_per_batch(rows.select("sheet", "codes"), "sheet bigint, v array<double>", votes_of), "sheet", "v", size))

    def pairs_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = _rows(batch.column(0), size).reshape(-1, k)
        n = n[n.sum(1) > 1]
        share = n / (n.sum(1, keepdims=True) - 1)
        return pa.RecordBatch.from_arrays([pa.array([0]), _arrays((share.T @ n - np.diag(share.sum(0))).reshape(1, k * k))], ["all", "v"])

    co = _sum_arrays(_per_batch(votes.select("v"), "all bigint, v array<double>", pairs_of), "all", "v", k * k).first()
    coincidence = np.array(co["v"]).reshape(k, k) if co else np.zeros((k, k))

    def evidence_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, m = _rows(batch.column(1), width).astype(np.int64), _prior(k) + _rows(batch.column(2), k * k).reshape(-1, k, k)
        logs = digamma(m) - digamma(m.sum(2, keepdims=True))
        got = logs[np.arange(len(c))[:, None, None], np.arange(k)[None, None, :], np.maximum(c - 1, 0)[:, :, None]]
        return pa.RecordBatch.from_arrays([batch.column(0), _arrays((got * (c > 0)[:, :, None]).reshape(len(c), size))], ["sheet", "v"])

    def posterior(classes: np.ndarray | None) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            v, n = _rows(batch.column(1), size).reshape(-1, width, k), _rows(batch.column(2), size).reshape(-1, width, k).sum(2, keepdims=True)
            if classes is None:
                post = v / np.maximum(n, 1)
            else:
                v = v + digamma(classes) - digamma(classes.sum())
                v = np.exp(v - v.max(2, keepdims=True))
                post = v / v.sum(2, keepdims=True) * (n > 0)
            return pa.RecordBatch.from_arrays([batch.column(0), _arrays(post.reshape(len(v), size))], ["sheet", "post"])

        return work

    def counts_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, post = _rows(batch.column(1), width).astype(np.int64), _rows(batch.column(2), size).reshape(-1, width, k)
        out = np.zeros((len(c), k, k + 1))
        np.add.at(out, (np.arange(len(c))[:, None, None], np.arange(k)[None, None, :], c[:, :, None]), post)
        return pa.RecordBatch.from_arrays([batch.column(0), _arrays(out[:, :, 1:].reshape(len(c), k * k))], ["rater", "m"])

    def moved(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (_prior(k) + _rows(c, k * k).reshape(-1, k, k) for c in batch.columns)
        return pa.RecordBatch.from_arrays([pa.array([np.abs(a / a.sum(2, keepdims=True) - b / b.sum(2, keepdims=True)).max()])], ["d"])

    table, classes = None, None
    for step in range(1, limit + 1):
        if table is None:
            scored = votes.select("sheet", "v", F.col("v").alias("n"))
        else:
            joined = balanced_join(rows, table, ["rater"], "inner", by_rater).select("sheet", "codes", "m")
            scored = _sum_arrays(_per_batch(joined, "sheet bigint, v array<double>", evidence_of), "sheet", "v", size).join(votes.withColumnRenamed("v", "n"), "sheet")
        post = cut(_per_batch(scored, "sheet bigint, post array<double>", posterior(classes)))
        sums = post.agg(*(F.sum(sum((F.col("post")[u * k + c] for u in range(1, width)), F.col("post")[c])).alias(f"c{c}") for c in range(k))).first()
        back = balanced_join(rows, post, ["sheet"], "inner", by_sheet).select("rater", "codes", "post")
        new = cut(_sum_arrays(_per_batch(back, "rater string, m array<double>", counts_of), "rater", "m", k * k))
        change = None
        if table is not None:
            both = new.join(table.withColumnRenamed("m", "before"), "rater").select("m", "before")
            change = _per_batch(both, "d double", moved).agg(F.max("d")).first()[0]
            discard(table, last)
        new_classes = 1.0 + np.array([x or 0.0 for x in sums])
        if table is not None and (change or 0.0) < tolerance:
            break
        table, last, classes = new, post, new_classes
    else:
        raise NotConvergedError(f"the confusion model moved by more than {tolerance} after {limit} iterations")
    final = balanced_join(rows, new, ["rater"], "inner", by_rater).select("sheet", "codes", "m")
    scored = _sum_arrays(_per_batch(final, "sheet bigint, v array<double>", evidence_of), "sheet", "v", size).join(votes.withColumnRenamed("v", "n"), "sheet")
    told = _per_batch(scored, "sheet bigint, post array<double>", posterior(new_classes)).join(votes, "sheet")

    def labels_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        post, n = _rows(batch.column(1), size).reshape(-1, k), _rows(batch.column(2), size).reshape(-1, k)
        some = np.flatnonzero(n.sum(1))
        sheet = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), width)
        whole = lambda x: pa.array(x.astype(np.int64), pa.int64())
        return pa.RecordBatch.from_arrays(
            [whole(sheet[some]), whole(np.tile(unit, batch.num_rows)[some]), whole(post[some].argmax(1) + 1), pa.array(post[some].max(1)), whole(n[some].sum(1)), whole((n[some] > 0).sum(1))],
            ["sheet_id", "unit", "label", "confidence", "codes", "different"],
        )

    labels = _per_batch(told, "sheet_id bigint, unit bigint, label bigint, confidence double, codes bigint, different bigint", labels_of)
    return labels, JoinedModel(new, new_classes, step, coincidence)


def consensus(codings: DataFrame, columns: Sequence[str], k: int = 5, max_raters: int = MAX_RATERS) -> tuple[DataFrame, Model | JoinedModel]:
    """The units with their labels, and the fitted model. An empty table gives no units and no raters."""
    latest = cut(latest_sheets(codings, columns))
    try:
        packed, names = pack_sheets(latest, len(columns), max_raters)
    except TooLargeError:
        return fit_joined(latest, len(columns), k)
    model = fit(packed, names, k)
    return units(packed, model), model


def unit_columns(df: DataFrame) -> list[str]:
    """c0, c1, ... of a table, in order."""
    return sorted((c for c in df.columns if re.fullmatch(r"c\d+", c)), key=lambda c: int(c[1:]))


def raters_frame(df: DataFrame, model: Model | JoinedModel) -> DataFrame:
    """(rater, codes, reliability, low, high) of each annotator."""
    if isinstance(model, JoinedModel):
        return model.raters_frame()
    rows = pd.DataFrame(model.reliability(), columns=["rater", "codes", "reliability", "low", "high"])
    return df.sparkSession.createDataFrame(rows, "rater string, codes double, reliability double, low double, high double")
