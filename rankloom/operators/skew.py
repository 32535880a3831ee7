"""Per-key work where a few keys hold most rows: fragment and replicate by estimated load.

Loads are counted per key with map-side combination. Keys heavier than a share of one task's load are split into
shards in proportion to their load; everything else falls into a fixed number of hash buckets. Shards and
buckets are packed onto tasks, largest first. The big side's rows of a split key are dealt out over its shards
and only that key's rows of the matching side are copied to the tasks of those shards.

What the driver sees is bounded: at most `tasks / heavy_share` split keys (no more keys than that can each
exceed that share of the load) and `buckets_per_task * tasks` bucket loads, whatever the number of keys or rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, task_count


@dataclass
class LoadPlan:
    """Where rows go: `heavy` has the tasks of each split key, `light` the task of each hash bucket."""

    keys: tuple[str, ...]
    tasks: int
    heavy: DataFrame
    light: DataFrame
    buckets: int
    loads: list[float]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")


def pack(items: list[tuple[float, object]], tasks: int) -> tuple[dict[object, int], list[float]]:
    """Items (load, name) onto the least loaded of `tasks` bins, largest first; ties by order given."""
    bins, where, loads = [(0.0, k) for k in range(tasks)], {}, [0.0] * tasks
    for load, name in sorted(items, key=lambda x: -x[0]):
        total, k = heapq.heappop(bins)
        where[name], loads[k] = k, total + load
        heapq.heappush(bins, (total + load, k))
    return where, loads


def plan_loads(df: DataFrame, keys: Sequence[str], tasks: int | None = None, load: Column | None = None, heavy_share: float = 0.25, buckets_per_task: int = 16) -> LoadPlan:
    """Count the load of each key of `df` (rows, or the sum of `load`) and lay shards and buckets out over tasks.

    A null key is a key like any other. An empty table gives a plan without split keys.
    """
    spark, keys = df.sparkSession, tuple(keys)
    tasks = tasks or task_count(spark)
    counts = cut(df.groupBy(*keys).agg(F.sum(F.lit(1.0) if load is None else load.cast("double")).alias("__load")))
    total = counts.agg(F.sum("__load")).first()[0] or 0.0
    limit = heavy_share * total / tasks
    big = counts.filter(F.col("__load") > limit).orderBy(F.desc("__load"), *keys).collect()
    buckets = buckets_per_task * tasks
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("b")
    small = counts.filter(F.col("__load") <= limit).groupBy(bucket).agg(F.sum("__load").alias("l")).collect()
    # a shard holds at most `limit` and at most one shard of a key goes to a task, so a key never has more shards than tasks
    items: list[tuple[float, object]] = [(r.l, ("light", r.b)) for r in small]
    for k, r in enumerate(big):
        shards = min(tasks, int(-(-r["__load"] // limit)))
        items += [(r["__load"] / shards, ("heavy", k, s)) for s in range(shards)]
    where, loads = pack(items, tasks)
    light = spark.createDataFrame([(b, where.get(("light", b), b % tasks)) for b in range(buckets)], "__b int, __light int")
    rows = [(*(r[c] for c in keys), [where["heavy", k, s] for s in range(tasks) if ("heavy", k, s) in where]) for k, r in enumerate(big)]
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keys), T.StructField("__tasks", T.ArrayType(T.IntegerType()))])
    return LoadPlan(keys, tasks, spark.createDataFrame(rows, schema), light, buckets, loads)


def _with_tasks(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """`df` with the tasks of its key if that is split, else null, and the task of its bucket.

    Both tables are broadcast: the split keys are few by construction and the buckets a fixed number per task.
    """
    heavy = plan.heavy.select(*(F.col(c).alias(f"__h{k}") for k, c in enumerate(plan.keys)), "__tasks")
    same = [df[c].eqNullSafe(heavy[f"__h{k}"]) for k, c in enumerate(plan.keys)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    known = df.join(F.broadcast(heavy), on, "left").drop(*(f"__h{k}" for k in range(len(plan.keys))))
    return known.withColumn("__b", plan.bucket()).join(F.broadcast(plan.light), "__b").drop("__b")


def fragment(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """The big side, each row once, with `__task`: rows of a split key are dealt out over its shards.

    They are dealt by a hash of the row and of the partition it comes from, so a task that is run again deals them the same, whatever order
    they come in, and repeated rows are spread as well.
    """
    dealt = df.withColumn("__share", F.xxhash64(F.spark_partition_id(), *(F.col(f"`{c}`") for c in df.columns)))
    turn = F.pmod(F.col("__share"), F.greatest(F.size("__tasks"), F.lit(1)).cast("bigint")).cast("int")
    return _with_tasks(dealt, plan).withColumn("__task", F.coalesce(F.get("__tasks", turn), "__light")).drop("__tasks", "__light", "__share")


def replicate(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """The matching side with `__task`: rows of a split key once for each task that has one of its shards."""
    tasks = F.coalesce(F.array_distinct("__tasks"), F.array("__light"))
    return _with_tasks(df, plan).withColumn("__task", F.explode(tasks)).drop("__tasks", "__light")


def place(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """Shuffle rows to the tasks the plan names."""
    return df.repartitionById(plan.tasks, F.col("__task"))


def balanced_join(big: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left", plan: LoadPlan | None = None) -> DataFrame:
    """Join on equal keys (nulls match nothing) without a task that holds all rows of a hot key.

    `how` is ``inner`` or ``left``: a row of `big` is on one task only, so either is decided there. Columns of `other` that `big`
    has too, other than the keys, are refused. Result: the columns of `big`, then those of `other` without the keys.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    keys = list(keys)
    if clash := ({*big.columns} & {*other.columns}) - {*keys}:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    plan = plan or plan_loads(big, keys)
    a, b = place(fragment(big, plan), plan), place(replicate(other, plan), plan)
    return a.join(b, ["__task", *keys], how).select(*big.columns, *(c for c in other.columns if c not in keys))


def balanced_aggregate(df: DataFrame, keys: Sequence[str], partial: dict[str, Column], final: dict[str, Column], plan: LoadPlan | None = None) -> DataFrame:
    """Aggregate in two steps: `partial` per key and task, then `final` over the few partial rows of each key."""
    plan = plan or plan_loads(df, keys)
    by_task = place(fragment(df, plan), plan).groupBy("__task", *keys).agg(*(c.alias(n) for n, c in partial.items()))
    return by_task.groupBy(*keys).agg(*(c.alias(n) for n, c in final.items()))


def label_key(column: Column | str) -> Column:
    """A label without outer blanks and letter case."""
    return F.lower(F.btrim(column, F.lit(" \t")))


def combine_in_place(df: DataFrame, held: int = 400_000) -> DataFrame:
    """The different rows of `df`, of strings, with how often each occurs (`n`), combined within each task without a shuffle.

    A row comes out once for each task that has it, and again whenever a task held `held` different ones.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        rows = 0

        def combined() -> pa.Table:
            return pa.concat_tables(parts).group_by(names).aggregate([("n", "sum")]).rename_columns([*names, "n"])

        for batch in batches:
            parts.append(pa.table([*(c.cast(pa.string()) for c in batch.columns), pa.repeat(pa.scalar(1, pa.int64()), batch.num_rows)], names=[*names, "n"]))
            rows += batch.num_rows
            if rows > held:
                parts = [combined()]
                if (rows := parts[0].num_rows) > held // 2:
                    yield from parts[0].to_batches()
                    parts, rows = [], 0
        if parts:
            yield from combined().to_batches()

    return df.mapInArrow(run, ", ".join([*(f"`{c}` string" for c in names), "n bigint"]))


def label_rows(log: DataFrame) -> DataFrame:
    """(side, label, opponent, won, tied, n, key): both sides of a comparison log, combined in place; n comparisons each."""
    log = combine_in_place(log.select("left", "right", F.lower(F.btrim("winner", F.lit(" \t"))).alias("outcome")))
    sides = [
        F.struct(F.lit(side).alias("side"), F.col(f"`{side}`").alias("label"), label_key(f"`{other}`").alias("opponent"), F.coalesce(F.col("outcome") == side, F.lit(False)).alias("won"), F.coalesce(F.col("outcome") == "tie", F.lit(False)).alias("tied"), "n")
        for side, other in (("left", "right"), ("right", "left"))
    ]
    return log.select(F.inline(F.array(*sides))).withColumn("key", label_key("label"))


def label_results(log: DataFrame, items: DataFrame) -> DataFrame:
    """Per side and label of a comparison log: rows, wins, ties and different opponents (side, item, n, wins, ties, opponents).

    Labels are written as in `items` (letter case and outer blanks aside); one that is not there stands as it is, without outer
    blanks or change of case. Every row counts, repeated ones too; a null label is a group of its own, with a null item.
    What each task has of the log is combined there; the combined rows, of which a hot label has the more the more tasks and opponents there are, go
    to their tasks by fragment and replicate and nowhere else before they are added up.
    """
    rows = cut(label_rows(log))
    names = items.select(label_key("item").alias("key"), F.col("item")).dropDuplicates(["key"])
    joined = balanced_join(rows, names, ["key"], plan=plan_loads(rows, ["key"]))
    pairs = joined.groupBy("side", F.coalesce("item", "label").alias("item"), "opponent").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("won"), F.col("n")).otherwise(0)).alias("wins"), F.sum(F.when(F.col("tied"), F.col("n")).otherwise(0)).alias("ties")
    )
    return pairs.groupBy("side", "item").agg(F.sum("n").alias("n"), F.sum("wins").alias("wins"), F.sum("ties").alias("ties"), F.count("opponent").alias("opponents"))


def heavy_labels(results: DataFrame, share: float = 0.02) -> DataFrame:
    """(side, item) of labels that hold at least `share` of their side's rows; a null label never comes out."""
    totals = results.groupBy("side").agg(F.sum("n").alias("total"))
    return results.join(F.broadcast(totals), "side").filter(F.col("item").isNotNull() & (F.col("n") >= F.lit(share) * F.col("total"))).select("side", "item")
