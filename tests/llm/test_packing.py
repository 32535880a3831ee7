import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.llm import packing as P

needs_vocabulary = pytest.mark.skipif(not os.path.exists(P.VOCABULARY), reason="no vocabulary file")


@needs_vocabulary
def test_long_runs_are_counted_whole():
    """As the vocabulary's merges, done one by one on a short run and by halves that meet at a blank on a long text, say."""
    import base64

    import tiktoken

    with open(P.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    def merged(piece):
        parts = [bytes([b]) for b in piece.encode()]
        while pairs := [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
            k = min(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return len(parts)

    count, rng = P.encoder(P.VOCABULARY), np.random.default_rng(6)
    for n in (50, 600, 1500):
        run = "".join(rng.choice(list("abcdefghij"), n))
        assert count(run) == merged(run)
    long = "".join(rng.choice(list("abcdefghij"), 60_000))
    assert count(long + " " + long) == count(long) + count(" " + long)
    whole = tiktoken.Encoding("whole", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for space in (" " * 20_000, "\n" * 15_000, " \t" * 9_000, "\u2003\n" * 9_000):
        for text in (space, "a" + space, space + "b", "a" + space + "b", f"one{space}two{space}, three{space}"):
            assert count(text) == len(whole.encode_ordinary(text))
    assert count("a" + " " * 3_000_000 + "b") > 10


@given(st.lists(st.integers(0, 100), max_size=60), st.integers(1, 6))
@settings(deadline=None)
def test_open_windows_never_overflow(sizes, most):
    w, fill = P.OpenWindows(100, most, 0), {}
    for s in sizes:
        k = w.put(s)
        fill[k] = fill.get(k, 0) + s
        assert len(w.ids) <= most
    assert all(f <= 100 for f in fill.values())


@given(st.lists(st.integers(1, 100), max_size=60))
def test_best_fit_never_overflows(fills):
    fills = np.array(sorted(fills, reverse=True), dtype=int)
    window = P.best_fit(fills, 100)
    assert all(fills[window == k].sum() <= 100 for k in set(window.tolist()))


@needs_vocabulary
def test_containers(spark):
    texts = ["", None, "one two three", "word " * 700, "x" * 60_000, "a b c " * 40] + ["some words in a row %d" % k for k in range(300)]
    df = spark.createDataFrame([(k, t, 5, 1) for k, t in enumerate(texts)], "doc_id long, text string, container long, n_tokens int").repartition(7)
    count = P.encoder(P.VOCABULARY)
    rows = P.pack(df, "doc_id", "text", capacity=256, windows=3, fan_in=2).collect()
    assert {r["doc_id"] for r in rows} == set(range(len(texts)))
    fill, pieces = {}, {}
    for r in rows:
        fill[r["container"]] = fill.get(r["container"], 0) + r["n_tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["first_token"], r["n_tokens"]))
    assert max(fill.values()) <= 256
    for k, t in enumerate(texts):
        n, got = count(t or ""), sorted(pieces[k])
        assert sum(x[2] for x in got) == n and [x[0] for x in got] == list(range(len(got))) and [x[1] for x in got] == [256 * x[0] for x in got]
        assert len(got) == max(1, -(-n // 256))
    least = -(-sum(fill.values()) // 256)
    assert len(fill) <= 1.15 * least + 2
    assert tuple(P.audit(P.pack(df, "doc_id", "text", capacity=256), "doc_id", 256).first()) == (len(texts), 0, 0)
    split = {r["doc_id"] for r in P.split_texts(P.pack(df, "doc_id", "text", capacity=256), "doc_id").collect()}
    assert split == {k for k, t in enumerate(texts) if count(t or "") > 256}


@needs_vocabulary
def test_empty_table_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (3, "b")], "doc_id long, text string")
    assert P.pack(df.limit(0), "doc_id", "text").count() == 0
    assert P.pack(df, "doc_id", "text").count() == 3


def test_leftovers_of_many_partitions_merge(spark):
    left = spark.range(400).select((F.col("id") * F.lit(1 << 36)).alias("container"), (1 + F.col("id") % 40).alias("fill"))
    rows = P.merge_leftovers(left, 100, 4, fan_in=8).join(left, "container").groupBy("merged").agg(F.sum("fill").alias("s"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in rows) == 400 and max(r["s"] for r in rows) <= 100 and len(rows) <= 105
