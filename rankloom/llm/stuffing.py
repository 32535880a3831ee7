"""Keyword-stuffed and link-list pages: block-wise compression, confirmed by the density of sentences.

A text is cut into blocks of neighbouring lines. Two compression ratios are taken of each: of its words, which is extreme where keywords are
repeated, and of its layout, which is extreme where links, tags, products or menus are listed although no two are the same. In the layout a
link is one sign, a word of four letters or more another, a number or single letter a third; short words and punctuation stay as they are,
and blanks go. Prose is irregular there, in any language that writes short words between long ones; lists are not.

Both ratios are normalised by what blocks made of sentences have in the whole corpus, by language and length. A block is redundant if its two
deviations above those medians add up to an extreme. A redundant block is spam if its density of sentence punctuation is low as well. A mark counts
only if what stands before it has short words among different long ones, so that marks strewn among repeated keywords do not count.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: characters after which a block ends at the next line (before `MOST`) or blank; a text's last block has up to `MOST`
LEAST, MOST = 500, 1000
#: sum of the two deviations that is extreme; sentences a character below which there are few
EXTREME, DENSITY = 2.5, 1 / 170
#: blocks of sentences that a language needs at a length to be its own norm; size classes are powers of `GROWTH`
ENOUGH, GROWTH = 30, 1.25

_NUMBER = re.compile(r"\d[\d.,]*|\b[^\W\d_]\b")
_LINK = re.compile(r".*(?:[/=@#]|\.(?=\w)).*", re.S)
_LONG = re.compile(r"[^\W\d_]{4,}")
_END = re.compile(r"[.!?…。！？।؟][\"'»”“)\]]*$")
_AROUND = ".,;:!?…\"'»«”“()[]"


class Tokens(dict):
    """Of a blank-free token: (its layout, whether it is a word, itself if it is a long word). Kept for the next time, up to `most` of them."""

    def __init__(self, most: int = 200_000) -> None:
        self.most = most

    def __missing__(self, token: str) -> tuple[str, bool, str]:
        if len(self) >= self.most:
            self.clear()
        plain = _NUMBER.sub("0", token)
        bare = token.strip(_AROUND)
        told = ("L" if _LINK.fullmatch(plain) else _LONG.sub("w", plain), any(map(str.isalnum, token)), bare if len(bare) > 3 and bare.isalpha() else "")
        if len(token) <= 40:
            self[token] = told
        return told


def cut_blocks(text: str) -> Iterator[str]:
    """A text in blocks: each ends at the first line end after LEAST characters, or blank if no line ends before MOST, or there if there is no blank either."""
    at, n = 0, len(text)
    while n - at > MOST:
        stop = text.find("\n", at + LEAST, at + MOST)
        if stop < 0:
            stop = text.find(" ", at + LEAST, at + MOST)
        stop = stop if stop >= 0 else at + MOST
        yield text[at:stop]
        at = stop
    yield text[at:]


def packed(text: str) -> int:
    """Bytes of a text without the frame of the compressor."""
    c = zlib.compressobj(6, zlib.DEFLATED, -12, 5)
    return len(c.compress(text.encode("utf-8", "replace"))) + len(c.flush())


def sentences(tokens: list[str], told: list[tuple[str, bool, str]]) -> int:
    """Marks that end a sentence: three words or more, a quarter of them short, and the long ones different but for one in seven."""
    n, last = 0, 0
    for at, token in enumerate(tokens):
        if token[-1].isalnum() or not _END.search(token):
            continue
        long = [t[2] for t in told[last : at + 1] if t[2]]
        words = sum([t[1] for t in told[last : at + 1]])
        n += words >= 3 and words - len(long) >= 0.25 * words and len({*long}) >= 0.85 * len(long)
        last = at + 1
    return n


def blocks(text: str, known: Tokens | None = None) -> list[tuple[int, ...]]:
    """(characters, words, sentences, bytes of the words packed, bytes of the layout packed) of each block with a word. Tokens without letters or digits are no words."""
    known, out = Tokens() if known is None else known, []
    text = text.lower()
    if "<" in text:
        text = text.replace("<", " <").replace(">", "> ")
    for block in cut_blocks(text):
        tokens = block.split()
        told = [known[t] for t in tokens]
        if words := sum([t[1] for t in told]):
            out.append((len(block), words, sentences(tokens, told), packed(block), packed("".join([t[0] for t in told]))))
    return out


def measure(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, language, size, n, words, sentences, words_ratio, layout_ratio, words_step, layout_step): a row for each block; null and empty texts have none.

    The ratios are logarithms of characters by packed bytes; a step is what two bytes more would change. `language` is the declared one, two letters, else
    xx; `size` the size class. So there are at most 677 languages x 32 sizes, whatever the corpus.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for batch in batches:
            rows = [(at, *b) for at, value in enumerate(batch.column(1).to_pylist()) if value for b in blocks(value, known)]
            at, *counts = zip(*rows) if rows else [()] * 6
            rows_of = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows_of), batch.column(2).take(rows_of), *(pa.array(c, pa.int32()) for c in counts)], ["key", "language", "n", "words", "sentences", "a", "b"])

    declared = F.lower(F.substring(F.btrim(F.col(lang).cast("string")), 1, 2))
    source = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.when(declared.rlike("^[a-z]{2}$"), declared).otherwise("xx").alias("language"))
    counted = source.mapInArrow(run, f"key {kind}, language string, n int, words int, sentences int, a int, b int")
    ratio = lambda c: F.ln(F.col("n") / F.col(c))
    return counted.select("key", "language", F.floor(F.ln("n") / math.log(GROWTH)).cast("int").alias("size"), "n", "words", "sentences", ratio("a").alias("words_ratio"), ratio("b").alias("layout_ratio"), (2 / F.col("a")).alias("words_step"), (2 / F.col("b")).alias("layout_step"))


def has_sentences(density: float) -> Column:
    return F.col("sentences") >= F.lit(density) * F.col("n")


def norms(measured: DataFrame, by: list[str], density: float, prefix: str) -> DataFrame:
    """(by..., n, median and deviation of both ratios) of the blocks made of sentences.

    The deviation is that of the lower half, so that lists among the sentences do not widen it. Quantiles are combined map-side.
    """
    quartiles = [F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5)), 1000).alias(c) for c in ("words_ratio", "layout_ratio")]
    told = measured.filter(has_sentences(density)).groupBy(*by).agg(F.count("*").alias(f"{prefix}n"), *quartiles)
    spread = lambda c: ((F.col(c)[1] - F.col(c)[0]) / 0.6745)
    return told.select(*by, f"{prefix}n", *(x for c in ("words_ratio", "layout_ratio") for x in (F.col(c)[1].alias(f"{prefix}{c}_mid"), spread(c).alias(f"{prefix}{c}_off"))))


def nearest_sizes(measured: DataFrame, density: float) -> DataFrame:
    """The norms of all languages for every size class: its own, or those of the nearest class with `ENOUGH` blocks of sentences (of the fullest one if none has).

    At most 32 rows come to the driver, one a class. No blocks of sentences give no rows.
    """
    rows = norms(measured, ["size"], density, "all_").collect()
    least = min(ENOUGH, max((r["all_n"] for r in rows), default=0))
    full = sorted((r for r in rows if r["all_n"] >= least), key=lambda r: r["size"])
    top = int(math.log(MOST + 1) / math.log(GROWTH)) + 1
    filled = [(size, *min(full, key=lambda r: abs(r["size"] - size))[1:]) for size in range(top)] if full else []
    return measured.sparkSession.createDataFrame(filled, "size int, all_n bigint, all_words_ratio_mid double, all_words_ratio_off double, all_layout_ratio_mid double, all_layout_ratio_off double")


def judge(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", extreme: float = EXTREME, density: float = DENSITY) -> DataFrame:
    """(key, words, spam_words, redundant_words, sentences) of each document with words.

    A block is redundant if the deviations of its words and of its layout, those above the norm, add up to more than `extreme`. The norm is that of its
    language and size; with fewer than `ENOUGH` blocks of sentences there, that of its size, or the nearest one, in all languages; in a corpus
    without sentences nothing is redundant. A redundant block is spam if it also has fewer than `density` sentences a character. The norms are a row for each language and size, a bounded number (see `measure`), and are broadcast. Repeated keys are summed up as one
    document.
    """
    measured = cut(measure(documents, key, text, lang))
    own, every = norms(measured, ["language", "size"], density, "own_"), nearest_sizes(measured, density)
    known = measured.join(F.broadcast(own), ["language", "size"], "left").join(F.broadcast(every), "size", "left")

    def deviation(c: str) -> Column:
        pick = lambda what: F.when(F.col("own_n") >= ENOUGH, F.col(f"own_{c}_ratio_{what}")).otherwise(F.col(f"all_{c}_ratio_{what}"))
        return F.greatest(F.lit(0.0), F.coalesce((F.col(f"{c}_ratio") - pick("mid")) / (pick("off") + F.col(f"{c}_step")), F.lit(0.0)))

    redundant = deviation("words") + deviation("layout") > extreme
    total = lambda c, name: F.sum(F.when(c, F.col("words")).otherwise(0)).alias(name)
    return known.groupBy(F.col("key").alias(key)).agg(F.sum("words").alias("words"), total(redundant & ~has_sentences(density), "spam_words"), total(redundant, "redundant_words"), F.sum("sentences").alias("sentences"))


def found(judged: DataFrame, key: str = "doc_id", share: float = 0.5) -> DataFrame:
    """Documents in which more than `share` of the words are spam."""
    return judged.filter(F.col("spam_words") > F.lit(share) * F.col("words")).select(key)
