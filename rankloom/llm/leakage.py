"""Evaluation texts leaking into training texts: an FM-index of each shard of the corpus.

Words are compared without case, accents, markup, invisible characters and line-end hyphens. A shard's words become numbers
(those of the evaluation items; all others are one symbol), its suffixes are sorted, and the Burrows-Wheeler transform goes into a
wavelet matrix over bit vectors with rank counts. Every phrase of three words of the items is searched backwards, all phrases at once;
occurrences are located by walking to sampled suffix positions. Occurrences that follow each other in item and document,
give or take a few words, form a chain, in whose gaps single words are matched in order; chains of enough words are leaks, the union
of those near each other is what an item has in a document and their spans are what to remove. Common phrases shared by chance stay below the chain
length or are strewn over a long document. So an item is found with one word in four replaced throughout; with one in three no phrase is left whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHRASE = 3
#: words between two matches of a chain, least words of a chain in its phrases, share of an item that must stand in a document
GAP, CHAIN, SHARE = 4, 9, 0.5
#: chains count together that begin within so many times the item's words, and so many more: chance strews them over a long document
SPREAD = 2, 50

_PLAIN = re.compile(r"[^\W_]+")
_SPECIAL = re.compile("[<&­̀-ͯ؜ᅟᅠ᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e0fff]|[-‐‑][ \t]*\r?\n")
_WORD = regex.compile(r"<[^<>]{0,500}>|&#?\w{1,10};|[\p{L}\p{N}](?:[\p{L}\p{N}\p{M}\p{Cf}ᅟᅠ]|[-‐‑­][ \t]*\r?\n\s*(?=\p{Ll}))*")
_DROP = regex.compile(r"[\p{M}\p{Cf}ᅟᅠ\s\-‐‑]+")
# fixed values: letters of other scripts that look like Latin ones, and what they look like
_LOOK = str.maketrans("аеіорсухѕјһԁԛԝкмтвнзɡοαενρτυικ", "aeiopcyxsjhdqwkmtbh3goaevptuik")


def fold(word: str) -> str:
    """A word without case, accents, invisible characters and line-end hyphens; look-alike letters as Latin ones."""
    return _DROP.sub("", unicodedata.normalize("NFKD", word.casefold())).casefold().translate(_LOOK)


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(word as written, start, end) of a text; tags and entities are no words."""
    if _SPECIAL.search(text):
        return [(m[0], *m.span()) for m in _WORD.finditer(text) if m[0][0] not in "<&"]
    return [(m[0], *m.span()) for m in _PLAIN.finditer(text)]


def bare_words(text: str) -> list[str]:
    """The words of `words_of`, without where they stand."""
    return [w for w in _WORD.findall(text) if w[0] not in "<&"] if _SPECIAL.search(text) else _PLAIN.findall(text)


class Symbols(dict):
    """The number of a word as written, folded when it is first met; 2 for words of no item."""

    def __init__(self, number: dict[str, int]) -> None:
        self.number = number

    def __missing__(self, word: str) -> int:
        self[word] = found = self.number.get(fold(word), 2)
        return found


class Bits:
    """A bit vector with constant-time rank: 64-bit words and the count before each."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w, b = at >> 6, (at & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << b) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Rank and access of symbols below 2**levels, bit by bit from the highest."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels, self.bits, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            self.bits.append(Bits(bit))
            self.zeros.append(int((~bit).sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position `at` arrives at the bottom when it follows the bits of `symbol`."""
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros)):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.follow(symbol, at) - self.follow(symbol, np.zeros_like(at))

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for bits, zeros in zip(self.bits, self.zeros):
            bit, ones = bits.get(at).astype(np.int64), bits.rank(at)
            out = (out << 1) | bit
            at = np.where(bit == 1, zeros + ones, at - ones)
        return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of `s` in order, by doubling the compared length; only suffixes still equal to another are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    heads = np.concatenate([[True], s[order][1:] != s[order][:-1]])
    start = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    width = 1
    while True:
        single = heads & np.concatenate([heads[1:], [True]])
        open_at = np.flatnonzero(~single)
        if not len(open_at):
            return order
        part = order[open_at]
        nxt = part + width
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = rank[part] * np.int64(n + 1) + second
        by = np.argsort(key, kind="stable")
        part, key = part[by], key[by]
        order[open_at] = part
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        heads[open_at] = fresh
        begin = np.maximum.accumulate(np.where(fresh, open_at, 0))
        rank[part] = begin
        width *= 2


class FMIndex:
    """Full-text index of a sequence of symbols that ends with the only 0; `sample`: every how many positions one is kept for locating."""

    def __init__(self, s: np.ndarray, symbols: int, sample: int = 8) -> None:
        self.n = len(s)
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols))]).astype(np.int64)
        self.matrix = WaveletMatrix(bwt, max(1, int(symbols - 1).bit_length()))
        kept = sa % sample == 0
        self.kept, self.samples = Bits(kept), sa[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of `phrases`, low, high) of those that occur: their range of suffixes. All phrases go backwards together."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[which, k]
            low, high = self.first[c] + self.matrix.rank(c, low), self.first[c] + self.matrix.rank(c, high)
            alive = high > low
            which, low, high = which[alive], low[alive], high[alive]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by stepping back to a sampled one."""
        out, at, steps = np.empty(len(rows), np.int64), rows.astype(np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            here = self.kept.get(at[left]) == 1
            done = left[here]
            out[done] = self.samples[self.kept.rank(at[done])] + steps[done]
            left = left[~here]
            c = self.matrix.access(at[left])
            at[left] = self.first[c] + self.matrix.rank(c, at[left])
            steps[left] += 1
        return out


class Items:
    """The evaluation items: vocabulary, phrases as numbers, and where each phrase stands. Numbers: 0 ends a shard, 1 a text, 2 is any other word."""

    def __init__(self, items: Sequence[tuple[int, str]]) -> None:
        words = {i: [fold(w) for w, _, _ in words_of(t)] for i, t in items if t}
        self.number = {w: k + 3 for k, w in enumerate(sorted({w for ws in words.values() for w in ws}))}
        self.ids = {i: [self.number[w] for w in ws] for i, ws in words.items()}
        self.places: dict[int, dict[tuple[int, ...], list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for i, ids in self.ids.items():
            m = min(PHRASE, len(ids))
            for p in range(len(ids) - m + 1) if m else ():
                self.places[m][tuple(ids[p : p + m])].append((i, p))
        self.names = sorted(self.ids)
        at = {i: k for k, i in enumerate(self.names)}
        self.sizes = np.array([len(self.ids[i]) for i in self.names], np.int64)
        # of each phrase length: (item number, place) of all phrases in turn, where each phrase's begin, and how many it has
        self.flat = {}
        for m, places in self.places.items():
            number = np.array([len(x) for x in places.values()], np.int64)
            own = np.array([(at[i], p) for x in places.values() for i, p in x], np.int64).reshape(-1, 2)
            self.flat[m] = own, np.concatenate([[0], np.cumsum(number)[:-1]]), number


def chains(hits: list[tuple[int, int]], m: int) -> list[list[tuple[int, int]]]:
    """Occurrences (place in item, place in document) of m words joined along the document.

    Only chains that end within reach are looked at, so long documents take time in proportion.
    """
    closed: list[list[tuple[int, int]]] = []
    opened: list[list[tuple[int, int]]] = []
    for p, q in sorted(hits, key=lambda h: (h[1], h[0])):
        reach = [c for c in opened if q - c[-1][1] <= GAP + m]
        if len(reach) < len(opened):
            closed += [c for c in opened if q - c[-1][1] > GAP + m]
            opened = reach
        for chain in reversed(opened):
            before_p, before_q = chain[-1]
            if 0 < p - before_p <= GAP + m and abs((q - before_q) - (p - before_p)) <= GAP:
                chain.append((p, q))
                break
        else:
            opened.append([(p, q)])
    return closed + opened


def covered(chain: list[tuple[int, int]], m: int, item: Sequence[int], text: Sequence[int]) -> set[int]:
    """The places of an item that a chain has: those of its phrases, and in the gaps between them the longest common series of single words."""
    out = {p + k for p, _ in chain for k in range(m)}
    for (p, q), (p2, q2) in zip(chain, chain[1:]):
        a, b = range(p + m, p2), range(q + m, q2)
        best: list[list[tuple[int, ...]]] = [[()] * (len(b) + 1)]
        for x in a:
            row: list[tuple[int, ...]] = [()]
            for k, y in enumerate(b):
                row.append((*best[-1][k], x) if item[x] == text[y] else max(row[k], best[-1][k + 1], key=len))
            best.append(row)
        out.update(best[-1][-1])
    return out


def together(good: list[tuple[int, int, set[int]]], size: int) -> tuple[float, list[tuple[int, int, set[int]]]]:
    """The greatest share of an item that chains (first word, word after the last, places of the item) within `SPREAD` of each other have, and the chains of all such places that have enough."""
    good, best, kept = sorted(good, key=lambda c: c[0]), 0.0, set()
    for k, (first, _, _) in enumerate(good):
        end = k
        while end < len(good) and good[end][0] - first <= SPREAD[0] * size + SPREAD[1]:
            end += 1
        share = len(set().union(*(has for *_, has in good[k:end]))) / size
        best = max(best, share)
        if share > SHARE:
            kept.update(range(k, end))
    return best, [good[n] for n in sorted(kept)]


def _candidates(hits: np.ndarray, items: Items) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Of hits (document, item number, place in item, place in document, words), those of documents and items that can have enough, by both.

    What a chain can have is its phrases and what stands in the gaps between them.
    """
    hits = hits[np.lexsort(hits.T[::-1])]
    pair = np.concatenate([[True], (hits[1:, :2] != hits[:-1, :2]).any(1)])
    fresh = pair | np.concatenate([[True], hits[1:, 2] != hits[:-1, 2]])
    group = np.cumsum(pair) - 1
    enough = np.bincount(group, fresh * (hits[:, 4] + GAP)) > SHARE * items.sizes[hits[pair, 1]]
    hits, group = hits[enough[group]], group[enough[group]]
    out: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for doc, item, p, q, _ in hits.tolist():
        out[doc, items.names[item]].append((p, q))
    return out


def search_shard(texts: Sequence[str | None], items: Items) -> Iterator[tuple[int, int, float, list[tuple[int, int]]]]:
    """(row, item, share of the item's words, character spans) of the leaks in the texts of a shard."""
    number = items.number
    folded = Symbols(number)
    symbols, origins, starts, length = [], [], [], 0
    for text in texts:
        starts.append(length)
        c = np.array([*map(folded.__getitem__, bare_words(text) if text else ()), 1], np.int64)
        # of a run of words of no item one is enough
        kept = np.flatnonzero(np.concatenate([[True], (c[1:] != 2) | (c[:-1] != 2)]))
        symbols.append(c[kept])
        origins.append(kept)
        length += len(kept)
    s, origin, start = np.concatenate([*symbols, [0]]), np.concatenate([*origins, [-1]]), np.array(starts, np.int64)
    index = FMIndex(s, len(number) + 3)
    parts: list[np.ndarray] = []
    for m, places in items.places.items():
        which, low, high = index.search(np.array(list(places), np.int64))
        if not len(which):
            continue
        counts = high - low
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        at = index.locate(rows)
        docs = np.searchsorted(start, at, side="right") - 1
        # each occurrence of a phrase once for each place of an item that has the phrase
        own, first, number_of = items.flat[m]
        phrase = np.repeat(which, counts)
        times = number_of[phrase]
        place = np.repeat(first[phrase] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        parts.append(np.column_stack([np.repeat(docs, times), own[place, 0], own[place, 1], np.repeat(origin[at], times), np.full(len(place), m)]))
    found = _candidates(np.concatenate(parts), items) if parts else {}
    spots: dict[int, tuple[list, list[int]]] = {}
    for (doc, item), hits in found.items():
        ids = items.ids[item]
        size = len(ids)
        m = min(PHRASE, size)
        linked = chains(hits, m)
        if sum(c[-1][0] + m - c[0][0] for c in linked) <= SHARE * size:
            continue
        if doc not in spots:
            words = words_of(texts[doc])
            spots[doc] = words, [folded[w] for w, _, _ in words]
        words, told = spots[doc]
        good = [(c[0][1], c[-1][1] + m, covered(c, m, ids, told)) for c in linked if len({p + n for p, _ in c for n in range(m)}) >= min(CHAIN, size)]
        share, good = together(good, size)
        if share > SHARE:
            spans: list[list[int]] = []
            for a, b in sorted((words[first][1], words[min(end, len(words)) - 1][2]) for first, end, _ in good):
                if spans and a <= spans[-1][1] + 1:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            yield doc, item, share, [(a, b) for a, b in spans]


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", shard_chars: int = 6_000_000, round_chars: int = 4_000_000) -> DataFrame:
    """(key, item_key, share, spans): documents and the items of which more than half the wording stands in them.

    The items are sent to every task, in as many rounds over the documents as keep each round to about `round_chars` characters of items (some 200 MB a
    worker); their size is added up first, so the usual set of items takes one. Each task indexes its documents in shards of about `shard_chars`
    characters (a longer document is a shard of its own) and drops an index when it is searched.
    Null and empty texts leak nothing; repeated documents come out each time; an empty table gives no rows.
    """
    known = items.select(F.col(item_key).cast("bigint").alias("id"), F.col(item_text).cast("string").alias("text")).filter("id is not null and text is not null")
    rounds = max(1, -(-(known.agg(F.sum(F.length("text"))).first()[0] or 0) // round_chars))
    found = None
    for k in range(rounds):
        part = known if rounds == 1 else known.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == k)
        one = _leaks(documents, [tuple(r) for r in part.collect()], key, text, item_key, shard_chars)
        found = one if found is None else found.unionAll(one)
    return found


def _leaks(documents: DataFrame, rows: list[tuple[int, str]], key: str, text: str, item_key: str, shard_chars: int) -> DataFrame:
    """The same for one round of items."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Items(rows)
        keys: list = []
        texts: list[str | None] = []
        held = 0

        def search() -> pa.RecordBatch:
            out = list(search_shard(texts, known))
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[d] for d, *_ in out], pa_key),
                    pa.array([i for _, i, *_ in out], pa.int64()),
                    pa.array([x for _, _, x, _ in out], pa.float64()),
                    pa.array([[{"start": a, "end": b} for a, b in spans] for *_, spans in out], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                ["key", "item", "share", "spans"],
            )
            keys.clear()
            texts.clear()
            return batch

        for batch in batches:
            pa_key = batch.schema.field(0).type
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not value:
                    continue
                keys.append(k)
                texts.append(value)
                held += len(value)
                if held >= shard_chars:
                    yield search()
                    held = 0
        if texts:
            yield search()

    found = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, item bigint, share double, spans array<struct<start:int,end:int>>")
    return found.select(F.col("key").alias(key), F.col("item").alias(item_key), "share", "spans")
