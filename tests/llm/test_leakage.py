import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import leakage as L

symbols = st.lists(st.integers(0, 5), min_size=1, max_size=200)


@given(symbols)
@settings(deadline=None)
def test_suffix_array(s):
    assert L.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda k: s[k:])


@given(symbols, st.lists(st.integers(0, 7), min_size=1, max_size=200))
@settings(deadline=None)
def test_wavelet_ranks(s, at):
    m, a = L.WaveletMatrix(np.array(s, np.int64), 3), np.array(at, np.int64) % (len(s) + 1)
    for c in range(8):
        assert m.rank(np.full(len(a), c), a).tolist() == [s[:x].count(c) for x in a.tolist()]
    assert m.access(np.arange(len(s))).tolist() == s


@given(symbols, st.integers(1, 4))
@settings(deadline=None)
def test_search_finds_every_occurrence(s, m):
    s = [c + 1 for c in s] + [0]
    index = L.FMIndex(np.array(s, np.int64), 7, sample=4)
    phrases = sorted({tuple(s[k : k + m]) for k in range(len(s) - m + 1)} | {(6,) * m})
    phrases = [p for p in phrases if 0 not in p]
    if not phrases:
        return
    which, low, high = index.search(np.array(phrases, np.int64))
    got = {phrases[w]: sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high)}
    want = {p: [k for k in range(len(s) - m + 1) if tuple(s[k : k + m]) == p] for p in phrases}
    assert got == {p: at for p, at in want.items() if at}


ITEM = "The quick brown foxes carry seven old lamps over the bridge. Later, the café owner counts every lamp in the cellar twice. Nobody finds the missing one before the harvest begins."
OTHER = "Completely different words stand here and they go on for quite a while without anything to quote from elsewhere at all."
CASES = {
    ITEM: True,
    OTHER + "\n" + ITEM.upper() + "\n" + OTHER: True,
    "<p>" + ITEM.replace(" ", "  \n").replace("é", "e") + "</p>": True,
    ITEM.replace("carry", "car­ry").replace("lamps", "la​mps").replace("bridge", "bri-\ndge"): True,
    ITEM.replace("seven", "eight").replace("owner", "keeper").replace("begins", "ends"): True,
    " ".join(reversed(ITEM.split(". "))): True,
    ITEM.replace("o", "о").replace("a", "а"): True,
    ITEM.replace("over", "[1] over").replace("twice", "(2) twice"): True,
    ITEM[: len(ITEM) // 3]: False,
    ITEM.split(". ")[0] + ". " + OTHER: False,
    OTHER: False,
    "": False,
    None: False,
    " ".join(w for k, w in enumerate(ITEM.split()) if k % 2): False,
}


def test_cases(spark):
    docs = spark.createDataFrame([(k, t, 9, "x") for k, t in enumerate(CASES)], "doc_id long, text string, item_id int, share string")
    items = spark.createDataFrame([(7, ITEM), (8, OTHER + " " + OTHER), (9, None), (10, ""), (None, ITEM)], "item_id long, text string")
    got = {r["doc_id"] for r in L.leaks(docs, items, shard_chars=500).filter("item_id = 7").collect()}
    assert got == {k for k, leaks in enumerate(CASES.values()) if leaks}
    assert L.leaks(docs.limit(0), items).count() == 0 and L.leaks(docs, items.limit(0)).count() == 0
    rounds = L.leaks(docs, items, shard_chars=500, round_chars=200)
    assert {r["doc_id"] for r in rounds.filter("item_id = 7").collect()} == got and rounds.filter("item_id = 7").count() == len(got)


def test_spans_cover_the_passage_wherever_it_stands():
    text = OTHER + "\n" + ITEM + "\n" + OTHER
    ((row, item, share, spans),) = list(L.search_shard([None, text], L.Items([(3, ITEM)])))
    assert (row, item) == (1, 3) and share == 1.0 and [text[a:b] for a, b in spans] == [ITEM[:-1]]


def test_long_documents_are_not_leaks_by_chance():
    rng = np.random.default_rng(0)
    pick = lambda: "n%d" % rng.integers(60)
    pool = [f"the {pick()} {pick()} the {pick()} in the {'pqrst'[rng.integers(5)]}." for _ in range(6000)]
    item = "the zebra waits behind the tall gate. the n1 n2 the n3 in the p. the n4 n5 the n6 in the q."
    assert list(L.search_shard([" ".join(pool)], L.Items([(1, item)]))) == []


def test_every_kth_word_replaced():
    """An item of 60 words each of which is replaced, one in k, all along: found from k = 4 on."""
    words = [f"w{k}" for k in range(60)]
    for k in (4, 5, 6, 9):
        text = OTHER + " " + " ".join("foreign" if n % k == k - 1 else w for n, w in enumerate(words)) + " " + OTHER
        ((_, _, share, _),) = list(L.search_shard([text], L.Items([(1, " ".join(words))])))
        assert share == (60 - 60 // k) / 60
    text = " ".join("foreign" if n % 3 == 2 else w for n, w in enumerate(words))
    assert not list(L.search_shard([text], L.Items([(1, " ".join(words))])))


def test_single_words_in_gaps_count():
    assert L.covered([(0, 0), (6, 6)], 3, [1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 2, 3, 0, 5, 0, 7, 8, 9]) == {0, 1, 2, 4, 6, 7, 8}
    assert L.covered([(0, 0)], 3, [1, 2, 3], [1, 2, 3]) == {0, 1, 2}


@given(st.text(alphabet="ab <>&;-\n\u00ad\u0301é1.", max_size=60))
def test_words_with_and_without_their_places(text):
    assert L.bare_words(text) == [w for w, _, _ in L.words_of(text)]
