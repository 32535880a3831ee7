import numpy as np

from rankloom.llm import stuffing as S

NOUNS = "lamp boat table chair window garden teacher baker river bottle spoon letter picture hammer fence drum".split()
VERBS = "finds carries paints repairs counts washes sells moves".split()


def prose(rng, n):
    """Sentences of changing build: where every sentence has one build, prose is as regular as a list, and its corpus the norm for nothing."""
    noun, verb = (lambda: rng.choice(NOUNS)), (lambda: rng.choice(VERBS))
    near = lambda: rng.choice(["near the", "behind my", "in an old", "on the", "by his", "under our"]) + " " + noun()
    main = lambda: f"{rng.choice(['the', 'a', 'our', 'her'])} {noun()} {rng.choice(['', 'quickly ', 'now ', 'as usual '])}{verb()} {rng.choice(['the', 'a', 'some'])} {noun()}{rng.choice(['', ' and a ' + noun(), ', the ' + noun() + ' and his ' + noun()])}"
    sentence = lambda: str(rng.choice([f"{main()} {near()}.", f"{near()}, {main()}.", f"when {main()}, {main()}.", f"{main()} because {main()} {near()}.", f"in {rng.integers(2, 40)} of 60 rounds {main()}.", f"{main()}!"]))
    return " ".join((x := sentence())[0].upper() + x[1:] for _ in range(n))


def cases():
    rng = np.random.default_rng(1)
    pick = lambda words, n, sep=" ": sep.join(rng.choice(words, n))
    url = lambda: f"https://{pick(NOUNS, 2, '-')}{rng.integers(99)}.example/{rng.choice(NOUNS)}?id={rng.integers(9999)}"
    spam = [
        pick(["cheap", "lamp", "lamps"], 120), "\n".join(url() for _ in range(25)), ", ".join(url() for _ in range(25)), " ".join(f'<a href="{url()}">{rng.choice(NOUNS)} sale</a>' for _ in range(20)),
        "\n".join("Home > " + pick(NOUNS, 3, " > ") for _ in range(20)), " ".join(f"#{rng.choice(NOUNS)}" for _ in range(60)), " ".join(f"{rng.choice(NOUNS)} ({rng.integers(300)})" for _ in range(60)),
        "\n".join(f"{rng.choice(NOUNS)}; size: {rng.integers(40)}; colour: {rng.integers(9)}; {rng.integers(99)}.95" for _ in range(25)),
        " ".join(f"Lamp lamps for {rng.choice(['cheap', 'lamp', 'sale'])} lamp and lamps with sale lamp." for _ in range(20)), prose(rng, 2) + "\n" + "\n".join(url() for _ in range(40)),
    ]
    fine = [
        prose(rng, 12), prose(rng, 1), prose(rng, 9).replace(".", ""), prose(rng, 9).upper(), "1. " + prose(rng, 6).replace(". ", ".\n2. "), prose(rng, 12) + "\n" + "\n".join(url() for _ in range(3)),
        prose(rng, 2)[:40], prose(rng, 20).replace(" the ", "\nthe "), prose(rng, 8) + " #lamp #boat", "“" + prose(rng, 6).replace(".", " /") + "”",
    ]
    return spam, fine


def test_cases_in_a_corpus(spark):
    spam, fine = cases()
    rng = np.random.default_rng(2)
    rows = [(k, t, "EN" if k % 3 else None, 1) for k, t in enumerate([*spam, *fine, *(prose(rng, int(n)) for n in rng.integers(1, 15, 200))])] + [(900, None, None, 1), (901, "", "en", 1), (902, " \n", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, words int")
    judged = S.judge(docs)
    got = {r["doc_id"] for r in S.found(judged).collect()}
    assert got == set(range(len(spam)))
    assert judged.count() == len(rows) - 3
    assert S.found(S.judge(docs.limit(0))).count() == 0


def test_keyword_repetition_is_redundant_by_compression(spark):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(k, prose(rng, 10), "en") for k in range(60)] + [(99, "lamp lamps " * 80, "en")], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in S.judge(docs).collect()}
    assert rows[99]["redundant_words"] == rows[99]["words"] == 160
    assert sum(r["redundant_words"] > 0.5 * r["words"] for k, r in rows.items() if k < 60) <= 9


def test_blocks_hold_every_word_once():
    spam, fine = cases()
    for text in [*spam, *fine, "x" * 3000, "a\n\nb", "lamp " * 900]:
        if "<a" not in text:
            found = S.blocks(text)
            assert sum(b[1] for b in found) == sum(any(c.isalnum() for c in t) for b in S.cut_blocks(text.lower()) for t in b.split())
            assert "".join(S.cut_blocks(text)) == text and max(b[0] for b in found) <= S.MOST


def test_marks_strewn_among_keywords_are_no_sentences():
    n = lambda text: sum(b[2] for b in S.blocks(text))
    rng = np.random.default_rng(4)
    stuffed = " ".join(" ".join(rng.choice(["cheap", "lamp", "lamps", "with", "buy", "for"], 8)) + rng.choice([".", "!", "?"]) for _ in range(30))
    assert n(stuffed) <= 6
    assert n("The baker finds a lamp. " * 9) == 9
    assert n("<p>The baker finds a lamp.</p><p>Our teacher paints the window!</p>") == 2
    assert n("1.5 www.lamp.example v2.0") == 0


def test_each_part_of_the_method_is_needed(spark):
    """Without compression short ends of sentences are found too; without one of the two ratios cases are lost; without sentences repeated prose is found."""
    spam, fine = cases()
    rng = np.random.default_rng(5)
    repeated = "The baker finds the lamp near the table. The teacher paints a fence and the window. " * 12
    texts = [*spam, *fine, repeated, *(prose(rng, int(n)) for n in rng.integers(1, 15, 200))]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    whole = {*range(len(spam))}
    ids = lambda **o: {r["doc_id"] for r in S.found(S.judge(docs, **o)).collect()}
    assert ids() >= whole and len(ids() - whole) <= 1
    assert ids(extreme=-1.0) > whole
    assert {r["doc_id"] for r in S.judge(docs).filter("redundant_words > 0.5 * words").collect()} >= {*whole, len(spam) + len(fine)}


def test_no_sentences_no_norm(spark):
    docs = spark.createDataFrame([(1, "lamp lamps " * 90, "en"), (1, "lamp lamps " * 90, "en"), (2, None, None), (3, "", "EN")], "doc_id long, text string, lang string")
    assert [(r["doc_id"], r["words"], r["spam_words"]) for r in S.judge(docs).collect()] == [(1, 360, 0)]
