"""The search against looking everywhere."""

import random

from docuplane.llm import leaks as L


def brute(docs, items, run):
    grams = {}
    for k, t in items:
        w = L.words(t)
        for i in range(len(w) - run + 1):
            grams.setdefault(tuple(w[i : i + run]), set()).add(k)
    return {(d, k) for d, t in docs for w in [L.words(t)] for i in range(len(w) - run + 1) for k in grams.get(tuple(w[i : i + run]), ())}


def test_words():
    assert L.words("Ｈéllo, W­orld​! ﬁne İx 2½") == ["hello", "world", "fine", "ix", "21", "2"]
    assert L.words(None) == L.words("") == L.words("漢字") == []


def test_random(spark):
    random.seed(3)
    text = lambda n: " ".join(random.choice("a b c d").strip() for _ in range(n))
    items = [(i, text(random.randrange(5, 40))) for i in range(12)] + [(90, None), (91, ""), (92, "too short")]
    docs = [(i, text(random.randrange(0, 400))) for i in range(60)] + [(70, None), (71, ""), (0, text(50))]
    p = L.Patterns(items, 10, 3)
    assert {(d, k) for d, t in docs for k in p.search(t)} == brute(docs, items, 10)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    for at_once in (20_000, 4):
        got = [tuple(r) for r in L.leaked(df, it, items_at_once=at_once).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(docs, items, 10)
    assert L.leaked(df.limit(0), it).count() == 0 and L.leaked(df, it.limit(0)).count() == 0


def test_a_passage_in_disguise():
    item = "While the witness was quietly withheld, the encrypted nickel escalated the schedule again"
    p = L.Patterns([(1, item)])
    assert p.search("x " + item.upper().replace("E", "É").replace(" ", "  \n") + " y") == {1}
    assert p.search("x " * 500 + item.replace("nickel", "copper")) == set()


def test_long_items_in_parts(spark):
    random.seed(5)
    long = " ".join(random.choice("abcdefghij") for _ in range(13_000))
    w = long.split()
    docs = [(k, "x y " + " ".join(w[at : at + 12]) + " z") for k, at in enumerate([0, 4_985, 4_991, 4_995, 9_985, 12_988])] + [(99, " ".join(w[7:16]))]
    it = spark.createDataFrame([(1, long), (2, None)], "item_id bigint, text string")
    for at_once in (1_000_000, 5_000):
        got = {r.doc_id for r in L.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), it, words_at_once=at_once).collect()}
        assert got == {d for d, t in docs if (d, 1) in brute(docs, [(1, long)], 10)} >= {0, 1, 2, 3, 4, 5}
