"""Ids against the public library, and back."""

import random

import pytest

from docuplane.llm import tokens as T

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return T.load_ranks()


@pytest.fixture(scope="module")
def public(ranks):
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def texts():
    random.seed(5)
    out = [None, "", " ", "\n\n  x", "don't I'll we've", "<|endoftext|> [CLS]", "naïve 漢字 😀 ＡＢＣ", "a" * 5000, "x\u0085y\u001cz  w", "1234 5,678.9", "\t\r\n"]
    for _ in range(400):
        out.append("".join(c for c in (chr(random.choice([random.randrange(32, 127), random.randrange(0x3000), random.randrange(0x10FFFF), 32, 10])) for _ in range(random.randrange(1, 40))) if not 0xD800 <= ord(c) < 0xE000))
    return out


def test_encoder(ranks, public):
    words = [b" the", b" harbour", b"s", b"the", b" ", "naïve".encode(), b" permit"]
    lex = T.Lexicon.build(words, [T.merge(w, ranks) for w in words])
    for memory in (1000, 3):
        enc = T.Encoder(lex, ranks, memory)
        for t, ids in zip(texts(), enc.encode(texts())):
            assert ids == (public.encode_ordinary(t) if t else [])


def test_lexicon_is_minimal_and_complete(tmp_path):
    random.seed(2)
    words = sorted({bytes(random.choice(b"abc") for _ in range(random.randrange(1, 7))) for _ in range(600)})
    random.shuffle(words)
    lex = T.Lexicon.build(words, [[i, i + 1] for i in range(len(words))])
    (tmp_path / "l").write_bytes(lex.dump())
    for x in (lex, T.Lexicon.map(str(tmp_path / "l"))):
        n = x.numbers(words)
        assert sorted(n) == list(range(len(words)))
        assert all(x.ids[x.starts[k] : x.starts[k + 1]].tolist() == [i, i + 1] for i, k in enumerate(n))
        assert x.numbers([b"abcabcabc", b"d", b"", b"abd"]).tolist() == [-1] * 4
    # equal suffixes are shared: no two states have the same continuations
    alphabet = {}
    for key, to in zip(lex.keys.tolist(), lex.to.tolist()):
        alphabet.setdefault(key >> 8, []).append((key & 255, to))
    seen = [(bool(lex.final[s]), tuple(alphabet.get(s, ()))) for s in range(len(lex.final))]
    assert len(set(seen)) == len(seen)
    assert T.Lexicon.build([], []).numbers([b"x"]).tolist() == [-1]


def test_corpus(spark, public):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(0, None, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = T.encode_corpus(df, most=50).collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts()[r.doc_id]
        assert r.ids == (public.encode_ordinary(t) if t else []) and public.decode(r.ids) == (t or "")
    assert T.encode_corpus(df.limit(0)).count() == 0
    assert len(T.frequent_words(df, most=20)) <= 20
