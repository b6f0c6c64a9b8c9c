"""Cuts against a search over every position."""

import random
from datetime import datetime

from docuplane.llm import pieces as P


def naive(text, limit):
    out, s = [], 0
    while len(text) - s > limit:
        ends = range(s + limit // 2 + 1, s + limit + 1)
        kinds = [lambda p: p >= 2 and text[p - 2 : p] == "\n\n", lambda p: p >= 2 and text[p - 1] in " \n" and text[p - 2] in ".!?", lambda p: text[p - 1] in " \n"]
        e = next((max(c) for k in kinds if (c := [p for p in ends if k(p)])), s + limit)
        out.append((s, e))
        s = next((q for q in range(e - limit // 10, e) if q > 0 and text[q - 1] in " \n"), e - limit // 10)
    return out + ([(s, len(text))] if len(text) > s else [])


def test_random_texts():
    random.seed(1)
    for limit in (4, 10, 33, 200):
        for _ in range(150):
            t = "".join(random.choice("ab .!?\n ä漢😀"[: random.choice([2, 3, 11])]) for _ in range(random.randrange(0, 700)))
            got = P.cut_points(t, limit)
            assert got == naive(t, limit)
            assert all(b - a <= limit for a, b in got) and all(x[1] >= y[0] > x[0] for x, y in zip(got, got[1:]))
    assert P.cut_points("", 5) == [] and P.cut_points("abc", 5) == [(0, 3)] and len(P.cut_points("x" * 1_000_000, 1000)) > 1000


def test_query(spark):
    at = datetime(2024, 1, 1)
    emb = spark.createDataFrame([("a", 2, at), ("a", None, datetime(2025, 1, 1)), ("b", None, at), ("a", 9, datetime(2020, 1, 1)), (None, 1, at)], "index_name string, context_length bigint, updated_at timestamp")
    docs = spark.createDataFrame(
        [("1", 1, "a", "word " * 5, 0), ("1", 2, "a", "word " * 5, 0), ("2", 3, "b", "x" * 99, 0), ("3", 4, "a", None, 0), ("4", 5, "a", "", 0), ("5", 6, "a", "12345678", 0), ("6", 7, None, "x" * 99, 0), ("7", 8, "a", "😀" * 9, 0)],
        "doc_id string, row_id bigint, index_name string, content string, max_chars int",
    )
    got = sorted(map(tuple, P.oversized_pieces(docs, emb).collect()))
    assert {r[0] for r in got} == {"1", "7"} and [(a, b) for d, _, a, b in got if d == "1"] == P.cut_points("word " * 5, 8)
    assert P.oversized_pieces(docs.limit(0), emb).count() == 0 and P.oversized_pieces(docs, emb.limit(0)).count() == 0


def prose(rng, words):
    return "".join(rng.choice(["harbour", "quay", "of", "the", "lot", "ledger", "räumt"]) + rng.choice([" ", " ", " ", " ", ". ", "\n", "\n\n"]) for _ in range(words))


def test_content_defined_pieces_fit_and_cover():
    rng = random.Random(2)
    for limit in (1, 2, 5, 40, 300, 1000):
        for t in ("", "a", "x" * 3000, " " * 1000, "\n\n" * 700, prose(rng, 1200), "😀漢" * 900):
            got = P.content_defined_cuts(t, limit)
            assert all(0 < b - a <= limit for a, b in got) and (not t and not got or got[0][0] == 0 and got[-1][1] == len(t))
            assert all(x[1] >= y[0] > x[0] and y[1] > x[1] for x, y in zip(got, got[1:]))


def test_landmarks_are_those_of_every_window():
    t = prose(random.Random(3), 3000)
    marks = set(P.landmarks(t, 6).tolist())
    assert marks and all((p in marks) == (P.landmarks(t[p - P.WINDOW : p], 6).tolist() == [P.WINDOW]) for p in range(P.WINDOW, 2000))


def test_an_edit_alters_only_neighbouring_pieces():
    """Cuts by distance all move behind an edit; content-defined ones are the old ones but for a few."""
    rng, limit, moved, by_distance, pieces = random.Random(4), 400, 0, 0, 0
    for _ in range(20):
        t = prose(rng, 4000)
        at = rng.randrange(len(t) // 4, len(t) // 2)
        u = t[:at] + "another few words. " + t[at:]
        for cuts, name in ((P.content_defined_cuts, "moved"), (P.cut_points, "by_distance")):
            old, new = {t[a:b] for a, b in cuts(t, limit)}, {u[a:b] for a, b in cuts(u, limit)}
            if name == "moved":
                moved, pieces = moved + len(old - new), pieces + len(old)
            else:
                by_distance += len(old - new)
    assert moved / 20 <= 2 and moved * 2 < by_distance and pieces / 20 > 40
