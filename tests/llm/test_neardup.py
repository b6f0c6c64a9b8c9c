"""Pairs against comparing all with all."""

import random
import re
from fractions import Fraction
from itertools import combinations

import numpy as np

from pyspark.sql import functions as F

from docuplane.llm import neardup as N


def brute(rows, run, similarity, least):
    sets = {}
    for k, t in rows:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        s = frozenset(tuple(w[i : i + run]) for i in range(len(w) - run + 1))
        if len(s) >= least:
            sets.setdefault(k, set()).add(s)
    return {(a, b) for a, b in combinations(sorted(sets), 2) if any(len(x & y) >= similarity * len(x | y) for x in sets[a] for y in sets[b])}


def rows_of(seed, n):
    random.seed(seed)
    base = [[f"w{random.randrange(60)}" for _ in range(random.randrange(10, 90))] for _ in range(n)]
    rows = []
    for i, b in enumerate(base):
        for j in range(random.randrange(1, 5)):
            c = list(b)
            for _ in range(random.randrange(0, 12)):
                c[random.randrange(len(c))] = f"w{random.randrange(60)}"
            rows.append((f"d{i:02d}-{j}", " ".join(c)))
    return rows + [("copy1", " ".join(base[0])), ("copy2", " ".join(base[0]).upper()), ("null", None), ("empty", ""), ("short", "a b c")]


def test_pairs(spark):
    for seed, run, sim, least in ((1, 3, Fraction(3, 5), 20), (2, 2, Fraction(4, 5), 5)):
        rows = rows_of(seed, 25)
        df = spark.createDataFrame([(k, t, "clash") for k, t in rows + rows[:3]], "key string, text string, class_id string")
        got = [tuple(r) for r in N.near_duplicate_pairs(df, run, sim, least).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, run, sim, least) and got


def test_empty(spark):
    assert N.near_duplicate_pairs(spark.createDataFrame([], "key string, text string")).count() == 0


def test_a_hot_group_of_copies(spark):
    rows = [(f"c{i:03d}", " ".join(f"w{j}" for j in range(40))) for i in range(60)] + rows_of(9, 5)
    df = spark.createDataFrame(rows, "key string, text string")
    members, pairs = N.class_pairs(df)
    assert members.where("key like 'c0%'").select("class_id").distinct().count() == 1
    assert {tuple(r) for r in N.near_duplicate_pairs(df).collect()} == brute(rows, 3, Fraction(3, 5), 20)


def test_words_in_blocks(monkeypatch):
    data = ("Ab9 c漢d " * 50 + "x" * 100 + " end").lower().encode()
    whole = N.word_hashes(data)
    monkeypatch.setattr(N, "_BLOCK", 16)
    parts = N.word_hashes(data)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    names = [m.group() for m in re.finditer(rb"[a-z0-9]+", data)]
    assert len(names) == len(whole[0]) and len(set(whole[1].tolist())) == len(set(names))


def test_codes():
    c = np.arange(256)
    assert (N._code(N._count(c.astype(np.uint8))) == c).all() and N._added(np.uint8([1, 0, 127]), np.uint8([1, 0, 1])).tolist() == [2, 0, 128]


def test_file_text(spark):
    df = spark.createDataFrame([("1", "a\\b/C.txt", None), ("2", None, "x"), (None, "q", "y")], "doc_id string, display_path string, content string")
    assert [tuple(r) for r in N.file_text(df).collect()] == [("1", "C.txt "), ("2", " x")]


def test_the_ring_prunes_false_candidates_only(spark):
    """Pairs of all sizes and distances: none within the bound is lost, and nearly all that are clearly beyond it are pruned."""
    rng = np.random.default_rng(3)
    rows, truth = [], []
    for n in (20, 60, 150, 900, 5000):
        for part in np.linspace(0.3, 1, 40):
            m = int(n * rng.uniform(0.7, 1.4))
            both = rng.integers(0, 1 << 63, size=n + m, dtype=np.uint64)
            k = int(min(n, m) * part)
            x, y = both[:n], np.concatenate([both[:k], both[n : n + m - k]])
            tau, d = (n + m) // 4, n + m - 2 * k
            rows.append((len(rows), N.sketch(x).tolist(), N.sketch(y).tolist(), tau))
            truth.append((d <= tau, d > 1.15 * tau))
    df = spark.createDataFrame(rows, "i int, a array<bigint>, b array<bigint>, tau int")
    kept = {r.i for r in df.where(N.within_ring(F.col("a"), F.col("b"), F.col("tau"))).collect()}
    assert all(i in kept for i, (near, _) in enumerate(truth) if near)
    far = [i for i, (_, f) in enumerate(truth) if f]
    assert len(far) > 50 and sum(i not in kept for i in far) > 0.9 * len(far)


def test_hot_runs_meet_in_salts(spark, monkeypatch):
    rows = [(f"k{i:03d}", "one two three four five six seven eight " + " ".join(f"w{(i * 7 + j) % 40}" for j in range(6))) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, text string")
    plain = {tuple(r) for r in N.near_duplicate_pairs(df, 2, Fraction(3, 5), 4).collect()}
    monkeypatch.setattr(N, "HOT", 3)
    monkeypatch.setattr(N, "HOT_TIMES", 0)
    assert {tuple(r) for r in N.near_duplicate_pairs(df, 2, Fraction(3, 5), 4).collect()} == plain == brute(rows, 2, Fraction(3, 5), 4) and plain
