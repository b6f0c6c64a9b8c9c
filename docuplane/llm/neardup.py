"""Near-duplicate texts by runs of words: all pairs above a Jaccard similarity, exactly.

Runs of words are hashed into sets; equal sets are one class, so copies cost nothing. The similarity is a bound on the Hamming
distance of the sets, tau = (1 - t) / (1 + t) * (|x| + |y|). A pair within it shares some of the rarest runs of both (the universe is
ordered by frequency; so it's enough to look for partners through the first runs of each set). Pigeonring filtering then prunes the
candidates: the universe is cut into segments on a ring, and a pair can only be within tau if from some segment on every chain of
consecutive segments differs by no more than its share of tau. The segments are sketches whose width grows with the set, so they
tell the differences of long texts as well. What is left is compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from docuplane.session import Scratch

SEGMENTS = 8
#: Bits of a set's sketch for each of its runs, and the widest and narrowest sketch, in words of 64 bits a segment.
SKETCH_BITS, NARROWEST, WIDEST = 8, 1, 256
#: Frequencies are counted in this many buckets; one byte each is broadcast.
BUCKETS = 1 << 25
_K = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_K ** i and its inverse, modulo 2 ** 64, for i < n; kept and grown."""
    global _POWERS
    if len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_K), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _POWERS = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, k, np.uint64)]), dtype=np.uint64) for k in (_K, inverse))
    return _POWERS


_POWERS = (np.ones(1, np.uint64), np.ones(1, np.uint64))
_INSIDE = np.zeros(256, bool)
_INSIDE[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
#: Runs among the rarest that a pair must share to be compared.
SHARED = 2
#: A run that stands in so many texts, and so many times as often as others on average, is hot: each of its texts goes to one of SALTS tasks
#: and meets all others there.
HOT, HOT_TIMES, SALTS = 10_000, 50, 16
#: Tables that are merged at once.
FAN = 32
#: Bytes hashed at once.
_BLOCK = 1 << 22


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of a-z and 0-9 begins, and its hash; in blocks that end between words, without an object per word."""
    raw = np.frombuffer(data, np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = min(at + _BLOCK, len(raw))
        while end < len(raw) and _INSIDE[raw[end]] and _INSIDE[raw[end - 1]]:
            stop = np.flatnonzero(~_INSIDE[raw[end : end + _BLOCK]])
            end = end + int(stop[0]) if len(stop) else min(end + _BLOCK, len(raw))
        part = raw[at:end]
        edge = np.diff(np.concatenate([[False], _INSIDE[part], [False]]).astype(np.int8))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            up, down = _powers(len(part))
            with np.errstate(over="ignore"):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64)])
                h = _mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            starts.append(s + at)
            hashes.append(h)
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str | None], run: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the texts with at least `least` distinct runs of words, where their sets begin, and all sets, sorted."""
    none = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    raw = [t.lower().encode() if t else b"" for t in texts]
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in raw])])
    at, h = word_hashes(b"\n".join(raw))
    n = len(h) - run + 1
    if n < 1:
        return none
    with np.errstate(over="ignore"):
        s = h[:n].copy()
        for k in range(1, run):
            s = _mix(s * _K + h[k : n + k])
    doc = np.searchsorted(begin, at, side="right") - 1
    inside = doc[:n] == doc[run - 1 :]
    s, doc = s[inside], doc[:n][inside]
    o = np.lexsort((s, doc))
    s, doc = s[o], doc[o]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[first], doc[first]
    size = np.bincount(doc, minlength=len(texts))
    keep = size[doc] >= least
    rows = np.flatnonzero(size >= max(least, 1))
    return rows, np.concatenate([[0], np.cumsum(size[rows])]).astype(np.int64), s[keep]


def _classes(begin: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """A class id for each set: equal sets, equal ids."""
    size = np.diff(begin)
    if not len(size):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        a = np.add.reduceat(_mix(sets), begin[:-1])
        b = np.bitwise_xor.reduceat(_mix(sets ^ _K), begin[:-1])
        return _mix(a * _K + b + size.astype(np.uint64)).view(np.int64)


def sketch(runs: np.ndarray) -> np.ndarray:
    """SEGMENTS segments of a power of two of words each, by the size of the set; each run flips one bit, so bits that differ are a lower
    bound of the difference. Halves of a segment laid over each other are the sketch of half the width."""
    words = NARROWEST
    while words < WIDEST and words * 64 * SEGMENTS < SKETCH_BITS * len(runs):
        words *= 2
    x = _mix(runs + _K)
    segment, bit = (x % np.uint64(SEGMENTS)).astype(np.int64), (x >> np.uint64(8)) % np.uint64(64 * words)
    out = np.zeros(SEGMENTS * words, np.uint64)
    np.bitwise_xor.at(out, segment * words + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.view(np.int64)


def ring_holds(a: np.ndarray, b: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """For sketches of one width, row by row: whether from some segment on every chain of segments differs by no more than its share of
    tau."""
    d = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).reshape(len(a), SEGMENTS, -1).sum(2, dtype=np.int64)
    alive = np.ones((len(a), SEGMENTS), bool)
    sums = np.zeros((len(a), SEGMENTS), np.int64)
    for length in range(1, SEGMENTS + 1):
        sums += np.roll(d, 1 - length, axis=1)
        alive &= sums * SEGMENTS <= length * tau[:, None]
    return alive.any(1)


def _folded(x: np.ndarray, words: int) -> np.ndarray:
    """A sketch laid over itself until its segments have `words` words."""
    return np.bitwise_xor.reduce(x.reshape(SEGMENTS, -1, words), axis=1).ravel()


@F.pandas_udf(T.BooleanType())
def within_ring(a: pd.Series, b: pd.Series, tau: pd.Series) -> pd.Series:
    """Whether from some segment on every chain of segments differs by no more than its share of tau; a and b are sketches, of which the
    wider one is folded. All pairs of a batch with one width are looked at together."""
    width = np.minimum(a.map(len), b.map(len)).to_numpy() // SEGMENTS
    out, x, y, t = np.zeros(len(a), bool), a.to_numpy(), b.to_numpy(), tau.to_numpy()
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        left, right = (np.stack([_folded(z[i], int(w)) for i in at]) for z in (x, y))
        out[at] = ring_holds(left, right, t[at])
    return pd.Series(out)


def _gathered(texts: DataFrame, batches_of, bits: int, merge) -> np.ndarray:
    """A table of 2 ** bits bytes over all texts: each task's table goes out packed, in ranges, of which FAN at a time are merged into one
    until one is left. So no task holds more than FAN packed ranges of one place; the whole table, whose size is fixed, comes to the
    driver."""
    span = 1 << 16

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = batches_of(batches)
        where = TaskContext.get().partitionId()
        for r in range(len(total) // span):
            part = total[r * span : (r + 1) * span]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([where], pa.int32()), pa.array([zstandard.compress(part.tobytes(), 1)], pa.binary())], ["r", "w", "data"])

    def joined(packed: bool):
        def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(span, np.uint8)
            for d in rows["data"]:
                total = merge(total, np.frombuffer(zstandard.decompress(d), np.uint8))
            return pd.DataFrame({"r": [key[0]], "w": [key[1]], "data": [zstandard.compress(total.tobytes(), 1) if packed else total.tobytes()]})

        return join

    tables, left = texts.mapInArrow(pack, "r int, w int, data binary"), max(1, texts.rdd.getNumPartitions())
    while left > FAN:
        tables = tables.groupBy("r", F.floor(F.col("w") / FAN).cast("int").alias("w")).applyInPandas(joined(True), "r int, w int, data binary")
        left = -(-left // FAN)
    out = np.zeros(1 << bits, np.uint8)
    for row in tables.groupBy("r", F.lit(0).alias("w")).applyInPandas(joined(False), "r int, w int, data binary").collect():
        out[row["r"] * span : (row["r"] + 1) * span] = np.frombuffer(row["data"], np.uint8)
    return out


def _added(codes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Frequencies added; in steps of a byte: 0 to 127 as they are, above that an eighth of an octave each."""
    return _code(_count(codes) + _count(more))


_LADDER = np.concatenate([np.arange(128), np.round(128 * 2 ** (np.arange(128) / 8.0))]).astype(np.int64)


def _count(codes: np.ndarray) -> np.ndarray:
    return _LADDER[codes]


def _code(counts: np.ndarray) -> np.ndarray:
    return (np.searchsorted(_LADDER, counts, side="right") - 1).astype(np.uint8)


def class_pairs(texts: DataFrame, run: int = 3, similarity: Fraction = Fraction(3, 5), least: int = 20) -> tuple[DataFrame, DataFrame]:
    """texts: key, text. Returns members (key, class_id) and pairs (class_a, class_b, shared, size_a, size_b), class_a < class_b.

    Members: one row per row of texts with at least `least` distinct runs of `run` words. Pairs: all pairs of classes whose sets
    have a Jaccard similarity of at least `similarity`. Nulls, empty and short texts are in neither. What is broadcast is a
    table of frequencies of BUCKETS bytes and one of BUCKETS bits, however many texts there are.
    """
    spark = texts.sparkSession
    num, den = similarity.numerator, similarity.denominator
    texts = texts.select("key", "text").where("text is not null")
    key = texts.schema["key"].dataType.simpleString()
    mask = np.uint64(BUCKETS - 1)
    scratch = Scratch(spark, "neardup")

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total, held, n = np.zeros(BUCKETS, np.uint8), [], 0
        for b in batches:
            held.append((shingle_sets(b.column(1).to_pylist(), run, least)[2] & mask).astype(np.uint32))
            n += len(held[-1])
            if n > 4_000_000:
                at, c = np.unique(np.concatenate(held), return_counts=True)
                total[at], held, n = _code(_count(total[at]) + c), [], 0
        if held:
            at, c = np.unique(np.concatenate(held), return_counts=True)
            total[at] = _code(_count(total[at]) + c)
        return total

    table = _gathered(texts, count, BUCKETS.bit_length() - 1, _added)
    hot = int(_code(np.array([HOT + HOT_TIMES * _count(table).mean()]))[0])
    frequency = spark.sparkContext.broadcast(table)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, seen = frequency.value, set()
        for b in batches:
            _, begin, sets = shingle_sets(b.column(1).to_pylist(), run, least)
            if not len(sets):
                continue
            ids = _classes(begin, sets)
            size = np.diff(begin)
            fresh = np.array([c not in seen and not seen.add(c) for c in ids.tolist()])
            row = np.repeat(np.arange(len(size)), size)
            k = code[(sets & mask).astype(np.int64)]
            o = np.lexsort((sets, k, row))
            place = np.arange(len(sets)) - begin[row]
            prefix = size - -(-size * num // den) + SHARED
            take = (place < prefix[row]) & (k[o] > 1) & fresh[row]
            row, at, runs, k = row[take], place[take], sets[o][take].view(np.int64), k[o][take]
            # side 0 meets all, side 1 (in one salt) meets side 2 (in every salt)
            n = np.where(k > hot, SALTS + 1, 1)
            i = np.repeat(np.arange(len(row)), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            salted = n[i] > 1
            side = np.where(salted, np.where(j == SALTS, 1, 2), 0)
            salt = np.where(side == 2, j, np.where(salted, ids[row][i] % SALTS, 0))
            yield pa.RecordBatch.from_arrays([pa.array(runs[i]), pa.array(salt, pa.int8()), pa.array(side, pa.int8()), pa.array(ids[row][i]), pa.array(size[row][i], pa.int32()), pa.array(at[i], pa.int32())], ["run", "salt", "side", "class", "n", "place"])

    posts = texts.mapInArrow(post, "run bigint, salt tinyint, side tinyint, class bigint, n int, place int").repartition("run", "salt").dropDuplicates(["run", "salt", "side", "class"])
    x, y = posts.alias("x"), posts.alias("y")
    both = F.col("x.n") + F.col("y.n")
    left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + (SHARED - 1)
    fits = (F.col("x.class") < F.col("y.class")) & (F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num) & (left * (num + den) >= both * num)
    # 0 meets 0, 1 meets 2: said so that neither a filter below the exchange nor a further join key keeps both sides from sharing it
    sides = F.abs(F.col("y.side") - 2 * F.col("x.side")) < 1
    met = x.join(y, (F.col("x.run") == F.col("y.run")) & (F.col("x.salt") == F.col("y.salt")) & sides & fits).select(F.col("x.class").alias("class_a"), F.col("y.class").alias("class_b"), F.col("x.n").alias("size_a"), F.col("y.n").alias("size_b"))
    pairs = scratch.cut(met.groupBy("class_a", "class_b", "size_a", "size_b").count().where(F.col("count") >= SHARED).drop("count"))

    def wanted_bits(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(BUCKETS >> 3, np.uint8)
        for b in batches:
            c = np.concatenate([b.column(0).to_numpy(), b.column(1).to_numpy()]).view(np.uint64) & mask
            np.bitwise_or.at(total, (c >> np.uint64(3)).astype(np.int64), np.uint8(1) << (c & np.uint64(7)).astype(np.uint8))
        return total

    wanted = spark.sparkContext.broadcast(_gathered(pairs.select("class_a", "class_b"), wanted_bits, BUCKETS.bit_length() - 4, np.bitwise_or))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, set()
        for b in batches:
            rows, begin, sets = shingle_sets(b.column(1).to_pylist(), run, least)
            ids = _classes(begin, sets)
            c = ids.view(np.uint64) & mask
            need = bits[(c >> np.uint64(3)).astype(np.int64)] >> (c & np.uint64(7)).astype(np.uint8) & 1
            new = [bool(w) and k not in seen and not seen.add(k) for w, k in zip(need.tolist(), ids.tolist())]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64()),
                pa.array([sketch(sets[begin[i] : begin[i + 1]]) if n else None for i, n in enumerate(new)], kind),
                pa.array([sets[begin[i] : begin[i + 1]].view(np.int64) if n else None for i, n in enumerate(new)], kind),
            ], ["key", "class_id", "seg", "runs"])

    described = scratch.cut(texts.mapInArrow(describe, f"key {key}, class_id bigint, seg array<bigint>, runs array<bigint>"))
    ends = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).distinct()
    sets = scratch.cut(described.where("runs is not null").select("class_id", "seg", "runs").join(ends, "class_id", "left_semi").dropDuplicates(["class_id"]))
    seg, runs = sets.select("class_id", "seg"), sets.select("class_id", "runs")
    tau = F.floor((F.col("size_a") + F.col("size_b")) * F.lit(den - num) / F.lit(den + num))
    near = pairs.join(seg.toDF("class_a", "seg_a"), "class_a").join(seg.toDF("class_b", "seg_b"), "class_b").where(within_ring(F.col("seg_a"), F.col("seg_b"), tau)).drop("seg_a", "seg_b")
    checked = (
        near.join(runs.toDF("class_a", "runs_a"), "class_a")
        .join(runs.toDF("class_b", "runs_b"), "class_b")
        .withColumn("shared", F.size(F.array_intersect("runs_a", "runs_b")))
        .where((F.col("size_a") + F.col("size_b")) * num <= F.col("shared") * (num + den))
    )
    return described.select("key", "class_id"), checked.select("class_a", "class_b", "shared", "size_a", "size_b")


def file_text(docs: DataFrame) -> DataFrame:
    """key (doc_id), text: the last segment of display_path, a blank and the content; null counts as empty."""
    name = F.element_at(F.split(F.regexp_replace(F.coalesce("display_path", F.lit("")), r"\\", "/"), "/"), -1)
    return docs.where("doc_id is not null").select(F.col("doc_id").alias("key"), F.concat(name, F.lit(" "), F.coalesce("content", F.lit(""))).alias("text"))


def near_duplicate_pairs(texts: DataFrame, run: int = 3, similarity: Fraction = Fraction(3, 5), least: int = 20) -> DataFrame:
    """key_a < key_b: all pairs of different keys whose texts are near duplicates or copies; one row per pair.

    A key with several texts has a pair if one of them has it. Copies are compared as one class and only expanded here.
    """
    members, pairs = class_pairs(texts, run, similarity, least)
    members = members.distinct()
    a, b = members.toDF("key_a", "class_a"), members.toDF("key_b", "class_b")
    linked = pairs.select("class_a", "class_b").join(a, "class_a").join(b, "class_b").select("key_a", "key_b")
    same = a.join(b, F.col("class_a") == F.col("class_b")).where("key_a < key_b").select("key_a", "key_b")
    return linked.unionByName(same).where("key_a <> key_b").select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()
